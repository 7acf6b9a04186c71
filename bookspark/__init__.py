"""bookspark: chapters of electronic books and paged documents, as Spark DataFrames."""
