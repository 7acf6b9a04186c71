"""New book files, as they arrive, into the tables of contents and chapters' titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import reader

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of book, format, length, content; each trigger takes a bounded number of files."""
    stream = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").load(path)
    return reader.with_format(stream)


def epub_contents(files: DataFrame) -> DataFrame:
    """book, title, source, error and table of contents of arriving EPUB files: stateless, so it runs in append mode."""
    return files.where("format = 'EPUB'").select("book", reader.epub_index("content").alias("i")).select("book", "i.title", "i.source", "i.error", "i.toc")


def run_contents(spark: SparkSession, path: str, out: str, checkpoint: str):
    """Writes epub_contents of all files below path to Parquet at out, then stops; a later run takes only new files."""
    stream = epub_contents(arriving(spark, path)).withColumn("n_entries", F.size("toc"))
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
