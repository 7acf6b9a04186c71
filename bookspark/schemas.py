"""Schemas of the relations that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

TOC = T.StructType(
    [
        T.StructField("book", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("pos", T.IntegerType()),  # 0-based place in the list
        T.StructField("index", T.IntegerType()),  # 1-based number that users see; may have gaps
        T.StructField("level", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("src", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("anchor", T.StringType()),
        T.StructField("char_offset", T.LongType()),
        T.StructField("phys", T.IntegerType()),
    ]
)
PAGE = "book string, phys int, text string, label string"
BOOKMARK = "book string, pos int, level int, title string, phys int"


def conform(df, schema: T.StructType = TOC):
    """df with the schema's columns, in order; those it lacks are null."""
    from pyspark.sql import functions as F

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
