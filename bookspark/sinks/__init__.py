"""Results as files: index documents, chapters, images, and listings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def index_documents(index: DataFrame) -> DataFrame:
    """book and json of each book from rows (book, ..., pos, level, title): the book's columns and its chapters in order.

    Columns named file_path, format, title and author of the book are given as book_*; the rest are the chapter's.
    """
    own = [c for c in index.columns if c.startswith("book_")]
    fields = [c for c in index.columns if c != "book" and c not in own]
    chapters = F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("__p"), F.struct(*[c for c in fields if c != "pos"]).alias("c")))), lambda x: x["c"])
    per = index.groupBy("book", *own).agg(chapters.alias("chapters"), F.count(F.lit(1)).alias("total_chapters"))
    document = F.struct(F.col("book").alias("file_path"), *[F.col(c).alias(c.removeprefix("book_")) for c in own], "total_chapters", "chapters")
    return per.select("book", F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))


def envelope(content: str = "content", image_paths: str | None = None) -> Column:
    """JSON of an extraction: success, the row's own fields, content, images, statistics."""
    from ..operators.pages import stats

    images = F.array().cast("array<string>") if image_paths is None else F.coalesce(F.col(image_paths), F.array().cast("array<string>"))
    return F.to_json(F.struct(F.lit(True).alias("success"), F.col("book").alias("file"), F.col("title"), F.col(content).alias("content"), images.alias("images_dumped"), stats(F.col(content), F.size(images)).alias("stats")))


def listing(toc: DataFrame, width: int = 40) -> DataFrame:
    """book, pos, line: a human-readable table of contents, indented by level, long titles cut."""
    title = F.when(F.length("title") > width, F.concat(F.substring("title", 1, width - 3), F.lit("..."))).otherwise(F.col("title"))
    line = F.concat(F.lpad(F.col("index").cast("string"), 4, " "), F.lit("  "), F.repeat(F.lit("  "), F.col("level") - 1), title)
    return toc.select("book", "pos", line.alias("line"))


def write_index(documents: DataFrame, folder: str) -> DataFrame:
    """Writes index documents (book, json) as <hash of the book>.index.json below folder; name, path, length once used."""
    return write_files(documents.select(F.concat(F.sha1(F.col("book").cast("binary")), F.lit(".index.json")).alias("name"), F.col("json").alias("data")), folder)


def write_chapters(chapters: DataFrame, folder: str, extension: str = "md") -> DataFrame:
    """Writes extracted chapters (book, pos, content) as <hash of the book>/<pos from 1, six digits>.<extension> below folder."""
    name = F.concat(F.sha1(F.col("book").cast("binary")), F.lit("/"), F.lpad((F.col("pos") + 1).cast("string"), 6, "0"), F.lit(f".{extension}"))
    return write_files(chapters.dropDuplicates(["book", "pos"]).select(name.alias("name"), F.col("content").alias("data")), folder)


def write_files(rows: DataFrame, folder: str, name: str = "name", data: str = "data") -> DataFrame:
    """Writes each row's data (binary or string) as folder/name and returns name, path, length.

    folder is a URI of a store that all executors reach.  A file is written under another name and then moved, so a task
    that is run again leaves whole files only.  Nothing is written before the result is used.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            names, sizes = b.column(0).to_pylist(), []
            for n, d in zip(names, b.column(1)):
                body = d.as_py() or b""
                target = f"{root}/{n}"
                fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                temp = f"{target}.{uuid.uuid4().hex}"
                with fs.open_output_stream(temp) as out:
                    out.write(body)
                if fs.get_file_info(target).type != pafs.FileType.NotFound:  # of an earlier run
                    fs.delete_file(target)
                fs.move(temp, target)
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([f"{folder}/{n}" for n in names], pa.string()), pa.array(sizes, pa.int64())], names=["name", "path", "length"])

    return rows.select(F.col(name), F.col(data).cast("binary")).mapInArrow(write, "name string, path string, length long")


def writable(folders: Iterable[str | None]) -> str:
    """The first of the folders (URIs; null and blank ones are passed over) in which a file can be written; OSError if in none.

    The test runs on the driver.  On a cluster, name only folders that all executors share.
    """
    tried = []
    for folder in folders:
        if not folder or not folder.strip():
            continue
        try:
            fs, root = pafs.FileSystem.from_uri(folder)
            fs.create_dir(root, recursive=True)
            probe = f"{root}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(probe) as out:
                out.write(b"x")
            fs.delete_file(probe)
            return folder
        except (OSError, pa.ArrowInvalid) as e:
            tried.append(f"{folder}: {e}")
    raise OSError("no folder can be written: " + "; ".join(tried))


def cache_folder(spark: SparkSession, *preferred: str | None) -> str:
    """A folder for what may be used again: the first writable one of `preferred`, then of spark.checkpoint.dir, then,
    only if Spark is local, a fresh temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    try:
        return writable([*preferred, shared])
    except OSError:
        if not spark.sparkContext.master.startswith("local"):
            raise
        return f"file://{tempfile.mkdtemp(prefix='bookspark-cache-')}"
