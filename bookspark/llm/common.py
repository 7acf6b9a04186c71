"""Plumbing shared by the corpus operators: table access, durable cuts of lineage, hot-bucket splitting, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words in contracts that split at white space, and the bytes of lines' margins.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: Maps each byte to itself if it may stand in a word (0-9, a-z, any byte of a non-ASCII character), else to a space.
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a UTF-8 text; null has none."""
    return text.lower().translate(WORD_BYTES).split() if text else []


_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset."""
    global _own_dir
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        folder = tempfile.mkdtemp(prefix="bookspark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_dir = f"file://{folder}"
    return _own_dir


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; one application's paths share a parent, to be removed after it ends."""
    return f"{shared_dir(spark)}/bookspark-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: later work survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(*cuts: DataFrame) -> None:
    """Removes tables that cut has given back, once whatever was worked out from them is cut itself."""
    for df in cuts:
        _remove(df.sparkSession, df._cut_path)


def remove_scratch(spark: SparkSession) -> None:
    """Removes all that this application has cut or written below the shared folder; results read from it are then gone."""
    _remove(spark, f"{shared_dir(spark)}/bookspark-{spark.sparkContext.applicationId}")


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of finished cuts: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Gives memory that a Python worker has freed back to the system.  Workers serve one stage after another, so what their
    allocators keep of a batch of texts would add up beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def bytes_col(column) -> F.Column:
    """Text as bytes: Python then sees whole texts even if they are not valid UTF-8."""
    return F.col(column).cast("binary")


def batches(it: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Joins small Arrow batches up to about `rows` rows, so vectorised work has something to chew on."""
    held, n = [], 0
    for b in it:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def split_hot(df: DataFrame, keys: list[str], member: str, cap: int) -> DataFrame:
    """Adds part_a, part_b and own so that all pairs within a bucket meet although no task gets a whole hot bucket.

    A bucket of at most `cap` rows keeps one cell (0, 0).  A larger one is dealt by a hash of `member` into
    p = ceil(rows / cap) parts, and each part goes to the p cells (a, b), a <= b, that name it; `own` is the row's
    part.  In a cell a < b only rows of different parts are to be compared, in a cell (a, a) all.  Buckets of one
    row are left out: they hold no pair.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    counts = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.ceil(F.col("__n") / cap).cast("int").alias("__p"))
    both = df.join(counts, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).drop(*[f"__{k}" for k in keys])
    both = both.withColumn("own", F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("__p")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("__p") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("a"), F.greatest(o, F.col("own")).alias("b")))
    both = both.withColumn("__c", F.explode(cells))
    return both.select(*df.columns, "own", F.col("__c.a").alias("part_a"), F.col("__c.b").alias("part_b"))


class Forest:
    """Union-find over the nodes of one block; gives back edges to each tree's smallest node."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (p := up.get(top, top)) != top:
            top = p
        while (p := up.get(x, x)) != top:
            up[x] = top
            x = p
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = [(self.root(x), x) for x in list(self.up)]
        pairs = [(r, x) for r, x in pairs if r != x]
        u = np.array([r for r, _ in pairs], dtype=np.int64)
        return u, np.array([x for _, x in pairs], dtype=np.int64)


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of edges (u, v: non-null longs); component is the smallest node reachable.

    Randomised contraction: in each round a node points to the neighbour (or itself) that comes first under a hash
    seeded by the round; edges are rewritten to those and distinct ones kept, so the nodes left shrink by a constant
    factor whatever the shape of the graph.  Nothing is gathered on the driver; each round is cut to the shared
    folder.  Aggregates combine before the shuffle and the joins are plain equi-joins that Spark may split, so a hub
    does not fill one task.  No edges: no rows.
    """
    edges = cut(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    for k in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", F.lit(k)).alias("h"), F.col("v").alias("n"))).alias("o"))
        me = F.struct(F.xxhash64("u", F.lit(k)).alias("h"), F.col("u").alias("n"))
        to = cut(first.select(F.col("u").alias("node"), F.least("o", me)["n"].alias("to")), "to")
        old = [edges]
        if labels is not None:
            old += [labels, to]
        labels = to if labels is None else cut(
            labels.join(to.select(F.col("node").alias("mid"), F.col("to").alias("next")), F.col("to") == F.col("mid"), "left").select("node", F.coalesce("next", "to").alias("to")), "labels")
        left = to.select(F.col("node").alias("u"), F.col("to").alias("a"))
        right = to.select(F.col("node").alias("v"), F.col("to").alias("b"))
        edges = edges.join(left, "u").join(right, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        edges = cut(edges.distinct(), "edges")
        drop(*old)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    drop(edges)
    least = labels.groupBy("to").agg(F.min("node").alias("component")).withColumnRenamed("to", "top")
    least = least.select("top", F.least("top", "component").alias("component"))
    return labels.join(least, F.col("to") == F.col("top")).select("node", "component")
