"""Line dedup: normalised lines that many documents share are dropped, and texts put together again by position."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """A line's key (margins stripped, A-Z lower-cased), or None if it has fewer code points than counted lines have."""
    key = line.strip(common.ASCII_SPACE)
    if len(key) < min_chars:
        return None
    if not key.isascii() and sum(b & 0xC0 != 0x80 for b in key) < min_chars:
        return None
    return key.lower()


def _digests(text: bytes | None, min_chars: int) -> list[bytes]:
    keys = (line_key(x, min_chars) for x in (text or b"").split(b"\n"))
    return list(dict.fromkeys(xxhash.xxh3_128_digest(k) for k in keys if k is not None))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept_text (binary, UTF-8).

    Texts are split at \\n.  Each document gives its distinct line keys of at least min_chars code points as 128-bit
    hashes; keys found in min_docs documents lose all their lines except in the largest doc_id that holds them.  Only
    hashes are shuffled for counting, combined before the shuffle, so a line that a third of all documents share is one
    partial count a task; the common keys are cut to a table, so the join that brings verdicts back is between two tables
    and Spark may broadcast the small one or split a hot key.

    Null or empty text: one empty line.  Every row counts as a document of its own, and rows tied for the largest id
    keep the line.  A null id is smaller than any other.  Empty table: no rows.  Other columns are not read.
    """

    @F.arrow_udf("array<binary>")
    def digests(texts: pa.Array) -> pa.Array:
        return pa.array([_digests(t.as_py(), min_chars) for t in texts], pa.list_(pa.binary()))

    @F.arrow_udf("n_lines long, n_dropped long, kept_text binary")
    def keep(texts: pa.Array, drops: pa.Array) -> pa.Array:
        n_lines, n_dropped, kept = [], [], []
        for t, d in zip(texts, drops):
            lines, bad = (t.as_py() or b"").split(b"\n"), set(d.as_py() or ())
            left = lines
            if bad:
                keys = [line_key(x, min_chars) for x in lines]
                left = [x for x, k in zip(lines, keys) if k is None or xxhash.xxh3_128_digest(k) not in bad]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(left))
            kept.append(b"\n".join(left))
        return pa.StructArray.from_arrays([pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary())], ["n_lines", "n_dropped", "kept_text"])

    body = docs.select(F.col(doc_id).alias("doc_id"), common.bytes_col(text).alias("body"))
    keys = common.cut(body.select("doc_id", F.explode(digests("body")).alias("key")), "lines")
    common_keys = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    common_keys = common.cut(common_keys.select(F.col("key").alias("common"), "keeper"), "common-lines")
    verdicts = keys.join(common_keys, F.col("key") == F.col("common")).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = verdicts.groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("key").alias("drops"))
    both = body.join(drops, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return both.select("doc_id", keep("body", "drops").alias("o")).select("doc_id", "o.n_lines", "o.n_dropped", "o.kept_text")
