"""Benchmark decontamination: Wu-Manber multi-pattern search for benchmark windows in whole documents."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of benchmark text whose windows are searched for at once; a larger benchmark is searched in blocks.
BLOCK_BYTES = 8 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


class WuManber:
    """Finds every occurrence of any of some byte strings: data[starts[i]:ends[i]], which may overlap but not be equal.

    With m the shortest length and b the block length, `shift` says for each hashed block in the first m bytes of a string
    how far its end is from m; a block in none of them lets the search jump m - b + 1 bytes.  At shift 0 the block
    may end some strings' first m bytes: only those, side by side in `suffix`, are compared.  Takes some ten bytes a byte of data.
    """

    def __init__(self, data: bytes, starts: np.ndarray, ends: np.ndarray, block: int = 8) -> None:
        self.data, self.starts, self.ends = data, starts, ends
        self.m = m = int((ends - starts).min())
        self.b = b = min(block, 8, m)
        self.far = min(m - b + 1, 255)
        self.bits = max(10, (4 * len(data)).bit_length())
        codes = self._codes(data)
        slots = self._slots(codes)
        self.shift = np.full(1 << self.bits, self.far, dtype=np.uint8)
        for j in range(m - b + 1):  # the least shift of a block comes last
            self.shift[slots[starts + j]] = min(m - b - j, self.far)
        last = codes[starts + (m - b)]
        self.order = np.argsort(last, kind="stable")
        self.suffix = last[self.order]

    def _codes(self, text: bytes) -> np.ndarray:
        """The block at each place as a number."""
        return np.ndarray((max(0, len(text) - self.b + 1),), "<u8", text + bytes(8), 0, (1,)) & np.uint64((1 << 8 * self.b) - 1)

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return (codes * _ODD) >> np.uint64(64 - self.bits)

    def find(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(start, number of the string) of all occurrences in ascending order of start."""
        if len(text) < self.m:
            return
        codes = self._codes(text)
        shift = self.shift[self._slots(codes)].tobytes()
        at, n = self.m - self.b, len(shift)
        while at < n:
            s = shift[at]
            if s:
                at += s
                continue
            start = at + self.b - self.m
            i = int(np.searchsorted(self.suffix, codes[at]))
            while i < len(self.suffix) and self.suffix[i] == codes[at]:
                k = int(self.order[i])
                if text.startswith(self.data[self.starts[k] : self.ends[k]], start):
                    yield start, k
                i += 1
            at += 1


class Windows:
    """The windows of some benchmark items, one matcher for each window length in words."""

    def __init__(self, items: Iterable[tuple[int | None, bytes | None]], window: int) -> None:
        self.ids: list[int | None] = []
        pieces: list[bytes] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = defaultdict(list)
        at = 0
        for item, text in items:
            w = common.words_of(text)
            if not w:
                continue
            k = min(window, len(w))
            edges = np.cumsum([0, *(len(x) + 1 for x in w)]) + at  # the spaces before words, and the last
            found[k].append((edges[: len(w) - k + 1], edges[k:] + 1, len(self.ids)))
            self.ids.append(item)
            pieces.append(b" %s " % b" ".join(w))
            at += len(pieces[-1])
        data = b"".join(pieces)
        self.search: dict[int, tuple[WuManber, np.ndarray, np.ndarray]] = {}
        for k, parts in found.items():
            starts, ends = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            owner = np.concatenate([np.full(len(p[0]), p[2], dtype=np.int64) for p in parts])
            digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[i:j]) for i, j in zip(starts.tolist(), ends.tolist())]), dtype="V16")
            _, first, which = np.unique(digests, return_index=True, return_inverse=True)
            by = np.argsort(which, kind="stable")  # owners of a window side by side
            self.search[k] = WuManber(data, starts[first], ends[first]), owner[by], np.searchsorted(which[by], np.arange(len(first) + 1))

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged word ranges inside any window, and the items with an id whose windows occur."""
        text = b" %s " % b" ".join(words)
        hits, seen = [], set()
        for k, (search, owner, edges) in self.search.items():
            at = word = 0
            for start, p in search.find(text):
                word += text.count(b" ", at, start)
                at = start
                hits.append((word, word + k))
                seen.add((k, p))
        items = {self.ids[i] for k, p in seen for i in self.search[k][1][self.search[k][2][p] : self.search[k][2][p + 1]]}
        return merged(hits), items - {None}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_HITS = "n_words long, spans array<struct<start:long,end:long>>, items array<long>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


#: The windows that this Python worker has built last: by name of the block.
_built: dict[str, Windows] = {}


def _searcher(items: list[tuple[int | None, bytes]], window: int):
    """Executors get a block's texts and build its shift tables themselves, once a worker."""
    name = uuid.uuid4().hex

    @F.arrow_udf(_HITS)
    def hits(texts: pa.Array) -> pa.Array:
        windows = _windows(name, items, window)
        n, spans, items_ = [], [], []
        for t in texts:
            w = common.words_of(t.as_py())
            s, i = windows.spans(w) if w else ([], set())
            n.append(len(w))
            spans.append([{"start": a, "end": b} for a, b in s])
            items_.append(sorted(i))
        common.release()
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(items_, pa.list_(pa.int64()))], ["n_words", "spans", "items"])

    return hits


def _windows(name: str, items: list[tuple[int | None, bytes]], window: int) -> Windows:
    if name not in _built:
        _built.clear()
        _built[name] = Windows(items, window)
    return _built[name]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, into: str = "hits") -> DataFrame:
    """docs with a column `into`: struct(n_words, spans of hit words (end exclusive), items with occurring windows).

    Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters.  A window is `window` consecutive words of an
    item; an item of fewer words, but not none, is one window.  A benchmark of up to BLOCK_BYTES is one block, whose texts
    go to the executors with the function that searches for them, in one pass without a shuffle.  A larger one is cut into blocks
    by hash: rows are numbered in a written table, each block's pass writes the rows with hits, and these are merged by number.
    The driver holds the texts of one block at a time and never a matcher.

    Null or empty text: no words.  Items that are null or have no words have no windows; those with a null id
    count in spans but are not listed in items.
    Items with equal texts are all reported.  Empty benchmark: no hits.  All columns of docs stay; one that is already
    named as `into` is replaced.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), common.bytes_col(item_text).alias("t")).where("t is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("t").cast("long")), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK_BYTES))
    if n == 1:
        return docs.withColumn(into, _searcher([(r["i"], bytes(r["t"])) for r in items.collect()], window)(common.bytes_col(text)))
    rows = common.cut(docs.drop(into).select(F.struct("*").alias("row"), common.bytes_col(text).alias("body"), F.monotonically_increasing_id().alias("n")), "numbered")
    found, blocks = None, []
    for k in range(n):
        block = [(r["i"], bytes(r["t"])) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]
        some = rows.select("n", _searcher(block, window)("body").alias("h")).select("n", "h.spans", "h.items").where(F.size("spans") > 0)
        some = common.cut(some, "block")
        blocks.append(some)
        found = some if found is None else found.unionByName(some)

    @F.arrow_udf(_SPANS_DDL)
    def merge(spans: pa.Array) -> pa.Array:
        return pa.array([[{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in s.as_py()])] for s in spans], _SPANS)

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len(common.words_of(t.as_py())) for t in texts], pa.int64())

    by_row = found.groupBy(F.col("n").alias("of")).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    by_row = common.cut(by_row.select("of", merge("spans").alias("spans"), "items"), "merged")
    common.drop(*blocks)
    out = rows.join(by_row, F.col("n") == F.col("of"), "left").withColumn("n_words", count("body"))
    hits = F.struct("n_words", F.coalesce("spans", F.array().cast(_SPANS_DDL)).alias("spans"), F.coalesce("items", F.array().cast("array<long>")).alias("items"))
    return out.select("row", hits.alias("hits")).select("row.*", F.col("hits").alias(into))


_SPANS_DDL = "array<struct<start:long,end:long>>"
