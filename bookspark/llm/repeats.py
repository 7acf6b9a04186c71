"""Suffix-array dedup: bytes covered by a long string that also starts earlier in the corpus are removed."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .suffixes import suffix_array

#: Bytes of documents that are hashed together, and runs that a task gathers before it passes them on.
BATCH, GATHERED = 1 << 20, 1 << 19
#: Most symbols of the texts that share an anchor and are put into one suffix array; larger groups get longer anchors.
ARRAY = 1 << 15
#: Contents of one key among a task's gathered runs from which they are dealt by content, not by key.
SPREAD = 64
#: Input bytes for one bucket of keys, and the least number of buckets.
BUCKET_BYTES, LEAST = 16 << 20, 512

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) <= n:
        n = max(n, BATCH + (BATCH >> 2))
        _powers = tuple(np.multiply.accumulate(np.r_[_U(1), np.full(n, b, dtype=np.uint64)]) for b in (_U(_BASE), _U(pow(_BASE, -1, 1 << 64))))
    return _powers


def window_runs(texts: list[bytes], length: int, core: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows of `length` bytes that have the same core: text, start, windows - 1, core's place in the
    first window, key (hash of the core) and content (128-bit BLAKE2b digest of the run's bytes, as two numbers).

    A window's core is the `core`-byte string in it with the least hash, the first of equal ones, so it depends on the
    window's bytes alone: equal windows have equal keys and the core in the same place.
    """
    joined = b"".join(texts)
    data = np.frombuffer(joined, dtype=np.uint8)
    n = len(data)
    ends = np.cumsum([len(t) for t in texts])
    if n < length:
        return (*(np.empty(0, dtype=np.int64) for _ in range(4)), np.empty(0, dtype=_U), np.empty((0, 2), dtype=_U))
    up, down = _powers_to(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    h = _mix((total[core:] - total[:-core]) * down[: n - core + 1])
    least = (h & ~_U(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    places, span = length - core + 1, 1
    while span * 2 <= places:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < places:
        least = np.minimum(least[: len(least) - (places - span)], least[places - span :])
    at = (least & _U(0xFFFFFFFF)).astype(np.int64)
    begins = np.r_[0, ends[:-1]]
    new = np.r_[True, at[1:] != at[:-1]]
    new[begins[begins < len(at)]] = True
    start = np.flatnonzero(new)
    stop = np.r_[start[1:] - 1, len(at) - 1]
    text = np.searchsorted(ends, start, side="right")
    last = ends[text] - length  # the last window within the text
    ok = start <= last
    start, stop, text = start[ok], np.minimum(stop[ok], last[ok]), text[ok]
    content = b"".join([blake2b(joined[i:j], digest_size=16).digest() for i, j in zip(start.tolist(), (stop + length).tolist())])
    return text, start - begins[text], stop - start, at[start] - start, h[at[start]], np.frombuffer(content, dtype="<u8").reshape(-1, 2)


_RUN = np.dtype([("key", "<u8"), ("content", "<u8"), ("content2", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("more", "u1"), ("place", "u1")])


def _pack(runs: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(runs[f]).tobytes() for f in _RUN.names)


def _unpack(data: bytes) -> np.ndarray:
    n = len(data) // _RUN.itemsize
    out, at = np.empty(n, dtype=_RUN), 0
    for f in _RUN.names:
        size = _RUN[f].itemsize * n
        out[f] = np.frombuffer(data, dtype=_RUN[f], count=n, offset=at)
        at += size
    return out


def _first_of(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs sorted by (key, content, doc, start), and whether each is the first of its key and content."""
    runs = runs[np.lexsort((runs["start"], runs["doc"], runs["content2"], runs["content"], runs["key"]))]
    first = np.ones(len(runs), dtype=bool)
    first[1:] = (runs["key"][1:] != runs["key"][:-1]) | (runs["content"][1:] != runs["content"][:-1]) | (runs["content2"][1:] != runs["content2"][:-1])
    return runs, first


def _contents(runs: np.ndarray) -> np.ndarray:
    """For each of the first runs in order of key, how many its key has."""
    new = np.ones(len(runs), dtype=bool)
    new[1:] = runs["key"][1:] != runs["key"][:-1]
    number = np.cumsum(new) - 1
    return np.bincount(number)[number] if len(runs) else np.empty(0, dtype=np.int64)


#: How packed runs are dealt and what they are: by key; later runs of a content; by content, of a key that has many; and
#: one run that tells its key's bucket that the key is such.
BY_KEY, AGAIN, SPREAD_OUT, TOLD = range(4)
_FOUND = "doc long, start long, more int, place int, kind byte, content binary"


def _found(runs: np.ndarray, kind: int) -> pa.RecordBatch:
    """AGAIN: all windows of these runs start earlier elsewhere, too.  BY_KEY: first runs whose windows may do so.
    SPREAD_OUT: runs of which those that are the first of their content may do so."""
    n = len(runs)
    content = pa.nulls(n, pa.binary())
    if kind == SPREAD_OUT:
        whole = np.ascontiguousarray(np.stack([runs["key"], runs["content"], runs["content2"]], axis=1)).tobytes()
        content = pa.array([whole[i : i + 24] for i in range(0, len(whole), 24)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(runs["doc"]), pa.array(runs["start"].astype(np.int64)), pa.array(runs["more"].astype(np.int32)), pa.array(runs["place"].astype(np.int32)), pa.array(np.full(n, kind, dtype=np.int8)), content], names=["doc", "start", "more", "place", "kind", "content"])


def equal_windows(texts: list[tuple[bytes, int, int, int, int, bytes]], length: int) -> list[tuple[int, int]]:
    """(doc, start) of windows that also start earlier, among (anchor, doc, start, windows - 1, anchor's place, bytes).

    One suffix array holds all texts.  The anchor, bytes that lie in all windows of a text and at the same place in equal
    ones, is one symbol of its own, so a window is `length - len(anchor) + 1` symbols; separators are the least
    symbol.  Equal windows are next to each other among the windows' suffixes.
    """
    anchors: dict[bytes, int] = {}
    codes: list[int] = []
    owner: dict[int, tuple[int, int, int]] = {}
    for anchor, doc, start, more, place, body in texts:
        symbol = anchors.setdefault(anchor, 257 + len(anchors))
        at = len(codes)
        codes += [1 + b for b in body[:place]]
        codes.append(symbol)
        codes += [1 + b for b in body[place + len(anchor) :]]
        codes.append(0)
        for i in range(more + 1):
            owner[at + i] = (doc, start + i, length - len(anchor) + 1)
    array = np.array(codes, dtype="<u4").tobytes()
    out: list[tuple[int, int]] = []
    least = previous = None
    for s in suffix_array(codes):
        if s in owner:
            doc, start, width = owner[s]
            window, here = array[4 * s : 4 * (s + width)], (doc, start)
            if window == previous:
                out.append(max(here, least))
                least = min(here, least)
            else:
                previous, least = window, here
    return out


def ranges(windows: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(doc, start, windows - 1) of runs of consecutive windows."""
    out: list[tuple[int, int, int]] = []
    for d, s in sorted(windows):
        if out and out[-1][0] == d and out[-1][1] + out[-1][2] + 1 == s:
            out[-1] = (d, out[-1][1], out[-1][2] + 1)
        else:
            out.append((d, s, 0))
    return out


def cover(body: bytes, starts: list[tuple[int, int]], length: int) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs and what is left, given (start, windows - 1) of removed windows."""
    removed = spans = 0
    left = []
    end = -1
    for a, more in sorted(starts):
        b = a + more + length
        if a > end:
            spans += 1
            left.append(body[max(end, 0) : a])
            removed += b - a
            end = b
        elif b > end:
            removed += b - end
            end = b
    left.append(body[max(end, 0) :])
    return removed, spans, b"".join(left)


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 100, core: int = 50) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (binary).

    Removed is each byte covered by a `length`-byte string that also starts earlier: in a smaller doc_id, or in the same
    document further left.  Matches never cross documents and are judged on the input.

    1. Windows of `length` bytes are cut into runs with one core (see window_runs), about one run for 25 windows, and
       only the runs' hashes are shuffled.  A run whose key and 128-bit BLAKE2b digest are those of an earlier one is
       removed whole; a task passes on just its first of each.  Runs alone in their key are unique: no window of theirs can
       occur elsewhere.  Runs of a key that has many contents within one task are dealt by content instead, and a
       mark sent to the key's bucket has the others follow, so that no task gets all of a hot key.
    2. What is left are keys with several contents: texts around an edit or at the edge of a passage.  Only their first
       runs' bytes are fetched.  Texts with one anchor, at first the core, are sorted in one suffix array (see
       suffixes); equal windows are neighbours there.
    3. Texts of an anchor with over ARRAY symbols, such as those at the edge of a passage that a third of all documents
       share, are cut in two by the core's place in their windows.  All windows of a half have more bytes in common than the
       core; these become its anchor, so texts that differ there part.  Equal halves are settled at once, and what is
       still too large is halved again.  At last a half is one window and its anchor all of it.  A text is
       halved six times at most, and as a rule one of its halves parts from all others each time.
    4. Removed windows go back to their documents.

    Whole runs are told apart by digests, all else byte by byte.  Null text is empty.  Rows of equal ids would share a
    document's removed windows, so the result is defined for distinct non-null ids; repeated or null ids are numbered apart first, in order of
    their texts' hashes, null before all.  Empty table: no rows.  Other columns are not read.
    """
    if not 0 < core < length <= core + 255:
        raise ValueError("core must be positive and less than length, by at most 255")
    spark = docs.sparkSession
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(common.bytes_col(text), F.lit(b"")).alias("body"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 56:  # Spark cannot tell
        size = body.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    buckets = LEAST
    while buckets * BUCKET_BYTES < size:
        buckets *= 2

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            if not held:
                return
            all_runs, first = _first_of(np.concatenate(held))
            held, n = [], 0
            again, keep = all_runs[~first], all_runs[first]
            many = _contents(keep) >= SPREAD
            told = many & np.r_[True, keep["key"][1:] != keep["key"][:-1]]
            at, kinds, data = [], [], []
            for kind, part in ((BY_KEY, keep[~many]), (TOLD, keep[told])):
                bucket = (part["key"] >> _U(20)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                part, bucket = part[order], bucket[order]
                edges = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(part)] if len(part) else np.zeros(1, dtype=np.int64)
                at += [int(bucket[i]) for i in edges[:-1]]
                data += [_pack(part[i:j]) for i, j in zip(edges[:-1], edges[1:])]
                kinds += [kind] * (len(data) - len(kinds))
            for kind, part in ((AGAIN, again), (SPREAD_OUT, keep[many])):
                data += [_pack(part[i : i + 4096]) for i in range(0, len(part), 4096)]
                at += [(i * 977) % buckets for i in range(len(data) - len(at))]
                kinds += [kind] * (len(data) - len(kinds))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(kinds, pa.int8()), pa.array(data, pa.binary())], names=["bucket", "kind", "runs"])

        def work(ids: list[int], texts: list[bytes], at: int = 0) -> None:
            nonlocal n
            text_no, start, more, place, key, content = window_runs(texts, length, core)
            out = np.empty(len(start), dtype=_RUN)
            out["doc"], out["start"], out["more"], out["place"], out["key"] = np.array(ids, dtype=np.int64)[text_no], start + at, more, place, key
            out["content"], out["content2"] = content[:, 0], content[:, 1]
            held.append(out)
            n += len(out)

        for b in batches:
            ids, texts, total = [], [], 0
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                if len(t) < length:
                    continue
                if len(t) > BATCH:  # a long text in pieces that share no window
                    for at in range(0, len(t) - length + 1, BATCH):
                        work([d], [t[at : at + BATCH + length - 1]], at)
                        if n >= GATHERED:
                            yield from flush()
                    continue
                ids.append(d)
                texts.append(t)
                total += len(t)
                if total >= BATCH:
                    work(ids, texts)
                    ids, texts, total = [], [], 0
                    if n >= GATHERED:
                        yield from flush()
            if ids:
                work(ids, texts)
        yield from flush()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, told = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            runs = np.concatenate(held)
            if told:  # their keys' other runs are not here
                out = np.isin(runs["key"], np.concatenate(told)["key"])
                yield _found(runs[out], SPREAD_OUT)
                runs = runs[~out]
            runs, first = _first_of(runs)
            yield _found(runs[~first], AGAIN)
            keep = runs[first]
            yield _found(keep[_contents(keep) > 1], BY_KEY)

        for b in batches:
            for bucket, kind, data in zip(*(c.to_pylist() for c in b.columns)):
                got = _unpack(data)
                if kind in (AGAIN, SPREAD_OUT):
                    yield _found(got, kind)
                    continue
                if bucket != current:
                    yield from done()
                    current, held, told = bucket, [], []
                (told if kind == TOLD else held).append(got)
        yield from done()

    body = _numbered(body)
    dealt = body.select("place", "body").mapInArrow(runs, "bucket int, kind byte, runs binary").repartition("bucket").sortWithinPartitions("bucket")
    found = common.cut(dealt.mapInArrow(resolve, _FOUND), "runs")
    common.tidy(spark)

    spread = found.where(F.col("kind") == SPREAD_OUT).select("doc", "start", "more", "place", "content")
    first = spread.groupBy(F.col("content").alias("of")).agg(F.min(F.struct("doc", "start")).alias("first"))
    spread = common.cut(spread.join(first, F.col("content") == F.col("of")).withColumn("again", F.struct("doc", "start") != F.col("first")).select("doc", "start", "more", "place", "again"), "spread")
    wanted = found.where(F.col("kind") == BY_KEY).select("doc", "start", "more", "place").unionByName(spread.where("not again").drop("again"))
    wanted = wanted.groupBy("doc").agg(F.collect_list(F.struct("start", "more", "place")).alias("want"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, t, want in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                t = t.as_py()
                for w in want.as_py():
                    rows.append((doc, w["start"], w["more"], w["place"], t[w["start"] : w["start"] + w["more"] + length]))
            for i in range(0, len(rows), 8192):
                part = rows[i : i + 8192]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["doc", "start", "more", "place", "body"])

    texts = body.join(wanted, F.col("place") == F.col("doc")).select(F.col("place"), "body", "want")
    texts = common.cut(texts.mapInArrow(fetch, "doc long, start long, more int, place int, body binary"), "texts")
    common.tidy(spark)
    late, used = _settled(texts, length, core)
    late = common.cut(late, "windows")
    common.drop(texts, *used)
    common.tidy(spark)

    gone = found.where(F.col("kind") == AGAIN).select("doc", "start", "more").unionByName(spread.where("again").select("doc", "start", "more")).unionByName(late)
    gone = gone.groupBy("doc").agg(F.collect_list(F.struct("start", "more")).alias("gone"))

    @F.arrow_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def apply(bodies: pa.Array, gone: pa.Array) -> pa.Array:
        rows = []
        for t, g in zip(bodies, gone):
            t = t.as_py()
            rows.append((len(t), *cover(t, [(w["start"], w["more"]) for w in g.as_py() or ()], length)))
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["n_bytes", "n_removed", "n_spans", "kept"])

    both = body.join(gone, F.col("place") == F.col("doc"), "left")
    return both.select("doc_id", apply("body", "gone").alias("o")).select("doc_id", "o.n_bytes", "o.n_removed", "o.n_spans", "o.kept")


def _settled(texts: DataFrame, length: int, core: int) -> tuple[DataFrame, list[DataFrame]]:
    """(doc, start, more): the windows that start earlier, too, among texts (doc, start, more, place, body) told apart; and
    the tables that it reads."""
    spark = texts.sparkSession

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole groups of two texts or more, then the group that is being read
        begun = symbols = 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            again = ranges(equal_windows(rows, length))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in again], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["doc", "start", "more"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and row[0] != held[-1][0]:
                    if begun == len(held) - 1:  # a text alone
                        symbols -= len(held[-1][5]) - len(held.pop()[0]) + 2
                    if symbols >= ARRAY:
                        yield out(held)
                        held, symbols = [], 0
                    begun = len(held)
                held.append(row)
                symbols += len(row[5]) - len(row[0]) + 2
        if begun < len(held) - 1 or begun:
            yield out(held)

    level = texts.withColumn("anchor", F.expr(f"substring(body, place + 1, {core})")).withColumn("at", F.col("place"))
    width = 1 << (length - core).bit_length()
    out, used = [], []
    while True:
        sizes = level.groupBy("anchor").agg(F.sum(F.octet_length("body") - F.octet_length("anchor") + 2).alias("n"), F.count(F.lit(1)).alias("c")).where("c > 1")
        sizes = common.cut(sizes.groupBy((F.col("n") > ARRAY).alias("hot"), F.when(F.col("n") > ARRAY, F.col("anchor")).alias("over")).agg(F.sum("n").alias("n")), "sizes")
        used.append(sizes)
        symbols, hot = sizes.agg(F.sum("n"), F.count("over")).first()
        over = sizes.where("hot").select("over")
        cold = level.join(over, F.col("anchor") == F.col("over"), "left_anti") if hot else level
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(symbols or 0) // (64 * ARRAY)))
        cold = cold.select("anchor", "doc", "start", "more", "at", "body").repartition(parts, "anchor").sortWithinPartitions("anchor")
        out.append(cold.mapInArrow(sort, "doc long, start long, more int"))
        if not hot:
            break
        width //= 2
        level = level.join(over, F.col("anchor") == F.col("over"), "left_semi")
        halves = level.withColumn("j", F.explode(F.expr(f"sequence(cast(floor((place - more) / {width}) as int), cast(floor(place / {width}) as int))")))
        halves = halves.withColumn("most", F.expr(f"least(place, j * {width} + {width - 1})")).withColumn("last", F.expr(f"least(j * {width} + {width - 1}, {length - core})"))
        halves = halves.selectExpr(
            "doc", "start + place - most as start", f"cast(most - greatest(place - more, j * {width}) as int) as more", "cast(most as int) as place", f"cast(most - j * {width} as int) as at",
            f"substring(body, place - most + 1, most - greatest(place - more, j * {width}) + {length}) as body", f"substring(body, place - j * {width} + 1, {length} - (last - j * {width})) as anchor")
        halves = common.cut(halves, "halves")
        first = halves.groupBy("anchor", "place", "body").agg(F.min(F.struct("doc", "start", "more", "at")).alias("first"), F.count(F.lit(1)).alias("c"))
        first = common.cut(first, "first")
        used += [halves, first]
        twice = first.where("c > 1").select(F.col("anchor").alias("a"), F.col("place").alias("p"), F.col("body").alias("b"), "first")
        again = halves.join(twice, (F.col("anchor") == F.col("a")) & (F.col("place") == F.col("p")) & (F.col("body") == F.col("b")))
        out.append(again.where(F.struct("doc", "start") != F.struct("first.doc", "first.start")).select("doc", "start", "more"))
        if width == 1:
            break
        level = first.select("anchor", "place", "body", "first.*")
    late = out[0]
    for more in out[1:]:
        late = late.unionByName(more)
    return late, used


def _numbered(body: DataFrame) -> DataFrame:
    """Adds place, which orders rows as doc_id does but is distinct and never null.

    Ids are distinct and not null in a table of documents, and then place is the id itself.  That is checked by one
    count of ids; only if it fails are rows numbered, which costs a sort of (id, hash of text) and a written table.
    """
    ids = body.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.where("n > 1 or doc_id is null").isEmpty():
        return body.withColumn("place", F.col("doc_id"))
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("body")]
    return common.cut(body.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()), "numbered")
