"""SimHash near-dedup: 64-bit fingerprints of word shingles, compared bit-sliced, and groups of those that link.

simhash_groups links by the fingerprints alone, similar_groups by the shingles' similarity, for which fingerprints pick the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Hash seed, shingle width in words, and the fingerprint's bits.
SEED, WIDTH, BITS = 42, 3, 64
#: Two fingerprints at most RADIUS bits apart agree on 2 of 5 blocks of bits whatever the bits are.
RADIUS, BLOCKS = 3, (13, 13, 13, 13, 12)
#: Rows of a bucket that are compared in one cell; larger buckets are compared in parts.
CELL = 1024
#: Lanes that are compared together, rows that a task holds at once, and shingles that are hashed at once.
LANES, HELD, PIECE = 4096, 1 << 16, 1 << 14
#: Fixed values of similar texts: shingle width in words, and the least Jaccard similarity of a link.
NEAR_WIDTH, LEAST = 5, 0.8
#: Buckets of similar texts: bands and the minima that each joins.  Two texts at similarity s share a band with chance 1 - (1 - s^5)^16.
BANDS, MINIMA = 16, 5
#: Bits in which similar texts' fingerprints differ at most, with chance 0.9995 at 0.8; pairs within the first are tried before others.
NEAR, FAR = 8, 21
#: Rows of a bucket of similar texts that are compared in one cell, and rows that a task holds once these carry sets.
NEAR_CELL, NEAR_HELD = 256, 1 << 11

_random = np.random.default_rng(31)
_MASKS = _random.integers(0, 1 << 32, BANDS * MINIMA, dtype=np.uint32)[:, None]
_ODDS = _random.integers(0, 1 << 32, BANDS * MINIMA, dtype=np.uint32)[:, None] | np.uint32(1)


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """A bit is 1 if it is set in over half of the XXH64 hashes of the text's shingles, repeats included; no words: 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    width = min(width, len(words))
    total = len(words) - width + 1
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, total, PIECE):
        part = words[i : i + PIECE + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width))))
        h = np.array(list(map(xxhash.xxh64_intdigest, shingles, repeat(SEED))), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def planes_of(fps: np.ndarray) -> list[int]:
    """Bit planes: bit r of plane b is bit b of fingerprint r, so one integer operation serves all lanes."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return [int.from_bytes(np.packbits(bits[:, b], bitorder="little").tobytes(), "little") for b in range(BITS)]


def within(planes: list[int], shift: int, lanes: int, radius: int = RADIUS) -> int:
    """Of the lanes r given as bits, those where fingerprints r and r + shift differ in at most radius bits.

    Carry-save counting: plane j of `count` holds bit j of each lane's count, which begins so that a lane overflows as it
    exceeds the radius and is out.  The block is abandoned as soon as no lane is left.
    """
    bits = radius.bit_length()
    spare = (1 << bits) - 1 - radius
    count = [lanes if spare >> j & 1 else 0 for j in range(bits)]
    for p in planes:
        carry = (p ^ (p >> shift)) & lanes
        for j in range(bits):
            if not carry:
                break
            count[j], carry = count[j] ^ carry, count[j] & carry
        lanes &= ~carry
        if not lanes:
            break
    return lanes


def block_links(fps: np.ndarray, cell: np.ndarray, own: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between rows of one cell; rows come sorted by cell.

    cross marks cells of two parts, where only rows of different parts are compared.
    """
    n = len(fps)
    label = np.arange(n)
    planes = planes_of(fps)
    longest = int(np.unique(cell, return_counts=True)[1].max()) if n else 0
    for shift in range(1, longest):
        pairs = (cell[:-shift] == cell[shift:]) & ~(cross[:-shift] & (own[:-shift] == own[shift:])) & (label[:-shift] != label[shift:])
        if not pairs.any():
            continue
        left = within(planes, shift, int.from_bytes(np.packbits(pairs, bitorder="little").tobytes(), "little"))
        if not left:
            continue
        at = np.flatnonzero(np.unpackbits(np.frombuffer(left.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little"))
        for i in at:
            a, b = label[i], label[i + shift]
            if a != b:
                label[label == max(a, b)] = min(a, b)
    child = np.flatnonzero(label != np.arange(n))
    return fps[label[child]], fps[child]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t, key, part_a, part_b, own, fp) of whole cells, sorted by cell, into edges (u, v)."""
    held: list[pa.RecordBatch] = []

    def edges(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        if not held:
            return
        cols = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(6)]
        t, key, a, b, own, fp = cols
        new = np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        starts = np.flatnonzero(new)
        end = len(fp) if last else int(starts[-1])  # the last cell may go on in the next batch
        held = [] if last else [pa.RecordBatch.from_arrays([pa.array(c[end:]) for c in cols], names=list("tkabof"))]
        cell = np.cumsum(new)
        starts = np.r_[starts[starts < end], end]
        i = 0
        while i < len(starts) - 1:
            j = i + 1
            while j < len(starts) - 1 and starts[j + 1] - starts[i] <= LANES:
                j += 1
            s = slice(int(starts[i]), int(starts[j]))
            u, v = block_links(fp[s], cell[s], own[s], a[s] != b[s])
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
            i = j

    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= HELD:
            yield from edges(False)
            n = sum(b.num_rows for b in held)
    yield from edges(True)


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) that connect what links among distinct fingerprints (fp long): 3 or fewer differing bits.

    Exact: fingerprints that close agree on two of five bit blocks, so each is put into ten buckets, one for each pair
    of blocks (25 or 26 bits, thus buckets stay small however many rows there are).  Buckets over CELL rows, which a
    large group of near copies makes, are compared in cells of two parts.  A task compares a stream of whole cells.
    """
    masks, low = [], 0
    for width in BLOCKS:
        masks.append(((1 << width) - 1) << low)
        low += width
    both = [a | b for a, b in combinations(masks, 2)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in both]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"))
    cells = common.split_hot(keyed, ["t", "key"], "fp", CELL)
    order = ["t", "key", "part_a", "part_b"]
    cells = cells.select(*order, "own", "fp").repartition(*order).sortWithinPartitions(*order, "fp")
    return cells.mapInArrow(_compare, "u long, v long")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, fp (long, the fingerprint's 64 bits), component_id, and the columns of carry.

    component_id is the smallest doc_id that links of 3 or fewer differing bits reach, the document's own included.
    Equal fingerprints are one node from the first, so a group of exact copies costs one row; documents are joined
    to their node's component by an equi-join that Spark may split.

    Words are lower-cased (A-Z) runs of anything but ASCII white space; fewer words than a shingle has make one shingle;
    null, empty or blank texts have fingerprint 0, which links like any other.  A null id counts as no id: it is never
    a component's id unless nothing else is there, then null.  Empty table: no rows.  Other columns are not read.
    """

    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint(t.as_py(), width) for t in texts], dtype=np.uint64)
        return pa.array(found.view(np.int64))

    rows = common.cut(docs.select(F.col(doc_id).alias("doc_id"), fp(common.bytes_col(text)).alias("fp"), *carry), "fingerprints")
    nodes = common.cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    groups = common.components(links(nodes.select("fp")))
    named = nodes.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("group"))
    named = common.cut(named, "named")
    common.drop(nodes)
    least = named.groupBy(F.col("group").alias("g")).agg(F.min("first").alias("component_id"))
    named = named.join(least, F.col("group") == F.col("g")).select(F.col("fp").alias("of"), "component_id")
    return rows.join(named, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id", *carry)


def shingles(text: bytes | None, width: int = NEAR_WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the text's shingles; fewer words than a shingle has make one shingle, no words none."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    width = min(width, len(words))
    joined = map(b" ".join, zip(*(words[k:] for k in range(width))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), dtype=np.uint64, count=len(words) - width + 1))


def sketch(found: np.ndarray) -> tuple[int, list[int]]:
    """Of a set of shingles: the fingerprint, and a key for each band, a hash of its minima."""
    ones = np.zeros(BITS, dtype=np.int64)
    least = np.full(BANDS * MINIMA, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(found), 1 << 10):
        part = found[i : i + (1 << 10)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        h = (part.astype(np.uint32) ^ _MASKS) * _ODDS
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x85EBCA6B)
        least = np.minimum(least, h.min(axis=1))
    fp = int(np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0])
    return fp, [xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in least.reshape(BANDS, MINIMA)]


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether the Jaccard similarity of two sets of sorted distinct hashes is at least `least`."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common_ = int((both[1:] == both[:-1]).sum())
    return common_ >= least * (len(both) - common_)


def _near_pairs(t: np.ndarray, cell: np.ndarray, own: np.ndarray, cross: np.ndarray, fps: np.ndarray, keys: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell whose fingerprints are within the radius and whose first common band is the cell's."""
    planes = planes_of(fps)
    for shift in range(1, int(np.unique(cell, return_counts=True)[1].max())):
        lanes = (cell[:-shift] == cell[shift:]) & ~(cross[:-shift] & (own[:-shift] == own[shift:]))
        if not lanes.any():
            continue
        left = within(planes, shift, int.from_bytes(np.packbits(lanes, bitorder="little").tobytes(), "little"), radius)
        if left:
            i = np.flatnonzero(np.unpackbits(np.frombuffer(left.to_bytes(-(-len(fps) // 8), "little"), np.uint8), bitorder="little"))
            i = i[(keys[i] == keys[i + shift]).argmax(axis=1) == t[i]]
            if len(i):
                yield i, i + shift


def _near_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, tuple[np.ndarray, ...]]]:
    """Blocks of whole cells of rows (t, key, part_a, part_b, own, node, fp, keys, ...) sorted by cell, with the arrays of _near_pairs."""
    held: list[pa.RecordBatch] = []
    n = 0

    def blocks(last: bool) -> Iterator[tuple[pa.Table, tuple[np.ndarray, ...]]]:
        nonlocal held
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        t, key, a, b, own = (table.column(i).to_numpy() for i in range(5))
        new = np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        starts = np.flatnonzero(new)
        end = len(t) if last else int(starts[-1])  # the last cell may go on in the next batch
        held = [] if last else table.slice(end).to_batches()
        starts = np.r_[starts[starts < end], end]
        cell = np.cumsum(new)
        i = 0
        while i < len(starts) - 1:
            j = i + 1
            while j < len(starts) - 1 and starts[j + 1] - starts[i] <= LANES:
                j += 1
            s = slice(int(starts[i]), int(starts[j]))
            part = table.slice(s.start, s.stop - s.start)
            keys = np.frombuffer(b"".join(part.column(7).to_pylist()), dtype="<u4").reshape(-1, BANDS)
            yield part, (t[s], cell[s], own[s], a[s] != b[s], part.column(6).to_numpy().view(np.uint64), keys)
            i = j

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= most:
            yield from blocks(False)
            n = sum(x.num_rows for x in held)
    yield from blocks(True)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that some pair of their cell has."""
    for table, arrays in _near_blocks(batches, HELD):
        some = np.zeros(table.num_rows, dtype=bool)
        for i, j in _near_pairs(*arrays, FAR):
            some[i] = some[j] = True
        yield from table.filter(pa.array(some)).combine_chunks().to_batches()
    common.release()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a spanning forest of the pairs whose sets (the last column) are similar."""
    for table, arrays in _near_blocks(batches, NEAR_HELD):
        node = table.column(5).to_pylist()
        sets = [np.frombuffer(x.as_buffer(), dtype="<u4") for x in table.column(8)]
        forest = common.Forest()
        for radius in (NEAR, FAR):
            for left, right in _near_pairs(*arrays, radius):
                for i, j in zip(left.tolist(), right.tolist()):
                    if forest.root(node[i]) != forest.root(node[j]) and similar(sets[i], sets[j]):
                        forest.join(node[i], node[j])
        u, v = forest.edges()
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
    common.release()


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, node (long, a hash of the text's set of shingles), component_id, and the columns of carry.

    component_id is the smallest doc_id that links reach, the document's own included.  Two texts link if the Jaccard
    similarity of their sets of five-word shingles is 0.8 or more.  Texts with equal sets are one node.  Nodes that share
    a band's bucket are compared there: bit-sliced, by the fingerprints of their sets, and pairs within FAR bits that
    are not yet connected by the whole sets (shingles as 32-bit hashes).  So no link is below 0.8, and one of exactly 0.8 is missed with
    chance of about 0.0025.  A pair that shares several bands is compared in the first.  Buckets over NEAR_CELL nodes are
    compared in cells of two parts.  Sets are built again, only for nodes with a pair, and only these nodes' rows carry them.

    Words are lower-cased (A-Z) runs of anything but ASCII white space.  Null, empty or blank texts have the empty set,
    which links with its like alone.  A null id counts as no id: it is never a component's id unless nothing else is
    there, then null.  Empty table: no rows.
    """

    @F.arrow_udf("node long, fp long, keys binary")
    def sketched(texts: pa.Array) -> pa.Array:
        nodes, fps, keys = [], [], []
        for t in texts:
            found = shingles(t.as_py())
            fp, bands = sketch(found)
            nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63))
            fps.append(fp - (1 << 64) if fp >> 63 else fp)
            keys.append(np.array(bands, dtype=np.uint64).tobytes() if len(found) else b"")
        common.release()
        return pa.StructArray.from_arrays([pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), pa.array(keys, pa.binary())], ["node", "fp", "keys"])

    @F.arrow_udf("binary")
    def sets(texts: pa.Array) -> pa.Array:
        out = pa.array([np.unique(shingles(t.as_py()).astype("<u4")).tobytes() for t in texts], pa.binary())
        common.release()
        return out

    @F.arrow_udf("bands array<long>, low binary")
    def split(keys: pa.Array) -> pa.Array:
        all_keys = [np.frombuffer(k.as_py(), dtype="<u8") for k in keys]
        return pa.StructArray.from_arrays([pa.array([k.view("<i8") for k in all_keys], pa.list_(pa.int64())), pa.array([k.astype("<u4").tobytes() for k in all_keys], pa.binary())], ["bands", "low"])

    body = common.bytes_col(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("hash"), sketched(body).alias("s"), *carry)
    rows = common.cut(rows.select("doc_id", "hash", "s.node", "s.fp", "s.keys", *carry), "sketches")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "hash")).alias("one"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = common.cut(nodes, "nodes")
    banded = nodes.select("node", "fp", split("keys").alias("k")).select("node", "fp", F.col("k.low").alias("keys"), F.posexplode("k.bands").alias("t", "key"))
    cells = common.split_hot(banded, ["t", "key"], "node", NEAR_CELL)
    order = ["t", "key", "part_a", "part_b"]
    cells = cells.select(*order, "own", "node", "fp", "keys").repartition(*order).sortWithinPartitions(*order, "node")
    cells = near = common.cut(cells.mapInArrow(_candidates, cells.schema), "cells")
    wanted = nodes.join(cells.select(F.col("node").alias("n")).distinct(), F.col("node") == F.col("n")).select("node", F.col("one.doc_id").alias("id"), F.col("one.hash").alias("of"))
    found = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("hash"), body.alias("body")).join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("of")))
    found = common.cut(found.select(F.col("node").alias("n"), sets("body").alias("body")).dropDuplicates(["n"]), "sets")
    cells = cells.join(found, F.col("node") == F.col("n")).select(*order, "own", "node", "fp", "keys", "body")
    links = common.cut(cells.repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(_verify, "u long, v long"), "links")
    common.drop(near, found)
    named = nodes.join(common.components(links).withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("node", "first", F.coalesce("component", "node").alias("group"))
    named = common.cut(named, "named")
    common.drop(nodes, links)
    least = named.groupBy(F.col("group").alias("g")).agg(F.min("first").alias("component_id"))
    named = named.join(least, F.col("group") == F.col("g")).select(F.col("node").alias("of"), "component_id")
    return rows.join(named, F.col("node") == F.col("of")).select("doc_id", "node", "component_id", *carry)
