"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, with multiprobe and verified pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rounds of random signs and Hadamard transforms that stand for one random rotation; buckets a vector looks into in each table.
ROUNDS, PROBES = 3, 4
#: Rows of a bucket that are compared in one cell, rows that a task holds at once, and links that are attributed at once.
CELL, HELD, PAIRS = 256, 1 << 13, 1 << 14
#: Rows that make a bucket worth a ball (see link_vectors).
TIGHT = 64
#: Chance, at the threshold itself, that a pair is found; pairs above the threshold are found more surely.
RECALL = 0.95


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform along the last axis, whose length is a power of 2."""
    n, h = x.shape[-1], 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        h *= 2
    return x


@lru_cache(maxsize=64)
def _signs(width: int, rotations: int) -> np.ndarray:
    return np.random.default_rng([20, width]).choice([-1.0, 1.0], size=(rotations, ROUNDS, width))


def signatures(x: np.ndarray, tables: int, hashes: int) -> np.ndarray:
    """Buckets (rows, tables, PROBES) of unit vectors; probe 0 is a vector's own bucket, the others its next-likeliest.

    One cross-polytope hash is the axis, with sign, that a rotated vector is nearest to; a table's bucket joins `hashes`
    of them.  A probe replaces the hash that loses least by doing so with its second or third axis.
    """
    n, dim = x.shape
    width = 1 << max(1, (dim - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - dim)))
    out = np.empty((n, tables, PROBES), dtype=np.int64)
    signs = _signs(width, tables * hashes)
    near = min(3, width)
    for t in range(tables):
        axes, losses = [], []
        for k in range(hashes):
            y = x
            for s in signs[t * hashes + k]:
                y = hadamard(y * s) / math.sqrt(width)
            size = np.abs(y)
            best = np.argsort(-size, axis=1, kind="stable")[:, :near]
            top = np.take_along_axis(size, best, 1)
            axes.append(2 * best + (np.take_along_axis(y, best, 1) < 0))
            losses.append(top[:, :1] ** 2 - top[:, 1:] ** 2)
        order = np.argsort(np.concatenate(losses, axis=1), axis=1, kind="stable")
        for p in range(PROBES):
            code = np.full(n, (t + 1) * 1000003 + dim, dtype=np.uint64)
            change = order[:, p - 1] if p and p <= order.shape[1] else np.full(n, -1)
            for k in range(hashes):
                at = np.where((change >= 0) & (change // (near - 1) == k), change % (near - 1) + 1, 0)
                axis = np.take_along_axis(axes[k], at[:, None], 1)[:, 0]
                code = (code ^ axis.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                code ^= code >> np.uint64(29)
            out[:, t, p] = code.view(np.int64)
    return out


def meets(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether pairs meet in each table, and in which bucket first: one's own bucket is among the other's probes."""
    ab = (a[:, :, :1] == b).any(axis=2)
    ba = (b[:, :, :1] == a).any(axis=2)
    top = np.iinfo(np.int64).max
    return ab | ba, np.minimum(np.where(ab, a[:, :, 0], top), np.where(ba, b[:, :, 0], top))


@lru_cache(maxsize=64)
def plan(dim: int, rows: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(tables, hashes): hashes so that random vectors seldom share one of about 2 * rows * PROBES buckets, and tables so that
    a simulated pair at the threshold is found with the given chance."""
    width = 1 << max(1, (dim - 1).bit_length())
    hashes = max(1, math.ceil(math.log(max(2, 2 * rows * PROBES)) / math.log(2 * width)))
    rng = np.random.default_rng(11)
    x, y = rng.standard_normal((2, 400, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * y
    some = 4
    hit = max(0.02, meets(signatures(x, some, hashes), signatures(y, some, hashes))[0].mean())
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - hit + 1e-9))), hashes


def digest(vector: list | None) -> bytes | None:
    """128 bits of a vector's components as doubles; None for vectors that link with nothing."""
    if not vector or any(v is None for v in vector):
        return None
    x = np.array(vector, dtype=np.float64) + 0.0  # -0.0 becomes 0.0
    return xxhash.xxh3_128_digest(x.tobytes()) if np.isfinite(x).all() and x.any() else None


def _units(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors padded to the longest, and their dimensions."""
    dims = vectors.value_lengths().to_numpy()
    values = vectors.flatten().to_numpy()
    x = np.zeros((len(dims), int(dims.max())))
    x[np.arange(x.shape[1]) < dims[:, None]] = values
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True), dims


def _signed(x: np.ndarray, dims: np.ndarray, plans: dict[int, tuple[int, int]], tables: int) -> np.ndarray:
    out = np.zeros((len(x), tables, PROBES), dtype=np.int64)
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        out[rows, : plans[int(d)][0]] = signatures(x[rows, :d], *plans[int(d)])
        out[rows, plans[int(d)][0] :] = rows[:, None, None] + (np.int64(d) << np.int64(32))  # tables that other lengths have
    return out


def link_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per row of vectors: vec_id, n_links (other rows linked directly), component_id (smallest id reachable).

    Rows of equal components are one node with a count, whatever their number and ids.  Nodes get buckets in several tables by
    cross-polytope hashing; each looks into PROBES buckets a table, and pairs of which one is in its own bucket are
    candidates.  Every candidate is verified by its cosine in double precision, so no link is below the threshold.  A
    pair that meets in several buckets counts in the first; rows carry their buckets, so neither pairs nor hashes are made again.

    Tight groups: of a bucket with TIGHT nodes or more one node, by least hash, is a centre.  A node within half the
    threshold's angle of the first centre among its buckets' is in that centre's ball, and two of one ball are linked, as
    angles add up.  So a ball's links are its size, and its nodes are compared only with nodes outside of it.  What is compared is
    dealt into cells of two parts of up to CELL rows, within which pairs become counts and edges of a spanning forest; no
    pair is emitted.  Vectors travel only with rows of such cells.  Tables and hashes follow from the number of nodes and the wanted
    recall (see plan); links near the threshold can be missed with chance 1 - RECALL.

    Ids are read as long; what isn't a number is null.  Rows with a null id or one that others have, too, are vectors like any
    other: they count as links, and each gets its own row; a component's id is the smallest that is not null, or null.  Null, empty
    and zero vectors, and those with null or non-finite components, have no links and are their own component; so are
    vectors that no other of their length is near.  Empty table: no rows.
    """

    @F.arrow_udf("binary")
    def digests(column: pa.Array) -> pa.Array:
        return pa.array([digest(v) for v in column.to_pylist()], pa.binary())

    rows = vectors.select(F.expr(f"try_cast(`{vec_id}` as long)").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    rows = rows.withColumn("d", digests("x"))
    nodes = rows.where("d is not null").groupBy("d").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("x").alias("x"))
    nodes = common.cut(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    sizes = {r["n"]: r["c"] for r in nodes.groupBy(F.size("x").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}
    plans = {d: plan(d, c, threshold) for d, c in sizes.items()}
    tables = max((t for t, _ in plans.values()), default=1)

    @F.arrow_udf("binary")
    def signed(column: pa.Array) -> pa.Array:
        out = []
        for i in range(0, len(column), 2048):
            x, dims = _units(column.slice(i, 2048))
            out += [row.tobytes() for row in _signed(x, dims, plans, tables)]
        return pa.array(out, pa.binary())

    plain, nodes = nodes, common.cut(nodes.withColumn("sign", signed("x")), "signed")
    common.drop(plain)

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                s = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype="<i8").reshape(-1, tables, PROBES)
                n = np.array([plans[d][0] for d in part.column(1).to_pylist()])
                own = (np.arange(tables) < n[:, None])[:, :, None] & np.stack([(s[:, :, :p] != s[:, :, p : p + 1]).all(axis=2) for p in range(PROBES)], axis=2)
                row, table, probe = np.nonzero(own)  # a bucket that two probes name holds the vector once
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(table, pa.int32()), pa.array(s[row, table, probe], pa.int64()), pa.array(probe == 0)], names=["node", "t", "key", "home"])

    slots = dealt = common.cut(nodes.select("node", F.size("x"), "sign").mapInArrow(bucketed, "node long, t int, key long, home boolean"), "slots")
    balls = common.cut(_balls(nodes, slots, threshold), "balls")
    slots = slots.join(balls.select(F.col("node").alias("in"), "ball"), F.col("node") == F.col("in"), "left").select("t", "key", "home", "node", F.coalesce("ball", F.lit(-1)).alias("ball"))
    groups = slots.groupBy("t", "key", "ball").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("home"))
    groups = groups.groupBy(F.col("t").alias("lt"), F.col("key").alias("lk")).agg(
        F.sum("n").alias("n"), F.max("home").alias("any_home"), F.collect_list(F.struct("ball", F.ceil(F.col("n") / CELL).cast("int").alias("p"))).alias("parts"))
    groups = groups.where("n > 1 and any_home and (size(parts) > 1 or parts[0].ball = -1)").drop("n", "any_home")
    cells = slots.join(groups, (F.col("t") == F.col("lt")) & (F.col("key") == F.col("lk")))
    cells = cells.withColumn("me", F.struct("ball", F.pmod(F.xxhash64("node", F.lit(7)), F.filter("parts", lambda g: g["ball"] == F.col("ball"))[0]["p"]).cast("int").alias("part")))
    others = F.filter("parts", lambda g: (g["ball"] != F.col("ball")) | (F.col("ball") == -1))
    others = F.flatten(F.transform(others, lambda g: F.transform(F.sequence(F.lit(0), g["p"] - 1), lambda o: F.struct(g["ball"].alias("ball"), o.alias("part")))))
    cells = cells.withColumn("other", F.explode(others))
    cells = cells.select("t", "key", F.least("me", "other").alias("a"), F.greatest("me", "other").alias("b"), (F.col("me") > F.col("other")).alias("right"), "node")
    cells = cells.join(nodes.select(F.col("node").alias("n"), "copies", "x", "sign"), F.col("node") == F.col("n"))
    cells = cells.select("t", "key", F.xxhash64("a", "b").alias("cell"), (F.col("a") == F.col("b")).alias("whole"), "right", "node", "copies", "x", "sign")
    order = ["t", "key", "cell"]
    cells = cells.repartition(*order).sortWithinPartitions(*order, "right", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            t, key, cell, whole, right, node, copies = (table.column(i).to_numpy() for i in range(7))
            starts = np.r_[0, 1 + np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))]
            end = len(node) if last else int(starts[-1])  # the last cell may go on in the next batch
            held = [] if last else table.slice(end).to_batches()
            if not end:
                return
            starts = starts[starts < end]
            x, dims = _units(table.column(7).slice(0, end).combine_chunks())
            sign = np.frombuffer(b"".join(table.column(8).slice(0, end).to_pylist()), dtype="<i8").reshape(-1, tables, PROBES)
            n_links, forest = np.zeros(end, dtype=np.int64), common.Forest()
            for lo, hi in zip(starts.tolist(), np.r_[starts[1:], end].tolist()):
                cut = lo if whole[lo] else lo + int(np.count_nonzero(~right[lo:hi]))
                u, v = np.nonzero(x[lo : hi if whole[lo] else cut] @ x[cut:hi].T >= threshold)
                u, v = u + lo, v + cut
                pairs = np.flatnonzero((u < v) & (dims[u] == dims[v]))
                for i in range(0, len(pairs), PAIRS):
                    p = pairs[i : i + PAIRS]
                    a, b = u[p], v[p]
                    met, bucket = meets(sign[a], sign[b])
                    here = met.argmax(axis=1)
                    mine = met.any(axis=1) & (here == t[lo]) & (bucket[np.arange(len(p)), here] == key[lo])
                    a, b = a[mine], b[mine]
                    np.add.at(n_links, a, copies[b])
                    np.add.at(n_links, b, copies[a])
                    for l, r in zip(node[a].tolist(), node[b].tolist()):
                        forest.join(l, r)
            some = np.flatnonzero(n_links)
            u, v = forest.edges()
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[node[some], v]), pa.array(np.r_[n_links[some], np.zeros(len(v), dtype=np.int64)]), pa.array(np.r_[node[some], u])], names=["node", "links", "to"])

        n = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= HELD:
                yield from work(False)
                n = sum(x.num_rows for x in held)
        yield from work(True)

    found = common.cut(cells.mapInArrow(compare, "node long, links long, to long").unionByName(balls.select("node", "links", F.col("first").alias("to"))), "links")
    common.drop(dealt, balls)
    groups = common.components(found.select(F.col("node").alias("u"), F.col("to").alias("v"))).withColumnRenamed("node", "n")
    counts = found.where("links > 0").groupBy(F.col("node").alias("of")).agg(F.sum("links").alias("links"))
    named = nodes.select("d", "node", "least", "copies").join(counts, F.col("node") == F.col("of"), "left").join(groups, F.col("node") == F.col("n"), "left")
    named = common.cut(named.select(F.col("d").alias("nd"), "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("group")), "named")
    common.drop(nodes, found)
    least = named.groupBy(F.col("group").alias("g")).agg(F.min("least").alias("component_id"))
    named = named.join(least, F.col("group") == F.col("g")).select("nd", "n_links", "component_id")
    out = rows.select("vec_id", "d").join(named, F.col("d") == F.col("nd"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("nd").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))


def _balls(nodes: DataFrame, slots: DataFrame, threshold: float) -> DataFrame:
    """(node, ball, links, first): the nodes that are in a ball, the rows of the others in it, and its least node."""
    home = slots.where("home").select("t", "key", "node")
    centres = home.groupBy(F.col("t").alias("ct"), F.col("key").alias("ck")).agg(F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("of"))).alias("c"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= TIGHT)
    picked = home.join(centres, (F.col("t") == F.col("ct")) & (F.col("key") == F.col("ck"))).groupBy("node").agg(F.min("c")["of"].alias("ball"))
    far = nodes.join(picked.select(F.col("ball").alias("b")).distinct(), F.col("node") == F.col("b")).select("b", F.col("x").alias("y"))
    both = picked.join(nodes.select(F.col("node").alias("n"), "copies", "x"), F.col("node") == F.col("n")).join(far, F.col("ball") == F.col("b"))

    def scaled(x) -> F.Column:  # no overflow in the products
        return F.transform(x, lambda v: v / F.array_max(F.transform(x, F.abs)))

    def dot(x, y) -> F.Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    both = both.where(F.size("x") == F.size("y")).select("node", "ball", "copies", scaled(F.col("x")).alias("x"), scaled(F.col("y")).alias("y"))
    cosine = dot(F.col("x"), F.col("y")) / F.sqrt(dot(F.col("x"), F.col("x")) * dot(F.col("y"), F.col("y")))
    inside = common.cut(both.where(cosine >= math.sqrt((1 + threshold) / 2) + 1e-7).select("node", "ball", "copies"), "inside")
    size = inside.groupBy(F.col("ball").alias("b")).agg(F.sum("copies").alias("all"), F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return inside.join(size, F.col("ball") == F.col("b")).select("node", "ball", (F.col("all") - F.col("copies")).alias("links"), "first")
