"""Mixing sources to target weights by hash-threshold histograms, in plain DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Hexadecimal digits of a document's place on the hash line, and digits that one refinement resolves.
DIGITS, STEP = 15, 3


def size_of(text) -> F.Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds rank, weight, target to (source, source_size).

    Sources in code-point order, null last, get the weights in turn.  share * sum(source_size) is dealt by weight; a
    source stops at most * its size and what it leaves is dealt again by weight until none is above its stop.  That
    fixed point is water-filling: in the order of stop / weight the stopped sources are a leading run, and source k is
    stopped iff filling all from k on at k's level would not use up what is left.  Windows run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", turn)
    t = t.withColumn("stop", F.lit(float(most)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("stop") / F.col("weight"), F.col("rank"))
    whole = Window.partitionBy()
    t = t.withColumn("before", F.coalesce(F.sum("stop").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("weights_left", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(whole))
    t = t.withColumn("stopped", F.col("stop") * F.col("weights_left") <= (F.col("budget") - F.col("before")) * F.col("weight"))
    t = t.withColumn("spent", F.coalesce(F.sum(F.when(F.col("stopped"), F.col("stop"))).over(whole), F.lit(0.0)))
    t = t.withColumn("open", F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(whole))
    t = t.withColumn("target", F.when(F.col("stopped"), F.col("stop")).otherwise((F.col("budget") - F.col("spent")) * F.col("weight") / F.col("open")))
    return t.select("source", "source_size", "rank", "weight", "target")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    A document's place on the hash line is the first 15 hexadecimal digits of the MD5 of its id, so a source's budget
    is a threshold on that line, thresholds for smaller budgets nest in those for larger ones, and reruns agree.  A
    source takes floor(target / source_size) whole passes, and for the rest every document up to its threshold.  The
    threshold is found by histograms: sizes are summed by source and leading three digits, the bucket where the sum
    passes the budget is the boundary, and only documents in it are summed again by their next three digits.  Documents
    are never sorted; a hot source is 4,096 sums like any other.

    Null text: size 0.  Null source: a source of its own, last in order.  Null ids and repeated rows share one place
    and are taken or left together; the documents of one place are taken if they fit the budget whole, or if that
    lands nearer to it than leaving them.  Empty table: no rows.  Only the three named columns are read.
    """
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), F.substring(F.md5(key.cast("binary")), 1, DIGITS).alias("h"))
    slim = common.cut(slim, "mix")
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = common.cut(targets(totals, weights, share, most).select("source", "source_size", "rank", "target"), "targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    # state of the search: a boundary's leading digits, words below it, words still to take
    edge = plan.select(F.col("source").alias("src"), "rank", (F.col("target") - passes * F.col("source_size")).alias("rest"), F.lit("").alias("lead"), F.lit(0).cast("long").alias("below"))
    for k in range(0, DIGITS, STEP):
        inside = slim.join(edge, F.col("source").eqNullSafe(F.col("src")) & F.col("h").startswith(F.col("lead")))
        sums = inside.groupBy("rank", F.substring("h", 1, k + STEP).alias("cell")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs"))
        upto = F.sum("n").over(Window.partitionBy("rank").orderBy("cell"))
        sums = sums.withColumn("upto", upto).join(edge.select(F.col("rank").alias("r"), "src", "rest", "below"), F.col("rank") == F.col("r"))
        # the first cell that brings the sum past the budget; none: the whole lead fits, and the last cell is boundary
        past = sums.withColumn("past", (F.col("below") + F.col("upto")) > F.col("rest"))
        best = past.groupBy("rank").agg(
            F.min(F.when(F.col("past"), F.col("cell"))).alias("hit"), F.max("cell").alias("last"),
            F.min_by("upto", F.when(F.col("past"), F.col("cell"))).alias("hit_upto"), F.min_by("n", F.when(F.col("past"), F.col("cell"))).alias("hit_n"),
            F.min_by("docs", F.when(F.col("past"), F.col("cell"))).alias("hit_docs"), F.max_by("docs", "cell").alias("last_docs"), F.max_by("upto", "cell").alias("last_upto"), F.max_by("n", "cell").alias("last_n"), F.first("src").alias("src"), F.first("rest").alias("rest"), F.first("below").alias("below"))
        edge = best.select("src", "rank", "rest", F.coalesce("hit", "last").alias("lead"), (F.col("below") + F.coalesce(F.col("hit_upto") - F.col("hit_n"), F.col("last_upto") - F.col("last_n"))).alias("below"),
            F.coalesce("hit_n", "last_n").alias("cell_n"), F.coalesce("hit_docs", "last_docs").alias("docs"))
        edge = common.cut(edge, "edge")
        if edge.where("docs > 1").isEmpty():
            break
    # the boundary is now one document or one place: in if that brings the sum nearer to the budget
    nearer = (F.col("below") + F.col("cell_n") - F.col("rest")) <= (F.col("rest") - F.col("below"))
    limits = edge.select(F.col("src"), "lead", nearer.alias("with_lead"))
    plan = plan.join(limits, F.col("source").eqNullSafe(F.col("src")), "left").select(F.col("source").alias("src"), "source_size", "target", passes.alias("passes"), "lead", "with_lead")
    out = slim.join(plan, F.col("source").eqNullSafe(F.col("src")))
    extra = F.when(F.col("h").startswith(F.col("lead")), F.col("with_lead")).otherwise(F.col("h") < F.col("lead")).cast("long")
    out = out.withColumn("copies", F.least(F.col("passes") + extra, F.lit(int(most)).cast("long")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
