"""Matching free-form chapter queries to titles in four tiers, all of them in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Queries whose tests go into one plan; more are matched in blocks of so many.
BLOCK = 200
#: Most queries that come from a table.
MOST_QUERIES = 10_000


def tier(title: Column, query: str, strip_title: bool = False) -> Column:
    """1 equal, 2 a whole number or word of the title or its beginning, 3 contained without separators, 4 contained; else null.

    Case is ignored.  A query of separators only is contained, by tier 3, in any title.
    """
    low = F.lower(title)
    q = F.lower(T.strip(F.lit(query)))
    pattern = r"(?dU)(?:^|[\s\x1c-\x1f第])" + T.quote(query.strip().lower()) + r"(?:[\s\x1c-\x1f.、:：章节]|$)"
    return (
        F.when((T.strip(low) if strip_title else low) == q, 1)
        .when(title.isNotNull() & (low.rlike(pattern) | low.startswith(q)), 2)
        .when(T.squash(title).contains(T.squash(q)), 3)
        .when(low.contains(q), 4)
    )


def find_chapters(toc: DataFrame, queries: list[str], strip_title: bool = False) -> DataFrame:
    """book, query, tier, pos, title of each query's entry in each book: the best tier, in it the first entry.

    The queries are literals of one projection, so there is no join and their patterns are compiled once; one aggregate
    keeps a row for each book and query, combined before the shuffle.  Null and blank queries match nothing.
    """
    queries = list(dict.fromkeys(q for q in queries if q is not None and q.strip()))
    out = None
    for at in range(0, max(1, len(queries)), BLOCK):
        tiers = [F.struct(F.lit(q).alias("query"), tier(F.col("title"), q, strip_title).alias("tier")) for q in queries[at : at + BLOCK]]
        each = F.explode(F.array(*tiers)) if tiers else F.explode(F.array().cast("array<struct<query:string,tier:int>>"))
        rows = toc.select("book", "pos", "title", each.alias("m")).where("m.tier is not null")
        best = rows.groupBy("book", F.col("m.query").alias("query")).agg(F.min(F.struct(F.col("m.tier").alias("tier"), "pos", "title")).alias("b"))
        one = best.select("book", "query", "b.tier", "b.pos", "b.title")
        out = one if out is None else out.unionByName(one)
    return out


def find_queries(toc: DataFrame, queries: DataFrame, column: str = "query", strip_title: bool = False) -> DataFrame:
    """find_chapters for a table of up to MOST_QUERIES distinct queries; ValueError if there are more: cut the table then."""
    distinct = [r[0] for r in queries.select(column).distinct().limit(MOST_QUERIES + 1).collect()]
    if len(distinct) > MOST_QUERIES:
        raise ValueError(f"over {MOST_QUERIES} distinct queries")
    return find_chapters(toc, distinct, strip_title)


def by_index(toc: DataFrame, index: int) -> DataFrame:
    return toc.where(F.col("index") == index)
