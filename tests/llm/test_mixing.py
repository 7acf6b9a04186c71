import pytest
from pyspark.sql import functions as F

from bookspark.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Repeated dealing of the excess until no source is above its stop; sizes in source order."""
    w = [weights[i % 3] for i in range(len(sizes))]
    stops = [most * s for s in sizes]
    fixed, target = set(), [0.0] * len(sizes)
    while True:
        rest = share * sum(sizes) - sum(stops[i] for i in fixed)
        free = [i for i in range(len(sizes)) if i not in fixed]
        total = sum(w[i] for i in free)
        target = [stops[i] if i in fixed else rest * w[i] / total for i in range(len(sizes))]
        over = {i for i in free if target[i] > stops[i]}
        if not over:
            return target
        fixed |= over


@pytest.mark.parametrize("sizes", [[10, 10, 10, 10], [1, 1000, 3, 40, 500, 0], [5], [0, 0], [100, 1, 1, 1, 1, 1, 1]])
def test_targets(spark, sizes):
    rows = [(f"s{i}" if i < len(sizes) - 1 else None, s) for i, s in enumerate(sizes)]
    got = mixing.targets(spark.createDataFrame(rows, "source string, source_size long"), (5, 2, 1), 1.5, 2.0).orderBy("rank").collect()
    assert [r.target for r in got] == pytest.approx(brute_targets(sizes))


def test_taken(documents):
    out = mixing.mix(documents)
    rows = out.collect()
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    biggest = max(r.size for r in rows)
    per = out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
    assert all(abs(r.t - r.target) <= biggest / 2 for r in per)
    assert sorted(map(tuple, mixing.mix(documents.repartition(7)).collect())) == sorted(map(tuple, rows))


def test_budgets_nest(documents):
    low, high = ({r.doc_id: r.copies for r in mixing.mix(documents, share=s).collect()} for s in (0.5, 0.8))
    assert all(low[d] <= high[d] for d in low) and low != high


def test_odd_tables(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and {r.size for r in rows if r.doc_id in (3, 4, 5)} == {0}
    assert len({r.copies for r in rows if r.doc_id == 7}) == 1
    assert mixing.mix(empty).count() == 0
