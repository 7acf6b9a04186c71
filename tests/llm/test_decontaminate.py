import random

import numpy as np
from pyspark.sql import functions as F

from bookspark.llm import common, decontaminate as D


def brute(words, items, window=10):
    hit, found = set(), set()
    for item, text in items:
        w = common.words_of(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == w[i : i + k]:
                    hit.update(range(j, j + k))
                    found.add(item)
    return hit, found


def test_wu_manber_finds_all():
    rng = random.Random(1)
    for _ in range(400):
        patterns = {bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 6))}
        text = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 60)))
        want = sorted((i, p) for p in patterns for i in range(len(text)) if text.startswith(p, i))
        patterns = sorted(patterns)
        ends = np.cumsum([len(p) for p in patterns])
        found = D.WuManber(b"".join(patterns), ends - [len(p) for p in patterns], ends, rng.choice([1, 2, 8])).find(text)
        assert sorted((i, patterns[k]) for i, k in found) == want


def test_windows():
    rng = random.Random(2)
    for _ in range(150):
        items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 14))).encode()) for i in range(4)]
        words = [rng.choice("abc").encode() for _ in range(rng.randint(0, 40))]
        spans, found = D.Windows([*items, (None, items[0][1])], 10).spans(words)
        hit, want = brute(words, items)
        assert found == want and {p for a, b in spans for p in range(a, b)} == hit
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_blocks_of_a_large_benchmark(spark, documents, small, monkeypatch):
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    one = D.find_benchmark(documents, benchmark).select("doc_id", "hits").orderBy("doc_id").collect()
    monkeypatch.setattr(D, "BLOCK_BYTES", 2000)
    many = D.find_benchmark(documents, benchmark).select("doc_id", "hits").orderBy("doc_id").collect()
    assert one == many and sum(bool(r.hits.spans) for r in one) > 0
    clash = documents.withColumn("n", F.lit(1)).withColumn("row", F.lit("r")).withColumn("__hits0", F.lit(2)).withColumn("hits", F.lit(3)).withColumn("of", F.lit(4))
    out = D.find_benchmark(clash, benchmark)
    assert set(out.columns) == set(clash.columns) and sorted(out.select("doc_id", "hits").collect(), key=lambda r: r.doc_id) == one
    assert [tuple(r) for r in out.select("n", "row", "__hits0", "of").distinct().collect()] == [(1, "r", 2, 4)]


def test_odd_tables(spark, odd, empty):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "Repeated, ROW"), (4, "日本"), (5, "日本"), (None, "alpha"), (6, "word " * 12)], "item_id long, text string")
    got = {(r.doc_id, r.text and r.text[:4]): r.hits for r in D.find_benchmark(odd, benchmark).collect()}
    assert got[(3, None)].n_words == 0 and got[(3, None)].items == []
    assert got[(7, "repe")].items == [3] and got[(7, "repe")].spans[0] == (0, 2)
    assert got[(8, "naïv")].items == [4, 5] and got[(1, "alph")].items == []
    assert got[(6, "word")].spans[0] == (0, 60_000)
    assert D.find_benchmark(odd, benchmark.limit(0)).where(F.size("hits.items") > 0).count() == 0
    assert D.find_benchmark(empty, benchmark).count() == 0
