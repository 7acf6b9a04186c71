from bookspark.llm import decontaminate as D


def test_null_item_ids_count_but_are_not_listed(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x alpha beta y"), (2, "gamma"), (3, "other")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, "alpha beta"), (None, "gamma"), (7, "gamma")], "item_id long, text string")
    for size in (1 << 20, 8):
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        got = {r.doc_id: ([tuple(s) for s in r.hits.spans], r.hits["items"]) for r in D.find_benchmark(docs, benchmark).collect()}
        assert got == {1: ([(1, 3)], []), 2: ([(0, 1)], [7]), 3: ([], [])}
