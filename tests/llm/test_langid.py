import numpy as np
from pyspark.sql import functions as F

from bookspark.llm import langid


def test_symbols_and_grams():
    text = "Ab,, c\n1É"
    assert "".join(map(chr, langid.symbols(text.encode()))) == " ab c é "
    assert len(langid.symbols(b" 12 ..")) == 0 and len(langid.symbols(None)) == 0
    whole = np.sort(np.concatenate(list(langid.grams(langid.symbols(("xy " * 50_000).encode())))))
    n = len(langid.symbols(("xy " * 50_000).encode()))
    assert len(whole) == sum(n - k + 1 for k in langid.ORDERS)


def test_ftrl_separates_and_is_sparse():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(400):
        y = int(rng.integers(3))
        at = np.unique(np.r_[rng.integers(100, 2000, 5), 10 * y + rng.integers(0, 5, 4)])
        rows.append((at, np.full(len(at), 1.0), y))
    known, w, bias = langid.train_ftrl(rows, 3, l1=0.5)
    assert np.mean([int((x @ w[np.searchsorted(known, at)] + bias).argmax()) == y for at, x, y in rows]) > 0.98
    assert len(known) < 2000 and (w == 0).mean() > 0.9


def test_temperature_softens_overconfidence():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    logits = np.zeros((400, 2))
    logits[np.arange(400), np.where(rng.random(400) < 0.8, y, 1 - y)] = 10
    t = langid.best_temperature(logits, y)
    assert abs(langid.softmax(logits / t).max(axis=1).mean() - 0.8) < 0.03


def test_held_out_accuracy(documents):
    held = langid.fold("doc_id") == 0
    model = langid.train(documents, only=~held)
    out = langid.identify(documents.where(held), model).select("lang", F.col("language.lang").alias("p"), F.col("language.score").alias("s")).collect()
    assert np.mean([r.lang == r.p for r in out]) > 0.97 and all(0 <= r.s <= 1 for r in out)


def test_odd_tables(odd, empty):
    model = langid.train(odd)
    got = {(r.doc_id, r.text and r.text[:3]): r.language for r in langid.identify(odd, model).collect()}
    assert got[(3, None)].lang == got[(4, "")].lang == got[(5, " \n\t")].lang == "und" and got[(5, " \n\t")].score == 0
    assert got[(1, "alp")].lang in model.languages
    none = langid.train(empty)
    assert langid.identify(empty, none).count() == 0 and none.predict(b"abc")[:2] == ("und", 0.0)


def plain_grams(text):
    """Buckets of a text's n-grams, one at a time."""
    kept = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    kept = "".join(c for k, c in enumerate(kept) if c != " " or k == 0 or kept[k - 1] != " ")
    out = []
    for n in (1, 2, 3):
        for i in range(len(kept) - n + 1):
            h = n * 0x9E3779B1 & 0xFFFFFFFF
            for c in kept[i : i + n]:
                h = (h ^ ord(c)) * 0x85EBCA6B & 0xFFFFFFFF
                h ^= h >> 15
            out.append(h >> 16)
    return out if any(c.isalpha() for c in text) else []


def test_counts_and_predictions_against_a_plain_version(spark, documents, monkeypatch):
    monkeypatch.setattr(langid, "CHUNK", 500)
    some = documents.where("doc_id % 5 = 1").select("doc_id", "text", "lang")
    rows = [(r.text or "", r.lang) for r in some.collect()]
    counts, n = langid.document_counts(some.select(F.col("text").cast("binary").alias("body")))
    want = np.zeros(langid.DIM, dtype=np.int64)
    for text, _ in rows:
        want[list(set(plain_grams(text)))] += 1
    assert n == len(rows) and (counts == want).all()
    model = langid.train(some)
    idf = np.log((1 + n) / (1 + want)) + 1
    assert np.allclose(model.idf, idf, rtol=1e-6) and model.languages == sorted({l for _, l in rows if l})
    for text, _ in rows[:40] + [("Ab", None), ("q", None)]:
        g = plain_grams(text)
        x = [sum(float(model.table[model.rows[k], c]) for k in g) / len(g) + model.bias[c] for c in range(len(model.languages))]
        e = [np.exp((v - max(x)) / model.temperature) for v in x]
        lang, score, novelty = model.predict(text.encode())
        assert lang == model.languages[int(np.argmax(x))] and abs(score - max(e) / sum(e)) < 1e-6
        assert abs(novelty - (sum(idf[k] for k in g) + langid.PRIOR * model.usual) / (len(g) + langid.PRIOR)) < 1e-4


def test_rare_and_too_many_languages(spark, documents):
    import pytest

    rare = spark.createDataFrame([(-1, "ąęłść żółw źdźbło " * 20, "pl")], "doc_id long, text string, lang string")
    both = documents.select("doc_id", "text", "lang").unionByName(rare)
    assert langid.train(both).predict("żółw źdźbło ąęłść".encode())[0] == "pl"
    assert langid.train(rare).predict(b"abc")[:2] == ("pl", 1.0)
    with pytest.raises(ValueError):
        langid.train(both, max_languages=2)
