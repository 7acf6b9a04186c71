import random

from pyspark.sql import functions as F

from bookspark.llm import licenses as L


def brute_blocks(words, templates, threshold):
    """Every block of every template, compared as sets."""
    out = []
    for t in templates:
        n, own = len(t.words), set(t.words)
        need = 1.0 if t.phrase else threshold
        for start in range(0, max(len(words), 1), n):
            block = words[start : start + 2 * n]
            share = len(own & set(block)) / len(own)
            if share >= need - 1e-12 and (not t.phrase or any(block[i : i + n] == t.words for i in range(len(block) - n + 1))):
                out.append((t.label, start, start + len(block), share))
    return sorted(out)


def brute_places(words, templates):
    return sorted((t.label, i) for t in templates if t.phrase for i in range(len(words)) if words[i : i + len(t.words)] == t.words)


def test_join_equals_comparing_all_blocks():
    rng = random.Random(6)
    vocabulary = sorted({w for t in L.TEMPLATES for w in t.words}) + [b"x%d" % i for i in range(5)]
    for k in range(300):
        words = []
        while len(words) < rng.randint(0, 120):
            t = rng.choice(L.TEMPLATES)
            piece = list(t.words)
            if rng.random() < 0.5:
                piece = [w if rng.random() < 0.85 else rng.choice(vocabulary) for w in piece]
            words += piece if rng.random() < 0.6 else rng.choices(vocabulary, k=rng.randint(1, 9))
        join = L.Join(L.TEMPLATES, {w: rng.randint(0, 9) for w in vocabulary}, 0.8)
        blocks, places = L.scan_words(words, join)
        assert sorted(blocks) == brute_blocks(words, L.TEMPLATES, 0.8)
        assert sorted(places) == brute_places(words, L.TEMPLATES)


def test_documents(documents):
    out = L.scan_licenses(documents).select("text", "licenses.*").collect()
    assert sum(bool(r.places) for r in out) > 0
    for r in out:
        words = L.common.words_of((r.text or "").encode())
        assert r.n_words == len(words)
        assert sorted((p.label, p.word) for p in r.places) == brute_places(words, L.TEMPLATES)


def test_odd_tables(odd, empty):
    out = {r.doc_id: r.licenses for r in L.scan_licenses(odd.withColumn("licenses", F.lit("clash"))).collect()}
    assert out[3].n_words == 0 and out[3].blocks == [] and out[6] is not None
    assert L.scan_licenses(empty).count() == 0


def test_long_notice_with_changes(spark):
    text = "Permission is hereby granted free of charge to any human obtaining a copy of this software and associated documentation to deal in the software without any restriction"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert {b.label for b in L.scan_licenses(df).first().licenses.blocks} == {"mit"}


def test_each_template_is_found_between_other_words():
    """A whole text gives its own label, and other labels only if their phrase is in it."""
    join = L.Join(L.TEMPLATES, {}, 0.8)
    for t in L.TEMPLATES:
        words = [b"w%d" % i for i in range(150)] + t.words + [b"v%d" % i for i in range(150)]
        blocks, places = L.scan_words(words, join)
        phrases = {p.label for p in L.TEMPLATES if p.phrase and b" ".join(p.words) in b" ".join(words)}
        assert {b[0] for b in blocks} == {t.label} | phrases, t
