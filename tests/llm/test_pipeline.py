import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
from bookspark.llm import common, langid

from test_decontaminate import brute as brute_hits
from test_simhash import brute_groups


def test_run_against_brute_force(spark, tiny):
    """The rows of run() from the stages' rules; the language model's and the mix's plan are held against plain versions in their own tests."""
    from bookspark.llm import mixing

    docs = common.load(spark, tiny, "documents")
    model = langid.train(docs, only=langid.fold("doc_id") != 0)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    found = [model.predict(r.text and r.text.encode()) for r in rows]
    rows = [r for r, (lang, _, novelty) in zip(rows, found) if lang != "und" and novelty <= model.limit]
    rows = [r for k, (r, g) in enumerate(zip(rows, brute_groups([r.text for r in rows]))) if k == g]
    items = [(r.item_id, r.text.encode()) for r in common.load(spark, tiny, "benchmark").collect()]
    rows = [r for r in rows if not brute_hits(common.words_of(r.text.encode()), items)[0]]
    mixed = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(rows, docs.schema)).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path(C.TOKENIZER))
    want, at = [], 0
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2]
        for _ in range(mixed[r.doc_id]):
            want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in C.run(spark, tiny).collect()) == want
    assert len(want) > 0


def test_language_stage_drops_what_is_in_no_learned_language(spark, tiny):
    """Named rows go; all of the corpus, short texts, and texts in two of its languages stay."""
    rng = random.Random(1)
    docs = common.load(spark, tiny, "documents")
    some = {r.lang: r.text for r in docs.where("length(text) > 500").collect()}
    junk = ["Съешь же ещё этих мягких французских булок, да выпей чаю. " * 9, "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία " * 9, "我能吞下玻璃而不伤身体" * 30, " ".join("".join(rng.choice("bcdfghjkmpqvwxz") for _ in range(7)) for _ in range(99)), "12 34 --- 56", "", None]
    clean = [some["en"][:400] + " " + some["de"][:400], "That it.", some["fr"][:60], some["es"][:300].upper() + " ### 123", "\n".join(f"{w}&&&" for w in some["en"].split()[:50])]
    planted = [(10_000_000 + k, t, None, "planted", 0) for k, t in enumerate(junk)] + [(20_000_000 + k, t, None, "planted", 0) for k, t in enumerate(clean)]
    both = docs.select(*C.COLUMNS).unionByName(spark.createDataFrame(planted, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r.doc_id for r in C.language_stage(spark, both, tiny).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()} | {20_000_000 + k for k in range(len(clean))}


def test_stages_on_odd_tables(spark, odd, empty, tiny):
    extra = odd.withColumn("__id", odd.doc_id)
    for name, stage in C.STAGES:
        for df in (extra, empty):
            out = stage(spark, df, tiny)
            if stage is not C.token_stage:
                assert out.columns == list(C.COLUMNS), name
            n = out.count()
            assert n == 0 if df is empty else n > 0, name
    texts = [r.text for r in C.near_duplicate_stage(spark, odd, tiny).collect()]
    assert len(texts) == len(set(texts))
