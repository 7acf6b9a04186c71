"""The queries opN_: their columns against plain versions, over documents and awkward rows."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bookspark.llm import queries as Q

from test_repeats import brute as brute_repeats
from test_secrets import brute as brute_spans
from test_simhash import brute_components, brute_fingerprint
from test_vectors import brute as brute_links


@pytest.fixture(scope="module")
def folder(spark, tiny, odd, tmp_path_factory):
    """Documents of the smallest table and the awkward rows with distinct ids, and some embeddings."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "lang", "source")
    extra = odd.where("doc_id is not null and doc_id <> 6").dropDuplicates(["doc_id"]).select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text", "lang", "source")
    docs.unionByName(extra).write.parquet(f"{path}/documents.parquet")
    vectors = spark.read.parquet(f"{tiny}/embeddings.parquet").limit(300)
    vectors.unionByName(vectors.limit(1).withColumn("vec_id", F.lit(-4).cast(vectors.schema["vec_id"].dataType)).withColumn("embedding", F.lit(None).cast(vectors.schema["embedding"].dataType))).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def texts(spark, folder):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())


def _rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_op1(spark, folder, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, at = [], 0
    for d, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert _rows(Q.op1_token_tables(spark, folder), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)


def test_op2(spark, folder, texts):
    got = {r.doc_id: r for r in Q.op2_language_id(spark, folder).collect()}
    labels = {r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert sorted(got) == [d for d, _ in texts]
    for d, t in texts:
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= got[d].score <= 1
        assert (got[d].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and got[d].lang_pred in labels | {"und"}


def test_op4(spark, folder, texts):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    got = {r.doc_id: r for r in Q.op4_license_scan(spark, folder).collect()}
    for d, t in texts:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        labels = sorted({x for _, x in places})
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) and sorted(set(r.labels.split(","))) == r.labels.split(",") and 0 <= r.score <= 1
    assert sum(r.n_base for r in got.values()) > 0


def test_op5(spark, folder):
    rows = [(r.vec_id, r.embedding and [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = {i: (n, c, i == c) for i, (n, c) in brute_links(rows).items()}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in Q.op5_embedding_dedup(spark, folder).collect()} == want


def test_op6(spark, folder, texts):
    want = [(d, f"{f:016x}", c) for d, f, c in brute_components([(d, brute_fingerprint(t)) for d, t in texts])]
    assert _rows(Q.op6_simhash(spark, folder), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


def test_op7(spark, folder, texts):
    want = [(d, n, gone, spans, hashlib.sha256(kept).hexdigest()) for d, n, gone, spans, kept in brute_repeats(texts)]
    assert _rows(Q.op7_drop_repeats(spark, folder), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)


def test_op9(spark, folder, texts):
    told = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    got = {r.doc_id: r for r in Q.op9_secret_scan(spark, folder).collect()}
    for d, t in texts:
        spans, r = brute_spans(t or ""), got[d]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(told(spans).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("literal")] == [s for s in told(spans).split(",") if s]
