"""Queries opN_<name>: each operator over its whole table with production parameters, as digest columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, langid, licenses, lines, mixing, repeats, secrets, simhash, tokens, vectors

#: The public tokenizer file by whose vocabulary token ids are written.
TOKENIZER = "word_bpe_49k.json"


def op1_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = tokens.write_tables(docs, common.scratch(spark, "tokens"), public_tokenizers.path(TOKENIZER))
    return tokens.digest_tables(manifest)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.fold("doc_id") == 0
    model = langid.train(docs, only=~held_out)
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(common.load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(common.load(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("licenses.places", lambda p: p["label"].isin(*licenses.BASE))
    joined: Column = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    out = out.select("doc_id", "licenses.n_words", base.alias("base"), "licenses.blocks")
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"), joined(F.col("blocks.label")).alias("labels"), F.coalesce(F.array_max("blocks.score"), F.lit(0.0)).alias("score"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link_vectors(common.load(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_groups(common.load(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_drop_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.drop_repeats(common.load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find_benchmark(docs, common.load(spark, sf_dir, "benchmark")).select("doc_id", "hits.*")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    out = out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(common.load(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = secrets.KINDS[:3]
    return out.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base], F.sha2(told(of(*base)), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(common.load(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_tables, op2_language_id, op3_line_dedup, op4_license_scan, op5_embedding_dedup, op6_simhash, op7_drop_repeats, op8_decontaminate, op9_secret_scan, op10_mix_sources)}


#: One line key: margins stripped, A-Z lower-cased.
_SPACE = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(string_split_regex(" + _ASCII_LOWER + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLE = {
    "op3_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {_ASCII_LOWER.format(f"trim(line, {_SPACE})")} AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, coalesce(c.keeper <> k.doc_id, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op8_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bw),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, lens WHERE len(w) >= n),
hit AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN win ON win.n = dw.n AND win.s = array_to_string(dw.w[i:i + dw.n - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_mix_sources": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
  row_number() OVER (ORDER BY source NULLS LAST) AS rank, 2.0::DOUBLE * source_size AS stop FROM s),
f AS (SELECT *, coalesce(sum(stop) OVER (ORDER BY stop / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER (ORDER BY stop / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM r),
g AS (SELECT *, stop * weights_left <= (budget - before) * weight AS stopped FROM f),
t AS (SELECT *, CASE WHEN stopped THEN stop ELSE (budget - coalesce(sum(stop) FILTER (WHERE stopped) OVER (), 0)) * weight / (sum(weight) FILTER (WHERE NOT stopped) OVER ()) END AS target FROM g),
p AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
c AS (SELECT source, h, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h),
x AS (SELECT c.source, h, source_size, target, passes, target - passes * source_size AS rest, n, upto FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source),
e AS (SELECT source, h, source_size, target, passes, CASE WHEN upto <= rest THEN 1 WHEN upto - n <= rest AND upto - rest <= rest - (upto - n) THEN 1 ELSE 0 END AS extra FROM x)
SELECT doc_id, size, source_size, target, (least(passes + extra, 2) * size)::BIGINT AS taken FROM d JOIN e ON d.h = e.h AND d.source IS NOT DISTINCT FROM e.source""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
