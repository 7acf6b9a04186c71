"""The corpus pipeline: five stages, each an operator of bookspark.llm over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookspark.llm import common, decontaminate, langid, mixing, simhash, tokens
from bookspark.llm.queries import TOKENIZER

#: The columns of documents, which every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
def _columns(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in none of the learned languages: those without a letter, and those whose n-grams are
    farther from the usual than any labelled training document's, with a margin (langid.Model.limit).

    The model learns from labelled documents outside the held-out fold, as op2 does.  If no document has a label, no language is
    learned, and only letterless texts go.  Short texts, texts in two learned languages and noise around words stay.
    """
    docs = _columns(docs)
    model = langid.train(docs, only=langid.fold("doc_id") != 0)
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = langid.identify(docs, model, into="__language")
    return _columns(found.where((F.col("__language.lang") != langid.UNKNOWN) & (F.col("__language.novelty") <= model.limit)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest id.

    Documents link at a Jaccard similarity of 0.8 or more between their sets of five-word shingles.  Where rows repeat the
    smallest id, one row of each set stays, the one whose text hashes least.
    """
    docs = _columns(docs).withColumn("__hash", F.xxhash64("text"))
    groups = common.cut(simhash.similar_groups(docs, carry=("__hash",)), "groups")
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "node").agg(F.min("__hash").alias("__least"), F.count(F.lit(1)).alias("n"))
    kept = first.select(F.col("doc_id").alias("__id"), "__least").distinct()
    out = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__hash").eqNullSafe(F.col("__least")))
    return _columns(out if first.where("n > 1").isEmpty() else out.dropDuplicates(["doc_id", "__hash"]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which any window of the benchmark occurs."""
    found = decontaminate.find_benchmark(_columns(docs), common.load(spark, sf_dir, "benchmark"), into="__hits")
    return _columns(found.where(F.size("__hits.spans") == 0))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 rows."""
    docs = _columns(docs)
    plan = mixing.mix(docs).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), "copies").distinct()
    both = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")))
    return both.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token tables and returns what is read back from them, a row per document: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    manifest = tokens.write_tables(_columns(docs), common.scratch(spark, "tokens"), public_tokenizers.path(TOKENIZER))
    return tokens.digest_tables(manifest)


STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token tables", token_stage),
]

#: Language ID, near copies and BPE are not for SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each stage's result written in the shared folder and read again."""
    docs = common.load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.cut(docs, f"stage{k}")
            if k:
                common.drop(before)
            before = docs
    return docs
