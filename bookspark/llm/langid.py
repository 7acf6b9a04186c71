"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, by FTRL, with a calibrated temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Hash buckets of n-grams, their lengths in characters, and positions that are scored at once.
BITS, ORDERS, CHUNK = 16, (1, 2, 3), 1 << 16
DIM = 1 << BITS
#: What texts without a letter get instead of a language.
UNKNOWN = "und"
#: Buckets of document counts that one shuffled row carries.
SLAB = 256

_letter: np.ndarray | None = None


def symbols(text: bytes | None) -> np.ndarray:
    """Lower-cased letters as code points, each run of anything else as one space, a space at either end; no letter: empty."""
    global _letter
    if not text:
        return np.empty(0, dtype=np.uint32)
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    codes = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), dtype="<u4")
    letter = _letter[codes]
    if not letter.any():
        return np.empty(0, dtype=np.uint32)
    codes = np.concatenate([[32], np.where(letter, codes, 32), [32]]).astype(np.uint32)
    letter = np.concatenate([[False], letter, [False]])
    return codes[letter | np.r_[True, letter[:-1]]]


def grams(symbols: np.ndarray) -> Iterator[np.ndarray]:
    """Hash buckets of all n-grams, in pieces of bounded size."""
    for at in range(0, len(symbols), CHUNK):
        s = symbols[at : at + CHUNK + max(ORDERS) - 1]
        for n in ORDERS:
            m = min(CHUNK, len(s) - n + 1)
            if m > 0:
                h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
                for i in range(n):
                    h = (h ^ s[i : i + m]) * np.uint32(0x85EBCA6B)
                    h ^= h >> np.uint32(15)
                yield h >> np.uint32(32 - BITS)


def frequencies(text: bytes | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets that a text's n-grams fill, their share of all its n-grams, and the number of these."""
    counts = np.zeros(DIM, dtype=np.int64)
    for g in grams(symbols(text)):
        counts += np.bincount(g, minlength=DIM)
    at = np.flatnonzero(counts)
    n = int(counts.sum())
    return at, counts[at] / max(1, n), n


@dataclass
class Model:
    languages: list[str]
    rows: np.ndarray  # of each bucket, its row in table; 0 for buckets without a weight
    table: np.ndarray  # weights, a column a language, times the buckets' inverse document frequencies; row 0 is 0
    idf: np.ndarray  # of each bucket
    bias: np.ndarray
    temperature: float
    usual: float = 0.0  # mean novelty of the training rows
    limit: float = np.inf  # most novelty that training rows have, with a margin

    def scores(self, text: bytes | None) -> tuple[np.ndarray | None, float]:
        """Of a whole text: a score for each language before the temperature (None without a letter), and its novelty.

        Novelty is the mean inverse document frequency of its n-grams, PRIOR usual ones included.  Text in none of the learned languages
        is made of n-grams that few training documents have.
        """
        total, rare, n = np.zeros(len(self.languages)), 0.0, 0
        for g in grams(symbols(text)):
            total += self.table.take(self.rows.take(g), axis=0).sum(axis=0, dtype=np.float64)
            rare += float(self.idf.take(g).sum(dtype=np.float64))
            n += len(g)
        if not n:
            return None, 0.0
        return total / n + self.bias, (rare + PRIOR * self.usual) / (n + PRIOR)

    def predict(self, text: bytes | None) -> tuple[str, float, float]:
        """Language, calibrated probability, and novelty."""
        x, novelty = self.scores(text)
        if x is None or not self.languages:
            return UNKNOWN, 0.0, novelty
        p = softmax(x / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k]), novelty


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets that some row has, in ascending order; their weights, a column a class; the bias).

    FTRL-Proximal: coordinates keep sums of gradients z and of their squares n; a weight is 0 while |z| <= l1 and else
    (sign(z) l1 - z) / ((beta + sqrt(n)) / alpha + l2).  Rows are (buckets, values, class).  Only buckets of the rows
    take room.
    """
    known = np.unique(np.concatenate([at for at, _, _ in rows])) if rows else np.empty(0, dtype=np.int64)
    rows = [(np.append(np.searchsorted(known, at), len(known)), np.append(x, 1.0), y) for at, x, y in rows]
    z, n = np.zeros((len(known) + 1, classes)), np.zeros((len(known) + 1, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            w = weights(z[at], n[at])
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    for i in range(0, len(z), SLAB):
        z[i : i + SLAB] = weights(z[i : i + SLAB], n[i : i + SLAB])
    return known, z[:-1], z[-1]


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least cross-entropy, by golden section over its logarithm.

    Labels count as (n + 1) / (n + classes) sure, as in Platt scaling, so few rows without an error don't make it 0.
    """
    classes = logits.shape[1]
    rest = 1.0 / (len(y) + classes)

    def loss(t: float) -> float:
        p = np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))
        return -(rest * p.sum(axis=1) + (1 - classes * rest) * p[np.arange(len(y)), y]).mean()

    lo, hi, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5; 0 is held out.  A null id counts as empty text, so it is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def document_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents whose text fills each bucket, and all documents, over every row of texts (body binary).

    A task adds up one vector of DIM counts and emits it in slabs; slabs are added by number, so what is shuffled is a
    fixed size a task and what reaches the driver is DIM numbers.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIM, dtype=np.int64), 0
        seen = np.zeros(DIM, dtype=bool)
        for b in batches:
            for t in b.column(0):
                seen[:] = False
                for g in grams(symbols(t.as_py())):
                    seen[g] = True
                total += seen
                n += 1
            common.release()
        slabs = [x.tobytes() for x in total.reshape(-1, SLAB)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(slabs)), pa.int32()), pa.array(slabs, pa.binary()), pa.array([n] + [0] * (len(slabs) - 1), pa.int64())], names=["slab", "counts", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for b in batches:
            for slab, counts, docs in zip(*(c.to_pylist() for c in b.columns)):
                total[slab] = total.get(slab, 0) + np.frombuffer(counts, dtype=np.int64)
                n[slab] = n.get(slab, 0) + docs
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary()), pa.array(list(n.values()), pa.int64())], names=["slab", "counts", "n"])

    schema = "slab int, counts binary, n long"
    rows = texts.select("body").mapInArrow(count, schema).repartition("slab").mapInArrow(add, schema).collect()
    out = np.zeros((DIM // SLAB, SLAB), dtype=np.int64)
    for r in rows:
        out[r["slab"]] = np.frombuffer(bytes(r["counts"]), dtype=np.int64)
    return out.ravel(), sum(r["n"] for r in rows)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 600, most: int = 40_000, max_languages: int = 1024, epochs: int = 3, only: F.Column | None = None) -> Model:
    """A model from the labelled rows of docs (non-null lang) that `only` admits.

    Document frequencies are counted over all labelled rows.  The regression is fitted on the driver to a sample that
    is bounded by parameters: about per_language rows of each language, or `most` rows of all where that is less, chosen
    by a hash of id and text.  Every language is learned; over max_languages raise an error.  Every fifth sampled row of a language sets
    the temperature and the others the weights.  No labelled row: a model without languages, which predicts `und`.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), common.bytes_col(text).alias("body"), (F.lit(True) if only is None else only).alias("admitted"))
    rows = rows.where("admitted and lang is not null")
    tally = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()
    if len(tally) > max_languages:
        raise ValueError(f"over {max_languages} languages; is this the column of languages? Else raise max_languages")
    if not tally:
        return Model([], np.zeros(DIM, dtype=np.int32), np.zeros((1, 0), dtype=np.float32), np.zeros(DIM), np.zeros(0), 1.0)
    languages = sorted(r["lang"] for r in tally)
    per_language = max(1, min(per_language, most // len(languages)))
    place = F.pmod(F.xxhash64("doc_id", "body"), F.lit(1 << 30))
    share = {r["lang"]: min(1.0, per_language / r["n"]) for r in tally}
    pick = F.create_map(*[x for l in languages for x in (F.lit(l), F.lit(int(share[l] * (1 << 30))))])
    sample = rows.where(place < F.coalesce(F.try_element_at(pick, F.col("lang")), F.lit(-1)))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [frequencies(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a.astype(np.int32).tobytes() for a, _, _ in found], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x, _ in found], pa.binary()), b.column(2), pa.array([n for _, _, n in found], pa.int64())], names=["lang", "at", "x", "place", "n"])

    got = sample.select("lang", "body", place.alias("place")).mapInArrow(featurize, "lang string, at binary, x binary, place long, n long").collect()
    counts, n = document_counts(rows)
    return fit(languages, [(r["lang"], r["place"], np.frombuffer(bytes(r["at"]), dtype=np.int32), np.frombuffer(bytes(r["x"]), dtype=np.float32), r["n"]) for r in got], counts, n, epochs)


def fit(languages: list[str], sample: list[tuple[str, int, np.ndarray, np.ndarray, int]], counts: np.ndarray, n: int, epochs: int) -> Model:
    """The model of a sample (language, place in its order, buckets, their shares, n-grams) and n documents' bucket counts."""
    idf = np.log((1 + n) / (1 + counts)) + 1.0
    number = {l: k for k, l in enumerate(languages)}
    learn, check, novelty = [], [], []
    seen = [0] * len(languages)
    for lang, _, at, x, size in sorted(sample, key=lambda r: (r[1], r[0], r[2].tobytes())):
        if len(at):
            k = number[lang]
            seen[k] += 1
            (learn if seen[k] % 5 else check).append((at, x * idf[at] * SCALE, k))
            novelty.append((float(x @ idf[at]), size))
    known, w, bias = train_ftrl(learn, len(languages), epochs)
    some = np.flatnonzero(w.any(axis=1))
    rows = np.zeros(DIM, dtype=np.int32)
    rows[known[some]] = np.arange(1, len(some) + 1)
    table = np.zeros((len(some) + 1, len(languages)), dtype=np.float32)
    table[1:] = w[some] * (idf[known[some]] * SCALE)[:, None]
    logits = np.array([x @ (table[rows[at]] / (idf[at] * SCALE)[:, None]) + bias for at, x, _ in check]).reshape(-1, len(languages))
    t = best_temperature(logits, np.array([y for _, _, y in check])) if len(check) > 1 else 1.0
    usual = float(np.mean([v for v, _ in novelty])) if novelty else 0.0
    smooth = [(v * size + PRIOR * usual) / (size + PRIOR) for v, size in novelty]
    limit = usual + MARGIN * (max(smooth) - usual) if smooth else np.inf
    return Model(languages, rows, table, idf.astype(np.float32), bias, t, usual, limit)


#: Brings shares of n-grams to the size of the bias's 1.
SCALE = 10.0
#: Usual n-grams that stand beside a text's own in its novelty, so that short texts are not odd by chance, and how much
#: farther from the usual than any training row a text may be before it is in none of the languages.
PRIOR, MARGIN = 200, 1.5


def identify(docs: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """docs with a column `into`: struct(lang, score, novelty) of the whole text.

    One pass without a shuffle.  Null, empty or letterless text: `und` with score and novelty 0.  The model's size is
    bounded by its languages.  All columns stay; one already named as `into` is replaced.
    """

    @F.arrow_udf("lang string, score double, novelty double")
    def predict(texts: pa.Array) -> pa.Array:
        found = [model.predict(t.as_py()) for t in texts]
        common.release()
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())], ["lang", "score", "novelty"])

    return docs.withColumn(into, predict(common.bytes_col(text)))
