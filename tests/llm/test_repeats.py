import random

import pytest

from bookspark.llm import repeats as R
from bookspark.llm.suffixes import lyndon_groups, suffix_array


def brute(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, kept); rows in ascending order of place."""
    seen, out = set(), []
    for d, t in rows:
        b = (t or "").encode() if not isinstance(t, bytes) else t
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        out.append((d, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def _got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()), key=repr)


def test_suffix_array():
    rng = random.Random(1)
    for k in range(1500):
        t = [rng.randint(0, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 30))] * rng.choice([1, 1, 3])
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_groups_are_lyndon_prefixes():
    rng = random.Random(2)

    def prefix(t, i):
        """The longest Lyndon word that begins at i ends where the next smaller suffix begins."""
        j = next((j for j in range(i + 1, len(t)) if t[j:] < t[i:]), len(t))
        return tuple(t[i:j])

    for _ in range(300):
        t = [rng.randint(0, 2) for _ in range(rng.randint(1, 25))]
        group, _, order, _ = lyndon_groups(t)
        rank = {g: k for k, g in enumerate(order)}
        words = [prefix(t, i) for i in range(len(t))]
        assert all((words[i] < words[j]) == (rank[group[i]] < rank[group[j]]) for i in range(len(t)) for j in range(len(t)))


def _texts(seed, alphabet, n):
    rng = random.Random(seed)
    word = lambda k: bytes(rng.choice(alphabet) for _ in range(k))
    passages = [word(rng.randint(20, 90)) for _ in range(6)]
    out = []
    for _ in range(n):
        t = b""
        for _ in range(rng.randint(0, 5)):
            t += rng.choice(passages) if rng.random() < 0.6 else word(rng.randint(1, 40))
        out.append(t)
        if rng.random() < 0.3 and out[-1]:
            b = bytearray(rng.choice(out) or b"x")
            b[rng.randrange(len(b))] ^= 1
            out.append(bytes(b))
    return out


@pytest.mark.parametrize("array, spread, gathered, seed, alphabet", [(1 << 15, 64, 1 << 20, 1, b"abcdefgh"), (60, 2, 50, 2, b"ab"), (1, 1, 1 << 20, 3, "é日a ".encode())])
def test_against_brute_force(spark, monkeypatch, array, spread, gathered, seed, alphabet):
    """With one suffix array a core, with cores whose texts are halved and dealt by content, and with all of them so."""
    for name, value in (("ARRAY", array), ("SPREAD", spread), ("GATHERED", gathered), ("BATCH", 150)):
        monkeypatch.setattr(R, name, value)
    texts = _texts(seed, alphabet, 60)
    rows = [(7 * i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(d, bytearray(t)) for d, t in rows], "doc_id long, text binary").repartition(5)
    want = brute(rows, 24)
    assert _got(R.drop_repeats(df, length=24, core=10)) == sorted(want, key=repr)
    assert sum(w[2] for w in want) > 0


def test_hot_passage(spark):
    """Thousands of texts hold one passage between words of their own; some share a few of these, too."""
    rng = random.Random(4)
    word = lambda k: "".join(rng.choice("abcdefghijklmnop") for _ in range(k))
    passage, near = word(180), [word(30) for _ in range(40)]
    rows = [(i, (word(rng.randint(0, 70)) + (rng.choice(near) if rng.random() < 0.5 else "") + passage + word(rng.randint(0, 70))).encode()) for i in range(4000)]
    df = spark.createDataFrame([(d, bytearray(t)) for d, t in rows], "doc_id long, text binary")
    assert _got(R.drop_repeats(df)) == sorted(brute(rows), key=repr)


def test_documents(documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    assert _got(R.drop_repeats(documents)) == sorted(brute(rows), key=repr)


def test_periodic_texts(spark):
    rows = [(1, "ab" * 120), (2, "x" * 100), (3, "x" * 260), (4, "x" * 99), (5, "ba" * 60 + "c")]
    assert _got(R.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(brute(rows), key=repr)


def test_odd_tables(spark, odd, empty):
    got = _got(R.drop_repeats(odd))
    assert len(got) == odd.count() and {g[1] for g in got if g[0] == 3} == {0}
    unique = odd.where("doc_id not in (6, 7)").dropna(subset=["doc_id"])
    assert _got(R.drop_repeats(unique)) == sorted(brute(sorted((r.doc_id, r.text) for r in unique.collect())), key=repr)
    same = spark.createDataFrame([(None, "y" * 150), (7, "y" * 150), (7, "y" * 150)], "doc_id long, text string")
    assert [g[2] for g in _got(R.drop_repeats(same))] == [150, 150, 149]
    assert R.drop_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        R.drop_repeats(empty, length=50, core=50)
