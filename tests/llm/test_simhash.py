import random

import numpy as np
import xxhash

from bookspark.llm import common, simhash as S


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in (text or "")).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """Component of each (doc_id, fingerprint) by all pairs of distinct fingerprints."""
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                up[root(a)] = root(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[root(f)] = min(least.get(root(f), d), d)
    return sorted(((d, f, least.get(root(f))) for d, f in rows), key=repr)


def _got(df):
    return sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in df.collect()), key=repr)


def test_bit_sliced_distances():
    rng = random.Random(1)
    fps = np.array([rng.getrandbits(64) if k % 3 else 0 for k in range(200)], dtype=np.uint64)
    for k in range(1, 200, 3):
        fps[k] = fps[k - 1] ^ np.uint64(sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 6))}))
    planes = S.planes_of(fps)
    for shift in (1, 2, 7):
        for radius in (1, 2, 3, 8, 21):
            want = [int((int(fps[i]) ^ int(fps[i + shift])).bit_count() <= radius) for i in range(200 - shift)]
            left = S.within(planes, shift, (1 << (200 - shift)) - 1, radius)
            assert [left >> i & 1 for i in range(200 - shift)] == want


def test_fingerprints(documents):
    for r in documents.limit(60).collect():
        assert S.fingerprint(r.text.encode()) == brute_fingerprint(r.text)
    for t in ("", " \n", "one", "One two", "a b c", None):
        assert S.fingerprint(t and t.encode()) == brute_fingerprint(t)


def test_links_are_exact_also_in_cells(spark, monkeypatch):
    """A crowd around one fingerprint, dealt into small cells, chains of links, and strangers."""
    monkeypatch.setattr(S, "CELL", 8)
    monkeypatch.setattr(S, "HELD", 64)
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 5))}) for _ in range(150)}
    at = rng.getrandbits(64)
    for _ in range(30):
        fps.add(at)
        at ^= sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 4))})
    fps |= {rng.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1, 7}
    rows = list(enumerate(sorted(fps)))
    signed = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in sorted(fps)], "fp long")
    got = {r.node: r.component for r in common.components(S.links(signed)).collect()}
    groups = {}
    for d, f in rows:
        s = f - (1 << 64) if f >= 1 << 63 else f
        groups.setdefault(got.get(s, s), set()).add(f)
    want = {}
    for d, f, c in brute_components(rows):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_documents(documents):
    rows = [(r.doc_id, S.fingerprint(r.text and r.text.encode())) for r in documents.select("doc_id", "text").collect()]
    assert _got(S.simhash_groups(documents)) == brute_components(rows)


def test_odd_tables(odd, empty):
    rows = [(r.doc_id, brute_fingerprint(r.text) if (r.text or "")[:9] != "word word" else S.fingerprint(r.text.encode())) for r in odd.collect()]
    assert _got(S.simhash_groups(odd)) == brute_components(rows)
    assert S.simhash_groups(empty).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5), (-7, 3000)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in up}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_sets(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts, least=0.8):
    """Least index of each text's group, by all pairs of shingle sets."""
    sets, up = [brute_sets(t) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if len(a & b) >= least * len(a | b):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return [root(i) for i in range(len(texts))]


def _frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def _copies(rng, edits):
    """A text of 200 words and copies of it with so many words replaced, far apart."""
    words = [rng.choice("abcdefghij") + str(rng.randrange(10_000)) for _ in range(200)]
    out = [" ".join(words)]
    for k, n in enumerate(edits):
        copy = list(words)
        for at in range(n):
            copy[10 + 15 * at] = f"new{k}x{at}"
        out.append(" ".join(copy))
    return out


def test_similarity_decides():
    a, b = S.shingles(b"A b c d e f g h i j"), S.shingles(b"a b c d e f g h i k")
    assert len(a) == len(b) == 6 and S.similar(a, b, 5 / 7) and not S.similar(a, b, 0.72)
    assert len(S.shingles(b"one two")) == 1 and len(S.shingles(None)) == len(S.shingles(b" \n")) == 0


def test_fingerprints_and_bands_of_similar_texts():
    """Pairs at a similarity just over 0.8 are within FAR bits and share a band."""
    rng = np.random.default_rng(3)
    near = met = 0
    for _ in range(2000):
        both = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        (f, k), (g, l) = S.sketch(np.unique(both[:360])), S.sketch(np.unique(both[40:]))  # 320 of 400
        near += (f ^ g).bit_count() <= S.FAR
        met += any(x == y for x, y in zip(k, l))
    assert near >= 1996 and met >= 1990


def test_similar_groups_in_cells(spark, monkeypatch):
    """Copies at a similarity of 0.82 to 0.95 and looser ones, a crowd of near copies larger than a cell, a chain, texts that
    share a passage only, and texts with hardly a word."""
    monkeypatch.setattr(S, "NEAR_CELL", 8)
    rng = random.Random(6)
    texts = []
    for _ in range(20):
        texts += _copies(rng, [1, 2, 3, 4, 7, 9])
    texts += _copies(rng, [1] * 60 + [3] * 20)
    texts += [" ".join([*(f"s{k}" for k in range(60)), *(f"t{i}x{k}" for k in range(40))]) for i in range(40)]
    chain = [f"c{k}" for k in range(100)]
    for k in range(8):
        texts.append(" ".join(chain))
        chain = chain[3:] + [f"d{k}x{x}" for x in range(3)]
    texts += ["", None, "  ", "one two", "one two three"]
    got = {r.doc_id: r.component_id for r in S.similar_groups(_frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_groups(texts)


def test_similar_documents(documents):
    rows = sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    want = {rows[i][0]: rows[g][0] for i, g in enumerate(brute_groups([t for _, t in rows]))}
    assert {r.doc_id: r.component_id for r in S.similar_groups(documents).collect()} == want


def test_similar_groups_of_odd_tables(odd, empty):
    got = {(r.doc_id, r.component_id) for r in S.similar_groups(odd).collect()}
    assert {(1, 1), (3, 3), (4, 3), (5, 3), (7, 7), (None, None)} <= got and S.similar_groups(empty).count() == 0
