import numpy as np
import pytest

from bookspark.llm import vectors as V


def brute(rows, threshold=0.9):
    """{vec_id: (n_links, component_id)} by all pairs."""
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v and all(x is not None for x in v) and np.isfinite(v).all() and any(v)]
    links, up = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ok)):
        for b in range(a + 1, len(ok)):
            (i, x), (j, y) = ok[a], ok[b]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return {i: (links[i], root(i)) for i, _ in rows}


def _got(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return {r.vec_id: (r.n_links, r.component_id) for r in V.link_vectors(df).collect()}


def test_hadamard_is_orthogonal():
    h = V.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, 16 * np.eye(16))


def test_odd_vectors(spark):
    e = [1.0, 0.0, 0.0, 0.0]
    rows = [(9, e), (3, e), (4, [2.0, 0.1, 0.0, 0.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [None, 1.0]), (10, [float("nan"), 1.0]), (11, [float("inf"), 1.0]), (12, [1.0, 0.0]), (13, [-0.0, 1.0, 0.0, 0.0]), (14, [0.0, 1.0, 0.0, 0.0]), (15, [1e300, 1e-300, 0.0, 0.0])]
    got = _got(spark, rows)
    assert got == {9: (3, 3), 3: (3, 3), 4: (3, 3), 15: (3, 3), 5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (0, 8), 10: (0, 10), 11: (0, 11), 12: (0, 12), 13: (1, 13), 14: (1, 13)}
    assert V.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_ids_are_read_as_they_are(spark):
    """Repeated, null and int ids: every row is a vector of its own."""
    a, b, c = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.1, 1.0, 0.0, 0.0]
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, c), (None, [0.0, 0.0, 1.0, 0.0]), (None, [0.0, 0.1, 1.0, 0.0]), (4, [0.0, 0.0, 0.0, 1.0]), (None, None)], "vec_id int, embedding array<float>")
    got = sorted((tuple(r) for r in V.link_vectors(df).collect()), key=repr)
    assert got == sorted([(1, 1, 1), (2, 1, 1), (1, 1, 1), (3, 1, 1), (None, 1, None), (None, 1, None), (4, 0, 4), (None, 0, None)], key=repr)


@pytest.mark.parametrize("tight", [4, 1000])
def test_groups_split_into_cells(spark, monkeypatch, tight):
    """Groups larger than a cell and a chain, near the threshold too: no link below it, recall above 0.9 of all links.
    Both with balls and without."""
    monkeypatch.setattr(V, "TIGHT", tight)
    monkeypatch.setattr(V, "CELL", 16)
    monkeypatch.setattr(V, "HELD", 64)
    rng = np.random.default_rng(7)
    rows, n = [], 0
    for size, spread in ((60, 0.01), (40, 0.12), (30, 0.3), (100, 3.0)):
        centre = rng.standard_normal(32)
        for _ in range(size):
            rows.append((n, (centre + spread * rng.standard_normal(32)).tolist()))
            n += 1
    rows += [(n + k, rows[0][1]) for k in range(20)]
    want, got = brute(rows), _got(spark, rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g for g, _ in got.values()) > 0.95 * sum(w for w, _ in want.values())
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.97


def test_recall_at_the_threshold():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((1000, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    for rows in (500, 50_000, 10_000_000):
        tables, hashes = V.plan(64, rows, 0.9)
        assert V.meets(V.signatures(x, tables, hashes), V.signatures(y, tables, hashes))[0].any(axis=1).mean() > 0.9
