import hashlib
from collections import defaultdict

from bookspark.llm import lines


def brute(rows, min_chars=40, min_docs=5):
    """(doc_id, n_lines, n_dropped, kept) of each row; rows are documents, null ids are smallest."""
    key = lambda l: l.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    found, largest = defaultdict(int), {}
    for d, t in rows:
        for k in {key(l) for l in (t or "").split("\n")}:
            if len(k) >= min_chars:
                found[k] += 1
                if d is not None:
                    largest[k] = max(largest.get(k, d), d)
    out = []
    for d, t in rows:
        ls = (t or "").split("\n")
        keep = [l for l in ls if found[key(l)] < min_docs or largest.get(key(l)) == d]
        out.append((d, len(ls), len(ls) - len(keep), "\n".join(keep)))
    return out


def _rows(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, bytes(r.kept_text).decode()) for r in df.collect()), key=repr)


def test_against_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert _rows(lines.dedup_lines(documents)) == sorted(brute(rows), key=repr)
    assert sum(r[2] for r in brute(rows)) > 0


def test_odd_tables(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = _rows(lines.dedup_lines(odd))
    assert got == sorted(brute(rows), key=repr)
    assert [r for r in got if r[0] == 3] == [(3, 1, 0, "")] and hashlib.sha256(b"").hexdigest()
    assert lines.dedup_lines(empty).count() == 0


def test_keys_count_code_points():
    assert lines.line_key(("é" * 39).encode(), 40) is None and lines.line_key(("é" * 40).encode(), 40) is not None
    assert lines.line_key(b" \x0b" + b"A" * 40 + b"\t", 40) == b"a" * 40
