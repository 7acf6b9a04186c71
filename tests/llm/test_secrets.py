import random
import re
import time

from bookspark.llm import secrets as S


def brute(text):
    """Base spans straight from the rules."""
    out = []
    for kind, pattern, least, group in (("assign", r"""(?i:(p[aA]ssword|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2), ("access", r"AKIA[A-Z0-9]+", 20, 0), ("hex", r"[0-9a-f]+", 24, 0)):
        out += [(kind, *m.span()) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[1], S.KINDS.index(s[0])))


def test_base_spans():
    rng = random.Random(4)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "12345", "a1b2c3d4e5f6", "AKIA", "ABCDEFGH12345678", "\n", "é", "ſecret", "toKen", "deadbeef", "x", "-", "."]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        assert [s for s in S.find_spans(text) if s[0] != "literal"] == brute(text), repr(text)


def test_documents(documents):
    n = 0
    for r in documents.select("text").collect():
        spans = [s for s in S.find_spans(r.text) if s[0] != "literal"]
        assert spans == brute(r.text)
        n += len(spans)
    assert n > 0


def test_lexer_propagates_constants():
    text = 'x = "Zk3" + "9vQp1LmT"\ny = x\ndb.credentials = y\nport = 80\nuser: "bob"'
    pairs = [(name, [text[a:b] for a, b in sorted(v.spans())]) for name, v in S.assignments(text)]
    assert pairs == [("x", ["9vQp1LmT", "Zk3"][::-1]), ("y", []), ("db.credentials", []), ("port", ["80"]), ("user", ["bob"])]
    found = {text[a:b] for k, a, b in S.find_spans(text) if k == "literal"}
    assert found == {"Zk3", "9vQp1LmT"}


def test_scores():
    assert S.sensitivity("dbPassword") == S.sensitivity("DB_PASSWORD") == 1.0 and S.sensitivity("private-key") == 1.0 and S.sensitivity("monkey") == 0
    assert S.randomness("changeme") == 0 and S.randomness("Zk39vQp1LmT") > 0.8 > S.randomness("just some words")
    assert not [s for s in S.find_spans('credentials = "changeme"\nname = "Zk39vQp1LmT"') if s[0] == "literal"]
    assert [s[0] for s in S.find_spans('{"credentials": "Zk39vQp1LmT"}')] == ["literal"]


def test_every_sensitive_name_can_be_reported():
    for name in S.SENSITIVE:
        assert [s[0] for s in S.find_spans(f'the_{name} := "Zk39vQp1LmT-x8Yw2Rr"') if s[0] in ("literal", "assign")], name
    for text in ('credential: str = "Zk39vQp1LmT"', 'const salt: string = "Zk39vQp1LmT-x8Yw2Rr"', 'encryption_key = "Zk39vQp1LmT-x8Yw2Rr"', 'a = b = c.credential = "Zk39vQp1LmT"'):
        assert [(k, text[a:b]) for k, a, b in S.find_spans(text)] == [("literal", text.split('"')[1])], text
    assert not S.find_spans('key: "somewhere"\nkey: str = "plain"')


def test_values_against_whole_strings():
    """A sum's randomness is that of the joined text."""
    rng = random.Random(6)
    for _ in range(500):
        parts = ["".join(rng.choice(rng.choice(["ab", "aB3", "x", "<>$.- é", "A9_"])) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 5))]
        got, want = S.Value.sum([S.Value.of(p, 0, 0) for p in parts]).randomness(), S.randomness("".join(parts))
        assert abs(got - want) < 1e-9, parts
    assert S.randomness("<" + "ab3" * 20 + ">") == 0 and S.randomness("x" * 50) == 0 and S.randomness("your-" + "Ab3" * 9) == 0


def test_doubling_and_long_texts_take_time_in_proportion():
    began = time.time()
    doubled = 'x = "Zk39vQp1LmT"\n' + "x = x + x\n" * 10_000 + "credentials = x\n"
    assert [(k, doubled[a:b]) for k, a, b in S.find_spans(doubled)] == [("literal", "Zk39vQp1LmT")]
    chain = "x = 'Zk3'\n" + "".join(f"x = x + 'a{i}'\ncredentials = x\n" for i in range(3000))
    assert len(S.find_spans(chain)) == 3001
    many = "password=abcdef1 credential='Zk39vQp1LmT'\n" * 120_000
    assert len(many) > 5_000_000 and len(S.find_spans(many)) == 240_000
    assert time.time() - began < 120


def test_odd_tables(odd, empty):
    got = S.scan_secrets(odd).collect()
    assert all(r.secrets is not None for r in got) and S.scan_secrets(empty).count() == 0
