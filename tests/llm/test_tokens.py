import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bookspark.llm import common, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_encoder_equals_library():
    rng = random.Random(3)
    alphabet = [chr(c) for c in range(256)] + list("aaaeeett  ''  12日本ﬁİ😀̈")
    texts = ["", "don't we'll 'S l'été ½ $% _x_", "<|endoftext|> a", *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(600))]
    own = Tokenizer.from_file(PATH)
    got = tokens.Encoder(PATH).encode(texts)
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u2").tolist() == own.encode(t, add_special_tokens=False).ids, repr(t)


def test_other_tokenizer_goes_through_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "Hello  world\n\n x"
    assert np.frombuffer(tokens.Encoder(path).encode([text])[0], "<u2").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def _table(entries):
    out = io.BytesIO()
    w = tokens.TableWriter(out, 2)
    for k, v in entries:
        w.add(k, v)
    w.finish()
    return tokens.Table(out, len(out.getvalue())), out


def test_table_round_trip_and_lookup():
    rng = random.Random(5)
    ids = sorted({rng.randrange(-(1 << 63), 1 << 63) for _ in range(3000)})
    entries = [(tokens.key_of(None), b"")] + [(tokens.key_of(i), bytes(rng.randrange(256) for _ in range(2 * rng.randrange(60)))) for i in ids]
    table, raw = _table(entries)
    assert list(table) == entries and len(table.index) > 1 and table.docs == len(entries)
    assert all(table.get(k) == v for k, v in entries[::7])
    assert [tokens.id_of(k) for k, _ in entries[1:]] == ids
    absent = [tokens.key_of(rng.randrange(-(1 << 63), 1 << 63)) for _ in range(2000)]
    assert all(table.get(k) is None for k in absent)
    passed = sum(bool(table.bloom[tokens._probes(np.array([tokens.xxhash.xxh3_64_intdigest(k)], dtype=np.uint64), len(table.bloom))].all()) for k in absent)
    assert passed < 100
    damaged = bytearray(raw.getvalue())
    damaged[10] ^= 1
    with pytest.raises(ValueError):
        list(tokens.Table(io.BytesIO(damaged), len(damaged)))


def test_equal_keys_and_large_values():
    entries = [(tokens.key_of(1), b"ab" * 50_000)] * 4 + [(tokens.key_of(2), b"")]
    table, _ = _table(entries)
    assert list(table) == entries and table.get(tokens.key_of(1)) == entries[0][1] and table.get(tokens.key_of(2)) == b""
    empty, _ = _table([])
    assert list(empty) == [] and empty.get(tokens.key_of(1)) is None


def test_write_and_read(spark, odd, empty):
    manifest = tokens.write_tables(odd, common.scratch(spark, "t"), PATH, shards=3)
    rows = tokens.read_tables(manifest).orderBy("start").collect()
    own = Tokenizer.from_file(PATH)
    want = sorted((r.doc_id is not None, r.doc_id or 0, tuple([*own.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in odd.collect())
    assert [r.doc_id for r in rows] == [d if has else None for has, d, _ in want]
    assert sorted((r.doc_id is not None, r.doc_id or 0, tuple(r.ids)) for r in rows) == want
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in tokens.digest_tables(manifest).collect()}
    assert digests == {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows}
    asked = spark.createDataFrame([(i,) for i in (None, 1, 3, 6, 7, 8, 99, -5, 7)], "doc_id long")
    got = {r.doc_id: r.ids for r in tokens.lookup(manifest, asked).collect()}
    firsts = {}
    for r in rows:
        firsts.setdefault(r.doc_id, r.ids)
    assert got == {i: firsts.get(i) for i in (None, 1, 3, 6, 7, 8, 99, -5)} and got[6] and got[99] is None
    assert tokens.digest_tables(tokens.write_tables(empty, common.scratch(spark, "t"), PATH)).count() == 0


def test_encoder_forgets_in_time():
    """What a worker remembers stays beside its executor's heap: 150,000 words are not kept for ever."""
    own = tokens.Encoder(PATH)
    own.known = {str(i): b"" for i in range(150_000)}
    want = tokens.Encoder(PATH).encode(["some words", "149999"])
    assert own.encode(["some words"]) + tokens.Encoder(PATH).encode(["149999"]) == want and len(own.known) == 2
    own.known |= {str(i): b"" for i in range(150_000)}
    assert own.encode(["some words"]) == want[:1] and "some" in own.known and len(own.known) + len(own.faded) < 200_000


def test_freed_memory_goes_back():
    """Freed memory below a piece that is still in use stays with the process unless it is given back."""

    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    pieces = [bytes(2000) for _ in range(50_000)]
    last = bytes(2000)
    del pieces
    before = held()
    common.release()
    assert before - held() > 50_000_000 and len(last) == 2000
