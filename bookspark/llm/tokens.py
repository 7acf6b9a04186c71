"""Token-id output: documents' token ids in sorted-string-table shards, written and read from any partitioning."""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import unicodedata
import uuid
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed values of the file format: magic, keys between restarts, and the footer's fields.
MAGIC = b"SSTTOK01"
RESTART = 16
FOOTER = struct.Struct("<QQQQQQII8s")  # index at, length; bloom at, length; documents, tokens; id width, crc32 of index and bloom; magic
#: A block's bytes before it is closed; a shard's bytes before the next one is begun; Bloom bits and probes a key.
BLOCK, SHARD, BLOOM_BITS, BLOOM_PROBES = 64 << 10, 64 << 20, 10, 7
#: Words whose ids a worker remembers before it starts over; with those from before, some 200 bytes each.
REMEMBERED = 100_000


#: How byte-level models spell bytes that are no printable Latin-1 character: by the characters from 256 on, in order.
BYTE_LEVEL = dict(zip([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)], map(chr, range(256, 512))))


def latin_pattern(pattern: str) -> re.Pattern | None:
    """A pattern with \\p{L}, \\p{N} and \\s for `re`, for Latin-1 texts only; None if it has other Unicode properties."""
    if re.search(r"(?<!\[\^)\\s", pattern):  # only the class [^\s...] is spelt out
        return None
    pattern = pattern.replace(r"\s", r"\t-\r\x20\x85\xa0")
    for name in ("L", "N"):
        pattern = pattern.replace(f"\\p{{{name}}}", "".join(chr(c) for c in range(256) if unicodedata.category(chr(c))[0] == name))
    return None if "\\p" in pattern or "\\P" in pattern else re.compile(pattern)


class Encoder:
    """Token ids of whole texts by a `tokenizers` file, as little-endian unsigned integers of `width` bytes.

    Where the file normalises by NFC, white-space folding and lower-casing and splits texts into independent pieces by
    one regular expression, a Latin-1 text (on which those steps need no Unicode tables that could differ) is split by
    that expression and the library's model encodes each distinct piece once; pieces are remembered for as long as
    they turn up again.  Any other text or file goes through the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        if sys.byteorder != "little":
            raise RuntimeError("token tables are written on little-endian machines")
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.lower, pattern = self._pieces(spec)
        self.pattern = latin_pattern(pattern) if pattern else None
        self.known: dict[str, bytes] = {}
        self.faded: dict[str, bytes] = {}

    @staticmethod
    def _pieces(spec: dict) -> tuple[bool, str | None]:
        norm, split = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        kinds = [n.get("type") for n in norm.get("normalizers", [])]
        folds = all(n.get("pattern", {}).get("Regex") == r"\s+" and n.get("content") == " " for n in norm.get("normalizers", []) if n["type"] == "Replace")
        steps = split.get("pretokenizers", [])
        plain = (
            set(kinds) <= {"NFC", "Replace", "Lowercase"} and folds and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
            and "Regex" in steps[0]["pattern"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"] and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout") and not spec.get("truncation") and not spec.get("padding")
        )
        return "Lowercase" in kinds, steps[0]["pattern"]["Regex"] if plain else None

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=f"<u{self.width}").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        pieces: dict[int, list[str]] = {}
        whole: list[int] = []
        for i, t in enumerate(texts):
            try:
                t.encode("latin-1")
                plain = self.pattern is not None and not any(a in t for a in self.added)
            except UnicodeEncodeError:
                plain = False
            if plain:
                pieces[i] = self.pattern.findall(t.lower() if self.lower else t)
            else:
                whole.append(i)
        if len(self.known) > REMEMBERED:  # what does not turn up until this happens again is forgotten
            self.known, self.faded = {}, self.known
        known, faded, model = self.known, self.faded, self.tokenizer.model
        code = "H" if self.width == 2 else "I"
        for p in {p for ps in pieces.values() for p in ps}.difference(known):
            known[p] = faded.get(p) or array(code, [t.id for t in model.tokenize(p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(BYTE_LEVEL))]).tobytes()
        for i, ps in pieces.items():
            out[i] = b"".join(map(known.__getitem__, ps))
        for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
            out[i] = self._bytes(e.ids)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def key_of(doc_id: int | None) -> bytes:
    """Keys sort as bytes as ids do, null first."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


class TableWriter:
    """Writes one shard to a stream from entries in ascending order of key; equal keys are allowed.

    A block holds entries (shared key bytes, own key bytes, value bytes, key rest, value); every RESTART-th key is
    whole, and the block ends with the restarts' offsets, their number and a CRC-32.  The index has each block's first
    key, offset, length, documents and tokens before it.  The Bloom filter has all keys.
    """

    def __init__(self, stream, width: int) -> None:
        self.out, self.width, self.at = stream, width, 0
        self.index: list[dict] = []
        self.hashes: list[int] = []
        self.docs = self.tokens = 0
        self.first = self.last = None
        self._open()

    def _open(self) -> None:
        self.block, self.restarts, self.n, self.previous, self.head = bytearray(), [], 0, b"", None

    def add(self, key: bytes, value: bytes) -> None:
        if self.last is not None and key < self.last:
            raise ValueError("keys must ascend")
        if self.n % RESTART == 0:
            self.restarts.append(len(self.block))
            shared = 0
        else:
            shared = len(os.path.commonprefix([self.previous, key]))
        if self.head is None:
            self.head, self.docs_before, self.tokens_before = key, self.docs, self.tokens
        self.first = key if self.first is None else self.first
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.previous = self.last = key
        self.n += 1
        self.docs += 1
        self.tokens += len(value) // self.width
        self.hashes.append(xxhash.xxh3_64_intdigest(key))
        if len(self.block) >= BLOCK:
            self._close()

    def _close(self) -> None:
        if self.n:
            data = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            data += struct.pack("<I", zlib.crc32(data))
            self.index.append({"key": self.head.hex(), "at": self.at, "length": len(data), "docs": self.docs_before, "tokens": self.tokens_before})
            self.out.write(data)
            self.at += len(data)
        self._open()

    def finish(self) -> None:
        self._close()
        index, bloom = json.dumps(self.index).encode(), bloom_filter(np.array(self.hashes, dtype=np.uint64))
        self.out.write(index + bloom)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.docs, self.tokens, self.width, zlib.crc32(index + bloom), MAGIC))


def _probes(h: np.ndarray, bits: int) -> np.ndarray:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + np.arange(BLOOM_PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


def bloom_filter(hashes: np.ndarray) -> bytes:
    bits = np.zeros(max(64, -(-len(hashes) * BLOOM_BITS // 8) * 8), dtype=bool)
    if len(hashes):
        bits[_probes(hashes, len(bits)).ravel()] = True
    return np.packbits(bits, bitorder="little").tobytes()


#: Most shards whose first keys a lookup holds.
MOST_SHARDS = 1 << 20


class Table:
    """Reads a shard from a seekable stream: the footer, index and filter at once, blocks as they are asked for."""

    def __init__(self, stream, size: int) -> None:
        self.stream = stream
        stream.seek(size - FOOTER.size)
        index_at, index_n, bloom_at, bloom_n, self.docs, self.tokens, self.width, crc, magic = FOOTER.unpack(stream.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token table")
        stream.seek(index_at)
        data = stream.read(index_n + bloom_n)
        if zlib.crc32(data) != crc:
            raise ValueError("index or filter is damaged")
        self.index = json.loads(data[:index_n])
        self.keys = [bytes.fromhex(b["key"]) for b in self.index]
        self.bloom = np.unpackbits(np.frombuffer(data[index_n:], np.uint8), bitorder="little")

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        b = self.index[k]
        self.stream.seek(b["at"])
        data = self.stream.read(b["length"])
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("block is damaged")
        n = struct.unpack("<I", data[-8:-4])[0]
        return data[: -8 - 4 * n], list(struct.unpack(f"<{n}I", data[-8 - 4 * n : -8]))

    @staticmethod
    def _entries(data: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            yield from self._entries(self._block(k)[0])

    def get(self, key: bytes) -> bytes | None:
        """The value of the first entry with the key: filter, binary search of the index, then of a block's restarts."""
        if not self.bloom[_probes(np.array([xxhash.xxh3_64_intdigest(key)], dtype=np.uint64), len(self.bloom))].all():
            return None
        k = bisect_right(self.keys, key) - 1
        while k > 0 and self.keys[k] == key:  # entries with the key may begin in the block before
            k -= 1
        for k in range(max(k, 0), len(self.keys)):
            if self.keys[k] > key:
                return None
            data, restarts = self._block(k)
            lo, hi = 0, len(restarts) - 1
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if next(self._entries(data, restarts[mid]))[0] < key:
                    lo = mid
                else:
                    hi = mid - 1
            for found, value in self._entries(data, restarts[lo]):
                if found == key:
                    return value
                if found > key:
                    return None
        return None


def _open_fs(uri: str):
    return pafs.FileSystem.from_uri(uri)


def write_tables(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = 2, shards: int | None = None) -> DataFrame:
    """Encodes docs and writes shards below folder (a URI on a store that all executors share); returns the manifest.

    The manifest has a row a shard: path, bytes, first (key), n_docs, n_tokens, and base, the tokens of all shards
    before it.  Rows are dealt by ranges of (doc_id, hash of text), sorted within a task (Spark spills), encoded and
    written as they stream by, so a task holds one block and one shard's index.  A shard is written under the
    attempt's own name and then moved, and the manifest is cut to the shared folder: a lost task is simply run again.

    Null ids come first.  Null text is empty: only the end id.  Repeated ids and rows are all kept, next to each other, texts in
    order of their hash.  Bytes that are not UTF-8 are decoded as U+FFFD.  Empty table: no shard and an empty manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()  # what earlier stages' batches have left
        enc = encoder(tokenizer)
        end = b"" if end_id is None else enc._bytes([end_id])
        fs, root = _open_fs(folder)
        task = TaskContext.get()
        rows: list[tuple] = []
        table = stream = temp = None

        def close() -> None:
            nonlocal table
            table.finish()
            stream.close()
            path = f"shard-{task.partitionId():06d}-{len(rows):04d}.sst"
            if fs.get_file_info(f"{root}/{path}").type != pafs.FileType.NotFound:  # of an attempt that was lost later on
                fs.delete_file(f"{root}/{path}")
            fs.move(f"{root}/{temp}", f"{root}/{path}")
            rows.append((f"{folder}/{path}", fs.get_file_info(f"{root}/{path}").size, table.first, table.docs, table.tokens))
            table = None

        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = [(t or b"").decode("utf-8", "replace") for t in part.column(1).to_pylist()]
                for d, value in zip(part.column(0).to_pylist(), enc.encode(texts)):
                    if table is None:
                        temp = f"_{uuid.uuid4().hex}"
                        fs.create_dir(root, recursive=True)
                        stream = fs.open_output_stream(f"{root}/{temp}")
                        table = TableWriter(stream, enc.width)
                    table.add(key_of(d), value + end)
                    if table.at >= SHARD:
                        close()
            common.release()
        if table is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))], names=["path", "bytes", "first", "n_docs", "n_tokens"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.bytes_col(text).alias("body"))
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("body")]
    dealt = slim.repartitionByRange(shards, *by) if shards else slim.repartitionByRange(*by)
    manifest = common.cut(dealt.sortWithinPartitions(*by).mapInArrow(write, "path string, bytes long, first binary, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("first", "path").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_tables(manifest: DataFrame) -> DataFrame:
    """A row per document of the shards: doc_id, start (tokens of all documents before it), n_tokens, ids (array of int)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start, width, part in _read_shards(batches):
            ids = [np.frombuffer(v, dtype=f"<u{width}").astype(np.int32) for _, v in part]
            n = np.array([len(i) for i in ids], dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([pa.array([id_of(k) for k, _ in part], pa.int64()), pa.array(start + np.r_[0, np.cumsum(n)[:-1]], pa.int64()), pa.array(n), lists], names=["doc_id", "start", "n_tokens", "ids"])

    return _spread(manifest).mapInArrow(read, "doc_id long, start long, n_tokens long, ids array<int>")


def digest_tables(manifest: DataFrame) -> DataFrame:
    """As read_tables, but with ids_crc32 (long), of the ids as little-endian unsigned 32-bit integers, for ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start, width, part in _read_shards(batches):
            n = np.array([len(v) // width for _, v in part], dtype=np.int64)
            crc = [zlib.crc32(np.frombuffer(v, dtype=f"<u{width}").astype("<u4").tobytes()) for _, v in part]
            yield pa.RecordBatch.from_arrays([pa.array([id_of(k) for k, _ in part], pa.int64()), pa.array(start + np.r_[0, np.cumsum(n)[:-1]], pa.int64()), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _spread(manifest).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, wanted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ids (array of int, null where no shard has it) of each distinct id of wanted; of repeated ids the first entry.

    The shards' first keys (up to MOST_SHARDS, else ValueError) tell which shards can hold an id; each such shard is opened
    by one task, which asks its Bloom filter, its index and then one block.  Null ids are looked up like any other.
    """
    shards = manifest.select("first", "path", "bytes").orderBy("first", "path").limit(MOST_SHARDS + 1).collect()
    if len(shards) > MOST_SHARDS:
        raise ValueError(f"over {MOST_SHARDS} shards: look up in parts of the manifest")
    firsts, paths = [bytes(r["first"]) for r in shards], [(r["path"], r["bytes"]) for r in shards]

    @F.arrow_udf("array<int>")
    def shards_of(ids: pa.Array) -> pa.Array:
        keys = [key_of(i) for i in ids.to_pylist()]  # entries with a key may begin in the shard before the one it is the first of
        return pa.array([list(range(max(0, bisect_left(firsts, k) - 1), bisect_right(firsts, k))) for k in keys], pa.list_(pa.int32()))

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, table, stream = None, None, None
        for b in batches:
            found = []
            for i, shard in zip(*(c.to_pylist() for c in b.columns)):
                if shard != current:
                    if stream:
                        stream.close()
                    fs, at = _open_fs(paths[shard][0])
                    stream = fs.open_input_file(at)
                    current, table = shard, Table(stream, paths[shard][1])
                value = table.get(key_of(i))
                found.append(None if value is None else np.frombuffer(value, dtype=f"<u{table.width}").astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "shard", "ids"])

    asked = wanted.select(F.col(doc_id).cast("long").alias("doc_id")).distinct()
    dealt = asked.select("doc_id", F.explode(shards_of("doc_id")).alias("shard")).repartition("shard").sortWithinPartitions("shard")
    found = dealt.mapInArrow(get, "doc_id long, shard int, ids array<int>").where("ids is not null")
    first = found.groupBy(F.col("doc_id").alias("of")).agg(F.min_by("ids", "shard").alias("ids"))
    return asked.join(first, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "ids")


def _spread(manifest: DataFrame) -> DataFrame:
    n = max(1, min(manifest.count(), int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.select("path", "bytes", "base").repartition(n, "path")


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple[bytes, bytes]]]]:
    """(tokens before, id width, entries) for runs of entries of about a megabyte."""
    for b in batches:
        for path, size, base in zip(*(c.to_pylist() for c in b.columns)):
            fs, at = _open_fs(path)
            with fs.open_input_file(at) as stream:
                table = Table(stream, size)
                part, held = [], 0
                for k, v in table:
                    part.append((k, v))
                    held += len(v) + 64
                    if held >= 1 << 20:
                        yield base, table.width, part
                        base += sum(len(v) for _, v in part) // table.width
                        part, held = [], 0
                if part:
                    yield base, table.width, part
