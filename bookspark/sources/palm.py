"""Palm databases and MOBI books: records, header, PalmDOC compression, markup, and the EPUB that KF8 files may hold."""

from __future__ import annotations

import io
import struct
import zipfile
from dataclasses import dataclass, field

# Offsets in record 0, code pages, and marks of a KF8 part.
CODE_PAGES = {65001: "utf-8", 1252: "windows-1252", 936: "gbk"}
NO_RECORD = 0xFFFFFFFF
ZIP_MARK = b"PK\x03\x04"


def records(data: bytes) -> list[bytes]:
    """The records of a Palm database; of a table that is cut off, those that it names.  ValueError if the header is cut off."""
    if len(data) < 78:
        raise ValueError("file is too short for a Palm database")
    (n,) = struct.unpack_from(">H", data, 76)
    n = min(n, (len(data) - 78) // 8)
    starts = [struct.unpack_from(">I", data, 78 + 8 * i)[0] for i in range(n)]
    return [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)])]


@dataclass
class Header:
    title: str = ""
    compression: int = 1
    text_length: int = 0
    text_records: int = 0
    record_size: int = 0
    encoding: str = "utf-8"
    first_image: int | None = None
    boundary: int | None = None


def header(data: bytes, recs: list[bytes]) -> Header:
    """Record 0's fields; fields beyond its end keep their defaults.  The title falls back on the database's name."""
    h = Header()
    zero = recs[0] if recs else b""
    if len(zero) >= 16:
        h.compression, _, h.text_length, h.text_records, h.record_size = struct.unpack_from(">HHIHH", zero)
        if zero[16:20] == b"MOBI" and len(zero) >= 24:
            page = struct.unpack_from(">I", zero, 28)[0] if len(zero) >= 32 else 1252
            h.encoding = CODE_PAGES.get(page, "utf-8")
            if len(zero) >= 112:
                (h.first_image,) = struct.unpack_from(">I", zero, 108)
            if len(zero) >= 196:
                (at,) = struct.unpack_from(">I", zero, 192)
                h.boundary = at if at != NO_RECORD and at < len(recs) else None
        if len(zero) >= 92:
            at, n = struct.unpack_from(">II", zero, 84)
            if at < len(zero) and at + n <= len(zero):
                h.title = zero[at : at + n].decode(h.encoding, "replace").strip()
    if not h.title:
        h.title = data[:32].split(b"\0")[0].decode("latin-1").strip()
    return h


def decompress(data: bytes, variant: str = "palmdoc") -> bytes:
    """PalmDOC text.  Bytes: 0 and 9-7F themselves, 1-8 that many literal bytes follow, 80-BF with the next byte a
    back-reference, C0-FF a space and the byte less 80.

    palmdoc: the published format, 11 bits of distance and 3 of length less 3.  compat: a variant with 9 and 5 bits.  A
    reference before the start, or a cut-off pair, gives nothing.
    """
    if variant not in ("palmdoc", "compat"):
        raise ValueError(f"unknown variant {variant!r}")
    bits = 3 if variant == "palmdoc" else 5
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        b = data[i]
        i += 1
        if b == 0 or 9 <= b <= 0x7F:
            out.append(b)
        elif b <= 8:
            out += data[i : i + b]
            i += b
        elif b >= 0xC0:
            out += bytes((0x20, b ^ 0x80))
        elif i < n:
            pair = (b << 8 | data[i]) & 0x3FFF
            i += 1
            distance, length = pair >> bits, (pair & (1 << bits) - 1) + 3
            if 0 < distance <= len(out):
                at = len(out) - distance
                for k in range(length):
                    out.append(out[at + k])
    return bytes(out)


def compress(data: bytes) -> bytes:
    """PalmDOC text of data: back-references where a greedy search finds them, else literals."""
    out, i, n = bytearray(), 0, len(data)
    seen: dict[bytes, int] = {}
    while i < n:
        key = data[i : i + 3]
        at = seen.get(key, -1)
        if len(key) == 3 and at >= 0 and i - at <= 2047:
            length = 3
            while length < 10 and i + length < n and data[at + length] == data[i + length]:
                length += 1
            pair = 0x8000 | (i - at) << 3 | length - 3
            out += bytes((pair >> 8, pair & 0xFF))
            step = length
        elif data[i] == 0x20 and i + 1 < n and 0x40 <= data[i + 1] <= 0x7F:
            out.append(data[i + 1] ^ 0x80)
            step = 2
        elif data[i] == 0 or 9 <= data[i] <= 0x7F:
            out.append(data[i])
            step = 1
        else:
            step = 1
            while step < 8 and i + step < n and not (data[i + step] == 0 or 9 <= data[i + step] <= 0x7F):
                step += 1
            out.append(step)
            out += data[i : i + step]
        for k in range(i, min(i + step, n - 2)):
            seen[data[k : k + 3]] = k
        i += step
    return bytes(out)


def markup(recs: list[bytes], h: Header) -> str:
    """The text records' markup: decompressed, joined as bytes (characters may straddle records), then decoded."""
    body = recs[1 : h.text_records + 1]
    if h.compression != 1:
        body = [_unpacked(r, h.compression) for r in body]
    return b"".join(body).decode(h.encoding, "replace")


def _unpacked(record: bytes, compression: int) -> bytes:
    """A text record; of an unknown compression as PalmDOC has it if that can be read, else as it is."""
    try:
        return decompress(record)
    except (ValueError, IndexError):
        if compression == 2:
            raise
        return record


def embedded_epub(recs: list[bytes], h: Header) -> bytes | None:
    """The first record from the KF8 boundary on that is a ZIP file whose directory can be read."""
    at = h.boundary
    if at is None:
        at = next((i for i, r in enumerate(recs) if r.startswith(b"BOUNDARY") or r[16:20] == b"KF8\0"), None)
    return None if at is None else next((r for r in recs[at:] if r.startswith(ZIP_MARK) and zipfile.is_zipfile(io.BytesIO(r))), None)


def image_record(recs: list[bytes], h: Header, recindex: int) -> bytes | None:
    """The record that an image number names."""
    at = None if h.first_image is None else h.first_image + recindex - 1
    return recs[at] if at is not None and 0 <= at < len(recs) else None


@dataclass
class Mobi:
    """A MOBI book: header and records, and either its markup or, for KF8 files, an EPUB."""

    head: Header
    recs: list[bytes] = field(repr=False)
    html: str | None = None
    epub: bytes | None = None


def open_mobi(data: bytes) -> Mobi:
    recs = records(data)
    h = header(data, recs)
    book = Mobi(h, recs, epub=embedded_epub(recs, h))
    if book.epub is None:
        book.html = markup(recs, h)
    return book


def build(title: str, html: str, packed: bool = True, images: list[bytes] | None = None, extra: list[bytes] | None = None, record_size: int = 4096) -> bytes:
    """A MOBI file of the given markup, with image records and further ones after them."""
    body = html.encode()
    parts = [body[i : i + record_size] for i in range(0, len(body), record_size)] or [b""]
    texts = [compress(p) for p in parts] if packed else parts
    name = title.encode()
    zero = bytearray(248) + name
    struct.pack_into(">HHIHH", zero, 0, 2 if packed else 1, 0, len(body), len(texts), record_size)
    zero[16:20] = b"MOBI"
    struct.pack_into(">III", zero, 20, 232, 2, 65001)
    struct.pack_into(">II", zero, 84, 248, len(name))
    struct.pack_into(">I", zero, 108, 1 + len(texts))
    struct.pack_into(">I", zero, 192, NO_RECORD)
    recs = [bytes(zero), *texts, *(images or []), *(extra or [])]
    at = 78 + 8 * len(recs) + 2
    table = b""
    for i, r in enumerate(recs):
        table += struct.pack(">II", at, i)
        at += len(r)
    top = bytearray(78)
    top[:31] = name[:31].ljust(31, b"\0")
    top[60:68] = b"BOOKMOBI"
    struct.pack_into(">H", top, 76, len(recs))
    return bytes(top) + table + b"\0\0" + b"".join(recs)
