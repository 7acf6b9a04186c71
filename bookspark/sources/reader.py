"""Book files as DataFrames.  Codecs run in Arrow functions over `content`; a file that cannot be read is a row with `error`."""

from __future__ import annotations

import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.pandas.types import from_arrow_type

from ..functions.files import book_format
from . import epub, palm

_BROKEN = (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError, OSError, EOFError, NotImplementedError, RuntimeError)
_ENTRY = pa.struct([("pos", pa.int32()), ("index", pa.int32()), ("level", pa.int32()), ("title", pa.string()), ("src", pa.string()), ("file_path", pa.string()), ("anchor", pa.string())])
_EPUB = pa.struct([("error", pa.string()), *((m, pa.string()) for m in epub.METADATA.values()), ("spine_items", pa.int32()), ("source", pa.string()), ("toc", pa.list_(_ENTRY))])
_MOBI = pa.struct([("error", pa.string()), ("title", pa.string()), ("compression", pa.int64()), ("text_length", pa.int64()), ("text_records", pa.int64()), ("record_size", pa.int64()), ("encoding", pa.string()), ("first_image", pa.int64()), ("boundary", pa.int64()), ("records", pa.int64()), ("html", pa.string()), ("epub", pa.binary())])
_REPORT = pa.struct([("kind", pa.string()), *((f.name, f.type) for f in _EPUB), ("html", pa.string())])
_BODIES = pa.list_(pa.struct([("entry", pa.string()), ("body", pa.binary())]))
_RECORDS = pa.list_(pa.struct([("rec", pa.int32()), ("data", pa.binary())]))


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """book (the file's path), format, length, content of every file below path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return with_format(reader.load(path))


#: Which files below a folder are read for each kind of book.
EPUB_GLOB, MOBI_GLOB = "*.[eE][pP][uU][bB]", "*.{[mM][oO][bB][iI],[aA][zZ][wW],[aA][zZ][wW]3,[pP][rR][cC]}"


def with_format(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("book"), book_format(F.col("path")).alias("format"), "length", "content")


def _index(content: bytes | None) -> dict:
    try:
        archive = epub.Archive(content or b"")
        p = epub.package(archive)
        source, toc = epub.contents(archive, p)
    except _BROKEN as e:
        return {"error": f"{type(e).__name__}: {e}"}
    return {**{m: p.metadata.get(m) for m in epub.METADATA.values()}, "spine_items": len(p.spine), "source": source, "toc": [{**t, "pos": i, "index": i + 1} for i, t in enumerate(toc)]}


@F.arrow_udf(from_arrow_type(_EPUB))
def epub_index(content: pa.Array) -> pa.Array:
    """Metadata and table of contents of EPUB files; chapters' bodies stay in the file."""
    return pa.array([_index(c.as_py()) for c in content], _EPUB)


@F.arrow_udf(ST.ArrayType(ST.BinaryType()))
def epub_entries(content: pa.Array, names: pa.Array) -> pa.Array:
    """The named entries of EPUB files, null for those that are missing: only what was asked for is unpacked."""
    out = []
    for c, wanted in zip(content, names.to_pylist()):
        found: list[bytes | None] = []
        try:
            archive = epub.Archive(c.as_py() or b"")
            for n in wanted or ():
                try:
                    found.append(archive.read(n))
                except _BROKEN:
                    found.append(None)
        except _BROKEN:
            found = [None] * len(wanted or ())
        out.append(found)
    return pa.array(out, pa.list_(pa.binary()))


@F.arrow_udf(from_arrow_type(_BODIES))
def unzip(content: pa.Array) -> pa.Array:
    """All entries of ZIP files; a file that is none has none."""
    out = []
    for c in content:
        try:
            archive = epub.Archive(c.as_py() or b"")
            out.append([{"entry": n, "body": archive.read(n)} for n in archive.names if not n.endswith("/")])
        except _BROKEN:
            out.append([])
    return pa.array(out, _BODIES)


def _mobi(content: bytes | None) -> dict:
    try:
        book = palm.open_mobi(content or b"")
    except _BROKEN as e:
        return {"error": f"{type(e).__name__}: {e}"}
    h = book.head
    return {"title": h.title, "compression": h.compression, "text_length": h.text_length, "text_records": h.text_records, "record_size": h.record_size, "encoding": h.encoding, "first_image": h.first_image, "boundary": h.boundary, "records": len(book.recs), "html": book.html, "epub": book.epub}


@F.arrow_udf(from_arrow_type(_MOBI))
def mobi_index(content: pa.Array) -> pa.Array:
    """Header and markup of MOBI files, or the EPUB that a KF8 file holds."""
    return pa.array([_mobi(c.as_py()) for c in content], _MOBI)


def _report(kind: str, content: bytes | None) -> dict:
    if kind == "EPUB":
        return {"kind": kind, **_index(content)}
    found = _mobi(content)
    if found.get("epub") is not None:
        return {"kind": "KF8", **_index(found["epub"])}
    return {"kind": kind, "error": found.get("error"), "title": found.get("title"), "html": found.get("html")}


@F.arrow_udf(from_arrow_type(_REPORT))
def book_report(formats: pa.Array, content: pa.Array) -> pa.Array:
    """Book files of either format opened once: kind (KF8 for a MOBI file that holds an EPUB), and epub_index's columns or title, error and markup."""
    return pa.array([_report(f, c.as_py()) for f, c in zip(formats.to_pylist(), content)], _REPORT)


@F.arrow_udf(ST.ArrayType(ST.BinaryType()))
def mobi_images(content: pa.Array, numbers: pa.Array) -> pa.Array:
    """The image records that numbers name, null for those that are missing."""
    out = []
    for c, wanted in zip(content, numbers.to_pylist()):
        try:
            recs = palm.records(c.as_py() or b"")
            h = palm.header(c.as_py(), recs)
            out.append([palm.image_record(recs, h, n) for n in wanted or ()])
        except _BROKEN:
            out.append([None] * len(wanted or ()))
    return pa.array(out, pa.list_(pa.binary()))


@F.arrow_udf(from_arrow_type(_RECORDS))
def pdb_records(content: pa.Array) -> pa.Array:
    """All records of Palm databases; a file that is none has none."""
    out = []
    for c in content:
        try:
            out.append([{"rec": i, "data": r} for i, r in enumerate(palm.records(c.as_py() or b""))])
        except _BROKEN:
            out.append([])
    return pa.array(out, _RECORDS)


@F.arrow_udf(ST.BinaryType())
def palmdoc_decompress(data: pa.Array) -> pa.Array:
    return pa.array([None if d is None else palm.decompress(d) for d in data.to_pylist()], pa.binary())


@F.arrow_udf(ST.BinaryType())
def palmdoc_compress(data: pa.Array) -> pa.Array:
    return pa.array([None if d is None else palm.compress(d) for d in data.to_pylist()], pa.binary())


def epubs(files: DataFrame, mobi_files: DataFrame | None = None) -> DataFrame:
    """files (book, format, content) that are EPUBs, or MOBI files that hold one, with their index; format KF8 marks the latter.

    mobi_files: where MOBI files stand if not among files, so that each kind is scanned for itself.
    """
    plain = files.where("format = 'EPUB'").select("book", "format", "content")
    packed = (files if mobi_files is None else mobi_files).where("format = 'MOBI'").select("book", F.lit("KF8").alias("format"), mobi_index("content").alias("m")).where("m.epub is not null").select("book", "format", F.col("m.epub").alias("content"))
    return plain.unionByName(packed).withColumn("index", epub_index("content"))


def reports(files: DataFrame, mobi_files: DataFrame | None = None) -> DataFrame:
    """book and book_report's columns of all EPUB and MOBI files: one pass, in which every file is opened once."""
    kinds = [files.where("format in ('EPUB', 'MOBI')")] if mobi_files is None else [files.where("format = 'EPUB'"), mobi_files.where("format = 'MOBI'")]
    found = [f.select("book", book_report("format", "content").alias("r")).select("book", "r.*") for f in kinds]
    return found[0] if mobi_files is None else found[0].unionByName(found[1])


def mobis(files: DataFrame) -> DataFrame:
    """files that are MOBI books without an EPUB inside: book, content, header fields, html, error."""
    return files.where("format = 'MOBI'").select("book", "content", mobi_index("content").alias("m")).where("m.epub is null").select("book", "content", "m.*").drop("epub")
