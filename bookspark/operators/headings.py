"""Tables of contents found in a MOBI book's markup: five schemes, of which the first that yields enough counts.

Books are rows (book, html[, title]).  Every scheme gives (book, pos, index, title, level, anchor, char_offset), offsets
in characters from 0.  Only matches are shuffled for their offsets, never the markup.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The schemes' patterns and limits, and what makes an anchor's text a chapter title.
HEADING = r"(?isu)<(h[1-4])[^>]*>(.*?)</\1>"
ANCHOR = r"""(?isUu)<a\s+[^>]*(?:name|id)=["']([^"']+)["'][^>]*>(.*?)</a>"""
BREAK = r"(?iu)<(?:mbp:pagebreak|hr)[^>]*>"
PARAGRAPHS = (
    r"(?idUu)<p[^>]*>(?:<b[^>]*>|<strong[^>]*>)?\s*(第[0-9一二三四五六七八九十百]+[章节篇卷部]\s*[^<\n]+)(?:</b>|</strong>)?\s*</p>",
    r"(?idUu)<p[^>]*>(?:<b[^>]*>|<strong[^>]*>)?\s*(Chapter\s+\d+[^<\n]*)(?:</b>|</strong>)?\s*</p>",
    r"(?idUu)<p[^>]*>(?:<b[^>]*>|<strong[^>]*>)?\s*(\d+\.\d+(?:\.\d+)?\s+[^<\n]+)(?:</b>|</strong>)?\s*</p>",
    r"""(?idUu)<p[^>]*class=["'](?:chapter|title|heading|head|bt)["'][^>]*>(.*?)</p>""",
    r"(?idUu)<p[^>]*>(?:<b[^>]*>|<strong[^>]*>)\s*([^<\n]{2,40})\s*(?:</b>|</strong>)\s*</p>",
)
CHAPTER_WORDS = ("第", "章", "Chapter", "Section", "前言", "附录", "目录", "序言", "后记", "引言", "Overview")
HEADING_MAX, ANCHOR_MAX, PARAGRAPH_MAX, BREAK_MAX = 99, 79, 60, 60
ANCHOR_AFTER, BREAK_AFTER = 200, 300
WHOLE = "Full Book Content"


def first_line(markup: Column) -> Column:
    """The first filled line of markup without tags, or null."""
    return F.get(T.filled_lines(T.strip_tags(markup)), F.lit(0))


def is_chapter_like(title: Column) -> Column:
    out = title.rlike(r"(?U)^\d+[.\s、]")
    for w in CHAPTER_WORDS:
        out = out | title.contains(w)
    return out


@dataclass(frozen=True)
class _Scheme:
    """One pattern of a scheme: characters that it looks at after a match, and how many matches and titles it needs."""

    name: str
    pattern: str | None
    longest: int
    after: int = 0
    least_raw: int = 1
    least: int = 2


#: In order of preference; the paragraph patterns are tried one after another.
_SCHEMES = (
    _Scheme("A", HEADING, HEADING_MAX, least_raw=2),
    _Scheme("B", ANCHOR, ANCHOR_MAX, after=ANCHOR_AFTER),
    *(_Scheme("C", p, PARAGRAPH_MAX, least_raw=2) for p in PARAGRAPHS),
    _Scheme("D", BREAK, BREAK_MAX, after=BREAK_AFTER, least=1),
    _Scheme("E", None, 1 << 30, least=1),
)


def _title(s: _Scheme, hit: Column, after: Column, raw: Column) -> Column:
    if s.name == "D":
        return F.substring(F.coalesce(first_line(after), F.concat(F.lit("Section "), (raw + 1).cast("string"))), 1, s.longest)
    own = T.strip(T.strip_tags(F.regexp_extract(hit, s.pattern, 1 if s.name == "C" else 2)))
    return T.bind(own, lambda t: F.when(t == "", first_line(after)).otherwise(t)) if s.name == "B" else own


def _level(s: _Scheme, hit: Column, title: Column) -> Column:
    if s.name == "A":
        return F.substring(F.regexp_extract(hit, s.pattern, 1), 2, 1).cast("int")
    return F.when(title.rlike(r"(?U)^\d+\.\d+\.\d+"), 3).when(title.rlike(r"(?U)^\d+\.\d+"), 2).otherwise(1) if s.name == "C" else F.lit(1)


def _row(k: int, s: _Scheme, raw: Column, gap: Column, width: Column, title: Column, level: Column, anchor: Column, fits: Column) -> Column:
    return F.struct(F.lit(k).alias("k"), F.lit(s.least).alias("least"), raw.alias("raw"), gap.cast("long").alias("gap"), width.cast("long").alias("width"), title.alias("title"), level.alias("level"), anchor.alias("anchor"), fits.alias("fits"))


def _matches(k: int, name: Column) -> Column:
    """Array of a scheme's matches in html: place, lengths before and of the match, title, level, anchor, whether the title fits."""
    s, none = _SCHEMES[k], F.lit(None).cast("string")
    if s.pattern is None:
        title = F.coalesce(F.nullif(name, F.lit("")), F.lit(WHOLE))
        return F.when(F.col("html") != "", F.array(_row(k, s, F.lit(0), F.lit(0), F.lit(0), title, F.lit(1), none, F.lit(True)))).otherwise(F.array())

    def row(m: Column, i: Column) -> Column:
        hit = m["hit"]

        def with_title(t: Column) -> Column:
            fits = F.coalesce(F.length(t).between(1, s.longest), F.lit(False))
            if s.name == "B":
                fits = fits & is_chapter_like(t)
            return _row(k, s, i, m["before"], F.length(hit), F.when(fits, t), _level(s, hit, t), F.regexp_extract(hit, s.pattern, 1) if s.name == "B" else none, fits)

        return T.bind(_title(s, hit, m["after"] if s.after else none, i), with_title)

    return T.bind(T.hits(F.col("html"), s.pattern, s.after), lambda found: F.when(F.size(found) >= s.least_raw, F.transform(found, row)).otherwise(F.array()))


def _entries(books: DataFrame, names: str) -> DataFrame:
    """Entries of each book's first scheme among names that yields enough: one pass over the markup, one shuffle of titles.

    index counts titles, but in A and D all matches, so there it has gaps where a heading is left out.
    """
    use = [k for k, s in enumerate(_SCHEMES) if s.name in names]
    name = F.col("title") if "title" in books.columns else F.lit(None).cast("string")
    arrays = [_matches(k, name) for k in use]
    found = books.select("book", F.explode(F.concat(*arrays) if len(arrays) > 1 else arrays[0]).alias("m")).select("book", "m.*").repartition("book")
    in_order = Window.partitionBy("book", "k").orderBy("raw")
    end = F.sum(F.col("gap") + F.col("width")).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("char_offset", (end - F.col("width")).cast("long")).where("fits")
    found = found.withColumn("pos", (F.row_number().over(in_order) - 1).cast("int")).withColumn("kept", F.count(F.lit(1)).over(Window.partitionBy("book", "k")))
    found = found.where("kept >= least").withColumn("best", F.min("k").over(Window.partitionBy("book"))).where("k = best")
    by_match = [k for k, s in enumerate(_SCHEMES) if s.name in "AD"]
    index = F.when(F.col("k").isin(*by_match), F.col("raw")).otherwise(F.col("pos")) + 1
    scheme = F.element_at(F.array(*[F.lit(s.name) for s in _SCHEMES]), F.col("k") + 1)
    return found.select("book", "pos", index.cast("int").alias("index"), "title", "level", "anchor", "char_offset", scheme.alias("scheme"))


def by_headings(books: DataFrame) -> DataFrame:
    """Scheme A: <h1> to <h4> with a title of 1 to 99 characters."""
    return _entries(books, "A").drop("scheme")


def by_anchors(books: DataFrame) -> DataFrame:
    """Scheme B: named anchors whose text, or else the first filled line after them, looks like a chapter title."""
    return _entries(books, "B").drop("scheme")


def by_paragraphs(books: DataFrame) -> DataFrame:
    """Scheme C: of five paragraph patterns the first that matches twice and keeps two titles of up to 60 characters."""
    return _entries(books, "C").drop("scheme")


def by_breaks(books: DataFrame) -> DataFrame:
    """Scheme D: page breaks and rules, titled by the first filled line after them, else 'Section n'."""
    return _entries(books, "D").drop("scheme")


def whole(books: DataFrame) -> DataFrame:
    """Scheme E: the book as one chapter."""
    return _entries(books, "E").drop("scheme")


def cascade(books: DataFrame) -> DataFrame:
    """For each book the entries of its first scheme that yields any, with `scheme` A to E."""
    return _entries(books, "ABCDE")


def listed(name: Column) -> Column:
    """Array of struct(index, level, title) of the markup in column html: cascade's entries within a row, without a shuffle for
    their offsets.  A scheme is tried only if those before it have not yielded enough."""
    out = F.array().cast("array<struct<index:int,level:int,title:string>>")
    for k in reversed(range(len(_SCHEMES))):
        out = _enough(k, name, out)
    return out


def _enough(k: int, name: Column, otherwise: Column) -> Column:
    s = _SCHEMES[k]

    def entry(x: Column, i: Column) -> Column:
        return F.struct(((x["raw"] if s.name in "AD" else i) + 1).cast("int").alias("index"), x["level"].alias("level"), x["title"].alias("title"))

    return T.bind(F.filter(_matches(k, name), lambda x: x["fits"]), lambda found: F.when(F.size(found) >= s.least, F.transform(found, entry)).otherwise(otherwise))


def sections(books: DataFrame, toc: DataFrame, scope: str = "section", only: DataFrame | None = None) -> DataFrame:
    """toc with html_start, html_end (exclusive) and html of each entry, or of the entries (book, pos) of `only`.

    section: to the next entry that is not deeper.  entry: to the next entry, as images are looked for.
    """
    from .toc import descendant_end, entry_end

    if scope not in ("section", "entry"):
        raise ValueError(f"unknown scope {scope!r}")
    ends = (descendant_end if scope == "section" else entry_end)(toc, "char_offset", "html_end")
    if only is not None:  # markup then meets the chosen entries only
        ends = ends.join(only.select("book", "pos"), ["book", "pos"], "left_semi")
    both = ends.join(books.select("book", "html"), "book").withColumn("html_end", F.coalesce("html_end", F.length("html").cast("long")))
    cut = F.substring(F.col("html"), (F.col("char_offset") + 1).cast("int"), (F.col("html_end") - F.col("char_offset")).cast("int"))
    return both.withColumn("html", cut).withColumnRenamed("char_offset", "html_start")
