"""Queries of the native operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files, html as H, settings, text as T
from ..operators import headings, match, pages as P, toc
from . import derived as D

#: Chapter queries that reach every tier: whole titles, beginnings, numbers, words, joined words, separators, nothing.
QUERIES = ("Red Widget 11.1 ECONOMY", "red widget", "11.1", "bolt", "smallring", "...", "conom", "no such title", "1")


def spine_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spine_titles(D.spine(spark, sf_dir)).select("book", "pos", "index", "title")


def spine_titles(spine: DataFrame, html: str = "html", fallback: str = "url") -> DataFrame:
    """spine with index and title: of <title>, else of the first <h1> or <h2>, else the fallback."""
    page = T.strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    head = T.strip(F.regexp_extract(html, r"(?is)<h[1-2][^>]*>(.*?)</h[1-2]>", 1))
    found = T.strip(T.strip_tags(F.when(page != "", page).otherwise(head)))
    return spine.withColumn("title", F.coalesce(F.nullif(found, F.lit("")), F.col(fallback))).withColumn("index", F.col("pos") + 1)


def toc_heal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.heal(D.bookmarks(spark, sf_dir)).select("book", "pos", "level", "title", "phys")


def chapter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.chapter_ranges(D.bookmarks(spark, sf_dir))


def chapter_range_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.chapter_ranges(D.bookmarks(spark, sf_dir), "locate").drop("index")


def find_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.find_chapters(D.titles(spark, sf_dir), list(QUERIES))


def locate_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's chapter in each book and its pages, by healed bookmarks that have one."""
    ranges = toc.chapter_ranges(D.bookmarks(spark, sf_dir), "locate").withColumn("title", T.strip(F.col("title")))
    found = match.find_chapters(ranges, ["purchase", "view 1", "error"], strip_title=True)
    return found.join(ranges.select("book", "pos", "start_phys", "end_phys"), ["book", "pos"]).select("book", "query", "tier", "pos", "title", "start_phys", "end_phys")


def heading_toc_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.by_headings(D.host_books(spark, sf_dir)).drop("anchor")


def toc_heading_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.by_headings(D.markup(spark, sf_dir))


def toc_anchor_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.by_anchors(D.markup(spark, sf_dir))


def toc_pattern_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.by_paragraphs(D.markup(spark, sf_dir))


def toc_pagebreak_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.by_breaks(D.markup(spark, sf_dir))


def toc_whole_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.whole(D.markup(spark, sf_dir))


def toc_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.cascade(D.markup(spark, sf_dir))


def _sections(spark: SparkSession, sf_dir: str, scope: str) -> DataFrame:
    books = D.markup(spark, sf_dir)
    out = headings.sections(books, headings.by_headings(books), scope)
    return out.select("book", "pos", "html_start", "html_end", F.md5(F.col("html").cast("binary")).alias("html_md5"))


def mobi_chapter_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir, "section")


def image_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir, "entry")


def text_toc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.contents_lines(D.printed_pages(spark, sf_dir))


def text_toc_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = D.printed_pages(spark, sf_dir)
    return toc.page_offset(pages, toc.contents_lines(pages))


def text_toc_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = D.printed_pages(spark, sf_dir)
    entries = toc.contents_lines(pages)
    totals = entries.select("book").distinct().withColumn("total", F.lit(D.PRINTED_TOTAL))
    return toc.printed_ranges(entries, toc.page_offset(pages, entries), totals)


def index_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of books that have bookmarks, printed contents or neither: how many chapters, from which source."""
    marked = toc.chapter_ranges(D.bookmarks(spark, sf_dir)).withColumn("book", F.col("book").cast("string"))
    printed = text_toc_ranges(spark, sf_dir)
    both = toc.first_source([("bookmarks (healed get_toc)", marked), ("extracted text TOC + offset", printed)])
    found = both.groupBy("book", "source").agg(F.count(F.lit(1)).alias("chapters"), F.min("start_phys").alias("first_phys"), F.sum("page_count").cast("long").alias("pages"))
    books = D.pages(spark, sf_dir).select("book").distinct().unionByName(printed.select("book").distinct()).unionByName(D.bookmarks(spark, sf_dir).select(F.col("book").cast("string")).distinct())
    none = F.lit("none (no TOC or bookmarks found)")
    return books.join(found, "book", "left").select("book", F.coalesce("source", none).alias("source"), F.coalesce("chapters", F.lit(0)).alias("chapters"), "first_phys", "pages")


def probe_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = D.table(spark, sf_dir, "labels").where("toxic = 1").join(D.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("book")), "doc_id")
    counts = toxic.groupBy("book").agg(F.count(F.lit(1)).alias("toc_count"))
    out = P.probe(D.pages(spark, sf_dir), counts)
    return out.withColumn("sample_char_counts", F.array_join(F.transform("sample_char_counts", lambda n: n.cast("string")), ","))


def toc_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toc.sample(D.bookmarks(spark, sf_dir))
    return out.select("book", F.array_join(F.transform("toc_sample", lambda x: F.concat_ws("|", x["level"].cast("string"), x["title"], x["phys"].cast("string"))), ";").alias("sample"))


def page_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    spec = F.concat(size, F.lit(", "), (F.col("p_size") - 3).cast("string"), F.lit("-"), (F.col("p_size") + 2).cast("string"), F.lit(",48-,-2,9-7, ,"), size)
    low = F.when(F.col("p_size") <= 3, F.concat(size, F.lit(",48-,-2,9-7"))).otherwise(spec)
    out = D.table(spark, sf_dir, "part").select("p_partkey", P.page_spec(low, F.lit(50)).alias("p"))
    return out.select("p_partkey", F.size("p").cast("long").alias("n"), F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("pages"))


def page_slice_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.slice_pages(D.pages(spark, sf_dir), D.page_ranges(spark, sf_dir, 10))
    return out.select("book", "start_phys", "end_phys", "page_count", F.md5(F.col("content").cast("binary")).alias("content_md5"), P.stats(F.col("content"))["char_count"].alias("char_count"))


def scan_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.slice_pages(D.pages(spark, sf_dir), D.page_ranges(spark, sf_dir, 1)).select("book", "start_phys", "page_count", "total_chars", "is_scanned")


def chapter_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = D.table(spark, sf_dir, "conversations").withColumn("book", F.col("conv_id"))
    out = D.joined(turns, "turn", "text", "\n\n---\n\n")
    return out.select("book", F.md5(F.col("text").cast("binary")).alias("content_md5"), F.length("text").cast("long").alias("char_count"))


def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.strip_tags(F.col("html"))
    return D.spread(D.table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.length(text).cast("long").alias("n"), F.md5(text.cast("binary")).alias("text_md5"))


def content_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.spread(D.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", P.stats(F.col("text")).alias("s")).select("doc_id", "s.*")


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.spread(D.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.array_join(P.first_lines(F.col("text")), "\n").alias("first_lines"))


def purge_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.purge_flat(F.col("html"))
    return D.spread(D.table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.length(text).cast("long").alias("n"), F.md5(text.cast("binary")).alias("html_md5"))


def clean_ocr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.clean_ocr(F.col("raw"))
    return D.recognised(spark, sf_dir).select("id", "kind", F.length(text).cast("long").alias("n"), F.md5(text.cast("binary")).alias("text_md5"))


def clean_code_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.clean_code(F.col("raw"))
    return D.recognised(spark, sf_dir).select("id", "kind", F.length(text).cast("long").alias("n"), F.md5(text.cast("binary")).alias("text_md5"))


def code_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.recognised(spark, sf_dir).select("id", "kind", T.clean_ocr(F.col("raw")).alias("t"))
    return out.select("id", "kind", T.is_code(F.col("t")).alias("is_code"), T.ocr_language(F.col("t")).alias("language"))


def ocr_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("kind") == "page", F.concat(F.lit("img/"), F.col("id").cast("string"), F.lit(".png")))
    text = T.ocr_markdown(F.col("raw"), T.image_alt(F.when(F.col("kind") == "event", F.col("kind")), F.col("id")), path)
    return D.recognised(spark, sf_dir).select("id", "kind", F.length(text).cast("long").alias("n"), F.md5(text.cast("binary")).alias("markdown_md5"))


def drift_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters that name the first line of a page, said to start a page or more away from it."""
    pages = D.pages(spark, sf_dir)
    title = F.get(T.filled_lines(F.col("text")), F.lit(0))
    chapters = pages.select("book", (F.col("phys") - 1).alias("pos"), title.alias("title"), (F.col("phys") + F.col("phys") % 4).alias("start_phys")).where("title is not null")
    return toc.drift(chapters, pages)


def extract_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located chapters with their text and statistics, as the JSON result's fields."""
    toc_rows = spine_titles(D.spine(spark, sf_dir))
    found = match.find_chapters(toc_rows, ["the", "de", "la"])
    body = toc_rows.select("book", "pos", "index", T.strip_tags(F.col("html")).alias("content"))
    out = found.join(body, ["book", "pos"]).withColumn("stats", P.stats(F.col("content")))
    return out.select("book", "query", F.lit(True).alias("success"), "title", "index", F.md5(F.col("content").cast("binary")).alias("content_md5"), "stats.char_count", "stats.line_count", "stats.image_count")


def format_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of the files that pages' addresses would be saved as, with some extensions changed."""
    ext = F.element_at(F.array(*[F.lit(x) for x in (".epub", ".MOBI", ".azw3", ".prc", ".pdf", "", ".azw", ".tar.epub")]), (F.col("page_id") % 8 + 1).cast("int"))
    path = F.concat(F.regexp_extract("url", r"([^/?#]*)/?(?:[?#].*)?$", 1), ext)
    return D.table(spark, sf_dir, "pages").select("page_id", path.alias("path"), files.extension(path).alias("ext"), files.book_format(path).alias("format"))


def resolve_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that links of a page would name, from a file two folders down."""
    link = F.regexp_extract("html", r'<a href="([^"]*)"', 1)
    href = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("../x", "./", "../../../up", "a%20b", "100%")]), (F.col("page_id") % 5 + 1).cast("int")), link, F.lit("#top"))
    return D.table(spark, sf_dir, "pages").select("page_id", files.resolve(F.lit("OEBPS/Text/ch.xhtml"), href).alias("entry"), files.anchor(href).alias("anchor"))


def image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension by first bytes, alt text and file name of images whose bytes stand in a part's row."""
    magics = ["ffd8ff00", "89504e470d0a1a0a", "474946383761", "474946383961", "5249464600000000574542500000", "424d00", "49492a00", "4d4d002a", "3c73766720", "0a0a3c737667", "00", "3c3f786d6c3f3e3c7376673e"]
    data = F.unhex(F.element_at(F.array(*[F.lit(m) for m in magics]), (F.col("p_partkey") % len(magics) + 1).cast("int")))
    ext = files.image_extension(data)
    part = D.table(spark, sf_dir, "part")
    alt = T.image_alt(F.when(F.col("p_size") > 25, F.concat(F.lit("a\\b/"), "p_name")), F.col("p_size"), file_name_only=True)
    return part.select("p_partkey", ext.alias("ext"), alt.alias("alt"), files.image_name(F.col("p_size"), F.col("p_partkey"), ext).alias("name"), files.page_name(F.col("p_partkey")).alias("page_name"))


def code_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of code blocks whose classes and texts come from parts' rows."""
    classes = ["lang-cpp", "go", "highlight-python", "java", "rs", "TypeScript", "sh", "sql", "xml", "c", "category", ""]
    codes = ["#include <x>", "package main\nfunc f()", "def f(): pass", "printf(1)", "x := 1", "std::cout << 1", "int main()", "plain", "import (", "def  ", "char *p"]
    cls = F.element_at(F.array(*[F.lit(x) for x in classes]), (F.col("p_partkey") % len(classes) + 1).cast("int"))
    code = F.element_at(F.array(*[F.lit(x) for x in codes]), (F.col("p_partkey") % len(codes) + 1).cast("int"))
    return D.table(spark, sf_dir, "part").select("p_partkey", T.code_language(cls, code).alias("language"))


def source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the first setting that has one, argument before environment before file, for each user's events."""
    prio = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    return settings.first_setting(D.table(spark, sf_dir, "events"), "user_id", "props", "event_type", F.col("event_id"), prio)


def image_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that a MOBI book's markup names by record number; those without a record go but keep their number."""
    p = D.table(spark, sf_dir, "part").withColumn("book", F.col("p_brand"))
    html = F.concat(F.lit("<p>"), "p_name", F.lit('<img alt="x" recindex="'), F.format_string("%05d", F.col("p_size")), F.lit('"/></p>'))
    books = D.joined(p.withColumn("html", html), "p_partkey", "html")
    found = books.select("book", F.explode(H.image_list("html")).alias("i")).select("book", "i.image", "i.recindex")
    records = D.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 2).alias("record"), F.col("s_name").alias("data"))
    first_image = 2
    return found.join(records, F.col("recindex") + first_image - 1 == F.col("record")).select("book", "image", "recindex", "data")


QUERY_FUNCTIONS = (
    spine_toc, toc_heal, chapter_range, chapter_range_locate, find_chapter, locate_pdf, heading_toc_offsets, toc_heading_scheme, toc_anchor_scheme, toc_pattern_scheme, toc_pagebreak_scheme,
    toc_whole_scheme, toc_cascade, mobi_chapter_slice, image_scope, text_toc_lines, text_toc_offset, text_toc_ranges, index_cascade, probe_classify, toc_sample, page_spec, page_slice_text,
    scan_detect, chapter_concat, strip_tags, content_stats, first_lines, purge_nav, clean_ocr_text, clean_code_ocr, code_detect, ocr_markdown, drift_window, extract_envelope, format_dispatch,
    resolve_link, image_names, code_language, source_priority, image_enumeration,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERY_FUNCTIONS}
