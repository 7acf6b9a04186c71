"""Pages: page specifications, slices of text, digital or scanned, probe reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Characters a page that make a book digital; sampled pages: the first five, and the tenth of longer books.
DIGITAL_CHARS, SAMPLE_FIRST, SAMPLE_EXTRA = 30, 5, 10
# Categories and recommendations of probe reports.
CATEGORIES = {
    "A": ("A (Digital + Has TOC)", "MarkItDown / PyMuPDF on physical pages directly (No offset needed)"),
    "B": ("B (Digital + No TOC)", "Extract TOC text from front pages -> compute offset -> MarkItDown"),
    "C": ("C (Scanned + Has TOC)", "Slice target pages -> mineru-open-api extract --model vlm (Token优先; 无Token才flash-extract, <=20 pages)"),
    "D": ("D (Scanned + No TOC)", "OCR TOC pages -> detect chapter title / calibrate page footer -> MinerU extract --model vlm (Token优先)"),
    "E": ("E (Reflowable EPUB)", "Pure Python zip+xhtml parse -> Native HTML to Markdown (0.05s, 0 Token, 100% precision)"),
    "M": ("M (Reflowable MOBI)", "Pure Python PalmDOC LZ77 unpack -> HTML to Markdown (0.05s, 0 Token)"),
    "K": ("M (Kindle KF8/AZW3)", "KF8 Container -> Native HTML/Markdown (0.05s, 0 Token)"),
}


def page_spec(spec: Column, last: Column) -> Column:
    """Sorted distinct pages of a specification such as '12,15,20-22,28-,-3'; open ends reach 1 and `last`, ranges that
    run backwards are empty, and parts that are no numbers, and pages outside 1..last, are left out."""
    parts = F.filter(F.transform(F.split(spec, ","), T.strip), lambda p: p != "")

    def pages(p: Column) -> Column:
        left, right = T.strip(F.split_part(p, F.lit("-"), F.lit(1))), T.strip(F.regexp_extract(p, r"(?s)-(.*)$", 1))
        ranged = p.contains("-")
        a = F.when(left == "", F.lit(1)).otherwise(left.try_cast("int"))
        b = F.when(~ranged, a).when(right == "", last.cast("int")).otherwise(right.try_cast("int"))
        a, b = F.greatest(a, F.lit(1)), F.when(a.isNotNull() & b.isNotNull(), F.least(b, last.cast("int")))
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    return F.sort_array(F.array_distinct(F.flatten(F.transform(parts, pages))))


def page_range(spec: Column, last: Column) -> Column:
    """struct(a, b) of 'a-b' or 'a', brought into 1..last; null if it is not of that form."""
    left, right = F.split_part(spec, F.lit("-"), F.lit(1)), F.split_part(spec, F.lit("-"), F.lit(2))
    a = T.strip(left).try_cast("int")
    b = F.when(spec.contains("-"), T.strip(right).try_cast("int")).otherwise(a)
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.greatest(F.lit(1), a).alias("a"), F.least(last.cast("int"), b).alias("b")))


def page_arguments(*args: str) -> str:
    """One specification from a command's page arguments: none is page 1, two numbers are a range, else a list."""
    given = [a.strip() for a in args if a.strip()]
    if not given:
        return "1"
    if len(given) == 2 and all(a.isdigit() for a in given):
        return "-".join(given)
    return ",".join(given)


def slice_pages(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges (book, start_phys, end_phys, ...) with content, page_count and total_chars, is_scanned (by text on them).

    Pages meet ranges by book and page number, and texts are put together in order.  A range of a book is at most the
    book's pages, so no task gets more than its ranges' own text.
    """
    keyed = ranges.withColumn("__at", F.explode(F.when(F.col("start_phys") <= F.col("end_phys"), F.sequence("start_phys", "end_phys")).otherwise(F.array())))
    body = pages.select(F.col("book").alias("__b"), F.col("phys").alias("__p"), F.coalesce("text", F.lit("")).alias("__text"))
    both = keyed.join(body, (F.col("book") == F.col("__b")) & (F.col("__at") == F.col("__p")))
    block = F.concat(F.lit("<!-- Page "), F.col("__p").cast("string"), F.lit(" -->\n"), F.col("__text"))
    per = both.groupBy(*ranges.columns).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("__p").alias("p"), block.alias("t")))), lambda x: x["t"]), "\n\n").alias("content"),
        F.sum(F.length(T.strip(F.col("__text")))).cast("long").alias("total_chars"))
    count = (F.col("end_phys") - F.col("start_phys") + 1).cast("long")
    return per.withColumn("page_count", count).withColumn("is_scanned", F.col("total_chars") < DIGITAL_CHARS * count)


def dual_channel(title: Column, images: Column, text: Column) -> Column:
    """Markdown of a scanned chapter: the list of its page images (array of struct(phys, path)) and the recognised text."""
    n = F.size(images).cast("string")
    listed = F.array_join(F.transform(images, lambda x: F.concat(F.lit("- Page "), x["phys"].cast("string"), F.lit(": `"), x["path"], F.lit("`"))), "\n")
    return F.concat(F.lit("# "), title, F.lit(DUAL_HEAD), F.lit("### Page images ("), n, F.lit(")\n"), listed, F.lit("\n\n---\n\n### Recognised text\n"), text, F.lit("\n"))


#: The note that precedes a scanned chapter's images.
DUAL_HEAD = "\n\n> A scanned chapter: layout, code and formulas are in the images, the text below was read from them.\n\n"


def category(code: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k, (name, _) in CATEGORIES.items():
        out = out.when(code == k, name)
    return out


def recommendation(code: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k, (_, what) in CATEGORIES.items():
        out = out.when(code == k, what)
    return out


def probe(pages: DataFrame, toc_counts: DataFrame) -> DataFrame:
    """A report a book from its pages (book, phys, text) and toc_counts (book, toc_count).

    total_pages, sample_char_counts in page order, avg_chars, is_digital, has_toc, toc_count, category, recommendation.
    """
    chars = F.length(T.strip(F.coalesce("text", F.lit(""))))
    totals = pages.groupBy("book").agg(F.max("phys").cast("long").alias("total_pages"))
    front = pages.where((F.col("phys") <= SAMPLE_FIRST) | (F.col("phys") == SAMPLE_EXTRA)).select(F.col("book").alias("b"), "phys", chars.alias("n"))
    taken = front.join(totals, F.col("b") == F.col("book")).where((F.col("phys") <= SAMPLE_FIRST) | (F.col("total_pages") > SAMPLE_EXTRA))
    counts = taken.groupBy("book", "total_pages").agg(F.transform(F.array_sort(F.collect_list(F.struct("phys", "n"))), lambda x: x["n"]).alias("sample_char_counts"), F.avg("n").alias("avg_chars"))
    out = counts.join(toc_counts, "book", "left").withColumn("toc_count", F.coalesce("toc_count", F.lit(0)).cast("long"))
    out = out.withColumn("is_digital", F.col("avg_chars") > DIGITAL_CHARS).withColumn("has_toc", F.col("toc_count") > 0)
    code = F.when(F.col("is_digital"), F.when(F.col("has_toc"), "A").otherwise("B")).otherwise(F.when(F.col("has_toc"), "C").otherwise("D"))
    return out.withColumn("category", category(code)).withColumn("recommendation", recommendation(code))


def first_lines(text: Column, n: int = 3) -> Column:
    """The first n filled lines: what a reader checks a page by."""
    return F.slice(T.filled_lines(text), 1, n)


def stats(content: Column, images: Column | None = None) -> Column:
    """struct(char_count, line_count, image_count)."""
    return F.struct(F.length(content).cast("long").alias("char_count"), T.line_count(content).alias("line_count"), (F.lit(0) if images is None else images).cast("long").alias("image_count"))
