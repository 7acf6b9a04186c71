"""Tables of contents as relations: healing bookmarks, chapter ranges, printed contents, priorities of sources.

A toc has book, pos (0-based place in the list), level, title and phys (1-based page; 0 or less: broken), and total (the
book's pages).  Order matters everywhere, so every 'first' and 'next' goes by pos.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _per_book(toc: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """A row a book with its entries in order: one shuffle, combined by nothing but each book's own list."""
    fields = ["pos", "level", "title", "phys", *extra]
    return toc.groupBy("book").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("t"), F.max("total").alias("total"))


def _healed(mode: str) -> Column:
    """Entries of t with phys from the first descendant that has one; in index mode else from the next entry.

    A scan to the right stops at the first entry that is not deeper or has a page; it is a descendant iff it is deeper.
    """

    def heal(x: Column, i: Column) -> Column:
        later = F.slice("t", i + 2, F.greatest(F.size("t"), F.lit(1)))
        hit = F.get(F.filter(later, lambda y: (y["level"] <= x["level"]) | (y["phys"] > 0)), F.lit(0))
        child = F.when(hit["level"] > x["level"], hit["phys"])
        following = F.get("t", i + 1)["phys"]
        if mode == "index":
            child = F.coalesce(child, F.when(following > 0, following))
        return x.withField("phys", F.when(x["phys"] > 0, x["phys"]).otherwise(F.coalesce(child, x["phys"])))

    return F.transform("t", heal)


def heal(toc: DataFrame, mode: str = "index") -> DataFrame:
    """Bookmarks with broken pages mended.

    index: entries whose page then lies outside 1..total go.  locate: no loan from the next entry, and all entries stay.
    """
    if mode not in ("index", "locate"):
        raise ValueError(f"unknown mode {mode!r}")
    out = _per_book(toc).withColumn("t", _healed(mode)).select("book", "total", F.inline("t"))
    return out.where(F.col("phys").between(1, F.col("total"))) if mode == "index" else out


def chapter_ranges(toc: DataFrame, mode: str = "index") -> DataFrame:
    """book, pos, index, level, title, start_phys, end_phys, page_count of each chapter with a page.

    A chapter ends before the first later entry that is not deeper and starts no earlier, else with the book.  In locate
    mode starts and ends are brought into 1..total, as a single chapter's lookup does it.
    """
    if mode not in ("index", "locate"):
        raise ValueError(f"unknown mode {mode!r}")
    books = _per_book(toc).withColumn("t", _healed(mode))
    if mode == "index":
        books = books.withColumn("t", F.filter("t", lambda x: x["phys"].between(F.lit(1), F.col("total"))))

    def span(x: Column, i: Column) -> Column:
        start = x["phys"] if mode == "index" else F.greatest(F.lit(1), F.least(F.col("total"), x["phys"]))
        later = F.slice("t", i + 2, F.greatest(F.size("t"), F.lit(1)))
        following = F.get(F.filter(later, lambda y: (y["level"] <= x["level"]) & (y["phys"] >= start)), F.lit(0))["phys"] - 1
        if mode == "locate":
            following = F.when(following.isNotNull(), F.least(F.col("total"), following))
        return x.withField("start_phys", start).withField("end_phys", F.when(following.isNull(), F.col("total")).otherwise(F.greatest(start, following))).withField("index", (i + 1).cast("int"))

    out = books.select("book", F.inline(F.transform("t", span)))
    if mode == "locate":
        out = out.where("phys > 0")
    return out.select("book", "pos", "index", "level", "title", "start_phys", "end_phys", (F.col("end_phys") - F.col("start_phys") + 1).alias("page_count"))


def descendant_end(toc: DataFrame, at: str, end: str = "end", book_end: Column | None = None) -> DataFrame:
    """Adds where an entry's section ends: `at` of the next entry that is not deeper, else book_end (null: to the end)."""
    books = toc.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in toc.columns if c not in ("book", "pos")]))).alias("t"))

    def close(x: Column, i: Column) -> Column:
        later = F.slice("t", i + 2, F.greatest(F.size("t"), F.lit(1)))
        return x.withField(end, F.get(F.filter(later, lambda y: y["level"] <= x["level"]), F.lit(0))[at])

    out = books.select("book", F.inline(F.transform("t", close)))
    return out if book_end is None else out.withColumn(end, F.coalesce(end, book_end))


def entry_end(toc: DataFrame, at: str, end: str = "end") -> DataFrame:
    """Adds `at` of the next entry whatever its level; the last entry's is null."""
    return toc.withColumn(end, F.lead(at).over(Window.partitionBy("book").orderBy("pos")))


def numbered(toc: DataFrame) -> DataFrame:
    """Adds index, 1 for a book's first entry."""
    return toc.withColumn("index", F.row_number().over(Window.partitionBy("book").orderBy("pos")))


def first_source(sources: list[tuple[str, DataFrame]], label: str = "source") -> DataFrame:
    """For each book the rows of the first source that has any; label names it.  Columns are matched by name."""
    out = None
    for k, (name, df) in enumerate(sources):
        one = df.withColumn(label, F.lit(name)).withColumn("__prio", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    best = F.min("__prio").over(Window.partitionBy("book"))
    return out.withColumn("__best", best).where("__prio = __best").drop("__prio", "__best")


def sample(toc: DataFrame, n: int = 10) -> DataFrame:
    """book and toc_sample, its first n entries in order."""
    fields = [c for c in ("pos", "level", "title", "phys") if c in toc.columns]
    return toc.where(F.col("pos") < n).groupBy("book").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("toc_sample"))


# --- printed tables of contents -----------------------------------------------------------------------------------

# Words of a page that holds a table of contents, and how many pages are looked at for it and for page 1.
CONTENTS_WORDS, CONTENTS_ANY_CASE = ("目录", "Contents"), "TABLE OF CONTENTS"
CONTENTS_PAGES, LABEL_PAGES = 20, 40
CONTENTS_LINE = r"(?dU)^(.+?)[.．·\s]{2,}(\d+)\s*$"


def is_contents_page(text: Column) -> Column:
    out = F.upper(text).contains(CONTENTS_ANY_CASE)
    for w in CONTENTS_WORDS:
        out = out | text.contains(w)
    return out


def contents_lines(pages: DataFrame) -> DataFrame:
    """book, phys, line (0-based), title, logical: lines of the form 'title ..... 12' on contents pages among the first 20."""
    front = pages.where((F.col("phys") <= CONTENTS_PAGES) & is_contents_page(F.col("text")))
    return printed_entries(front.select("book", "phys", F.posexplode(T.lines(F.col("text"))).alias("line", "raw")), "raw")


def printed_entries(rows: DataFrame, column: str) -> DataFrame:
    """rows with title and logical in place of `column`; lines of another form, and titles of digits or one character, go."""
    line = T.strip(F.col(column))
    out = rows.withColumn("title", T.strip(F.regexp_extract(line, CONTENTS_LINE, 1))).withColumn("logical", F.regexp_extract(line, CONTENTS_LINE, 2))
    out = out.where((F.length("title") >= 2) & ~F.col("title").rlike(r"(?U)^\d+$") & (F.col("logical") != ""))
    digits = F.translate("logical", "０１２３４５６７８９٠١٢٣٤٥٦٧٨٩", "01234567890123456789")
    return out.withColumn("logical", digits.try_cast("int")).where("logical is not null").drop(column)


def page_offset(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """book, page_offset: what is added to a printed page number to get the physical page.

    The 0-based place of the first of 40 pages that is labelled 1; where that is 0 or there is none, the distance that puts
    the first printed entry on the second page after the last contents page, at least 0.
    """
    labelled = pages.where((F.col("phys") <= LABEL_PAGES) & (T.strip(F.col("label")) == "1")).groupBy("book").agg((F.min("phys") - 1).alias("by_label"))
    first = entries.groupBy("book").agg(F.max("phys").alias("last_contents"), F.min_by("logical", F.struct("phys", "line")).alias("first_logical"))
    guess = F.greatest(F.lit(0), F.col("last_contents") + 1 - F.col("first_logical"))
    return first.join(labelled, "book", "left").select("book", F.coalesce(F.nullif("by_label", F.lit(0)), guess).alias("page_offset"))


def printed_ranges(entries: DataFrame, offsets: DataFrame, totals: DataFrame) -> DataFrame:
    """Chapter ranges, all of level 1, from printed entries (book, phys, line, title, logical)."""
    order = Window.partitionBy("book").orderBy("phys", "line")
    rows = entries.join(offsets, "book").join(totals, "book")
    rows = rows.withColumn("start_phys", F.least(F.col("total"), F.greatest(F.lit(1), F.col("logical") + F.col("page_offset"))))
    rows = rows.withColumn("following", F.lead("start_phys").over(order)).withColumn("index", F.row_number().over(order))
    end = F.when(F.col("following").isNull(), F.col("total")).otherwise(F.greatest(F.col("start_phys"), F.col("following") - 1))
    rows = rows.withColumn("end_phys", end)
    return rows.select("book", (F.col("index") - 1).alias("pos"), "index", F.lit(1).alias("level"), "title", "start_phys", "end_phys", (F.col("end_phys") - F.col("start_phys") + 1).alias("page_count"))


def drift(chapters: DataFrame, pages: DataFrame, lines: int = 5, reach: int = 2) -> DataFrame:
    """chapters (book, pos, title, start_phys) with found_phys: the nearest page within `reach` whose first filled lines
    hold the title, else null.  Of two equally near pages the earlier counts.  From the reference's prose; it has no code for it."""
    near = F.explode(F.sequence(F.col("start_phys") - reach, F.col("start_phys") + reach)).alias("at")
    want = chapters.select("book", "pos", "title", "start_phys", near)
    head = pages.select(F.col("book").alias("b"), "phys", F.array_join(F.slice(T.filled_lines(F.col("text")), 1, lines), "\n").alias("head"))
    seen = want.join(head, (F.col("book") == F.col("b")) & (F.col("at") == F.col("phys"))).where(F.col("head").contains(F.col("title")))
    rank = F.struct(F.abs(F.col("at") - F.col("start_phys")), F.col("at"))
    best = seen.groupBy("book", "pos").agg(F.min_by("at", rank).alias("found_phys"))
    return chapters.join(best, ["book", "pos"], "left")
