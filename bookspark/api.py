"""Libraries of books: probe, index, locate, extract, lazily over many files at once.

    books = Library(spark).read("/books")
    books.locate(["Chapter 1"]).show()
    books.extract(queries=["Chapter 1"]).select("book", "title", "content").show()
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ocr as O
from . import sinks
from .functions import files as FS
from .functions import html as H
from .functions import text as T
from .operators import headings, match, pages as P, toc as TOC
from .schemas import conform
from .sources import reader

EBOOK_FORMATS = ("md", "html")
PAGED_FORMATS = ("md", "text")
#: Most names of books that are broadcast.
FEW_BOOKS = 50_000


class Library:
    """Entry point; the OCR backend reads images where extraction is asked to."""

    def __init__(self, spark: SparkSession, backend: O.OcrBackend | None = None) -> None:
        self.spark, self.backend = spark, backend or O.NullBackend()

    def read(self, path: str, glob: str | None = None, toc: str | None = None) -> Books:
        """All EPUB, MOBI, AZW, AZW3 and PRC files below path; toc: where write_toc has put their tables of contents."""
        stored = self.spark.read.parquet(toc) if toc else None
        if glob:
            return self.files(reader.read_files(self.spark, path, glob), stored)
        return Books(reader.read_files(self.spark, path, reader.EPUB_GLOB), self.backend, stored, reader.read_files(self.spark, path, reader.MOBI_GLOB))

    def files(self, files: DataFrame, toc: DataFrame | None = None) -> Books:
        """Books from rows (book, format, content), and their tables of contents if these are at hand."""
        return Books(files, self.backend, toc)

    def paged(self, pages: DataFrame, bookmarks: DataFrame | None = None) -> Paged:
        """Paged books from tables: pages (book, phys, text[, label]), bookmarks (book, pos, level, title, phys)."""
        return Paged(pages, bookmarks)


class Books:
    """Electronic books.  Chapters' bodies are unpacked only when they are extracted."""

    def __init__(self, files: DataFrame, backend: O.OcrBackend, toc: DataFrame | None = None, mobi_files: DataFrame | None = None) -> None:
        self.files, self.backend, self._toc, self.mobi_files = files, backend, toc, mobi_files
        self.epubs = reader.epubs(files, mobi_files)
        self.mobis = reader.mobis(files if mobi_files is None else mobi_files)

    def toc(self) -> DataFrame:
        """All books' tables of contents in the schema TOC.

        Every verb needs them, some twice, so they are persisted (in memory and on disk, worked out again where lost) on
        first use, until close(); a stored table is used as it is.
        """
        if self._toc is not None:
            return self._toc
        epub = self.epubs.select("book", "format", F.explode("index.toc").alias("t")).select("book", "format", "t.*")
        mobi = headings.cascade(self._markup()).withColumn("format", F.lit("MOBI"))
        self._toc = conform(epub).unionByName(conform(mobi)).persist()
        return self._toc

    def close(self) -> None:
        """Lets go of what toc has persisted."""
        if self._toc is not None:
            self._toc.unpersist()

    def write_toc(self, path: str | None = None) -> Books:
        """Writes the tables of contents as Parquet; the books given back look chapters up there and open only matching files.

        Without a path they go into a folder of their own below sinks.cache_folder.
        """
        path = path or f"{sinks.cache_folder(self.files.sparkSession)}/toc-{uuid.uuid4().hex}"
        self.toc().write.mode("overwrite").parquet(path)
        return Books(self.files, self.backend, self.files.sparkSession.read.parquet(path), self.mobi_files)

    def _markup(self) -> DataFrame:
        return self.mobis.where("error is null").select("book", "html", "title")

    def probe(self) -> DataFrame:
        """A report a book, with error in place of all else for files that cannot be read.  Every file is opened once."""
        books = reader.reports(self.files, self.mobi_files)
        epub = F.col("kind") != "MOBI"
        shape = lambda make: F.when(F.col("kind") == "KF8", make(F.lit("K"))).when(epub, make(F.lit("E"))).otherwise(make(F.lit("M")))
        index = F.transform("toc", lambda x: F.struct(x["index"].alias("index"), x["level"].alias("level"), x["title"].alias("title")))
        if self._toc is None:
            own = F.when(F.col("error").isNull(), headings.listed(F.col("title")))
        else:  # as it is stored
            entries = self.toc().where("format = 'MOBI'").groupBy("book").agg(F.array_sort(F.collect_list(F.struct("pos", "index", "level", "title"))).alias("t"))
            books = books.join(entries, "book", "left")
            own = F.transform("t", lambda x: F.struct(x["index"].alias("index"), x["level"].alias("level"), x["title"].alias("title")))
        books = books.withColumn("entries", F.when(epub, index).otherwise(own))
        out = books.select(
            "book", F.when(F.col("kind") == "KF8", "AZW3 / MOBI (KF8)").when(epub, "EPUB").otherwise("MOBI (PalmDOC/Mobi6)").alias("format"), "error", "title", "author", "language",
            F.col("spine_items").cast("long").alias("total_spine_items"), F.length("html").cast("long").alias("total_chars"), F.size("entries").cast("long").alias("toc_count"), F.slice("entries", 1, 10).alias("toc_sample"), shape(P.category).alias("category"), shape(P.recommendation).alias("recommendation"))
        out = out.withColumn("toc_count", F.when(F.col("error").isNull(), F.greatest("toc_count", F.lit(0))))
        return out.withColumn("is_digital", F.when(F.col("error").isNull(), True)).withColumn("has_toc", F.col("toc_count") > 0)

    def index(self) -> DataFrame:
        """An index document a book: book, json."""
        meta = self.epubs.select("book", F.col("index.title").alias("book_title"), F.col("index.author").alias("book_author"), F.lit("EPUB").alias("book_format"), F.lit("EPUB TOC (NCX / NAV / Spine)").alias("book_source"))
        meta = meta.unionByName(self.mobis.select("book", F.col("title").alias("book_title"), F.lit(None).cast("string").alias("book_author"), F.lit("MOBI/AZW3").alias("book_format"), F.lit("MOBI / KF8 TOC").alias("book_source")))
        return sinks.index_documents(self.toc().drop("format", "phys").join(meta, "book"))

    def locate(self, queries: Sequence[str]) -> DataFrame:
        """book, query, tier, and the matching entry."""
        toc = self.toc()
        found = match.find_chapters(toc, list(queries))
        return found.select("book", "query", "tier", "pos").join(toc, ["book", "pos"])

    def select(self, queries: Sequence[str] | None = None, index: int | None = None, span: str | None = None) -> DataFrame:
        """Entries by number, else by query, else by a range of numbers such as '2-4' or '2-'; a missing number falls through to the queries."""
        toc = self.toc()
        if index is not None:
            by_number = toc.where(F.col("index") == index).withColumn("query", F.lit(None).cast("string"))
            if not queries:
                return by_number
            rest = self.locate(queries).drop("tier")
            return by_number.unionByName(rest.join(by_number.select("book"), "book", "left_anti"))
        if queries:
            return self.locate(queries).drop("tier")
        if span:
            first, dash, last = span.partition("-")
            a = int(first)
            within = F.col("index") >= a if dash and not last.strip() else F.col("index").between(a, int(last) if dash else a)
            return toc.where(within).withColumn("query", F.lit(None).cast("string"))
        raise ValueError("give queries, an index or a span")

    def html(self, entries: DataFrame, merge_subsections: bool = False) -> DataFrame:
        """entries with html: of an EPUB the file, or the container that the anchor names; of a MOBI book the section.

        merge_subsections: an EPUB chapter also takes in the files of the deeper entries that follow it.
        """
        epub = entries.where("file_path is not null")
        if merge_subsections:
            deeper = self._family(epub)
        else:
            deeper = epub.withColumn("files", F.array("file_path"))
        wanted = deeper.groupBy("book").agg(F.collect_set("files").alias("sets")).withColumn("names", F.array_distinct(F.flatten("sets"))).select("book", "names")
        bodies = self._of(self.epubs.select("book", "content"), wanted).join(wanted, "book").select("book", "names", reader.epub_entries("content", "names").alias("bodies"))
        bodies = bodies.select("book", F.explode(F.arrays_zip("names", "bodies")).alias("b")).select("book", F.col("b.names").alias("name"), F.expr("make_valid_utf8(cast(b.bodies as string))").alias("text"))
        parts = deeper.select(*entries.columns, F.posexplode("files").alias("part", "name")).join(bodies, ["book", "name"])
        joined = parts.groupBy(*entries.columns).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n").alias("whole"))
        anchor = F.lit(None).cast("string") if merge_subsections else F.col("anchor")
        epub = joined.withColumn("html", H.section_html("whole", anchor)).drop("whole")
        chosen = entries.where("file_path is null")
        mobi_toc = self.toc().where("format = 'MOBI'").select("book", "pos", "level", "char_offset")
        opened = reader.mobis(self._of(self.files if self.mobi_files is None else self.mobi_files, chosen))
        sections = headings.sections(opened.where("error is null").select("book", "html", "title"), mobi_toc, only=chosen).select("book", "pos", "html")
        mobi = chosen.join(sections, ["book", "pos"]).select(*entries.columns, "html")
        return epub.unionByName(mobi)

    def _of(self, files: DataFrame, chosen: DataFrame) -> DataFrame:
        """The files of chosen books: below the decoders, and without a shuffle of the files if the names are few."""
        books = chosen.select("book").distinct()
        few = books.limit(FEW_BOOKS + 1).count() <= FEW_BOOKS
        return files.join(F.broadcast(books) if few else books, "book", "left_semi")

    def _family(self, entries: DataFrame) -> DataFrame:
        ends = TOC.descendant_end(self.toc().where("file_path is not null").select("book", "pos", "level", "file_path"), "pos", "end").select("book", "pos", "end")
        spans = entries.join(ends, ["book", "pos"])
        others = self.toc().select(F.col("book").alias("b"), F.col("pos").alias("p"), F.col("file_path").alias("f"))
        met = spans.join(others, (F.col("book") == F.col("b")) & (F.col("p") >= F.col("pos")) & (F.col("end").isNull() | (F.col("p") < F.col("end"))))
        files = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("p", "f"))), lambda x: x["f"]))
        return met.groupBy(*entries.columns).agg(files.alias("files"))

    def images(self, chapters: DataFrame) -> DataFrame:
        """book, pos, index, image, internal_path, recindex, alt, data, ext, name of the images of chapters with html.

        Images that cannot be read are left out; the others keep their numbers.
        """
        listed = chapters.select("book", "pos", "index", "file_path", F.explode(H.image_list("html")).alias("i")).select("book", "pos", "index", "file_path", "i.*")
        listed = listed.withColumn("internal_path", F.when(F.col("file_path").isNotNull() & F.col("src").isNotNull(), FS.resolve(F.col("file_path"), F.split_part("src", F.lit("?"), F.lit(1)))))
        epub = listed.where("internal_path is not null")
        names = epub.groupBy("book").agg(F.collect_set("internal_path").alias("names"))
        read = self._of(self.epubs.select("book", "content"), names).join(names, "book").select("book", "names", reader.epub_entries("content", "names").alias("d"))
        read = read.select("book", F.explode(F.arrays_zip("names", "d")).alias("x")).select("book", F.col("x.names").alias("internal_path"), F.col("x.d").alias("data"))
        from_epub = epub.join(read.where("data is not null"), ["book", "internal_path"])
        mobi = listed.where("file_path is null and recindex is not null")
        numbers = mobi.groupBy("book").agg(F.collect_set("recindex").alias("numbers"))
        recs = self._of(self.mobis.select("book", "content"), numbers).join(numbers, "book").select("book", "numbers", reader.mobi_images("content", "numbers").alias("d"))
        recs = recs.select("book", F.explode(F.arrays_zip("numbers", "d")).alias("x")).select("book", F.col("x.numbers").alias("recindex"), F.col("x.d").alias("data"))
        from_mobi = mobi.join(recs.where("data is not null and length(data) > 0"), ["book", "recindex"])
        out = from_epub.select(*_IMAGE).unionByName(from_mobi.select(*_IMAGE))
        ext = F.when(FS.extension(F.col("internal_path")) != "", FS.extension(F.col("internal_path"))).otherwise(FS.image_extension(F.col("data")))
        number = F.coalesce("index", F.lit(1))
        return out.withColumn("ext", F.coalesce(ext, FS.image_extension(F.col("data")))).withColumn("name", FS.image_name(number, F.col("image"), F.col("ext")))

    def extract(self, queries: Sequence[str] | None = None, index: int | None = None, span: str | None = None, format: str = "md", dump_images: str | None = None, ocr: bool = False, merge_subsections: bool = False) -> DataFrame:
        """book, query, pos, index, level, title, format, content, images_dumped, stats of the chapters that select finds.

        dump_images: a folder (URI) below which each book's images are written, in a folder named by a hash of the book.
        ocr: images are replaced by what the backend reads in them.
        """
        if format not in EBOOK_FORMATS:
            raise ValueError(f"format of an electronic book must be one of {EBOOK_FORMATS}")
        chapters = self.html(self.select(queries, index, span), merge_subsections)
        out = chapters.withColumn("images_dumped", F.array().cast("array<string>"))
        if format == "html":
            out = out.withColumn("content", F.col("html"))
        elif not (ocr or dump_images):
            out = out.withColumn("content", H.html_to_markdown("html", "title", "anchor"))
        else:
            images = self.images(chapters)
            folder = F.concat(F.lit((dump_images or "").rstrip("/") + "/"), F.sha1(F.col("book").cast("binary")), F.lit("/"), F.col("name"))
            images = images.withColumn("path", folder if dump_images else F.lit(None).cast("string"))
            if dump_images:
                sinks.write_files(images.withColumn("name", F.concat(F.sha1(F.col("book").cast("binary")), F.lit("/"), F.col("name"))), dump_images).count()
            if ocr:
                images = O.recognise(images, self.backend)
                caption = F.when(F.col("recindex").isNotNull(), T.image_alt(F.col("alt"), F.col("image"), True)).otherwise(T.image_alt(F.col("alt"), F.col("image")))
                images = images.withColumn("block", T.ocr_markdown(F.col("text"), caption, F.col("path")))
            else:
                images = images.withColumn("block", F.lit(None).cast("string"))
            entries = lambda c: F.map_from_entries(F.transform(F.filter("all", lambda x: x[c].isNotNull()), lambda x: F.struct(x["image"], x[c])))
            per = images.groupBy(F.col("book").alias("b"), F.col("pos").alias("p")).agg(F.array_sort(F.collect_list(F.struct("image", "block", "path"))).alias("all"))
            per = per.select("b", "p", entries("block").alias("blocks"), entries("path").alias("paths"))
            out = chapters.join(per, (F.col("book") == F.col("b")) & (F.col("pos") == F.col("p")), "left")
            out = out.withColumn("content", H.markdown_with_images("html", "title", "anchor", "blocks", "paths")).withColumn("images_dumped", F.coalesce(F.map_values("paths"), F.array().cast("array<string>")))
        out = out.withColumn("stats", P.stats(F.col("content"), F.size("images_dumped")))
        return out.select("book", "query", "pos", "index", "level", "title", F.lit(format).alias("format"), "content", "images_dumped", "stats")

    def extract_range(self, span: str) -> DataFrame:
        """book, content: the chapters of a range of numbers, missing ones left out, joined by rules."""
        got = self.extract(span=span)
        parts = F.transform(F.array_sort(F.collect_list(F.struct("index", "content"))), lambda x: x["content"])
        return got.groupBy("book").agg(F.array_join(parts, "\n\n---\n\n").alias("content"))


_IMAGE = ("book", "pos", "index", "image", "internal_path", "recindex", "alt", "data")


class Paged:
    """Books of pages, such as PDF files whose text layer and bookmarks some other tool has put into tables."""

    def __init__(self, pages: DataFrame, bookmarks: DataFrame | None = None) -> None:
        self.pages = pages if "label" in pages.columns else pages.withColumn("label", F.lit(None).cast("string"))
        totals = self.pages.groupBy("book").agg(F.max("phys").alias("total"))
        self.totals = totals
        if bookmarks is None:
            bookmarks = pages.sparkSession.createDataFrame([], "book string, pos int, level int, title string, phys int")
        self.bookmarks = bookmarks.join(totals, "book").withColumn("title", T.strip(F.col("title")))

    def probe(self) -> DataFrame:
        counts = self.bookmarks.groupBy("book").agg(F.count(F.lit(1)).alias("toc_count"))
        return P.probe(self.pages, counts).join(TOC.sample(self.bookmarks), "book", "left")

    def index(self) -> DataFrame:
        """Chapter ranges of each book, from its bookmarks, else from its printed table of contents; source says which."""
        entries = TOC.contents_lines(self.pages)
        printed = TOC.printed_ranges(entries, TOC.page_offset(self.pages, entries), self.totals)
        return TOC.first_source([("bookmarks (healed get_toc)", TOC.chapter_ranges(self.bookmarks)), ("extracted text TOC + offset", printed)])

    def index_json(self) -> DataFrame:
        return sinks.index_documents(self.index().withColumnRenamed("source", "book_source").withColumn("book_format", F.lit("PDF")))

    def locate(self, queries: Sequence[str]) -> DataFrame:
        """book, query, tier, title, start_phys, end_phys by healed bookmarks."""
        ranges = TOC.chapter_ranges(self.bookmarks, "locate")
        found = match.find_chapters(ranges, list(queries), strip_title=True)
        return found.join(ranges.select("book", "pos", "level", "start_phys", "end_phys"), ["book", "pos"])

    def extract(self, queries: Sequence[str] | None = None, pages: str | None = None, format: str = "md", ocr_text: DataFrame | None = None) -> DataFrame:
        """book, title, start_phys, end_phys, page_count, is_scanned, content, stats.

        pages: a range 'a-b' or a page, brought into the book.  ocr_text (book, phys, text, path): page images and what was
        read in them; scanned chapters are then given by those, in Markdown with the list of images.
        """
        if format not in PAGED_FORMATS:
            raise ValueError(f"format of a paged book must be one of {PAGED_FORMATS}")
        if queries:
            ranges = self.locate(queries).select("book", "title", "start_phys", "end_phys")
        elif pages:
            span = P.page_range(F.lit(pages), F.col("total"))
            ranges = self.totals.withColumn("r", span).select("book", F.lit(f"Pages {pages}").alias("title"), F.col("r.a").alias("start_phys"), F.col("r.b").alias("end_phys")).where("start_phys <= end_phys")
        else:
            raise ValueError("give queries or pages")
        out = P.slice_pages(self.pages, ranges)
        if ocr_text is not None:
            clean = ocr_text.select("book", "phys", T.clean_ocr(F.col("text")).alias("text"))
            read = P.slice_pages(clean, ranges).select(*ranges.columns, F.col("content").alias("read"))
            keyed = ranges.withColumn("phys", F.explode(F.sequence("start_phys", "end_phys"))).join(ocr_text.select("book", "phys", "path"), ["book", "phys"])
            listed = keyed.groupBy(*ranges.columns).agg(F.array_sort(F.collect_list(F.struct("phys", "path"))).alias("images"))
            out = out.join(read, ranges.columns, "left").join(listed, ranges.columns, "left")
            text = F.coalesce("read", F.lit(""))
            dual = P.dual_channel(F.col("title"), F.col("images"), text) if format == "md" else text
            out = out.withColumn("content", F.when(F.col("is_scanned") & F.col("images").isNotNull(), dual).otherwise(F.col("content"))).withColumn("n_images", F.when(F.col("is_scanned"), F.greatest(F.size("images"), F.lit(0))).otherwise(0))
        else:
            out = out.withColumn("n_images", F.lit(0))
        return out.withColumn("stats", P.stats(F.col("content"), F.col("n_images"))).select("book", "title", "start_phys", "end_phys", "page_count", "is_scanned", "content", "stats")
