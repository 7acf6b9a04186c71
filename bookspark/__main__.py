"""python -m bookspark probe|index|locate|extract|paged PATH ...: the library from a shell."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="bookspark", description="Chapters of electronic books")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, what in (("probe", "what kind of books these are"), ("index", "their tables of contents as JSON documents"), ("locate", "the chapters that queries match"), ("extract", "chapters' text")):
        c = commands.add_parser(name, help=what)
        c.add_argument("path", help="a folder of EPUB and MOBI files, or one file")
        if name in ("locate", "extract"):
            c.add_argument("--chapter", action="append", default=[], help="a title, part of one, or a chapter number; may be repeated")
        if name == "extract":
            c.add_argument("--index", type=int)
            c.add_argument("--range", dest="span", help="numbers such as 2-4")
            c.add_argument("--format", choices=("md", "html"), default="md")
            c.add_argument("--dump-images", metavar="URI")
            c.add_argument("--json", action="store_true")
        if name in ("index", "extract"):
            c.add_argument("--output", metavar="URI", help="a folder for the files, in place of printing")
    c = commands.add_parser("paged", help="books of pages, from Parquet tables")
    c.add_argument("path", help="pages: book, phys, text")
    c.add_argument("--bookmarks", help="book, pos, level, title, phys")
    c.add_argument("--action", choices=("probe", "index", "list", "locate", "extract", "pages"), default="probe")
    c.add_argument("--chapter", action="append", default=[])
    c.add_argument("--format", choices=("md", "text"), default="md")
    c.add_argument("--pages", nargs="*", default=[], help="for pages: 7, 3 5, 2,4,9 or 20-")
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession

    from . import sinks
    from .api import Library

    spark = SparkSession.builder.appName("bookspark").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if args.command == "paged":
        return _paged(Library(spark), args)
    books = Library(spark).read(args.path)
    if args.command == "probe":
        books.probe().select("book", "format", "title", "author", "toc_count", "category", "error").show(truncate=60)
    elif args.command == "index" and args.output:
        print(sinks.write_index(books.index(), args.output).count())
    elif args.command == "index":
        for r in books.index().toLocalIterator():
            print(r.json)
    elif args.command == "locate":
        books.locate(args.chapter).select("book", "query", "tier", "index", "level", "title").show(truncate=60)
    else:
        out = books.extract(args.chapter or None, args.index, args.span, args.format, args.dump_images)
        if args.output:
            n = sinks.write_chapters(out, args.output, args.format).count()
            print(n)
            return 0 if n else 1
        found = False
        for r in out.withColumn("json", sinks.envelope("content", "images_dumped")).toLocalIterator():
            found = True
            print(r.json if args.json else r.content)
        if not found:
            print("no such chapter", file=sys.stderr)
            return 1
    return 0


def _paged(library, args) -> int:
    from pyspark.sql import functions as F

    from . import sinks
    from .operators import pages as P, toc as TOC

    spark = library.spark
    books = library.paged(spark.read.parquet(args.path), spark.read.parquet(args.bookmarks) if args.bookmarks else None)
    if args.action == "probe":
        books.probe().select("book", "total_pages", "avg_chars", "toc_count", "category").show(truncate=60)
    elif args.action == "index":
        for r in books.index_json().toLocalIterator():
            print(r.json)
    elif args.action == "list":
        for r in sinks.listing(TOC.heal(books.bookmarks).withColumn("index", F.col("pos") + 1)).orderBy("book", "pos").toLocalIterator():
            print(r.line)
    elif args.action == "locate":
        books.locate(args.chapter).select("book", "query", "tier", "title", "start_phys", "end_phys").show(truncate=60)
    elif args.action == "extract":
        for r in books.extract(args.chapter, format=args.format).toLocalIterator():
            print(r.content)
    else:
        spec = P.page_spec(F.lit(P.page_arguments(*args.pages)), F.col("total"))
        wanted = books.totals.select(F.col("book").alias("b"), F.explode(spec).alias("p"))
        rows = books.pages.join(wanted, (F.col("book") == F.col("b")) & (F.col("phys") == F.col("p"))).orderBy("book", "phys")
        for r in rows.select("phys", "text").toLocalIterator():
            print(f"<!-- Page {r.phys} -->\n{r.text or ''}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
