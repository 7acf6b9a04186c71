"""Native text functions against Python's rules for the same things."""

import random
import re

from pyspark.sql import functions as F

from bookspark.functions import files, text as T
from bookspark.operators import match, pages as P

ALPHABET = list("ab1 \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　​.:-/*=<>!;{第章٣é😀")


def _strings(n, seed):
    rng = random.Random(seed)
    return ["", *("".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(n))]


def _apply(spark, strings, column):
    rows = spark.createDataFrame(list(enumerate(strings)), "i int, s string").select("i", column(F.col("s")).alias("o")).collect()
    return [r.o for r in sorted(rows, key=lambda r: r.i)]


def test_strip_lines(spark):
    s = _strings(1500, 1)
    assert _apply(spark, s, T.strip) == [x.strip() for x in s]
    assert _apply(spark, s, T.lines) == [x.splitlines() for x in s]
    assert _apply(spark, s, T.line_count) == [len(x.splitlines()) for x in s]


def test_clean_ocr(spark):
    def want(x):
        x = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f﻿​�]", "", x)
        out = []
        for line in x.splitlines():
            line = line.strip()
            for pattern, to in T.REWRITES:
                line = re.sub(pattern, to, line)
            out.append(line)
        return "\n".join(out).strip()

    s = _strings(1500, 2)
    assert _apply(spark, s, T.clean_ocr) == [want(x) for x in s]


def test_clean_code(spark):
    s = ["#  include <a.h>", '# include "b"', "（x；） ： =", "# define X", None]
    assert _apply(spark, s, T.clean_code) == ["#include <a.h>".replace("e<", "e <"), '#include "b"', "(x;) : =", "#define X", ""]


def test_ocr_markdown(spark):
    got = _apply(spark, ["int main() {}", "plain\n\ntext", ""], lambda c: T.ocr_markdown(c, F.lit("alt"), F.lit(None).cast("string")))
    assert got == ["\n🖼️ **[插图: alt]**\n```cpp\nint main() {}\n```\n", "\n🖼️ **[插图: alt]**\n> plain\n>\n> text\n", "\n> *[插图: alt]*\n"]
    assert _apply(spark, [""], lambda c: T.ocr_markdown(c, F.lit("alt"), F.lit("a.png"))) == ["\n![alt](a.png)\n"]


def test_match_tiers(spark):
    toc = spark.createDataFrame([("b", 1, "Chapter 10 End"), ("b", 2, "Chapter 1 Intro"), ("b", 3, "1.2 Foo"), ("b", 4, "第1章 计算机")], "book string, pos int, title string")
    got = {r.query: (r.pos, r.tier) for r in match.find_chapters(toc, ["chapter 1", "1.2", "第1章", "计算", "1", "...", "1.2 foo", "nd", "  ", r"\E", None]).collect()}
    assert got == {"chapter 1": (1, 2), "1.2": (3, 2), "第1章": (4, 2), "计算": (4, 3), "1": (2, 2), "...": (1, 3), "1.2 foo": (3, 1), "nd": (1, 3)}


def test_page_spec(spark):
    s = ["1", "1-5", "12,15,20-22", "28-", "-2", "5-3", " , 3,3 ,", "x,4", ""]
    assert _apply(spark, s, lambda c: P.page_spec(c, F.lit(30))) == [[1], [1, 2, 3, 4, 5], [12, 15, 20, 21, 22], [28, 29, 30], [1, 2], [], [3], [4], []]
    assert [P.page_arguments(*a) for a in ((), ("3-5",), ("3", "5"), ("1", "x"), ("1", "2", "3"))] == ["1", "3-5", "3-5", "1,x", "1,2,3"]
    assert _apply(spark, ["2-4", "7", "0-99", "x"], lambda c: P.page_range(c, F.lit(9))) == [(2, 4), (7, 7), (1, 9), None]


def test_probe_boundaries(spark):
    rows = [("four", i, "x" * 30) for i in range(1, 5)] + [("ten", i, "x" * (31 if i <= 5 else 0)) for i in range(1, 11)] + [("eleven", i, "x" * (31 if i <= 5 else 0)) for i in range(1, 12)]
    counts = spark.createDataFrame([("ten", 2)], "book string, toc_count long")
    got = {r.book: (r.is_digital, r.category[0], r.sample_char_counts) for r in P.probe(spark.createDataFrame(rows, "book string, phys int, text string"), counts).collect()}
    assert got == {"four": (False, "D", [30] * 4), "ten": (True, "A", [31] * 5), "eleven": (False, "D", [31] * 5 + [0])}


def test_image_extension(spark):
    data = [b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"GIF87a", b"GIF89a", b"RIFF1234WEBP", b"BM1", b"II*\x00", b"MM\x00*", b"<svg", b"<?xml?>\n<svg", b"?", b"", b"\x03\xc7\x37\x66\x70"]
    rows = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "i int, d binary").select("i", files.image_extension(F.col("d")).alias("o")).orderBy("i").collect()
    assert [r.o for r in rows] == [".jpg", ".png", ".gif", ".gif", ".webp", ".bmp", ".tif", ".tif", ".svg", ".svg", ".png", ".png", ".png"]


def test_paths(spark):
    s = ["a/b.xhtml", "../x.png", "./y#z", "a%20b.html#q", "100%", "", "a+b", "../../../up"]
    assert _apply(spark, s, lambda c: files.resolve(F.lit("OEBPS/Text/c.xhtml"), c)) == ["OEBPS/Text/a/b.xhtml", "OEBPS/x.png", "OEBPS/Text/y", "OEBPS/Text/a b.html", "OEBPS/Text/100%", "OEBPS/Text", "OEBPS/Text/a+b", "../up"]
    assert _apply(spark, ["a.EPUB", "x/y.azw3", "n.prc", "p.pdf", ".epub", "q"], files.book_format) == ["EPUB", "MOBI", "MOBI", "PDF", "PDF", "PDF"]
