"""Ranges, healing and printed contents against small independent versions."""

import random

from bookspark.operators import toc


def _books(n, seed):
    rng = random.Random(seed)
    rows = []
    for book in range(n):
        total = rng.randint(1, 40)
        for pos in range(rng.randint(0, 14)):
            rows.append((book, pos, rng.randint(1, 3), f"t{pos}", rng.choice([-1, 0, *range(1, 46)]), total))
    return rows


def _heal(entries, loan):
    out = []
    for i, (level, phys) in enumerate(entries):
        if phys <= 0:
            got = None
            for l, p in entries[i + 1 :]:
                if l <= level:
                    break
                if p > 0:
                    got = p
                    break
            if got is None and loan and i + 1 < len(entries) and entries[i + 1][1] > 0:
                got = entries[i + 1][1]
            phys = got if got is not None else phys
        out.append((level, phys))
    return out


def _by_book(rows):
    books = {}
    for book, pos, level, title, phys, total in rows:
        books.setdefault((book, total), []).append((pos, level, phys))
    return books


SCHEMA = "book int, pos int, level int, title string, phys int, total int"


def test_index_ranges(spark):
    rows = _books(600, 1)
    want = []
    for (book, total), entries in _by_book(rows).items():
        healed = [(pos, l, p) for (pos, _, _), (l, p) in zip(entries, _heal([(l, p) for _, l, p in entries], True)) if 1 <= p <= total]
        for i, (pos, l, p) in enumerate(healed):
            nxt = next((q for _, m, q in healed[i + 1 :] if m <= l and q >= p), None)
            want.append((book, pos, i + 1, p, total if nxt is None else max(p, nxt - 1)))
    got = toc.chapter_ranges(spark.createDataFrame(rows, SCHEMA)).select("book", "pos", "index", "start_phys", "end_phys")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_locate_ranges(spark):
    rows = _books(600, 2)
    want = []
    for (book, total), entries in _by_book(rows).items():
        healed = _heal([(l, p) for _, l, p in entries], False)
        for i, (l, p) in enumerate(healed):
            if p > 0:
                start = max(1, min(total, p))
                nxt = next((q for m, q in healed[i + 1 :] if m <= l and q >= start), None)
                want.append((book, entries[i][0], start, total if nxt is None else max(start, min(total, nxt - 1))))
    got = toc.chapter_ranges(spark.createDataFrame(rows, SCHEMA), "locate").select("book", "pos", "start_phys", "end_phys")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_contents_lines(spark):
    lines = ["Chapter 1 ...... 12", "甲．．3", "a b··7", "Chapter.12", "Chapter . 12", "123 .... 4", "x .. 5", "Two\t\t9  "]
    pages = spark.createDataFrame([("b", 1, "目录\n" + "\n".join(lines), None), ("b", 2, "nothing .... 8", None)], "book string, phys int, text string, label string")
    got = [(r.line, r.title, r.logical) for r in toc.contents_lines(pages).orderBy("line").collect()]
    assert got == [(1, "Chapter 1", 12), (3, "a b", 7), (5, "Chapter", 12), (8, "Two", 9)]


def test_offsets(spark):
    page = lambda book, phys, label, text="": (book, phys, text, label)
    contents = "Contents\nOne ..... 3\nTwo ..... 9"
    rows = [page("labelled", 1, None, contents), page("labelled", 19, " 1 "), page("first", 1, "1", contents), page("none", 4, None, contents)]
    pages = spark.createDataFrame(rows, "book string, phys int, text string, label string")
    got = {r.book: r.page_offset for r in toc.page_offset(pages, toc.contents_lines(pages)).collect()}
    assert got == {"labelled": 18, "first": 0, "none": 2}


def test_drift(spark):
    pages = spark.createDataFrame([("b", i, f"\n head {i}\nx") for i in range(1, 9)], "book string, phys int, text string")
    chapters = spark.createDataFrame([("b", 0, "head 4", 5), ("b", 1, "head 1", 8), ("b", 2, "x", 3)], "book string, pos int, title string, start_phys int")
    assert {r.pos: r.found_phys for r in toc.drift(chapters, pages).collect()} == {0: 4, 1: None, 2: 3}
