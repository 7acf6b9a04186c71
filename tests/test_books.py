"""Codecs, Markdown and the library over files built as bytes."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from bookspark import ocr, sinks
from bookspark.api import Library
from bookspark.functions import html as H
from bookspark.sources import epub, palm

PNG = b"\x89PNG\r\n\x1a\n" + b"\0" * 20
CH1 = "<html><head><title>第1章 起步</title></head><body><h1>第1章 起步</h1><p>text one</p><table><tr><td>甲</td><td>乙</td></tr><tr><td>1</td><td>2</td></tr></table></body></html>"
CH2 = "<html><head><title>第2章 代码</title></head><body><h1>第2章 代码</h1><pre><code>int main() { return 0; }</code></pre><img src='../img/a.png' alt='code'/></body></html>"


def _files(spark, *books):
    return spark.createDataFrame([(n, f, bytearray(c)) for n, f, c in books], "book string, format string, content binary")


@pytest.fixture(scope="module")
def shelf(spark):
    two = epub.build("书", "作者", [("NCX 一", CH1), ("NCX 二", CH2)], "ncx", {"OEBPS/img/a.png": PNG})
    nav = epub.build("Nav", "", [("One", CH1), ("Two", CH2)], "nav")
    mobi = palm.build("Python 指南", "<html><body><h1>第1章 基础</h1><p>解释型</p><h2>细节</h2><p>x</p><h1>第2章 结构</h1><p>列表<img recindex='00001' alt='d/e.png'></p></body></html>", True, [PNG])
    kf8 = palm.build("K", "<p>old</p>", False, None, [b"BOUNDARY", two])
    return _files(spark, ("two", "EPUB", two), ("nav", "EPUB", nav), ("mobi", "MOBI", mobi), ("kf8", "MOBI", kf8), ("bad", "EPUB", b"no zip"), ("short", "MOBI", b"x"))


def test_toc(spark, shelf):
    toc = Library(spark).files(shelf).toc()
    got = {(r.book, r["index"]): (r.title, r.level) for r in toc.collect()}
    assert got[("two", 1)] == ("NCX 一", 1) and got[("nav", 2)] == ("Two", 1) and got[("kf8", 2)] == ("NCX 二", 1)
    assert [got[("mobi", i)] for i in (1, 2, 3)] == [("第1章 基础", 1), ("细节", 2), ("第2章 结构", 1)]


def test_probe(spark, shelf):
    got = {r.book: r for r in Library(spark).files(shelf).probe().collect()}
    assert got["two"].title == "书" and got["two"].author == "作者" and got["two"].toc_count == 2 and got["two"].category.startswith("E")
    assert "Python" in got["mobi"].title and got["mobi"].toc_count == 3 and got["mobi"].total_chars > 50
    assert got["kf8"].format == "AZW3 / MOBI (KF8)" and got["bad"].error and got["short"].error


def test_probe_opens_files_once(spark, shelf):
    """Files that are worked out are worked out once, and entries found within a row are those of the table of contents."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    pages = ["<hr>one\n<hr>two", "<p>a</p>", "<h1>x</h1>", "", "<a name='p'>Chapter 1</a><a id='q'></a><div>2. two</div>", "<p><b> 1.2 a</b></p><p><b>1.2.3 b</b></p>", f"<h1>{'t' * 100}</h1><h2>b</h2><h3>c</h3>", "<p>第1章 x</p><p>第2章 y</p>" * 9]
    more = _files(spark, *((f"m{k}", "MOBI", palm.build(f"M{k}", p)) for k, p in enumerate(pages)), ("other", "PDF", b"%PDF"))
    files = shelf.unionByName(more).mapInArrow(count, shelf.schema)
    got = {r.book: r for r in Library(spark).files(files).probe().collect()}
    assert made.value == shelf.count() + len(pages) + 1 and len(got) == made.value - 1
    toc = {}
    for r in Library(spark).files(shelf.unionByName(more)).toc().orderBy("book", "pos").collect():
        toc.setdefault(r.book, []).append((r["index"], r.level, r.title))
    for book, r in got.items():
        assert r.toc_count == (None if r.error else len(toc.get(book, []))) and [tuple(x) for x in r.toc_sample or ()] == toc.get(book, [])[:10], book


def test_extract(spark, shelf):
    books = Library(spark).files(shelf)
    got = {r.book: r for r in books.extract(["第2章", "NCX 二"]).collect()}
    assert "```cpp" in got["two"].content or "```c" in got["two"].content and "int main()" in got["two"].content
    assert "列表" in got["mobi"].content and "解释型" not in got["mobi"].content
    one = books.extract(index=1).where("book = 'two'").first()
    assert "| 甲 | 乙 |" in one.content and one.content.startswith("# ") and one.stats.char_count == len(one.content)
    section = books.extract(index=1).where("book = 'mobi'").first()
    assert "解释型" in section.content and "## 细节" in section.content and "列表" not in section.content
    joined = books.extract_range("1-9").where("book = 'two'").first().content
    assert joined.count("\n\n---\n\n") == 1
    with pytest.raises(ValueError):
        books.extract(index=1, format="pdf")


def test_stored_toc(spark, shelf, tmp_path):
    books = Library(spark).files(shelf).write_toc(str(tmp_path / "toc"))
    found = {(r.book, r.title) for r in books.extract(["第2章"]).collect()}
    assert ("mobi", "第2章 结构") in found
    assert Library(spark).files(shelf, books.toc()).locate(["ncx 二"]).count() == 2


def test_images(spark, shelf, tmp_path):
    class Reader:
        def recognize(self, images):
            return ["seen" for _ in images]

    books = Library(spark, ocr.FallbackBackend(ocr.NullBackend(), Reader())).files(shelf)
    got = {r.book: r for r in books.extract(index=2, ocr=True, dump_images=f"file://{tmp_path}").collect()}
    assert "> seen" in got["two"].content and "插图: code" in got["two"].content and len(got["two"].images_dumped) == 1
    assert got["two"].stats.image_count == 1 and len(list(tmp_path.rglob("ch002_img001.png"))) == 2  # two and kf8
    plain = books.extract(index=3).where("book = 'mobi'").first()
    assert "recindex:00001" in plain.content or "![" in plain.content


def _says():  # made within a function, so it is pickled by value
    class Says:
        def __init__(self, text):
            self.text = text

        def recognize(self, images):
            return [self.text if i != b"blank" else "" for i in images]

    return Says


def test_choose_engines(spark):
    says = _says()

    def broken():
        raise ImportError("no model")

    engines = [
        ocr.Engine("cloud", lambda: says("cloud"), needs_setting="OCR_TOKEN"),
        ocr.Engine("local", lambda: says("local"), needs_module="json"),
        ocr.Engine("absent", lambda: says("absent"), needs_module="no_such_module_here"),
    ]
    asked = lambda *a, **k: ocr.choose(engines, *a, **k).recognize([b"a", b"blank"])
    assert asked(env={"OCR_TOKEN": "t"}) == ["cloud", ""]
    assert asked("local", env={"OCR_TOKEN": "t"}) == ["local", ""]
    assert asked(env={}) == asked(env={"OCR_TOKEN": "your_token"}) == asked("absent", env={}) == ["local", ""]
    assert ocr.choose([engines[2]], env={}).recognize([b"a"]) == ocr.choose([]).recognize([b"a"]) == [""]
    with pytest.raises(ValueError):
        ocr.choose(engines, "other", env={})
    both = ocr.choose([ocr.Engine("broken", broken), engines[1]], env={})  # the first fails when it is built
    images = spark.createDataFrame([(1, bytearray(b"a")), (2, bytearray(b"blank")), (3, None)], "n int, data binary")
    assert {r.n: r.text for r in ocr.recognise(images, both).collect()} == {1: "local", 2: "", 3: ""}


def test_lazy_backend_is_built_once():
    made = []
    lazy = ocr.LazyBackend("counted", lambda: made.append(1) or _says()("x"))
    assert not made and lazy.recognize([b"a"]) == lazy.recognize([b"b"]) == ["x"] and made == [1]


def test_cache_folder(spark, shelf, tmp_path):
    good = f"file://{tmp_path}/cache"
    (tmp_path / "file").write_text("x")
    bad = f"file://{tmp_path}/file/below"
    assert sinks.writable([None, " ", bad, good]) == good and list((tmp_path / "cache").iterdir()) == []
    with pytest.raises(OSError):
        sinks.writable([bad])
    assert sinks.cache_folder(spark, bad, good) == good and sinks.cache_folder(spark, bad) not in (None, bad)
    books = Library(spark).files(shelf).write_toc()
    assert ("mobi", "第2章 结构") in {(r.book, r.title) for r in books.locate(["第2章"]).collect()}


def test_index_json(spark, shelf):
    import json

    got = {r.book: json.loads(r.json) for r in Library(spark).files(shelf).index().collect()}
    assert got["two"]["title"] == "书" and got["two"]["total_chapters"] == 2 and got["two"]["chapters"][1]["title"] == "NCX 二"
    lines = sinks.listing(Library(spark).files(shelf).toc().where("book = 'mobi'")).orderBy("pos").collect()
    assert lines[1].line == "   2    细节"


def test_merge_subsections(spark):
    toc = [("Part", 1, "a.xhtml"), ("Sub", 2, "b.xhtml"), ("Next", 1, "c.xhtml")]
    points = '<navPoint><navLabel><text>Part</text></navLabel><content src="a.xhtml"/><navPoint><navLabel><text>Sub</text></navLabel><content src="b.xhtml#x"/></navPoint></navPoint><navPoint><navLabel><text>Next</text></navLabel><content src="c.xhtml"/></navPoint>'
    content = _nested(points, {f: f"<p>{t}</p>" for t, _, f in toc})
    books = Library(spark).files(_files(spark, ("n", "EPUB", content)))
    assert [(r.title, r.level, r.anchor) for r in books.toc().orderBy("pos").collect()] == [("Part", 1, None), ("Sub", 2, "x"), ("Next", 1, None)]
    assert books.extract(["Part"]).first().content == "# Part\n\nPart"
    assert books.extract(["Part"], merge_subsections=True).first().content == "# Part\n\nPart\n\nSub"


def _nested(points, files):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="{f}" href="{f}"/>' for f in files)
        z.writestr("p.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}<item id="t" href="t.ncx"/></manifest><spine/></package>')
        z.writestr("t.ncx", f'<!DOCTYPE ncx><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{points}</navMap></ncx>')
        for f, body in files.items():
            z.writestr(f.upper() if f == "b.xhtml" else f, body)
    return out.getvalue()


def test_nav():
    nav = '<nav><ol><li><a href="z"/></ol></nav><nav epub:type="toc"><ol><li><a href="a%20b.xhtml#q">One</a><ol><li><a href="c.xhtml"></a></li></ol></li><li>none</li></ol></nav>'
    got = [(e["title"], e["level"], e["file_path"], e["anchor"]) for e in epub.nav_toc(nav, "x/nav.xhtml")]
    assert got == [("One", 1, "x/a b.xhtml", "q"), ("", 2, "x/c.xhtml", None)]


def test_palmdoc():
    assert palm.decompress(bytes([5, 1, 2, 3, 4, 5]) + b"abc\xe1\x00") == b"\x01\x02\x03\x04\x05abc a\x00"
    assert palm.decompress(b"abcde" + struct.pack(">H", 0x8000 | 5 << 3 | 2)) == b"abcdeabcde"
    assert palm.decompress(b"ab" + struct.pack(">H", 0x8000 | 9 << 3)) == b"ab" and palm.decompress(b"a\x80") == b"a"
    assert palm.decompress(b"abc" + struct.pack(">H", 0x8000 | 3 << 5 | 1), "compat") == b"abcabca"
    rng = random.Random(4)
    for _ in range(200):
        data = bytes(rng.choice(b"ab \x00\x01\xe9z") for _ in range(rng.randint(0, 300)))
        assert palm.decompress(palm.compress(data)) == data


def test_mobi_boundary_of_zero():
    """A header that is zero beyond its fields names record 0 as the KF8 boundary; without a ZIP the book stays a MOBI 6."""
    data = bytearray(palm.build("T", "<h1>a</h1><h1>b</h1>", False))
    (start,) = struct.unpack_from(">I", data, 78)
    struct.pack_into(">I", data, start + 192, 0)
    book = palm.open_mobi(bytes(data))
    assert book.epub is None and book.html == "<h1>a</h1><h1>b</h1>"


def test_purge_and_code():
    md = lambda h: H.to_markdown(h)
    assert md("<header>h</header><nav>kept</nav><nav class='navbar'>gone</nav><nav epub:type='toc'>x</nav><p>body<a href='#'>[Top]</a><a></a></p><footer>f</footer>") == "kept\n\nbody"
    assert md("<div class='highlight-code'><pre class='language-cpp'>a;\nb;</pre></div>") == "```cpp\na;\nb;\n```"
    assert md("<tt>x</tt> and <p class='program'>print(1); y</p>") == "`x` and\n\n```\nprint(1); y\n```"
    assert md("<ul><li>a<li>b<ol><li>c</ol></ul><blockquote><p>q<p>r</blockquote>") == "- a\n- b\n  1. c\n\n> q\n>\n> r"
    assert md("<p>a <b>b</b><br>c <a href='u'>l</a> <img src='s' alt='t'></p>") == "a **b**  \nc [l](u) ![t](s)"
    assert H.to_markdown("<p>x</p><section id='s'><p>y</p></section>", "T", "s") == "# T\n\ny"


def test_mathml():
    tex = lambda m: "".join(H.latex(c) for c in H.parse(m).children)
    assert tex("<math><mfrac><mi>a</mi><mi>β</mi></mfrac><mo>≤</mo><msqrt><mn>2</mn></msqrt></math>") == r"$\frac{a}{\beta}\le \sqrt{2}$"
    assert tex("<math><msup><mi>x</mi></msup><mo>+</mo><mfenced open='['><mn>1</mn></mfenced></math>") == "$x + [1)$"
    assert tex("<math mode='display'><mroot><mi>x</mi><mn>3</mn></mroot><munder><mi>m</mi><mi>n</mi></munder></math>") == "\n$$\n\\sqrt[3]{x}mn\n$$\n"


def test_paged(spark):
    pages = spark.createDataFrame([("b", 1, "Cover\nContents\nChapter 1 ..... 2\nChapter 2 ..... 3", None), ("b", 2, "Getting Started body", None), ("b", 3, "Advanced", None)], "book string, phys int, text string, label string")
    marks = spark.createDataFrame([("b", 0, 1, "Chapter 1: Getting Started", 2), ("b", 1, 1, "Chapter 2: Advanced Topics", 3)], "book string, pos int, level int, title string, phys int")
    book = Library(spark).paged(pages, marks)
    assert [(r.start_phys, r.end_phys) for r in book.index().orderBy("pos").collect()] == [(2, 2), (3, 3)]
    report = book.probe().first()
    assert report.total_pages == 3 and report.has_toc
    assert "Getting Started" in book.extract(["Chapter 1"]).first().content
    assert book.extract(pages="2-9").first().content == "<!-- Page 2 -->\nGetting Started body\n\n<!-- Page 3 -->\nAdvanced"
    bare = Library(spark).paged(pages)
    assert [(r.title, r.source[:9]) for r in bare.index().orderBy("pos").collect()] == [("Chapter 1", "extracted"), ("Chapter 2", "extracted")]
    seen = spark.createDataFrame([("b", 3, "re ad", "p3.png")], "book string, phys int, text string, path string")
    scanned = book.extract(["Chapter 2"], ocr_text=seen).first()
    assert scanned.is_scanned and "- Page 3: `p3.png`" in scanned.content and "re ad" in scanned.content


def test_ingest(spark, tmp_path):
    from bookspark.streaming import ingest

    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"b{k}.epub").write_bytes(epub.build(f"T{k}", "", [("One", CH1)], "nav"))
        ingest.run_contents(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.title, r.n_entries) for r in got.collect()) == [("T0", 1), ("T1", 1)]


def test_read_folder(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(epub.build("A", "", [("One", CH1)], "spine"))
    (tmp_path / "b.azw3").write_bytes(palm.build("B", "<hr>one\n<hr>two"))
    books = Library(spark).read(str(tmp_path))
    assert sorted((r.book.rsplit("/")[-1], r.title) for r in books.toc().collect()) == [("a.epub", "第1章 起步"), ("b.azw3", "one"), ("b.azw3", "two")]
    assert books.select(index=1).select(F.count("*")).first()[0] == 2


def test_command_line(spark, tmp_path, capsys):
    from bookspark.__main__ import main

    (tmp_path / "a.epub").write_bytes(epub.build("A", "", [("One", CH1), ("Two", CH2)], "nav"))
    assert main(["extract", str(tmp_path), "--chapter", "two", "--json"]) == 0
    import json

    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["success"] and out["title"] == "Two" and "int main()" in out["content"] and out["stats"]["char_count"] == len(out["content"])
    assert main(["index", str(tmp_path)]) == 0 and '"total_chapters":2' in capsys.readouterr().out
    assert main(["extract", str(tmp_path), "--chapter", "nothing of the kind"]) == 1


def test_damaged_palm_files():
    """A record table that is cut off keeps what it names; an unknown compression is read as PalmDOC or as it is."""
    import struct

    whole = bytearray(palm.build("T", "<p>hello</p>", packed=False))
    struct.pack_into(">H", whole, 76, 9999)
    assert len(palm.records(bytes(whole))) > 2 and palm.records(bytes(whole))[0][16:20] == b"MOBI"
    with pytest.raises(ValueError):
        palm.records(b"x" * 70)
    recs = [b"", b"plain text"]
    assert palm.markup(recs, palm.Header(compression=17480, text_records=1)) == "plain text"


def test_settings_precedence(tmp_path):
    from bookspark.functions import settings as S

    path = tmp_path / "conf.yaml"
    path.write_text("other: 1\ntoken: your_token_here\n  token: \"abc\" # x\n")
    assert S.setting("token", "arg", {"token": "env"}, [str(path)]) == ("arg", "argument")
    assert S.setting("token", "<token>", {"token": "env"}, [str(path)]) == ("env", "environment")
    assert S.setting("token", None, {"token": " "}, ["/no/such", str(path)]) == ("abc", str(path))
    assert S.setting("none", None, {}, [str(path)]) == (None, None)


def test_written_chapters_and_index(spark, tmp_path, capsys):
    from bookspark.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.epub").write_bytes(epub.build("A", "nobody", [("One", "<p>first</p>"), ("Two", "<p>second</p>")], "ncx"))
    out = f"file://{tmp_path}/out"
    assert main(["extract", str(tmp_path / "in"), "--range", "1-", "--output", out]) == 0 and main(["index", str(tmp_path / "in"), "--output", out]) == 0
    assert main(["extract", str(tmp_path / "in"), "--index", "9", "--output", out]) == 1
    files = sorted(p.relative_to(tmp_path / "out") for p in (tmp_path / "out").rglob("*") if p.is_file())
    assert [p.name for p in files if p.suffix == ".md"] == ["000001.md", "000002.md"] and sum(p.suffix == ".json" for p in files) == 1
    assert (tmp_path / "out" / files[0]).read_text() == "# One\n\nfirst" or (tmp_path / "out" / files[1]).read_text() == "# One\n\nfirst"
    spark.createDataFrame([("b", 1, "x"), ("b", 2, "y"), ("b", 3, None)], "book string, phys int, text string").write.parquet(f"{tmp_path}/pages")
    capsys.readouterr()
    assert main(["paged", f"{tmp_path}/pages", "--action", "pages", "--pages", "2", "3"]) == 0
    assert capsys.readouterr().out == "<!-- Page 2 -->\ny\n<!-- Page 3 -->\n\n"
