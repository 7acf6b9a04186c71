"""Queries over markup, books and settings planted in the test tables' rows, so that SQL can say what must come out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..api import Library
from ..functions import html as H
from ..functions import text as T
from ..operators import match, pages as P, toc as TOC
from ..sources import epub, palm, reader
from . import derived as D
from .native import spine_titles

#: Markup with {} for a part's size, the title and anchor it is converted with, and its Markdown.
FORMS = [
    ("<h2>Part {}</h2><p>one <b>two</b> <i>three</i></p>", None, None, "## Part {}\n\none **two** *three*"),
    ("<nav class='x-nav'><a href='a'>A{}</a></nav><p>body {}</p><footer>f</footer>", "T {}", None, "# T {}\n\nbody {}"),
    ("<pre><code class='language-python'>x = {}\nprint(x)</code></pre>", None, None, "```python\nx = {}\nprint(x)\n```"),
    ("<div class='program'>int a = {};</div><p>after</p>", None, None, "```\nint a = {};\n```\n\nafter"),
    ("<p style='font-family: Courier'>plain words {}</p>", None, None, "plain words {}"),
    ("<ul><li>a {}</li><li>b</li></ul><ol><li>c</li><li>d {}</li></ol>", None, None, "- a {}\n- b\n\n1. c\n2. d {}"),
    ("<table><tr><th>h</th><th>k</th></tr><tr><td>{}</td><td>v</td></tr></table>", None, None, "| h | k |\n| --- | --- |\n| {} | v |"),
    ("<p>see <a href='u{}.html'>link {}</a><a href='t'>[top]</a><a href='n'></a></p>", None, None, "see [link {}](u{}.html)"),
    ("<p>a</p><div id='s{}'><h1>S {}</h1><p>in</p></div><p>b</p>", "T", "s{}", "# S {}\n\nin"),
    ("<p>a</p><p id='s{}'>in</p>", "T", "s{}", "# T\n\na\n\nin"),
    ("<p>x <math><mi>α</mi></math> {}</p>", None, None, "x $\\alpha$ {}"),
    ("<p>t <img src='i{}.png' alt='pic {}'/></p>", None, None, "t ![pic {}](i{}.png)"),
    ("<blockquote><p>q {}</p></blockquote><hr/><p>e</p>", None, None, "> q {}\n\n---\n\ne"),
    ("<font face='Courier New'>line {}\nline two</font>", None, None, "```\nline {}\nline two\n```"),
    ("<p><tt>short {}</tt></p>", None, None, "`short {}`"),
    ("<h1>Own {}</h1><p>p</p>", "T", None, "# Own {}\n\np"),
]
#: Markup, anchor, and the markup of the section that the anchor names.
SECTIONS = [
    ('<p>a</p><div id="s{}"><p>in {}</p></div><p>b</p>', "s{}", '<div id="s{}"><p>in {}</p></div>'),
    ('<section id="s{}"><img src="i.png"/>x &amp; y</section>', "s{}", '<section id="s{}"><img src="i.png"/>x &amp; y</section>'),
    ('<article name="n{}">t</article><p>b</p>', "n{}", '<article name="n{}">t</article>'),
    ('<p>a</p><h2 id="s{}">h</h2><p>in</p>', "s{}", '<p>a</p><h2 id="s{}">h</h2><p>in</p>'),
    ('<div id="s{}">x</div>', None, '<div id="s{}">x</div>'),
]
#: Markup with images; their list as number|address|record|alt.
IMAGES = [
    ("<img src='a{}.png' alt=' one '/><img/><image xlink:href='b.svg'/>", ["1|a{}.png||one", "3|b.svg||"]),
    ("<p><img recindex='000{}' alt='x'/></p><img recindex='none'/>", ["1||{}|x"]),
    ("<p>none {}</p>", []),
]
ARGUMENTS = [(), ("7",), ("3", "5"), ("2", "4", "9"), ("48-", "x"), ("10-12",), (" ", "6")]
ARGUMENT_PAGES = ["1", "7", "3,4,5", "2,4,9", "48,49,50", "10,11,12", "6"]


def _pick(values: list, by: str = "p_partkey") -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(by) % len(values) + 1).cast("int"))


def _fill(values: list) -> Column:
    return F.replace(_pick(values), F.lit("{}"), F.col("p_size").cast("string"))


def _sql(values: list, by: str = "p_partkey") -> str:
    listed = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"replace(([{listed}]::VARCHAR[])[{by} % {len(values)} + 1], '{{}}', p_size::VARCHAR)"


def markdown_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, emphasis, code, lists, tables, links, anchors, formulas, images, quotes as Markdown."""
    html, title, anchor, _ = zip(*FORMS)
    part = D.table(spark, sf_dir, "part")
    return part.select("p_partkey", H.html_to_markdown(_fill(html), _fill(title), _fill(anchor)).alias("markdown"))


def anchor_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    html, anchor, _ = zip(*SECTIONS)
    return D.table(spark, sf_dir, "part").select("p_partkey", H.section_html(_fill(html), _fill(anchor)).alias("html"))


def image_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images in place: recognised text for the first, a saved path for the second, the third as it is."""
    n = F.col("p_size").cast("string")
    html = F.concat(F.lit("<p>a</p><img src='x.png' alt='q'/><p>b</p><img recindex='00002'/><p>c <img src='z"), n, F.lit(".png' alt='z'/></p>"))
    md = H.markdown_with_images(html, F.lit("T"), F.lit(None).cast("string"), F.create_map(F.lit(1), F.concat(F.lit("> read "), n)), F.create_map(F.lit(2), F.concat(F.lit("im/"), n, F.lit(".png"))))
    return D.table(spark, sf_dir, "part").select("p_partkey", md.alias("markdown"))


def image_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.table(spark, sf_dir, "part").select("p_partkey", H.image_list(_fill([x[0] for x in IMAGES])).alias("i"))
    rows = F.transform("i", lambda x: F.concat_ws("|", x["image"].cast("string"), F.coalesce(x["src"], F.lit("")), F.coalesce(x["recindex"].cast("string"), F.lit("")), x["alt"]))
    return out.select("p_partkey", F.array_join(rows, ";").alias("images"))


def envelope_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON documents of located chapters."""
    toc = spine_titles(D.spine(spark, sf_dir))
    found = match.find_chapters(toc, ["the", "de", "la"])
    body = toc.select("book", "pos", T.strip_tags(F.col("html")).alias("content"))
    out = found.join(body, ["book", "pos"])
    return out.select("book", "query", F.md5(sinks.envelope().cast("binary")).alias("json_md5"))


def index_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index document a book."""
    toc = spine_titles(D.spine(spark, sf_dir)).select("book", F.lit("EPUB").alias("book_format"), "pos", "index", F.lit(1).alias("level"), "title")
    return sinks.index_documents(toc).select("book", F.md5(F.col("json").cast("binary")).alias("json_md5"))


def toc_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.listing(TOC.heal(D.bookmarks(spark, sf_dir)).withColumn("index", F.col("pos") + 1), 30)


def palm_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of Palm files: markup, an EPUB inside (after a damaged one), a file cut off in its header."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            books, contents = [], []
            for k, size, name in zip(*(c.to_pylist() for c in b.columns)):
                inside = epub.build(f"B{k}", "nobody", [(f"c{i}", f"<p>{name}</p>") for i in range(size % 3 + 1)], "ncx")
                whole = palm.build(f"B{k}", f"<h1>One</h1><p>{name}</p><h1>Two</h1><p>{size}</p>", extra=[b"BOUNDARY", b"PK\x03\x04 damaged", inside] if k % 3 == 1 else None)
                books.append(f"B{k}")
                contents.append(whole[:60] if k % 3 == 2 else whole)
            yield pa.RecordBatch.from_arrays([pa.array(books), pa.array(["MOBI"] * len(books)), pa.array(contents, pa.binary())], names=["book", "format", "content"])

    parts = D.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name").repartition(spark.sparkContext.defaultParallelism)  # a book costs far more than its row
    files = parts.mapInArrow(build, "book string, format string, content binary")
    out = Library(spark).files(files).probe()
    return out.select("book", "format", F.col("error").isNotNull().alias("broken"), "title", "total_spine_items", "total_chars", "toc_count", "has_toc", F.when(F.col("error").isNull(), F.col("category")).alias("category"))


def mobi_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that chapters name by record number; one number has no record."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            data = [palm.build(f"B{k}", "<p>x</p>", images=[f"{name}/{i}".encode() for i in range(3)]) for k, name in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(data, pa.binary())], names=["p_partkey", "content"])

    books = D.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name").mapInArrow(build, "p_partkey long, content binary")
    numbers = F.array(F.lit(1), F.lit(3), F.lit(9))
    found = books.select("p_partkey", F.posexplode(reader.mobi_images("content", numbers)).alias("i", "data"))
    return found.select("p_partkey", numbers[F.col("i")].alias("recindex"), F.col("data").cast("string").alias("data"))


def dual_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    images = F.array(F.struct(n.alias("phys"), F.lit("a.png").alias("path")), F.struct((n + 1).alias("phys"), F.lit("b.png").alias("path")))
    return D.table(spark, sf_dir, "part").select("p_partkey", P.dual_channel(F.col("p_name"), images, F.col("p_type")).alias("markdown"))


def page_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a command's arguments name in a book of 50."""
    spec = _pick([P.page_arguments(*a) for a in ARGUMENTS])
    return D.table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(P.page_spec(spec, F.lit(50)), lambda x: x.cast("string")), ",").alias("pages"))


def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = _fill(["{}", "{}-45", " 5 - {} ", "0-{}", "{}-x", "-{}"])
    return D.table(spark, sf_dir, "part").select("p_partkey", P.page_range(spec, F.lit(40)).alias("r")).select("p_partkey", F.col("r.a").alias("first"), F.col("r.b").alias("last"))


QUERY_FUNCTIONS = (markdown_forms, anchor_sections, image_blocks, image_lists, envelope_json, index_json, toc_listing, palm_probe, mobi_images, dual_channel, page_arguments, page_range)


def queries() -> dict:
    return {f.__name__: f for f in QUERY_FUNCTIONS}


def oracle_sql() -> dict[str, str]:
    from .oracle import _SPINE_TITLES, SQL, _find, _lines, _tags

    images = _sql([";".join(x[1]) for x in IMAGES])
    stats = f"{{'char_count': length(content)::BIGINT, 'line_count': len({_lines('content')})::BIGINT, 'image_count': 0::BIGINT}}"
    return {
        "markdown_forms": f"SELECT p_partkey, {_sql([x[3] for x in FORMS])} AS markdown FROM part",
        "anchor_sections": f"SELECT p_partkey, {_sql([x[2] for x in SECTIONS])} AS html FROM part",
        "image_blocks": "SELECT p_partkey, '# T' || chr(10) || chr(10) || 'a' || chr(10) || chr(10) || '> read ' || p_size || chr(10) || chr(10) || 'b' || chr(10) || chr(10) || '![](im/' || p_size || '.png)' || chr(10) || chr(10) || 'c ![z](z' || p_size || '.png)' AS markdown FROM part",
        "image_lists": f"SELECT p_partkey, {images} AS images FROM part",
        "envelope_json": f"""WITH {_SPINE_TITLES}, m AS ({_find('toc', ['the', 'de', 'la'])}), x AS (SELECT m.book, query, m.title, {_tags('html')} AS content FROM m JOIN toc ON m.book = toc.book AND m.pos = toc.pos)
SELECT book, query, md5(to_json({{'success': true, 'file': book, 'title': title, 'content': content, 'images_dumped': []::VARCHAR[], 'stats': {stats}}})::VARCHAR) AS json_md5 FROM x""",
        "index_json": f"""WITH {_SPINE_TITLES} SELECT book, md5(to_json({{'file_path': book, 'format': 'EPUB', 'total_chapters': count(*), 'chapters': list({{'index': index, 'level': 1, 'title': title}} ORDER BY pos)}})::VARCHAR) AS json_md5 FROM toc GROUP BY book""",
        "toc_listing": f"""WITH h AS ({SQL['toc_heal']}) SELECT book, pos, lpad((pos + 1)::VARCHAR, 4, ' ') || '  ' || repeat('  ', level - 1) || CASE WHEN length(title) > 30 THEN title[:27] || '...' ELSE title END AS line FROM h""",
        "palm_probe": """WITH b AS (SELECT 'B' || p_partkey AS book, p_partkey % 3 AS k, p_size, p_name FROM part)
SELECT book, CASE k WHEN 1 THEN 'AZW3 / MOBI (KF8)' ELSE 'MOBI (PalmDOC/Mobi6)' END AS format, k = 2 AS broken, CASE WHEN k < 2 THEN book END AS title, CASE k WHEN 1 THEN (p_size % 3 + 1)::BIGINT END AS total_spine_items,
  CASE k WHEN 0 THEN (38 + length(p_name) + length(p_size::VARCHAR))::BIGINT END AS total_chars, CASE k WHEN 0 THEN 2 WHEN 1 THEN p_size % 3 + 1 END::BIGINT AS toc_count, CASE WHEN k < 2 THEN true END AS has_toc,
  CASE k WHEN 0 THEN 'M (Reflowable MOBI)' WHEN 1 THEN 'M (Kindle KF8/AZW3)' END AS category FROM b""",
        "mobi_images": "SELECT p_partkey::BIGINT AS p_partkey, unnest([1, 3, 9])::INT AS recindex, unnest([p_name || '/0', p_name || '/2', NULL]) AS data FROM part",
        "dual_channel": "SELECT p_partkey, '# ' || p_name || '" + P.DUAL_HEAD.replace("'", "''") + "### Page images (2)' || chr(10) || '- Page ' || p_size || ': `a.png`' || chr(10) || '- Page ' || (p_size + 1) || ': `b.png`' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '### Recognised text' || chr(10) || p_type || chr(10) AS markdown FROM part",
        "page_arguments": f"SELECT p_partkey, {_sql(ARGUMENT_PAGES)} AS pages FROM part",
        "page_range": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN 5 WHEN 3 THEN 1 END::INT AS first, CASE p_partkey % 6 WHEN 0 THEN least(40, p_size) WHEN 1 THEN 40 WHEN 2 THEN least(40, p_size) WHEN 3 THEN least(40, p_size) END::INT AS last FROM part""",
    }
