"""Books, pages, bookmarks and markup as the test tables can stand in for them, each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pages that every derived bookmark list counts.
TOTAL = 400
PRINTED_TOTAL, PRINTED_LINES = 60, 10


#: Bytes of a file from which on it is worth dealing its rows to idle cores.
SPREAD_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it would be read by fewer tasks, as one file of one row group is; else df itself.

    For functions that cost far more than a row's shuffle.  Tables of many files, which large ones are, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size >= SPREAD_BYTES and df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def _pos(*by: str):
    return (F.row_number().over(Window.partitionBy("book").orderBy(*by)) - 1).cast("int")


# --- pages as the files of a book: a host is a book ----------------------------------------------------------------

HOST = r"^https?://([^/]+)"


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, pos, page_id, url, html"""
    pages = table(spark, sf_dir, "pages").withColumn("book", F.regexp_extract("url", HOST, 1))
    return pages.withColumn("pos", _pos("page_id"))


SPINE = f"spine AS (SELECT regexp_extract(url, '{HOST}', 1) AS book, (row_number() OVER (PARTITION BY regexp_extract(url, '{HOST}', 1) ORDER BY page_id) - 1)::INT AS pos, page_id, url, html FROM pages)"


def joined(df: DataFrame, order: str, text: str, sep: str = "") -> DataFrame:
    """A row a book with its texts joined in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col(text).alias("t")))), lambda x: x["t"])
    return df.groupBy("book").agg(F.array_join(parts, sep).alias(text))


def host_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, html: all pages of a host as one text, as a MOBI book's markup is"""
    return joined(spine(spark, sf_dir), "page_id", "html")


HOST_BOOKS = f"{SPINE}, books AS (SELECT book, string_agg(html, '' ORDER BY page_id) AS html FROM spine GROUP BY book)"


# --- events as dirty bookmarks: a user is a book --------------------------------------------------------------------


def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, pos, level, title, phys, total"""
    e = table(spark, sf_dir, "events").withColumn("book", F.col("user_id"))
    level = F.when(F.col("event_type").isin("signup", "purchase"), 1).when(F.col("event_type") == "view", 2).otherwise(3)
    phys = F.when(F.col("event_type") == "error", 0).when(F.col("value") > 300, -1).otherwise(F.floor("value").cast("int") + 1)
    title = F.concat_ws(" ", "event_type", F.col("event_id").cast("string"))
    return e.select("book", _pos("ts", "event_id").alias("pos"), level.alias("level"), title.alias("title"), phys.alias("phys"), F.lit(TOTAL).alias("total"))


BOOKMARKS = f"""toc AS (SELECT user_id AS book, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS pos,
  CASE WHEN event_type IN ('signup', 'purchase') THEN 1 WHEN event_type = 'view' THEN 2 ELSE 3 END AS level, event_type || ' ' || event_id AS title,
  CASE WHEN event_type = 'error' THEN 0 WHEN value > 300 THEN -1 ELSE floor(value)::INT + 1 END AS phys, {TOTAL} AS total FROM events)"""


# --- documents as pages: a source is a book -------------------------------------------------------------------------


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, phys, text"""
    d = table(spark, sf_dir, "documents").withColumn("book", F.col("source"))
    return d.select("book", (_pos("doc_id") + 1).alias("phys"), "text")


PAGES = "page AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS phys, text FROM documents)"


def page_ranges(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    """book, start_phys, end_phys: consecutive ranges of `width` pages, the last one shorter"""
    last = pages(spark, sf_dir).groupBy("book").agg(F.max("phys").alias("total"))
    start = F.explode(F.sequence(F.lit(1), F.col("total"), F.lit(width)))
    return last.select("book", "total", start.alias("start_phys")).select("book", "start_phys", F.least(F.col("start_phys") + width - 1, "total").alias("end_phys"))


def page_ranges_sql(width: int) -> str:
    return f"""{PAGES}, ranges AS (SELECT book, start_phys::INT AS start_phys, least(start_phys + {width - 1}, total)::INT AS end_phys FROM
  (SELECT book, total, unnest(range(1, total + 1, {width})) AS start_phys FROM (SELECT book, max(phys) AS total FROM page GROUP BY book)))"""


# --- parts as printed tables of contents and as markup: a brand is a book -------------------------------------------


def printed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, phys, text, label: contents pages of ten dotted lines; every page's label is two less than its place"""
    p = table(spark, sf_dir, "part").withColumn("book", F.col("p_brand")).withColumn("pos", _pos("p_partkey"))
    line = F.concat("p_name", F.lit(" "), F.expr("repeat('.', p_size % 5)"), F.lit(" "), F.col("p_size").cast("string"))
    p = p.select("book", F.floor(F.col("pos") / PRINTED_LINES + 1).cast("int").alias("phys"), "pos", line.alias("line"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    out = p.groupBy("book", "phys").agg(F.array_join(parts, "\n").alias("lines"))
    return out.select("book", "phys", F.concat(F.lit("Contents\n"), "lines").alias("text"), (F.col("phys") - 2).cast("string").alias("label"))


PRINTED = f"""parts AS (SELECT p_brand AS book, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, p_name || ' ' || repeat('.', p_size % 5) || ' ' || p_size AS line FROM part),
page AS (SELECT book, (pos // {PRINTED_LINES} + 1)::INT AS phys, 'Contents' || chr(10) || string_agg(line, chr(10) ORDER BY pos) AS text, ((pos // {PRINTED_LINES}) - 1)::VARCHAR AS label FROM parts GROUP BY book, pos // {PRINTED_LINES})"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, pos, title"""
    p = table(spark, sf_dir, "part").withColumn("book", F.col("p_brand"))
    return p.select("book", _pos("p_partkey").alias("pos"), F.concat(F.initcap("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit(".1 "), "p_type").alias("title"))


TITLES = """toc AS (SELECT p_brand AS book, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS pos,
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' ' || p_size || '.1 ' || p_type AS title FROM part)"""

#: Markup of a part by its brand's number modulo 5: what schemes A to E look for.
_PIECES = (
    "concat('<h', 1 + p_size % 4, ' class=\"t\"><b>', p_name, '</b></h', 1 + p_size % 4, '><p>', p_type, '</p>')",
    "concat('<p>', p_type, '</p><a name=\"p', p_partkey, '\">', CASE WHEN p_size % 3 = 0 THEN concat('Chapter ', p_size) ELSE '' END, '</a><div>', p_size, '. ', p_name, '</div>')",
    "concat('<p class=\"x\"><b> ', CASE WHEN p_size % 2 = 0 THEN concat(p_size, '.1 ') ELSE concat(p_size, '.2.3 ') END, p_name, '</b> </p><p>', p_type, '</p>')",
    "concat(CASE WHEN p_size % 2 = 0 THEN '<mbp:pagebreak/>' ELSE '<HR width=1>' END, CASE WHEN p_size % 7 = 0 THEN '' ELSE concat('<p> ', p_name, ' </p>') END, chr(10), chr(10))",
    "concat('<p>', p_name, ' ', p_type, '</p>')",
)
_KIND = "CAST(substr(p_brand, 7) AS INT) % 5"
_PIECE = f"CASE {_KIND} " + " ".join(f"WHEN {k} THEN {p}" for k, p in enumerate(_PIECES)) + " END"


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, html, title"""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("book"), "p_partkey", F.expr(_PIECE).alias("html"))
    return joined(p, "p_partkey", "html").withColumn("title", F.col("book"))


MARKUP = f"books AS (SELECT p_brand AS book, string_agg({_PIECE}, '' ORDER BY p_partkey) AS html, p_brand AS title FROM part GROUP BY p_brand)"


# --- texts as an OCR engine might give them -------------------------------------------------------------------------

_NOISE = (("' de '", "' - > '"), ("'. '", "' ; '"), ("', '", "' = = '"), ("' the '", "' / / '"), ("' est '", "' （ ： '"), ("' und '", "chr(8203)"))


def _noisy(text: str) -> str:
    for a, b in _NOISE:
        text = f"replace({text}, {a}, {b})"
    return text


def recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, raw: noisy documents, tagless pages, and events' properties"""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), F.expr(_noisy("text").replace("chr(8203)", r"'​'")).alias("raw"))
    p = spread(table(spark, sf_dir, "pages").select("page_id", "html")).select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), F.regexp_replace("html", "<[^>]+>", "").alias("raw"))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("event").alias("kind"), F.col("props").alias("raw"))
    return d.unionByName(p).unionByName(e)


RECOGNISED = f"""ocr AS (SELECT doc_id AS id, 'document' AS kind, {_noisy('text')} AS raw FROM documents
  UNION ALL SELECT page_id, 'page', regexp_replace(html, '<[^>]+>', '', 'g') FROM pages UNION ALL SELECT event_id, 'event', props FROM events)"""
