"""DuckDB SQL for the native queries, written in another form than the plans wherever there is one: joins for arrays."""

from __future__ import annotations

from ..functions import text as T
from ..operators import headings, pages as P
from . import derived as D
from .native import QUERIES

_W = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _q(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{_W}+|{_W}+\z', '', 'g')"


def _tags(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]+>', '', 'g')"


def _lines(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{_BREAK}'), lambda l, i: NOT (l = '' AND i = len(string_split_regex({x}, '{_BREAK}'))))"


def _filled(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '{_BREAK}'), lambda l: {_strip('l')}), lambda l: l <> '')"


_HEALED = """f AS (SELECT a.book, a.pos, a.level, a.title, a.phys, a.total, min(CASE WHEN b.level <= a.level THEN b.pos END) AS stop, min(CASE WHEN b.phys > 0 THEN b.pos END) AS cpos,
  min_by(b.phys, b.pos) FILTER (WHERE b.phys > 0) AS cphys, max(CASE WHEN b.pos = a.pos + 1 THEN b.phys END) AS nphys
  FROM toc a LEFT JOIN toc b ON a.book = b.book AND b.pos > a.pos GROUP BY ALL),
h AS (SELECT book, pos, level, title, total, CASE WHEN phys > 0 THEN phys WHEN cpos < coalesce(stop, 2147483647) THEN cphys {next}ELSE phys END AS phys FROM f)"""
_INDEX = _HEALED.format(next="WHEN nphys > 0 THEN nphys ") + ", v AS (SELECT * FROM h WHERE phys BETWEEN 1 AND total)"
_LOCATE = _HEALED.format(next="") + ", v AS (SELECT *, greatest(1, least(total, phys)) AS start FROM h)"

_LOCATE_RANGES = f"""WITH {D.BOOKMARKS}, {_LOCATE},
r AS (SELECT a.book, a.pos, a.level, a.title, a.start AS start_phys, a.total, min_by(b.phys, b.pos) - 1 AS following FROM v a LEFT JOIN v b ON a.book = b.book AND b.pos > a.pos AND b.level <= a.level AND b.phys >= a.start
  WHERE a.phys > 0 GROUP BY ALL),
g AS (SELECT book, pos, level, title, start_phys, CASE WHEN following IS NULL THEN total ELSE greatest(start_phys, least(total, following)) END AS end_phys FROM r)"""

_RANGES = f"""WITH {D.BOOKMARKS}, {_INDEX},
r AS (SELECT a.book, a.pos, row_number() OVER (PARTITION BY a.book ORDER BY a.pos) AS index, a.level, a.title, a.phys AS start_phys, a.end_phys FROM
  (SELECT a.book, a.pos, a.level, a.title, a.phys, greatest(a.phys, coalesce(min_by(b.phys, b.pos) - 1, a.total)) AS end_phys FROM v a
   LEFT JOIN v b ON a.book = b.book AND b.pos > a.pos AND b.level <= a.level AND b.phys >= a.phys GROUP BY a.book, a.pos, a.level, a.title, a.phys, a.total) a)
"""


def _tier(title: str, query: str) -> str:
    q = f"lower({_strip(query)})"
    sq = lambda x: rf"regexp_replace(lower({x}), '(?:{_W}|[-_.:：·])+', '', 'g')"
    pattern = rf"'(?:^|[\t-\r\x1c-\x20\x{{85}}\p{{Z}}第])' || regexp_escape({q}) || '(?:[\t-\r\x1c-\x20\x{{85}}\p{{Z}}.、:：章节]|$)'"
    return f"""CASE WHEN lower({title}) = {q} THEN 1 WHEN regexp_matches(lower({title}), {pattern}) OR starts_with(lower({title}), {q}) THEN 2
  WHEN contains({sq(title)}, {sq(query)}) THEN 3 WHEN contains(lower({title}), {q}) THEN 4 END"""


def _find(toc: str, queries: list[str], title: str = "title") -> str:
    values = ", ".join(f"({_q(q)})" for q in queries)
    return f"""SELECT book, query, tier, pos, title FROM (SELECT book, pos, title, query, tier, row_number() OVER (PARTITION BY book, query ORDER BY tier, pos) AS rn
  FROM (SELECT book, pos, {title} AS title, query, {_tier(title, 'query')} AS tier FROM {toc}, (VALUES {values}) AS q(query)) WHERE tier IS NOT NULL) WHERE rn = 1"""


_SPINE_TITLES = rf"""{D.SPINE}, titled AS (SELECT *, pos + 1 AS index, {_strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS t, {_strip("regexp_extract(html, '(?is)<h[1-2][^>]*>(.*?)</h[1-2]>', 1)")} AS h FROM spine),
toc AS (SELECT book, pos, index, html, coalesce(nullif({_strip(_tags("CASE WHEN t <> '' THEN t ELSE h END"))}, ''), url) AS title FROM titled)"""

# --- matches with offsets -------------------------------------------------------------------------------------------

_HEADING = "(?is)" + "|".join(f"<h{k}[^>]*>.*?</h{k}>" for k in (1, 2, 3, 4))


def _hits(pattern: str, name: str = "hits") -> str:
    """book, i, hit, char_offset, end_offset of every match in books.html."""
    p = _q(pattern)
    return f"""{name} AS (SELECT book, i, hit, (sum(gap + length(hit)) OVER (PARTITION BY book ORDER BY i) - length(hit))::BIGINT AS char_offset, sum(gap + length(hit)) OVER (PARTITION BY book ORDER BY i) AS end_offset,
  count(*) OVER (PARTITION BY book) AS n FROM (SELECT book, unnest(regexp_extract_all(html, {p})) AS hit, unnest(list_transform(string_split_regex(html, {p})[:-2], lambda s: length(s))) AS gap,
  unnest(range(len(regexp_extract_all(html, {p})))) AS i FROM books))"""


def _numbered(rows: str, index: str, least: int = 2) -> str:
    """The scheme's rows from `rows` (book, i, title, level, anchor, char_offset)."""
    return f"""SELECT book, pos, index, title, level, anchor, char_offset FROM (SELECT book, (row_number() OVER w - 1)::INT AS pos, {index} AS index, title, level::INT AS level, anchor, char_offset,
  count(*) OVER (PARTITION BY book) AS kept FROM ({rows}) r WINDOW w AS (PARTITION BY book ORDER BY i)) WHERE kept >= {least}"""


_ORDINAL = "(row_number() OVER w)::INT"
_A_ROWS = f"""SELECT book, i, {_strip(_tags("regexp_extract(hit, '(?is)^<h[1-4][^>]*>(.*)</h[1-4]>$', 1)"))} AS title, hit[3] AS level, NULL::VARCHAR AS anchor, char_offset FROM hits WHERE n >= 2"""
_A = _numbered(f"SELECT * FROM ({_A_ROWS}) WHERE length(title) BETWEEN 1 AND {headings.HEADING_MAX}", "(i + 1)::INT")
_ANCHOR = headings.ANCHOR.replace("(?isUu)", "(?is)")
_LIKE = "(" + " OR ".join(f"contains(title, {_q(w)})" for w in headings.CHAPTER_WORDS) + rf" OR regexp_matches(title, '^\d+(?:[.、]|{_W})'))"
_AFTER = "substr(html, end_offset::BIGINT + 1, {n})"
_B_ROWS = f"""SELECT h.book, i, CASE WHEN own = '' THEN {_filled(_tags(_AFTER.format(n=headings.ANCHOR_AFTER)))}[1] ELSE own END AS title, 1 AS level, regexp_extract(hit, {_q(_ANCHOR)}, 1) AS anchor, char_offset
  FROM (SELECT *, {_strip(_tags(f"regexp_extract(hit, {_q(_ANCHOR)}, 2)"))} AS own FROM hits) h JOIN books ON h.book = books.book"""
_B = _numbered(f"SELECT * FROM ({_B_ROWS}) WHERE length(title) BETWEEN 1 AND {headings.ANCHOR_MAX} AND {_LIKE}", _ORDINAL)
_PARAGRAPHS = [p.replace("(?idUu)", "(?i)") for p in headings.PARAGRAPHS]


def _c_rows(k: int) -> str:
    title = _strip(_tags(f"regexp_extract(hit, {_q(_PARAGRAPHS[k])}, 1)"))
    rows = f"SELECT book, i, title, CASE WHEN regexp_matches(title, '^\\d+\\.\\d+\\.\\d+') THEN 3 WHEN regexp_matches(title, '^\\d+\\.\\d+') THEN 2 ELSE 1 END AS level, NULL::VARCHAR AS anchor, char_offset FROM (SELECT *, {title} AS title FROM c{k} WHERE n >= 2) WHERE length(title) BETWEEN 1 AND {headings.PARAGRAPH_MAX}"
    return f"SELECT *, {k} AS k FROM ({_numbered(rows, _ORDINAL)})"


_C_HITS = ", ".join(_hits(p, f"c{k}") for k, p in enumerate(_PARAGRAPHS))
_C = f"SELECT book, pos, index, title, level, anchor, char_offset FROM (SELECT *, min(k) OVER (PARTITION BY book) AS best FROM ({' UNION ALL '.join(_c_rows(k) for k in range(len(_PARAGRAPHS)))})) WHERE k = best"
_BREAKS = headings.BREAK.replace("(?iu)", "(?i)")
_D_ROWS = f"""SELECT h.book, i, left(coalesce({_filled(_tags(_AFTER.format(n=headings.BREAK_AFTER)))}[1], 'Section ' || (i + 1)), {headings.BREAK_MAX}) AS title, 1 AS level, NULL::VARCHAR AS anchor, char_offset FROM hits h JOIN books ON h.book = books.book"""
_D = _numbered(_D_ROWS, "(i + 1)::INT", 1)
_E = "SELECT book, 0 AS pos, 1 AS index, coalesce(nullif(title, ''), 'Full Book Content') AS title, 1 AS level, NULL::VARCHAR AS anchor, 0::BIGINT AS char_offset FROM books WHERE html <> ''"
_A_CTE = f"{_hits(_HEADING)}, a AS ({_A})"


def _scoped(end: str) -> str:
    return f"""WITH {D.MARKUP}, {_A_CTE}, e AS ({end}) SELECT e.book, pos, char_offset AS html_start, coalesce(html_end, length(html))::BIGINT AS html_end,
  md5(substr(html, char_offset + 1, coalesce(html_end, length(html)) - char_offset)) AS html_md5 FROM e JOIN books ON e.book = books.book"""


# --- printed contents ----------------------------------------------------------------------------------------------

_LINE = rf"^(.+?)(?:[.．·]|{_W}){{2,}}(\d+){_W}*$"
_ENTRIES = f"""raw AS (SELECT book, phys, unnest({_lines('text')}) AS raw, unnest(range(len({_lines('text')}))) AS line FROM page WHERE phys <= 20 AND (contains(text, '目录') OR contains(text, 'Contents') OR contains(upper(text), 'TABLE OF CONTENTS'))),
cut AS (SELECT *, {_strip(f"regexp_extract({_strip('raw')}, {_q(_LINE)}, 1)")} AS title, regexp_extract({_strip('raw')}, {_q(_LINE)}, 2) AS digits FROM raw),
entries AS (SELECT book, phys, line::INT AS line, title, digits::INT AS logical FROM cut WHERE length(title) >= 2 AND NOT regexp_matches(title, '^\\d+$') AND digits <> '')"""
_OFFSETS = """offsets AS (SELECT book, coalesce(nullif((SELECT min(phys) - 1 FROM page p WHERE p.book = e.book AND phys <= 40 AND trim(label) = '1'), 0), greatest(0, max(phys) + 1 - arg_min(logical, phys * 100000 + line))) AS page_offset FROM entries e GROUP BY book)"""
_PRINTED = f"""printed AS (SELECT *, lead(start_phys) OVER (PARTITION BY book ORDER BY phys, line) AS following, row_number() OVER (PARTITION BY book ORDER BY phys, line)::INT AS index FROM
  (SELECT entries.*, least({D.PRINTED_TOTAL}, greatest(1, logical + page_offset)) AS start_phys FROM entries JOIN offsets USING (book)))"""
_PRINTED_RANGES = f"SELECT book, index - 1 AS pos, index, 1 AS level, title, start_phys, CASE WHEN following IS NULL THEN {D.PRINTED_TOTAL} ELSE greatest(start_phys, following - 1) END AS end_phys, CASE WHEN following IS NULL THEN {D.PRINTED_TOTAL} ELSE greatest(start_phys, following - 1) END - start_phys + 1 AS page_count FROM printed"

# --- recognised text -----------------------------------------------------------------------------------------------


def _java(p: str) -> str:
    """A pattern's Unicode classes in RE2's words; class members stay inside their brackets."""
    out, depth, i = "", 0, 0
    while i < len(p):
        two = p[i : i + 2]
        if two in (r"\s", r"\w", r"\d", r"\b"):
            inner = {r"\s": r"\t-\r\x1c-\x20\x{85}\p{Z}", r"\w": r"\p{L}\p{M}\p{Nd}\p{Pc}\p{Nl}", r"\d": r"\p{Nd}"}.get(two)
            out += (inner if depth else f"[{inner}]") if inner else two
            i += 2
            continue
        if p[i] == "\\":
            out += two
            i += 2
            continue
        depth += {"[": 1, "]": -1}.get(p[i], 0)
        out += p[i]
        i += 1
    return out


def _mend(x: str) -> str:
    x = _strip(x)
    for p, to in T.REWRITES:
        x = f"regexp_replace({x}, {_q(_java(p))}, {_q(to)}, 'g')"
    return x


_JUNK = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{feff}\x{200b}\x{fffd}]"
_CLEAN = f"cleaned AS (SELECT id, kind, {_strip(f'array_to_string(list_transform({_lines('j')}, lambda l: {_mend('l')}), chr(10))')} AS t FROM (SELECT id, kind, regexp_replace(raw, '{_JUNK}', '', 'g') AS j FROM ocr))"


def _code(x: str) -> str:
    x = f"translate({x}, {_q(T.FULL_WIDTH)}, {_q(T.HALF_WIDTH)})"
    x = rf"regexp_replace({x}, '#{_W}*include{_W}*<([^>]+)>', '#include <\1>', 'g')"
    x = rf"""regexp_replace({x}, '#{_W}*include{_W}*"([^"]+)"', '#include "\1"', 'g')"""
    for d in T.DIRECTIVES:
        x = f"regexp_replace({x}, '#{_W}*{d}', '#{d}', 'g')"
    return x


_IS_CODE = "(" + " OR ".join(f"regexp_matches(t, {_q('(?m)' + _java(p))})" for p in T.CODE_MARKS) + " OR length(t) - length(replace(t, ';', '')) >= 2 OR contains(t, '{'))"
_LANGUAGE = "CASE " + " ".join(f"WHEN regexp_matches(t, {_q(_java(p))}) THEN {_q(l)}" for l, p in T.OCR_LANGUAGES) + f" WHEN {_IS_CODE} THEN 'c' ELSE '' END"
# cleaned again, as code is before its punctuation is mended
_RECLEAN = _strip(f"array_to_string(list_transform({_lines('t')}, lambda l: {_mend('l')}), chr(10))")
_OCR_MD = f"""SELECT id, kind, length(m)::BIGINT AS n, md5(m) AS markdown_md5 FROM (SELECT id, kind, CASE
  WHEN t = '' AND path <> '' THEN chr(10) || '![' || alt || '](' || path || ')' || chr(10) WHEN t = '' THEN chr(10) || '> *[插图: ' || alt || ']*' || chr(10)
  WHEN {_IS_CODE} THEN chr(10) || head || chr(10) || CASE WHEN starts_with(c, '```') THEN c ELSE '```' || {_LANGUAGE} || chr(10) || c || chr(10) || '```' END || chr(10)
  ELSE chr(10) || head || chr(10) || array_to_string(list_transform({_lines('t')}, lambda l: CASE WHEN {_strip('l')} = '' THEN '>' ELSE '> ' || l END), chr(10)) || chr(10) END AS m FROM
  (SELECT *, {_code(_RECLEAN)} AS c, '🖼️ **[插图: ' || alt || ']**' || CASE WHEN path <> '' THEN ' *(高清原图路径: `' || path || '`)*' ELSE '' END AS head FROM
   (SELECT *, CASE kind WHEN 'page' THEN 'img/' || id || '.png' ELSE '' END AS path, CASE kind WHEN 'event' THEN kind ELSE '插图 ' || id END AS alt FROM cleaned)))"""


def _pick(values: list[str], by: str) -> str:
    return f"([{', '.join(_q(v) for v in values)}])[{by} % {len(values)} + 1]"


_CLASSES = ["lang-cpp", "go", "highlight-python", "java", "rs", "TypeScript", "sh", "sql", "xml", "c", "category", ""]
_CODES = ["#include <x>", "package main\nfunc f()", "def f(): pass", "printf(1)", "x := 1", "std::cout << 1", "int main()", "plain", "import (", "def  ", "char *p"]
_MAGICS = ["ffd8ff00", "89504e470d0a1a0a", "474946383761", "474946383961", "5249464600000000574542500000", "424d00", "49492a00", "4d4d002a", "3c73766720", "0a0a3c737667", "00", "3c3f786d6c3f3e3c7376673e"]
_EXTS = [".jpg", ".png", ".gif", ".gif", ".webp", ".bmp", ".tif", ".tif", ".svg", ".svg", ".png", ".svg"]
# languages worked out by hand for each class, and for texts where the class says nothing
_BY_CLASS = ["cpp", "go", "python", "java", "rust", "javascript", "bash", "sql", "html", "c", "", ""]
_BY_CODE = ["cpp", "go", "python", "c", "", "cpp", "c", "", "", "", "c"]

SQL = {
    "spine_toc": f"WITH {_SPINE_TITLES} SELECT book, pos, index, title FROM toc",
    "toc_heal": f"WITH {D.BOOKMARKS}, {_INDEX} SELECT book, pos, level, title, phys FROM v",
    "chapter_range": f"{_RANGES} SELECT *, end_phys - start_phys + 1 AS page_count FROM r",
    "chapter_range_locate": f"{_LOCATE_RANGES} SELECT *, end_phys - start_phys + 1 AS page_count FROM g",
    "find_chapter": f"WITH {D.TITLES} {_find('toc', list(QUERIES))}",
    "locate_pdf": f"{_LOCATE_RANGES}, m AS ({_find('g', ['purchase', 'view 1', 'error'])}) SELECT m.*, start_phys, end_phys FROM m JOIN g USING (book, pos)".replace("SELECT m.*", "SELECT m.book, query, tier, m.pos, m.title"),
    "heading_toc_offsets": f"WITH {D.HOST_BOOKS}, {_hits(_HEADING)} SELECT book, pos, index, title, level, char_offset FROM ({_A})",
    "toc_heading_scheme": f"WITH {D.MARKUP}, {_hits(_HEADING)} {_A}",
    "toc_anchor_scheme": f"WITH {D.MARKUP}, {_hits(_ANCHOR)} {_B}",
    "toc_pattern_scheme": f"WITH {D.MARKUP}, {_C_HITS} {_C}",
    "toc_pagebreak_scheme": f"WITH {D.MARKUP}, {_hits(_BREAKS)} {_D}",
    "toc_whole_scheme": f"WITH {D.MARKUP} {_E}",
    "toc_cascade": f"""WITH {D.MARKUP}, {_hits(_HEADING, 'ha')}, {_hits(_ANCHOR, 'hb')}, {_C_HITS}, {_hits(_BREAKS, 'hd')},
a AS ({_A.replace('FROM hits', 'FROM ha')}), b AS ({_B.replace('FROM hits', 'FROM hb')}), c AS ({_C}), d AS ({_D.replace('FROM hits', 'FROM hd')}), e AS ({_E}),
u AS (SELECT *, 'A' AS scheme FROM a UNION ALL SELECT *, 'B' FROM b UNION ALL SELECT *, 'C' FROM c UNION ALL SELECT *, 'D' FROM d UNION ALL SELECT *, 'E' FROM e)
SELECT * FROM u WHERE (book, scheme) IN (SELECT (book, min(scheme)) FROM u GROUP BY book)""",
    "mobi_chapter_slice": _scoped("SELECT x.book, x.pos, x.char_offset, min(y.char_offset) AS html_end FROM a x LEFT JOIN a y ON x.book = y.book AND y.pos > x.pos AND y.level <= x.level GROUP BY ALL"),
    "image_scope": _scoped("SELECT x.book, x.pos, x.char_offset, min(y.char_offset) AS html_end FROM a x LEFT JOIN a y ON x.book = y.book AND y.pos > x.pos GROUP BY ALL"),
    "text_toc_lines": f"WITH {D.PRINTED}, {_ENTRIES} SELECT * FROM entries",
    "text_toc_offset": f"WITH {D.PRINTED}, {_ENTRIES}, {_OFFSETS} SELECT * FROM offsets",
    "text_toc_ranges": f"WITH {D.PRINTED}, {_ENTRIES}, {_OFFSETS}, {_PRINTED} {_PRINTED_RANGES}",
    "index_cascade": f"""{_RANGES}, {D.PRINTED}, {_ENTRIES}, {_OFFSETS}, {_PRINTED}, p AS ({_PRINTED_RANGES}),
x AS (SELECT book::VARCHAR AS book, 'bookmarks (healed get_toc)' AS source, count(*) AS chapters, min(start_phys) AS first_phys, sum(end_phys - start_phys + 1)::BIGINT AS pages FROM r GROUP BY book
  UNION ALL SELECT book, 'extracted text TOC + offset', count(*), min(start_phys), sum(page_count)::BIGINT FROM p GROUP BY book),
n AS (SELECT DISTINCT source AS book FROM documents UNION SELECT book FROM p UNION SELECT user_id::VARCHAR FROM events)
SELECT n.book, coalesce(x.source, 'none (no TOC or bookmarks found)') AS source, coalesce(chapters, 0) AS chapters, first_phys, pages FROM n LEFT JOIN x ON n.book = x.book""",
    "probe_classify": f"""WITH {D.PAGES}, t AS (SELECT source AS book, count(*) AS toc_count FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source),
s AS (SELECT book, phys, length({_strip("coalesce(text, '')")}) AS n, max(phys) OVER (PARTITION BY book) AS total_pages FROM page),
g AS (SELECT book, total_pages::BIGINT AS total_pages, string_agg(n::VARCHAR, ',' ORDER BY phys) AS sample_char_counts, avg(n) AS avg_chars FROM s WHERE phys <= 5 OR (phys = 10 AND total_pages > 10) GROUP BY ALL),
k AS (SELECT g.*, coalesce(toc_count, 0) AS toc_count, avg_chars > 30 AS is_digital, coalesce(toc_count, 0) > 0 AS has_toc FROM g LEFT JOIN t USING (book))
SELECT k.*, CASE {' '.join(f"WHEN {c} THEN {_q(P.CATEGORIES[x][0])}" for x, c in (('A', 'is_digital AND has_toc'), ('B', 'is_digital'), ('C', 'has_toc'), ('D', 'true')))} END AS category,
  CASE {' '.join(f"WHEN {c} THEN {_q(P.CATEGORIES[x][1])}" for x, c in (('A', 'is_digital AND has_toc'), ('B', 'is_digital'), ('C', 'has_toc'), ('D', 'true')))} END AS recommendation FROM k""",
    "toc_sample": f"WITH {D.BOOKMARKS} SELECT book, string_agg(level || '|' || title || '|' || phys, ';' ORDER BY pos) AS sample FROM toc WHERE pos < 10 GROUP BY book",
    "page_spec": """WITH s AS (SELECT p_partkey, unnest(list_concat(range(p_size, p_size + 1), CASE WHEN p_size > 3 THEN range(p_size - 3, p_size + 3) ELSE [] END, range(48, 51), range(1, 3))) AS x FROM part)
SELECT p_partkey, count(DISTINCT x) AS n, string_agg(DISTINCT x::VARCHAR, ',' ORDER BY x) AS pages FROM s WHERE x BETWEEN 1 AND 50 GROUP BY p_partkey""".replace("string_agg(DISTINCT x::VARCHAR, ',' ORDER BY x)", "array_to_string(list_sort(list_distinct(list(x))), ',')"),
    "page_slice_text": f"""WITH {D.page_ranges_sql(10)}, c AS (SELECT r.book, start_phys, end_phys, string_agg('<!-- Page ' || phys || ' -->' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY phys) AS content
  FROM ranges r JOIN page p ON r.book = p.book AND phys BETWEEN start_phys AND end_phys GROUP BY ALL)
SELECT book, start_phys, end_phys, (end_phys - start_phys + 1)::BIGINT AS page_count, md5(content) AS content_md5, length(content)::BIGINT AS char_count FROM c""",
    "scan_detect": f"""WITH {D.PAGES} SELECT book, phys AS start_phys, 1::BIGINT AS page_count, length({_strip("coalesce(text, '')")})::BIGINT AS total_chars, length({_strip("coalesce(text, '')")}) < 30 AS is_scanned FROM page""",
    "chapter_concat": "SELECT book, md5(t) AS content_md5, length(t)::BIGINT AS char_count FROM (SELECT conv_id AS book, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)",
    "strip_tags": f"SELECT page_id, length({_tags('html')})::BIGINT AS n, md5({_tags('html')}) AS text_md5 FROM pages",
    "content_stats": f"SELECT doc_id, length(text)::BIGINT AS char_count, len({_lines('text')})::BIGINT AS line_count, 0::BIGINT AS image_count FROM documents",
    "first_lines": f"SELECT doc_id, array_to_string(({_filled('text')})[:3], chr(10)) AS first_lines FROM documents",
    "purge_nav": """SELECT page_id, length(h)::BIGINT AS n, md5(h) AS html_md5 FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<header\\b[^>]*>.*?</header>|<footer\\b[^>]*>.*?</footer>', '', 'g'),
  '(?is)<a\\b[^>]*>[\\s\\p{Z}]*(?:\\[top\\]|\\[next\\]|\\[previous\\]|\\[contents\\]|\\[back to top\\]|top|contents)[\\s\\p{Z}]*</a>', '', 'g'), '(?is)<a\\b[^>]*>[\\s\\p{Z}]*</a>', '', 'g') AS h FROM pages)""",
    "clean_ocr_text": f"WITH {D.RECOGNISED}, {_CLEAN} SELECT id, kind, length(t)::BIGINT AS n, md5(t) AS text_md5 FROM cleaned",
    "clean_code_ocr": f"WITH {D.RECOGNISED}, {_CLEAN} SELECT id, kind, length(c)::BIGINT AS n, md5(c) AS text_md5 FROM (SELECT id, kind, {_code('t')} AS c FROM cleaned)",
    "code_detect": f"WITH {D.RECOGNISED}, {_CLEAN} SELECT id, kind, {_IS_CODE} AS is_code, {_LANGUAGE} AS language FROM cleaned",
    "ocr_markdown": f"WITH {D.RECOGNISED}, {_CLEAN} {_OCR_MD}",
    "drift_window": f"""WITH {D.PAGES}, c AS (SELECT book, phys - 1 AS pos, ({_filled('text')})[1] AS title, phys + phys % 4 AS start_phys FROM page),
m AS (SELECT c.book, c.pos, arg_min(p.phys, abs(p.phys - start_phys) * 10 + p.phys - start_phys) AS found_phys FROM c JOIN page p ON p.book = c.book AND p.phys BETWEEN start_phys - 2 AND start_phys + 2
  WHERE contains(array_to_string(({_filled('text')})[:5], chr(10)), title) GROUP BY ALL)
SELECT c.*, found_phys FROM c LEFT JOIN m ON c.book = m.book AND c.pos = m.pos WHERE title IS NOT NULL""",
    "extract_envelope": f"""WITH {_SPINE_TITLES}, m AS ({_find('toc', ['the', 'de', 'la'])}), x AS (SELECT m.book, query, m.title, index, {_tags('html')} AS content FROM m JOIN toc ON m.book = toc.book AND m.pos = toc.pos)
SELECT book, query, true AS success, title, index, md5(content) AS content_md5, length(content)::BIGINT AS char_count, len({_lines('content')})::BIGINT AS line_count, 0::BIGINT AS image_count FROM x""",
    "format_dispatch": f"""WITH f AS (SELECT page_id, regexp_extract(url, '([^/?#]*)/?(?:[?#].*)?$', 1) || {_pick(['.epub', '.MOBI', '.azw3', '.prc', '.pdf', '', '.azw', '.tar.epub'], 'page_id')} AS path FROM pages),
g AS (SELECT *, CASE WHEN contains(ltrim(path, '.'), '.') AND NOT starts_with(reverse(path), '.') OR contains(ltrim(path, '.'), '.') THEN '.' || lower(reverse(split_part(reverse(path), '.', 1))) ELSE '' END AS ext FROM f)
SELECT page_id, path, ext, CASE WHEN ext = '.epub' THEN 'EPUB' WHEN ext IN ('.mobi', '.azw', '.azw3', '.prc') THEN 'MOBI' ELSE 'PDF' END AS format FROM g""",
    "resolve_link": """WITH f AS (SELECT page_id, page_id % 5 AS k, regexp_extract(html, '<a href="([^"]*)"', 1) AS link FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'OEBPS/x' || link WHEN 1 THEN 'OEBPS/Text' || link WHEN 2 THEN '../up' || link WHEN 3 THEN 'OEBPS/Text/a b' || link ELSE 'OEBPS/Text/100%' || link END AS entry, 'top' AS anchor FROM f""",
    "image_names": f"""WITH f AS (SELECT *, {_pick(_EXTS, 'p_partkey')} AS ext FROM part)
SELECT p_partkey, ext, CASE WHEN p_size > 25 THEN p_name ELSE '插图 ' || p_size END AS alt, format('ch{{:03d}}_img{{:03d}}{{}}', p_size, p_partkey, ext) AS name, format('page_{{:04d}}.png', p_partkey) AS page_name FROM f""",
    "code_language": f"SELECT p_partkey, coalesce(nullif({_pick(_BY_CLASS, 'p_partkey')}, ''), {_pick(_BY_CODE, 'p_partkey')}) AS language FROM part",
    "source_priority": "SELECT user_id, props AS value, event_type AS origin FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, event_id) AS rn FROM events) WHERE rn = 1",
    "image_enumeration": """SELECT book, image, recindex, data FROM (SELECT p_brand AS book, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INT AS image, p_size AS recindex FROM part) JOIN (SELECT s_suppkey + 2 AS record, s_name AS data FROM supplier) ON record = recindex + 1""",
}
