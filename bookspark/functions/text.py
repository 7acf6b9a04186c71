"""Native text functions, Column to Column.  All follow Unicode rules for white space, digits and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators that Java's class leaves out.
SPACE = r"[\s\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


#: Every character of SPACE.
SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space at both ends, of which only the ends are looked at."""
    return F.btrim(c, F.lit(SPACES))


def lines(c: Column) -> Column:
    """Lines without their breaks; a final break starts no further line, and an empty text has none."""
    parts = F.split(c, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(c: Column) -> Column:
    parts = F.split(c, LINE_BREAK)
    return (F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)).cast("long")


def filled_lines(c: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(lines(c), strip), lambda l: l != "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def squash(c: Column) -> Column:
    """Lower case without white space and the marks that separate numbers from titles."""
    return F.regexp_replace(F.lower(c), rf"(?U)(?:{SPACE}|[-_.:：·])+", "")


def quote(s: str) -> str:
    """A Java pattern that matches s itself."""
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def hits(text: Column, pattern: str, after: int = 0) -> Column:
    """Array of struct(before, hit, after): each match, the length of what lies between it and the last one, and up to
    `after` characters that follow it.  The pattern's groups are read from `hit` later; offsets are running sums."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("long"))
    columns = [F.slice(gaps, 1, F.size(found)).alias("before"), found.alias("hit")]
    if after:
        groups = _groups(pattern)
        columns.append(F.regexp_extract_all(text, F.lit(f"{pattern}(?=((?s:.{{0,{after}}})))"), F.lit(groups + 1)).alias("after"))
    return F.arrays_zip(*columns)


def _groups(pattern: str) -> int:
    import re

    return len(re.findall(r"(?<!\\)\((?!\?)", pattern))


# --- code ---------------------------------------------------------------------------------------------------------

# What class names say of a code block's language, in order; a word must stand alone, a part need not.
CLASS_RULES = (
    ("cpp", ("cpp", "c++"), ()),
    ("go", ("golang",), ("go",)),
    ("python", ("python",), ("py",)),
    ("java", (), ("java",)),
    ("rust", (), ("rust", "rs")),
    ("javascript", ("javascript", "typescript"), ("js", "ts")),
    ("bash", ("bash", "shell"), ("sh",)),
    ("sql", (), ("sql",)),
    ("html", (), ("html", "xml")),
    ("c", (), ("c",)),
)
# What the code says, in order: any of the first, and any of the second where there is one.
CODE_RULES = (
    ("cpp", ("#include", "std::", "cout <<"), ()),
    ("go", ("package ",), ("func ", "import (", ":=")),
    ("python", ("def ",), (":", "import ", "print(")),
    ("c", ("printf(", "int main(", "char *"), ()),
)


def bind(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def code_language(classes: Column, code: Column) -> Column:
    """Language of a code block by its class names, else by its text, else ''."""
    low = F.lower(classes)
    words = F.split(low, rf"(?U){SPACE}+")
    out = F.when(F.lit(False), "")
    for lang, parts, whole in CLASS_RULES:
        out = out.when(_any([low.contains(p) for p in parts] + [F.array_contains(words, w) for w in whole]), lang)
    for lang, first, second in CODE_RULES:
        test = _any(code.contains(p) for p in first)
        out = out.when(test & _any(code.contains(p) for p in second) if second else test, lang)
    return out.otherwise("")


# --- recognised text ----------------------------------------------------------------------------------------------

# Characters that recognised text is rid of, and its rewrites, in order.
JUNK = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ufeff\u200b\ufffd]"
REWRITES = (
    (r"/\s+/", "//"), (r"/\s+\*", "/*"), (r"\*\s+/", "*/"), (r":\s*=", ":="), (r"-\s+>", "->"), (r"=\s+=", "=="),
    (r"!=\s*", "!="), (r"<=\s*", "<="), (r">=\s*", ">="), (r"<\s+<", "<<"), (r">\s+>", ">>"),
)
# Full-width characters and what they become in code; directives whose spacing is mended.
FULL_WIDTH, HALF_WIDTH = "（）【】｛｝；：，。“”‘’！？＝＋－", "()[]{};:,.\"\"''!?=+-"
DIRECTIVES = ("define", "ifndef", "ifdef", "endif")
# Patterns of which one makes text code, and languages by patterns, in order.
CODE_MARKS = (
    r"#\s*include", r"\bdef\s+\w+\s*\(", r"\bclass\s+\w+", r"\bint\s+main\s*\(", r"\bpublic\s+static\s+void\b", r"\bnamespace\s+\w+",
    r"\bcout\s*<<", r"\bcin\s*>>", r"\breturn\s+[0-9a-zA-Z_\"]+;", r"[{};]\s*$", r"//.*", r"/\*.*\*/",
)
OCR_LANGUAGES = (
    ("cpp", r"#\s*include|cout\s*<<|namespace\s+std|int\s+main"),
    ("python", r"def\s+\w+\s*\(|import\s+\w+|from\s+\w+\s+import"),
    ("java", r"public\s+class|System\.out\.println"),
    ("javascript", r"function\s+\w+|const\s+\w+\s*=|let\s+\w+\s*="),
)


def clean_ocr(c: Column) -> Column:
    """Recognised text without control characters, its lines stripped and split operators joined; null: ''."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), JUNK, "")

    def mend(line: Column) -> Column:
        out = line
        for pattern, to in REWRITES:
            out = F.regexp_replace(out, "(?dU)" + pattern, to)
        return F.when(line.rlike("[/*:=<>-]"), out).otherwise(line)  # every rewrite needs one of these

    return strip(F.array_join(F.transform(F.transform(lines(text), strip), mend), "\n"))


def clean_code(c: Column) -> Column:
    """clean_ocr, then half-width punctuation and mended preprocessor directives."""
    text = F.translate(clean_ocr(c), FULL_WIDTH, HALF_WIDTH)
    text = F.regexp_replace(text, r"(?U)#\s*include\s*<([^>]+)>", "#include <$1>")
    text = F.regexp_replace(text, r'(?U)#\s*include\s*"([^"]+)"', '#include "$1"')
    for d in DIRECTIVES:
        text = F.regexp_replace(text, rf"(?U)#\s*{d}", f"#{d}")
    return text


def is_code(cleaned: Column) -> Column:
    marked = _any(cleaned.rlike("(?mdU)" + p) for p in CODE_MARKS)
    return marked | (F.regexp_count(cleaned, F.lit(";")) >= 2) | cleaned.contains("{")


def ocr_language(cleaned: Column, code: Column | None = None) -> Column:
    """Language by the text; code says whether it is code at all, where that is known."""
    out = F.when(F.lit(False), "")
    for lang, pattern in OCR_LANGUAGES:
        out = out.when(cleaned.rlike("(?dU)" + pattern), lang)
    return out.when(is_code(cleaned) if code is None else code, "c").otherwise("")


def ocr_markdown(raw: Column, alt: Column, path: Column) -> Column:
    """A Markdown block for an image's recognised text: fenced code, or a quote; without text a link or a note.

    path may be null or '': the image was not saved.
    """
    saved, name = F.coalesce(path, F.lit("")) != "", F.coalesce(alt, F.lit("插图"))
    empty = F.when(saved, F.concat(F.lit("\n!["), name, F.lit("]("), path, F.lit(")\n"))).otherwise(F.concat(F.lit("\n> *[插图: "), name, F.lit("]*\n")))
    head = F.concat(F.lit("🖼️ **[插图: "), name, F.lit("]**"), F.when(saved, F.concat(F.lit(" *(高清原图路径: `"), path, F.lit("`)*"))).otherwise(""))

    def fenced(cleaned: Column) -> Column:
        return bind(clean_code(cleaned), lambda code: F.when(code.startswith("```"), code).otherwise(F.concat(F.lit("```"), ocr_language(cleaned, F.lit(True)), F.lit("\n"), code, F.lit("\n```"))))

    def quoted(cleaned: Column) -> Column:
        return F.array_join(F.transform(lines(cleaned), lambda l: F.when(strip(l) == "", ">").otherwise(F.concat(F.lit("> "), l))), "\n")

    def block(cleaned: Column) -> Column:
        body = F.when(is_code(cleaned), fenced(cleaned)).otherwise(quoted(cleaned))
        return F.when(cleaned == "", empty).otherwise(F.concat(F.lit("\n"), head, F.lit("\n"), body, F.lit("\n")))

    return bind(clean_ocr(raw), block)


def image_alt(alt: Column, number: Column, file_name_only: bool = False) -> Column:
    """An image's caption: its stripped alt text, of which a MOBI book keeps only the last path part; else 插图 n."""
    text = strip(F.coalesce(alt, F.lit("")))
    if file_name_only:
        text = F.element_at(F.split(F.translate(text, "\\", "/"), "/"), -1)
    return F.when(text == "", F.concat(F.lit("插图 "), number.cast("string"))).otherwise(text)


# --- flat markup --------------------------------------------------------------------------------------------------


def ended_references(html: Column) -> Column:
    """Markup in which every & that begins no reference with its semicolon stands as text, as XML and Markdown read it.

    HTML also reads some names without one, so a title cut off in `&amp;` would end in & there.
    """
    return F.regexp_replace(html, "&(?!(?:[0-9A-Za-z]+|#[0-9]+|#[xX][0-9A-Fa-f]+);)", "&amp;")


# Texts of links that only lead elsewhere.
JUMPS = ("[top]", "[next]", "[previous]", "[contents]", "[back to top]", "top", "contents")


def purge_flat(html: Column) -> Column:
    """Markup without headers, footers, tables of contents and jump links, for markup where these do not nest.

    Trees with nesting go through functions.html; this is the native form for flat pages.
    """
    text = F.regexp_replace(html, r"(?is)<(header|footer)\b[^>]*>.*?</\1>", "")
    text = F.regexp_replace(text, r"""(?is)<nav\b(?=[^>]*(?:epub:type=["'][^"']*toc|class=["'][^"']*(?:nav|pagination)))[^>]*>.*?</nav>""", "")
    jumps = "|".join(quote(j) for j in JUMPS)
    text = F.regexp_replace(text, rf"(?isU)<a\b[^>]*>\s*(?:{jumps})\s*</a>", "")
    return F.regexp_replace(text, r"(?isU)<a\b[^>]*>\s*</a>", "")
