"""Chapter markup to Markdown: a forgiving tree, its cleaning, formulas, code blocks and the conversion.

A tree lives within one call; Spark sees strings only.  The Arrow wrappers at the end take whole batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .text import CLASS_RULES, CODE_RULES, JUMPS

VOID = frozenset("area base br col embed hr img input link meta param source track wbr mbp:pagebreak".split())
#: Elements that start a block of their own.
BLOCKS = frozenset("address article aside blockquote body center chapter dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: What an opening tag closes, and the elements that such closing does not reach across.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
FENCES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}}
HIDDEN = frozenset({"script", "style", "head", "title", "template"})


class Node:
    """An element; children are nodes and strings.  raw: text that stands in the Markdown as it is."""

    __slots__ = ("tag", "attrs", "children", "parent", "raw")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None, raw: str | None = None) -> None:
        self.tag, self.attrs, self.parent, self.raw = tag, attrs or {}, parent, raw
        self.children: list[Node | str] = []

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    @property
    def classes(self) -> list[str]:
        return self.get("class").split()

    def walk(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.raw is not None:
                out.append(n.raw)
            else:
                stack += reversed(n.children)
        return "".join(out)

    def within(self, *tags: str) -> bool:
        n = self.parent
        while n is not None:
            if n.tag in tags:
                return True
            n = n.parent
        return False

    def replace(self, other: Node | None) -> None:
        """Puts other in this node's place, or nothing."""
        if self.parent is None:
            return
        at = next(i for i, c in enumerate(self.parent.children) if c is self)
        self.parent.children[at : at + 1] = [] if other is None else [other]
        if other is not None:
            other.parent = self.parent
        self.parent = None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS and tag != "body" and tag != "html":
            self._close_open({"p"}, {"table", "td", "th", "li", "div", "section", "article", "blockquote", "button"})
        if tag in CLOSES:
            self._close_open(CLOSES[tag], FENCES[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)

    def _close_open(self, tags: set[str], fences: set[str]) -> None:
        """Closes the outermost open element of tags this side of a fence."""
        n, found = self.at, None
        while n is not self.root and n.tag not in fences:
            if n.tag in tags:
                found = n
            n = n.parent
        if found is not None:
            self.at = found.parent

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def unknown_decl(self, data: str) -> None:  # <![CDATA[...]]>
        if data.startswith("CDATA["):
            self.at.children.append(data[6:])


def parse(html: str) -> Node:
    """A tree of any markup: unclosed elements are closed where the next one implies it, stray end tags are ignored."""
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


# --- cleaning -------------------------------------------------------------------------------------------------------


def purge(root: Node) -> None:
    """Drops headers, footers, navigation that says what it is, jump links, and links without text or image."""
    for n in root.all("nav", "header", "footer"):
        names = " ".join(n.classes)
        if n.tag != "nav" or "toc" in n.get("epub:type") or "nav" in names or "pagination" in names:
            n.replace(None)
    for a in root.all("a"):
        label = a.text().strip().lower()
        if label in JUMPS or (not label and a.first("img", "image") is None):
            a.replace(None)


def section(html: str, anchor: str | None) -> Node:
    """The element that the anchor names, if it is a container; else the whole file."""
    root = parse(html)
    if anchor:
        by = [n for n in root.walk() if n.get("id") == anchor] or [n for n in root.walk() if n.get("name") == anchor]
        if by and by[0].tag in ("section", "div", "article", "chapter"):
            whole = Node("#root")
            whole.children = [by[0]]
            by[0].parent = whole
            return whole
    return root


# --- formulas -------------------------------------------------------------------------------------------------------

# LaTeX of letters and operators, and operators that get spaces.
GREEK = {"α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "θ": r"\theta", "λ": r"\lambda", "μ": r"\mu", "π": r"\pi", "σ": r"\sigma", "ω": r"\omega", "Δ": r"\Delta", "Σ": r"\Sigma", "Ω": r"\Omega"}
OPERATORS = {
    "≤": r"\le ", "≥": r"\ge ", "≠": r"\ne ", "±": r"\pm ", "×": r"\times ", "÷": r"\div ", "∈": r"\in ", "∉": r"\notin ",
    "⊂": r"\subset ", "∪": r"\cup ", "∩": r"\cap ", "→": r"\to ", "∞": r"\infty ", "∑": r"\sum ", "∏": r"\prod ", "∫": r"\int ",
}
SPACED = "+-=<>"
#: Elements of a fixed number of parts: the number, and how the parts' LaTeX is put together.
_SCHEMATA: dict[str, tuple[int, Callable[..., str]]] = {
    "msup": (2, lambda base, top: f"{base}^{{{top}}}"),
    "msub": (2, lambda base, low: f"{base}_{{{low}}}"),
    "msubsup": (3, lambda base, low, top: f"{base}_{{{low}}}^{{{top}}}"),
    "mfrac": (2, lambda over, under: f"\\frac{{{over}}}{{{under}}}"),
    "mroot": (2, lambda base, degree: f"\\sqrt[{degree}]{{{base}}}"),
}


def latex(node: Node | str) -> str:
    """LaTeX of a MathML element; one with too few parts, or of an unknown kind, is its parts' LaTeX in a row."""
    if isinstance(node, str):
        return node.strip()
    tag = node.tag.rpartition(":")[2].lower()
    token = node.text().strip()
    if tag in ("mi", "mn"):
        return GREEK.get(token, token)
    if tag == "mo":
        return OPERATORS.get(token) or (f" {token} " if token and token in SPACED and len(token) == 1 else token)
    if tag == "mtext":
        return f"\\text{{{token}}}"
    parts = [latex(c) for c in node.children if isinstance(c, Node) or c.strip()]
    if tag in _SCHEMATA and len(parts) >= _SCHEMATA[tag][0]:
        n, form = _SCHEMATA[tag]
        return form(*parts[:n])
    row = "".join(parts)
    if tag == "msqrt":
        return f"\\sqrt{{{row}}}"
    if tag == "mfenced":
        return node.get("open", "(") + row + node.get("close", ")")
    if tag == "math":
        shown = node.get("display") == "block" or node.get("mode") == "display"
        return f"\n$$\n{row.strip()}\n$$\n" if shown else f"${row.strip()}$"
    return row


def formulas(root: Node) -> None:
    """Puts LaTeX in the place of every formula."""
    for n in [n for n in root.walk() if n.tag.rpartition(":")[2] == "math"]:
        n.replace(Node("#raw", raw=latex(n)))


# --- code -----------------------------------------------------------------------------------------------------------

# What names a code container by class or style, a monospaced font, and what makes a single line code.
CODE_CLASSES = ("code", "program", "listing", "syntax", "snippet", "monospace")
CODE_STYLES = ("monospace", "courier", "consolas", "menlo")
CODE_FACES = ("monospace", "courier", "consolas")
CODE_SIGNS = (";", "{", "}", "()", "def ", "func ", "int ", "#include")
TELETYPE_CHARS = 80


def code_language(classes: Iterable[str], code: str) -> str:
    """As text.code_language."""
    names = " ".join(classes).lower()
    words = names.split()
    for lang, parts, whole in CLASS_RULES:
        if any(p in names for p in parts) or any(w in words for w in whole):
            return lang
    for lang, first, second in CODE_RULES:
        if any(p in code for p in first) and (not second or any(p in code for p in second)):
            return lang
    return ""


def _fence(node: Node, classes: list[str], code: str) -> None:
    node.replace(Node("#fence", raw=f"```{code_language(classes, code)}\n{code.strip()}\n```"))


def fence_code(root: Node) -> None:
    """Puts fenced blocks in the place of <pre>, of containers styled as code, and of long or multi-line teletype.

    A container is left alone if something in it was fenced already: the code is not fenced twice.
    """
    for n in root.all("pre"):
        if n.parent is not None and not n.within("pre"):
            code = n.first("code")
            _fence(n, n.classes + (code.classes if code else []), n.text())
    for n in root.all("div", "p"):
        names, style = " ".join(n.classes).lower(), n.get("style").lower()
        if not any(k in names for k in CODE_CLASSES) and not any(k in style for k in CODE_STYLES):
            continue
        text = n.text()
        if _attached(n, root) and not n.within("pre") and n.first("#fence") is None and text.strip() and (len(text.splitlines()) >= 2 or any(k in text for k in CODE_SIGNS)):
            _fence(n, n.classes, text)
    for n in root.all("font", "tt"):
        text = n.text()
        mono = n.tag == "tt" or any(k in n.get("face").lower() for k in CODE_FACES)
        if mono and _attached(n, root) and n.first("#fence") is None and (len(text.splitlines()) >= 2 or len(text.strip()) > TELETYPE_CHARS):
            _fence(n, [], text)


def _attached(n: Node, root: Node) -> bool:
    while n.parent is not None:
        n = n.parent
    return n is root


# --- images ---------------------------------------------------------------------------------------------------------


def images(root: Node) -> list[tuple[int, Node, str, str]]:
    """(number from 1, element, address, alt text) of every image; those without an address are left out but counted."""
    out = []
    for i, n in enumerate(root.all("img", "image"), 1):
        src = n.get("src") or n.get("xlink:href")
        if src:
            out.append((i, n, src, n.get("alt").strip()))
    return out


def records(root: Node) -> list[tuple[int, Node, int, str]]:
    """(number from 1, element, record number, alt text) of images that name a record; others are counted only."""
    out = []
    for i, n in enumerate(root.all("img"), 1):
        rec = n.get("recindex").strip()
        if rec.isdigit():
            out.append((i, n, int(rec), n.get("alt").strip()))
    return out


# --- Markdown -------------------------------------------------------------------------------------------------------


def _inline(node: Node) -> str:
    """The Markdown of what stands in a line; white space is folded, except around raw parts."""
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(re.sub(r"\s+", " ", c))
        elif c.tag in HIDDEN:
            continue
        elif c.raw is not None:
            out.append(c.raw)
        elif c.tag == "br":
            out.append("  \n")
        elif c.tag in ("img", "image"):
            src = c.get("src") or c.get("xlink:href") or (f"recindex:{c.get('recindex')}" if c.get("recindex") else "")
            out.append(f"![{c.get('alt')}]({src})")
        else:
            text = _inline(c)
            bare = text.strip()
            if not bare:
                out.append(text)
            elif c.tag in ("b", "strong"):
                out.append(text.replace(bare, f"**{bare}**", 1))
            elif c.tag in ("i", "em"):
                out.append(text.replace(bare, f"*{bare}*", 1))
            elif c.tag in ("code", "tt", "kbd", "samp"):
                out.append(f"`{bare}`")
            elif c.tag == "a" and c.get("href"):
                out.append(f"[{bare}]({c.get('href')})")
            else:
                out.append(text)
    return "".join(out)


def _is_block(c: Node | str) -> bool:
    return isinstance(c, Node) and (c.tag in BLOCKS or c.tag == "#fence" or c.tag == "mbp:pagebreak" or c.raw is not None and "\n" in c.raw)


def _has_block(n: Node) -> bool:
    return any(_is_block(c) for c in n.walk())


def _table(node: Node) -> str:
    rows = [[re.sub(r"\s+", " ", _inline(cell)).strip().replace("|", "\\|") for cell in r.children if isinstance(cell, Node) and cell.tag in ("td", "th")] for r in node.all("tr")]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def _items(node: Node) -> str:
    out = []
    for k, li in enumerate([c for c in node.children if isinstance(c, Node) and c.tag == "li"], 1):
        mark = f"{k}. " if node.tag == "ol" else "- "
        body = ""
        for b in _blocks(li):
            body += b if not body else ("\n" if re.match(r"- |\d+\. ", b) else "\n\n") + b
        out.append(mark + re.sub(r"\n(?=[^\n])", "\n" + " " * len(mark), body))
    return "\n".join(out)


def _blocks(node: Node) -> list[str]:
    out: list[str] = []
    line = Node("#line")

    def flush() -> None:
        nonlocal line
        text = "\n".join(re.sub(r"^ +| +$", lambda m: m[0] if m[0] == "  " and m.end() == len(m.string) else "", l) for l in _inline(line).strip().split("\n"))
        if text:
            out.append(text)
        line = Node("#line")

    for c in node.children:
        if isinstance(c, Node) and c.tag in HIDDEN:
            continue
        if not _is_block(c) and not (isinstance(c, Node) and _has_block(c)):
            line.children.append(c)
            continue
        flush()
        if c.raw is not None:
            out.append(c.raw.strip("\n"))
        elif re.fullmatch("h[1-6]", c.tag):
            text = re.sub(r"\s+", " ", _inline(c)).strip()
            if text:
                out.append("#" * int(c.tag[1]) + " " + text)
        elif c.tag in ("hr", "mbp:pagebreak"):
            out.append("---")
        elif c.tag == "table":
            out.append(_table(c))
        elif c.tag in ("ul", "ol"):
            out.append(_items(c))
        elif c.tag == "blockquote":
            out.append("\n".join(f"> {l}".rstrip() for l in "\n\n".join(_blocks(c)).split("\n")))
        else:
            out += _blocks(c)
    flush()
    return [b for b in out if b]


def to_markdown(html: str, title: str | None = None, anchor: str | None = None, blocks: dict[int, str] | None = None, paths: dict[int, str] | None = None) -> str:
    """Markdown of a chapter: section, purge, formulas, code, images, conversion, title.

    blocks: Markdown in the place of the image with that number, such as its recognised text; paths: where the image
    was saved.  The title heads the chapter unless it begins with a heading of level 1.
    """
    root = section(html, anchor)
    purge(root)
    formulas(root)
    fence_code(root)
    for i, n in enumerate(root.all("img", "image"), 1):
        if blocks and i in blocks:
            n.replace(Node("#block", raw="\n" + blocks[i].strip("\n") + "\n"))
        elif paths and i in paths:
            n.attrs["xlink:href" if n.tag == "image" else "src"] = paths[i]
    md = "\n\n".join(_blocks(root)).strip()
    return f"# {title}\n\n{md}" if title and not md.startswith("# ") else md


@F.arrow_udf(ST.StringType())
def html_to_markdown(html: pa.Array, title: pa.Array, anchor: pa.Array) -> pa.Array:
    """to_markdown over a batch; null markup stays null."""
    return pa.array([None if h is None else to_markdown(h, t, a) for h, t, a in zip(html.to_pylist(), title.to_pylist(), anchor.to_pylist())], pa.string())


@F.arrow_udf(ST.StringType())
def markdown_with_images(html: pa.Array, title: pa.Array, anchor: pa.Array, blocks: pa.Array, paths: pa.Array) -> pa.Array:
    """to_markdown with maps from image numbers to blocks and to paths."""
    out = []
    for h, t, a, b, p in zip(*(x.to_pylist() for x in (html, title, anchor, blocks, paths))):
        out.append(None if h is None else to_markdown(h, t, a, dict(b or ()), dict(p or ())))
    return pa.array(out, pa.string())


@F.arrow_udf(ST.StringType())
def section_html(html: pa.Array, anchor: pa.Array) -> pa.Array:
    """Markup of the section that an anchor names."""
    return pa.array([None if h is None else (h if not a else serialise(section(h, a), h)) for h, a in zip(html.to_pylist(), anchor.to_pylist())], pa.string())


def serialise(root: Node, whole: str) -> str:
    """Markup of a one-element section; a section that is the whole file is given back as it was."""
    if len(root.children) != 1 or not isinstance(root.children[0], Node) or root.children[0].tag not in ("section", "div", "article", "chapter") or root.children[0].parent is not root:
        return whole
    from html import escape

    def write(n: Node | str) -> str:
        if isinstance(n, str):
            return escape(n, quote=False)
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in n.attrs.items())
        return f"<{n.tag}{attrs}/>" if n.tag in VOID else f"<{n.tag}{attrs}>{''.join(map(write, n.children))}</{n.tag}>"

    return write(root.children[0])


@F.arrow_udf(ST.StringType())
def mathml_to_latex(markup: pa.Array) -> pa.Array:
    """LaTeX of the formulas in markup, one after another."""
    out = []
    for m in markup.to_pylist():
        out.append(None if m is None else "".join(latex(c) for c in parse(m).children))
    return pa.array(out, pa.string())


IMAGES = ST.ArrayType(ST.StructType().add("image", "integer").add("src", "string").add("recindex", "integer").add("alt", "string"))


@F.arrow_udf(IMAGES)
def image_list(html: pa.Array) -> pa.Array:
    """The images of markup in order: number, address or record number, alt text."""
    out = []
    for h in html.to_pylist():
        root = parse(h or "")
        found = {i: {"image": i, "src": s, "recindex": None, "alt": a} for i, _, s, a in images(root)}
        found |= {i: {"image": i, "src": None, "recindex": r, "alt": a} for i, _, r, a in records(root)}
        out.append([found[i] for i in sorted(found)])
    return pa.array(out, pa.list_(pa.struct([("image", pa.int32()), ("src", pa.string()), ("recindex", pa.int32()), ("alt", pa.string())])))
