"""EPUB books: entries of the ZIP file, package document, and tables of contents from NAV, NCX or spine."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from dataclasses import dataclass, field
from urllib.parse import unquote
from xml.etree import ElementTree

from ..functions.html import Node, parse

METADATA = {"title": "title", "creator": "author", "language": "language", "identifier": "identifier", "publisher": "publisher"}
NCX_TYPE = "application/x-dtbncx+xml"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _named(e: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [c for c in e if _local(c.tag) == name]


class Archive:
    """Entries by name; a name that differs in separators, a leading slash or case finds its entry too."""

    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = self.zip.namelist()
        self.any_case = {n.lower(): n for n in reversed(self.names)}

    def read(self, name: str) -> bytes:
        name = name.replace("\\", "/").lstrip("/")
        if name not in self.names:
            name = self.any_case.get(name.lower(), name)
        return self.zip.read(name)

    def text(self, name: str) -> str:
        return self.read(name).decode("utf-8", "replace")


def join(base_file: str, href: str) -> tuple[str, str | None]:
    """(entry, anchor) that href, already unquoted, names in base_file."""
    path, _, anchor = href.partition("#")
    folder = posixpath.dirname(base_file)
    return posixpath.normpath(f"{folder}/{path}" if folder else path).replace("\\", "/"), anchor or None


@dataclass
class Package:
    """A package document: metadata, manifest items by id, in order, and the spine's ids."""

    path: str
    metadata: dict[str, str] = field(default_factory=dict)
    manifest: dict[str, dict[str, str]] = field(default_factory=dict)
    spine: list[str] = field(default_factory=list)
    ncx_id: str | None = None


def package(archive: Archive) -> Package:
    container = ElementTree.fromstring(archive.text("META-INF/container.xml"))
    path = next((e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile" and e.get("full-path")), None)
    if not path:
        raise ValueError("container names no package document")
    out = Package(path)
    for part in ElementTree.fromstring(archive.text(path)):
        kind = _local(part.tag)
        if kind == "metadata":
            for m in part:
                if _local(m.tag) in METADATA:  # of repeated elements the last counts
                    out.metadata[METADATA[_local(m.tag)]] = (m.text or "").strip()
        elif kind == "manifest":
            for item in part:
                if item.get("id") and item.get("href"):
                    href = unquote(item.get("href"))
                    out.manifest[item.get("id")] = {"href": href, "entry": join(path, href.replace("#", "%23"))[0].replace("%23", "#"), "type": item.get("media-type") or "", "properties": item.get("properties") or ""}
        elif kind == "spine":
            out.ncx_id = part.get("toc")
            out.spine = [i.get("idref") for i in part if i.get("idref")]
    return out


def _entry(title: str, level: int, src: str, base: str) -> dict:
    path, anchor = join(base, src)
    return {"title": title, "level": level, "src": src, "file_path": path, "anchor": anchor}


def nav_toc(html: str, base: str) -> list[dict]:
    """Links of the first list of the navigation marked as contents, else of the first navigation."""
    navs = parse(html).all("nav")
    nav = next((n for n in navs if n.get("epub:type") == "toc"), navs[0] if navs else None)
    top = nav.first("ol") if nav else None
    out: list[dict] = []

    def walk(ol: Node, level: int) -> None:
        for li in ol.children:
            if isinstance(li, Node) and li.tag == "li":
                kids = [c for c in li.children if isinstance(c, Node)]
                link = next((c for c in kids if c.tag == "a"), None)
                if link is not None and link.get("href"):
                    out.append(_entry(link.text().strip(), level, unquote(link.get("href").strip()), base))
                inner = next((c for c in kids if c.tag == "ol"), None)
                if inner is not None:
                    walk(inner, level + 1)

    if top is not None:
        walk(top, 1)
    return out


def ncx_toc(xml: str, base: str) -> list[dict]:
    """Navigation points in pre-order; those without a title or a target are left out, their children are not."""
    out: list[dict] = []

    def walk(point: ElementTree.Element, level: int) -> None:
        labels = [t.text.strip() for l in _named(point, "navlabel") for t in _named(l, "text")[:1] if t.text]
        sources = [c.get("src") for c in _named(point, "content") if c.get("src")]
        if labels and labels[0] and sources:
            out.append(_entry(labels[0], level, unquote(sources[0]), base))
        for p in _named(point, "navpoint"):
            walk(p, level + 1)

    for nav_map in _named(ElementTree.fromstring(xml), "navmap")[:1]:
        for p in _named(nav_map, "navpoint"):
            walk(p, 1)
    return out


def spine_title(html: str, fallback: str) -> str:
    """As plans.native.spine_titles: of <title>, else of the first <h1> or <h2>."""
    for pattern in (r"(?is)<title[^>]*>(.*?)</title>", r"(?is)<h[1-2][^>]*>(.*?)</h[1-2]>"):
        m = re.search(pattern, html)
        if m and m[1].strip():
            return re.sub("<[^>]+>", "", m[1]).strip() or fallback
    return fallback


def spine_toc(archive: Archive, p: Package) -> list[dict]:
    out = []
    for idref in p.spine:
        item = p.manifest.get(idref)
        if item:
            try:
                title = spine_title(archive.text(item["entry"]), idref)
            except KeyError:
                title = idref
            out.append({"title": title, "level": 1, "src": item["href"], "file_path": item["entry"], "anchor": None})
    return out


def contents(archive: Archive, p: Package) -> tuple[str, list[dict]]:
    """(source, entries) of the first of NAV, NCX and spine that has entries; one that cannot be read has none."""
    nav = next((i["entry"] for i in p.manifest.values() if "nav" in i["properties"].split()), None)
    ncx = p.manifest.get(p.ncx_id or "") or next((i for i in p.manifest.values() if i["type"] == NCX_TYPE or i["href"].lower().endswith(".ncx")), None)
    for source, entry, read in (("NAV", nav, nav_toc), ("NCX", ncx and ncx["entry"], ncx_toc)):
        if entry:
            try:
                found = read(archive.text(entry), entry)
            except (KeyError, ElementTree.ParseError):
                found = []
            if found:
                return source, found
    return "Spine", spine_toc(archive, p)


def build(title: str, author: str, chapters: list[tuple[str, str]], toc: str = "ncx", others: dict[str, bytes] | None = None, language: str = "en") -> bytes:
    """An EPUB of (title, XHTML) chapters with an NCX ('ncx'), a NAV ('nav') or no table of contents ('spine')."""
    from html import escape

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        files = [f"Text/ch{i}.xhtml" for i in range(1, len(chapters) + 1)]
        items = "".join(f'<item id="ch{i}" href="{f}" media-type="application/xhtml+xml"/>' for i, f in enumerate(files, 1))
        items += {"ncx": f'<item id="ncx" href="toc.ncx" media-type="{NCX_TYPE}"/>', "nav": '<item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>'}.get(toc, "")
        refs = "".join(f'<itemref idref="ch{i}"/>' for i in range(1, len(files) + 1))
        z.writestr("OEBPS/content.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator><dc:language>{language}</dc:language></metadata><manifest>{items}</manifest><spine{" toc=" + chr(34) + "ncx" + chr(34) if toc == "ncx" else ""}>{refs}</spine></package>')
        if toc == "ncx":
            points = "".join(f'<navPoint><navLabel><text>{escape(t)}</text></navLabel><content src="{f}"/></navPoint>' for (t, _), f in zip(chapters, files))
            z.writestr("OEBPS/toc.ncx", f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{points}</navMap></ncx>')
        elif toc == "nav":
            links = "".join(f'<li><a href="{f}">{escape(t)}</a></li>' for (t, _), f in zip(chapters, files))
            z.writestr("OEBPS/nav.xhtml", f'<html><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>')
        for (_, body), f in zip(chapters, files):
            z.writestr(f"OEBPS/{f}", body)
        for name, data in (others or {}).items():
            z.writestr(name, data)
    return out.getvalue()
