"""Native functions about files: formats by extension, images by their first bytes, paths, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of the formats; anything else is a PDF.
EXTENSIONS = {"EPUB": (".epub",), "MOBI": (".mobi", ".azw", ".azw3", ".prc")}
# First bytes of image files.
MAGIC = (
    (".jpg", (b"\xff\xd8\xff",)),
    (".png", (b"\x89PNG\r\n\x1a\n",)),
    (".gif", (b"GIF87a", b"GIF89a")),
    (".webp", ()),
    (".bmp", (b"BM",)),
    (".tif", (b"II*\x00", b"MM\x00*")),
    (".svg", ()),
)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, or '': leading dots of a name are not one's."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(F.regexp_replace(name, r"^\.+", ""), r".(\.[^.]*)$", 1))


def book_format(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(*EXTENSIONS["EPUB"]), "EPUB").when(ext.isin(*EXTENSIONS["MOBI"]), "MOBI").otherwise("PDF")


def image_extension(data: Column) -> Column:
    """An image file's extension by its first bytes; unknown, empty or null ones count as .png."""

    def begins(magic: bytes) -> Column:
        return F.substring(data, 1, len(magic)) == F.unhex(F.lit(magic.hex()))

    out = F.when(data.isNull(), ".png")
    for ext, magics in MAGIC:
        if ext == ".webp":
            test = begins(b"RIFF") & (F.substring(data, 9, 4) == F.unhex(F.lit(b"WEBP".hex())))
        elif ext == ".svg":  # within the first 100 bytes, at a byte boundary of its hexadecimal form
            test = F.hex(F.substring(data, 1, 100)).rlike("^(..)*" + b"<svg".hex().upper())
        else:
            test = F.lit(False)
            for m in magics:
                test = test | begins(m)
        out = out.when(test, ext)
    return out.otherwise(".png")


def unquoted(c: Column) -> Column:
    """Percent escapes decoded as UTF-8; a text with a malformed escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(c, r"\+", "%2B")), c)


def normal_path(c: Column) -> Column:
    """A relative path without '.', empty and resolvable '..' segments, with / between segments; nothing left: '.'."""
    parts = F.split(F.translate(c, "\\", "/"), "/")

    def step(kept: Column, part: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        pop = (part == "..") & last.isNotNull() & (last != "..")
        return F.when((part == "") | (part == "."), kept).when(pop, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(F.concat(kept, F.array(part)))

    out = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    root = F.when(c.startswith("/"), "/").otherwise("")
    return F.when((out == "") & (root == ""), ".").otherwise(F.concat(root, out))


def resolve(base_file: Column, href: Column) -> Column:
    """The entry that href, found in base_file, names: unquoted, without fragment, relative to base_file's folder."""
    folder = F.regexp_extract(base_file, r"^(.*)/[^/]*$", 1)
    path = F.split_part(unquoted(href), F.lit("#"), F.lit(1))
    return normal_path(F.when(folder == "", path).otherwise(F.concat(folder, F.lit("/"), path)))


def anchor(href: Column) -> Column:
    """The fragment of href, or null."""
    return F.nullif(F.regexp_extract(unquoted(href), r"(?s)#(.*)$", 1), F.lit(""))


def image_name(chapter: Column, image: Column, ext: Column) -> Column:
    return F.format_string("ch%03d_img%03d%s", chapter.cast("int"), image.cast("int"), ext)


def page_name(phys: Column) -> Column:
    return F.format_string("page_%04d.png", phys.cast("int"))
