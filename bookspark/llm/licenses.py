"""License scans: exact set-similarity join of license templates with blocks of document words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Template:
    """A license text.  phrase: its words count only where they stand consecutively; else its words as a set."""

    label: str
    text: str
    phrase: bool = False

    @property
    def words(self) -> list[bytes]:
        return common.words_of(self.text.encode())


# The phrases that give base labels, and public license notices that give further labels.
TEMPLATES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
    Template("agpl", "affero general public license", True),
    Template("lgpl", "lesser general public license", True),
    Template("mpl", "mozilla public license", True),
    Template("epl", "eclipse public license", True),
    Template("boost", "boost software license", True),
    Template("ofl", "open font license", True),
    Template("cc", "creative commons attribution", True),
    Template("cc0", "cc0 1 0 universal", True),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    Template("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("cc", "This work is licensed under a Creative Commons Attribution International License"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    Template(
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "This notice may not be removed or altered from any source distribution",
    ),
    Template(
        "boost",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, "
        "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ),
)
#: Labels whose phrases are base phrases.
BASE = ("mit", "apache", "gpl")


class Join:
    """The join's template side: prefix index over templates whose tokens are in ascending order of corpus frequency."""

    def __init__(self, templates: Iterable[Template], frequency: dict[bytes, int], threshold: float) -> None:
        self.templates = list(templates)
        vocabulary = {w for t in self.templates for w in t.words}
        self.rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
        self.sets, self.needs, self.size = [], [], []
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.templates):
            tokens = sorted(set(t.words), key=self.rank.__getitem__)
            need = len(tokens) if t.phrase else math.ceil(threshold * len(tokens) - 1e-9)
            self.sets.append(frozenset(tokens))
            self.needs.append(need)
            self.size.append(len(t.words))
            for i, w in enumerate(tokens[: len(tokens) - need + 1]):
                self.prefix.setdefault(w, []).append((k, i))

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, int, float]]:
        """(template, block's first word, its end, containment) of every block that meets a template's threshold.

        A template of n words has blocks of 2 n words at every multiple of n, so a place of up to n + 1 words is whole
        in one.  Only blocks with a prefix token are candidates: a block without any can't reach the threshold.
        """
        prefix, rank, seen = self.prefix, self.rank, set()
        for at in [i for i, w in enumerate(words) if w in prefix]:
            for k, i in prefix[words[at]]:
                n, need, total = self.size[k], self.needs[k], len(self.sets[k])
                for b in (at // n - 1, at // n):
                    if b < 0 or (k, b) in seen:
                        continue
                    seen.add((k, b))
                    block = words[b * n : (b + 2) * n]
                    if len(block) < need:  # length filter
                        continue
                    known = {w for w in block if w in rank}
                    here = min((rank[w], w) for w in known if any(x == k for x, _ in prefix.get(w, ())))
                    first = next(j for x, j in prefix[here[1]] if x == k)
                    rest = sum(rank[w] > here[0] for w in known)
                    if 1 + min(total - first - 1, rest) < need:  # positional filter
                        continue
                    overlap = len(self.sets[k] & known)
                    if overlap >= need:
                        yield k, b * n, b * n + len(block), overlap / total


def scan_words(words: list[bytes], join: Join) -> tuple[list[tuple[str, int, int, float]], list[tuple[str, int]]]:
    """(label, start, end, containment) of matching blocks, and (label, first word) of all places of phrases."""
    blocks, places = [], set()
    for k, start, end, score in join.matches(words):
        t = join.templates[k]
        if t.phrase:
            phrase = t.words
            n = len(phrase)
            found = [i for i in range(start, end - n + 1) if words[i : i + n] == phrase]
            if not found:
                continue
            places.update((t.label, i) for i in found)
        blocks.append((t.label, start, end, score))
    return blocks, sorted(places, key=lambda p: (p[1], p[0]))


def token_frequency(docs: DataFrame, templates: Iterable[Template], text: str = "text") -> dict[bytes, int]:
    """Documents of the whole corpus that hold each template token; its size is bounded by the templates."""
    vocabulary = frozenset(w for t in templates for w in t.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(0):
                c.update(vocabulary.intersection(common.words_of(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["token", "n"])

    found = docs.select(common.bytes_col(text).alias("body")).mapInArrow(count, "token binary, n long")
    return {bytes(r["token"]): r["n"] for r in found.groupBy("token").agg(F.sum("n").alias("n")).collect()}


_BLOCKS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
_PLACES = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))


def scan_licenses(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, threshold: float = 0.8, into: str = "licenses") -> DataFrame:
    """docs with a column `into`: struct(n_words, blocks, places).

    An exact containment join of templates with all blocks of all documents: tokens are ordered by the number of
    documents that hold them, counted over the whole corpus; rare-first prefixes, block lengths and positions rule out
    pairs that can't reach the threshold; the rest are verified on the sets.  blocks: those that hold at least
    `threshold` of a template's distinct words (label, first word, end, containment).  A phrase template needs all of
    its words, and then counts only if they stand consecutively in the block; places has every such place.

    Templates are a bounded list given by the caller; documents are never shuffled.  Null or empty text: no words and
    no matches.  Empty table: no rows.  All columns stay; one already named as `into` is replaced.
    """
    join = Join(templates, token_frequency(docs, templates, text), threshold)

    @F.arrow_udf("n_words long, blocks array<struct<label:string,start:long,end:long,score:double>>, places array<struct<label:string,word:long>>")
    def scan(texts: pa.Array) -> pa.Array:
        n, blocks, places = [], [], []
        for t in texts:
            words = common.words_of(t.as_py())
            b, p = scan_words(words, join)
            n.append(len(words))
            blocks.append([{"label": x, "start": s, "end": e, "score": c} for x, s, e, c in b])
            places.append([{"label": x, "word": i} for x, i in p])
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(blocks, _BLOCKS), pa.array(places, _PLACES)], ["n_words", "blocks", "places"])

    return docs.withColumn(into, scan(common.bytes_col(text)))
