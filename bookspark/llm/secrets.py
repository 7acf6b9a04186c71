"""Secret scans: an assignment-aware lexer that scores literals by the names they reach."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# The patterns of the base kinds and the least lengths they are kept at.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones need not be matched first
MIN_ASSIGN, MIN_ACCESS = 6, 20
#: Base kinds in the order that breaks ties of start, then the kind that the lexer adds.
KINDS = ("assign", "access", "hex", "literal")

# How sensitive a part of a target name is, and literals that only stand for a secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "auth": 0.7, "bearer": 0.8, "key": 0.65, "signature": 0.65, "salt": 0.65}
HEAD = 16  # longer than any of the fixed words
PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|\.+|none|null|true|false|changeme|example|placeholder|your[_-].*|<.*>|\$\{.*\}|\{\{.*\}\})$")

_TOKEN = re.compile(
    r"""(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<name>[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z_$][A-Za-z0-9_$]*)*)"""
    r"""|(?P<bare>[0-9][A-Za-z0-9+/_.=-]*)"""
    r"""|(?P<op>:=|=>|==|!=|<=|>=|[:=])|(?P<plus>\+)|(?P<end>[;,\n(){}\[\]])|(?P<space>[ \t]+)|(?P<other>.)""",
    re.ASCII,
)
_ASSIGNING = {":=", "=>", "=", ":"}
_PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")


def sensitivity(name: str) -> float:
    """0 to 1: of the most sensitive part, or two joined parts, of a name in snake, kebab, dotted or camel case."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *(a + b for a, b in zip(parts, parts[1:]))]), default=0.0)


def randomness(value: str) -> float:
    """0 to 1: entropy of a literal's characters against 4 bits, less for short or word-like literals."""
    return Value.of(value, 0, 0).randomness()


class Value:
    """What a name resolves to: the characters' shares of literals joined by +, and the literals themselves.

    A sum keeps references to its parts, not their text, so it takes the same room however often `x = x + x` doubles it; `head`
    and `tail` are enough of the text to tell placeholders.
    """

    __slots__ = ("head", "tail", "length", "shares", "parts", "span", "hit")

    def __init__(self, head: str, tail: str, length: float, shares: dict[str, float], parts: tuple[Value, ...], span: tuple[int, int] | None) -> None:
        self.head, self.tail, self.length, self.shares, self.parts, self.span, self.hit = head, tail, length, shares, parts, span, False

    @staticmethod
    def of(text: str, start: int, end: int) -> Value:
        return Value(text[:HEAD], text[-2:], len(text), {c: k / len(text) for c, k in Counter(text).items()}, (), (start, end))

    @staticmethod
    def sum(parts: list[Value]) -> Value:
        if len(parts) == 1:
            return parts[0]
        length = sum(p.length for p in parts)
        shares: dict[str, float] = {}
        for p in parts:
            for c, k in p.shares.items():
                shares[c] = shares.get(c, 0.0) + k * (p.length / length if length else 0.0)
        head = ""
        for p in parts:
            if len(head) == HEAD:
                break
            head = (head + p.head)[:HEAD]
        tail = ""
        for p in reversed(parts):
            if len(tail) == 2:
                break
            tail = (p.tail + tail)[-2:]
        return Value(head, tail, min(length, 1e300), shares, tuple(parts), None)

    def placeholder(self) -> bool:
        whole = self.head if self.length <= HEAD else f"{self.head}{self.tail}"
        return bool(PLACEHOLDER.match(whole)) and (self.length <= HEAD or self.head[0] in "<${yY" or len(self.shares) <= 2)

    def randomness(self) -> float:
        if self.length < 6 or self.placeholder():
            return 0.0
        bits = -sum(k * math.log2(k) for k in self.shares.values() if k > 0)
        chars = "".join(self.shares)
        classes = sum(bool(re.search(p, chars)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
        return min(1.0, bits / 4) * (0.4 if classes == 1 else 1.0) * (0.3 if " " in self.shares else 1.0)

    def spans(self) -> Iterator[tuple[int, int]]:
        """Spans of the literals in it that no earlier call on this value, or one that it is part of, has given."""
        left = [self]
        while left:
            v = left.pop()
            if not v.hit:
                v.hit = True
                if v.span:
                    yield v.span
                left.extend(v.parts)


def assignments(text: str) -> Iterator[tuple[str, Value]]:
    """(target name, value) of the statements that give a name a value, also by way of other names.

    Statements are NAME or "NAME", an operator (= := : =>), then literals, bare values or names joined by +; NAME : TYPE = names
    a type in between.  A name on the right stands for the value it was last assigned above, so `a = "x"` and later `password = a`
    gives password the literal x.  Takes time and room in proportion to the text.
    """
    known: dict[str, Value] = {}
    target = last = None
    value: list[Value] = []
    joining = typed = False

    def close() -> tuple[str, Value] | None:
        nonlocal target, value, joining, typed
        done = None
        if target and value:
            done = target, Value.sum(value)
            known[target] = done[1]
        target, value, joining, typed = None, [], False, False
        return done

    for m in _TOKEN.finditer(text):
        kind, s = m.lastgroup, m.group()
        if kind == "space":
            continue
        if kind in ("end", "other"):
            if target and (done := close()):
                yield done
            last = None
        elif kind == "op":
            if s == "=" and typed and len(value) == 1:  # NAME : TYPE = value
                value, typed = [], False
            elif s in _ASSIGNING and last is not None and len(value) <= 1:  # a = b = "x": the nearest name gets it
                target, value = last, []
                typed = s == ":"
            elif target and (done := close()):
                yield done
            joining = bool(target)
            last = None
        elif kind == "plus":
            joining = bool(target and value)
            typed = False
        else:
            word = s[1:-1] if kind == "string" else s
            a, b = (m.start() + 1, m.end() - 1) if kind == "string" else (m.start(), m.end())
            typed = typed and kind == "name"
            if target and joining:
                if kind == "name" and s in known:
                    value.append(known[s])
                elif kind != "name" or not value:
                    value.append(Value.of(word, a, b))
                joining = False
            elif target and (done := close()):
                yield done
            last = word
    if done := close():
        yield done


def find_spans(text: str, threshold: float = 0.6) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start, then kind as listed in KINDS.

    assign, access and hex are the lexer's fixed rules.  literal is a literal that goes into a target whose sensitivity times
    the randomness of all it is given reaches the threshold, and that no base span covers.
    """
    spans: list[tuple[str, int, int]] = []
    assigning = ":" in text or "=" in text
    if assigning:
        low = text.lower()
        if any(k in low for k in ("passw", "secret", "token", "api_key", "apikey")):
            spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    if assigning:
        base = sorted((a, b) for _, a, b in spans)
        starts, ends = [a for a, _ in base], list(accumulate((b for _, b in base), max))
        for a, b in set(_sensitive(text, threshold)):
            k = bisect_right(starts, a)
            if a < b and not (k and ends[k - 1] >= b):
                spans.append(("literal", a, b))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _sensitive(text: str, threshold: float) -> Iterator[tuple[int, int]]:
    """Spans of literals that reach the threshold in the text's assigning lines; other lines give no name a value."""
    lines, moves, starts, at, n = [], [], [], 0, 0
    for line in text.split("\n"):
        if ":" in line or "=" in line:
            lines.append(line)
            starts.append(n)
            moves.append(at - n)
            n += len(line) + 1
        at += len(line) + 1
    for name, value in assignments("\n".join(lines)):
        much = sensitivity(name)
        if much >= threshold and not value.hit and much * value.randomness() >= threshold:
            for a, b in value.spans():
                move = moves[bisect_right(starts, a) - 1]
                yield a + move, b + move


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, text: str = "text", threshold: float = 0.6, into: str = "secrets") -> DataFrame:
    """docs with a column `into`: array of struct(kind, start, end), see find_spans.

    One pass without a shuffle; constants are propagated within a document.  Null or empty text: no spans.  Bytes that
    are not UTF-8 count as one U+FFFD each as Python decodes them.  All columns stay; one already named as `into` is
    replaced.
    """

    @F.arrow_udf("array<struct<kind:string,start:long,end:long>>")
    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            body = t.as_py()
            spans = find_spans(body.decode("utf-8", "replace"), threshold) if body else []
            out.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
        return pa.array(out, _SPANS)

    return docs.withColumn(into, scan(common.bytes_col(text)))
