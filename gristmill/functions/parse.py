"""Parsers whose rules need state: JSON repair, diagrams, answers, page labels, stems."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

_FENCED = re.compile("`{3}(?:json)?\\s*(.*?)`{3}", re.S | re.I)


def repair_json(text: str | None) -> str | None:
    """The JSON object in a model's answer in its normal form, or none.

    A fenced block is taken first. What doesn't parse is tried again with open brackets closed,
    with sets of strings as lists, and last as lines of "key": value that are merged.
    """
    if not text:
        return None
    m = _FENCED.search(text)
    body = (m[1] if m else text).strip()
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    body = body[start:]

    def load(s: str):
        try:
            return json.loads(s)
        except ValueError:
            try:
                return json.JSONDecoder().raw_decode(s)[0]
            except ValueError:
                return None

    stack, quoted, escaped = [], False, False
    for ch in body:
        if escaped:
            escaped = False
        elif ch == "\\" and quoted:
            escaped = True
        elif ch == '"':
            quoted = not quoted
        elif not quoted and ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif not quoted and ch in "}]" and stack:
            stack.pop()
    closed = body.rstrip().rstrip(",") + ('"' if quoted else "") + "".join(reversed(stack))
    flat = re.sub(r"\{\s*((?:\"[^\"]*\"\s*,\s*)*\"[^\"]*\")\s*\}", r"[\1]", closed)
    for s in (body, closed, re.sub(r",\s*([}\]])", r"\1", closed), flat):
        value = load(s)
        if value is not None:
            return json.dumps(value, ensure_ascii=False, sort_keys=True)
    merged: dict = {}
    for line in body.splitlines():
        piece = load("{" + line.strip().strip(",{}") + "}")
        if isinstance(piece, dict):
            merged.update(piece)
    return json.dumps(merged, ensure_ascii=False, sort_keys=True) if merged else None


@F.pandas_udf(StringType())
def repaired_json(texts: pd.Series) -> pd.Series:
    return texts.map(repair_json)


_EDGE = re.compile(r"\s*(?:--\s*(?P<mid>[^->|]+?)\s*-->|-->\s*\|(?P<bar>[^|]+)\||-->|---|-\.->|==>)\s*")
_NODE = re.compile(r"^\s*(?P<id>[\w.\-]+)\s*(?:\[+\(*\"?(?P<sq>[^\]\)\"]+)\"?\)*\]+|\(+\"?(?P<ro>[^)\"]+)\"?\)+|\{+\"?(?P<cu>[^}\"]+)\"?\}+)?\s*;?\s*$")


def diagram_claims(text: str | None) -> list[str]:
    """A flow diagram's edges as sentences ``A relation B``; nodes without an edge by their own name."""
    if not text:
        return []
    names: dict[str, str] = {}
    linked: set[str] = set()
    claims: list[str] = []
    directed = True

    def node(part: str) -> str | None:
        m = _NODE.match(part)
        if not m:
            return None
        label = m["sq"] or m["ro"] or m["cu"]
        if label or m["id"] not in names:
            names[m["id"]] = (label or m["id"]).strip()
        return m["id"]

    edges: list[tuple[str, str, str]] = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("%%") or re.match(r"(?:graph|flowchart|subgraph|end|classDef|class|style|linkStyle|click)\b", line):
            continue
        parts, at, rels = [], 0, []
        for m in _EDGE.finditer(line):
            parts.append(line[at : m.start()])
            directed = ">" in m.group()
            rels.append((m["mid"] or m["bar"] or ("leads to" if directed else "connected to")).strip())
            at = m.end()
        parts.append(line[at:])
        ids = [[node(x) for x in p.split("&")] for p in parts]
        for left, rel, right in zip(ids, rels, ids[1:]):
            edges += [(a, rel, b) for a in left if a for b in right if b]
    for a, rel, b in edges:
        linked |= {a, b}
        claims.append(f"{names[a]} {rel} {names[b]}")
    return list(dict.fromkeys(claims + [n for i, n in names.items() if i not in linked]))


def answer_claims(text: str | None) -> list[tuple[str, str]]:
    """(kind, claim) of an answer in Markdown: sentences of prose and items of lists, without headings and code."""
    if not text:
        return []
    out: list[tuple[str, str]] = []
    fence, prose = False, []

    def flush():
        for s in re.split(r"(?<=[.!?])\s+", " ".join(prose).strip()):
            if s.strip():
                out.append(("prose", s.strip()))
        prose.clear()

    for line in text.splitlines():
        if line.lstrip().startswith("`" * 3):
            flush()
            fence = not fence
            continue
        if fence or re.match(r"\s*#{1,6}\s", line) or re.match(r"\s*\|", line):
            flush()
            continue
        m = re.match(r"\s*(?:[-*+]|\d+[.)])\s+(.*)", line)
        if m:
            flush()
            if m[1].strip():
                out.append(("list", m[1].strip()))
        elif line.strip():
            prose.append(line.strip().lstrip("> "))
        else:
            flush()
    flush()
    return out


_ROMAN = re.compile(r"^(?=.)m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$", re.I)
#: What a label may be: a number, or a Roman one.
_LABEL = r"(\d{1,4}|[ivxlc]{1,7})"
#: The ways in which a page prints its label, the surest first: (line, pattern). A label in running words is taken in
#: lower case only, at the end of the foot or the start of the head.
_DRESSES = (
    ("foot", r"(?i)\b(?:{page})\s+" + _LABEL + r"\b"),
    ("head", r"(?i)\b(?:{page})\s+" + _LABEL + r"\b"),
    ("foot", r"(?i)^\W*" + _LABEL + r"\W*$"),
    ("head", r"(?i)^\W*" + _LABEL + r"\W*$"),
    ("foot", r"\S\s+" + _LABEL + r"$"),
    ("head", r"^" + _LABEL + r"\s+\S"),
)


def page_label(text: Column, page_words: tuple[str, ...] = ("page",)) -> Column:
    """The label that a page prints in its first or last line with text, in lower case; empty if there is none."""
    kept = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+", ""), r"\s+$", "")
    lines = F.split(kept, "\n")
    line = {"head": F.regexp_replace(lines[0], r"\s+$", ""), "foot": F.regexp_replace(F.element_at(lines, -1), r"^\s+", "")}
    out = []
    for where, dress in _DRESSES:
        label = F.lower(F.regexp_extract(line[where], dress.replace("{page}", "|".join(page_words)), 1))
        out.append(F.when((label != "") & label.rlike(r"^(?:\d+|(?:xc|xl|l?x{0,3}|c{1,3}(?:xc|xl|l?x{0,3}))(?:ix|iv|v?i{0,3}))$"), label))
    return F.coalesce(*out, F.lit(""))


def roman_number(c: Column) -> Column:
    """The value of a Roman numeral in lower case."""
    worth = F.create_map(*[F.lit(x) for pair in zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000)) for x in pair])
    each = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: worth[x])
    later = lambda x, i: F.coalesce(F.get(each, i + 1), F.lit(0))
    return F.aggregate(F.transform(each, lambda x, i: F.when(x < later(x, i), -x).otherwise(x)), F.lit(0), lambda s, v: s + v)


@F.pandas_udf(ArrayType(StringType()))
def claims_of_diagram(texts: pd.Series) -> pd.Series:
    return texts.map(diagram_claims)


@F.pandas_udf(ArrayType(StructType().add("kind", StringType()).add("claim", StringType())))
def claims_of_answer(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"kind": k, "claim": c} for k, c in answer_claims(t)])


def roman_value(s: str) -> int:
    v = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c] for c in s.lower()]
    return sum(-x if any(y > x for y in v[k + 1 :]) else x for k, x in enumerate(v))


_ENDINGS = ("ational", "ization", "fulness", "ousness", "iveness", "tional", "biliti", "entli", "ousli", "ation", "alism", "aliti", "ements", "ement", "ments", "ment", "ness", "ings", "ing", "edly", "ies", "ied", "ers", "er", "ed", "ly", "es", "s")


def stem(word: str) -> str:
    """A light English stem: the longest known ending is taken off while three letters stay."""
    w = word.lower()
    for e in _ENDINGS:
        if w.endswith(e) and len(w) - len(e) >= 3:
            base = w[: -len(e)]
            if e in ("ies", "ied"):
                return base + "y"
            if e == "s" and base.endswith("s"):
                return w
            if e in ("ing", "ings", "ed", "er", "ers") and len(base) > 3 and base[-1] == base[-2] and base[-1] not in "lsz":
                return base[:-1]
            return base
    return w


@F.pandas_udf(StringType())
def stemmed(words: pd.Series) -> pd.Series:
    return words.map(lambda w: w if w is None else stem(w))


_TAGS = {"script", "style", "nav", "footer", "header", "aside"}


def html_text(page: str | None, cap: int = 1500) -> str:
    """The text of a page without scripts, styles and page furniture, at most ``cap`` words."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.parts = 0, []

        def handle_starttag(self, tag, attrs):
            self.depth += tag in _TAGS

        def handle_endtag(self, tag):
            self.depth -= tag in _TAGS and self.depth > 0

        def handle_data(self, data):
            if not self.depth and data.strip():
                self.parts.append(data.strip())

    r = Reader()
    r.feed(page or "")
    return " ".join(" ".join(r.parts).split()[:cap])


@F.pandas_udf(StringType())
def page_text(pages: pd.Series) -> pd.Series:
    return pages.map(html_text)
