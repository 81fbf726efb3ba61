"""Noise in text from scanned pages: cut words, misread characters, running lines and page numbers.

Misread words are words of pages that text without pages hardly knows. Candidates for them come
from an inverted join on character q-grams. The grams are those of the word with characters that
scanners confuse taken as one, so any number of known misreadings leaves all of them, and one
other change leaves all but a few: the rarest few more than that, of each word, go to the join.
A gradient-boosted ranking picks the replacement. Line pairs are judged by two
small classifiers: whether the end of one line and the start of the next are one word, and
whether a line at the top or foot of a page runs on through the pages around it. All three
models are trained on made-up noise (``python -m gristmill.llm.ocr_train``) and kept in
``ocr_model.json``.
"""

from __future__ import annotations

import functools
import json
import math
import os
import pkgutil
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.session import durable

MODEL = os.path.join(os.path.dirname(__file__), "ocr_model.json")
#: A word of pages is suspect if pages have it more than this many times as often as other text.
RATIO = 8
#: Words known to be right that a worker is sent, at most: the most frequent ones (about 2 MB).
COMMON = 20_000
#: Lines at each edge of a page that may be furniture, and pages before and after it that are compared.
EDGE, AROUND = 3, 2
#: Blocks of a file that are looked at in one task, and how many on each side are taken along for comparison.
STRETCH, BESIDE = 512, 8
#: Characters kept of the start and of the end of a line at an edge; lines longer than both are no running lines.
LINE = 200

#: Characters and what scanners read for them.
MISREAD = {
    "e": ["c"], "a": ["o"], "i": ["!", "l", "1", "|"], "t": ["f"], "o": ["0"], "n": ["u"], "s": ["5"], "l": ["1", "i", "|"],
    "g": ["q", "9"], "h": ["b"], "m": ["rn"], "w": ["vv"], "é": ["6"], "ó": ["6"], "b": ["6"], "li": ["h"], "ü": ["ii"], "fi": ["ﬁ"], "fl": ["ﬂ"],
    "cl": ["d"], "d": ["cl"], "rn": ["m"], "u": ["n"], "c": ["e"], "f": ["t"], "q": ["g"], "B": ["8"], "S": ["5"], "z": ["2"],
}
_PAIRS = {(a, b) for a, bs in MISREAD.items() for b in bs}
_STRIP = ".,;:()[]{}«»„“”\"'’‘…?¿¡*#<>"
_SOFT = "­¬‐"
_CUT = re.compile(rf"([^\W\d_][^\s]*?|[^\W\d_])([-{_SOFT}])$")
_WORDLIKE = re.compile(r"^(?=.*[^\W\d_])[^\W_](?:[^\W_]|[!|\-])*$")
_CODE = re.compile(r"\d.*\d|^[A-Z]+\d|-\d|^\d")
PAGE_WORDS = {"page", "seite", "página", "pagina", "p", "s", "pág", "pag", "folio", "blatt", "pg"}
_OF = {"of", "von", "sur", "de", "di", "da", "do", "su", "/"}
_ROMAN = re.compile(r"^m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")


def letters_of(token: str) -> str | None:
    """A token as a word in lower case without punctuation around it, or none if it can't be one."""
    w = token.strip(_STRIP)
    if len(w) < 2 or "’" in w or not _WORDLIKE.match(w) or _CODE.search(w):
        return None
    letters = sum(c.isalpha() for c in w)
    return w.lower() if letters * 10 >= len(w) * 6 else None


@functools.lru_cache(maxsize=1 << 18)
def _word(token: str) -> str | None:
    return letters_of(token)


def cut_pairs(lines: list[str]) -> list[tuple[int, str, str, str]]:
    """(line, first piece, mark, second piece) of each word that may be cut at the end of a line."""
    out = []
    for i in range(len(lines) - 1):
        line = lines[i].rstrip()
        if line and line[-1] in "-­¬‐":
            nxt = lines[i + 1].split(None, 1)
            m = _CUT.search(line.rsplit(None, 1)[-1].lstrip(_STRIP))
            if m and nxt and (nxt[0][0].islower() or nxt[0][0] in "!|15"):
                b = nxt[0].rstrip(_STRIP)
                if any(c.isalpha() for c in b):
                    out.append((i, m[1], m[2], b))
    return out


def edges(lines: list[str]) -> tuple[list[int], list[int]]:
    """The first and the last few lines with text of a page, as numbers of lines; on a short page they are partly the same."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    return full[:EDGE], full[-EDGE:]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (what = c), cuts (h) and edges of pages (p), all from one reading of the texts."""
    for b in batches:
        clean: Counter = Counter()
        paged: Counter = Counter()
        rows = []
        for file_id, block_id, page, no, text in zip(*[c.to_pylist() for c in b.columns]):
            if not text:
                continue
            if not page or page <= 0:
                clean.update(text.split())
                continue
            lines = text.split("\n")
            cuts = cut_pairs(lines)
            for i, a, mark, rest in cuts:
                rows.append(("h", file_id, block_id, page, no, i, a.lower(), mark, rest.lower(), None))
            paged.update(text.split())
            for line in lines:
                line = line.rstrip()
                if line and line[-1] in "-­¬‐":
                    paged[line.rsplit(None, 1)[-1]] -= 1  # a piece of a word, as it seems, is none itself
            top, foot = edges(lines)
            full = [len(x) for x in lines if x.strip()]
            width = max(full, default=0)
            short = lambda x: x if len(x) <= 2 * LINE else f"{x[:LINE]} … {x[-LINE:]}"
            about = json.dumps([width, len(full), [[i, short(lines[i]), int(i + 1 < len(lines) and not lines[i + 1].strip())] for i in top], [[i, short(lines[i]), int(i > 0 and not lines[i - 1].strip())] for i in foot]], ensure_ascii=False)
            rows.append(("p", file_id, block_id, page, no, 0, "", "", "", about))
        words: dict[str, list[int]] = {}
        for k, counts in enumerate((clean, paged)):
            for t, n in counts.items():
                w = _word(t)
                if w and n > 0:
                    words.setdefault(w, [0, 0])[k] += n
        rows += [("c", None, None, n[1], n[0], 0, w, "", "", None) for w, n in words.items()]
        cols = list(zip(*rows)) if rows else [()] * 10
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["what", "file_id", "block_id", "x", "y", "line", "a", "mark", "b", "about"])


_SCANNED = "what string, file_id bigint, block_id bigint, x bigint, y bigint, line int, a string, mark string, b string, about string"


# --- the boosted ranking -------------------------------------------------------------------


class Boosted:
    """Trees of depth 3 over a few features; score is the sum of their leaves."""

    def __init__(self, trees: list[dict], base: float):
        self.base = base
        self.feature = np.array([t["feature"] for t in trees], np.int64).reshape(-1, 7)
        self.at = np.array([t["at"] for t in trees], np.float64).reshape(-1, 7)
        self.leaf = np.array([t["leaf"] for t in trees], np.float64).reshape(-1, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, at, leaf in zip(self.feature, self.at, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(3):
                node = 2 * node + 1 + (x[rows, f[node]] > at[node])
            out += leaf[node - 7]
        return out


@functools.lru_cache(maxsize=1)
def model() -> dict:
    """The models in the package (also where that is an archive)."""
    m = json.loads(pkgutil.get_data(__package__, os.path.basename(MODEL)))
    return {"rank": Boosted(m["rank"]["trees"], m["rank"]["base"]), "rank_at": m["rank"]["at"], "cut": np.array(m["cut"]), "furniture": [float(x) for x in m["furniture"]]}


#: Costs beyond this are not told apart.
FARTHEST = 1.31


def distance(right: str, seen: str) -> float:
    """The least cost of reading ``seen`` for ``right``: 0.3 for each known misreading, 1 for each other change."""
    if abs(len(right) - len(seen)) > 4:
        return 9.0
    i = 0
    while i < min(len(right), len(seen)) and right[i] == seen[i]:
        i += 1
    j = 0
    while j < min(len(right), len(seen)) - i and right[-1 - j] == seen[-1 - j]:
        j += 1
    # one more character on each side, as misreadings of two characters may share one with what was read
    a, b = right[i : len(right) - j], seen[i : len(seen) - j]
    if (a, b) in _PAIRS:
        return 0.3
    lo, hi = max(0, i - 1), max(0, j - 1)
    a, b = right[lo : len(right) - hi], seen[lo : len(seen) - hi]
    best = [[99.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best[0][0] = 0.0
    for x in range(len(a) + 1):
        for y in range(len(b) + 1):
            d = best[x][y]
            if d > FARTHEST:
                continue
            if x < len(a) and y < len(b):
                best[x + 1][y + 1] = min(best[x + 1][y + 1], d + (a[x] != b[y]))
            if x < len(a):
                best[x + 1][y] = min(best[x + 1][y], d + 1)
            if y < len(b):
                best[x][y + 1] = min(best[x][y + 1], d + 1)
            for n in (1, 2):
                for k in (1, 2):
                    if x + n <= len(a) and y + k <= len(b) and (a[x : x + n], b[y : y + k]) in _PAIRS:
                        best[x + n][y + k] = min(best[x + n][y + k], d + 0.3)
    return best[-1][-1]


def rank_features(seen: str, right: str, seen_clean: int, seen_paged: int, right_clean: int, right_paged: int, cost: float | None = None) -> list[float]:
    grams = lambda w: {w[i : i + 2] for i in range(len(w) - 1)}
    a, b = grams(f"^{seen}$"), grams(f"^{right}$")
    known = math.log10(right_clean + right_paged + 1)
    return [
        distance(right, seen) if cost is None else cost,
        float(len(right)),
        float(abs(len(right) - len(seen))),
        known,
        known - math.log10(seen_clean + seen_paged + 1),
        math.log10((seen_clean + 0.5) / (seen_paged + 0.5)),
        float(any(not c.isalpha() and c != "-" for c in seen)),
        2.0 * len(a & b) / (len(a) + len(b)),
        float(seen[0] == right[0]),
        float(seen[-1] == right[-1]),
    ]


#: What characters become where those that scanners confuse, alone or two for one, are the same.
_SAME = {
    "i": "I", "!": "I", "l": "I", "1": "I", "|": "I", "h": "II", "b": "II", "6": "II", "8": "II", "é": "II", "ó": "II", "ü": "II",
    "r": "R", "n": "N", "u": "N", "m": "RN", "v": "V", "w": "VV", "c": "C", "e": "C", "d": "CI", "a": "O", "o": "O", "0": "O",
    "t": "T", "f": "T", "ﬁ": "TI", "ﬂ": "TI", "s": "S", "5": "S", "g": "G", "q": "G", "9": "G", "z": "Z", "2": "Z",
}
_SAME_TABLE = str.maketrans(_SAME)
#: Symbols that one change of another kind may touch, on either side.
TOUCHED = 2
#: Numbers under which the frequencies of grams are kept; what is sent to the workers has so many.
BUCKETS = 1 << 16


def alike(word: str) -> str:
    """The word with characters that scanners confuse taken as one."""
    return word.translate(_SAME_TABLE)


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def _q(n: int) -> int:
    return 2 if n < 8 else 3


def _grams(word: str, q: int) -> set[str]:
    s = f"^{alike(word)}$"
    return {s[i : i + q] for i in range(len(s) - q + 1)}


class Grams:
    """The keys by which words are looked up, given how often right words have the grams of each bucket.

    A key is a gram and the length of the right word, both with confused characters taken as one. One
    change that touches TOUCHED symbols destroys at most q + TOUCHED - 1 grams, so of two words that
    are so near each other the q + TOUCHED rarest grams have one in common.
    """

    def __init__(self, often):
        self.often = often

    def _rarest(self, word: str, n: int) -> list[str]:
        q = _q(n)
        return [f"{n}{g}" for g in sorted(_grams(word, q), key=lambda g: (self.often[_bucket(g)], g))[: q + TOUCHED]]

    def right(self, word: str) -> list[str]:
        return self._rarest(word, len(alike(word)))

    def seen(self, word: str) -> list[str]:
        n = len(alike(word))
        return [k for m in range(max(1, n - TOUCHED), n + TOUCHED + 1) for k in self._rarest(word, m)]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n: Counter = Counter()
        for w in b.column(0).to_pylist():
            n.update(_bucket(g) for g in _grams(w, _q(len(alike(w)))))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64())], names=["bucket", "n"])


def grams_of(words: DataFrame) -> Grams:
    """The keys for right words (word): what is sent to the driver is bounded by BUCKETS."""
    often = [0] * BUCKETS
    for r in words.select("word").mapInArrow(_gram_counts, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        often[r["bucket"]] = r["n"]
    return Grams(often)


def _keyed(rows: DataFrame, shared, side: str, columns: list[str]) -> DataFrame:
    """A row for each key of ``word``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = getattr(Grams(shared.value), side)
        for b in batches:
            take, out = [], []
            for i, w in enumerate(b.column("word").to_pylist()):
                k = keys(w)
                take += [i] * len(k)
                out += k
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in columns] + [pa.array(out, pa.string())], names=[*columns, "gram"])

    slim = rows.select(*columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields)
    return slim.mapInArrow(run, f"{schema}, gram string")


def may_be(right: str, seen: str) -> bool:
    """Whether the two are alike but for at most TOUCHED symbols in one place."""
    a, b = alike(right), alike(seen)
    if abs(len(a) - len(b)) > TOUCHED:
        return False
    i, most = 0, min(len(a), len(b))
    while i < most and a[i] == b[i]:
        i += 1
    j = 0
    while j < most - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= TOUCHED


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = model()
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        near = [(*r, d) for r in zip(*cols) if may_be(r[3], r[0]) and (d := distance(r[3], r[0])) <= 1.3]
        x = np.array([rank_features(s, r, sc, sp, rc, rp, d) for s, sc, sp, r, rc, rp, d in near], np.float64).reshape(-1, 10)
        score = m["rank"].score(x) if len(near) else np.zeros(0)
        keep = [(r[0], r[3], float(s)) for r, s in zip(near, score) if s >= m["rank_at"]]
        out = list(zip(*keep)) if keep else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["word", "right", "score"])


def corrections(counts: DataFrame, suspects: DataFrame) -> DataFrame:
    """(word, right) for each suspect word that has a replacement.

    counts: word, clean, paged; suspects: the same of the words to be corrected. A candidate is a
    word that text without pages knows; of equal scores the more frequent, then the first in the
    alphabet is taken.
    """
    s = suspects.select("word", F.col("clean").alias("sc"), F.col("paged").alias("sp"))
    # what is right is known outside pages, and more frequent there than its misreadings
    v = counts.where("clean > 0 and not word rlike '[0-9!|]'")
    shared = counts.sparkSession.sparkContext.broadcast(grams_of(v).often)
    left = _keyed(s, shared, "seen", ["word", "sc", "sp"])
    right = _keyed(v, shared, "right", ["word", "clean", "paged"]).select(F.col("word").alias("right"), F.col("clean").alias("rc"), F.col("paged").alias("rp"), "gram")
    pairs = left.join(right, "gram").where("word <> right and rc > sc").select("word", "sc", "sp", "right", "rc", "rp").distinct()
    ranked = pairs.mapInArrow(_ranked, "word string, right string, score double")
    return ranked.groupBy("word").agg(F.max_by("right", F.struct("score", "right")).alias("right"))


# --- cut words -----------------------------------------------------------------------------


def cut_features(joined: int, hyphened: int, first: int, second: int, first_hyphen: int, soft: bool) -> list[float]:
    g = lambda n: math.log10(n + 1)
    return [1.0, g(joined), g(hyphened), g(first), g(second), g(first_hyphen), float(soft), float(joined > 0), float(hyphened > 0), float(first_hyphen > 0 and second > 0)]


def cut_kind(x: list[float], weights: np.ndarray) -> int:
    """0: not one word, 1: one word without a hyphen, 2: one word with its hyphen."""
    return int(np.argmax(weights @ np.array(x)))


def _judged_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    w = model()["cut"]
    for b in batches:
        d = b.to_pydict()
        words = []
        for a, mark, c, nj, nh, na, nc, ns, fixed in zip(d["a"], d["mark"], d["b"], d["nj"], d["nh"], d["na"], d["nc"], d["ns"], d["fixed"]):
            kind = cut_kind(cut_features(nj, nh, na, nc, ns, mark != "-"), w)
            if nj == 0 and nh == 0 and fixed:
                words.append(fixed)
            else:
                words.append(None if kind == 0 else a + c if kind == 1 else f"{a}-{c}")
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("mark"), b.column("b"), pa.array(words, pa.string())], names=["a", "mark", "b", "word"])


# --- running lines and page numbers ----------------------------------------------------------


_PARTS = re.compile(r"[^\W_]+|/")
_NUMBER = re.compile(r"^(?:[ivxlcdm]+|[\dloiszbq]*\d[\dloiszbq]*)$")


@functools.lru_cache(maxsize=4096)
def _page_word(word: str) -> bool:
    return word in PAGE_WORDS or any(distance(p, word) <= 0.7 for p in PAGE_WORDS if len(p) > 2)


def number_of(line: str) -> int | None:
    """The page's number if the line holds only that, in any dress."""
    s = line.strip().lower()
    if not s or re.search(r"[^\w\s\-–—.|/()\[\]·•*~:!]", s):
        return None
    parts = _PARTS.findall(s)
    if not parts or len(parts) > 4 or not any(_NUMBER.match(x) for x in parts):
        return None
    if len(parts) > 1 and len(parts[0]) > 1 and not parts[0].isdigit() and _page_word(parts[0]):
        parts = parts[1:]
    if len(parts) == 3 and (parts[1] in _OF or any(distance(o, parts[1]) <= 0.3 for o in _OF)):
        parts = parts[:1]
    if len(parts) != 1:
        return None
    n = parts[0]
    if n.isdigit():
        return int(n) if len(n) <= 5 else None
    if _ROMAN.match(n):
        values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
        v = [values[c] for c in n]
        return sum(-x if any(y > x for y in v[k + 1 :]) else x for k, x in enumerate(v))
    read = n.translate(str.maketrans("loiszbq|!", "101528911"))
    return int(read) if read.isdigit() and any(c.isdigit() for c in n) and len(n) <= 4 else None


_NUMBERED = re.compile(r"(?:^|(?<=\s))[\W_]*(?:\d+|[ivxl]{1,5})[\W_]*(?=\s|$)")
_NOT_WORD = re.compile(r"\W+")
_FOLD = str.maketrans("0oc1l!|5nqéó6bfühao", "aaeiiiisugeabhtubaa")


def _folded(line: str) -> frozenset:
    """The letter pairs of a line, with what scanners confuse taken as one and numbers left out."""
    s = _NUMBERED.sub(" ", line.strip().lower()).replace("rn", "m").replace("vv", "w").replace("ii", "u").translate(_FOLD)
    s = _NOT_WORD.sub("", s)
    return frozenset(map("".join, zip(s, s[1:])))


def title_like(line: str, width: int) -> bool:
    s = line.strip()
    core = re.sub(r"^[\W\d_]*\s+|\s+[\W\d_]*$", "", s)
    letters = [c for c in core if c.isalpha()]
    if len(letters) < 4 or s[-1] in ".,;!?…":
        return False
    upper = sum(c.isupper() for c in letters) >= 0.7 * len(letters)
    return upper or (core[:1].isupper() and len(s) <= max(24, 0.8 * width))


class Line:
    """A line at the edge of a page, with what is found out about it kept."""

    __slots__ = ("i", "text", "apart", "width", "_pairs", "_title", "_number")

    def __init__(self, i: int, text: str, apart: int, width: int):
        self.i, self.text, self.apart, self.width = i, text, bool(apart), width
        self._pairs = self._title = self._number = None

    @property
    def pairs(self) -> frozenset:
        if self._pairs is None:
            self._pairs = _folded(self.text)
        return self._pairs

    @property
    def title(self) -> bool:
        if self._title is None:
            self._title = title_like(self.text, self.width)
        return self._title

    @property
    def number(self) -> int | None:
        if self._number is None:
            self._number = (number_of(self.text),)
        return self._number[0]


@functools.lru_cache(maxsize=256)
def page_edges(about: str) -> tuple[list[Line], list[Line]]:
    """The lines at the top and, from the last upwards, at the foot of a scanned page."""
    width, _, top, foot = json.loads(about)
    return [Line(*x, width) for x in top], [Line(*x, width) for x in reversed(foot)]


def plain_features(line: Line, place: int) -> list[float]:
    """Features of a line at an edge by itself. place: lines with text between it and the edge."""
    s = line.text.strip()
    return [1.0, float(line.title), float(line.apart), float(place), len(s) / max(1, line.width), float(bool(s) and s[-1] in ".,;!?…"), float(s[:1].islower())]


def likeness(line: Line, place: int, others: list[tuple[Line, int, int]]) -> tuple[float, float]:
    """How like the line is to the nearest line at the same edge of the pages around it, and whether
    the next pages have a title at its place. others: (line, place, pages away)."""
    best, near = 0.0, 0.0
    mine = line.pairs
    for o, p, away in others:
        if mine:
            part = 1.0 if abs(p - place) <= 1 else 0.8
            theirs = o.pairs
            both = len(mine) + len(theirs)
            if 2.0 * min(len(mine), len(theirs)) * part > best * both:
                best = max(best, 2.0 * len(mine & theirs) / both * part)
        if away == 1 and p == place and line.title and o.title:
            near = 1.0
    return best, near


def line_score(weights: list[float], plain: list[float], best: float, near: float) -> float:
    """Above 0 for a running line. The first seven weights are for the plain features."""
    w = weights
    return sum(map(float.__mul__, w, plain)) + w[7] * best + w[8] * (best > 0.8) + w[9] * (best > 0.6) + w[10] * near * plain[1]


def line_features(line: Line, place: int, others: list[tuple[Line, int, int]]) -> list[float]:
    """All features in the order of the weights."""
    best, near = likeness(line, place, others)
    return [*plain_features(line, place), best, float(best > 0.8), float(best > 0.6), near * float(line.title)]


def furniture(page: str, around: list[tuple[int, str]], weights: list[float]) -> list[tuple[int, str]]:
    """(line, kind) of the running lines and the page number of a page, given the pages around it.

    page: as scanned; around: (pages away, page).
    """
    found: list[tuple[int, str]] = []
    for edge, lines in enumerate(page_edges(page)):
        others: list[tuple[Line, int, int]] | None = None
        for place, line in enumerate(lines):
            if any(i == line.i for i, _ in found):
                continue
            if len(line.text) > 2 * LINE:
                break
            n = line.number
            if n is None and not around:
                break
            if others is None:
                others = [(x, k, abs(away)) for away, p in around for k, x in enumerate(page_edges(p)[edge])]
            if n is not None:
                if any(kind == "page_no" for _, kind in found):
                    break
                seq = any(k == place and o.number is not None for o, k, _ in others)
                text = line.text.strip()
                if text[-1] in ".:" and not any(o.number in (n - a, n + a) for o, k, a in others):
                    break  # the end of a sentence
                if place and not line.apart and text.isdigit() and not seq and not found:
                    break
                found.append((line.i, "page_no"))
                continue
            plain = plain_features(line, place)
            if line_score(weights, plain, 0.800001 if weights[7] < 0 else 1.0, 1.0) <= 0 or line_score(weights, plain, *likeness(line, place, others)) <= 0:
                break  # the first test: not even a line like it nearby would make it one
            found.append((line.i, "header"))
    return found


def _edge_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Furniture (kind header, page_no) and the open ends of each page (kind tail, head)."""
    w = model()["furniture"]
    names = [f"b{k}" for k in range(AROUND, 0, -1)] + [f"a{k}" for k in range(1, AROUND + 1)]
    for b in batches:
        d = b.to_pydict()
        rows = []
        for r, block in enumerate(d["block_id"]):
            page = d["about"][r]
            around = [(int(n[1]) * (-1 if n[0] == "b" else 1), d[n][r]) for n in names if d[n][r]]
            found = furniture(page, around, w)
            off = {i for i, _ in found}
            text = {x.i: x.text for part in page_edges(page) for x in part}
            rows += [(block, i, kind, text[i].strip()) for i, kind in found]
            rest = [i for i in sorted(text) if i not in off]
            if rest:
                last = text[rest[-1]].rstrip()
                m = _CUT.search(last.rsplit(None, 1)[-1].lstrip(_STRIP)) if last and last[-1] in "-­¬‐" else None
                if m:
                    rows.append((block, rest[-1], "tail", f"{m[2]}{m[1].lower()}"))
                first = text[rest[0]].split(None, 1)
                if first and first[0][0].islower():
                    rows.append((block, rest[0], "head", first[0].rstrip(_STRIP).lower()))
        cols = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["block_id", "line", "kind", "text"])


def _rare_words(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        usual: set[str] = set()  # tokens, with whatever punctuation, that are common words or no words
        for b in batches:
            if len(usual) > COMMON * 20:
                usual.clear()
            ids, lines_, words = [], [], []
            for block, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                odd = {}
                for t in set(text.split()).difference(usual):
                    w = _word(t)
                    if w is None or w in common:
                        usual.add(t)
                    else:
                        odd[t] = w
                if not odd:
                    continue
                rows = text.split("\n")
                after = {i + 1 for i, _, _, _ in cut_pairs(rows)}
                for i, line in enumerate(rows):
                    tokens = line.split()
                    for k, t in enumerate(tokens):
                        if t in odd and not (k == 0 and i in after) and not (k == len(tokens) - 1 and t[-1] in "-­¬‐"):
                            ids.append(block), lines_.append(i), words.append(odd[t])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines_, pa.int32()), pa.array(words, pa.string())], names=["block_id", "line", "word"])

    return run


def noise(blocks: DataFrame) -> DataFrame:
    """(block_id, line, kind, seen, word): each piece of noise of each page.

    kind ``hyphen``: a word cut at the end of a line or page; ``ocr_char``: a misread word;
    ``header``, ``page_no``: a line at the edge of a page. seen is what stands in the text (the
    pieces of a cut word with the mark between), word the whole right word, or the line without
    spaces around it. line counts from 0. Pages are blocks with a page_number above 0; their
    order in a file is by page_number and block_no. Null and empty texts have no noise.
    """
    texts = blocks.select(F.col("file_id").cast("bigint"), F.col("block_id").cast("bigint"), F.col("page_number").cast("bigint"), F.col("block_no").cast("bigint"), "text").where("text is not null")
    seen = durable(texts.mapInArrow(_scan, _SCANNED))
    counts = durable(seen.where("what = 'c'").groupBy(F.col("a").alias("word")).agg(F.sum("y").alias("clean"), F.sum("x").alias("paged")))

    # running lines and page numbers, from each page's edge lines and those of the pages around it
    # a file is gone through in stretches, each with a few pages of the ones beside it, so that no task holds a whole file
    at = F.coalesce("y", F.lit(0))
    near = F.pmod(at, F.lit(STRETCH))
    stretch = F.floor(at / STRETCH)
    beside = F.array(F.struct(stretch.alias("s"), F.lit(True).alias("own")), F.when((near < BESIDE) & (stretch > 0), F.struct((stretch - 1).alias("s"), F.lit(False).alias("own"))), F.when(near >= STRETCH - BESIDE, F.struct((stretch + 1).alias("s"), F.lit(False).alias("own"))))
    pages = seen.where("what = 'p'").select("file_id", "block_id", "x", "y", "about", F.explode(F.filter(beside, lambda b: b.isNotNull())).alias("in"))
    pages = pages.select("file_id", "block_id", "x", "y", "about", F.col("in.s").alias("stretch"), F.col("in.own").alias("own"))
    order = Window.partitionBy("file_id", "stretch").orderBy("x", "y", "block_id")
    steps = range(1, AROUND + 1)
    beside = [f(F.col("about"), k).over(order).alias(f"{n}{k}") for k in steps for n, f in (("b", F.lag), ("a", F.lead))]
    pages = pages.select("block_id", "about", "own", F.lead("block_id").over(order).alias("next_block"), *beside).where("own")
    about = [f"{s}{k}" for s in "ba" for k in range(1, AROUND + 1)]
    judged = durable(pages.select("block_id", "about", *about).mapInArrow(_edge_pages, "block_id bigint, line int, kind string, text string"))
    furniture_rows = judged.where("kind in ('header', 'page_no')")

    # cut words: within a page, and over to the next page
    follow = pages.select("block_id", "next_block").where("next_block is not null")
    tail = judged.where("kind = 'tail'").select("block_id", "line", F.substring("text", 1, 1).alias("mark"), F.expr("substring(text, 2)").alias("a"))
    head = judged.where("kind = 'head'").select(F.col("block_id").alias("next_block"), F.col("text").alias("b"))
    over = tail.join(follow, "block_id").join(head, "next_block").select("block_id", "line", "a", "mark", "b")
    inside = seen.where("what = 'h'").select("block_id", "line", "a", "mark", "b")
    taken = furniture_rows.select("block_id", "line").unionByName(furniture_rows.select("block_id", (F.col("line") - 1).cast("int").alias("line")))
    inside = inside.join(taken, ["block_id", "line"], "left_anti")  # neither line may be furniture
    cuts = inside.unionByName(over)
    distinct = cuts.select("a", "mark", "b").distinct()
    n = counts.select(F.col("word").alias("_key"), (F.col("clean") + F.col("paged")).alias("n"))
    asked = {"nj": F.concat("a", "b"), "nh": F.concat("a", F.lit("-"), "b"), "na": F.col("a"), "nc": F.col("b"), "ns": F.concat("a", F.lit("-"))}
    each = distinct.select("a", "mark", "b", F.explode(F.array(*[F.struct(F.lit(k).alias("what"), c.alias("_key")) for k, c in asked.items()])).alias("k")).select("a", "mark", "b", "k.what", "k._key")
    known = each.join(n, "_key", "left").groupBy("a", "mark", "b")
    distinct = durable(known.agg(*[F.coalesce(F.max(F.when(F.col("what") == k, F.col("n"))), F.lit(0)).alias(k) for k in asked]))

    # misread words, and joined words that nothing knows
    odd = counts.where(F.col("clean") * RATIO < F.col("paged"))
    unknown = distinct.where("nj = 0 and nh = 0").select(F.concat("a", "b").alias("word"), F.lit(0).cast("bigint").alias("clean"), F.lit(1).cast("bigint").alias("paged")).distinct()
    fixed = durable(corrections(counts, odd.unionByName(unknown.join(odd, "word", "left_anti"))))
    known_cuts = (
        distinct.withColumn("_key", F.concat("a", "b"))
        .join(fixed.select(F.col("word").alias("_key"), F.col("right").alias("fixed")), "_key", "left")
        .select("a", "mark", "b", "nj", "nh", "na", "nc", "ns", "fixed")
        .mapInArrow(_judged_cuts, "a string, mark string, b string, word string")
        .where("word is not null")
    )
    hyphen = cuts.join(known_cuts, ["a", "mark", "b"]).select("block_id", "line", F.lit("hyphen").alias("kind"), F.concat("a", "mark", "b").alias("seen"), "word")

    rows = counts.where(F.col("clean") * RATIO >= F.col("paged")).orderBy(F.desc(F.col("clean") + F.col("paged")), "word").limit(COMMON).select("word")
    shared = blocks.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in rows.collect()))
    rare = texts.where("page_number > 0 and text <> ''").select("block_id", "text").mapInArrow(_rare_words(shared), "block_id bigint, line int, word string")
    misread = rare.join(fixed, "word").join(furniture_rows.select("block_id", "line"), ["block_id", "line"], "left_anti")
    misread = misread.select("block_id", "line", F.lit("ocr_char").alias("kind"), F.col("word").alias("seen"), F.col("right").alias("word"))
    lines = furniture_rows.select("block_id", "line", "kind", F.col("text").alias("seen"), F.col("text").alias("word"))
    return hyphen.unionByName(misread).unionByName(lines)


def found(blocks: DataFrame) -> DataFrame:
    """(block_id, kind, word) of all noise, each once."""
    return noise(blocks).select("block_id", "kind", "word").distinct()


# --- repair ----------------------------------------------------------------------------------


def _like(word: str, model_: str) -> str:
    """The word in the case of what stood there."""
    letters = [c for c in model_ if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if model_[:1].isupper() else word


def repair_pages(pages: list[tuple[str | None, list[tuple[int, str, str, str]]]], begun: bool = False) -> tuple[str, bool]:
    """The continuous text of a file's pages in order, with their noise taken out, and whether its last paragraph goes on after them.

    pages: (text, [(line, kind, seen, word)]). Lines of a paragraph are joined; an empty line
    starts a new one, the end of a page doesn't unless the sentence has ended there. begun: the
    first word of the first page is the rest of one that the pages before these hold whole.
    """
    paragraphs: list[str] = []
    open_ = ""
    carry: tuple[str, str] | None = None  # a word cut at the end of a page: what it begins with, and the whole word
    for text, marks in pages:
        if not text:
            continue
        off = {i for i, kind, _, _ in marks if kind in ("header", "page_no")}
        cuts: dict[int, list[tuple[str, str]]] = {}
        fixes: dict[int, dict[str, str]] = {}
        for i, kind, seen, word in marks:
            if kind == "hyphen":
                cuts.setdefault(i, []).append((seen, word))
            elif kind == "ocr_char":
                fixes.setdefault(i, {})[seen] = word
        lines = text.split("\n")
        body = [i for i, line in enumerate(lines) if line.strip() and i not in off]
        for i in range(body[0], body[-1] + 1) if body else ():  # empty lines beside furniture are no paragraphs
            line = lines[i]
            if i in off:
                continue
            if not line.strip():
                if open_:
                    paragraphs.append(open_)
                    open_ = ""
                continue
            tokens = line.split()
            if begun and tokens:
                rest = tokens[0].rstrip(_STRIP)
                tokens[0] = tokens[0][len(rest) :]
                tokens = tokens if tokens[0] else tokens[1:]
                begun = False
            if carry and tokens:
                rest = tokens[0].rstrip(_STRIP)
                tokens[0] = _like(carry[1], carry[0]) + tokens[0][len(rest) :]
                carry = None
            fix = fixes.get(i, {})
            for k, t in enumerate(tokens):
                w = _word(t)
                if w in fix:
                    body = t.strip(_STRIP)
                    tokens[k] = t.replace(body, _like(fix[w], body))
            if i in cuts and tokens and tokens[-1][-1] in "-­¬‐":
                last = tokens.pop()
                lead = len(last) - len(last.lstrip(_STRIP))
                carry = (last[lead:], last[:lead] + _like(cuts[i][0][1], last[lead:]) if lead else cuts[i][0][1])
            if tokens:
                open_ = f"{open_} {' '.join(tokens)}" if open_ else " ".join(tokens)
        if open_ and open_[-1] in ".!?…:”»" and not carry:
            paragraphs.append(open_)
            open_ = ""
    if carry:
        open_ = f"{open_} {carry[1]}".strip()
    if open_:
        paragraphs.append(open_)
    return "\n\n".join(paragraphs), bool(open_)


#: Blocks of one file that are put together in one task; of longer files each run of so many gives a part.
PART = 2_000


def repaired(blocks: DataFrame) -> DataFrame:
    """(file_id, part, pages, text, goes_on): each file's pages as continuous text in readable paragraphs.

    A file of more than PART blocks comes in parts, so that no task holds an unbounded file. A
    word cut between two parts stands whole in the first and not in the second; goes_on says that
    the last paragraph goes on in the next part. Files without pages have no row.
    """
    found = noise(blocks)
    marks = found.groupBy("block_id").agg(F.collect_list(F.struct("line", "kind", "seen", "word")).alias("marks"))
    place = [F.col("file_id").cast("bigint").alias("file_id"), F.col("block_id").cast("bigint").alias("block_id"), "page_number", "block_no", F.floor(F.coalesce("block_no", F.lit(0)) / PART).cast("int").alias("part")]
    paged = blocks.where("page_number > 0 and text is not null")
    pages = paged.select(*place, "text").join(marks, "block_id", "left")
    row = F.struct("page_number", "block_no", "block_id", "text", "marks")
    grouped = pages.groupBy("file_id", "part").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    # the last page of a part, where a word cut over to the next page may stand; pages that end one are few
    ends = paged.select(*place).groupBy("file_id", "part").agg(F.max(F.struct("page_number", "block_no", "block_id")).alias("last")).select("file_id", (F.col("part") + 1).alias("part"), F.col("last.block_id").alias("block_id"))
    ends = ends.join(paged.select(*place).select("file_id", "part").distinct(), ["file_id", "part"], "left_semi")
    over = found.where("kind = 'hyphen'").groupBy("block_id").agg(F.max("line").alias("line"))
    begun = ends.join(over.join(_last_lines(paged.join(ends.select(F.col("block_id").alias("_b")), F.col("block_id") == F.col("_b"), "left_semi"), found), ["block_id", "line"]), "block_id").select("file_id", "part", F.lit(True).alias("begun"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, on = [], [], []
            for rows, starts in zip(b.column("rows").to_pylist(), b.column("begun").to_pylist()):
                counts.append(len(rows))
                text, goes_on = repair_pages([(r["text"], [(m["line"], m["kind"], m["seen"], m["word"]) for m in r["marks"] or []]) for r in rows], bool(starts))
                texts.append(text), on.append(goes_on)
            yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("part"), pa.array(counts, pa.int32()), pa.array(texts, pa.string()), pa.array(on, pa.bool_())], names=["file_id", "part", "pages", "text", "goes_on"])

    return grouped.join(begun, ["file_id", "part"], "left").mapInArrow(run, "file_id bigint, part int, pages int, text string, goes_on boolean")


def _last_lines(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(block_id, line): the last line with text of each page that is not furniture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, lines = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                foot = edges(text.split("\n"))[1] if text else []
                take += [i] * len(foot)
                lines += foot
            yield pa.RecordBatch.from_arrays([b.column("block_id").take(pa.array(take, pa.int64())), pa.array(lines, pa.int32())], names=["block_id", "line"])

    feet = pages.select(F.col("block_id").cast("bigint"), "text").mapInArrow(run, "block_id bigint, line int")
    off = found.where("kind in ('header', 'page_no')").select("block_id", "line")
    return feet.join(off, ["block_id", "line"], "left_anti").groupBy("block_id").agg(F.max("line").alias("line"))
