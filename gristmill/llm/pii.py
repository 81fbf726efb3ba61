"""Personal information in free text: found by a conditional random field and replaced by its type.

A text is read as tokens. Each token has features of its shape, its affixes, the word itself and
the kind of stretch without spaces it stands in (one with an @ or of a link); a linear-chain conditional random field scores the labels of a token
by the features of the five tokens around it and by the label before. The weights are trained
from the labelled table in ``pii_table`` (``python -m gristmill.llm.pii_train``) and kept in
``pii_weights.npz``. The scores of a distinct token are looked up once for all its occurrences,
so scoring is gathering and adding rows; the best labels of many texts are found together by
Viterbi's algorithm in numpy.
"""

from __future__ import annotations

import functools
import io
import os
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Tokens on each side whose features a label sees.
REACH = 3
WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.npz")
#: Distinct tokens a worker remembers before it starts afresh (about 350 bytes each).
REMEMBERED = 200_000
#: Tokens that are decoded in one sequence; longer texts are gone through in such stretches, each sharing SHARED tokens
#: with the next. Two stretches are joined where both have no item; where there is no such place they are decoded as one.
LONGEST, SHARED = 4_000, 400

#: Words, line breaks, marks; the sign for "number" with its point is one token.
_TOKEN = re.compile(r"(?<![^\W_])[Nn](?:[or]\.|\.?[º°])|[^\W_]+|\s*\n\s*|[^\w\s]|_")
_CHUNK = re.compile(r"\S*@\S*|\S*://\S*")
_IN_EMAIL = re.compile(r"[\w.+%-]+")
_LONG_NUMBER = re.compile(r"\d{4,}")
_ALLOWED = np.zeros((len(LABELS), len(LABELS)), bool)
for _i, _a in enumerate(LABELS):
    for _j, _b in enumerate(LABELS):
        _ALLOWED[_i, _j] = _b[0] != "I" or (_a[0] != "O" and _a[1:] == _b[1:])


def _key(token: str) -> str:
    """A token as its features see it: long numbers by their first two digits and their length."""
    if "\0" in token:
        word, _, chunk = token.partition("\0")
        return f"{_key(word)}\0{chunk}"
    if "\n" in token:
        return "\n\n" if token.count("\n") > 1 else "\n"
    return _LONG_NUMBER.sub(lambda m: m.group()[:2] + "#" * (len(m.group()) - 2), token) if len(token) > 3 and not token.isalpha() else token


def read(text: str) -> tuple[list[str], list[str], list[int] | None]:
    """(tokens, the same with the kind of chunk they are of, number of the chunk) of a text; the last is none where there is no chunk."""
    if "@" not in text and "://" not in text:
        tokens = _TOKEN.findall(text)
        return tokens, tokens, None
    tokens, keys, chunks, at = [], [], [], 0
    for k, m in enumerate(_CHUNK.finditer(text), 1):
        before, inside = _TOKEN.findall(text[at : m.start()]), _TOKEN.findall(m.group())
        kind = "u" if "://" in m.group() else "@" if re.search(r"\w@\w", m.group()) else "h"
        tokens += before + inside
        keys += before + [f"{t}\0{kind}" for t in inside]
        chunks += [0] * len(before) + [k] * len(inside)
        at = m.end()
    rest = _TOKEN.findall(text[at:])
    return tokens + rest, keys + rest, chunks + [0] * len(rest)


def features(key: str) -> list[str]:
    """The features of a token."""
    key, _, chunk = key.partition("\0")
    if chunk:
        return [*features(key), f"c{chunk}", f"c{chunk}{key if not key.isalnum() else ''}"]
    if key in ("\n", "\n\n", ""):
        return [f"={key!r}"]
    low = key.lower()
    shape = re.sub(r"[\d#]", "9", re.sub(r"[^\W\d_]", lambda m: "X" if m.group().isupper() else "x", key))
    short = re.sub(r"(.)\1+", r"\1+", shape)
    out = [f"s{short}", f"l{min(len(key), 12)}{short[0]}"]
    if len(key) <= 14:
        out.append(f"w{low}")
    if any(c in "9" for c in shape):
        out.append(f"S{shape[:18]}")
        out.append(f"d{key[:2]}{len(key)}")
        out.append(f"e{key[:1]}{shape[:18]}")
    elif len(key) > 2:
        out += [f"p{low[:2]}", f"p{low[:3]}", f"p{low[:4]}", f"f{low[-2:]}", f"f{low[-3:]}", f"f{low[-4:]}", f"P{short}{low[:3]}", f"F{short}{low[-3:]}"]
    return out


class Tagger:
    def __init__(self, names: list[str], weights: np.ndarray, moves: np.ndarray):
        """weights: features x (2 * REACH + 1) x labels; moves: labels x labels."""
        self.at = {n: i for i, n in enumerate(names)}
        self.weights = weights.reshape(len(names), -1).astype(np.float32)
        self.moves = np.where(_ALLOWED, moves, -1e4).astype(np.float32)
        self._reset()

    def _reset(self) -> None:
        self.rows = np.zeros((4096, self.weights.shape[1]), np.float32)
        self.known: dict[str, int] = {}
        self.keys: dict[str, int] = {}
        self.row("")

    def row(self, token: str) -> int:
        i = self.known.get(token)
        if i is None:
            key = _key(token)
            i = self.keys.get(key)
            if i is None:
                i = len(self.keys)
                if i == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.keys[key] = i
                have = [self.at[f] for f in features(key) if f in self.at]
                if have:
                    self.rows[i] = self.weights[have].sum(0)
            self.known[token] = i
        return i

    def ids(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter((known[t] for t in tokens), np.int32, len(tokens))
        except KeyError:
            for t in set(tokens).difference(known):
                self.row(t)
            return np.fromiter((known[t] for t in tokens), np.int32, len(tokens))

    def tag(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The labels of each text's tokens."""
        if all(len(t) <= LONGEST for t in texts):
            return self._tag(texts)
        step = LONGEST - SHARED
        starts = [range(0, max(1, len(t) - SHARED), step) if len(t) > LONGEST else range(1) for t in texts]
        parts = iter(self._tag([t[a : a + LONGEST] if len(t) > LONGEST else t for t, at in zip(texts, starts) for a in at]))
        return [self._joined(t, [(a, next(parts)) for a in at]) for t, at in zip(texts, starts)]

    def _joined(self, tokens: list[str], parts: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """The labels of a text from those of its stretches: (first token, labels)."""
        a, labels = parts[0]
        for b, more in parts[1:]:
            both = len(labels) + a - b  # tokens that the two have in common
            free = (labels[b - a :] == 0) & (more[:both] == 0)
            runs = np.flatnonzero(np.convolve(free, np.ones(2 * REACH + 1), "valid") > 2 * REACH) if both > 2 * REACH else []
            if len(runs):
                k = int(runs[np.abs(runs - both // 2).argmin()]) + REACH
                labels = np.concatenate([labels[: b - a + k], more[k:]])
            else:
                (redone,) = self._tag([tokens[a : b + len(more)]])
                labels = redone
        return labels

    def _tag(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self._reset()
        n_labels = len(LABELS)
        out: list[np.ndarray] = [np.zeros(len(t), np.int8) for t in texts]
        order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: len(texts[i]))
        at = 0
        while at < len(order):
            group, cells = [], 0
            while at < len(order) and (not group or (len(group) + 1) * len(texts[order[at]]) <= 60_000):
                group.append(order[at])
                at += 1
            width = len(texts[group[-1]])
            ids = np.zeros((len(group), width + 2 * REACH), np.int32)
            lengths = np.array([len(texts[i]) for i in group])
            for r, i in enumerate(group):
                ids[r, REACH : REACH + len(texts[i])] = self.ids(texts[i])
            used, ids = np.unique(ids, return_inverse=True)
            ids = ids.reshape(len(group), -1)
            rows = self.rows[used]
            scores = np.zeros((width, len(group), n_labels), np.float32)
            for k in range(2 * REACH + 1):
                part = np.ascontiguousarray(rows[:, k * n_labels : (k + 1) * n_labels])
                scores += part[ids[:, k : k + width].T]
            labels = self._viterbi(scores, lengths)
            for r, i in enumerate(group):
                out[i] = labels[: lengths[r], r]
        return out

    def _viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best labels, for texts in order of length. scores: position x text x label."""
        width, n, n_labels = scores.shape
        best = np.empty((width, n_labels, n), np.float32)
        best[0] = scores[0].T + self.moves[0][:, None]
        free = [0, *range(1, n_labels, 2)]  # O and B- may follow any label, I- its own kind alone
        into = np.ascontiguousarray(self.moves[:, free])[:, :, None]
        inner = np.arange(2, n_labels, 2)
        from_begin, from_inner = self.moves[inner - 1, inner][:, None], self.moves[inner, inner][:, None]
        for t in range(1, width):
            at = int(np.searchsorted(lengths, t, "right"))  # texts that go on
            last, now = best[t - 1][:, at:], best[t][:, at:]
            step = last[0] + into[0]
            for k in range(1, n_labels):
                np.maximum(step, last[k] + into[k], out=step)
            now[free] = step
            now[inner] = np.maximum(last[inner - 1] + from_begin, last[inner] + from_inner)
            now += scores[t, at:].T
        labels = np.zeros((width, n), np.int8)
        here = np.arange(n)
        now = best[lengths - 1, :, here].argmax(1)
        for t in range(width - 1, -1, -1):
            at = int(np.searchsorted(lengths, t, "right"))
            labels[t, at:] = now[at:]
            if t:
                now[at:] = (best[t - 1][:, at:] + self.moves[:, now[at:]]).argmax(0)
        return labels


@functools.lru_cache(maxsize=1)
def tagger(path: str | None = None) -> Tagger:
    """The tagger of a file of weights, or of those in the package (also where that is an archive)."""
    with np.load(path or io.BytesIO(pkgutil.get_data(__package__, os.path.basename(WEIGHTS)))) as z:
        return Tagger(z["names"].tolist(), z["weights"].astype(np.float32), z["moves"].astype(np.float32))


_POSTCODE = re.compile(r"[A-Z]\d")
_NAME = re.compile(r"[^\W\d_a-zß-öø-ÿ].*[^\W\d_]{2}|[^\W\d_a-zß-öø-ÿ][^\W\d_]{2}", re.S)


def _digits_beside(tokens: list[str], labels: np.ndarray, i: int, step: int) -> bool:
    """A group of digits outside any item stands at i, or past a line break or hyphen there."""
    if 0 <= i < len(tokens) and (tokens[i].isspace() or tokens[i] == "-"):
        i += step
    return 0 <= i < len(tokens) and labels[i] == 0 and tokens[i].isdigit()


def items(tokens: list[str], labels: np.ndarray, chunks: list[int] | None = None) -> list[tuple[str, int, int]]:
    """(kind, first token, last token + 1) of each item, checked for what its kind must have.

    An address of a chunk with an @ is taken whole, and nothing in it is an item by itself.
    """
    out: list[tuple[str, int, int]] = []
    marked = np.flatnonzero(labels).tolist()
    i = 0
    while i < len(marked):
        a = marked[i]
        kind = KINDS[(int(labels[a]) - 1) // 2]
        b = a + 1
        while i + 1 < len(marked) and marked[i + 1] == b and labels[b] == 2 * KINDS.index(kind) + 2:
            i += 1
            b += 1
        i += 1
        while b > a and (tokens[b - 1].isspace() or tokens[b - 1] in ",;:("):
            b -= 1
        while a < b and (tokens[a].isspace() or tokens[a] in ",;:)"):
            a += 1
        if kind in ("phone", "id_number") and (_digits_beside(tokens, labels, a - 1, -1) or _digits_beside(tokens, labels, b, 1)):
            continue  # the middle of a longer number that isn't personal
        for a, b in _trimmed(kind, tokens, a, b, chunks):
            out = _with(out, kind, tokens, a, b)
    return out


#: Titles that a point ends, longer than an initial.
_SHORTENED = set("mr mrs ms dr prof st sr sra dra srta sig dott ing avv eng dipl dña jr phd me mme mlle don doña pr".split())

#: Small words inside names, and words with which no name begins.
_PARTICLES = set("ssa ra von van der den de la le da dos das di del della du zu zur ter y e i el al bin ibn s d o".split())
_NO_NAME_BEGINS = set("the a an of in at on for to and but or as if when while after before from by with am im der die das den dem ein eine und oder vom zum zur bei nach vor seit les un une des du en au aux il elle dans pour par avec et los las una unos con por para y el gli uno per nel nella dal os as um uma no na do ao em com".split())


def _trimmed(kind: str, tokens: list[str], a: int, b: int, chunks: list[int] | None) -> list[tuple[int, int]]:
    """The item or items that a labelled stretch holds, by what any item of its kind looks like."""
    if kind == "email" and a < b:
        if chunks is not None and "@" in tokens[a:b] and chunks[a + tokens[a:b].index("@")]:
            a = a + tokens[a:b].index("@")
            c = chunks[a]
            b = a + 1
            while a > 0 and chunks[a - 1] == c and _IN_EMAIL.fullmatch(tokens[a - 1]):
                a -= 1
            while b < len(tokens) and chunks[b] == c and _IN_EMAIL.fullmatch(tokens[b]):
                b += 1
            while b > a and not tokens[b - 1].isalnum():
                b -= 1
        else:  # written out: what stands before "at" has no two words side by side
            at = next((i for i in range(a, b) if tokens[i].lower() == "at"), a)
            i = at - 1
            while i > a and not (tokens[i].isalnum() and (tokens[i - 1].isalnum() or tokens[i - 1].isspace())):
                i -= 1
            a = max(a, i) if at > a else a
    elif kind == "phone":
        words = [i for i in range(a, b) if any(c.isalpha() for c in tokens[i])]
        a = words[-1] + 1 if words else a
        while a < b and tokens[a] not in "+(" and not tokens[a][0].isdigit():
            a += 1
        if "(" in tokens[a:b] and ")" not in tokens[a:b]:
            a += tokens[a] == "("
        if a < b and tokens[b - 1] == ")" and tokens[a:b].count("(") < tokens[a:b].count(")"):
            b -= 1
        if a < b - 1 and tokens[a] == "(" and tokens[a + 1] == "(":
            a += 1
    elif kind == "name":
        cuts = [i + 1 for i in range(a + 1, b - 1) if tokens[i] == "." and len(tokens[i - 1]) > 3 and tokens[i - 1].lower() not in _SHORTENED]
        out = []
        for x, y in zip([a, *cuts], [*cuts, b]):
            while y > x and not tokens[y - 1][0].isupper():
                y -= 1
            while y > x and tokens[x].lower() in _NO_NAME_BEGINS and len(tokens[x]) > 1:
                x += 1
            words = [t for t in tokens[x:y] if t[0].isalpha()]
            if sum(t[0].isupper() for t in words) < 2 or any(t[0].islower() and t not in _PARTICLES for t in words):
                continue
            if all(t.isupper() for t in words) and any(len(t) > 2 for t in words) and any(0 <= i < len(tokens) and tokens[i].isupper() and len(tokens[i]) > 1 for i in (x - 1, y)):
                continue  # a part of a line in capitals
            out.append((x, y))
        return out
    return [(a, b)]


def _with(out: list[tuple[str, int, int]], kind: str, tokens: list[str], a: int, b: int) -> list[tuple[str, int, int]]:
    """The items with one more, if it has what its kind must have. Nothing inside an e-mail address is an item by itself."""
    if out and a < out[-1][2]:
        if kind != "email":
            return out
        while out and a < out[-1][2]:
            out.pop()
    body = "".join(tokens[a:b])
    digits = sum(c.isdigit() for c in body)
    ok = {
        "email": lambda: len(body) > 5 and ("@" in body or "at" in body.lower()),
        "phone": lambda: digits >= 6,
        "id_number": lambda: digits >= 5,
        "address": lambda: (digits >= 4 or (digits > 2 and _POSTCODE.search(body) is not None)) and any(c.isalpha() for c in body),
        "name": lambda: digits == 0 and _NAME.match(body) is not None,
    }[kind]()
    return [*out, (kind, a, b)] if ok else out


def find(texts: list[str | None], model: Tagger | None = None) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of each item of each text, in characters and in reading order."""
    model = model or tagger()
    out = []
    seen = [read(t) if t else ([], [], None) for t in texts]
    for t, (tokens, _, chunks), y in zip(texts, seen, model.tag([k for _, k, _ in seen])):
        found = items(tokens, y, chunks) if y.any() else []
        if found:
            spans = [(m.start(), m.end()) for m in _TOKEN.finditer(t)]
            found = [(k, spans[a][0], spans[b - 1][1]) for k, a, b in found]
        out.append(found)
    return out


#: What stands in the text for an item.
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}


def mask(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    if not text or not found:
        return text
    out, at = [], 0
    for kind, a, b in found:
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join(out) + text[at:]


def _found(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tagger(path)
        for b in batches:
            seen = [read(t) if t else ([], [], None) for t in b.column("text").to_pylist()]
            take, kinds, occ = [], [], []
            for i, ((tokens, _, chunks), y) in enumerate(zip(seen, model.tag([k for _, k, _ in seen]))):
                if y.any():
                    numbers: Counter = Counter()
                    for kind, _, _ in items(tokens, y, chunks):
                        numbers[kind] += 1
                        take.append(i), kinds.append(kind), occ.append(numbers[kind])
            yield pa.RecordBatch.from_arrays([b.column("block_id").take(pa.array(take, pa.int64())), pa.array(kinds, pa.string()), pa.array(occ, pa.int32())], names=["block_id", "kind", "occ"])

    return run


def personal_items(blocks: DataFrame, path: str | None = None) -> DataFrame:
    """(block_id, kind, occ): each item of personal information; those of a kind are numbered in their text in reading order from 1.

    Null and empty texts have none. Repeated rows give their items once each.
    """
    return blocks.select(F.col("block_id").cast("bigint"), "text").mapInArrow(_found(path), "block_id bigint, kind string, occ int")


_ITEM = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def masked(blocks: DataFrame, path: str | None = None) -> DataFrame:
    """(block_id, text, items): the texts with each item replaced by its type in brackets, all else unchanged.

    items: kind, start and end of each in the original text. Null and empty texts stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tagger(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            found = find(texts, model)
            lists = [[{"kind": k, "start": a, "end": e} for k, a, e in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column("block_id"), pa.array([mask(t, f) for t, f in zip(texts, found)], pa.string()), pa.array(lists, _ITEM)], names=["block_id", "text", "items"])

    return blocks.select(F.col("block_id").cast("bigint"), "text").mapInArrow(run, "block_id bigint, text string, items array<struct<kind:string,start:int,end:int>>")
