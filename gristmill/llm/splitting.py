"""Cutting texts over a token limit into pieces at natural boundaries.

A text is read as units (white space and the word after it), each with its token count and the
strength of the boundary before it: heading, paragraph, line, sentence, clause, word. The
strengths go into a sparse table of range maxima, so the strongest boundary in any window of
units takes two look-ups. Each piece ends at the strongest boundary in the window of permitted
lengths (ties go right, to the longer piece); the next piece starts at the strongest boundary
near the place that lies the overlap before that end.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.tokens import SPACE, UNIT, VOCABULARY, BpeCounter, counter, shipped

#: A piece but the last has at least this share of the limit's tokens where its words allow it.
FILL = 0.5
_LEAD = re.compile(f"^[{SPACE}]+")
_SENTENCE_END = re.compile("[.!?…][\"'’”»)\\]*_]*$")
_CLAUSE_END = re.compile("[,;:–—][\"'’”»)\\]*_]*$")
_HEADING = re.compile(r"^(?:#{1,6}$|#{1,6}\S|={3,}|-{3,}$)")
WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH, HEADING = 1, 2, 3, 4, 5, 6


class Splitter:
    def __init__(self, tokens: BpeCounter, fill: float = FILL):
        self.tokens, self.fill = tokens, fill
        self._codes: dict[str, int] = {}

    def _code(self, unit: str) -> int:
        """tokens, strength of the boundary before the unit, and of the one after its word, as one number."""
        code = self._codes.get(unit)
        if code is None:
            if len(self._codes) > 1_000_000:
                self._codes.clear()
            m = _LEAD.match(unit)
            space, word = (m.group(), unit[m.end() :]) if m else ("", unit)
            lines = space.count("\n") + space.count(" ")
            lead = HEADING if lines and _HEADING.match(word) else PARAGRAPH if lines > 1 else LINE if lines else WORD
            tail = SENTENCE if _SENTENCE_END.search(word) else CLAUSE if _CLAUSE_END.search(word) else WORD
            code = self.tokens.count_unit(unit) << 8 | lead << 4 | tail
            if len(unit) <= 64:
                self._codes[unit] = code
        return code

    def codes(self, units: list[str]) -> np.ndarray:
        known = self._codes
        try:
            return np.fromiter((known[u] for u in units), np.int64, len(units))
        except KeyError:
            return np.fromiter((self._code(u) for u in units), np.int64, len(units))

    def _small(self, unit: str, limit: int) -> list[str]:
        """A unit of more tokens than the limit in parts within it."""
        if len(unit) == 1 or self.tokens.count_unit(unit) <= limit:
            return [unit]
        half = len(unit) // 2
        return self._small(unit[:half], limit) + self._small(unit[half:], limit)

    def split(self, text: str | None, limit: int | None, overlap: int | None = 0) -> list[tuple[int, int, int]]:
        """(start, end, tokens) of each piece, in characters of the text.

        A text within the limit, or without a limit (null or below 1), is one piece; null and
        empty texts have none. An overlap that is null or negative is 0; one of the limit or more
        counts as the limit less 1. Pieces always move on, by a word at least.
        """
        if not text:
            return []
        units = UNIT.findall(text)
        codes = self.codes(units)
        total = int((codes >> 8).sum())
        if not limit or limit < 1 or total <= limit:
            return [(0, len(text), total)]
        overlap = min(max(0, overlap or 0), limit - 1)
        # what a piece has beyond the overlap at least, and how far from its place the overlap may begin
        least, slack = max(1, int(limit * self.fill), overlap + (limit - overlap) // 4), min(overlap / 4, (limit - overlap) / 8)
        if int((codes >> 8).max()) > max(1, limit // 4):
            part = max(1, limit // 4)
            small = [self._small(u, part) if c >> 8 > part else [u] for u, c in zip(units, codes.tolist())]
            inner = np.fromiter((i > 0 for s in small for i in range(len(s))), bool)
            units = [u for s in small for u in s]
            codes = self.codes(units)
        else:
            inner = None
        n = len(units)
        cum = np.concatenate(([0], np.cumsum(codes >> 8)))
        at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, units), np.int64, n))))
        strength = np.zeros(n + 1, np.int64)
        strength[1:n] = np.maximum(codes[1:] >> 4 & 15, codes[:-1] & 15)
        if inner is not None:
            strength[:n][inner] = 0
        table = [strength * (n + 1) + np.arange(n + 1)]
        while 2 << (len(table) - 1) <= n + 1:
            t, step = table[-1], 1 << (len(table) - 1)
            table.append(np.maximum(t[:-step], t[step:]))

        def best(lo: int, hi: int) -> int:
            """The strongest boundary from lo to hi, both included; of equal ones the last."""
            k = (hi - lo + 1).bit_length() - 1
            return int(max(table[k][lo], table[k][hi + 1 - (1 << k)])) % (n + 1)

        pieces, i, done = [], 0, 0
        while True:
            if cum[n] - cum[i] <= limit:
                pieces.append((int(at[i]), int(at[n]), int(cum[n] - cum[i])))
                return self._exact(text, pieces, limit) if inner is not None else pieces
            hi = int(np.searchsorted(cum, cum[i] + limit, "right")) - 1
            lo = int(np.searchsorted(cum, cum[i] + least, "left"))
            hi = max(hi, done + 1, i + 1)
            lo = min(max(lo, done + 1, i + 1), hi)
            j = best(lo, hi)
            pieces.append((int(at[i]), int(at[j]), int(cum[j] - cum[i])))
            done = j
            if overlap:
                a = int(np.searchsorted(cum, math.floor(cum[j] - overlap - slack), "left"))
                b = int(np.searchsorted(cum, math.floor(cum[j] - overlap + slack), "right")) - 1
                fits = int(np.searchsorted(cum, cum[j + 1] - limit, "left"))  # from here the next word is within the limit
                a = max(a, i + 1, fits)
                i = best(a, max(a, b)) if a < j else j
            else:
                i = j

    def _exact(self, text: str, pieces: list[tuple[int, int, int]], limit: int) -> list[tuple[int, int, int]]:
        """Pieces that start or end inside a long unit, counted as they stand and halved if over the limit."""
        out: list[tuple[int, int, int]] = []
        for a, b, _ in pieces:
            todo = [(a, b)]
            while todo:
                x, y = todo.pop()
                if out and y <= out[-1][1]:
                    continue  # half of a piece, all of which the one before it holds
                if out and x <= out[-1][0]:
                    x = out[-1][1]
                n = self.tokens.count(text[x:y])
                if n <= limit or y - x == 1:
                    out.append((x, y, n))
                else:
                    m = (x + y) // 2
                    todo += [(m, y), (x, m)]
        return out


def _cut(path: str, fill: float, with_text: bool, with_extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(counter(path), fill)
        names = ["doc_id", *with_extra, "piece_no", "pieces", "start", "end", "tokens"] + ["text"] * with_text
        for b in batches:
            take, no, of, start, end, tokens, texts = [], [], [], [], [], [], []
            cols = [b.column(c).to_pylist() for c in ("text", "max_tokens", "overlap_tokens")]
            for r, (text, limit, overlap) in enumerate(zip(*cols)):
                pieces = splitter.split(text, limit, overlap)
                for k, (x, y, n) in enumerate(pieces):
                    take.append(r), no.append(k + 1), of.append(len(pieces)), start.append(x), end.append(y), tokens.append(n)
                    if with_text:
                        texts.append(text[x:y])
            at = pa.array(take, pa.int64())
            ints = [pa.array(x, pa.int32()) for x in (no, of, start, end, tokens)]
            yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in ("doc_id", *with_extra)] + ints + [pa.array(texts, pa.string())] * with_text, names=names)

    return run


def split_documents(documents: DataFrame, limits: DataFrame, path: str = VOCABULARY, fill: float = FILL, with_text: bool = True) -> DataFrame:
    """Numbered pieces of each document within the token limit of its source.

    In: documents (doc_id, source, text), limits (source, max_tokens, overlap_tokens), one row
    for each source. Out: doc_id, source, piece_no (from 1), pieces, start, end (characters of
    the document's text), tokens and, unless with_text is off, text. A piece's text is exactly
    the document's between start and end. Documents of a source without a limit come whole, as
    one piece; null and empty texts give no piece. Repeated rows are cut each by itself; of
    several limits of one source the smallest holds.
    """
    cap = limits.groupBy("source").agg(F.min("max_tokens").alias("max_tokens"), F.min("overlap_tokens").alias("overlap_tokens"))
    rows = shipped(documents, path).select("doc_id", "source", "text").join(cap, "source", "left")
    schema = "doc_id bigint, source string, piece_no int, pieces int, start int, `end` int, tokens int" + ", text string" * with_text
    return rows.select(F.col("doc_id").cast("bigint"), "source", "text", "max_tokens", "overlap_tokens").mapInArrow(_cut(path, fill, with_text, ["source"]), schema)
