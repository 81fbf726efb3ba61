"""Evaluation items that stand, wholly or in part, in corpus documents.

Items and documents are brought to one form: accents, case, punctuation, spacing, line breaks,
invisible characters and markup are removed, so that only a stream of letters and digits is
left. The patterns of one Aho-Corasick automaton are the items cut into anchors of half a run:
any ``run`` consecutive words of an item hold a whole anchor. Each document's stream is scanned
once; from an anchor that is found the match is followed to both sides for as long as item and
document agree, and counts if it holds ``run`` whole words. A pair is reported where such
stretches cover at least ``share`` of the item's words; they are mapped back to offsets of the
original text.

The items are a held-out set, small beside the corpus. They are sent to the workers in blocks
of about ``block_bytes`` of text. One block has one automaton that a worker keeps. Of several, a
worker holds one automaton at a time: it reads texts up to ROUND_CHARS, takes them through the
automaton of each block in turn, and goes on, so the corpus is read once whatever the number of items.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words a stretch must have, and the share of an item's words that must stand in such stretches.
RUN, SHARE = 8, 0.5
#: Text of the items that one automaton is built from (about 60 bytes of memory for each of its letters).
BLOCK_BYTES = 2 << 20
#: Characters of texts that a worker holds while it takes them through the automata of several blocks.
ROUND_CHARS = 32 << 20

_MARKUP = re.compile(
    r"<!--(?:[^<]|<(?!!--))*?-->"
    r"|</?[A-Za-z][^<>\s]*>"
    r"|<[A-Za-z][\w:.-]*(?:\s+[\w:@.-]+(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>]+))?)*+\s*/?>"
    r"|&(?:#\d{1,7}|#x[0-9A-Fa-f]{1,6}|[A-Za-z]{2,8});"
    r"|\]\([^()\s]+(?:\([^()\s]*\)[^()\s]*)*+(?:\s+\"[^\"()]*\")?\)"
)
_WORD = re.compile(r"[^\W_]+")
_DROP = re.compile(r"[\W_]+")
_MARKS = re.compile("[̀-ͯ­​-‏⁠-⁤﻿︀-️]+")
_MAY_HOLD_MARKUP = re.compile(r"[<&]|\]\(")


def _plain(text: str) -> str:
    """Text without markup, accents, invisible characters and case; word boundaries are kept."""
    if _MAY_HOLD_MARKUP.search(text):
        text = _MARKUP.sub("", text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return text.casefold()


def words(text: str) -> list[str]:
    """The words by which items are counted; marks of emphasis inside a word don't divide it."""
    return _WORD.findall(re.sub(r"[*_`~]+", "", _plain(text)))


def stream(text: str) -> str:
    """The letters and digits of a text alone."""
    return _DROP.sub("", _plain(text))


def stream_offsets(text: str) -> tuple[str, list[int]]:
    """stream(text) and for each of its characters the offset in text that it comes from."""
    gone = bytearray(len(text))
    for m in _MARKUP.finditer(text) if _MAY_HOLD_MARKUP.search(text) else ():
        gone[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    out, at = [], []
    for i, ch in enumerate(text):
        if gone[i]:
            continue
        for c in stream(ch):
            out.append(c)
            at.append(i)
    return "".join(out), at


def _agree(a: str, i: int, b: str, j: int) -> int:
    """How many characters a from i and b from j have in common."""
    n, most, step = 0, min(len(a) - i, len(b) - j), 32
    while n < most:
        k = min(step, most - n)
        if a[i + n : i + n + k] == b[j + n : j + n + k]:
            n, step = n + k, step * 2
        elif k == 1:
            break
        else:
            step = k // 2
    return n


class ItemIndex:
    """The automaton over the anchors of a block of items.

    An item of fewer words than a run is one run of all its words. Items without words never
    match.
    """

    def __init__(self, items: list[tuple[int, str]], run: int = RUN):
        import ahocorasick

        #: of each item: letters, the same backwards, where its words start (and the end), words of a run
        self.items: dict[int, tuple[str, str, list[int], int]] = {}
        where: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            w = words(text)
            if not w:
                continue
            starts = [0]
            for x in w:
                starts.append(starts[-1] + len(x))
            need = min(run, len(w))
            letters = "".join(w)
            self.items[item] = (letters, letters[::-1], starts, need)
            step = (need + 1) // 2
            for i in range(0, len(w) - step + 1, step):
                where.setdefault(letters[starts[i] : starts[i + step]], []).append((item, starts[i]))
        self.automaton = ahocorasick.Automaton()
        for key, places in where.items():
            self.automaton.add_word(key, (len(key), places))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def find(self, text: str, share: float = SHARE) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
        """(item, words, words covered, stretches in the original text) of each leaked item."""
        if self.empty or not text:
            return []
        covered: dict[int, set[int]] = {}
        spans: dict[int, list[tuple[int, int]]] = {}
        followed: dict[tuple[int, int], int] = {}  # up to where a match of an item at a shift has been followed
        letters, back = stream(text), None
        for end, (size, places) in self.automaton.iter(letters):
            for item, at in places:
                begin = end - size + 1
                if end < followed.get((item, begin - at), -1):
                    continue
                own, own_back, starts, need = self.items[item]
                right = at + size + _agree(letters, end + 1, own, at + size)
                followed[item, begin - at] = begin - at + right
                if back is None:
                    back = letters[::-1]
                left = at - _agree(back, len(letters) - begin, own_back, len(own) - at)
                first, last = bisect_left(starts, left), bisect_right(starts, right) - 1
                if last - first >= need:
                    covered.setdefault(item, set()).update(range(first, last))
                    spans.setdefault(item, []).append((begin - at + starts[first], begin - at + starts[last]))
        out, at = [], None
        for item, have in covered.items():
            n = len(self.items[item][2]) - 1
            if len(have) >= share * n:
                if at is None:
                    at = stream_offsets(text)[1]
                merged: list[list[int]] = []
                for a, b in sorted(spans[item]):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                out.append((item, n, len(have), [(at[a], at[b - 1] + 1) for a, b in merged]))
        return sorted(out)


@functools.lru_cache(maxsize=2)
def _index(items: tuple[tuple[int, str], ...], run: int) -> ItemIndex:
    return ItemIndex(list(items), run)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _rows(index: ItemIndex, ids: list, texts: list, share: float, kind: pa.DataType) -> pa.RecordBatch:
    rows = [(d, *hit) for d, t in zip(ids, texts) if t for hit in index.find(t, share)]
    cols = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays(
        [
            pa.array(cols[0], kind),
            pa.array(cols[1], pa.int64()),
            pa.array(cols[2], pa.int32()),
            pa.array(cols[3], pa.int32()),
            pa.array([[{"start": x, "end": y} for x, y in s] for s in cols[4]], _SPANS),
        ],
        names=["doc_id", "item_id", "item_words", "found_words", "stretches"],
    )


def _scan(blocks: list, run: int, share: float, round_chars: int):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(blocks[0].value, run)
        for b in batches:
            yield _rows(index, b.column(0).to_pylist(), b.column(1).to_pylist(), share, b.schema.field(0).type)

    def in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0

        def through() -> Iterator[pa.RecordBatch]:
            for shared in blocks:
                yield _rows(ItemIndex(list(shared.value), run), ids, texts, share, pa.int64())
                if hasattr(shared, "_value"):
                    del shared._value  # it is read from the worker's disk again in the next round

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    ids.append(d), texts.append(t)
                    held += len(t)
                    if held >= round_chars:
                        yield from through()
                        ids, texts, held = [], [], 0
        if texts:
            yield from through()

    return kept if len(blocks) == 1 else in_turn


def leaked_items(documents: DataFrame, items: DataFrame, run: int = RUN, share: float = SHARE, block_bytes: int = BLOCK_BYTES, round_chars: int = ROUND_CHARS) -> DataFrame:
    """Each document and evaluation item where the item leaked into the document.

    In: documents (doc_id, text), items (item_id, text); other columns are ignored. Out: doc_id,
    item_id, item_words, found_words and stretches, an array of (start, end) offsets in the
    document's text in characters. Null and empty texts leak nothing. Repeated documents and
    items each come out under their own id; a row given twice comes out twice.
    """
    spark = documents.sparkSession
    usable = items.where("item_id is not null and length(text) > 0").select("item_id", "text").dropDuplicates()
    size = usable.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    parts = []
    for k in range(blocks):
        part = usable if blocks == 1 else usable.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        parts.append(spark.sparkContext.broadcast(tuple(sorted((r[0], r[1]) for r in part.toLocalIterator()))))
    schema = "doc_id bigint, item_id bigint, item_words int, found_words int, stretches array<struct<start:int,end:int>>"
    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_scan(parts, run, share, round_chars), schema)
