r"""Text garbled by decoding with the wrong character encoding.

Every distinct clean word of the corpus that has a character beyond ASCII is written in all the
garbled forms it can take: encoded in one encoding and read in another, once, twice (in every pair
of the encodings) or three times over (in the same one), or with characters replaced on the way. Documents' tokens are hash-joined against this table of
forms. A match is verified by how often word and form occur, and substituted.

Words are runs of letters, digits and characters beyond ASCII; runs of such characters at the
edge of a word (quotation marks, dashes) count as words of their own, so that marks around a
rare name are found too.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.session import durable

#: Encodings as which UTF-8 bytes are read by mistake, and those taken for each other.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251")
SINGLE = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251")
#: How many times as often as its garbled form a word occurs where that form could be a word itself.
TIMES = 4
#: Letters a word has at least for its forms by chains that write one character as one other to be evidence by themselves.
#: Shorter words of this kind are put right where another word of their block shows the chain.
LETTERS = 3

#: Letters of Western languages, and marks around and inside words.
_LETTER = "àáâãäåæçèéêëìíîïñòóôõöøœùúûüýÿßÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØŒÙÚÛÜÝ"
_OPEN, _CLOSE, _INNER = "“„«‘‹¿¡", "”“»’›…", "’‘·–"
_WORD = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]*+[^\x00-\x7F](?:[A-Za-z0-9]|[^\x00-\x7F])*")
_ASKED = re.compile(r"(?<![A-Za-z?])[A-Za-z]*+\?[A-Za-z?]*[A-Za-z][A-Za-z?]*")


def _cased(script: str) -> str:
    """The pattern of a word of one script: in lower case, with a capital, or in capitals."""
    up, low, any_ = (f"[\\p{{{x}}}&&\\p{{Script={script}}}]" for x in ("Lu", "Ll", "L"))
    return f"(?:{up}?(?:{low}|[0-9])+|(?:{up}|[0-9])+)(?:[{_INNER}](?:{any_}|[0-9])+)*"


#: A word of one script with usual marks around it, or marks alone.
CLEAN = regex.compile(f"^(?:[{_OPEN}]*(?:{_cased('Latin')}|{_cased('Greek')}|{_cased('Cyrillic')}|[\\p{{Lo}}\\p{{M}}0-9]+)[{_CLOSE}]*|[{_OPEN}{_CLOSE}–—€£§°]+)$", regex.V1)
_A_LETTER = regex.compile(r"\p{L}")
#: What any garbled form has, but for some of the chains in SINGLE: a character that clean words of Western languages lack,
#: or one that begins a UTF-8 letter in READ_AS.
SUSPECT = re.compile(f"[^\\x00-\\x7F{_LETTER}{_OPEN}{_CLOSE}{_INNER}—€\\u00AC\\u00AD\\u2010\\u2500-\\u2503\\u2514\\u251C]|\\?|[ÃÂâÅÔ]|\\u00AC.|\\u251C[^\\u2500]")


def letters(word: str) -> int:
    return len(_A_LETTER.findall(word))


class _Bytes(dict):
    """Bytes, as numbers, as a lenient reader of an encoding shows them: what the encoding leaves open keeps its number."""

    def __init__(self, encoding: str):
        super().__init__((b, bytes([b]).decode(encoding, "ignore") or chr(b)) for b in range(256))


class _Misread(dict):
    """Characters as their UTF-8 bytes read in an encoding, filled as they are asked for."""

    def __init__(self, encoding: str):
        super().__init__()
        self.bytes = _BYTES[encoding]

    def __missing__(self, code: int) -> str:
        self[code] = out = chr(code).encode("utf-8", "surrogatepass").decode("latin-1").translate(self.bytes)
        return out


_BYTES = {e: _Bytes(e) for e in {*READ_AS, *SINGLE}}
_MISREAD = {e: _Misread(e) for e in READ_AS}


def _read(data: bytes, encoding: str) -> str:
    """Bytes as a lenient reader of an encoding shows them."""
    return data.decode("latin-1").translate(_BYTES[encoding])


def forms(word: str) -> list[tuple[str, str, bool]]:
    """(garbled form, chain, lost) of a word, for every chain that changes it.

    lost: the original can't be had back from the form.
    """
    data = word.encode("utf-8", "surrogatepass")
    out: dict[str, tuple[str, bool]] = {}

    def add(form: str, chain: str, lost: bool) -> None:
        if form != word:
            out.setdefault(form, (chain, lost))

    first = {e: word.translate(_MISREAD[e]) for e in READ_AS}
    for e, once in first.items():
        add(once, f"utf-8>{e}", False)
    for e, once in first.items():
        for e2 in READ_AS:
            twice = once.translate(_MISREAD[e2])
            add(twice, f"utf-8>{e}>utf-8>{e2}", False)
            if e == e2:
                add(twice.translate(_MISREAD[e2]), f"utf-8>{e}>utf-8>{e2}>utf-8>{e2}", False)
    for e in SINGLE:
        try:
            raw = word.encode(e)
        except UnicodeEncodeError:
            continue
        for e2 in SINGLE:
            if e2 != e:
                add(_read(raw, e2), f"{e}>{e2}", False)
        add(raw.decode("utf-8", "replace"), f"{e}>utf-8", True)
    add(data.decode("ascii", "replace"), "utf-8>ascii", True)
    add(re.sub(r"[^\x00-\x7f]", "�", word), "replaced", True)
    add(word.encode("ascii", "replace").decode(), "ascii", True)
    for e, once in first.items():
        add(once.encode("ascii", "replace").decode(), f"utf-8>{e}>ascii", True)
    return [(f, c, lost) for f, (c, lost) in out.items()]


def _evidence(word: str) -> list[tuple[str, str, bool]]:
    """The forms by which a word is found."""
    out = forms(word)
    return out if letters(word) >= LETTERS else [x for x in out if x[2] or x[1].startswith("utf-8")]


def _form_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(f, w, n, c, lost) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for f, c, lost in _evidence(w)]
        cols = list(zip(*rows)) if rows else [()] * 5
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["form", "word", "word_n", "chain", "lost"])


@functools.lru_cache(maxsize=1 << 18)
def _kind(piece: str) -> tuple[bool, bool]:
    """(clean, suspect); a form of a chain in SINGLE may consist of usual letters and marks only."""
    return bool(CLEAN.match(piece)), bool(SUSPECT.search(piece)) or letters(piece) >= LETTERS


@functools.lru_cache(maxsize=1 << 18)
def _with_edges(word: str) -> tuple[str, ...]:
    """A word and the runs beyond ASCII at its edges."""
    m = re.match(r"([^\x00-\x7F]*)(.*[A-Za-z0-9])([^\x00-\x7F]*)$", word, re.S)
    return tuple(x for x in (word, m[1], m[3]) if x) if m else (word,)


def pieces(text: str) -> set[str]:
    """The words of a text that have a character beyond ASCII or a question mark inside."""
    found: set[str] = set()
    if not text.isascii():
        for w in set(_WORD.findall(text)):
            found.update(_with_edges(w))
    if "?" in text:
        found.update(_ASKED.findall(text))
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct word of a batch: how often it stands there as a clean word, and the blocks where it is suspect."""
    for b in batches:
        words: dict[str, list] = {}
        for block, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for p in pieces(text) if text else ():
                is_clean, suspect = _kind(p)
                if is_clean or suspect:
                    row = words.get(p)
                    if row is None:
                        row = words[p] = [0, []]
                    row[0] += is_clean
                    if suspect:
                        row[1].append(block)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(words), pa.string()), pa.array([n for n, _ in words.values()], pa.int64()), pa.array([x for _, x in words.values()], pa.list_(pa.int64()))],
            names=["piece", "n", "blocks"],
        )


def garbled_words(blocks: DataFrame) -> DataFrame:
    """(block_id, piece, word, chain, lost): each garbled word of each block with its original.

    For a form of several words the one that most often occurs is taken, then the first in
    order of the alphabet. The texts are read once: their suspect words with the blocks they
    stand in, and the counts of clean ones, a row for each word of a batch, are written down
    and used from there.
    """
    texts = blocks.where("text is not null").select(F.col("block_id").cast("bigint"), "text")
    seen = durable(texts.mapInArrow(_scan, "piece string, n bigint, blocks array<bigint>"))
    counts = seen.groupBy("piece").agg(F.sum("n").alias("n"), F.sum(F.size("blocks")).alias("piece_n"))
    # spread by number, as each of these few rows becomes some hundred
    spread = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = counts.where("n > 0").select("piece", "n").repartition(spread).mapInArrow(_form_batches, "form string, word string, word_n bigint, chain string, lost boolean")
    # merged, as what the forms take can't be told from the few words they are made of, so a broadcast of them would go unchecked
    hit = counts.where("piece_n > 0").join(table.hint("merge"), F.col("piece") == F.col("form")).where(f"n = 0 or word_n >= {TIMES} * piece_n")
    best = hit.groupBy("piece").agg(F.max_by(F.struct("word", "chain", "lost"), F.struct(~F.col("lost"), F.col("word_n"), -F.length("chain"), "word")).alias("as"))
    best = best.select("piece", "as.word", "as.chain", "as.lost")
    return seen.where(F.size("blocks") > 0).join(best, "piece").select(F.explode("blocks").alias("block_id"), "piece", "word", "chain", "lost").distinct()


def garbled_blocks(blocks: DataFrame) -> DataFrame:
    """(block_id, outcome) of each block with garbled text.

    outcome: ``lost`` if characters of any garbled word were destroyed, else ``whole``. Null,
    empty and ASCII texts without replacement marks are not garbled. Repeated rows of a
    block_id count as one block.
    """
    words = garbled_words(blocks)
    return words.groupBy("block_id").agg(F.when(F.max("lost"), "lost").otherwise("whole").alias("outcome"))


@functools.lru_cache(maxsize=None)
def _back(encoding: str) -> dict[str, int]:
    return {c: b for b, c in reversed(_BYTES[encoding].items())}


def undo(piece: str, chain: str) -> str | None:
    """A piece decoded back along a chain, if every step works out and doing it again gives the piece."""
    steps = chain.split(">")
    text = piece
    try:
        for read, wrote in zip(reversed(steps[1::2]), reversed(steps[0::2])):
            text = bytes(_back(read)[c] for c in text).decode(wrote)
    except (KeyError, UnicodeDecodeError, LookupError):
        return None
    return text if any(f == piece for f, c, _ in forms(text) if c == chain) else None


def restore(text: str, known: dict[str, str], chains: list[str]) -> str:
    """The text with its garbled words put right: those known, and others that a chain of the block undoes."""

    def put(m: re.Match) -> str:
        p = m.group()
        if p in known:
            return known[p]
        e = re.match(r"([^\x00-\x7F]*)(.*[A-Za-z0-9])([^\x00-\x7F]*)$", p, re.S)
        q = known.get(e[1], e[1]) + known.get(e[2], e[2]) + known.get(e[3], e[3]) if e else p
        for c in chains:
            if (w := undo(q, c)) is not None and CLEAN.match(w):
                return w
        return q

    return _ASKED.sub(put, _WORD.sub(put, text))


def restored(blocks: DataFrame) -> DataFrame:
    """(block_id, outcome, text): the affected blocks with their original text as far as it can be had.

    Words whose characters were destroyed are given as the corpus word that fits them best.
    Repeated rows of a block_id are each restored.
    """
    by_block = garbled_words(blocks).groupBy("block_id").agg(
        F.when(F.max("lost"), "lost").otherwise("whole").alias("outcome"),
        F.collect_set(F.when(~F.col("lost") | F.col("piece").rlike("[A-Za-z]"), F.struct("piece", "word"))).alias("known"),
        F.collect_set(F.when(~F.col("lost"), F.col("chain"))).alias("chains"),
    )
    rows = blocks.select("block_id", "text").join(by_block, "block_id").select("block_id", "outcome", "text", "known", "chains")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("text", "known", "chains")]
            texts = [restore(t, {k["piece"]: k["word"] for k in known}, sorted(chains)) for t, known, chains in zip(*cols)]
            yield pa.RecordBatch.from_arrays([b.column("block_id"), b.column("outcome"), pa.array(texts, pa.string())], names=["block_id", "outcome", "text"])

    return rows.mapInArrow(run, "block_id bigint, outcome string, text string")
