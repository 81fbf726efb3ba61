"""Exact token counts with a byte-pair vocabulary, and token budgets by slice.

A vocabulary is compiled into a matching automaton over its tokens' bytes. The encoding of a
text is unique in this sense: a sequence of tokens is the encoding of its bytes exactly if every
two neighbours are compatible, that is, if encoding their joined bytes gives the two again. So
one pass suffices: at each position the token that ends the encoding of the prefix is the one
match whose start has an encoding and whose predecessor there is compatible with it. Only the
last token and the count of each prefix are held; no identifiers of a whole text are made.

The split pattern of the vocabulary never joins text over the start of a run of white space, so
a text is cut there into units (a run of white space and the word after it), the units of a
worker's texts are counted once each, and a text's count is the sum over its units.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.metadata import canonical_language, path_domain

#: The tokenizer whose counts are used unless another path is given (a rank file: base64 token, rank).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which this kind of vocabulary splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: Unicode's White_Space.
SPACE = "\t\n\v\f\r \x85\xa0  -     　"
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Units remembered by a worker before it starts afresh (about 100 bytes each).
REMEMBERED = 1_000_000
_ASCII_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")


class BpeCounter:
    """Counts the tokens of texts under one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.automaton = ahocorasick.Automaton()
        for token in ranks:
            key = token.decode("latin-1")
            self.automaton.add_word(key, key)
        self.automaton.make_automaton()
        self._pieces = regex.compile(SPLIT)
        self._joins: dict[tuple[str, str], bool] = {}
        self._reachable: dict[str, bool] = {}
        self._units: dict[str, int] = {}

    def _merged(self, data: bytes) -> list[bytes]:
        """Plain merging by rank, for the short strings of the compatibility checks only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _alone(self, token: str) -> bool:
        ok = self._reachable.get(token)
        if ok is None:
            data = token.encode("latin-1")
            ok = self._reachable[token] = self._merged(data) == [data]
        return ok

    def _compatible(self, left: str, right: str) -> bool:
        ok = self._joins.get((left, right))
        if ok is None:
            if len(self._joins) > 4 * REMEMBERED:
                self._joins.clear()
            a, b = left.encode("latin-1"), right.encode("latin-1")
            ok = self._joins[left, right] = self._merged(a + b) == [a, b]
        return ok

    def count_piece(self, data: bytes) -> int:
        """Tokens of one pre-split piece, in one pass over its matches."""
        text = data.decode("latin-1")
        last: list[str | None] = [None] * (len(text) + 1)
        count = [0] * (len(text) + 1)
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] is not None:
                continue
            start = end - len(token)
            if self._alone(token) if start == 0 else last[start] is not None and self._compatible(last[start], token):
                last[end], count[end] = token, count[start] + 1
        return count[-1]

    def count_unit(self, unit: str) -> int:
        n = self._units.get(unit)
        if n is None:
            if len(self._units) > REMEMBERED:
                self._units.clear()
            pieces = _ASCII_PIECE.findall(unit) if unit.isascii() and unit.isprintable() else self._pieces.findall(unit)
            n = sum(self.count_piece(p.encode("utf-8", "surrogatepass")) for p in pieces)
            if len(unit) <= 64:
                self._units[unit] = n
        return n

    def unit_counts(self, units: Iterable[str]) -> list[int]:
        units = list(units)
        known = self._units
        try:
            return [known[u] for u in units]
        except KeyError:
            return [self.count_unit(u) for u in units]

    def count(self, text: str | None) -> int:
        """Tokens of a text; 0 for null and for an empty text."""
        return sum(self.unit_counts(UNIT.findall(text))) if text else 0


@functools.lru_cache(maxsize=4)
def counter(path: str = VOCABULARY) -> BpeCounter:
    """The counter of a rank file, compiled once in each worker. A worker takes the copy that ``shipped`` sent it."""
    from pyspark import SparkFiles

    if not os.path.exists(path):
        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as f:
        return BpeCounter({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def shipped(df: DataFrame, path: str) -> DataFrame:
    """df, once the vocabulary has been sent to the executors, so that it need not be installed there."""
    sc = df.sparkSession.sparkContext
    sent = sc.__dict__.setdefault("_gristmill_files", set())
    if path not in sent:
        sc.addFile(path)
        sent.add(path)
    return df


def _count_batches(path: str, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            n = [c.count(t) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keys] + [pa.array(n, pa.int64())], names=[*keys, "tokens"])

    return run


def with_tokens(df: DataFrame, text: str, *keys: str, path: str = VOCABULARY) -> DataFrame:
    """The key columns of df with the exact token count of the text column as ``tokens``.

    Null and empty texts have 0 tokens. Key columns may not be called ``tokens`` or ``_text``.
    """
    slim = shipped(df, path).select(*keys, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != "_text")
    return slim.mapInArrow(_count_batches(path, list(keys)), f"{schema}, tokens bigint")


def _per_file(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            tokens: Counter = Counter()
            blocks: Counter = Counter()
            for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens[f] += c.count(t)
                blocks[f] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(blocks), b.schema.field(0).type), pa.array(list(blocks.values()), pa.int64()), pa.array([tokens[f] for f in blocks], pa.int64())],
                names=["file_id", "blocks", "tokens"],
            )

    return run


def file_tokens(blocks: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Blocks and tokens of each file: (file_id, blocks, tokens).

    Each Arrow batch is summed by file before the shuffle, so a file of any number of blocks
    sends a row per batch. Null texts count as blocks of 0 tokens; blocks of a null file_id
    come out under null.
    """
    part = shipped(blocks, path).select("file_id", "text").mapInArrow(_per_file(path), "file_id bigint, blocks bigint, tokens bigint")
    return part.groupBy("file_id").agg(F.sum("blocks").alias("blocks"), F.sum("tokens").alias("tokens"))


def token_budget(files: DataFrame, blocks: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Usable text by source, language and domain, and every total of these: a cube.

    Out: source, language, domain, level, files, blocks, tokens. ``level`` names the columns a
    row is of, ``all`` for the grand total; a column that a row is totalled over holds ``*``.
    Languages are in one spelling (``und`` where the label says none), domains in lower case
    (``none`` without one). Files without blocks count with 0 tokens; blocks of unknown files
    come under source ``none``. Repeated file rows with one file_id count once.
    """
    per_file = file_tokens(blocks, path)
    meta = files.select(
        "file_id",
        F.coalesce("source", F.lit("none")).alias("source"),
        F.coalesce(canonical_language(F.col("meta_language")), F.lit("und")).alias("language"),
        F.coalesce(path_domain(F.col("file_path")), F.lit("none")).alias("domain"),
    ).dropDuplicates(["file_id"])
    none = F.lit("none")
    joined = meta.join(per_file, "file_id", "full_outer").select(
        F.coalesce("source", none).alias("source"),
        F.coalesce("language", F.lit("und")).alias("language"),
        F.coalesce("domain", none).alias("domain"),
        F.coalesce("blocks", F.lit(0)).alias("blocks"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
    )
    dims = ["source", "language", "domain"]
    # one row per finest slice first: the cube's eightfold expansion then runs over slices, not files
    slices = joined.groupBy(*dims).agg(F.count(F.lit(1)).alias("files"), F.sum("blocks").alias("blocks"), F.sum("tokens").alias("tokens"))
    cube = slices.cube(*dims).agg(
        *[F.grouping(d).alias(f"_{d}") for d in dims],
        F.sum("files").alias("files"),
        F.sum("blocks").alias("blocks"),
        F.sum("tokens").alias("tokens"),
    )
    level = F.concat_ws(",", *[F.when(F.col(f"_{d}") == 0, F.lit(d)) for d in dims])
    return cube.select(
        *[F.when(F.col(f"_{d}") == 1, F.lit("*")).otherwise(F.col(d)).alias(d) for d in dims],
        F.when(level == "", "all").otherwise(level).alias("level"),
        "files",
        "blocks",
        "tokens",
    )
