"""Weights of runs of words by tf-idf without a row per document and run.

Documents are gathered by their key into blocks; a block numbers its words and its distinct runs (a tree: a run's
parent is the run without its last word). Each distinct run of a block is sent once, with the number of the block's
documents that have it, to the shard of its first two words, which sends back the number of all documents that have it.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words of a block, unless one document has more: three numbers below it fit into 63 bits, its arrays into some 150 MB.
BLOCK = 1 << 20
_ROWS = pa.schema([("key", pa.int64()), ("part", pa.int64()), ("payload", pa.binary())])


def _squeezed(words: list[str], arrays: list[np.ndarray]) -> bytes:
    """Words and arrays of numbers below 2**32 in few bytes: the numbers' bytes by place, compressed."""
    text = "\n".join(words).encode()
    raw = np.array([len(text), len(arrays), *map(len, arrays)], "<i8").tobytes() + text
    raw += b"".join(a.astype("<u4").view("u1").reshape(-1, 4).T.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _opened(payload: bytes) -> tuple[list[str], list[np.ndarray]]:
    raw = pa.Codec("zstd").decompress(payload[8:], int.from_bytes(payload[:8], "little"), asbytes=True)
    n_text, n = (int(x) for x in np.frombuffer(raw, "<i8", 2))
    at = 16 + 8 * n + n_text
    text, arrays = raw[at - n_text : at].decode(), []
    for size in np.frombuffer(raw, "<i8", n, 16).tolist():
        arrays.append(np.frombuffer(raw, "u1", 4 * size, at).reshape(4, size).T.copy().view("<u4").ravel().astype(np.int64))
        at += 4 * size
    return text.split("\n") if text else [], arrays


def _steps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=0)


def _numbered(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs numbered in their order: each place's number, and the two parts of each pair."""
    n = len(high)
    if not n:
        return high, high, low
    bits, more, place = (int(x).bit_length() for x in (low.max(), high.max(), n))
    key = (high << bits) | low
    if bits + more + place <= 63:  # sorting numbers is many times faster than sorting places by them
        key = (key << place) | np.arange(n)
        key.sort()
        at = key & ((1 << place) - 1)
        key >>= place
    else:
        at = np.argsort(key, kind="stable")
        key = key[at]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    number = np.empty(n, np.int64)
    number[at] = np.cumsum(new) - 1
    key = key[new]
    return number, key >> bits, key & ((1 << bits) - 1)


class _Block:
    """The runs of up to n_max words in texts given as numbers of words in alphabetical order.

    Level k has the runs of k words in alphabetical order; ``before`` numbers all runs in that order.
    """

    def __init__(self, words: list[str], ids: np.ndarray, sizes: np.ndarray, docs: np.ndarray, n_max: int):
        # docs: the document of each text, ascending
        self.words = words
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))
        doc = np.repeat(docs, sizes)
        at, node = np.arange(len(ids)), ids
        self.parent, self.word = [np.zeros(len(words), np.int64)], [np.arange(len(words))]
        short = np.int32 if n_max * len(ids) < 1 << 31 else np.int64  # of what is kept for each word and level
        places = [(at.astype(short), node.astype(short))]
        for k in range(2, n_max + 1):
            more = left[at] >= k
            at = at[more]
            node, parent, word = _numbered(node[more], ids[at + (k - 1)])
            self.parent.append(parent)
            self.word.append(word)
            places.append((at.astype(short), node.astype(short)))
        del left, at, node
        size = [np.ones(len(w), np.int64) for w in self.word]
        for k in range(n_max - 1, 0, -1):
            size[k - 1] += np.bincount(self.parent[k], size[k], len(size[k - 1])).astype(np.int64)
        self.before = [np.cumsum(size[0]) - size[0]]
        for k in range(1, n_max):
            to, p = np.cumsum(size[k]) - size[k], self.parent[k]
            first = np.searchsorted(p, np.arange(len(size[k - 1])))
            self.before.append(self.before[k - 1][p] + 1 + to - to[first[p]])
        self.runs = int(sum(map(len, self.word)))
        key, end = np.empty(sum(len(at) for at, _ in places), np.int64), 0
        for k, (at, node) in enumerate(places):
            part = key[end : end + len(at)]
            np.multiply(doc[at], self.runs, out=part)
            part += self.before[k][node]
            end += len(at)
        del places, doc
        key.sort()
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        #: how often each document has each of its runs, by document and then alphabet
        self.tf = np.diff(new, append=len(key)).astype(short)
        key = key[new]
        del new
        self.doc = (key // max(1, self.runs)).astype(short)
        key -= self.doc.astype(np.int64) * self.runs
        self.run = key.astype(short)

    def shards(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level the order of its runs by shard, and where each shard begins in it."""
        h = pd.util.hash_array(np.array(self.words, dtype=object), categorize=False)
        out, shard = [], (h % np.uint64(n)).astype(np.int64)
        for k, (p, w) in enumerate(zip(self.parent, self.word)):
            if k == 1:
                shard = (((h[p] * np.uint64(0x9E3779B97F4A7C15) + h[w]) >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
            elif k:
                shard = shard[p]
            order = np.argsort(shard.astype(np.uint16), kind="stable")
            out.append((order, np.searchsorted(shard[order], np.arange(n + 1))))
        return out

    def messages(self, n: int, n_docs: int) -> Iterator[tuple[int, bytes]]:
        """For each shard its runs with the number of documents that have them; the first also gets the number of documents."""
        has = np.bincount(self.run, minlength=self.runs)
        shards = self.shards(n)
        place = []
        for order, _ in shards:
            place.append(np.empty(len(order), np.int64))
            place[-1][order] = np.arange(len(order))
        for s in range(n):
            cut = [order[start[s] : start[s + 1]] for order, start in shards]
            if s and not any(map(len, cut)):
                continue
            firsts = self.parent[1][cut[1]] if len(cut) > 1 else cut[0][:0]
            used = np.unique(np.concatenate([firsts, *(self.word[k][c] for k, c in enumerate(cut))]))
            arrays = [np.array([n_docs] * (s == 0))]
            for k, c in enumerate(cut):
                if k == 1:
                    arrays.append(_steps(np.searchsorted(used, firsts)))
                elif k:
                    arrays.append(_steps(place[k - 1][self.parent[k][c]] - shards[k - 1][1][s]))
                arrays += [np.searchsorted(used, self.word[k][c]), has[self.before[k][c]]]
            yield s, _squeezed([self.words[i] for i in used.tolist()], arrays)

    def best(self, df: list[np.ndarray], n_docs: int, first: int, second: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, word and weight of the best words in each document's best runs."""
        n_max = len(self.word)
        log, has = np.empty(self.runs), np.unique(np.concatenate(df))
        logs = np.array([math.log((1 + n_docs) / (1 + x)) for x in has.tolist()])
        spelt = np.full((self.runs, n_max), -1)
        for k in range(n_max):
            b = self.before[k]
            log[b] = logs[np.searchsorted(has, df[k])]
            if k:
                spelt[b] = spelt[self.before[k - 1][self.parent[k]]]
            spelt[b, k] = self.word[k]
        w = self.tf * log[self.run]
        ends = np.flatnonzero(np.diff(self.doc, prepend=-1, append=-1)).tolist()
        kept = []
        for a, b in zip(ends, ends[1:]):
            x = w[a:b]
            if b - a > first:
                at = np.flatnonzero(x >= np.partition(x, b - a - first)[b - a - first] - 2e-9)
                kept.append(a + at[np.argsort(-np.round(x[at], 9), kind="stable")[:first]])
            else:
                kept.append(np.arange(a, b))
        at = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        word = spelt[self.run[at]]
        i, k = np.nonzero(word >= 0)
        doc, word, w = self.doc[at[i]], word[i, k], w[at[i]]
        o = np.lexsort((-w, word, doc))
        doc, word, w = doc[o], word[o], w[o]
        new = np.diff(doc, prepend=-1).astype(bool) | np.diff(word, prepend=-1).astype(bool)
        doc, word, w = doc[new], word[new], w[new]
        o = np.lexsort((word, -np.round(w, 9), doc))
        doc, word, w = doc[o], word[o], w[o]
        in_top = np.arange(len(doc)) - np.searchsorted(doc, doc) < second
        return doc[in_top], word[in_top], w[in_top]


def _blocks(size: int, shards: int, n_max: int, shortest: int):
    """From lower-case texts in the order of their documents to the blocks' rows: its documents, and a message to each shard."""
    find = re.compile(f"[a-z0-9]{{{shortest},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, kind = TaskContext.get().partitionId(), 0, None

        def end() -> pa.RecordBatch:
            names = sorted(number)
            rank = np.empty(len(names), np.int64)
            rank[[number[x] for x in names]] = np.arange(len(names))
            ids = rank[np.concatenate(parts)] if parts else np.zeros(0, np.int64)
            sizes, of = np.array(lengths, np.int64), np.array(owner, np.int64)
            block = (task << 24) | made
            keys = pa.array(docs, kind)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("doc_id", kind)])) as w:
                w.write_batch(pa.record_batch([keys], names=["doc_id"]))
            held = sink.getvalue().to_pybytes()
            body = _squeezed(names, [ids, sizes, of])
            rows = [(block, -1, len(held).to_bytes(8, "little") + held + body)]
            n_docs = len(keys) - keys.null_count  # as count(DISTINCT) has it
            rows += [(-1 - s, block, x) for s, x in _Block(names, ids, sizes, of, n_max).messages(shards, n_docs)]
            return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), _ROWS)], schema=_ROWS)

        number: dict[str, int] = defaultdict()
        docs, parts, lengths, owner, held = [], [], [], [], 0
        for b in batches:
            kind = b.schema.field(0).type
            few = (b.slice(a, 500) for a in range(0, b.num_rows, 500))  # texts as strings take up to four times as much
            for d, text in (x for f in few for x in zip(f.column(0).to_pylist(), f.column(1).to_pylist())):
                if not docs or docs[-1] != d:
                    if held >= size:
                        yield end()
                        made, docs, parts, lengths, owner, held = made + 1, [], [], [], [], 0
                        number = defaultdict()
                    docs.append(d)
                number.default_factory = number.__len__
                found = find(text)
                parts.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
                lengths.append(len(found))
                owner.append(len(docs) - 1)
                held += len(found)
        if docs:
            yield end()

    return run


def _counts(n_max: int):
    """The shards' answers: for each message the documents of each of its runs, in the message's order."""

    def answers(messages: list[tuple[int, bytes]], shard: int) -> pa.RecordBatch:
        opened = [_opened(x) for _, x in messages]
        words = pa.array([w for ws, _ in opened for w in ws], pa.string()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        base = np.cumsum([0, *(len(ws) for ws, _ in opened)])
        column = lambda j: [a[j] for _, a in opened]
        named = lambda arrays: words[np.concatenate([a + b for a, b in zip(arrays, base)])]
        total = int(sum(a.sum() for a in column(0)))
        out, number, j = [], None, 1
        for k in range(n_max):
            if k:
                high = [np.cumsum(a) for a in column(j)]
                high = named(high) if k == 1 else number[np.concatenate([a + b for a, b in zip(high, start)])]
                number = _numbered(high, named(column(j + 1)))[0]
            else:
                number = named(column(j))
            has = column(j + bool(k) + 1)
            df = np.bincount(number, np.concatenate(has)).astype(np.int64)[number]
            start = np.cumsum([0, *map(len, has)])
            out.append(np.split(df, start[1:-1]))
            j += 2 + bool(k)
        rows = [(block, shard, _squeezed([], [np.array([total >> 32, total & 0xFFFFFFFF] * (shard == 0)), *(o[i] for o in out)])) for i, (block, _) in enumerate(messages)]
        return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), _ROWS)], schema=_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = defaultdict(list)
        for b in batches:
            b = b.filter(pc.less(b.column(0), 0))
            for key, block, x in zip(*(c.to_pylist() for c in b.columns)):
                sent[-1 - key].append((block, x))
        for shard, messages in sent.items():
            yield answers(messages, shard)

    return run


def _weighed(shards: int, n_max: int, first: int, second: int, kind: pa.DataType):
    """A block's documents and the answers to its messages, as the best words."""
    schema = pa.schema([("doc_id", kind), ("keyword", pa.string()), ("weight", pa.float64())])

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows:  # a shard's messages
            return schema.empty_table()
        (payload,) = block.column("payload").to_pylist()
        size = int.from_bytes(payload[:8], "little")
        keys = pa.ipc.open_stream(payload[8 : 8 + size]).read_all().column(0).combine_chunks()
        words, (ids, sizes, of) = _opened(payload[8 + size :])
        b = _Block(words, ids, sizes, of, n_max)
        order, df, n_docs = b.shards(shards), [np.zeros(len(w), np.int64) for w in b.word], 0
        for s, x in zip(answers.column("part").to_pylist(), answers.column("payload").to_pylist()):
            total, *arrays = _opened(x)[1]
            n_docs = (int(total[0]) << 32) | int(total[1]) if len(total) else n_docs
            for k, a in enumerate(arrays):
                df[k][order[k][0][order[k][1][s] : order[k][1][s + 1]]] = a
        if not all(x.all() for x in df):
            raise RuntimeError("a shard's answer is missing")
        doc, word, w = b.best(df, n_docs, first, second)
        return pa.table([keys.take(pa.array(doc)).cast(kind), pa.array(words, pa.string()).take(pa.array(word)), pa.array(w)], schema=schema)

    return run


def best_words(documents: DataFrame, n_max: int, first: int, second: int, shortest: int = 3, size: int = BLOCK) -> DataFrame:
    """(doc_id, keyword, weight): the ``second`` best words in the ``first`` best runs of up to n_max words of each document.

    documents: (doc_id, text). Words are runs of ASCII letters and digits, those under ``shortest`` left out.
    A run weighs tf * ln((1 + documents) / (1 + documents with it)); equal weights (to nine places) go by alphabet.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = min(2 * parts, 1 << 16)
    key = documents.schema["doc_id"]
    texts = documents.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text")).repartition("doc_id").sortWithinPartitions("doc_id")
    rows = "key bigint, part bigint, payload binary"
    sent = texts.mapInArrow(_blocks(size, shards, n_max, shortest), rows).repartition(parts, "key")
    answers = sent.mapInArrow(_counts(n_max), rows)  # reads the exchange that the blocks are read from
    out = StructType().add("doc_id", key.dataType).add("keyword", "string").add("weight", "double")
    kind = to_arrow_type(key.dataType)
    return sent.groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(_weighed(shards, n_max, first, second, kind), out)
