"""Retrieval over many queries at once: inverted index, vectors, entity graph, verbs and nouns.

Every retriever gives hits: (query_id, chunk_id, score) with the best ``k`` of each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as T

#: BM25, graph and verb/noun settings.
K1, B = 1.2, 0.75
HOPS, GRAPH_CANDIDATES, MIN_EDGE = 2, 50, 1
VERB_WEIGHT, NOUN_WEIGHT, BOTH_BONUS, FALLBACK = 2.0, 1.0, 0.25, 0.6


def top_k(hits: DataFrame, k: int, *order) -> DataFrame:
    """The best k of each query by score, then chunk_id; planned as a group limit before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(*(order or (F.desc("score"), F.asc("chunk_id"))))
    return hits.withColumn("hit_rank", F.row_number().over(w)).where(F.col("hit_rank") <= k)


#: Parts into which the postings of a term are split for the join with the queries, so that no hot term is one task's.
SPREAD = 16


class Bm25Index:
    """Postings, document lengths and term statistics as tables."""

    def __init__(self, chunks: DataFrame, key: str = "chunk_id", text: str = "text"):
        tok = chunks.select(F.col(key).alias("chunk_id"), T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
        self.lengths = tok.select("chunk_id", F.size("tokens").alias("dl"))
        self._words = tok.select("chunk_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
        self.postings = self._counted(self._words)
        self.corpus = self.lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words"), F.avg("dl").alias("avg_dl"))
        self.df = self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    @staticmethod
    def _counted(words: DataFrame) -> DataFrame:
        return words.groupBy("term", "chunk_id", "dl").agg(F.count(F.lit(1)).alias("tf"))

    @property
    def terms(self) -> DataFrame:
        return self._idf(self.df)

    def _idf(self, df: DataFrame) -> DataFrame:
        return _with_one(df, self.corpus.select("n")).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))

    def _of(self, terms: DataFrame) -> DataFrame:
        """The postings of some terms; others are left out before anything is counted or shuffled."""
        if self._words is not None:
            return self._counted(self._words.join(terms, "term", "left_semi"))
        return self.postings.join(terms, "term", "left_semi")

    def scores(self, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
        """(query_id, chunk_id, score) of every chunk that shares a term; repeated query terms count again."""
        q = queries.select("query_id", F.explode(T.tokens(F.coalesce(F.col("text"), F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
        few = self._of(q.select("term").distinct())
        idf = self._idf(few.groupBy("term").agg(F.count("tf").alias("df")))  # of tf, so that the postings are the same exchange as below
        q = q.join(idf, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_s"))
        # the part of a term and chunk is made once, before the join with the queries
        part = _with_one(few, self.corpus.select("avg_dl"))
        part = part.select("term", "chunk_id", F.pmod(F.xxhash64("chunk_id"), F.lit(SPREAD)).cast("int").alias("_s"), (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))).alias("p"))
        return part.join(q, ["term", "_s"]).groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * F.col("p")).alias("score"))

    def query(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """The best k chunks of each query with a score above 0; ``allowed`` filters chunks before scores are ranked."""
        s = self.scores(queries).where("score > 0")
        if allowed is not None:
            s = s.join(allowed, "chunk_id", "left_semi")
        return top_k(s, k, F.desc(F.round("score", 8)), F.asc("chunk_id"))

    def without(self, removed: DataFrame) -> Bm25Index:
        """The index after chunks (chunk_id) are deleted: what they held is taken off the counts, nothing is counted anew."""
        gone = removed.select("chunk_id").distinct()
        out = object.__new__(Bm25Index)
        out._words = None
        out.postings = self.postings.join(gone, "chunk_id", "left_anti")
        out.lengths = self.lengths.join(gone, "chunk_id", "left_anti")
        less = self.lengths.join(gone, "chunk_id", "left_semi").agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("_w"))
        n, words = F.col("n") - F.col("_n"), F.col("words") - F.col("_w")
        out.corpus = _with_one(self.corpus, less).select(n.alias("n"), words.alias("words"), F.when(n > 0, words / n).alias("avg_dl"))
        minus = self.postings.join(gone, "chunk_id", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("_d"))
        out.df = self.df.join(minus, "term", "left").select("term", (F.col("df") - F.coalesce("_d", F.lit(0))).alias("df")).where("df > 0")
        return out


def _with_one(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with the columns of a table of exactly one row."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")


def vector_scores(queries: DataFrame, vectors: DataFrame, k: int | None, block: int = 4096, least: float | None = None) -> DataFrame:
    """(query_id, chunk_id, score): the k nearest vectors of each query by cosine, exactly; from ``least`` on if given, and all of these where k is none.

    queries: (query_id, embedding), a stated set; vectors: (chunk_id, embedding). The queries are
    sent to the workers in blocks of at most ``block`` vectors; each batch of vectors is one
    product of matrices, of which only its best k per query leave the worker.
    """
    spark = vectors.sparkSession
    q = queries.select("query_id", "embedding")
    blocks = max(1, -(-q.count() // block))
    found = None
    for i in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        rows = sorted((r[0], r[1]) for r in part.toLocalIterator())
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids = np.array([r[0] for r in shared.value])
            m = _unit(np.array([r[1] for r in shared.value], np.float64))
            for b in batches:
                if not b.num_rows or not len(ids):
                    continue
                v = _unit(_matrix(b.column(1)))
                s = np.round(m @ v.T, 10)
                edge = np.full((len(ids), 1), -2.0)
                if k is not None and s.shape[1] > k:
                    edge = np.partition(s, s.shape[1] - k, axis=1)[:, [s.shape[1] - k]]
                keep = s >= (edge if least is None else np.maximum(edge, least))  # ties at the edge all go on
                r, c = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r], pa.int64()), b.column(0).take(pa.array(c)), pa.array(s[r, c], pa.float64())], names=["query_id", "chunk_id", "score"])

        kind = dict(vectors.dtypes)["chunk_id"]
        hits = vectors.where("embedding is not null").select("chunk_id", "embedding").mapInArrow(run, f"query_id bigint, chunk_id {kind}, score double")
        found = hits if found is None else found.unionByName(hits)
    return top_k(found, k) if k is not None else found


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix, from Arrow's flat values."""
    flat = column.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    if not len(m):
        return m
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def entity_edges(chunk_entity: DataFrame) -> DataFrame:
    """(src, dst, weight) in both directions: chunks that two entities share.

    chunk_entity: (chunk_id, entity). Pairs come from entities of one chunk, of which there are
    as many as a chunk names.
    """
    e = chunk_entity.select("chunk_id", "entity").distinct()
    pairs = e.join(e.withColumnRenamed("entity", "other"), "chunk_id").where("entity < other")
    half = pairs.groupBy("entity", "other").agg(F.count(F.lit(1)).alias("weight"))
    return half.select(F.col("entity").alias("src"), F.col("other").alias("dst"), "weight").unionByName(half.select(F.col("other").alias("src"), F.col("entity").alias("dst"), "weight"))


def graph_scores(seeds: DataFrame, edges: DataFrame, chunk_entity: DataFrame, hops: int = HOPS, min_edge: int = MIN_EDGE, k: int = GRAPH_CANDIDATES, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score) by walking from each query's seed entities.

    seeds: (query_id, entity). An entity within ``hops`` has the summed weight of the edges from
    entities expanded before it (seeds start with 0); a chunk has the sum over its visited
    entities. ``allowed`` filters after scoring, before the best k are taken. Zero scores stay.
    """
    hops = max(1, hops)
    strong = edges.where(F.col("weight") >= min_edge)
    known = seeds.join(chunk_entity.select("entity").distinct(), "entity", "left_semi").select("query_id", "entity").distinct()
    reached = known.withColumn("dist", F.lit(0))
    front = reached
    for d in range(1, hops + 1):
        step = front.join(strong, front.entity == strong.src).select("query_id", F.col("dst").alias("entity")).distinct()
        front = step.join(reached.select("query_id", "entity"), ["query_id", "entity"], "left_anti").withColumn("dist", F.lit(d))
        reached = reached.unionByName(front)
    expanded = reached.where(F.col("dist") <= hops - 1)
    weight = expanded.join(strong, expanded.entity == strong.src).groupBy("query_id", F.col("dst").alias("entity")).agg(F.sum("weight").alias("w"))
    scored = reached.select("query_id", "entity").join(weight, ["query_id", "entity"], "left").fillna(0, ["w"])
    hits = scored.join(chunk_entity.select("chunk_id", "entity").distinct(), "entity").groupBy("query_id", "chunk_id").agg(F.sum("w").cast("double").alias("score"))
    if allowed is not None:
        hits = hits.join(allowed, "chunk_id", "left_semi")
    return top_k(hits, k)


def verb_noun_scores(query_terms: DataFrame, chunk_terms: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score) by shared verbs and nouns.

    query_terms and chunk_terms: (query_id or chunk_id, verbs, nouns) as arrays. A chunk passes
    if it shares a verb and a noun, of the kinds the query has; 2 x verb coverage + noun coverage,
    and a quarter more where both match. Where no chunk passes, chunks with a verb count at 0.6.
    """
    q = query_terms.select("query_id", F.array_distinct("verbs").alias("qv"), F.array_distinct("nouns").alias("qn"))
    kinds = lambda df, key, v, n: df.select(key, F.explode(F.concat(F.transform(v, lambda x: F.concat(F.lit("v:"), x)), F.transform(n, lambda x: F.concat(F.lit("n:"), x)))).alias("term"))
    qt = kinds(q, "query_id", F.col("qv"), F.col("qn"))
    ct = kinds(chunk_terms, "chunk_id", F.array_distinct("verbs"), F.array_distinct("nouns"))
    shared = qt.join(ct, "term").groupBy("query_id", "chunk_id").agg(F.count_if(F.col("term").startswith("v:")).alias("v"), F.count_if(F.col("term").startswith("n:")).alias("n"))
    s = shared.join(q.select("query_id", F.size("qv").alias("nv"), F.size("qn").alias("nn")), "query_id")
    vcov, ncov = F.when(F.col("nv") > 0, F.col("v") / F.col("nv")).otherwise(0.0), F.when(F.col("nn") > 0, F.col("n") / F.col("nn")).otherwise(0.0)
    strict = ((F.col("nv") == 0) | (F.col("v") > 0)) & ((F.col("nn") == 0) | (F.col("n") > 0))
    full = VERB_WEIGHT * vcov + NOUN_WEIGHT * ncov + F.when((F.col("v") > 0) & (F.col("n") > 0), BOTH_BONUS).otherwise(0.0)
    s = s.select("query_id", "chunk_id", "v", "n", F.when(strict, full).alias("strict"), F.when(F.col("v") > 0, FALLBACK * VERB_WEIGHT * vcov).alias("loose"))
    s = s.withColumn("any_strict", F.max("strict").over(Window.partitionBy("query_id")))
    s = s.withColumn("score", F.when(F.col("any_strict").isNotNull(), F.col("strict")).otherwise(F.col("loose"))).where("score is not null")
    return top_k(s.select("query_id", "chunk_id", "score", "v", "n"), k, F.desc("score"), F.desc(F.col("v") + F.col("n")), F.desc("v"), F.desc("n"), F.asc("chunk_id"))
