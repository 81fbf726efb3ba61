"""Fusing ranked lists, dropping near-duplicates, and choosing evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as T

#: Fixed values.
RRF_K, VARIANT_WEIGHT, DUPLICATE, SINGLE_BOOST = 60, 0.9, 0.85, 1.25


@dataclass(frozen=True)
class Strategy:
    """How many chunks a strategy fetches and keeps, from which score, and its weights by retriever."""

    name: str
    final: int
    retriever_k: int
    threshold: float
    file_limit: int
    graph: float = 1.0


#: The strategies by name.
STRATEGIES = {
    s.name: s
    for s in (
        Strategy("NARROW", 20, 80, 0.60, 5, 0.0),
        Strategy("BALANCED_FILE_CAP", 40, 60, 0.55, 10),
        Strategy("DEFAULT", 50, 100, 0.50, 15),
        Strategy("WIDE", 60, 160, 0.50, 20),
        Strategy("ULTRA_WIDE", 1500, 3000, 0.45, 0),
    )
}


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with ``position`` from 1 in an order over all rows, without bringing them into one task.

    The rows are sorted by ranges and written down; each range is numbered by itself, after the
    number of rows in the ranges before it. One row a range is broadcast.
    """
    from gristmill.session import durable

    ranges = durable(df.orderBy(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    w = Window.partitionBy("_range").orderBy(*order)
    return ranges.join(F.broadcast(starts), "_range").withColumn("position", F.row_number().over(w) + F.col("_start")).drop("_range", "_start")


def reciprocal_rank(hits: DataFrame, k: int = RRF_K, weight: Column | None = None, *more: str) -> DataFrame:
    """(query_id, chunk_id, rrf_score, sources) summed over the lists a chunk stands in.

    hits: (query_id, retriever, leg, hit_rank, chunk_id). sources names the retrievers in order
    of their best rank, then name. ``more`` adds columns to the key, as the language for
    fusion within languages.
    """
    w = F.lit(1.0) if weight is None else weight
    key = ["query_id", *more, "chunk_id"]
    by_list = hits.groupBy(*key, "retriever").agg(F.sum(w / (k + F.col("hit_rank"))).alias("part"), F.min("hit_rank").alias("first"))
    return by_list.groupBy(*key).agg(
        F.sum("part").alias("rrf_score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "retriever"))), lambda s: s["retriever"]), ",").alias("sources"),
    )


def best_variant(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """(need_id, chunk_id, score): the best, not the sum, of weight / (k + rank) over a need's variants."""
    return hits.groupBy("need_id", "chunk_id").agg(F.max(F.col("weight") / (k + F.col("hit_rank"))).alias("score"))


def interleave(ranked: DataFrame, n: int, score: str = "rrf_score") -> DataFrame:
    """Round robin over languages: the first of each, then the second, languages in order of their best chunk."""
    by_lang = Window.partitionBy("query_id", "language").orderBy(F.desc(score), "chunk_id")
    out = ranked.withColumn("_n", F.row_number().over(by_lang)).withColumn("_best", F.max(score).over(Window.partitionBy("query_id", "language")))
    w = Window.partitionBy("query_id").orderBy("_n", F.desc("_best"), "language", "chunk_id")
    return out.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n).drop("_n", "_best")


def duplicate_pairs(pool: DataFrame, threshold: float = DUPLICATE) -> DataFrame:
    """(query_id, a, b, similarity): chunks of one pool with Jaccard of their words of at least the threshold.

    Candidates share one of their rarest words: with similarity of at least t, two sets share an
    element among the first |x| - ceil(t |x|) + 1 of each in a common order. Words are ordered by
    how many chunks have them, so hot words are never joined on where rarer ones decide.
    """
    toks = pool.select("query_id", "chunk_id", T.dedup_tokens(F.coalesce("text", F.lit(""))).alias("t")).where(F.size("t") > 0)
    words = toks.select("query_id", "chunk_id", F.size("t").alias("n"), F.explode("t").alias("w"))
    df = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("query_id", "chunk_id").orderBy("df", "w")
    prefix = words.join(df, "w").withColumn("i", F.row_number().over(order)).where(F.col("i") <= F.col("n") - F.ceil(threshold * F.col("n")) + 1).select("query_id", "w", "chunk_id", "n")
    a, b = prefix.select("query_id", "w", F.col("chunk_id").alias("a"), F.col("n").alias("na")), prefix.select("query_id", "w", F.col("chunk_id").alias("b"), F.col("n").alias("nb"))
    cand = a.join(b, ["query_id", "w"]).where("a < b and na >= %f * nb and nb >= %f * na" % (threshold, threshold)).select("query_id", "a", "b").distinct()
    s = toks.select("query_id", F.col("chunk_id"), "t")
    both = cand.join(s.select("query_id", F.col("chunk_id").alias("a"), F.col("t").alias("ta")), ["query_id", "a"]).join(s.select("query_id", F.col("chunk_id").alias("b"), F.col("t").alias("tb")), ["query_id", "b"])
    return both.select("query_id", "a", "b", T.jaccard(F.col("ta"), F.col("tb")).alias("similarity")).where(F.col("similarity") >= threshold)


def drop_duplicates(pool: DataFrame, score: str = "rrf_score", threshold: float = DUPLICATE) -> DataFrame:
    """A pool without chunks that are near-duplicates of a better one that is kept.

    Greedy in order of score, as lists are walked from the top: a chunk goes if a kept one before
    it is like it. Settled in rounds: a chunk with no undecided better neighbour is kept, and
    those after it that are like it go. The rounds needed are the length of the longest chain.
    """
    pairs = duplicate_pairs(pool, threshold)
    rank = pool.select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")).alias("_r"))
    e = pairs.join(rank.select("query_id", F.col("chunk_id").alias("a"), F.col("_r").alias("ra")), ["query_id", "a"]).join(rank.select("query_id", F.col("chunk_id").alias("b"), F.col("_r").alias("rb")), ["query_id", "b"])
    edges = e.select("query_id", F.when(F.col("ra") < F.col("rb"), F.col("a")).otherwise(F.col("b")).alias("up"), F.when(F.col("ra") < F.col("rb"), F.col("b")).otherwise(F.col("a")).alias("down"))
    from gristmill.session import durable

    edges = durable(edges)
    gone = edges.select("query_id", F.col("down").alias("chunk_id")).limit(0)
    left = edges
    while not left.isEmpty():
        waiting = left.select("query_id", F.col("down").alias("up")).distinct()
        firm = left.join(waiting, ["query_id", "up"], "left_anti")
        out = firm.select("query_id", F.col("down").alias("chunk_id")).distinct()
        gone = gone.unionByName(out)
        left = durable(
            left.join(out.withColumnRenamed("chunk_id", "down"), ["query_id", "down"], "left_anti").join(out.withColumnRenamed("chunk_id", "up"), ["query_id", "up"], "left_anti")
        )
    return pool.join(gone, ["query_id", "chunk_id"], "left_anti")


def min_max(pool: DataFrame, score: str = "raw") -> DataFrame:
    """Scores of each query scaled to 0..1; where all are equal, all are 0."""
    w = Window.partitionBy("query_id")
    span = F.max(score).over(w) - F.min(score).over(w)
    return pool.withColumn("scaled", (F.col(score) - F.min(score).over(w)) / F.when(span == 0, 1.0).otherwise(span))


def above_threshold(pool: DataFrame, threshold: float, web_threshold: float = 0.5, boost: float = SINGLE_BOOST, fallback: bool = True) -> DataFrame:
    """Rows whose reranked score passes, with ``kept_score``.

    pool: (query_id, chunk_id, file_path, source, raw, retrieval_score). A local file with exactly
    one chunk in the pool gets ln(boost) on its raw score; web rows have their own threshold. If
    the best local score without boost misses the threshold and fallback is on, all rows stay and
    keep their retrieval score; the column ``fallback`` says so.
    """
    per_file = Window.partitionBy("query_id", "file_path")
    per_query = Window.partitionBy("query_id")
    local = F.col("source") != "web"
    single = local & (F.count(F.lit(1)).over(per_file) == 1)
    boosted = T.sigmoid(F.col("raw") + F.when(single, F.log(F.lit(boost))).otherwise(0.0))
    best = F.max(F.when(local, T.sigmoid(F.col("raw")))).over(per_query)
    out = pool.withColumn("_boosted", boosted).withColumn("_all", F.lit(fallback) & (F.coalesce(best, F.lit(0.0)) < threshold))
    keep = F.col("_all") | F.when(local, F.col("_boosted") >= threshold).otherwise(F.col("_boosted") >= web_threshold)
    return out.where(keep).withColumn("kept_score", F.when(F.col("_all"), F.col("retrieval_score")).otherwise(F.col("_boosted"))).withColumnRenamed("_all", "fallback").drop("_boosted")


def capped_by_file(pool: DataFrame, cap: int, budget: int, score: str = "kept_score") -> DataFrame:
    """Files by their number of chunks, within a file by score, at most ``cap`` each, until the budget is full.

    A cap of 0 takes by the budget alone.
    """
    by_file = Window.partitionBy("query_id", "file_path")
    out = pool.withColumn("_n", F.count(F.lit(1)).over(by_file)).withColumn("_i", F.row_number().over(by_file.orderBy(F.desc(score), "chunk_id")))
    if cap:
        out = out.where(F.col("_i") <= cap)
    w = Window.partitionBy("query_id").orderBy(F.desc("_n"), "file_path", "_i")
    return out.withColumn("position", F.row_number().over(w)).where(F.col("position") <= budget).drop("_n", "_i")


def single_document(pool: DataFrame, score: str = "kept_score") -> DataFrame:
    """The chunks of the file with the most chunks in the pool; of equal ones the first by path."""
    by_file = pool.groupBy("query_id", "file_path").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), "file_path")
    best = by_file.withColumn("_i", F.row_number().over(w)).where("_i = 1").select("query_id", "file_path")
    return pool.join(best, ["query_id", "file_path"], "left_semi")


#: Weights of the parts of confidence, what a fallback takes off, where levels begin, and the score of an unknown scale.
TOP, MEAN, COVERAGE, LOCAL, PENALTY, HIGH, MEDIUM, UNKNOWN = 0.50, 0.30, 0.15, 0.05, 0.15, 0.78, 0.56, 0.5


def evidence_score(raw: Column, scaled: Column | None = None, other: Column | None = None) -> Column:
    """A chunk's score from 0 to 1: the sigmoid of its raw score, else a scaled one, else the middle where it has one of another scale."""
    unit = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    rest = F.when(F.lit(False) if other is None else other.isNotNull(), F.lit(UNKNOWN)).otherwise(0.0)
    return F.when(raw.isNotNull(), unit(T.sigmoid(raw))).otherwise(rest if scaled is None else F.coalesce(unit(scaled), rest))


def confidence(pool: DataFrame, final: int = 50, grounding_failed: Column | None = None) -> DataFrame:
    """(query_id, top, mean3, coverage, local_share, penalty, confidence, level) of each query's chosen evidence.

    pool: (query_id, position, raw, source, fallback). Coverage is the share of the ``final``
    chunks that were asked for. Where all rows were kept for want of better ones, the penalty is
    taken off. grounding_failed: a condition on the pool's columns; where it holds for a query its
    confidence is 0.
    """
    score = evidence_score(F.col("raw"))
    failed = F.lit(False) if grounding_failed is None else F.coalesce(grounding_failed, F.lit(False))
    c = pool.groupBy("query_id").agg(
        F.max(score).alias("top"),
        F.avg(F.when(F.col("position") <= 3, score)).alias("mean3"),
        F.least(F.lit(1.0), F.count(F.lit(1)) / final).alias("coverage"),
        F.avg((F.lower(F.coalesce("source", F.lit(""))) != "web").cast("double")).alias("local_share"),
        F.when(F.some("fallback"), F.lit(PENALTY)).otherwise(0.0).alias("penalty"),
        F.some(failed).alias("_failed"),
    )
    total = TOP * F.col("top") + MEAN * F.col("mean3") + COVERAGE * F.col("coverage") + LOCAL * F.col("local_share") - F.col("penalty")
    c = c.withColumn("confidence", F.when(F.col("_failed"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))).drop("_failed")
    return c.withColumn("level", F.when(F.col("confidence") >= HIGH, "HIGH").when(F.col("confidence") >= MEDIUM, "MEDIUM").otherwise("LOW"))


#: Fixed value: what a web result's place in the order is worth beside a local chunk's.
WEB_WEIGHT = 0.5


def rerank(pool: DataFrame, languages: DataFrame, web_weight: float = WEB_WEIGHT) -> DataFrame:
    """The pool in one language, with ``rerank_score`` from 0 to 1 for the order.

    pool: (query_id, chunk_id, language, source, raw); languages: (query_id, language), those a
    query was asked in. Of the local chunks in one of these the best raw score decides the
    language (of equal ones the first in the alphabet); chunks in it and web results stay, and
    all where no chunk is in any. Raw scores are scaled over what stays, 0 where all are equal;
    web results count by web_weight unless there is nothing else.
    """
    web = F.lower(F.coalesce("source", F.lit(""))) == "web"
    asked = languages.select("query_id", "language").where("language is not null").distinct()
    local = pool.where(~web).join(asked, ["query_id", "language"], "left_semi").groupBy("query_id", "language").agg(F.max("raw").alias("_top"))
    best = local.groupBy("query_id").agg(F.min_by("language", F.struct(-F.col("_top"), F.col("language"))).alias("_best"))
    kept = pool.join(best, "query_id", "left").where(F.col("_best").isNull() | web | (F.col("language") == F.col("_best"))).drop("_best")
    w = Window.partitionBy("query_id")
    span = F.max("raw").over(w) - F.min("raw").over(w)
    kept = kept.withColumn("_scaled", (F.col("raw") - F.min("raw").over(w)) / F.when(span == 0, 1.0).otherwise(span)).withColumn("_web", F.every(web).over(w))
    return kept.withColumn("rerank_score", F.when(web & ~F.col("_web"), web_weight * F.col("_scaled")).otherwise(F.col("_scaled"))).drop("_scaled", "_web")


def need_associations(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """(chunk_id, needs, score): the needs that a chunk was found for, and its best score over their variants.

    hits: (need_id, chunk_id, hit_rank, weight), of every retriever and of the keyword leg.
    """
    best = best_variant(hits, k)
    return best.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("need_id")), lambda n: n.cast("string")), ",").alias("needs"), F.max("score").alias("score"))
