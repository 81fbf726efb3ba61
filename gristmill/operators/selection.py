"""Rescue of thin pools, filters of web results, semantic chunks, keyword weights, spans of evidence."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gristmill.functions import parse as P
from gristmill.functions import text as T

#: Fixed values.
WEB_BM25, WEB_COSINE, WEB_K1, WEB_B = 0.10, 0.30, 1.5, 0.75
BREAK_PERCENTILE, SHORT_WORDS, SEMANTIC_WORDS = 0.15, 15, 256
DIMENSIONS = 64


@F.pandas_udf(ArrayType(DoubleType()))
def hashed_vector(texts: pd.Series) -> pd.Series:
    """A unit vector of hashed words, in place of an embedding model; zeros for a text without words."""

    def one(t):
        v = np.zeros(DIMENSIONS)
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % DIMENSIONS] += 1.0 if h & 1024 else -1.0
        n = float(np.linalg.norm(v))
        return (v / n if n else v).tolist()

    return texts.map(one)


def rescue_sizes(fetch_k: int | None, context: int | None) -> tuple[int, int]:
    """(pool below which chunks are added, how many at most). Halves are rounded to even."""
    k = max(20, fetch_k or 100)
    target = min(max(8, context or 50), max(8, round(0.24 * k)))
    return max(20, round(0.4 * k)), min(target, max(4, round(0.24 * k)))


def rescue(pool: DataFrame, chunks: DataFrame, queries: DataFrame, fetch_k: int | None = None, context: int | None = None) -> DataFrame:
    """(query_id, chunk_id, overlap): chunks added to pools that are too small.

    Only pools with a hit get any, only chunks of files that are hit, and only those that share a
    word with the query; the best by shared words, and of tables the best one in any case.
    pool: (query_id, chunk_id, file_path); chunks: (chunk_id, file_path, text, is_table).
    """
    least, most = rescue_sizes(fetch_k, context)
    thin = pool.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least).select("query_id")
    files = pool.join(thin, "query_id", "left_semi").select("query_id", "file_path").distinct()
    cand = files.join(chunks.select("chunk_id", "file_path", "text", "is_table"), "file_path").join(pool.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    q = queries.select("query_id", F.array_distinct(T.tokens(F.coalesce("text", F.lit("")))).alias("q"))
    scored = cand.join(q, "query_id").withColumn("overlap", F.size(F.array_intersect("q", T.tokens(F.coalesce("text", F.lit("")))))).where("overlap > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "chunk_id")
    wt = Window.partitionBy("query_id", "is_table").orderBy(F.desc("overlap"), "chunk_id")
    return scored.withColumn("_r", F.row_number().over(w)).withColumn("_t", F.row_number().over(wt)).where((F.col("_r") <= most) | (F.col("is_table") & (F.col("_t") == 1))).select("query_id", "chunk_id", "overlap")


def web_bm25(results: DataFrame, threshold: float = WEB_BM25) -> DataFrame:
    """(query_id, result_id, score): results of each query that pass BM25 over that query's results alone.

    results: (query_id, query, result_id, text). Distinct query words count once; the mean length is at least 1.
    """
    t = results.select("query_id", "result_id", F.array_distinct(T.tokens(F.coalesce("query", F.lit("")))).alias("q"), T.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    per = Window.partitionBy("query_id")
    t = t.withColumn("n", F.count(F.lit(1)).over(per)).withColumn("avg", F.greatest(F.avg(F.size("t")).over(per), F.lit(1.0)))
    hit = t.select("query_id", "result_id", "n", "avg", F.size("t").alias("dl"), F.explode("q").alias("w"), "t").withColumn("tf", F.size(F.filter("t", lambda x: x == F.col("w")))).where("tf > 0")
    hit = hit.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("query_id", "w")))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (WEB_K1 + 1) / (F.col("tf") + WEB_K1 * (1 - WEB_B + WEB_B * F.col("dl") / F.col("avg")))
    return hit.groupBy("query_id", "result_id").agg(F.sum(part).alias("score")).where(F.col("score") >= threshold)


def web_cosine(results: DataFrame, threshold: float = WEB_COSINE) -> DataFrame:
    """(query_id, result_id, score): results whose snippet, else text, is near the query."""
    body = F.coalesce(F.when(F.trim("snippet") != "", F.col("snippet")), F.col("text"), F.lit(""))
    s = results.select("query_id", "result_id", T.cosine(hashed_vector(F.coalesce("query", F.lit(""))), hashed_vector(body)).alias("score"))
    return s.where(F.col("score") >= threshold)


def quality(top: Column, mean3: Column, fallback: Column, coverage: Column, n: Column, support: Column, presence: Column, quantity: Column) -> tuple[Column, Column, Column]:
    """Proxies of relevance, completeness and grounding from 0 to 1."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return clamp(0.55 * top + 0.35 * mean3 + 0.10 * (1 - fallback)), clamp(0.70 * coverage + 0.30 * F.least(n / 6, F.lit(1.0))), clamp(0.70 * support + 0.20 * presence + 0.10 * quantity)


def semantic_chunks(documents: DataFrame, percentile: float = BREAK_PERCENTILE, embed=hashed_vector) -> DataFrame:
    """(doc_id, my_chunk, text, words, vector): sentences grouped between breaks in meaning.

    Short sentences join their neighbours first. A break lies where the cosine of neighbours is
    below the document's percentile. vector is the mean of the parts' by their words, of unit length.
    """
    from gristmill.operators import chunking

    def parts(it):
        for b in it:
            rows = [(d, i, s) for d, t in zip(b["doc_id"], b["text"]) if t for i, s in enumerate(chunking.merge_short(chunking.sentences(t), SHORT_WORDS))]
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "part"])

    p = documents.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(parts, "doc_id bigint, pos int, part string").withColumn("v", embed("part"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    p = p.withColumn("near", T.cosine(F.lag("v").over(w), F.col("v"))).withColumn("near", F.when(F.col("pos") > 0, F.round("near", 9)))
    p = p.withColumn("cut", F.percentile("near", F.lit(percentile)).over(Window.partitionBy("doc_id")))
    p = p.withColumn("my_chunk", F.sum(F.coalesce((F.col("near") < F.col("cut")).cast("int"), F.lit(0))).over(w) + 1).withColumn("n", T.word_count(F.col("part")))
    g = p.groupBy("doc_id", "my_chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "part", "v", "n"))).alias("r"), F.sum("n").alias("words"))
    mean = F.aggregate("r", F.array_repeat(F.lit(0.0), DIMENSIONS), lambda a, x: F.zip_with(a, x["v"], lambda s, y: s + y * x["n"]))
    return g.select("doc_id", "my_chunk", F.array_join(F.transform("r", lambda x: x["part"]), " ").alias("text"), "words", T.l2_normalise(mean).alias("vector"))


def weighted_stems(near: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, stem, weight, surface): keywords' closeness times their weight (0 where there is none), the best by stem.

    near: (doc_id, keyword, closeness); weights: (doc_id, keyword, weight). Of equal weights the
    first surface form in the alphabet holds.
    """
    j = near.join(weights, ["doc_id", "keyword"], "left").select("doc_id", "keyword", (F.col("closeness") * F.coalesce("weight", F.lit(0.0))).alias("w"))
    return best_by_stem(j)


def best_by_stem(weighed: DataFrame) -> DataFrame:
    """(doc_id, stem, weight, surface): the best of each document's keywords by stem. weighed: (doc_id, keyword, w)."""
    s = weighed.select("doc_id", "keyword", "w", P.stemmed("keyword").alias("stem"))
    # the least struct holds the surface form too: min_by would carry it through the shuffle twice
    return s.groupBy("doc_id", "stem").agg(F.max("w").alias("weight"), F.min(F.struct((-F.col("w")).alias("w"), "keyword"))["keyword"].alias("surface"))


def embedding_scores(texts: DataFrame, phrases: DataFrame, algo: str, threshold: float, least: float, k: int = 5, embed=hashed_vector) -> DataFrame:
    """(text_id, phrase, algo, score, threshold): the k nearest phrases of each text from ``least`` on.

    Phrases are a short list that is scored against each text in one product of matrices.
    """
    from gristmill.operators.retrieval import vector_scores

    p = phrases.select("phrase").distinct().withColumn("query_id", F.xxhash64("phrase")).withColumn("embedding", embed("phrase"))
    t = texts.select(F.col("text_id").alias("chunk_id"), embed(F.coalesce("text", F.lit(""))).alias("embedding"))
    hits = vector_scores(p, t, None, least=least).join(p.select("query_id", "phrase"), "query_id")
    w = Window.partitionBy("chunk_id").orderBy(F.desc("score"), "phrase")
    return hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select(F.col("chunk_id").alias("text_id"), "phrase", F.lit(algo).alias("algo"), "score", F.lit(threshold).alias("threshold"))


def merged_by_phrase(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two scorers' rows joined by text and phrase, whichever has them; scores and thresholds added up."""
    x = a.select("text_id", "phrase", F.col("score").alias("s1"), F.col("threshold").alias("t1"))
    y = b.select("text_id", "phrase", F.col("score").alias("s2"), F.col("threshold").alias("t2"))
    z = F.lit(0.0)
    return x.join(y, ["text_id", "phrase"], "full_outer").select("text_id", "phrase", (F.coalesce("s1", z) + F.coalesce("s2", z)).alias("score"), (F.coalesce("t1", z) + F.coalesce("t2", z)).alias("threshold"))


def outside_boxes(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page, word_id, slot): words whose centre lies in no box of their page, with the number of boxes whose top they are below.

    words: (page, word_id, x, y); boxes: (page, x0, y0, x1, y1). Joined by page, which has few boxes.
    """
    b = boxes.groupBy("page").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("b"))
    j = words.join(b, "page", "left").withColumn("b", F.coalesce("b", F.array().cast(b.schema["b"].dataType)))
    inside = F.exists("b", lambda r: (F.col("x") >= r["x0"]) & (F.col("x") <= r["x1"]) & (F.col("y") >= r["y0"]) & (F.col("y") <= r["y1"]))
    return j.where(~inside).select("page", "word_id", F.size(F.filter("b", lambda r: F.col("y") >= r["y0"])).alias("slot"))


def first_overlap(sentences: DataFrame, chunks: DataFrame, n: int = 5) -> DataFrame:
    """(answer_id, sentence_no, chunk_id, position): where in the chunk the first run of n shared words stands, in words from 1."""
    a = sentences.select("answer_id", "sentence_no", F.explode(F.array_distinct(T.windows(T.grounding_tokens("sentence"), n))).alias("run"))
    b = chunks.select("answer_id", "chunk_id", F.posexplode(T.windows(T.grounding_tokens(F.coalesce("text", F.lit(""))), n)).alias("p", "run"))
    return a.join(b, ["answer_id", "run"]).groupBy("answer_id", "sentence_no", "chunk_id").agg((F.min("p") + 1).alias("position"))


def snippets(overlaps: DataFrame, chunks: DataFrame, around: int = 12) -> DataFrame:
    """(answer_id, file_path, page, snippet) of the evidence, each snippet of a page once whatever its case and spacing."""
    c = chunks.select("answer_id", "chunk_id", "file_path", "page", T.words(F.coalesce("text", F.lit(""))).alias("w"))
    j = overlaps.join(c, ["answer_id", "chunk_id"])
    s = F.array_join(F.slice("w", F.greatest(F.lit(1), F.col("position") - around), F.lit(2 * around + 5)), " ")
    return j.select("answer_id", "file_path", "page", s.alias("snippet")).withColumn("_k", T.collapse(F.lower("snippet"))).groupBy("answer_id", "file_path", "page", "_k").agg(F.min("snippet").alias("snippet")).drop("_k")


def marked_answer(answers: DataFrame, grounded: DataFrame, style: str = "html") -> DataFrame:
    """(answer_id, text): each answer's sentences in order, the grounded ones marked.

    answers: (answer_id, sentence_no, sentence); grounded: (answer_id, sentence_no).
    """
    left, right = {"html": ("<mark>", "</mark>"), "cli": ("**", "**")}[style]
    g = grounded.select("answer_id", "sentence_no").distinct().withColumn("g", F.lit(True))
    s = answers.join(g, ["answer_id", "sentence_no"], "left").withColumn("s", F.when(F.col("g"), F.concat(F.lit(left), "sentence", F.lit(right))).otherwise(F.col("sentence")))
    return s.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_no", "s"))), lambda x: x["s"]), " ").alias("text"))


def translated(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(text_id, text): each word replaced by the dictionary's, words it lacks kept. dictionary: (source, target), one row a word."""
    w = texts.select("text_id", F.posexplode(T.words(F.lower(F.coalesce("text", F.lit(""))))).alias("p", "source"))
    t = w.join(dictionary.groupBy(F.lower("source").alias("source")).agg(F.min("target").alias("target")), "source", "left")
    return t.groupBy("text_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", F.coalesce("target", "source").alias("w")))), lambda x: x["w"]), " ").alias("text"))
