"""Compliance scoring: several scorers per phrase and text, and the consensus over them.

Texts and phrases meet by an inverted join on their tokens or grams, not by comparing each with
each; pairs that share nothing score 0 and have no row, except in ``regex_scores``, which states
a row for every phrase of a text that it is asked for.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T


@dataclass(frozen=True)
class Stage:
    """Depth and breadth a stage asks for before it objects."""

    name: str
    depth: int
    breadth: int


#: Stages, thresholds and settings of the scorers.
STAGES = {s.name: s for s in (Stage("load", 3, 4), Stage("chat_prompt", 2, 3), Stage("chat_pipeline", 4, 4), Stage("classify_prompt", 4, 4), Stage("classify_pipeline", 2, 3))}
JACCARD, JACCARD_MIN, GRAMS = 0.75, 0.5, (4, 6)
BM25, BM25_MIN, OVERLAP, RAW_MIN, PERCENTILE = 0.7, 0.2, 2, 25.0, 97.0
REGEX, REGEX_MIN, HARD, FUZZY = 1.0, 0.5, 1.0, 0.75
LEVENSHTEIN, KEYWORD, KEYWORD_MIN = 0.5, 0.45, 0.2


def regex_scores(texts: DataFrame, phrases: DataFrame, fuzzy: bool = False) -> DataFrame:
    """(text_id, phrase, algo, score, threshold): 1.0 where the phrase's words stand in order, 0.75 for a fuzzy match.

    The first word of a phrase decides which texts are looked at: only where a text has it as a
    token (or, fuzzy, a token that shares its first three letters) is the pattern tried. Only
    matches have rows.
    """
    t = texts.select("text_id", "text", T.tokens(F.coalesce("text", F.lit(""))).alias("tok"))
    p = phrases.select("phrase", T.tokens("phrase").alias("pt")).where(F.size("pt") > 0)
    first = (lambda c: F.substring(c, 1, 3)) if fuzzy else (lambda c: c)
    tk = t.select("text_id", F.explode(F.array_distinct(F.transform("tok", first))).alias("key"))
    cand = tk.join(p.select("phrase", "pt", first(F.col("pt")[0]).alias("key")), "key").select("text_id", "phrase", "pt").distinct().join(t.select("text_id", "text"), "text_id")
    hard = F.concat(F.lit(r"(?i)\b"), F.array_join("pt", r"\b[\s\W_]+\b"), F.lit(r"\b"))
    score = F.when(F.rlike("text", hard), HARD)
    if fuzzy:
        loose = F.concat(F.lit(r"(?i)\b"), F.array_join(F.transform("pt", lambda w: F.concat(F.substring(w, 1, 3), F.lit(r"\w*"))), r"\b.{0,20}?\b"))
        score = score.when(F.rlike("text", loose), FUZZY)
    return cand.select("text_id", "phrase", F.lit("REGEX").alias("algo"), score.alias("score"), F.lit(REGEX).alias("threshold")).where("score is not null")


#: Text of the phrases that a worker is sent at once; a longer list goes in several blocks.
BLOCK_BYTES = 4 << 20


def jaccard_scores(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """The best of token Jaccard, Jaccard of 4- to 6-grams, and containment of tokens; from 0.5 on.

    The phrases become an index of their tokens and grams; each text is read once and meets only
    the phrases it has something of. The index is built from at most BLOCK_BYTES of phrases; a
    longer list is gone through in blocks.
    """
    listed = phrases.where("phrase is not null").select("phrase").distinct()
    size = listed.agg(F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    found = None
    for k in range(blocks):
        part = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == k)
        shared = texts.sparkSession.sparkContext.broadcast(sorted(r[0] for r in part.toLocalIterator()))
        kind = dict(texts.dtypes)["text_id"]
        hits = texts.select("text_id", "text").mapInArrow(_jaccard(shared), f"text_id {kind}, phrase string, algo string, score double, threshold double")
        found = hits if found is None else found.unionByName(hits)
    return found


def _sets(text: str) -> tuple[set[str], set[str]]:
    """Distinct tokens, and distinct grams of the tokens joined by a space."""
    tok = re.findall("[a-z0-9]+", text.lower())
    line = " ".join(tok)
    return set(tok), {line[i : i + n] for n in range(GRAMS[0], GRAMS[1] + 1) for i in range(len(line) - n + 1)}


def _jaccard(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [(p, *_sets(p)) for p in shared.value]
        index: tuple[dict, dict] = ({}, {})
        for i, (_, *both) in enumerate(sets):
            for ix, xs in zip(index, both):
                for x in xs:
                    ix.setdefault(x, []).append(i)
        for b in batches:
            take, phrase, score = [], [], []
            for r, text in enumerate(b.column(1).to_pylist()):
                mine = _sets(text or "")
                n = [Counter(i for x in xs & ix.keys() for i in ix[x]) for xs, ix in zip(mine, index)]
                for i in n[0] | n[1]:
                    p, *theirs = sets[i]
                    t, g = n[0][i], n[1][i]
                    s = max(t / (len(mine[0]) + len(theirs[0]) - t), t / min(len(mine[0]), len(theirs[0])) if t else 0.0, g / (len(mine[1]) + len(theirs[1]) - g) if g else 0.0)
                    if s >= JACCARD_MIN:
                        take.append(r), phrase.append(p), score.append(s)
            m = len(take)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), pa.array(phrase, pa.string()), pa.array(["JACCARD"] * m, pa.string()), pa.array(score, pa.float64()), pa.array([JACCARD] * m, pa.float64())], names=["text_id", "phrase", "algo", "score", "threshold"])

    return run


def bm25_scores(texts: DataFrame, phrases: DataFrame, k1: float = 1.2, b: float = 0.75, raw_min: float = RAW_MIN, overlap: int = OVERLAP) -> DataFrame:
    """Phrases as the documents and the text as the query, its repeated words counting again.

    Raw scores from raw_min on with at least two shared words, scaled by the text's 97th percentile.
    """
    p = phrases.select("phrase", T.tokens("phrase").alias("tok"))
    post = p.select("phrase", F.size("tok").alias("dl"), F.explode("tok").alias("term")).groupBy("phrase", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    stats = p.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tok")).alias("avg"))
    idf = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    one = lambda df: df.withColumn("_1", F.lit(1))
    idf = one(idf).join(F.broadcast(one(stats)), "_1").select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avg")
    q = texts.select("text_id", F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("text_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg")))
    raw = q.join(post.join(idf, "term"), "term").groupBy("text_id", "phrase").agg(F.sum(part).alias("raw"), F.count(F.lit(1)).alias("shared"))
    raw = raw.where((F.col("shared") >= overlap) & (F.col("raw") >= raw_min))
    scale = raw.groupBy("text_id").agg(F.percentile("raw", F.lit(PERCENTILE / 100)).alias("scale"))
    out = raw.join(scale, "text_id").withColumn("score", F.least(F.lit(1.0), F.col("raw") / F.greatest("scale", F.lit(1e-12))))
    return out.select("text_id", "phrase", F.lit("BM25").alias("algo"), "score", F.lit(BM25).alias("threshold")).where(F.col("score") >= BM25_MIN)


def with_levenshtein(regex: DataFrame, texts: DataFrame) -> DataFrame:
    """Regex hits joined with the best Levenshtein similarity of the phrase to a window of its length; scores and thresholds add up."""
    t = texts.select("text_id", T.tokens(F.coalesce("text", F.lit(""))).alias("tok"))
    hits = regex.join(t, "text_id").withColumn("n", F.size(T.tokens("phrase")))
    near = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("tok") - F.col("n") + 1)), lambda i: T.levenshtein_similarity(F.array_join(F.slice("tok", i, F.col("n")), " "), F.lower("phrase"))))
    return hits.select("text_id", "phrase", F.lit("REGEX+LEVENSHTEIN").alias("algo"), (F.coalesce("score", F.lit(0.0)) + F.coalesce(near, F.lit(0.0))).alias("score"), (F.col("threshold") + LEVENSHTEIN).alias("threshold"))


def consensus(results: DataFrame, depth: int, breadth: int, *key: str) -> DataFrame:
    """(key, depth, breadth, objected): how many algorithms pass, and the most that any phrase scores in.

    results: (key, algo, phrase, score, threshold). For a document over its chunks the key is the
    document: algorithms are counted once however many chunks they pass in.
    """
    deep = results.groupBy(*key).agg(F.countDistinct(F.when(F.col("score") >= F.col("threshold"), F.col("algo"))).alias("depth"))
    wide = results.where("score > 0").groupBy(*key, "phrase").agg(F.countDistinct("algo").alias("n")).groupBy(*key).agg(F.max("n").alias("breadth"))
    out = deep.join(wide, list(key), "left").fillna(0, ["breadth"])
    return out.withColumn("objected", (F.col("depth") >= depth) | (F.col("breadth") >= breadth))


def best_by_algorithm(results: DataFrame, algos: list[str]) -> DataFrame:
    """A row per text and phrase with each algorithm's best passing score, else its best failing one marked ``*``."""
    best = results.groupBy("text_id", "phrase", "algo").agg(F.max(F.struct((F.col("score") >= F.col("threshold")).alias("ok"), "score")).alias("b"))
    shown = best.withColumn("v", F.concat(F.when(F.col("b.ok"), "").otherwise("*"), F.format_string("%.4f", F.col("b.score"))))
    wide = shown.groupBy("text_id", "phrase").pivot("algo", algos).agg(F.first("v"))
    counts = best.groupBy("text_id", "phrase").agg(F.count_if(F.col("b.ok")).alias("depth"), F.count_if(F.col("b.score") > 0).alias("breadth"), F.max("b.score").alias("max_score"))
    return wide.join(counts, ["text_id", "phrase"])


def intent_gate(queries: DataFrame, entities: DataFrame, intents: DataFrame, entity_gates: list[str], intent_gates: list[str], refuse: int = 60, warn: int = 30) -> DataFrame:
    """(query_id, score, outcome) from weighted rules.

    entities: (category, term, weight), a term of several words matching if all stand anywhere;
    intents: (name, pattern, weight), weights below 0 mitigate. A category counts once. REFUSE if
    a gated entity meets a gated intent, or from ``refuse`` on with any entity; warned from ``warn``.
    """
    tok = queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.coalesce("text", F.lit(""))))).alias("w"))
    terms = entities.select("category", "weight", "term", F.array_distinct(T.tokens("term")).alias("ws")).withColumn("need", F.size("ws"))
    matched = tok.join(terms.select("category", "weight", "term", "need", F.explode("ws").alias("w")), "w").groupBy("query_id", "category", "weight", "term", "need").agg(F.count(F.lit(1)).alias("n")).where("n = need")
    ent = matched.select("query_id", "category", "weight").distinct().groupBy("query_id").agg(F.sum("weight").alias("es"), F.collect_set("category").alias("cats"))
    out = queries.select("query_id", F.coalesce("text", F.lit("")).alias("text")).join(ent, "query_id", "left")
    score, gated = F.coalesce("es", F.lit(0)), F.lit(False)
    for name, pattern, weight in intents.select("name", "pattern", "weight").toLocalIterator():  # a short list of rules becomes part of the plan
        hit = F.col("text").rlike(pattern)
        score = score + F.when(hit, weight).otherwise(0)
        if name in intent_gates:
            gated = gated | hit
    cats = F.coalesce("cats", F.array().cast("array<string>"))
    hard = gated & F.arrays_overlap(cats, F.array(*[F.lit(g) for g in entity_gates]))
    s = F.greatest(F.lit(0), F.least(F.lit(200), score))
    return out.select("query_id", s.cast("int").alias("score"), F.when(hard | ((s >= refuse) & (F.size(cats) > 0)), "REFUSE").when(s >= warn, "ALLOW_WITH_SAFETY_FRAMING").otherwise("ALLOW").alias("outcome"))


def first_block(texts: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """(text_id, reason) of texts that a pattern of a list blocks; the first in order gives the reason."""
    reason = F.lit(None).cast("string")
    for pattern, why in reversed(patterns):
        reason = F.when(F.col("text").rlike(pattern), why).otherwise(reason)
    return texts.select("text_id", reason.alias("reason")).where("reason is not null")
