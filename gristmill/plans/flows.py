"""Flows: which legs, languages and stages a retrieval runs, checked when the plan is made."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators import fusion

RETRIEVERS = ("VECTOR", "BM25", "GRAPH", "REGEX", "WEB")
SOURCES = ("ORIGINAL", "TRANSLATED", "REWRITTEN")


@dataclass(frozen=True)
class Flow:
    """One flow: language scope, text each leg asks with, and the stages that run."""

    name: str
    languages: str = "NATIVE"
    retrievers: tuple[str, ...] = ("VECTOR", "BM25", "GRAPH", "REGEX")
    query_source: str = "REWRITTEN"
    rewrite: bool = True
    rerank: bool = True
    wordnet: bool = False
    secondary_leg: bool = False
    original_vector_leg: bool = False
    variants: int = 3
    deduplicate: bool = True


_BASE = [
    Flow("NATIVE_ALL"),
    Flow("ENGLISH_ALL", languages="ENGLISH", query_source="TRANSLATED"),
    Flow("NATIVE_ALL_MULTILEG", secondary_leg=True, original_vector_leg=True),
    Flow("NATIVE_ALL_WORDNET", wordnet=True),
    Flow("NATIVE_ALL_NO_REWRITE", rewrite=False, query_source="ORIGINAL"),
    Flow("NATIVE_ALL_NO_RERANK", rerank=False),
    Flow("ENGLISH_VECTOR", languages="ENGLISH", retrievers=("VECTOR",), query_source="TRANSLATED"),
    Flow("ENGLISH_BM25", languages="ENGLISH", retrievers=("BM25",), query_source="TRANSLATED"),
    Flow("ORIGINAL_VECTOR", retrievers=("VECTOR",), query_source="ORIGINAL", rewrite=False),
]
FLOWS = {f.name: f for f in _BASE}


def resolve(name: str = "NATIVE_ALL", **overrides) -> Flow:
    """A flow with overrides; an unknown flow, setting or value is an error."""
    if name not in FLOWS:
        raise ValueError(f"unknown flow {name!r}")
    known = {f.name: f.type for f in fields(Flow)}
    for k, v in overrides.items():
        if k not in known or k == "name":
            raise ValueError(f"unknown setting {k!r}")
        if k == "retrievers" and (not v or set(v) - set(RETRIEVERS)):
            raise ValueError(f"unknown retrievers {v!r}")
        if k == "query_source" and v not in SOURCES:
            raise ValueError(f"unknown query source {v!r}")
        if known[k] == "bool" and not isinstance(v, bool):
            raise ValueError(f"{k} is on or off, not {v!r}")
    return replace(FLOWS[name], **overrides)


def retrieval_mode(mode: str) -> tuple[str, ...]:
    """``ALL`` or names joined by ``_`` as retrievers."""
    if mode == "ALL":
        return RETRIEVERS[:4]
    names = tuple(mode.split("_"))
    if set(names) - set(RETRIEVERS):
        raise ValueError(f"unknown retrieval mode {mode!r}")
    return names


def cast_setting(value: str, kind: str):
    """A session setting by its declared type; a value that is not of it is an error."""
    if kind == "bool":
        low = value.strip().lower()
        if low in ("1", "true", "yes", "on"):
            return True
        if low in ("0", "false", "no", "off"):
            return False
        raise ValueError(f"not on or off: {value!r}")
    return {"str": str, "int": int, "float": float, "debug_level": lambda v: max(0, min(100, int(v)))}[kind](value)


def legs(hits: DataFrame, queries: DataFrame, flow: Flow) -> DataFrame:
    """The ranked lists that a flow fuses.

    hits: (query_id, retriever, leg, hit_rank, chunk_id); queries: (query_id, leg, text,
    meta_language). The list of the final text always counts. That of the seed text counts in a
    flow with a secondary leg, unless a query's seed and final text are the same whatever their
    case. The vector list of the original text counts in a flow with that leg, unless the query's
    language is English or unknown or the texts are the same.
    """
    said = queries.where("text is not null").select("query_id", "leg", F.lower(F.trim("text")).alias("_t"))
    same = said.where("leg <> 'final'").join(said.where("leg = 'final'").select("query_id", "_t"), ["query_id", "_t"], "left_semi").select("query_id", "leg").distinct()
    language = queries.groupBy("query_id").agg(F.min(F.lower("meta_language")).alias("_language"))
    h = hits.where(F.upper("retriever").isin(*flow.retrievers)).join(language, "query_id", "left")
    foreign = F.col("_language").isNotNull() & ~F.col("_language").isin("en", "und", "unknown")
    keep = F.col("leg") == "final"
    if flow.secondary_leg:
        keep = keep | (F.col("leg") == "seed")
    if flow.original_vector_leg:
        keep = keep | ((F.col("leg") == "original") & (F.col("retriever") == "vector") & foreign)
    return h.where(keep).drop("_language").join(same, ["query_id", "leg"], "left_anti")


def run(hits: DataFrame, queries: DataFrame, chunks: DataFrame, flow: Flow, strategy: fusion.Strategy = fusion.STRATEGIES["DEFAULT"]) -> DataFrame:
    """(query_id, chunk_id, position, score): a flow from its lists to the order of its chunks.

    The lists are fused with equal weights and cut to the strategy's pool; near-duplicates go,
    the pool is reranked in one language, and the best are kept, as the flow says. chunks:
    (chunk_id, source, language, text); an English flow takes those in English alone.
    """
    fused = fusion.reciprocal_rank(legs(hits, queries, flow)).withColumn("rrf_score", F.round("rrf_score", 10))
    kept = chunks.where("language = 'en'") if flow.languages == "ENGLISH" else chunks
    pool = fused.join(kept.select("chunk_id", "source", "language", "text"), "chunk_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "chunk_id")
    pool = pool.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= strategy.retriever_k).drop("_r")
    if flow.deduplicate:
        pool = fusion.drop_duplicates(pool)
    pool = pool.withColumn("raw", F.round(F.col("rrf_score") * 60 - 1, 6))
    if flow.rerank:
        asked = queries.select("query_id", F.col("meta_language").alias("language"))
        pool = fusion.rerank(pool, asked).withColumn("score", F.round("rerank_score", 6))
    else:
        pool = pool.withColumn("score", F.col("rrf_score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("rrf_score"), "chunk_id")
    return pool.withColumn("position", F.row_number().over(w)).where(F.col("position") <= strategy.final).select("query_id", "chunk_id", "position", "score")
