"""Conversations, document selection, synonyms, keywords and summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import grams


def synonyms(phrases: DataFrame, table: DataFrame, depth: int = 1, most: int = 5, stop: list[str] | None = None) -> DataFrame:
    """(phrase, synonym): the words within ``depth`` steps of a synonym table, the first ``most`` by step and then alphabet.

    phrases: (phrase), one word each; table: (lemma, synonym).
    """
    seen = phrases.select("phrase", F.lower("phrase").alias("word")).distinct().withColumn("step", F.lit(0))
    front = seen
    links = table.select(F.lower("lemma").alias("word"), F.lower("synonym").alias("next")).distinct()
    if stop:
        links = links.where(~F.col("next").isin(stop))
    for d in range(1, depth + 1):
        nxt = front.join(links, "word").select("phrase", F.col("next").alias("word")).distinct()
        front = nxt.join(seen.select("phrase", "word"), ["phrase", "word"], "left_anti").withColumn("step", F.lit(d))
        seen = seen.unionByName(front)
    w = Window.partitionBy("phrase").orderBy("step", "word")
    return seen.where("step > 0").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("phrase", F.col("word").alias("synonym"), "n")


def expanded_queries(queries: DataFrame, syn: DataFrame) -> DataFrame:
    """(query_id, text): each query's text with the synonyms of its words after it."""
    words = queries.select("query_id", F.explode(F.array_distinct(T.tokens("text"))).alias("phrase"))
    extra = words.join(syn, "phrase").groupBy("query_id").agg(F.array_sort(F.collect_set("synonym")).alias("s"))
    return queries.join(extra, "query_id", "left").select("query_id", F.concat_ws(" ", "text", F.array_join(F.coalesce("s", F.array().cast("array<string>")), " ")).alias("text"))


def pruned(turns: DataFrame, keep: int) -> DataFrame:
    """The last ``keep`` turns of each conversation as they are, all before them as one row of kind ``summary``.

    turns: (conv_id, turn, text).
    """
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    r = turns.withColumn("_n", F.row_number().over(w))
    old = r.where(F.col("_n") > keep).groupBy("conv_id").agg(F.max("turn").alias("turn"), F.count(F.lit(1)).cast("string").alias("n"))
    return r.where(F.col("_n") <= keep).select("conv_id", "turn", "text", F.lit("turn").alias("kind")).unionByName(
        old.select("conv_id", "turn", F.concat(F.lit("summary of "), "n", F.lit(" turns")).alias("text"), F.lit("summary").alias("kind"))
    )


def rewritten_query(answer: Column, original: Column, history_words: Column, minimum: float = 0.5) -> Column:
    """The text to ask with, from a rewriter's JSON answer (depends, confidence, contextual, standalone).

    Contextual if the turn depends on its history with enough confidence; else standalone, unless
    it adds words that neither query nor history has while a pronoun is left; else the original.
    """
    a = F.from_json(answer, "depends boolean, confidence double, contextual string, standalone string")
    added = F.size(F.array_except(T.tokens(F.coalesce(a["standalone"], F.lit(""))), F.concat(T.tokens(original), history_words)))
    pronoun = F.arrays_overlap(T.tokens(original), F.array(*[F.lit(p) for p in ("he", "she", "it", "they", "him", "her", "them", "his", "its", "their")]))
    good = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return F.when(a["depends"] & (a["confidence"] >= minimum) & good(a["contextual"]), a["contextual"]).when(good(a["standalone"]) & ~(pronoun & (added > 0)), a["standalone"]).otherwise(original)


def unresolved_pronoun(text: Column) -> Column:
    """A question that starts with a pronoun and names nothing: no capitalised word and no digit after the first word."""
    rest = F.regexp_replace(F.trim(text), r"^\S+\s*", "")
    return F.lower(F.trim(text)).rlike(r"^(?:and |but |so )?(?:he|she|it|they|this|that|these|those)\b|\b(?:his|its|their)\b") & ~rest.rlike(r"[A-Z\d]")


def select_document(files: DataFrame, name: str) -> DataFrame:
    """(file_id, file_path, ambiguous): the files of a name or path, marked where more than one path has it."""
    n = F.lit(name.lower().replace("\\", "/"))
    p = F.lower(T.path_normalise(F.col("file_path")))
    hit = files.where((F.lower("file_name") == n) | (p == n)).select("file_id", "file_path")
    paths = hit.agg((F.min("file_path") != F.max("file_path")).alias("ambiguous"))
    return hit.withColumn("_1", F.lit(1)).join(F.broadcast(paths.withColumn("_1", F.lit(1))), "_1").drop("_1").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


def keywords(documents: DataFrame, n_max: int = 4, first: int = 60, second: int = 30) -> DataFrame:
    """(doc_id, keyword, weight): two passes, phrases of up to four words and then the words of the best phrases.

    Weights are tf-idf over the documents, in place of an embedding model's similarity.
    """
    return grams.best_words(documents, n_max, first, second)


def summaries(documents: DataFrame, budget: int = 400, sentences_each: int = 3) -> DataFrame:
    """(doc_id, rounds, text): batches of sentences under a token budget, each cut to its first sentences, until the rest fits.

    A stand-in for a model that summarises: each round keeps the opening sentences of every batch,
    so the text shrinks in each. A sentence over the budget stands alone and is cut to it.
    """
    from gristmill.operators.chunking import count, pack, sentences

    def reduce(text: str) -> tuple[int, str]:
        rounds, limit = 0, max(1, int(budget / 1.3))
        while count(text) > limit:
            parts = [" ".join(s.split()[:limit]) for s in sentences(text) or [text]]
            batches = pack(parts, limit)
            short = " ".join(" ".join(sentences(b)[:sentences_each]) for b in batches)
            if count(short) >= count(text):
                short = " ".join(text.split()[: max(limit, count(text) // 2)])
            text, rounds = short, rounds + 1
        return rounds, text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(d, *reduce(t)) for d, t in zip(b["doc_id"], b["text"]) if t]
            yield pd.DataFrame(out, columns=["doc_id", "rounds", "text"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(run, "doc_id bigint, rounds int, text string")


def marked(text: Column, spans: list[str]) -> Column:
    """A text with each of the given lines between ``<mark>`` and ``</mark>``."""
    for s in sorted(set(spans), key=len, reverse=True):
        text = F.replace(text, F.lit(s), F.lit(f"<mark>{s}</mark>"))
    return text


def confidence_log(steps: DataFrame, names: list[str]) -> DataFrame:
    """A row per turn with the columns of each step of it: ``step_column``; a step that a turn lacks is null.

    steps: (turn_id, step, level, score); names: the steps there may be, in order of their columns.
    """
    picked = [F.max(F.when(F.col("step") == n, F.col(c))).alias(f"{n}_{c}") for n in names for c in ("level", "score")]
    return steps.groupBy("turn_id").agg(*picked)
