"""How well sentences of an answer are grounded in chunks of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as T

#: Fixed values.
SENTENCE, WINDOW, FRAGMENT = 5, 5, 12
LOOSE_SENTENCE, LOOSE_TOKEN, LOOSE_SHARED, LOOSE_LONG, LOOSE_SHARE = 4, 3, 3, 5, 0.60
PASSAGE, SUPPORT_SHARED, SUPPORT_RATIO = 48, 4, 0.60
NEGATIONS = ["no", "not", "never", "none", "without", "kein", "keine", "nicht", "nie", "pas", "jamais", "sin", "nunca", "non", "mai", "senza", "não", "sem"]


def strict(sentences: DataFrame, chunks: DataFrame, n: int = WINDOW) -> DataFrame:
    """(answer_id, sentence_no, chunk_id): sentences that share a run of min(n, length) words with a chunk.

    sentences: (answer_id, sentence_no, sentence) of at least five words; chunks: (answer_id,
    chunk_id, text), the evidence of each answer. Joined on the answer and the run, so a run that
    many chunks have only meets the sentences of its own answer.
    """
    s = sentences.select("answer_id", "sentence_no", T.grounding_tokens("sentence").alias("t")).where(F.size("t") >= SENTENCE)
    c = chunks.select("answer_id", "chunk_id", T.grounding_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    a = s.select("answer_id", "sentence_no", F.explode(F.array_distinct(T.windows(F.col("t"), n))).alias("run"))
    b = c.select("answer_id", "chunk_id", F.explode(F.array_distinct(T.windows(F.col("t"), n))).alias("run"))
    return a.join(b, ["answer_id", "run"]).select("answer_id", "sentence_no", "chunk_id").distinct()


def relaxed(sentences: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sentences that share enough words of three letters: three or more, one of five letters, containment from .60."""
    keep = lambda c: F.array_distinct(F.filter(T.grounding_tokens(c), lambda w: F.length(w) >= LOOSE_TOKEN))
    s = sentences.select("answer_id", "sentence_no", F.size(T.grounding_tokens("sentence")).alias("len"), keep(F.col("sentence")).alias("t")).where(F.col("len") >= LOOSE_SENTENCE)
    c = chunks.select("answer_id", "chunk_id", keep(F.coalesce("text", F.lit(""))).alias("t"))
    a = s.select("answer_id", "sentence_no", F.size("t").alias("na"), F.explode("t").alias("w"))
    b = c.select("answer_id", "chunk_id", F.size("t").alias("nb"), F.explode("t").alias("w"))
    both = a.join(b, ["answer_id", "w"]).groupBy("answer_id", "sentence_no", "chunk_id", "na", "nb").agg(F.count(F.lit(1)).alias("shared"), F.max(F.length("w")).alias("longest"))
    share = F.col("shared") / F.least("na", "nb")
    return both.where((F.col("shared") >= LOOSE_SHARED) & (F.col("longest") >= LOOSE_LONG) & (share >= LOOSE_SHARE)).select("answer_id", "sentence_no", "chunk_id", share.alias("containment"))


def evidence_gate(claims: DataFrame) -> DataFrame:
    """(answer_id, grounded): all claims of prose supported, and one of a list or diagram if there are any.

    claims: (answer_id, kind, supported) with kind prose, list or diagram.
    """
    prose = F.col("kind") == "prose"
    g = claims.groupBy("answer_id").agg(F.coalesce(F.every(F.when(prose, F.col("supported"))), F.lit(True)).alias("p"), F.some(F.when(~prose, F.col("supported"))).alias("o"))
    return g.select("answer_id", (F.col("p") & F.coalesce("o", F.lit(True))).alias("grounded"))


def summary_support(sentences: DataFrame, chunks: DataFrame) -> DataFrame:
    """(answer_id, sentence_no, chunk_id, ratio): the chunk that best supports each sentence of a summary.

    Its numbers stand in the chunk, it negates as the chunk does, and at least four words and .60
    of its words are shared. Of equal ratios the first chunk holds.
    """
    words = lambda c: F.array_distinct(F.filter(T.grounding_tokens(c), lambda w: (F.length(w) >= 3) | w.rlike(r"^\d")))
    nums = lambda a: F.filter(a, lambda w: w.rlike(r"^\d+$"))
    neg = lambda c: F.arrays_overlap(T.grounding_tokens(c), F.array(*[F.lit(x) for x in NEGATIONS]))
    s = sentences.select("answer_id", "sentence_no", words(F.col("sentence")).alias("t"), neg(F.col("sentence")).alias("neg"))
    c = chunks.select("answer_id", "chunk_id", words(F.col("text")).alias("t"), neg(F.col("text")).alias("neg"))
    # they meet by the words they share, as a pair that shares none supports nothing
    a = s.select("answer_id", "sentence_no", "neg", F.size("t").alias("n"), F.size(nums(F.col("t"))).alias("numbers"), F.explode("t").alias("w"))
    b = c.select("answer_id", "chunk_id", "neg", F.explode("t").alias("w"))
    j = a.join(b, ["answer_id", "neg", "w"]).groupBy("answer_id", "sentence_no", "chunk_id", "n", "numbers").agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("w").rlike(r"^\d+$")).alias("held"))
    j = j.withColumn("ratio", F.col("shared") / F.col("n"))
    ok = j.where((F.col("held") == F.col("numbers")) & (F.col("shared") >= SUPPORT_SHARED) & (F.col("ratio") >= SUPPORT_RATIO))
    return ok.groupBy("answer_id", "sentence_no").agg(F.max_by(F.struct("chunk_id", "ratio"), F.struct("ratio", F.col("chunk_id"))).alias("b")).select("answer_id", "sentence_no", "b.chunk_id", "b.ratio")


def cross_language(sentences: DataFrame, proxies: DataFrame, chunks: DataFrame, n: int = WINDOW) -> DataFrame:
    """(answer_id, sentence_no, chunk_id, via): sentences grounded in evidence of their own language or of another.

    sentences: (answer_id, sentence_no, language, sentence); proxies: the same sentences
    translated, with the language they were translated to; chunks: (answer_id, chunk_id, language,
    text). A chunk in the answer's language meets the sentence itself, any other the proxy in the
    chunk's language. Where none of an answer's chunks is in its language or in that of a proxy,
    all its chunks meet the proxies, and the sentence itself where it has none. via is
    ``original`` or ``translated``.
    """
    own = sentences.select("answer_id", "sentence_no", "language", "sentence", F.lit("original").alias("via"))
    other = proxies.join(own.select("answer_id", "sentence_no", F.col("language").alias("_own")), ["answer_id", "sentence_no"]).where("language <> _own").select("answer_id", "sentence_no", "language", "sentence", F.lit("translated").alias("via"))
    said = own.unionByName(other)
    met = chunks.join(said.select("answer_id", "language").distinct(), ["answer_id", "language"], "left_semi").select("answer_id").distinct()
    alone = said.join(met, "answer_id", "left_anti")
    first = alone.withColumn("_any", F.some(F.col("via") == "translated").over(Window.partitionBy("answer_id", "sentence_no"))).where((F.col("via") == "translated") | ~F.col("_any"))
    # a key stands for the language where one is met, and for any where none is
    asked = said.join(met, "answer_id", "left_semi").select("answer_id", "language", "sentence_no", "sentence", "via").unionByName(first.select("answer_id", F.lit("*").alias("language"), "sentence_no", "sentence", "via"))
    given = chunks.join(met, "answer_id", "left_semi").select("answer_id", "chunk_id", "language", "text").unionByName(chunks.join(met, "answer_id", "left_anti").select("answer_id", "chunk_id", F.lit("*").alias("language"), "text"))
    a = asked.select("answer_id", "language", "sentence_no", "via", T.grounding_tokens("sentence").alias("t")).where(F.size("t") >= SENTENCE)
    a = a.select("answer_id", "language", "sentence_no", "via", F.explode(F.array_distinct(T.windows(F.col("t"), n))).alias("run"))
    b = given.select("answer_id", "chunk_id", "language", F.explode(F.array_distinct(T.windows(T.grounding_tokens(F.coalesce("text", F.lit(""))), n))).alias("run"))
    return a.join(b, ["answer_id", "language", "run"]).select("answer_id", "sentence_no", "chunk_id", "via").distinct()
