"""Keywords by way of blocks of documents: the same words as by brute force, and few bytes between tasks."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gristmill.operators import grams, history, selection
from gristmill.plans import selection_queries


def by_hand(rows, n_max, first, second):
    tf = defaultdict(Counter)
    for d, text in rows:
        w = [x for x in re.findall("[a-z0-9]+", (text or "").lower()) if len(x) > 2]
        tf[d].update(" ".join(w[i : i + k]) for k in range(1, n_max + 1) for i in range(len(w) - k + 1))
    n, df, out = len({d for d, _ in rows} - {None}), Counter(g for c in tf.values() for g in c), {}
    for d, c in tf.items():
        w = {g: x * math.log((1 + n) / (1 + df[g])) for g, x in c.items()}
        words = {}
        for g in sorted(w, key=lambda g: (-round(w[g], 9), g))[:first]:
            for x in g.split(" "):
                words[x] = max(words.get(x, -math.inf), w[g])
        out |= {(d, x): round(words[x], 6) for x in sorted(words, key=lambda x: (-round(words[x], 9), x))[:second]}
    return out


def rows_of(n):
    draw = random.Random(7)
    vocabulary = [f"{a}{b}" for a in ("red", "fish", "ledger", "x", "été", "12", "kiln") for b in ("", "s", "ing", "7", "99")]
    rows = [(i, " ".join(draw.choices(vocabulary, weights=range(1, len(vocabulary) + 1), k=draw.randrange(60)))) for i in range(n)]
    return rows + [(3, rows[4][1]), (3, "only ONE more line"), (None, "no key, but a text"), (None, "and one more text"), (n + 1, None), (n + 2, ""), (n + 3, "a b c"), (n + 4, "one")]


@pytest.mark.parametrize(("n_max", "first", "second", "size"), [(4, 60, 30, grams.BLOCK), (4, 12, 5, 100), (1, 5, 3, 300), (2, 7, 30, 1)])
def test_best_words_by_brute_force(spark, n_max, first, second, size):
    rows = rows_of(120)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {(r["doc_id"], r["keyword"]): round(r["weight"], 6) for r in grams.best_words(docs, n_max, first, second, size=size).collect()}
    assert got == by_hand(rows, n_max, first, second)


def test_keys_of_any_kind_and_no_documents(spark):
    rows = [(f"key {d}", text) for d, text in rows_of(10)]
    got = history.keywords(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(r["doc_id"], r["keyword"]): round(r["weight"], 6) for r in got} == by_hand(rows, 4, 60, 30)
    for none in ([], [(1, None), (2, "")]):
        assert history.keywords(spark.createDataFrame(none, "doc_id bigint, text string")).collect() == []


def test_pairs_too_large_to_sort_with_their_places():
    import numpy as np

    high, low = np.array([1 << 30, 5, 1 << 30, 5]), np.array([7, 1 << 31, 7, 3])
    number, h, w = grams._numbered(high, low)
    assert number.tolist() == [2, 1, 2, 0] and h.tolist() == [5, 5, 1 << 30] and w.tolist() == [3, 1 << 31, 7]


def shuffled(df):
    """Bytes written between tasks by a frame that has run."""

    def of(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return of(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return of(node.plan())
        own = node.metrics().apply("shuffleBytesWritten").value() if name == "ShuffleExchangeExec" else 0
        below = node.children()
        return own + sum(of(below.apply(i)) for i in range(below.length()))

    return of(df._jdf.queryExecution().executedPlan())


def test_keywords_move_no_row_per_run(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    text = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    df = history.keywords(docs)
    assert df._jdf.collectToPython() is not None  # runs this frame's own plan, whose figures are read
    assert 0 < shuffled(df) < 4 * text


def test_keyword_pipeline_weighs_once(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kw = history.keywords(docs)
    near = kw.select("doc_id", "keyword", (1 / (1 + F.length("keyword"))).alias("closeness"))
    joined = selection.weighted_stems(near, kw.select("doc_id", "keyword", "weight")).withColumn("weight", F.round("weight", 6))
    df = selection_queries.dom_keyword_pipeline(spark, data)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, joined.collect()))
    assert df._jdf.collectToPython() is not None
    assert 0 < shuffled(df) < 4 * docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
