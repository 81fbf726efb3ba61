import math

import pytest
from pyspark.sql import functions as F

from gristmill.operators import selection as S


def test_rescue_sizes():
    assert S.rescue_sizes(None, None) == (40, 24)
    assert S.rescue_sizes(20, 4) == (20, 5)
    assert S.rescue_sizes(50, 50) == (20, 12)


def test_rescue(spark):
    pool = spark.createDataFrame([(1, "a", "f1")], "query_id bigint, chunk_id string, file_path string")
    rows = [("a", "f1", "red fish", False), ("b", "f1", "red", False), ("c", "f1", "blue", False), ("t", "f1", "red table", True), ("z", "f2", "red", False), ("n", "f1", None, False)]
    chunks = spark.createDataFrame(rows, "chunk_id string, file_path string, text string, is_table boolean")
    q = spark.createDataFrame([(1, "red fish"), (2, "red")], "query_id bigint, text string")
    assert {r["chunk_id"] for r in S.rescue(pool, chunks, q).collect()} == {"b", "t"}
    big = spark.createDataFrame([(1, f"x{i}", "f1") for i in range(60)], "query_id bigint, chunk_id string, file_path string")
    assert S.rescue(big, chunks, q).count() == 0


def test_web_bm25(spark):
    rows = [(1, "red red fish", "a", "red fish fish"), (1, "red red fish", "b", "blue"), (1, "red red fish", "c", None)]
    got = {r["result_id"]: r["score"] for r in S.web_bm25(spark.createDataFrame(rows, "query_id bigint, query string, result_id string, text string")).collect()}
    avg = max(4 / 3, 1.0)
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    want = sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * 3 / avg)) for tf in (1, 2))
    assert got == {"a": pytest.approx(want)}


def test_web_cosine_prefers_the_snippet(spark):
    rows = [(1, "red fish", "a", "nothing like", "red fish"), (1, "red fish", "b", "red fish", ""), (1, "red fish", "c", "other words", None)]
    got = {r["result_id"] for r in S.web_cosine(spark.createDataFrame(rows, "query_id bigint, query string, result_id string, text string, snippet string")).collect()}
    assert {"a", "b"} <= got


def test_semantic_chunks_keep_all_words(spark):
    text = " ".join(f"Word{i} alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi." for i in range(12))
    out = S.semantic_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "One short line.")], "doc_id bigint, text string")).orderBy("doc_id", "my_chunk").collect()
    assert " ".join(r["text"] for r in out if r["doc_id"] == 1).split() == text.split()
    assert [r["doc_id"] for r in out if r["doc_id"] != 1] == [4] and all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-6 for r in out)


def test_stems_and_merge(spark):
    near = spark.createDataFrame([(1, "running", 0.5), (1, "runs", 0.9), (1, "cat", 0.4)], "doc_id bigint, keyword string, closeness double")
    w = spark.createDataFrame([(1, "running", 1.0), (1, "runs", 0.5)], "doc_id bigint, keyword string, weight double")
    got = {r["stem"]: (r["weight"], r["surface"]) for r in S.weighted_stems(near, w).collect()}
    assert got == {"run": (0.5, "running"), "cat": (0.0, "cat")}
    a = spark.createDataFrame([("t", "p", 1.0, 1.0)], "text_id string, phrase string, score double, threshold double")
    b = spark.createDataFrame([("t", "p", 0.5, 0.5), ("t", "q", 0.2, 0.5)], "text_id string, phrase string, score double, threshold double")
    assert {(r["phrase"], r["score"], r["threshold"]) for r in S.merged_by_phrase(a, b).collect()} == {("p", 1.5, 1.5), ("q", 0.2, 0.5)}


def test_outside_boxes(spark):
    words = spark.createDataFrame([(1, 1, 0.5, 0.5), (1, 2, 5.0, 3.0), (2, 3, 0.5, 0.5)], "page int, word_id int, x double, y double")
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (1, 0.0, 9.0, 1.0, 10.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert {(r["word_id"], r["slot"]) for r in S.outside_boxes(words, boxes).collect()} == {(2, 1), (3, 0)}


def test_spans_and_marks(spark):
    s = spark.createDataFrame([("q", 1, "we saw the old red ledger there"), ("q", 2, "nothing")], "answer_id string, sentence_no int, sentence string")
    c = spark.createDataFrame([("q", "c1", "Indeed WE saw the old red ledger.", "/f", 3), ("q", "c2", None, "/f", 3)], "answer_id string, chunk_id string, text string, file_path string, page int")
    o = S.first_overlap(s, c)
    assert [(r["sentence_no"], r["chunk_id"], r["position"]) for r in o.collect()] == [(1, "c1", 2)]
    assert S.snippets(o, c).first()["snippet"].startswith("Indeed WE saw")
    assert S.marked_answer(s, o).first()["text"] == "<mark>we saw the old red ledger there</mark> nothing"


def test_embedding_scores_and_translation(spark):
    t = spark.createDataFrame([("1", "red fish"), ("2", None)], "text_id string, text string")
    p = spark.createDataFrame([("red fish",), ("blue bird",)], "phrase string")
    got = {(r["text_id"], r["phrase"]): r["score"] for r in S.embedding_scores(t, p, "K", 0.45, 0.2).collect()}
    assert got["1", "red fish"] == pytest.approx(1.0) and not any(k[0] == "2" for k in got)
    assert S.translated(t, spark.createDataFrame([("Red", "rot")], "source string, target string")).where("text_id = '1'").first()["text"] == "rot fish"
    r = spark.range(1).select(*S.quality(*[F.lit(1.0)] * 8)).first()
    assert r[0] == pytest.approx(0.9) and r[1] == pytest.approx(0.75) and r[2] == pytest.approx(1.0)
