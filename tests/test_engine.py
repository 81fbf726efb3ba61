import pytest
from pyspark.sql import functions as F

from gristmill.operators import chunking as K
from gristmill.operators import compliance as C
from gristmill.operators import grounding as G
from gristmill.operators import history as H
from gristmill.operators import ingest as I
from gristmill.plans import flows
from gristmill.sources import files as S
from gristmill.sources import index_store
from gristmill.streaming import ingest as X


def test_consensus_table(spark):
    cols = "text_id string, algo string, phrase string, score double, threshold double"
    rows = [("deep", "A", "p", 0.9, 0.5), ("deep", "B", "q", 0.9, 0.5), ("wide", "A", "p", 0.1, 0.5), ("wide", "B", "p", 0.1, 0.5), ("none", "A", "p", 0.1, 0.5), ("zero", "A", "p", 0.0, 0.5)]
    got = {r["text_id"]: (r["depth"], r["breadth"], r["objected"]) for r in C.consensus(spark.createDataFrame(rows, cols), 2, 2, "text_id").collect()}
    assert got == {"deep": (2, 1, True), "wide": (0, 2, True), "none": (0, 1, False), "zero": (0, 0, False)}


def test_scorers(spark):
    t = spark.createDataFrame([("1", "The Secondary-Server is down"), ("2", "nothing"), ("3", None), ("4", "second servers")], "text_id string, text string")
    p = spark.createDataFrame([("secondary server",), ("very long phrase indeed",)], "phrase string")
    assert [(r["text_id"], r["score"]) for r in C.regex_scores(t, p).collect()] == [("1", 1.0)]
    assert {(r["text_id"], r["score"]) for r in C.regex_scores(t, p, fuzzy=True).collect()} == {("1", 1.0), ("4", 0.75)}
    assert {(r["text_id"], r["score"]) for r in C.jaccard_scores(t, p).collect()} >= {("1", 1.0)}
    assert C.jaccard_scores(t, p.limit(0)).count() == 0 and C.bm25_scores(t, p).count() == 0


def test_intent_gate(spark):
    q = spark.createDataFrame([("a", "how to make storage controller"), ("b", "make tea"), ("c", "storage controller study"), ("d", None)], "query_id string, text string")
    e = spark.createDataFrame([("s", "storage controller", 40)], "category string, term string, weight int")
    i = spark.createDataFrame([("make", r"(?i)\bmake\b", 35), ("study", r"(?i)\bstudy\b", -20)], "name string, pattern string, weight int")
    got = {r["query_id"]: (r["score"], r["outcome"]) for r in C.intent_gate(q, e, i, ["s"], ["make"]).collect()}
    assert got == {"a": (75, "REFUSE"), "b": (35, "ALLOW_WITH_SAFETY_FRAMING"), "c": (20, "ALLOW"), "d": (0, "ALLOW")}


def test_packers():
    assert K.pack(["a b", "c d", "e"], 4) == ["a b c d", "e"]
    assert K.pack(["a b c d e f"], 3) == ["a b c d e f"]
    assert K.sliding("Aa bb cc. Dd ee ff. Gg hh ii.", 6, 1) == ["Aa bb cc. Dd ee ff.", "Dd ee ff. Gg hh ii.", "Gg hh ii."]
    assert K.headings("# A\nx\n## B\ny\n# C\nz", mode="prefix") == ["[section: A]\nx", "[section: A > B]\ny", "[section: C]\nz"]
    assert K.merge_short(["a", "b c", "d"], 2) == ["a b c d"]
    for t in ("", None, "  \n "):
        assert K.sentence_windows(t or "") == [] and K.headings(t) == [] and K.recursive(t or "") == []
    words = " ".join(map(str, range(1000)))
    parts = K.recursive(words, 256, 32)
    assert all(len(p.split()) <= 256 for p in parts) and set(" ".join(parts).split()) == set(words.split())


def test_table_rows_repeat_header_and_cut_columns():
    rows = [["h1", "h2"], ["a b c", "d"], ["e f", "g"]]
    parts = K.table_rows(rows, 1, 10)
    assert all(p.startswith("h1 | h2\n") for p in parts) and len(parts) == 2
    wide = K.table_rows([["x" + str(i) for i in range(40)]], 0, 20)
    assert sum(p.count("x") for p in wide) == 40 and len(wide) > 1
    assert K.table_rows(None) == [] and K.table_rows([["h"]], 1) == ["h"]


def test_grounding(spark):
    s = spark.createDataFrame([("q", 1, "The small team moved the old ledger today"), ("q", 2, "Too short here"), ("q", 3, "It did not move 42 ledgers to the annex")], "answer_id string, sentence_no int, sentence string")
    c = spark.createDataFrame([("q", "c1", "Yesterday the small team moved the old ledger away."), ("q", "c2", None), ("z", "c3", "The small team moved the old ledger today")], "answer_id string, chunk_id string, text string")
    assert [(r["sentence_no"], r["chunk_id"]) for r in G.strict(s, c).collect()] == [(1, "c1")]
    assert {(r["sentence_no"], r["chunk_id"]) for r in G.relaxed(s, c).collect()} == {(1, "c1")}
    claims = spark.createDataFrame([("a", "prose", True), ("a", "list", False), ("b", "prose", True), ("c", "prose", False), ("c", "list", True), ("d", "list", True)], "answer_id string, kind string, supported boolean")
    assert {r[0]: r[1] for r in G.evidence_gate(claims).collect()} == {"a": False, "b": True, "c": False, "d": True}


def test_summary_support_checks_numbers_and_negation(spark):
    s = spark.createDataFrame([("a", 1, "The team moved 42 old ledgers away"), ("a", 2, "The team moved 43 old ledgers away"), ("a", 3, "The team never moved 42 old ledgers away")], "answer_id string, sentence_no int, sentence string")
    c = spark.createDataFrame([("a", "c", "The team moved 42 old ledgers away today")], "answer_id string, chunk_id string, text string")
    assert [r["sentence_no"] for r in G.summary_support(s, c).collect()] == [1]


def test_ingest_totals_quirk(spark):
    rows = [(1, 5, 5), (2, 0, 0), (3, 5, 2), (4, 5, 0), (5, None, None)]
    got = {r["file_id"]: (r["skip_status"], r["status"]) for r in I.totals(spark.createDataFrame(rows, "file_id bigint, inserted int, skipped int")).collect()}
    assert got == {1: ("ALL", "NOT_OK"), 2: ("ALL", "NOT_OK"), 3: ("PARTIAL", "OK"), 4: ("NONE", "OK"), 5: ("ALL", "NOT_OK")}


def test_where_clause():
    assert I.where_clause("A like 'LIKE %' AND N >= 3", ["N"]) == "A ILIKE 'LIKE %' AND try_cast(N AS DOUBLE) >= 3"


def test_classification_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("OK", "/a/x.md", ["p", "q"], {"k": "v"}, 7), ("NOT_OK", "", None, None, None)], "Status string, FilePath string, Labels array<string>, Extra map<string,string>, WordCount int")
    S.write_classification(df, str(tmp_path / "c"))
    back = S.read_classification(spark, str(tmp_path / "c"), "FilePath LIKE '%X.MD' AND WordCount > 5").collect()
    assert len(back) == 1 and back[0]["Labels"] == "p, q" and back[0]["Extra"] == "k: v" and back[0]["Status"] == "OK"
    with pytest.raises(Exception):
        S.read_classification(spark, str(tmp_path / "c"), "NoSuch = 1").collect()
    got = S.coerced(spark.createDataFrame([("7",), ("1.5",), ("x",), (None,)], "v string"), "v").collect()
    assert [(r["v_int"], r["v_float"], r["v_text"]) for r in got] == [(7, None, None), (None, 1.5, None), (None, None, "x"), (None, None, None)]


def test_files_and_encodings(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("grün".encode())
    (tmp_path / "sub" / "b.MD").write_bytes("déjà vu".encode("cp1252"))
    (tmp_path / "c.bin").write_bytes(b"x")
    (tmp_path / "d.html").write_text("<p>Hi</p><nav>no</nav>")
    got = {r["file_type"]: r["text"] for r in S.read_text(spark, str(tmp_path)).collect()}
    assert got == {"txt": "grün", "md": "déjà vu"}
    assert [r["text"] for r in S.read_html(spark, str(tmp_path)).collect()] == ["Hi"]
    assert {r["text"] for r in S.read_documents(spark, str(tmp_path), {"html": lambda b: str(len(b))}).collect()} == {"26" if False else str(len((tmp_path / "d.html").read_bytes()))}


def test_index_store(spark, tmp_path):
    from gristmill.operators.retrieval import Bm25Index

    chunks = spark.createDataFrame([("a", "red fish"), ("b", "blue")], "chunk_id string, text string")
    built = []

    def build(c):
        built.append(1)
        i = Bm25Index(c)
        return {"postings": i.postings, "terms": i.terms}

    for c in (chunks, chunks, chunks.union(chunks.limit(1))):
        t = index_store.load_or_build(spark, str(tmp_path / "ix"), "Test", c, build, ["postings", "terms"])
        assert t["terms"].count() == 3
    assert len(built) == 2


def test_stream_upsert(spark, tmp_path):
    src, target, schema = str(tmp_path / "in"), str(tmp_path / "out"), "file_path string, file_hash string, ingested_at timestamp"
    put = lambda rows: spark.createDataFrame(rows, "file_path string, file_hash string, t string").selectExpr("file_path", "file_hash", "cast(t as timestamp) ingested_at").coalesce(1).write.mode("append").parquet(src)
    put([("/a", "1", "2024-01-01"), ("/b", "1", "2024-01-01"), ("/a", "1", "2024-01-01")])
    from pyspark.sql.types import _parse_datatype_string

    s = X.new_versions(X.file_stream(spark, src, _parse_datatype_string(schema)))
    X.start_upsert(s, target, str(tmp_path / "cp"), buckets=4).awaitTermination()
    assert spark.read.parquet(target).count() == 2
    put([("/a", "2", "2024-01-02")])
    X.start_upsert(X.new_versions(X.file_stream(spark, src, _parse_datatype_string(schema))), target, str(tmp_path / "cp"), buckets=4).awaitTermination()
    assert {(r["file_path"], r["file_hash"]) for r in spark.read.parquet(target).collect()} == {("/a", "2"), ("/b", "1")}


def test_flows():
    assert flows.resolve("ENGLISH_BM25").retrievers == ("BM25",)
    assert flows.resolve(rerank=False).rerank is False
    for bad in (dict(name="X"), dict(nothing=1), dict(retrievers=("X",)), dict(rerank="yes"), dict(query_source="X")):
        with pytest.raises(ValueError):
            flows.resolve(**({"name": "NATIVE_ALL"} | bad))
    assert flows.retrieval_mode("ALL") == ("VECTOR", "BM25", "GRAPH", "REGEX") and flows.retrieval_mode("VECTOR_BM25") == ("VECTOR", "BM25")
    assert flows.cast_setting("on", "bool") is True and flows.cast_setting("7", "int") == 7


def test_history(spark):
    t = spark.createDataFrame([("c", i, f"t{i}") for i in range(1, 6)], "conv_id string, turn int, text string")
    got = {(r["turn"], r["kind"]) for r in H.pruned(t, 2).collect()}
    assert got == {(5, "turn"), (4, "turn"), (3, "summary")}
    a = '{"depends": true, "confidence": 0.9, "contextual": "ctx", "standalone": "s"}'
    q = spark.createDataFrame([(a, "it runs"), ('{"depends": false, "standalone": "the cat runs"}', "it runs"), ("junk", "who")], "a string, q string")
    assert [r[0] for r in q.select(H.rewritten_query(F.col("a"), F.col("q"), F.array().cast("array<string>"))).collect()] == ["ctx", "it runs", "who"]
    assert H.summaries(spark.createDataFrame([(1, "Aa bb cc. " * 400), (2, None), (3, "short")], "doc_id bigint, text string"), 50).count() == 2


def test_metadata_filter(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    assert I.matching(df, {"k": "a", "n": {"$gt": 5}}).count() == 1 and I.matching(df, None).count() == 2
    assert I.matching(df, {"$and": [{"k": {"$in": ["a", "b"]}}, {"n": 2}]}).count() == 1
