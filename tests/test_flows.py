import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import fusion, grounding, history, ingest, retrieval
from gristmill.plans import flows
from gristmill.sources import files


def test_sentences_keep_their_digits(spark):
    text = "No. one. 281 things cost 11. Then 22 more came. 3"
    got = spark.createDataFrame([(text,)], "t string").select(T.sentences(F.col("t"))).first()[0]
    assert got == ["No.", "one.", "281 things cost 11.", "Then 22 more came.", "3"]


def test_rerank_picks_one_language(spark):
    rows = [(1, "a", "en", "local", 1.0), (1, "b", "de", "local", 2.0), (1, "c", "de", "local", 0.0), (1, "w", None, "web", 4.0), (2, "a", "fr", "local", 1.0), (2, "b", "fr", "local", 1.0), (3, "w", None, "Web", 3.0), (3, "x", None, "web", 1.0), (4, "n", None, None, 1.0)]
    pool = spark.createDataFrame(rows, "query_id long, chunk_id string, language string, source string, raw double")
    asked = spark.createDataFrame([(1, "en"), (1, "de"), (1, None), (2, "es"), (3, "en")], "query_id long, language string")
    got = {(r["query_id"], r["chunk_id"]): r["rerank_score"] for r in fusion.rerank(pool, asked).collect()}
    assert got == {(1, "b"): 0.5, (1, "c"): 0.0, (1, "w"): 0.5, (2, "a"): 0.0, (2, "b"): 0.0, (3, "w"): 1.0, (3, "x"): 0.0, (4, "n"): 0.0}


def test_confidence_parts(spark):
    rows = [(1, 1, 2.0, "local", False), (1, 2, 0.0, "web", False), (2, 1, -3.0, "local", True), (3, 1, 5.0, "local", False)]
    pool = spark.createDataFrame(rows, "query_id long, position int, raw double, source string, fallback boolean")
    got = {r["query_id"]: r for r in fusion.confidence(pool, 4, F.col("query_id") == 3).collect()}
    s = lambda x: 1 / (1 + math.exp(-x))
    assert got[1]["confidence"] == pytest.approx(0.5 * s(2) + 0.3 * (s(2) + s(0)) / 2 + 0.15 * 0.5 + 0.05 * 0.5)
    assert got[2]["confidence"] == pytest.approx(max(0, 0.8 * s(-3) + 0.15 * 0.25 + 0.05 - 0.15)) and got[2]["penalty"] == 0.15
    assert got[3]["confidence"] == 0 and got[3]["level"] == "LOW"
    df = spark.createDataFrame([(None, 0.7, 3.0), (None, None, 3.0), (None, None, None), (0.0, 0.1, None)], "raw double, scaled double, other double")
    assert [r[0] for r in df.select(fusion.evidence_score(F.col("raw"), F.col("scaled"), F.col("other"))).collect()] == [0.7, 0.5, 0.0, 0.5]


def test_index_after_deletion_is_that_of_the_rest(spark):
    rows = [(f"c{i}", f"alpha {'beta ' * (i % 3)}gamma{i % 4} delta") for i in range(40)] + [("empty", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string")
    gone = chunks.where("chunk_id in ('c1', 'c7', 'c8', 'none')")
    one = retrieval.Bm25Index(chunks).without(gone)
    two = retrieval.Bm25Index(chunks.join(gone, "chunk_id", "left_anti"))
    seen = lambda i: {r["term"]: (r["df"], round(r["idf"], 9)) for r in i.terms.collect()}
    assert seen(one) == seen(two) and one.corpus.select("n", "avg_dl").first() == two.corpus.select("n", "avg_dl").first()
    q = spark.createDataFrame([(1, "alpha beta beta gamma1"), (2, None), (3, "zzz")], "query_id long, text string")
    hits = lambda i: sorted((r["query_id"], r["chunk_id"], round(r["score"], 9)) for r in i.scores(q).collect())
    assert hits(one) == hits(two) and hits(one)
    assert retrieval.Bm25Index(chunks).without(chunks).terms.count() == 0


def test_numbered_over_all_ranges(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("v")).repartition(7)
    got = {r["v"]: r["position"] for r in fusion.numbered(df, ["v"]).collect()}
    assert got == {v: v + 1 for v in range(500)}
    assert fusion.numbered(df.limit(0), ["v"]).count() == 0


HITS = "query_id long, retriever string, leg string, hit_rank int, chunk_id string"


def test_legs(spark):
    hits = spark.createDataFrame([(q, r, leg, 1, f"{leg}-{r}") for q in (1, 2, 3) for leg in ("final", "seed", "original") for r in ("vector", "bm25")], HITS)
    queries = spark.createDataFrame([(1, "final", "A cat", "de"), (1, "seed", "a CAT ", "de"), (1, "original", "eine Katze", "de"), (2, "final", "x", "en"), (3, "final", "x", None), (3, "seed", "y", None)], "query_id long, leg string, text string, meta_language string")
    got = {(r["query_id"], r["chunk_id"]) for r in flows.legs(hits, queries, flows.resolve("NATIVE_ALL_MULTILEG")).collect()}
    finals = {(q, f"final-{r}") for q in (1, 2, 3) for r in ("vector", "bm25")}
    assert got == finals | {(q, f"seed-{r}") for q in (2, 3) for r in ("vector", "bm25")} | {(1, "original-vector")}
    assert {(r["query_id"], r["chunk_id"]) for r in flows.legs(hits, queries, flows.resolve("ENGLISH_BM25")).collect()} == {(q, "final-bm25") for q in (1, 2, 3)}


def test_flow_drops_near_duplicates_like_a_walk_down_the_list(spark):
    texts = {"a": "one two three four five six seven", "b": "one two three four five six seven", "c": "nine ten eleven twelve", "d": "one two three four five six seven eight", "e": ""}
    hits = spark.createDataFrame([(1, "bm25", "final", i + 1, c) for i, c in enumerate("bacde")], HITS)
    chunks = spark.createDataFrame([(c, "local", "en", t) for c, t in texts.items()], "chunk_id string, source string, language string, text string")
    queries = spark.createDataFrame([(1, "final", "q", "en")], "query_id long, leg string, text string, meta_language string")
    kept = []
    for c in "bacde":
        s = set(texts[c].split())
        if not any(s and set(texts[k].split()) and len(s & set(texts[k].split())) / len(s | set(texts[k].split())) >= fusion.DUPLICATE for k in kept):
            kept.append(c)
    run = lambda **kw: [r["chunk_id"] for r in flows.run(hits, queries, chunks, flows.resolve("NATIVE_ALL", **kw)).orderBy("position").collect()]
    assert run() == kept and run(deduplicate=False) == list("bacde")


def test_cross_language(spark):
    s = spark.createDataFrame([(1, 1, "en", "the cat sat on the mat today"), (2, 1, "en", "the dog ran over the hill today")], "answer_id long, sentence_no int, language string, sentence string")
    p = spark.createDataFrame([(1, 1, "de", "die katze saß auf der matte heute"), (2, 1, "de", "der hund lief über den hügel heute")], s.schema)
    c = spark.createDataFrame([(1, "own", "en", "so the cat sat on the mat"), (1, "de", "de", "und die katze saß auf der matte"), (1, "mixed", "de", "the cat sat on the mat"), (2, "none", "fr", "der hund lief über den hügel"), (2, "orig", "fr", "the dog ran over the hill")], "answer_id long, chunk_id string, language string, text string")
    got = {(r["answer_id"], r["chunk_id"], r["via"]) for r in grounding.cross_language(s, p, c).collect()}
    assert got == {(1, "own", "original"), (1, "de", "translated"), (2, "none", "translated")}


def test_lists_and_stores(spark):
    one = lambda *p: spark.createDataFrame([(x,) for x in p], "file_path string")
    listed = ingest.excluded(one("/a", "/b", "/b", None, " "), one("D:\\c"), one("/a", "/zz"))
    assert {r[0] for r in listed.collect()} == {"/b", "D:/c"}
    assert {r[0] for r in ingest.allowed(one("/a", "/b", "D:\\c", None), listed).collect()} == {"/a", None}
    docs = spark.createDataFrame([("s", 1, "2024-01-01", 5), ("s", 2, "2024-01-09", 50), ("s", 3, "2024-01-10", 40), ("s", 4, "2024-01-10", None), ("t", 5, None, 1)], "store string, doc_id long, day string, bytes int").withColumn("at", F.col("day").cast("timestamp"))
    assert {r["doc_id"] for r in ingest.stored(docs, "5 days", 80).collect()} == {3, 4}
    steps = spark.createDataFrame([(1, "a", "HIGH", 0.9), (1, "b", "LOW", 0.1), (2, "b", "LOW", 0.2)], "turn_id long, step string, level string, score double")
    assert {tuple(r) for r in history.confidence_log(steps, ["a", "b"]).collect()} == {(1, "HIGH", 0.9, "LOW", 0.1), (2, None, None, "LOW", 0.2)}


def _office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, f'<?xml version="1.0"?><x xmlns="urn:n" xmlns:w="urn:w">{body}</x>')
    return out.getvalue()


def test_office_readers(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(_office({"word/document.xml": "<w:p><w:r><w:t>First</w:t></w:r><w:r><w:t> one</w:t></w:r></w:p><w:p/><w:p><w:t>Second</w:t></w:p>"}))
    (tmp_path / "b.pptx").write_bytes(_office({"ppt/slides/slide10.xml": "<w:p><w:t>last</w:t></w:p>", "ppt/slides/slide2.xml": "<w:p><w:t>first</w:t></w:p>"}))
    (tmp_path / "c.xlsx").write_bytes(_office({"xl/sharedStrings.xml": "<si><t>name</t></si><si><r><t>va</t></r><r><t>lue</t></r></si>", "xl/worksheets/sheet1.xml": '<row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c><v>7</v></c><c t="inlineStr"><is><t>x</t></is></c></row><row/>'}))
    (tmp_path / "d.docx").write_bytes(b"damaged")
    got = {r["file_path"].rsplit("/", 1)[-1]: r["text"] for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": "First one\nSecond", "b.pptx": "first\nlast", "c.xlsx": "name | value\n7 | x", "d.docx": None}


def test_no_machine_local_folder_on_a_cluster():
    from gristmill.session import shared_folder

    class Stub:
        class conf:
            @staticmethod
            def get(k, d=None):
                return d

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(ValueError):
        shared_folder(Stub)
