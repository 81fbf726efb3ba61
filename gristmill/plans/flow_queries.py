"""Queries of whole flows, reranking, needs, stores, sinks and sources, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gristmill.functions import parse as P
from gristmill.operators import fusion
from gristmill.operators import grounding as G
from gristmill.operators import history as H
from gristmill.operators import ingest
from gristmill.operators import retrieval as V
from gristmill.operators import selection as S
from gristmill.plans import flows
from gristmill.plans import retrieval_queries as R
from gristmill.session import durable, shared_folder
from gristmill.sources import files, index_store
from gristmill.sources.tables import table

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


# --- reranking and flows ---------------------------------------------------------------------------

_RERANKED = """lg AS (SELECT DISTINCT query_id, meta_language AS language FROM queries WHERE meta_language IS NOT NULL),
 lo AS (SELECT query_id, language, max(raw) AS top FROM po JOIN lg USING (query_id, language) WHERE source <> 'web' GROUP BY 1, 2),
 be AS (SELECT query_id, language AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY top DESC, language) AS rn FROM lo) WHERE rn = 1),
 kp AS (SELECT po.*, bool_and(source = 'web') OVER q AS web_only, (raw - min(raw) OVER q) / (CASE WHEN max(raw) OVER q = min(raw) OVER q THEN 1.0 ELSE max(raw) OVER q - min(raw) OVER q END) AS scaled
   FROM po LEFT JOIN be USING (query_id) WHERE best IS NULL OR source = 'web' OR language = best WINDOW q AS (PARTITION BY query_id)),
 rk AS (SELECT *, CASE WHEN source = 'web' AND NOT web_only THEN 0.5 * scaled ELSE scaled END AS rerank_score FROM kp)"""


@query(f"WITH {R._PO}, {_RERANKED} SELECT query_id, chunk_id, round(rerank_score, 6) AS rerank_score FROM rk")
def fuse_rerank(spark, d):
    """Pools in the language of their best local chunk, scored from 0 to 1 for the order."""
    asked = table(spark, d, "queries").select("query_id", F.col("meta_language").alias("language"))
    return fusion.rerank(R._pool(spark, d), asked).select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"))


def _flow(spark, d, name, **settings):
    c = R._chunks(spark, d).select("chunk_id", "source", F.col("meta_language").alias("language"), "text")
    return flows.run(R._last_run(spark, d), table(spark, d, "queries"), c, flows.resolve(name, **settings)).withColumn("score", F.round("score", 6))


def _flow_sql(legs: str, languages: str = "true", rerank: bool = True) -> str:
    """A flow without the removal of near-duplicates, which walks its list and so has no SQL."""
    pool = f"""{R._LAST}, {R._CH}, lq AS (SELECT query_id, min(lower(meta_language)) AS lang FROM queries GROUP BY 1), lf AS (SELECT lh.* FROM lh LEFT JOIN lq USING (query_id) WHERE {legs}),
     rr AS (SELECT query_id, chunk_id, round(sum(1.0/(60+hit_rank)), 10) AS rrf FROM lf GROUP BY 1, 2),
     tp AS (SELECT query_id, chunk_id, source, meta_language AS language, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS rn FROM rr JOIN ch USING (chunk_id) WHERE {languages}),
     po AS (SELECT *, round(rrf*60-1, 6) AS raw FROM tp WHERE rn <= 100)"""
    if rerank:
        return f"WITH {pool}, {_RERANKED} SELECT query_id, chunk_id, p::INT AS position, round(rerank_score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 6) DESC, rrf DESC, chunk_id) AS p FROM rk) WHERE p <= 50"
    return f"WITH {pool} SELECT query_id, chunk_id, rn::INT AS position, round(rrf, 6) AS score FROM po WHERE rn <= 50"


@query(_flow_sql("leg = 'final' OR leg = 'seed' OR (leg = 'original' AND retriever = 'vector' AND lang IS NOT NULL AND lang NOT IN ('en', 'und', 'unknown'))"))
def flow_multileg(spark, d):
    """The flow with a leg for the seed text and a vector leg for the original one."""
    return _flow(spark, d, "NATIVE_ALL_MULTILEG", deduplicate=False)


@query(_flow_sql("leg = 'final' AND retriever = 'bm25'", "meta_language = 'en'"))
def flow_english_bm25(spark, d):
    return _flow(spark, d, "ENGLISH_BM25", deduplicate=False)


@query(_flow_sql("leg = 'final'", rerank=False))
def flow_without_rerank(spark, d):
    return _flow(spark, d, "NATIVE_ALL_NO_RERANK", deduplicate=False)


@query()
def flow_native_all(spark, d):
    """The whole default flow, near-duplicates removed (a walk down each list, so tested against brute force)."""
    return _flow(spark, d, "NATIVE_ALL")


_STRATEGIES = ", ".join(f"('{s.name}', {s.final}, {s.threshold}, {s.file_limit})" for s in fusion.STRATEGIES.values())


@query(
    f"""WITH {R._PO}, sy(strategy, final, least, lim) AS (VALUES {_STRATEGIES}), bo AS (SELECT *, 1/(1+exp(-(raw + CASE WHEN source <> 'web' AND count(*) OVER (PARTITION BY query_id, file_path) = 1 THEN ln(1.25) ELSE 0 END))) AS bs,
      coalesce(max(CASE WHEN source <> 'web' THEN 1/(1+exp(-raw)) END) OVER (PARTITION BY query_id), 0) AS best FROM po),
    th AS (SELECT strategy, final, lim, query_id, file_path, count(*) AS n FROM bo, sy WHERE best < least OR bs >= CASE WHEN source = 'web' THEN 0.5 ELSE least END GROUP BY ALL)
    SELECT strategy, query_id, least(final, sum(CASE WHEN lim = 0 THEN n ELSE least(n, lim) END))::BIGINT AS chunks FROM th GROUP BY strategy, query_id, final"""
)
def fuse_strategies(spark, d):
    """How many chunks each strategy keeps of each pool, by its threshold, its cap by file and its budget."""
    pool = durable(R._pool(spark, d))
    out = None
    for s in fusion.STRATEGIES.values():
        kept = fusion.capped_by_file(fusion.above_threshold(pool, s.threshold), s.file_limit, s.final)
        n = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks")).withColumn("strategy", F.lit(s.name))
        out = n if out is None else out.unionByName(n)
    return out


_NEED_BM = R._BM.replace("WHERE leg='final'", "WHERE need_id IS NOT NULL")


@query(
    f"""WITH {R._LAST}, {_NEED_BM}, qn AS (SELECT query_id, need_id, weight FROM queries WHERE need_id IS NOT NULL),
    kw AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, chunk_id) AS hit_rank FROM sc WHERE score > 0),
    al AS (SELECT need_id, chunk_id, hit_rank, weight FROM lh JOIN qn USING (query_id) UNION ALL SELECT need_id, chunk_id, hit_rank, 1.0 FROM kw JOIN qn USING (query_id) WHERE hit_rank <= 20),
    b AS (SELECT need_id, chunk_id, max(weight/(60+hit_rank)) AS s FROM al GROUP BY 1, 2)
    SELECT chunk_id, string_agg(need_id::VARCHAR, ',' ORDER BY need_id) AS needs, round(max(s), 8) AS score FROM b GROUP BY 1"""
)
def fuse_need_fanout(spark, d):
    """Every retriever and a keyword leg for each need; a chunk is kept once with the needs it was found for."""
    q = table(spark, d, "queries").where("need_id is not null")
    need = q.select("query_id", "need_id", "weight")
    ranked = R._last_run(spark, d).join(need, "query_id").select("need_id", "chunk_id", "hit_rank", "weight")
    words = V.Bm25Index(R._chunks(spark, d)).query(q.select("query_id", "text"), 20).join(need.drop("weight"), "query_id").select("need_id", "chunk_id", "hit_rank", F.lit(1.0).alias("weight"))
    return fusion.need_associations(ranked.unionByName(words)).withColumn("score", F.round("score", 8))


# --- index maintenance, grounding in another language ----------------------------------------------


@query(f"WITH {R._BM.replace('AS tok FROM ch)', 'AS tok FROM ch WHERE coalesce(file_id % 50, 1) <> 0)')} SELECT term, df::BIGINT AS df, round(idf, 6) AS idf, n::BIGINT AS n, round(avg_dl, 6) AS avg_dl FROM te, co")
def agg_bm25_after_delete(spark, d):
    """The statistics after the chunks of some files (ids divisible by 50) are deleted from the index."""
    c = R._chunks(spark, d)
    i = V.Bm25Index(c).without(c.where("file_id % 50 = 0"))
    return V._with_one(i.terms, i.corpus.select("n", "avg_dl")).select("term", "df", F.round("idf", 6).alias("idf"), "n", F.round("avg_dl", 6).alias("avg_dl"))


@query(
    f"""WITH {R._AN}, di(s, t) AS (VALUES ('the','der'),('ledger','buch'),('moved','verschob')), w AS (SELECT answer_id, list_filter(regexp_split_to_array(lower(sentence), '[{R._SPACE}]+'), lambda x: x <> '') AS k FROM sn),
    u AS (SELECT answer_id, unnest(k) AS x, generate_subscripts(k, 1) AS p FROM w), px AS (SELECT answer_id, string_agg(coalesce(t, x), ' ' ORDER BY p) AS sentence FROM u LEFT JOIN di ON s = x GROUP BY 1),
    said AS (SELECT answer_id, language, t, 'original' AS via FROM sn UNION ALL SELECT answer_id, 'de', {R._GT('px.sentence')}, 'translated' FROM px JOIN sn USING (answer_id) WHERE language <> 'de'),
    met AS (SELECT DISTINCT answer_id FROM ev JOIN (SELECT DISTINCT answer_id, language FROM said) USING (answer_id, language)),
    asked AS (SELECT * FROM said WHERE answer_id IN (FROM met) UNION ALL SELECT answer_id, '*', t, via FROM (SELECT *, bool_or(via = 'translated') OVER (PARTITION BY answer_id) AS o FROM said WHERE answer_id NOT IN (FROM met)) WHERE via = 'translated' OR NOT o),
    given AS (SELECT answer_id, chunk_id, CASE WHEN answer_id IN (FROM met) THEN language ELSE '*' END AS language, t FROM ev),
    a AS (SELECT DISTINCT answer_id, language, via, {R._RUNS('t')} AS run FROM asked WHERE len(t) >= 5), b AS (SELECT DISTINCT answer_id, chunk_id, language, {R._RUNS('t')} AS run FROM given)
    SELECT DISTINCT answer_id, 1 AS sentence_no, chunk_id, via FROM a JOIN b USING (answer_id, language, run)"""
)
def dom_cross_language(spark, d):
    """Sentences grounded in evidence of their language, or by a translated proxy in another's; a dictionary stands for the translator."""
    s, c = R._answers(spark, d)
    lang = table(spark, d, "queries").select(F.col("query_id").alias("answer_id"), F.col("meta_language").alias("language"))
    said = s.join(lang, "answer_id")
    words = spark.createDataFrame([("the", "der"), ("ledger", "buch"), ("moved", "verschob")], "source string, target string")
    proxies = S.translated(said.select(F.col("answer_id").alias("text_id"), F.col("sentence").alias("text")), words).select(F.col("text_id").alias("answer_id"), F.lit(1).alias("sentence_no"), F.lit("de").alias("language"), F.col("text").alias("sentence"))
    known = R._chunks(spark, d).select("chunk_id", F.coalesce("meta_language", F.lit("und")).alias("language"))
    return G.cross_language(said, durable(proxies), durable(c.join(known, "chunk_id")))


# --- lists, stores, logs -----------------------------------------------------------------------------

_PATH = "replace(file_path, chr(92), '/')"


@query(
    f"""WITH a AS (SELECT DISTINCT {_PATH} AS p FROM ingest_log WHERE status = 'NOT_OK' AND trim(file_path) <> ''), b AS (SELECT DISTINCT {_PATH} AS p FROM ingest_log WHERE status = 'HUMAN_REVIEW' AND trim(file_path) <> ''),
    r AS (SELECT {_PATH} AS p FROM files WHERE source = 'web'), l AS (SELECT p FROM (FROM a UNION FROM b) WHERE p NOT IN (SELECT p FROM r WHERE p IS NOT NULL))
    SELECT file_id, file_path FROM files WHERE coalesce({_PATH}, '') NOT IN (FROM l)"""
)
def join_exclusions(spark, d):
    """Files that are not on the list of excluded paths, once some paths were added to it and some removed."""
    log, f = table(spark, d, "ingest_log"), table(spark, d, "files")
    listed = ingest.excluded(log.where("status = 'NOT_OK'"), log.where("status = 'HUMAN_REVIEW'"), f.where("source = 'web'"))
    return ingest.allowed(f, listed).select("file_id", "file_path")


@query(
    """WITH e AS (SELECT user_id AS store, event_id AS doc_id, ts AS t, strlen(coalesce(props, '')) AS bytes FROM events), a AS (SELECT *, max(t) OVER (PARTITION BY store) AS newest FROM e),
    b AS (SELECT *, sum(bytes) OVER (PARTITION BY store ORDER BY t DESC, doc_id DESC ROWS UNBOUNDED PRECEDING) AS held FROM a WHERE t >= newest - INTERVAL 10 DAY) SELECT store, doc_id FROM b WHERE held <= 200"""
)
def win_ttl_store(spark, d):
    """What stores with a time to live and a cap on their bytes still hold; here a user's events are its documents."""
    e = table(spark, d, "events").select(F.col("user_id").alias("store"), F.col("event_id").alias("doc_id"), F.col("ts").alias("at"), F.octet_length(F.coalesce("props", F.lit(""))).alias("bytes"))
    return ingest.stored(e, "10 days", 200).select("store", "doc_id")


@query(
    f"""WITH {R._SEL}, {R._CONF} SELECT query_id AS turn_id, CASE WHEN confidence >= 0.78 THEN 'HIGH' WHEN confidence >= 0.56 THEN 'MEDIUM' ELSE 'LOW' END AS retrieval_level, round(confidence, 6) AS retrieval_score,
    CASE WHEN penalty > 0 THEN 'LOW' ELSE 'HIGH' END AS threshold_level, round(top, 6) AS threshold_score FROM e"""
)
def sink_confidence_log(spark, d):
    """The log of each turn's steps, a row a turn with the columns of its steps, appended as text and read back."""
    c = fusion.confidence(R._selected(spark, d))
    one = c.select(F.col("query_id").alias("turn_id"), F.lit("retrieval").alias("step"), "level", F.round("confidence", 6).alias("score"))
    two = c.select(F.col("query_id").alias("turn_id"), F.lit("threshold").alias("step"), F.when(F.col("penalty") > 0, "LOW").otherwise("HIGH").alias("level"), F.round("top", 6).alias("score"))
    path = _folder(spark)
    H.confidence_log(one.unionByName(two), ["retrieval", "threshold"]).write.mode("append").option("header", "true").csv(path)
    return spark.read.option("header", "true").schema("turn_id bigint, retrieval_level string, retrieval_score double, threshold_level string, threshold_score double").csv(path)


# --- sinks and sources -------------------------------------------------------------------------------


@query("""SELECT log_id::VARCHAR AS log_id, file_path AS "FilePath", stage AS "Stage", coalesce(status, 'NONE') AS "Status" FROM ingest_log WHERE stage = 'store' AND file_path ILIKE '%.pdf' AND trim(file_path) <> ''""")
def sink_classification(spark, d):
    """A classification written as text by status, and read through a WHERE clause as users write it."""
    path = _folder(spark)
    log = table(spark, d, "ingest_log").select("log_id", F.col("file_path").alias("FilePath"), F.col("stage").alias("Stage"), F.coalesce("status", F.lit("NONE")).alias("Status"))
    files.write_classification(log, path)
    return files.read_classification(spark, path, "Stage = 'store' AND FilePath LIKE '%.PDF'").select("log_id", "FilePath", "Stage", "Status")


@query("SELECT file_id, file_name, NULL::INT AS word_count FROM files WHERE source = 'local' UNION ALL SELECT file_id, NULL, word_count FROM files WHERE source = 'web'")
def sink_new_columns(spark, d):
    """Rows with a new column appended to a table: what each lacks is null."""
    f = table(spark, d, "files")
    return files.append_columns(f.where("source = 'local'").select("file_id", "file_name"), f.where("source = 'web'").select("file_id", "word_count"))


@query(R.SQL["agg_bm25_terms"])
def src_index_rebuild(spark, d):
    """The index's terms as they come from its folder: built the first time, only read the second."""
    c, path = R._chunks(spark, d), _folder(spark)
    build = lambda x: {"terms": V.Bm25Index(x).terms}
    index_store.load_or_build(spark, path, "chunks", c, build, ["terms"])
    return index_store.load_or_build(spark, path, "chunks", c, build, ["terms"])["terms"].select("term", "df", F.round("idf", 6).alias("idf"))


@query("SELECT source, 'txt' AS file_type, count(*)::BIGINT AS lines, count(DISTINCT file_name)::BIGINT AS names FROM files WHERE trim(file_name) <> '' AND source IS NOT NULL GROUP BY 1")
def src_text_files(spark, d):
    """Text files of a folder and its subfolders, read whole and cut into lines; files of other types are passed over."""
    path = _folder(spark)
    f = table(spark, d, "files").where("trim(file_name) <> '' and source is not null")
    f.select("file_name", "source").write.partitionBy("source").text(path)
    f.select("file_id").write.parquet(f"{path}/source=other")
    lines = files.read_text(spark, path).select("file_type", F.regexp_extract("file_path", "source=([^/]+)", 1).alias("source"), F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.groupBy("source", "file_type").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("line").alias("names"))


@query(f"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[{R._SPACE}]+'), lambda x: x <> '')[1:1500], ' ') AS body FROM documents WHERE text IS NOT NULL")
def proj_html_text(spark, d):
    """Texts got back out of web pages without their scripts and menus."""
    safe = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    page = F.concat(F.lit("<html><head><script>var x = 1;</script></head><nav>menu</nav><body><p>"), safe, F.lit("</p></body><footer>foot</footer></html>"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", P.page_text(page).alias("body"))


@query("SELECT retriever, count(*)::BIGINT AS hits FROM hits WHERE retriever IN ('vector', 'bm25') GROUP BY 1")
def flow_modes(spark, d):
    """The retrievers that a mode names, and what they found."""
    mode = [r.lower() for r in flows.retrieval_mode("VECTOR_BM25")]
    return table(spark, d, "hits").where(F.col("retriever").isin(*mode)).groupBy("retriever").agg(F.count(F.lit(1)).alias("hits"))


@query(
    f"""WITH {R._RES}, st(stage, depth, breadth) AS (VALUES {", ".join(f"('{s.name}', {s.depth}, {s.breadth})" for s in R.C.STAGES.values())}), {R._CON.format(k='text_id')}
    SELECT stage, count(*) FILTER (dp.depth >= st.depth OR coalesce(br.breadth, 0) >= st.breadth)::BIGINT AS objected, count(*)::BIGINT AS texts FROM dp LEFT JOIN br USING (text_id), st GROUP BY stage"""
)
def agg_consensus_stages(spark, d):
    """How many texts each stage objects to, by the depth and breadth it asks for."""
    results = durable(R._results(spark, d))
    out = None
    for s in R.C.STAGES.values():
        n = R.C.consensus(results, s.depth, s.breadth, "text_id").agg(F.count_if("objected").alias("objected"), F.count(F.lit(1)).alias("texts")).withColumn("stage", F.lit(s.name))
        out = n if out is None else out.unionByName(n)
    return out
