"""Queries of retrieval, fusion, selection, compliance and grounding, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import parse as P
from gristmill.functions import text as T
from gristmill.operators import compliance as C
from gristmill.operators import fusion as R
from gristmill.operators import grounding as G
from gristmill.operators import retrieval as V
from gristmill.session import durable
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


_TOK = "regexp_extract_all(lower(coalesce(text,'')), '[a-z0-9]+')"


def _chunks(spark, d) -> DataFrame:
    """Chunks once each (some rows come twice)."""
    return table(spark, d, "chunks").dropDuplicates(["chunk_id"])


def _final(spark, d) -> DataFrame:
    return table(spark, d, "queries").where("leg = 'final'")


def _hits(spark, d) -> DataFrame:
    """Hits once each (some rows come twice); a score may be null."""
    return table(spark, d, "hits").dropDuplicates(["run_id", "query_id", "retriever", "leg", "hit_rank"])


_CH = "ch AS (SELECT DISTINCT ON (chunk_id) * FROM chunks ORDER BY chunk_id)"
_HI = "hi AS (SELECT DISTINCT ON (run_id, query_id, retriever, leg, hit_rank) * FROM hits ORDER BY run_id, query_id, retriever, leg, hit_rank)"
_BM = f"""{_CH}, tk AS (SELECT chunk_id, {_TOK} AS tok FROM ch), dl AS (SELECT chunk_id, len(tok) AS dl FROM tk),
 po AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(tok) AS term FROM tk) GROUP BY 1,2),
 co AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM dl), te AS (SELECT term, count(*) AS df, ln(1+((SELECT n FROM co)-count(*)+0.5)/(count(*)+0.5)) AS idf FROM po GROUP BY term),
 qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOK}) AS term FROM queries WHERE leg='final') GROUP BY 1,2),
 sc AS (SELECT query_id, po.chunk_id, sum(qtf*idf*(tf*2.2/(tf+1.2*(0.25+0.75*dl/(SELECT avg_dl FROM co))))) AS score FROM qt JOIN te USING (term) JOIN po USING (term) JOIN dl USING (chunk_id) GROUP BY 1,2)"""


@query(f"WITH {_BM} SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM te")
def agg_bm25_terms(spark, d):
    i = V.Bm25Index(_chunks(spark, d))
    return i.terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM} SELECT n::BIGINT AS n, round(avg_dl, 6) AS avg_dl FROM co")
def agg_bm25_corpus(spark, d):
    i = V.Bm25Index(_chunks(spark, d))
    return i.corpus.select("n", F.round("avg_dl", 6).alias("avg_dl"))


@query(f"WITH {_BM} SELECT query_id, count(*)::BIGINT AS n, round(max(score), 6) AS best, round(sum(score), 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, chunk_id) AS rn FROM sc WHERE score > 0) WHERE rn <= 50 GROUP BY query_id")
def dom_bm25_top(spark, d):
    """The best 50 chunks of each query by BM25, summed up by query."""
    top = V.Bm25Index(_chunks(spark, d)).query(_final(spark, d), 50)
    return top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("best"), F.round(F.sum("score"), 4).alias("total"))


@query(f"WITH {_BM} SELECT query_id, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, chunk_id) AS rn FROM sc WHERE score > 0) WHERE rn <= 10")
def sort_bm25_top10(spark, d):
    s = V.Bm25Index(_chunks(spark, d)).scores(_final(spark, d)).where("score > 0")
    return V.top_k(s.withColumn("s", F.round("score", 8)), 10, F.desc("s"), F.asc("chunk_id")).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0),
       s AS (SELECT query_id, vec_id, round(list_cosine_similarity(qe::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q, embeddings)
       SELECT query_id, count(*)::BIGINT AS n, round(max(score), 4) AS best, round(min(score), 4) AS worst FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn <= 10 GROUP BY query_id"""
)
def dom_vector_top(spark, d):
    """Exact nearest vectors of a stated query set (ids divisible by 50) against all."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    top = V.vector_scores(q, e.select(F.col("vec_id").alias("chunk_id"), "embedding"), 10)
    return top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 4).alias("best"), F.round(F.min("score"), 4).alias("worst"))


def _entities(spark, d) -> DataFrame:
    """Capitalised words inside a text, a stand-in for a named-entity tagger."""
    return _chunks(spark, d).select("chunk_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[a-z,] ([A-Z][a-z]{4,})"), F.lit(1)))).alias("entity"))


_EN = f"{_CH}, ce AS (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(text, '[a-z,] ([A-Z][a-z]{{4,}})', 1)) AS entity FROM ch)"
_ED = f"{_EN}, hf AS (SELECT a.entity AS a, b.entity AS b, count(*) AS weight FROM ce a JOIN ce b USING (chunk_id) WHERE a.entity < b.entity GROUP BY 1,2), ed AS (SELECT a AS src, b AS dst, weight FROM hf UNION ALL SELECT b, a, weight FROM hf)"


@query(f"WITH {_ED} SELECT src, dst, weight::BIGINT AS weight FROM ed")
def agg_entity_edges(spark, d):
    return V.entity_edges(_entities(spark, d))


_GQ = f"""{_ED}, fr AS (SELECT entity, count(*) AS n FROM ce GROUP BY 1), se AS (SELECT rn AS query_id, entity FROM (SELECT entity, row_number() OVER (ORDER BY n DESC, entity) AS rn FROM fr) WHERE rn <= 20),
 r0 AS (SELECT query_id, entity FROM se), r1 AS (SELECT DISTINCT query_id, dst AS entity FROM r0 JOIN ed ON src = entity WHERE (query_id, dst) NOT IN (SELECT query_id, entity FROM r0)),
 r2 AS (SELECT DISTINCT query_id, dst AS entity FROM r1 JOIN ed ON src = entity WHERE (query_id, dst) NOT IN (SELECT query_id, entity FROM r0) AND (query_id, dst) NOT IN (SELECT query_id, entity FROM r1)),
 ex AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1), al AS (SELECT * FROM ex UNION ALL SELECT * FROM r2), w AS (SELECT query_id, dst AS entity, sum(weight) AS w FROM ex JOIN ed ON src = entity GROUP BY 1,2),
 sc AS (SELECT query_id, chunk_id, sum(coalesce(w, 0))::DOUBLE AS score FROM al LEFT JOIN w USING (query_id, entity) JOIN ce USING (entity) GROUP BY 1,2)"""


@query(f"WITH {_GQ} SELECT query_id::BIGINT AS query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM sc) WHERE rn <= 50")
def dom_graph_query(spark, d):
    """Chunks near twenty seeds (the most frequent entities) by walking two steps."""
    ce = durable(_entities(spark, d))
    edges = durable(V.entity_edges(ce))  # walked over several times
    top = ce.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity").limit(20)
    seeds = top.withColumn("query_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "entity")).cast("bigint")).select("query_id", "entity")
    return V.graph_scores(seeds, edges, ce).select("query_id", "chunk_id", "score")


_VN = """k(kind, w) AS (VALUES ('v','rewrote'),('v','compared'),('v','moved'),('v','restored'),('v','counted'),('v','rejected'),('v','delivered'),('v','measured'),('n','index'),('n','ledger'),('n','depot'),('n','ramp'),('n','server'),('n','annex'),('n','report'),('n','snapshots'))"""
_VERBS = "rewrote compared moved restored counted rejected delivered measured".split()
_NOUNS = "index ledger depot ramp server annex report snapshots".split()


def _terms(df: DataFrame, key: str) -> DataFrame:
    """Verbs and nouns by a small lexicon, a stand-in for a part-of-speech tagger."""
    t = T.tokens(F.coalesce("text", F.lit("")))
    return df.select(key, F.array_intersect(t, F.array(*[F.lit(w) for w in _VERBS])).alias("verbs"), F.array_intersect(t, F.array(*[F.lit(w) for w in _NOUNS])).alias("nouns"))


@query(
    f"""WITH {_VN}, {_CH}, q AS (SELECT query_id, kind, w FROM (SELECT DISTINCT query_id, unnest({_TOK}) AS w FROM queries WHERE leg='final') JOIN k USING (w)),
    n AS (SELECT query_id, count(*) FILTER (kind='v') AS nv, count(*) FILTER (kind='n') AS nn FROM q GROUP BY 1), c AS (SELECT chunk_id, kind, w FROM (SELECT DISTINCT chunk_id, unnest({_TOK}) AS w FROM ch) JOIN k USING (w)),
    s AS (SELECT query_id, chunk_id, count(*) FILTER (q.kind='v') AS v, count(*) FILTER (q.kind='n') AS n FROM q JOIN c USING (kind, w) GROUP BY 1,2),
    x AS (SELECT s.*, nv, nn, CASE WHEN nv>0 THEN v/nv ELSE 0 END AS vc, CASE WHEN nn>0 THEN n/nn ELSE 0 END AS nc FROM s JOIN n USING (query_id)),
    y AS (SELECT *, CASE WHEN (nv=0 OR v>0) AND (nn=0 OR n>0) THEN 2*vc+nc+CASE WHEN v>0 AND n>0 THEN 0.25 ELSE 0 END END AS st, CASE WHEN v>0 THEN 1.2*vc END AS lo FROM x),
    z AS (SELECT *, CASE WHEN max(st) OVER (PARTITION BY query_id) IS NOT NULL THEN st ELSE lo END AS score FROM y)
    SELECT query_id, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, v+n DESC, v DESC, n DESC, chunk_id) AS rn FROM z WHERE score IS NOT NULL) WHERE rn <= 50"""
)
def dom_verb_noun(spark, d):
    top = V.verb_noun_scores(_terms(_final(spark, d).where("text is not null"), "query_id"), _terms(_chunks(spark, d), "chunk_id"), 50)
    return top.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


# --- fusion --------------------------------------------------------------------------------------


@query(f"WITH {_HI} SELECT run_id, query_id, retriever, leg, hit_rank, (row_number() OVER (PARTITION BY run_id, query_id, retriever, leg ORDER BY score DESC NULLS LAST, hit_rank))::INT AS score_rank FROM hi")
def win_rank_in_list(spark, d):
    """Ranks by score: a list's own order doesn't always follow it."""
    w = Window.partitionBy("run_id", "query_id", "retriever", "leg").orderBy(F.desc_nulls_last("score"), "hit_rank")
    return _hits(spark, d).select("run_id", "query_id", "retriever", "leg", "hit_rank", F.row_number().over(w).alias("score_rank"))


_LAST = f"{_HI}, la AS (SELECT query_id, max(run_id) AS run_id FROM hi GROUP BY 1), lh AS (SELECT hi.* FROM hi JOIN la USING (query_id, run_id))"


def _last_run(spark, d) -> DataFrame:
    h = _hits(spark, d)
    return h.join(h.groupBy("query_id").agg(F.max("run_id").alias("run_id")), ["query_id", "run_id"])


_RRF = f"""{_LAST}, bl AS (SELECT query_id, chunk_id, retriever, sum(CASE WHEN leg='seed' THEN 0.9 ELSE 1.0 END/(60+hit_rank)) AS part, min(hit_rank) AS first FROM lh GROUP BY 1,2,3),
 rr AS (SELECT query_id, chunk_id, sum(part) AS rrf_score, string_agg(retriever, ',' ORDER BY first, retriever) AS sources FROM bl GROUP BY 1,2)"""


def _rrf(spark, d) -> DataFrame:
    return R.reciprocal_rank(_last_run(spark, d), weight=F.when(F.col("leg") == "seed", 0.9).otherwise(1.0))


@query(f"WITH {_RRF} SELECT query_id, chunk_id, round(rrf_score, 8) AS rrf_score, sources FROM rr")
def fuse_weighted_rrf(spark, d):
    return _rrf(spark, d).select("query_id", "chunk_id", F.round("rrf_score", 8).alias("rrf_score"), "sources")


@query(f"WITH {_RRF} SELECT query_id, chunk_id, round(rrf_score, 8) AS rrf_score, rn::INT AS hit_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 10) DESC, chunk_id) AS rn FROM rr) WHERE rn <= 100")
def sort_rrf_cap(spark, d):
    r = _rrf(spark, d).withColumn("s", F.round("rrf_score", 10))
    return V.top_k(r, 100, F.desc("s"), F.asc("chunk_id")).select("query_id", "chunk_id", F.round("rrf_score", 8).alias("rrf_score"), "hit_rank")


_LRR = f"""{_LAST}, {_CH}, lr AS (SELECT query_id, coalesce(c.meta_language, 'und') AS language, chunk_id, sum(1.0/(60+hit_rank)) AS rrf FROM lh JOIN ch c USING (chunk_id) GROUP BY 1,2,3),
 ln AS (SELECT *, row_number() OVER (PARTITION BY query_id, language ORDER BY round(rrf, 10) DESC, chunk_id) AS n, max(round(rrf, 10)) OVER (PARTITION BY query_id, language) AS b FROM lr)"""


@query(f"WITH {_LRR} SELECT query_id, language, chunk_id, p::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n, b DESC, language, chunk_id) AS p FROM ln) WHERE p <= 20")
def fuse_language_interleave(spark, d):
    lang = _chunks(spark, d).select("chunk_id", F.coalesce("meta_language", F.lit("und")).alias("language"))
    ranked = R.reciprocal_rank(_last_run(spark, d).join(lang, "chunk_id"), R.RRF_K, None, "language").withColumn("rrf_score", F.round("rrf_score", 10))
    return R.interleave(ranked, 20).select("query_id", "language", "chunk_id", "position")


@query(f"WITH {_HI}, q AS (SELECT query_id, need_id, max(weight) AS weight FROM queries WHERE need_id IS NOT NULL GROUP BY 1,2) SELECT need_id, chunk_id, round(max(weight/(60+hit_rank)), 8) AS score FROM hi JOIN q USING (query_id) GROUP BY 1,2")
def win_best_variant(spark, d):
    q = table(spark, d, "queries").where("need_id is not null").groupBy("query_id", "need_id").agg(F.max("weight").alias("weight"))
    return R.best_variant(_hits(spark, d).join(q, "query_id")).select("need_id", "chunk_id", F.round("score", 8).alias("score"))


@query(f"WITH {_LAST} SELECT query_id, chunk_id, min(o)::INT AS first_leg, string_agg(leg, ',' ORDER BY o) AS legs FROM (SELECT query_id, chunk_id, leg, min(CASE leg WHEN 'final' THEN 0 WHEN 'seed' THEN 1 ELSE 2 END) AS o FROM lh GROUP BY 1,2,3) GROUP BY 1,2")
def join_union_legs(spark, d):
    """Union of the legs with each chunk once, marked with the legs it came from, in their order."""
    o = F.when(F.col("leg") == "final", 0).when(F.col("leg") == "seed", 1).otherwise(2)
    by = _last_run(spark, d).groupBy("query_id", "chunk_id", "leg").agg(F.min(o).alias("o"))
    g = by.groupBy("query_id", "chunk_id").agg(F.min("o").alias("first_leg"), F.array_sort(F.collect_list(F.struct("o", "leg"))).alias("l"))
    return g.select("query_id", "chunk_id", "first_leg", F.array_join(F.transform("l", lambda s: s["leg"]), ",").alias("legs"))


def _pool(spark, d) -> DataFrame:
    """The fused pool of each query with a deterministic rerank score in place of a model's."""
    r = V.top_k(_rrf(spark, d).withColumn("score", F.round("rrf_score", 10)), 100)
    c = _chunks(spark, d).select("chunk_id", "file_path", "source", F.col("meta_language").alias("language"), "text")
    return r.join(c, "chunk_id").select("query_id", "chunk_id", "file_path", "source", "language", "text", "sources", F.round("rrf_score", 10).alias("retrieval_score"), F.round(F.col("rrf_score") * 60 - 1, 6).alias("raw"))


_PO = f"""{_RRF}, {_CH}, tp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 10) DESC, chunk_id) AS rn FROM rr),
 po AS (SELECT query_id, chunk_id, file_path, source, meta_language AS language, text, sources, round(rrf_score, 10) AS retrieval_score, round(rrf_score*60-1, 6) AS raw FROM tp JOIN ch USING (chunk_id) WHERE rn <= 100)"""


@query(f"WITH {_PO} SELECT query_id, chunk_id, round((raw - min(raw) OVER w)/(CASE WHEN max(raw) OVER w = min(raw) OVER w THEN 1.0 ELSE max(raw) OVER w - min(raw) OVER w END), 6) AS scaled FROM po WINDOW w AS (PARTITION BY query_id)")
def agg_min_max_pool(spark, d):
    return R.min_max(_pool(spark, d)).select("query_id", "chunk_id", F.round("scaled", 6).alias("scaled"))


_TH = f"""{_PO}, bo AS (SELECT *, 1/(1+exp(-(raw + CASE WHEN source <> 'web' AND count(*) OVER (PARTITION BY query_id, file_path) = 1 THEN ln(1.25) ELSE 0 END))) AS bs,
 max(CASE WHEN source <> 'web' THEN 1/(1+exp(-raw)) END) OVER (PARTITION BY query_id) AS best FROM po),
 th AS (SELECT *, coalesce(best, 0) < 0.5 AS everything, CASE WHEN coalesce(best, 0) < 0.5 THEN retrieval_score ELSE bs END AS kept_score FROM bo WHERE coalesce(best, 0) < 0.5 OR bs >= 0.5)"""


def _kept(spark, d) -> DataFrame:
    return R.above_threshold(_pool(spark, d), 0.5)


@query(f"WITH {_TH} SELECT query_id, chunk_id, round(kept_score, 6) AS kept_score FROM th")
def fuse_threshold(spark, d):
    return _kept(spark, d).select("query_id", "chunk_id", F.round("kept_score", 6).alias("kept_score"))


@query(f"WITH {_TH}, a AS (SELECT *, count(*) OVER (PARTITION BY query_id, file_path) AS n, row_number() OVER (PARTITION BY query_id, file_path ORDER BY round(kept_score, 8) DESC, chunk_id) AS i FROM th), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, file_path, i) AS p FROM a WHERE i <= 10) SELECT query_id, chunk_id, p::INT AS position FROM b WHERE p <= 40")
def fuse_file_cap(spark, d):
    s = R.STRATEGIES["BALANCED_FILE_CAP"]
    return R.capped_by_file(_kept(spark, d).withColumn("kept_score", F.round("kept_score", 8)), s.file_limit, s.final).select("query_id", "chunk_id", "position")


@query(f"WITH {_TH}, n AS (SELECT query_id, file_path, count(*) AS n FROM th GROUP BY 1,2), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, file_path) AS i FROM n) SELECT th.query_id, chunk_id FROM th JOIN b ON th.query_id = b.query_id AND th.file_path = b.file_path WHERE i = 1")
def fuse_single_document(spark, d):
    return R.single_document(_kept(spark, d)).select("query_id", "chunk_id")


_SEL = f"{_TH}, se AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(kept_score, 8) DESC, chunk_id) AS position FROM th)"


def _selected(spark, d) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("kept_score", 8)), "chunk_id")
    return _kept(spark, d).withColumn("position", F.row_number().over(w)).where(F.col("position") <= 50)


_CONF = """c AS (SELECT query_id, max(1/(1+exp(-raw))) AS top, avg(CASE WHEN position <= 3 THEN 1/(1+exp(-raw)) END) AS mean3, least(1.0, count(*)/50) AS coverage, avg((source <> 'web')::INT) AS local_share,
      CASE WHEN bool_or(everything) THEN 0.15 ELSE 0.0 END AS penalty FROM se WHERE position <= 50 GROUP BY 1),
    e AS (SELECT *, greatest(0, least(1, 0.5*top+0.3*mean3+0.15*coverage+0.05*local_share-penalty)) AS confidence FROM c)"""


@query(
    f"""WITH {_SEL}, {_CONF}
    SELECT query_id, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.78 THEN 'HIGH' WHEN confidence >= 0.56 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM e"""
)
def flagship(spark, d):
    """One plan from ranked lists to evidence: fused, capped, thresholded, selected, and its confidence by query."""
    return R.confidence(_selected(spark, d)).select("query_id", F.round("confidence", 6).alias("confidence"), "level")


@query(f"WITH {_SEL} SELECT query_id, source, min(position)::INT AS first, count(*)::BIGINT AS chunks, file_path FROM se WHERE position <= 50 GROUP BY query_id, source, file_path")
def agg_selected_sources(spark, d):
    return _selected(spark, d).groupBy("query_id", "source", "file_path").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("chunks"))


def _texts_of_pool(spark, d) -> DataFrame:
    return _pool(spark, d).select("query_id", "chunk_id", "text", F.col("retrieval_score").alias("rrf_score"))


@query(
    f"""WITH {_PO}, st AS (SELECT query_id, chunk_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS t FROM po)
    SELECT a.query_id, a.chunk_id AS a, b.chunk_id AS b, round(len(list_intersect(a.t, b.t))/len(list_distinct(list_concat(a.t, b.t))), 6) AS similarity FROM st a JOIN st b ON a.query_id = b.query_id AND a.chunk_id < b.chunk_id
    WHERE len(a.t) > 0 AND len(b.t) > 0 AND len(a.t) >= 0.85*len(b.t) AND len(b.t) >= 0.85*len(a.t) AND len(list_intersect(a.t, b.t)) >= 0.85*len(list_distinct(list_concat(a.t, b.t)))"""
)
def join_near_duplicates(spark, d):
    return R.duplicate_pairs(_texts_of_pool(spark, d)).select("query_id", "a", "b", F.round("similarity", 6).alias("similarity"))


@query()
def fuse_drop_duplicates(spark, d):
    """Each pool without near-duplicates of better chunks (greedy, so tested against brute force)."""
    return R.drop_duplicates(_texts_of_pool(spark, d)).select("query_id", "chunk_id")


# --- compliance ----------------------------------------------------------------------------------

_PH = ["storage controller", "missing attachments", "follow-up questions", "water samples near the ramp", "retention rules", "secondary server", "duplicate passages in the annex", "upper floor", "graphics adapter", "backup running"]
_PHS = "ph AS (SELECT unnest([" + ",".join(f"'{p}'" for p in _PH) + "]) AS phrase)"


def _phrases(spark) -> DataFrame:
    return spark.createDataFrame([(p,) for p in _PH], "phrase string")


def _texts(spark, d) -> DataFrame:
    return _chunks(spark, d).select(F.col("chunk_id").alias("text_id"), "text")


_RG = f"{_CH}, {_PHS}, rg AS (SELECT chunk_id AS text_id, phrase, 1.0::DOUBLE AS score FROM ch JOIN ph ON regexp_matches(text, '(?i)\\b' || array_to_string(regexp_extract_all(lower(phrase), '[a-z0-9]+'), '\\b[\\s\\W_]+\\b') || '\\b'))"


@query(f"WITH {_RG} SELECT text_id, phrase, 'REGEX' AS algo, score, 1.0::DOUBLE AS threshold FROM rg")
def dom_regex_scores(spark, d):
    return C.regex_scores(_texts(spark, d), _phrases(spark))


_JT = f"""{_CH}, {_PHS}, tx AS (SELECT chunk_id AS text_id, {_TOK} AS k FROM ch), pt AS (SELECT phrase, regexp_extract_all(lower(phrase), '[a-z0-9]+') AS k FROM ph),
 bt AS (SELECT text_id, phrase, list_distinct(tx.k) AS a, list_distinct(pt.k) AS b FROM tx, pt)"""


@query(f"WITH {_JT} SELECT text_id, phrase, round(len(list_intersect(a,b))/least(len(a),len(b)), 6) AS containment, round(len(list_intersect(a,b))/len(list_distinct(list_concat(a,b))), 6) AS jaccard FROM bt WHERE len(list_intersect(a,b)) > 0")
def join_token_overlap(spark, d):
    """Jaccard and containment of the words of phrases and texts that share any, by an inverted join."""
    prep = lambda df, key, c: df.select(key, F.array_distinct(T.tokens(F.coalesce(c, F.lit("")))).alias("t")).select(key, F.size("t").alias(f"n_{key}"), F.explode("t").alias("w"))
    j = prep(_texts(spark, d), "text_id", "text").join(prep(_phrases(spark), "phrase", "phrase"), "w").groupBy("text_id", "phrase", "n_text_id", "n_phrase").agg(F.count(F.lit(1)).alias("s"))
    return j.select("text_id", "phrase", F.round(F.col("s") / F.least("n_text_id", "n_phrase"), 6).alias("containment"), F.round(F.col("s") / (F.col("n_text_id") + F.col("n_phrase") - F.col("s")), 6).alias("jaccard"))


_G = lambda t: f"list_distinct(flatten(list_transform([4,5,6], lambda n: list_transform(range(1, length({t})-n+2), lambda i: substr({t}, i, n)))))"


@query(
    f"""WITH {_CH}, {_PHS}, tx AS (SELECT chunk_id AS text_id, list_distinct({_TOK}) AS a, array_to_string({_TOK}, ' ') AS line FROM ch), px AS (SELECT phrase, list_distinct(regexp_extract_all(lower(phrase), '[a-z0-9]+')) AS b, array_to_string(regexp_extract_all(lower(phrase), '[a-z0-9]+'), ' ') AS line FROM ph),
    tg AS (SELECT text_id, {_G("line")} AS g FROM tx), pg AS (SELECT phrase, {_G("line")} AS h FROM px),
    st AS (SELECT text_id, phrase, count(*) AS s FROM (SELECT text_id, unnest(a) AS w FROM tx) JOIN (SELECT phrase, unnest(b) AS w FROM px) USING (w) GROUP BY 1, 2),
    sg AS (SELECT text_id, phrase, count(*) AS s FROM (SELECT text_id, unnest(g) AS w FROM tg) JOIN (SELECT phrase, unnest(h) AS w FROM pg) USING (w) GROUP BY 1, 2),
    sy AS (SELECT text_id, phrase, greatest(coalesce(st.s, 0)/(len(a)+len(b)-coalesce(st.s, 0)), coalesce(st.s, 0)/least(len(a), len(b)), coalesce(sg.s/(len(g)+len(h)-sg.s), 0)) AS v
     FROM st FULL JOIN sg USING (text_id, phrase) JOIN tx USING (text_id) JOIN px USING (phrase) JOIN tg USING (text_id) JOIN pg USING (phrase))
    SELECT text_id, phrase, 'JACCARD' AS algo, round(v, 6) AS score, 0.75::DOUBLE AS threshold FROM sy WHERE v >= 0.5"""
)
def dom_jaccard_scores(spark, d):
    return C.jaccard_scores(_texts(spark, d), _phrases(spark)).withColumn("score", F.round("score", 6))


_BP = f"""{_CH}, {_PHS}, pk AS (SELECT phrase, regexp_extract_all(lower(phrase), '[a-z0-9]+') AS k FROM ph), ps AS (SELECT count(*) AS n, avg(len(k)) AS av FROM pk), pp AS (SELECT phrase, len(k) AS dl, t AS term, count(*) AS tf FROM (SELECT phrase, k, unnest(k) AS t FROM pk) GROUP BY 1,2,3),
 pi AS (SELECT term, ln(1+((SELECT n FROM ps)-count(*)+0.5)/(count(*)+0.5)) AS idf FROM pp GROUP BY 1), qt AS (SELECT text_id, term, count(*) AS qtf FROM (SELECT chunk_id AS text_id, unnest({_TOK}) AS term FROM ch) GROUP BY 1,2),
 rw AS (SELECT text_id, phrase, sum(qtf*idf*tf*2.2/(tf+1.2*(0.25+0.75*dl/(SELECT av FROM ps)))) AS raw, count(*) AS sh FROM qt JOIN pp USING (term) JOIN pi USING (term) GROUP BY 1,2),
 rf AS (SELECT * FROM rw WHERE sh >= 2 AND raw >= 4), rs AS (SELECT text_id, quantile_cont(raw, 0.97) AS scale FROM rf GROUP BY 1)"""


@query(f"WITH {_BP} SELECT text_id, phrase, round(least(1.0, raw/greatest(scale, 1e-12)), 6) AS score FROM rf JOIN rs USING (text_id) WHERE least(1.0, raw/greatest(scale, 1e-12)) >= 0.2")
def dom_bm25_compliance(spark, d):
    return C.bm25_scores(_texts(spark, d), _phrases(spark), raw_min=4.0).select("text_id", "phrase", F.round("score", 6).alias("score"))


def _results(spark, d) -> DataFrame:
    t, p = _texts(spark, d), _phrases(spark)
    keep = lambda df: df.select("text_id", "phrase", "algo", F.round("score", 6).alias("score"), "threshold")
    return keep(C.regex_scores(t, p)).unionByName(keep(C.bm25_scores(t, p, raw_min=4.0)))


_RES = f"""{_RG}, {_BP.replace(_CH + ', ', '').replace(_PHS + ', ', '')}, re AS (SELECT text_id, phrase, 'REGEX' AS algo, score, 1.0 AS threshold FROM rg UNION ALL
 SELECT text_id, phrase, 'BM25', round(least(1.0, raw/greatest(scale, 1e-12)), 6), 0.7 FROM rf JOIN rs USING (text_id) WHERE least(1.0, raw/greatest(scale, 1e-12)) >= 0.2)"""
_CON = "dp AS (SELECT {k}, count(DISTINCT CASE WHEN score >= threshold THEN algo END) AS depth FROM re GROUP BY 1), br AS (SELECT {k}, max(n) AS breadth FROM (SELECT {k}, phrase, count(DISTINCT algo) AS n FROM re WHERE score > 0 GROUP BY 1,2) GROUP BY 1)"


@query(f"WITH {_RES}, {_CON.format(k='text_id')} SELECT text_id, depth::BIGINT AS depth, coalesce(breadth, 0)::BIGINT AS breadth, (depth >= 2 OR coalesce(breadth, 0) >= 2) AS objected FROM dp LEFT JOIN br USING (text_id)")
def agg_consensus_chunk(spark, d):
    return C.consensus(_results(spark, d), 2, 2, "text_id")


@query(f"WITH {_RES.replace(' re AS (SELECT text_id,', ' r0 AS (SELECT text_id,')}, re AS (SELECT file_id, phrase, algo, score, threshold FROM r0 JOIN ch ON chunk_id = text_id), {_CON.format(k='file_id')} SELECT file_id, depth::BIGINT AS depth, coalesce(breadth, 0)::BIGINT AS breadth, (depth >= 2 OR coalesce(breadth, 0) >= 2) AS objected FROM dp LEFT JOIN br USING (file_id)")
def agg_consensus_document(spark, d):
    """The same over all chunks of a document: an algorithm that passes in any chunk counts once."""
    files = _chunks(spark, d).select(F.col("chunk_id").alias("text_id"), "file_id")
    return C.consensus(_results(spark, d).join(files, "text_id"), 2, 2, "file_id")


@query(
    f"""WITH {_RES}, b AS (SELECT text_id, phrase, algo, max(score) AS s, max(score) >= max(threshold) AS ok FROM re GROUP BY 1, 2, 3)
    SELECT text_id, phrase, max(CASE WHEN algo = 'REGEX' THEN CASE WHEN ok THEN '' ELSE '*' END || format('{{:.4f}}', round(s::DECIMAL(18,6), 4)::DOUBLE) END) AS "REGEX", max(CASE WHEN algo = 'BM25' THEN CASE WHEN ok THEN '' ELSE '*' END || format('{{:.4f}}', round(s::DECIMAL(18,6), 4)::DOUBLE) END) AS "BM25",
      count(*) FILTER (ok)::BIGINT AS depth, count(*) FILTER (s > 0)::BIGINT AS breadth, max(s) AS max_score FROM b GROUP BY 1, 2"""
)
def agg_best_by_algorithm(spark, d):
    return C.best_by_algorithm(_results(spark, d), ["REGEX", "BM25"])


@query(
    f"""WITH {_RG}, tx AS (SELECT chunk_id AS text_id, {_TOK} AS tok FROM ch), w AS (SELECT text_id, phrase, lower(phrase) AS p, tok, len(regexp_extract_all(lower(phrase), '[a-z0-9]+')) AS n FROM rg JOIN tx USING (text_id))
    SELECT text_id, phrase, 'REGEX+LEVENSHTEIN' AS algo, round(1.0 + list_max(list_transform(range(1, greatest(1, len(tok)-n+1)+1), lambda i: 1 - levenshtein(array_to_string(tok[i:i+n-1], ' '), p) / greatest(length(array_to_string(tok[i:i+n-1], ' ')), length(p)))), 6) AS score, 1.5::DOUBLE AS threshold FROM w"""
)
def join_regex_levenshtein(spark, d):
    t = _texts(spark, d)
    return C.with_levenshtein(C.regex_scores(t, _phrases(spark)), t).withColumn("score", F.round("score", 6))


_ENTITIES = [("storage", "storage controller", 40), ("storage", "backup", 40), ("animals", "camel", 30), ("paper", "ledger", 20)]
_INTENTS = [("rewrite", r"(?i)\brewrote|restored\b", 30), ("move", r"(?i)\bmoved\b", 15), ("care", r"(?i)\bcompared|measured\b", -20)]


@query(
    f"""WITH {_CH}, t AS (SELECT chunk_id, text, list_distinct({_TOK}) AS k FROM ch),
    s AS (SELECT chunk_id, text, CASE WHEN list_contains(k,'storage') AND list_contains(k,'controller') OR list_contains(k,'backup') THEN 40 ELSE 0 END AS e1, CASE WHEN list_contains(k,'camel') THEN 30 ELSE 0 END AS e2, CASE WHEN list_contains(k,'ledger') THEN 20 ELSE 0 END AS e3,
     regexp_matches(text, '(?i)\\brewrote|restored\\b') AS i1, regexp_matches(text, '(?i)\\bmoved\\b') AS i2, regexp_matches(text, '(?i)\\bcompared|measured\\b') AS i3 FROM t),
    u AS (SELECT *, greatest(0, least(200, e1+e2+e3+30*i1::INT+15*i2::INT-20*i3::INT)) AS score FROM s)
    SELECT chunk_id AS query_id, score::INT AS score, CASE WHEN (e1 > 0 AND i1) OR (score >= 60 AND e1+e2+e3 > 0) THEN 'REFUSE' WHEN score >= 30 THEN 'ALLOW_WITH_SAFETY_FRAMING' ELSE 'ALLOW' END AS outcome FROM u"""
)
def filt_intent_gate(spark, d):
    q = _chunks(spark, d).select(F.col("chunk_id").alias("query_id"), "text")
    ent = spark.createDataFrame(_ENTITIES, "category string, term string, weight int")
    return C.intent_gate(q, ent, spark.createDataFrame(_INTENTS, "name string, pattern string, weight int"), ["storage"], ["rewrite"])


@query(f"WITH {_CH} SELECT chunk_id AS text_id, CASE WHEN regexp_matches(text, '(?i)\\bsecondary server\\b') THEN 'server' ELSE 'forbidden list' END AS reason FROM ch WHERE regexp_matches(text, '(?i)\\bsecondary server\\b') OR regexp_matches(text, '(?i)\\bforbidden phrases\\b')")
def filt_hard_block(spark, d):
    return C.first_block(_texts(spark, d), [(r"(?i)\bsecondary server\b", "server"), (r"(?i)\bforbidden phrases\b", "forbidden list")])


# --- grounding -----------------------------------------------------------------------------------


_SPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_GT = lambda c: rf"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower({c}), '\bx(\d)', 'x \1', 'g'), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\x{{200C}}\x{{200D}}{_SPACE}]+', ' ', 'g'), '[{_SPACE}]+'), lambda x: x <> '')"
_AN = f"""{_BM}, an AS (SELECT query_id AS answer_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, chunk_id) AS rn FROM sc WHERE score > 0) WHERE rn <= 10),
 sn AS (SELECT query_id AS answer_id, 1 AS sentence_no, meta_language AS language, text AS sentence, {_GT('text')} AS t FROM queries WHERE leg = 'final' AND text IS NOT NULL AND meta_language IS NOT NULL),
 ev AS (SELECT answer_id, chunk_id, coalesce(meta_language, 'und') AS language, text, {_GT("coalesce(text,'')")} AS t FROM an JOIN ch USING (chunk_id))"""
_RUNS = lambda c: f"unnest(list_transform(range(1, len({c})-3), lambda i: array_to_string({c}[i:i+4], ' ')))"
_ST = f"{_AN}, ra AS (SELECT DISTINCT answer_id, sentence_no, {_RUNS('t')} AS run FROM sn WHERE len(t) >= 5), rb AS (SELECT answer_id, chunk_id, {_RUNS('t')} AS run, unnest(range(1, len(t)-3)) AS p FROM ev), gs AS (SELECT DISTINCT answer_id, sentence_no, chunk_id FROM ra JOIN rb USING (answer_id, run))"


def _answers(spark, d) -> tuple[DataFrame, DataFrame]:
    """A query's text as an answer of one sentence, and its best ten chunks as evidence."""
    q = _final(spark, d).where("text is not null and meta_language is not null").select(F.col("query_id").alias("answer_id"), "meta_language", F.lit(1).alias("sentence_no"), F.col("text").alias("sentence"))
    top = V.Bm25Index(_chunks(spark, d)).query(_final(spark, d), 10).select(F.col("query_id").alias("answer_id"), "chunk_id")
    return q.select("answer_id", "sentence_no", "sentence"), durable(top.join(_chunks(spark, d).select("chunk_id", "text"), "chunk_id"))


@query(f"WITH {_ST} SELECT * FROM gs")
def dom_grounding_strict(spark, d):
    return G.strict(*_answers(spark, d))


@query(
    f"""WITH {_AN}, a AS (SELECT answer_id, sentence_no, list_distinct(list_filter(t, lambda x: length(x) >= 3)) AS t FROM sn WHERE len(t) >= 4), b AS (SELECT answer_id, chunk_id, list_distinct(list_filter(t, lambda x: length(x) >= 3)) AS t FROM ev),
    j AS (SELECT answer_id, sentence_no, chunk_id, list_intersect(a.t, b.t) AS s, len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) AS c FROM a JOIN b USING (answer_id))
    SELECT answer_id, sentence_no, chunk_id, round(c, 6) AS containment FROM j WHERE len(s) >= 3 AND list_max(list_transform(s, lambda x: length(x))) >= 5 AND c >= 0.6"""
)
def dom_grounding_relaxed(spark, d):
    return G.relaxed(*_answers(spark, d)).withColumn("containment", F.round("containment", 6))


_NEG = "[" + ",".join(f"'{x}'" for x in G.NEGATIONS) + "]"


@query(
    f"""WITH {_AN}, a AS (SELECT answer_id, sentence_no, list_distinct(list_filter(t, lambda x: length(x) >= 3 OR regexp_matches(x, '^[0-9]'))) AS t, list_has_any(t, {_NEG}) AS neg FROM sn),
    b AS (SELECT answer_id, chunk_id, list_distinct(list_filter(t, lambda x: length(x) >= 3 OR regexp_matches(x, '^[0-9]'))) AS ct, list_has_any(t, {_NEG}) AS cneg FROM ev),
    j AS (SELECT answer_id, sentence_no, chunk_id, len(list_intersect(t, ct)) AS shared, len(list_intersect(t, ct)) / len(t) AS ratio FROM a JOIN b USING (answer_id)
      WHERE neg = cneg AND len(list_filter(t, lambda x: regexp_matches(x, '^[0-9]+$') AND NOT list_contains(ct, x))) = 0)
    SELECT answer_id, sentence_no, chunk_id, round(ratio, 6) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY answer_id, sentence_no ORDER BY ratio DESC, chunk_id DESC) AS rn FROM j WHERE shared >= 4 AND ratio >= 0.6) WHERE rn = 1"""
)
def dom_summary_support(spark, d):
    return G.summary_support(*_answers(spark, d)).withColumn("ratio", F.round("ratio", 6))


@query(f"WITH {_CH}, g AS (SELECT DISTINCT file_id, chunk_id, unnest(list_transform(range(1, len(tok)-3), lambda i: array_to_string(tok[i:i+4], ' '))) AS run FROM (SELECT file_id, chunk_id, {_TOK} AS tok FROM ch)) SELECT file_id, run, count(*)::BIGINT AS chunks FROM g GROUP BY 1,2 HAVING count(*) > 1")
def join_shared_runs(spark, d):
    """Runs of five words that several chunks of one file share."""
    t = T.tokens(F.coalesce("text", F.lit("")))
    g = _chunks(spark, d).select("file_id", F.explode(F.array_distinct(T.windows(t, 5))).alias("run"))
    return g.groupBy("file_id", "run").agg(F.count(F.lit(1)).alias("chunks")).where("chunks > 1")


# --- sets and orders -----------------------------------------------------------------------------


@query("SELECT lower(text) AS variant, min(query_id) AS query_id, count(*)::BIGINT AS n FROM queries WHERE text IS NOT NULL GROUP BY 1")
def sort_distinct_variants(spark, d):
    q = table(spark, d, "queries").where("text is not null")
    return q.groupBy(F.lower("text").alias("variant")).agg(F.min("query_id").alias("query_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT meta_language FROM chunks WHERE meta_language IS NOT NULL INTERSECT SELECT DISTINCT meta_language FROM queries")
def agg_language_buckets(spark, d):
    c = table(spark, d, "chunks").where("meta_language is not null").select("meta_language").distinct()
    return c.join(table(spark, d, "queries").select("meta_language").distinct(), "meta_language", "left_semi")


@query("SELECT DISTINCT meta_language FROM chunks WHERE meta_language IS NOT NULL EXCEPT SELECT meta_language FROM queries WHERE meta_language IS NOT NULL")
def sort_remaining_languages(spark, d):
    c = table(spark, d, "chunks").where("meta_language is not null").select("meta_language").distinct()
    return c.join(table(spark, d, "queries").select("meta_language").distinct(), "meta_language", "left_anti")


_RV = "list_sum(list_transform(range(1, length(page_label)+1), lambda i: CASE WHEN i < length(page_label) AND strpos('ivxlcdm', substr(page_label, i, 1)) < strpos('ivxlcdm', substr(page_label, i+1, 1)) THEN -1 ELSE 1 END * ([1,5,10,50,100,500,1000])[strpos('ivxlcdm', substr(page_label, i, 1))]))"


@query(
    f"""WITH l AS (SELECT DISTINCT page_label FROM blocks WHERE page_label <> ''), k AS (SELECT page_label, CASE WHEN regexp_matches(page_label, '^[ivxlcdm]+$') THEN 0 WHEN regexp_matches(page_label, '^[0-9]+$') THEN 1 ELSE 2 END AS kind FROM l),
    v AS (SELECT page_label, kind, CASE kind WHEN 0 THEN {_RV} WHEN 1 THEN page_label::BIGINT ELSE 0 END AS value FROM k)
    SELECT page_label, value::BIGINT AS value, row_number() OVER (ORDER BY kind, value, length(page_label), page_label) AS position FROM v"""
)
def sort_page_labels(spark, d):
    """Roman numerals by value, then numbers by value, then other labels; numbered over all partitions of the sorted labels."""
    lab = table(spark, d, "blocks").where("page_label <> ''").select("page_label").distinct()
    roman, number = F.col("page_label").rlike("^[ivxlcdm]+$"), F.col("page_label").rlike("^[0-9]+$")
    kind = F.when(roman, 0).when(number, 1).otherwise(2)
    value = F.when(roman, P.roman_number(F.col("page_label"))).when(number, F.expr("try_cast(page_label as bigint)")).otherwise(F.lit(0))
    lab = lab.select("page_label", kind.alias("kind"), value.cast("bigint").alias("value"), F.length("page_label").alias("n"))
    return R.numbered(lab, ["kind", "value", "n", "page_label"]).select("page_label", "value", "position")


@query(
    """WITH t AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_id, rn::INT AS turn FROM t WHERE rn <= 3"""
)
def win_last_turns(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("turn", F.row_number().over(w)).where("turn <= 3").select("user_id", "event_id", "turn")


@query("SELECT query_id, coalesce(nullif(trim(text), ''), 'rewritten') AS text, count(*)::BIGINT AS n FROM queries GROUP BY 1, 2")
def join_query_source(spark, d):
    """The text a leg asks with; an empty one falls back."""
    t = F.coalesce(F.when(F.trim("text") != "", F.trim("text")), F.lit("rewritten"))
    return table(spark, d, "queries").groupBy("query_id", t.alias("text")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_HI}, n AS (SELECT DISTINCT query_id, need_id FROM queries), ne AS (SELECT DISTINCT need_id FROM queries WHERE need_id IS NOT NULL),
    a AS (SELECT h.query_id, h.chunk_id, n.need_id, 1.0/(60+hit_rank) AS s FROM hi h JOIN n USING (query_id)),
    b AS (SELECT chunk_id, need_id, s FROM a WHERE need_id IS NOT NULL UNION ALL SELECT chunk_id, ne.need_id, s FROM (SELECT chunk_id, max(s) AS s FROM a WHERE need_id IS NULL GROUP BY 1), ne)
    SELECT need_id, count(DISTINCT chunk_id)::BIGINT AS chunks, round(max(s), 8) AS best FROM b GROUP BY 1"""
)
def join_needs_or_all(spark, d):
    """Chunks scored for the needs of their query, or for all needs where the query has none; the needs are a short list."""
    q = table(spark, d, "queries")
    needs = q.where("need_id is not null").select("need_id").distinct()
    a = _hits(spark, d).join(q.select("query_id", "need_id").distinct(), "query_id").select("chunk_id", "need_id", (1.0 / (60 + F.col("hit_rank"))).alias("s"))
    # what is free counts for every need: its chunks and best score are one row, and a need's own chunks add those that are not free
    free = a.where("need_id is null").groupBy("chunk_id").agg(F.max("s").alias("s"))
    own = a.where("need_id is not null")
    best = own.groupBy("need_id").agg(F.max("s").alias("_own"))
    added = own.select("need_id", "chunk_id").distinct().join(free, "chunk_id", "left_anti").groupBy("need_id").agg(F.count(F.lit(1)).alias("_added"))
    each = V._with_one(needs.join(best, "need_id", "left").join(added, "need_id", "left"), free.agg(F.count(F.lit(1)).alias("_free"), F.max("s").alias("_best")))
    out = each.select("need_id", (F.col("_free") + F.coalesce("_added", F.lit(0))).alias("chunks"), F.round(F.greatest("_own", "_best"), 8).alias("best"))
    return out.where("chunks > 0")


@query(
    f"""WITH {_LAST}, r AS (SELECT query_id, list_sort(list(DISTINCT retriever)) AS r FROM lh GROUP BY 1)
    SELECT query_id, unnest(CASE WHEN len(r) = 1 THEN r ELSE list_transform(range(1, len(r)), lambda i: r[i] || ' feeds ' || r[i+1]) END) AS claim FROM r"""
)
def dom_diagram_claims(spark, d):
    """Claims of diagrams: each chain of retrievers of a query drawn as a graph and read back."""
    h = _last_run(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_set("retriever")).alias("r"))
    node = lambda i: F.concat(F.lit("n"), i.cast("string"), F.lit("["), F.element_at("r", i), F.lit("]"))
    last = F.size("r")
    steps = F.when(last == 1, F.array(node(F.lit(1)))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last - 1, F.lit(1))), lambda i: F.concat(node(i), F.lit(" -->|feeds| "), node(F.least(i + 1, last)))))
    drawn = h.select("query_id", F.concat(F.lit("graph LR\n"), F.array_join(steps, "\n")).alias("text"))
    return drawn.select("query_id", F.explode(P.claims_of_diagram("text")).alias("claim"))


@query()
def dom_answer_claims(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(P.claims_of_answer("text")).alias("c")).select("doc_id", "c.kind", "c.claim")
