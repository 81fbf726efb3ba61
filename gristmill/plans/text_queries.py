"""Queries of the text functions, filters and ingestion, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import metadata as M
from gristmill.functions import parse as P
from gristmill.functions import text as T
from gristmill.operators import chunking, history, ingest
from gristmill.sources.tables import table

STOP = ["the", "of", "and", "a", "to", "in", "is", "was", "on", "at", "der", "die", "das", "le", "la", "el", "il", "o", "de", "que"]
QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# white space as str.split sees it, for RE2
_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text,''), '{_WS}'), lambda x: x <> '')"
_TOK = "regexp_extract_all(lower(coalesce(text,'')), '[a-z0-9]+')"


@query(f"SELECT chunk_id, my_chunk, len({_WORDS})::INT AS words, CAST(len({_WORDS}) * 1.3::DOUBLE AS DOUBLE) AS raw FROM chunks".replace(", CAST(len", ", floor(len").replace(" AS DOUBLE) AS raw", ")::INT AS tokens"))
def proj_word_and_token_count(spark: SparkSession, d: str) -> DataFrame:
    """Words and reckoned tokens of each chunk."""
    c = table(spark, d, "chunks")
    return c.select("chunk_id", "my_chunk", T.word_count(F.col("text")).alias("words"), T.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, len({_TOK})::INT AS tokens, len(list_distinct({_TOK}))::INT AS distinct_tokens, array_to_string({_TOK}[1:5], ' ') AS first_tokens FROM documents")
def proj_tokens_shared(spark, d):
    t = T.tokens(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("distinct_tokens"), F.array_join(F.slice(t, 1, 5), " ").alias("first_tokens"))


@query(
    rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[[:punct:]]', ' ', 'g'), '{_WS}', ' ', 'g')) AS clean FROM documents"""
)
def proj_clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query(
    "SELECT doc_id, array_to_string(list_filter("
    + _WORDS.replace("coalesce(text,'')", "text")
    + ", lambda w: NOT list_contains(["
    + ",".join(f"'{w}'" for w in STOP)
    + "], lower(w))), ' ') AS kept FROM documents WHERE text IS NOT NULL"
)
def proj_stop_words_removed(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.drop_stop_words(F.col("text"), STOP).alias("kept"))


@query(
    """SELECT query_id, variant_no, leg, len(list_distinct(flatten(list_transform(range(4,7), lambda n: list_transform(range(1, length(lower(text))-n+2), lambda i: substr(lower(text), i, n)))))) ::INT AS grams
       FROM queries WHERE text IS NOT NULL"""
)
def proj_char_ngrams(spark, d):
    q = table(spark, d, "queries").where("text is not null")
    return q.select("query_id", "variant_no", "leg", F.size(F.array_distinct(T.char_ngrams(F.lower("text"), 4, 6))).alias("grams"))


@query(
    f"""WITH t AS (SELECT chunk_id, my_chunk, {_TOK} AS tok FROM chunks)
        SELECT chunk_id, my_chunk, len(list_distinct(list_transform(range(1, len(tok)-3), lambda i: array_to_string(tok[i:i+4], ' '))))::INT AS windows FROM t"""
)
def proj_token_windows(spark, d):
    t = T.tokens(F.coalesce("text", F.lit("")))
    return table(spark, d, "chunks").select("chunk_id", "my_chunk", F.size(F.array_distinct(T.windows(t, 5))).alias("windows"))


_CUT = "chr(1)"
_SENTENCES = f"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(\\w\\w[.!?])\\s+', '\\1' || {_CUT}, 'g'),
  '(^|\n)\\s*[•\\-\\*●◦▪]\\s+', {_CUT}, 'g'), '\n\n+', {_CUT}, 'g'), '\n([A-Z])', {_CUT} || '\\1', 'g'), {_CUT}), lambda s: trim(s)), lambda s: s <> '')"""


@query(f"WITH s AS (SELECT doc_id, {_SENTENCES} AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, (unnest(generate_series(1, len(l))) - 1)::INT AS no, unnest(l) AS sentence FROM s")
def proj_sentences(spark, d):
    """Sentences of each document."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("no", "sentence"))


@query(
    """SELECT f.file_id, round(CASE WHEN greatest(length(coalesce(file_name,'')), length(coalesce(b.caption,''))) = 0 THEN 1.0
       ELSE 1 - levenshtein(coalesce(file_name,''), coalesce(b.caption,'')) / greatest(length(coalesce(file_name,'')), length(coalesce(b.caption,''))) END, 6) AS similarity, b.block_id
       FROM files f JOIN blocks b USING (file_id) WHERE b.caption <> ''"""
)
def proj_levenshtein(spark, d):
    b = table(spark, d, "blocks", "file_id", "block_id", "caption").where("caption <> ''")
    f = table(spark, d, "files", "file_id", "file_name")
    return b.join(f, "file_id").select("file_id", "block_id", F.round(T.levenshtein_similarity(F.col("file_name"), F.col("caption")), 6).alias("similarity"))


@query("SELECT doc_id, sha256(text) AS hash, substr(sha256(text), 1, 12) AS short FROM documents WHERE text IS NOT NULL")
def proj_hashes(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"), T.short_hash(F.col("text")).alias("short"))


_LANG_SQL = "CASE " + " ".join(
    "WHEN regexp_extract(lower(trim(meta_language)), '^([^-_ .]+)', 1) IN (" + ",".join(f"'{x}'" for x in (code, *names)) + f") THEN '{code}'" for code, names in M.LANGUAGE_NAMES.items()
) + " END"


@query(
    f"""SELECT file_id, replace(file_path, chr(92), '/') AS path, {_LANG_SQL} AS language,
        nullif(regexp_extract(regexp_replace(regexp_replace(regexp_replace(lower(replace(file_path, chr(92), '/')), '^(https?:)/+[^/]+/', '/corpus/'), '/(\\./)+', '/', 'g'), '/+', '/', 'g'), '/corpus/(?:\\./)*([^/]+)/', 1), '') AS domain
        FROM files"""
)
def proj_metadata_canonical(spark, d):
    f = table(spark, d, "files")
    return f.select("file_id", T.path_normalise(F.col("file_path")).alias("path"), M.canonical_language(F.col("meta_language")).alias("language"), M.path_domain(F.col("file_path")).alias("domain"))


@query(
    """SELECT file_id, CASE WHEN left_ <= 0 THEN 2048 ELSE least(left_, 2048) END::INT AS budget FROM
       (SELECT file_id, 8192 - 700 - coalesce(word_count, 0) * 13 AS left_ FROM files)"""
)
def proj_output_budget(spark, d):
    f = table(spark, d, "files")
    return f.select("file_id", T.output_budget(F.lit(8192), F.lit(700), F.coalesce("word_count", F.lit(0)) * 13, F.lit(2048)).cast("int").alias("budget"))


@query("SELECT run_id, query_id, retriever, leg, hit_rank, round(CASE WHEN score < -700 THEN 0.0 ELSE 1/(1+exp(-score)) END, 6) AS p FROM hits")
def proj_sigmoid(spark, d):
    h = table(spark, d, "hits")
    return h.select("run_id", "query_id", "retriever", "leg", "hit_rank", F.round(T.sigmoid(F.col("score")), 6).alias("p"))


@query(
    f"""SELECT chunk_id, my_chunk, trim(regexp_replace(translate(lower(text), '0123456789@$!', 'oizeasgtbgasi'), '{_WS}', ' ', 'g')) AS norm
        FROM chunks WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]')"""
)
def proj_compliance_normalise(spark, d):
    c = table(spark, d, "chunks").where(~F.col("text").rlike(r"[^\x00-\x7F]"))
    return c.select("chunk_id", "my_chunk", T.compliance_normalise(F.col("text")).alias("norm"))


@query()
def proj_unicode_normalise(spark, d):
    return table(spark, d, "chunks").select("chunk_id", "my_chunk", T.unicode_normalise("text").alias("norm"), T.compliance_normalise(F.col("text")).alias("folded"))


def _masked_sql(c: str) -> str:
    """All maskings in turn. What the patterns look at beside a match is taken into groups, as RE2 has no look-around."""
    for name, _, pattern, to in sorted(T.MASKS, key=lambda m: (m[1], m[0])):
        pattern = pattern.replace("(?<local>", "(").replace("(?<domain>", "(").replace("'", "''")
        if pattern.startswith("(?<!["):
            pattern = "(^|[^0-9a-fA-F])" + pattern[len("(?<![0-9a-fA-F])") : -len("(?![0-9a-fA-F])")] + "($|[^0-9a-fA-F])"
            to = f"\\1{to}\\2"
        c = f"regexp_replace({c}, '(?im){pattern}', '{to}', 'g')"
    return c


@query(f"SELECT block_id, {_masked_sql('text')} AS masked FROM blocks WHERE text IS NOT NULL")
def proj_mask(spark, d):
    return table(spark, d, "blocks").where("text is not null").select("block_id", T.mask(F.col("text")).alias("masked"))


def _credentials_sql(c: str) -> str:
    for pattern, to in T.CREDENTIALS:
        c = f"""regexp_replace({c}, '{pattern.replace("(?![*]{6})", "")}', '{to.replace("$1", chr(92) + "1")}', 'g')"""
    return c


@query(f"SELECT block_id, {_masked_sql(_credentials_sql('text'))} AS masked FROM blocks WHERE text IS NOT NULL")
def proj_mask_all(spark, d):
    """Credentials in text for logs first, then all maskings."""
    return table(spark, d, "blocks").where("text is not null").select("block_id", T.mask(T.mask_credentials(F.col("text"))).alias("masked"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], prev::DOUBLE[]), 6) AS cosine FROM (SELECT vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings) WHERE prev IS NOT NULL")
def win_consecutive_cosine(spark, d):
    """Cosine of neighbours in order, within each label."""
    e = table(spark, d, "embeddings").withColumn("prev", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id")))
    return e.where("prev is not null").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("prev")), 6).alias("cosine"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first_unit FROM embeddings")
def proj_l2_normalise(spark, d):
    e = table(spark, d, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return e.select("vec_id", F.round(norm, 4).alias("norm"), F.round(T.l2_normalise(F.col("embedding"))[0], 6).alias("first_unit"))


@query(f"SELECT doc_id, array_to_string(({_WORDS})[1:40], ' ') AS cut FROM documents WHERE text IS NOT NULL")
def proj_truncate_tokens(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.first_words(F.col("text"), 40).alias("cut"))


@query("SELECT block_id, CASE WHEN trim(coalesce(heading_path, '')) = '' THEN text ELSE text || chr(10) || '[section: ' || heading_path || ']' END AS placed FROM blocks WHERE text IS NOT NULL")
def proj_breadcrumb(spark, d):
    return table(spark, d, "blocks").where("text is not null").select("block_id", T.breadcrumb(F.col("text"), F.col("heading_path"), "suffix").alias("placed"))


@query(
    """SELECT b.block_id, '(Source: ' || f.file_name || CASE WHEN page_number > 0 THEN ' | Page ' || coalesce(nullif(page_label, ''), page_number::VARCHAR) ELSE '' END || ')' || chr(10) || 'Content:' || chr(10) || b.text AS context
       FROM blocks b JOIN files f USING (file_id) WHERE b.text IS NOT NULL AND b.text <> ''"""
)
def proj_context_format(spark, d):
    b = table(spark, d, "blocks", "file_id", "block_id", "page_number", "page_label", "text").where("text is not null and text <> ''")
    f = table(spark, d, "files", "file_id", "file_name")
    page = F.when(F.col("page_number") > 0, F.concat(F.lit(" | Page "), F.coalesce(F.when(F.col("page_label") != "", F.col("page_label")), F.col("page_number").cast("string")))).otherwise("")
    return b.join(f, "file_id").select("block_id", F.concat(F.lit("(Source: "), "file_name", page, F.lit(")\nContent:\n"), "text").alias("context"))


@query(
    """SELECT log_id, CASE WHEN regexp_matches(lower(trim(status)), '\\b(s[0-9])\\b') THEN upper(regexp_extract(lower(trim(status)), '\\b(s[0-9])\\b', 1))
       WHEN regexp_matches(lower(trim(status)), '\\b(unsafe|not safe|harmful|blocked|refuse|violation)\\b') THEN 'unsafe'
       WHEN regexp_matches(lower(trim(status)), '\\b(safe|ok|allowed|harmless|benign)\\b') THEN 'safe' END AS label FROM ingest_log"""
)
def proj_guard_label(spark, d):
    return table(spark, d, "ingest_log").select("log_id", T.guard_label(F.col("status")).alias("label"))


_ROMAN_OK = "^(?:\\d+|(?:xc|xl|l?x{0,3}|c{1,3}(?:xc|xl|l?x{0,3}))(?:ix|iv|v?i{0,3}))$"
_LABELS = ", ".join(
    f"""CASE WHEN regexp_matches(lower(regexp_extract({where}, '{dress.replace("{page}", "page")}', 1)), '{_ROMAN_OK}') AND regexp_extract({where}, '{dress.replace("{page}", "page")}', 1) <> '' THEN lower(regexp_extract({where}, '{dress.replace("{page}", "page")}', 1)) END"""
    for where, dress in P._DRESSES
)


@query(
    f"""WITH k AS (SELECT block_id, string_split(regexp_replace(regexp_replace(coalesce(text,''), '^\\s+', ''), '\\s+$', ''), chr(10)) AS l FROM blocks WHERE page_number > 0),
    e AS (SELECT block_id, regexp_replace(l[1], '\\s+$', '') AS head, regexp_replace(l[-1], '^\\s+', '') AS foot FROM k) SELECT block_id, coalesce({_LABELS}, '') AS label FROM e"""
)
def proj_page_label(spark, d):
    """Labels that pages print."""
    return table(spark, d, "blocks").where("page_number > 0").select("block_id", P.page_label(F.col("text")).alias("label"))


@query()
def proj_stem(spark, d):
    t = table(spark, d, "chunks").select(F.explode(F.array_distinct(T.tokens(F.coalesce("text", F.lit(""))))).alias("word")).distinct()
    return t.select("word", P.stemmed("word").alias("stem"))


@query()
def agg_reverse_stem(spark, d):
    """For each stem the surface form that occurs most, of equal ones the first in the alphabet."""
    n = table(spark, d, "chunks").select(F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return n.select("word", "n", P.stemmed("word").alias("stem")).groupBy("stem").agg(F.min_by("word", F.struct(-F.col("n"), "word")).alias("surface"), F.max("n").alias("n"))


@query("SELECT event_id, ts, try_cast(json_extract_string(props, '$.' || json_keys(props)[1]) AS VARCHAR) AS first_value FROM events WHERE json_valid(props)")
def proj_json_parse(spark, d):
    """The first property of each event's JSON."""
    e = table(spark, d, "events")
    m = F.from_json("props", "map<string,string>")
    return e.where(F.from_json("props", "map<string,string>").isNotNull()).select("event_id", "ts", F.map_values(m)[0].alias("first_value"))


@query()
def proj_json_repair(spark, d):
    """Broken answers put right: the closing brackets of each event's JSON are cut off first."""
    e = table(spark, d, "events")
    return e.select("event_id", P.repaired_json(F.expr("substring(props, 1, length(props) - 1)")).alias("json"))


# --- filters -------------------------------------------------------------------------------------


@query("SELECT chunk_id, my_chunk FROM chunks WHERE source = 'web' AND meta_language = 'en'")
def filt_metadata_equality(spark, d):
    return ingest.matching(table(spark, d, "chunks"), {"source": "web", "meta_language": {"$eq": "en"}, "my_chunk": {"$gt": 1}}).select("chunk_id", "my_chunk")


@query("SELECT file_id FROM files WHERE file_type IN ('pdf','md') AND source = 'local'")
def filt_in_list(spark, d):
    return ingest.matching(table(spark, d, "files"), {"$and": [{"file_type": {"$in": ["pdf", "md"]}}, {"source": "local"}]}).select("file_id")


@query("SELECT file_id FROM files WHERE file_name ILIKE '%SCAN%' AND try_cast(word_count AS DOUBLE) > 100")
def filt_sql_where(spark, d):
    """A WHERE clause as users write it for classification tables: LIKE in any case, numbers compared as numbers."""
    f = table(spark, d, "files").select("file_id", F.col("file_name").alias("FileName"), F.col("word_count").cast("string").alias("WordCount"))
    return f.where(F.expr(ingest.where_clause("FileName LIKE '%SCAN%' AND WordCount > 100", ["WordCount"]))).select("file_id")


@query(f"SELECT file_id, CASE WHEN {_LANG_SQL} IN ('en','de','fr') THEN 'OK' ELSE 'FALLBACK_EN' END AS gate FROM files")
def filt_language_gate(spark, d):
    return table(spark, d, "files").select("file_id", F.when(M.canonical_language(F.col("meta_language")).isin("en", "de", "fr"), "OK").otherwise("FALLBACK_EN").alias("gate"))


@query(
    """WITH seen AS (SELECT file_path, max(file_hash) AS prev FROM files WHERE ingested_at < TIMESTAMP '2024-07-01' GROUP BY file_path)
       SELECT f.file_id FROM files f LEFT JOIN seen s USING (file_path) WHERE s.prev IS NULL OR f.file_hash IS NULL OR s.prev <> f.file_hash"""
)
def filt_unchanged_skip(spark, d):
    f = table(spark, d, "files")
    seen = f.where(F.col("ingested_at") < F.lit("2024-07-01").cast("timestamp")).groupBy("file_path").agg(F.max("file_hash").alias("prev"))
    return ingest.changed(f, seen).select("file_id")


@query("SELECT count(*)::BIGINT AS n, min(chunk_id) AS first FROM chunks WHERE trim(text) <> ''")
def filt_empty_drop(spark, d):
    return table(spark, d, "chunks").where(F.trim("text") != "").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first"))


@query("SELECT query_id, variant_no, leg, CASE WHEN regexp_matches(lower(text), 'follow.?up') THEN 'follow_up' WHEN regexp_matches(lower(text), '\\btags?\\b') THEN 'tags' WHEN regexp_matches(lower(text), '\\btitle\\b') THEN 'title' ELSE 'chat' END AS kind FROM queries WHERE text IS NOT NULL")
def filt_request_kind(spark, d):
    q = table(spark, d, "queries").where("text is not null")
    t = F.lower("text")
    return q.select("query_id", "variant_no", "leg", F.when(t.rlike("follow.?up"), "follow_up").when(t.rlike(r"\btags?\b"), "tags").when(t.rlike(r"\btitle\b"), "title").otherwise("chat").alias("kind"))


@query("SELECT DISTINCT w AS noun FROM (SELECT unnest(regexp_split_to_array(text, ' ')) AS w FROM chunks) WHERE length(w) >= 3 AND NOT regexp_matches(w, '^[\\[({<]') AND regexp_matches(w, '[A-Za-z]')")
def filt_noun_noise(spark, d):
    w = table(spark, d, "chunks").select(F.explode(F.split("text", " ")).alias("noun"))
    return w.where((F.length("noun") >= 3) & ~F.col("noun").rlike(r"^[\[({<]") & F.col("noun").rlike("[A-Za-z]")).distinct()


# --- ingestion -----------------------------------------------------------------------------------


@query("SELECT f.file_id FROM files f WHERE EXISTS (SELECT 1 FROM ingest_log l WHERE l.file_path = f.file_path AND l.stage = 'store' AND l.status = 'OK')")
def join_allow_semi(spark, d):
    allow = table(spark, d, "ingest_log").where("stage = 'store' and status = 'OK'").select("file_path")
    return table(spark, d, "files").join(allow, "file_path", "left_semi").select("file_id")


@query("SELECT f.file_id FROM files f WHERE NOT EXISTS (SELECT 1 FROM ingest_log l WHERE l.file_path = f.file_path AND l.status = 'NOT_OK')")
def join_exclude_anti(spark, d):
    out = table(spark, d, "ingest_log").where("status = 'NOT_OK'").select("file_path")
    return table(spark, d, "files").join(out, "file_path", "left_anti").select("file_id")


@query(
    """WITH l AS (SELECT DISTINCT * FROM ingest_log WHERE stage IN ('chunk','store')),
       t AS (SELECT file_id, sum(coalesce(inserted,0)) AS ins, sum(coalesce(skipped,0)) AS skp FROM l GROUP BY file_id)
       SELECT file_id, ins::BIGINT AS inserted, skp::BIGINT AS skipped, CASE WHEN skp = ins OR ins = 0 THEN 'ALL' WHEN skp = 0 THEN 'NONE' ELSE 'PARTIAL' END AS skip_status,
              CASE WHEN skp = ins OR ins = 0 THEN 'NOT_OK' ELSE 'OK' END AS status FROM t"""
)
def agg_ingest_totals(spark, d):
    return ingest.totals(table(spark, d, "ingest_log").where("stage in ('chunk','store')"))


@query("SELECT coalesce(status, 'IGNORED') AS status, count(*)::BIGINT AS n, count(DISTINCT file_id)::BIGINT AS files FROM (SELECT DISTINCT * FROM ingest_log) GROUP BY 1")
def agg_status_counters(spark, d):
    log = table(spark, d, "ingest_log").dropDuplicates()
    return log.groupBy(F.coalesce("status", F.lit("IGNORED")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_id").alias("files"))


@query(
    """SELECT file_id, stage, status, inserted, skipped FROM (SELECT *, row_number() OVER (PARTITION BY file_id, stage ORDER BY occurred_at DESC, log_id DESC) AS rn FROM ingest_log) WHERE rn = 1"""
)
def win_latest_stage(spark, d):
    w = Window.partitionBy("file_id", "stage").orderBy(F.desc("occurred_at"), F.desc("log_id"))
    return table(spark, d, "ingest_log").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("file_id", "stage", "status", "inserted", "skipped")


@query()
def dom_chunks_by_type(spark, d):
    """Files' texts cut by the chunker of their type."""
    text = table(spark, d, "blocks").where("text <> ''").groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda s: s["text"]), "\n\n").alias("text"))
    docs = text.join(table(spark, d, "files", "file_id", "file_type"), "file_id").select(F.col("file_id").alias("doc_id"), "text", "file_type")
    return chunking.chunked(docs)


@query()
def dom_chunks_sliding(spark, d):
    return chunking.chunked(table(spark, d, "documents").select("doc_id", "text"), chunking.sliding)


@query()
def dom_chunks_recursive(spark, d):
    return chunking.chunked(table(spark, d, "documents").select("doc_id", "text"), chunking.recursive)


@query()
def dom_chunks_headings(spark, d):
    return chunking.chunked(table(spark, d, "documents").select("doc_id", "text"), chunking.headings)


@query()
def dom_chunks_tables(spark, d):
    return ingest.table_chunks(table(spark, d, "blocks"))


@query()
def dom_chunks_pages(spark, d):
    return ingest.page_chunks(table(spark, d, "blocks"))


@query("SELECT file_id, count(*)::BIGINT AS blocks, sum((table_rows IS NOT NULL AND len(table_rows) > 0)::INT)::BIGINT AS tables, string_agg(CASE WHEN table_rows IS NOT NULL AND len(table_rows) > 0 THEN 'T' ELSE 'P' END, '' ORDER BY block_no, block_id) AS layout FROM blocks GROUP BY file_id")
def dom_mixed_layout(spark, d):
    """The order of prose and tables in each file, kept when each goes to its own chunker."""
    b = table(spark, d, "blocks").withColumn("t", F.size("table_rows") > 0)
    rows = b.groupBy("file_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.coalesce("t", F.lit(False)).cast("long")).alias("tables"), F.array_sort(F.collect_list(F.struct("block_no", "block_id", F.when(F.col("t"), "T").otherwise("P").alias("k")))).alias("r"))
    return rows.select("file_id", "blocks", "tables", F.array_join(F.transform("r", lambda x: x["k"]), "").alias("layout"))


# --- conversations, keywords, summaries --------------------------------------------------------


@query(
    """WITH t AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
       o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, n FROM t)
       SELECT user_id AS conv_id, turn::INT AS turn, 'turn' AS kind FROM o WHERE n <= 5 UNION ALL SELECT user_id, max(turn)::INT, 'summary' FROM o WHERE n > 5 GROUP BY 1"""
)
def win_prune_history(spark, d):
    e = table(spark, d, "events")
    turns = e.select(F.col("user_id").alias("conv_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("turn"), F.col("event_type").alias("text"))
    return history.pruned(turns, 5).select("conv_id", "turn", "kind")


@query(
    """WITH s(lemma, synonym) AS (VALUES ('ledger','register'),('register','record'),('report','account'),('account','record'),('server','host'),('ramp','slope'),('ramp','incline')),
       l AS (SELECT DISTINCT lower(lemma) AS a, lower(synonym) AS b FROM s), p AS (SELECT DISTINCT lemma AS phrase FROM s),
       r1 AS (SELECT phrase, b AS w, 1 AS step FROM p JOIN l ON a = phrase), r2 AS (SELECT DISTINCT phrase, b AS w, 2 AS step FROM r1 JOIN l ON a = w WHERE b <> phrase AND (phrase, b) NOT IN (SELECT phrase, w FROM r1)),
       al AS (SELECT DISTINCT * FROM r1 UNION ALL SELECT * FROM r2)
       SELECT phrase, w AS synonym, (row_number() OVER (PARTITION BY phrase ORDER BY step, w))::INT AS n FROM al"""
)
def proj_synonyms(spark, d):
    rows = [("ledger", "register"), ("register", "record"), ("report", "account"), ("account", "record"), ("server", "host"), ("ramp", "slope"), ("ramp", "incline")]
    syn = spark.createDataFrame(rows, "lemma string, synonym string")
    return history.synonyms(syn.select(F.col("lemma").alias("phrase")).distinct(), syn, 2)


_GRAMS = ", ".join(" || ' ' || ".join(f"lead(w, {j}) OVER d" if j else "w" for j in range(k)) for k in (1, 2, 3, 4))


@query(
    f"""WITH tk AS (SELECT doc_id, list_filter({_TOK}, lambda w: length(w) > 2) AS t FROM documents), u AS (SELECT doc_id, unnest(t) AS w, unnest(generate_series(1, len(t))) AS p FROM tk), gs AS (SELECT doc_id, [{_GRAMS}] AS g FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
    tf AS (SELECT doc_id, g, count(*) AS tf FROM (SELECT doc_id, unnest(g) AS g FROM gs) WHERE g IS NOT NULL GROUP BY 1, 2),
    df AS (SELECT g, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT doc_id) AS n FROM documents), w AS (SELECT doc_id, g, tf * ln((1 + n) / (1 + df)) AS w FROM tf JOIN df USING (g), n),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, g) AS r FROM w) WHERE r <= 60),
    k AS (SELECT doc_id, keyword, max(w) AS weight FROM (SELECT doc_id, unnest(string_split(g, ' ')) AS keyword, w FROM b) GROUP BY 1, 2)
    SELECT doc_id, keyword, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, keyword) AS r FROM k) WHERE r <= 30"""
)
def dom_keywords(spark, d):
    return history.keywords(table(spark, d, "documents")).withColumn("weight", F.round("weight", 6))


@query()
def agg_summaries(spark, d):
    return history.summaries(table(spark, d, "documents"))


@query("SELECT file_id, file_path, (SELECT count(DISTINCT file_path) > 1 FROM files WHERE lower(file_name) = (SELECT lower(min(file_name)) FROM files)) AS ambiguous FROM files WHERE lower(file_name) = (SELECT lower(min(file_name)) FROM files)")
def fuse_document_selection(spark, d):
    """The files of a name (here the first in the alphabet), marked as ambiguous where several paths have it."""
    f = table(spark, d, "files")
    return history.select_document(f, f.agg(F.min("file_name")).first()[0])


@query("SELECT query_id, variant_no, leg, regexp_matches(lower(trim(text)), '^(?:and |but |so )?(?:he|she|it|they|this|that|these|those)\\b|\\b(?:his|its|their)\\b') AND NOT regexp_matches(regexp_replace(trim(text), '^\\S+\\s*', ''), '[A-Z\\d]') AS unresolved FROM queries WHERE text IS NOT NULL")
def filt_unresolved_pronoun(spark, d):
    return table(spark, d, "queries").where("text is not null").select("query_id", "variant_no", "leg", history.unresolved_pronoun(F.col("text")).alias("unresolved"))


@query("SELECT event_id, CASE WHEN value > 50 THEN 'asked again: ' || event_type ELSE event_type END AS text FROM events")
def fuse_rewrite_decision(spark, d):
    """A rewriter's answer decides which text is asked; here the answers are made from each event's value."""
    e = table(spark, d, "events")
    answer = F.to_json(F.struct((F.col("value") > 50).alias("depends"), F.lit(0.9).alias("confidence"), F.concat(F.lit("asked again: "), "event_type").alias("contextual"), F.lit("").alias("standalone")))
    return e.select("event_id", history.rewritten_query(answer, F.col("event_type"), F.array().cast("array<string>")).alias("text"))


# --- beyond text: windows of event time ----------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def agg_event_windows(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2")
def agg_lineitem_summary(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))
