"""Queries of streams, marked texts and gates, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import grounding as G
from gristmill.operators import history as H
from gristmill.plans import retrieval_queries as R
from gristmill.session import shared_folder
from gristmill.sources.tables import table
from gristmill.streaming import ingest as X

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
    """A new folder in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query("SELECT date_trunc('day', occurred_at) AS day, stage, status, count(*)::BIGINT AS n FROM ingest_log WHERE occurred_at IS NOT NULL GROUP BY 1, 2, 3")
def stream_status_counts(spark, d):
    """Stages by status and day of event time, counted by a stream over the log until all of it is taken in."""
    path = f"{d}/ingest_log.parquet"
    s = X.file_stream(spark, path, spark.read.parquet(path).schema)
    name = f"counts_{uuid.uuid4().hex}"
    counts = X.status_counts(s, late="3650 days")
    counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", _folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("window.start").alias("day"), "stage", "status", "n")


@query(
    """WITH f AS (SELECT file_path, file_id, ingested_at, file_hash FROM files) SELECT file_path, max(file_id) AS file_id, count(*)::BIGINT AS n FROM f GROUP BY 1"""
)
def stream_upsert_latest(spark, d):
    """Files kept up to date by a stream: the row of each path that is latest."""
    path = f"{d}/files.parquet"
    target = _folder(spark)
    s = X.file_stream(spark, path, spark.read.parquet(path).schema).select("file_path", "file_id", "file_hash", "ingested_at")
    X.start_upsert(s, target, _folder(spark), order="file_id", buckets=8).awaitTermination()
    return spark.read.parquet(target).groupBy("file_path").agg(F.max("file_id").alias("file_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, replace(text, 'the', '<mark>the</mark>') AS marked FROM documents WHERE text IS NOT NULL")
def proj_marked_text(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", H.marked(F.col("text"), ["the"]).alias("marked"))


@query(r"SELECT file_id, regexp_replace('see ' || replace(file_path, chr(92), '/'), '([^(\w/\[])(/[\w.\-]+(?:/[\w.\-]+)+)', '\1[\2](file://\2)', 'g') AS linked FROM files")
def proj_linkify(spark, d):
    """Source paths in texts as links."""
    return table(spark, d, "files").select("file_id", T.linkify(F.concat(F.lit("see "), T.path_normalise(F.col("file_path")))).alias("linked"))


@query(
    """WITH t AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events)
       SELECT user_id AS conv_id, event_id, turn::INT AS turn FROM t WHERE turn <= 4"""
)
def win_history_fetch(spark, d):
    """The first turns of each conversation by its turn index: ordered, then limited."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("turn", F.row_number().over(w)).where("turn <= 4").select(F.col("user_id").alias("conv_id"), "event_id", "turn")


@query(
    "SELECT file_id AS answer_id, coalesce(bool_and(CASE WHEN stage IN ('extract','chunk') THEN coalesce(status,'') = 'OK' END), true) AND coalesce(bool_or(CASE WHEN stage NOT IN ('extract','chunk') THEN coalesce(status,'') = 'OK' END), true) AS grounded FROM ingest_log WHERE stage IS NOT NULL GROUP BY 1"
)
def agg_evidence_gate(spark, d):
    """The evidence gate over claims; here stages of the log stand for prose and list claims, their status for support."""
    log = table(spark, d, "ingest_log").where("stage is not null")
    claims = log.select(F.col("file_id").alias("answer_id"), F.when(F.col("stage").isin("extract", "chunk"), "prose").otherwise("list").alias("kind"), (F.coalesce("status", F.lit("")) == "OK").alias("supported"))
    return G.evidence_gate(claims)


@query(
    f"""WITH {R._CH} SELECT chunk_id, round(0.9 - greatest(0, least(1, (n - 3)/7)) * 0.3, 6) AS threshold, CASE WHEN n < 3 THEN 'en' WHEN 0.75 >= 0.9 - greatest(0, least(1, (n - 3)/7)) * 0.3 AND meta_language IN ('en','de') THEN meta_language WHEN meta_language = 'fr' THEN 'fr' ELSE 'en' END AS language
    FROM (SELECT chunk_id, meta_language, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM ch WHERE meta_language IS NOT NULL)"""
)
def proj_language_fallback(spark, d):
    """The language taken from a detector's scores (here the label with 0.75 before its runner-up with 0.5)."""
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    c = R._chunks(spark, d).where("meta_language is not null").select("chunk_id", "meta_language", n.alias("n"))
    second = F.when(F.col("meta_language") == "fr", "fr").otherwise("xx")
    lang = T.detected_language(F.col("n"), F.col("meta_language"), F.lit(0.75), second, F.lit(0.5), ["en", "de"])
    lang = F.when((F.col("n") >= 3) & (F.col("meta_language") == "fr"), "fr").otherwise(lang)
    return c.select("chunk_id", F.round(T.language_threshold(F.col("n")), 6).alias("threshold"), lang.alias("language"))
