"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1000) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder (or of a single file), at most so many files at once."""
    if path.endswith(".parquet"):
        path = path[:-1] + "[t]"  # as a pattern it may name a file as well as a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def new_versions(stream: DataFrame, key: str = "file_path", content_hash: str = "file_hash", late: str = "10 days", time: str = "ingested_at") -> DataFrame:
    """The first arrival of each version of a file, within the time that late rows are waited for.

    The state holds a key and hash per version seen within that time and drops older ones.
    """
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key, content_hash])


def upsert(target: str, key: str = "file_path", buckets: int = 16, order: str = "ingested_at"):
    """A batch sink that replaces the rows of the files in a batch: for ``writeStream.foreachBatch``.

    The target is a folder of Parquet in ``buckets`` partitions by hash of the key; only the
    partitions a batch touches are read and written again (dynamic partition overwrite). Of
    several rows of one key the one latest by ``order`` stays. A batch done twice gives the same.
    """

    def put(batch: DataFrame, _: int) -> None:
        from gristmill.session import durable

        spark = batch.sparkSession
        new = durable(batch.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        try:
            old = spark.read.parquet(target).where(F.col("_bucket").isin(touched)).join(new.select(key).distinct(), key, "left_anti")
            rows = new.unionByName(durable(old), allowMissingColumns=True)
        except Exception as e:  # the first batch finds no target
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            rows = new
        last = rows.groupBy("_bucket", key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("_bucket", key)]), F.struct(order)).alias("r"))
        last.select(key, "r.*", "_bucket").repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(target)

    return put


def start_upsert(stream: DataFrame, target: str, checkpoint: str, **settings) -> StreamingQuery:
    """Keeps the target up to date until all files there now are taken in."""
    return stream.writeStream.foreachBatch(upsert(target, **settings)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_counts(stream: DataFrame, every: str = "1 day", late: str = "10 days") -> DataFrame:
    """Pipeline stages by status in windows of event time; rows later than ``late`` are left out."""
    return stream.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", every), "stage", "status").agg(F.count(F.lit(1)).alias("n"))
