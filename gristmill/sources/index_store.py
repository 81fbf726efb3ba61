"""Indexes as tables in a folder, with what they were built from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(tables: dict[str, DataFrame], folder: str, collection: str, chunks: DataFrame) -> None:
    """Writes each table, and last the name of the collection and the number of its chunks."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    chunks.agg(F.count(F.lit(1)).alias("doc_count")).withColumn("collection", F.lit(collection)).write.mode("overwrite").parquet(f"{folder}/_about")


def fresh(spark: SparkSession, folder: str, collection: str, chunks: DataFrame) -> bool:
    """The folder holds an index of this collection and of as many chunks as it has now."""
    try:
        about = spark.read.parquet(f"{folder}/_about").first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise
    return about is not None and about["collection"] == collection and about["doc_count"] == chunks.count()


def load_or_build(spark: SparkSession, folder: str, collection: str, chunks: DataFrame, build: Callable[[DataFrame], dict[str, DataFrame]], names: list[str]) -> dict[str, DataFrame]:
    """The index's tables, built anew if they are stale."""
    if not fresh(spark, folder, collection, chunks):
        save(build(chunks), folder, collection, chunks)
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}
