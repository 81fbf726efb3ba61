"""Every query of the subpackage over tables of nulls, of empty texts, and without rows."""

import os

import pytest

from gristmill.llm import pii, queries

TABLES = ("files", "blocks", "documents", "benchmark", "lang_samples", "sources")


def _write(spark, data, to, change):
    for t in TABLES:
        change(t, spark.read.parquet(f"{data}/{t}.parquet")).coalesce(1).write.parquet(f"{to}/{t}.parquet")
    return to


@pytest.fixture(scope="module")
def folders(spark, data, tmp_path_factory):
    from pyspark.sql import functions as F

    base = tmp_path_factory.mktemp("edges")

    def nulls(name, df):
        gone = df.limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
        return gone if name not in ("lang_samples",) else df.unionByName(gone)

    def empty_texts(name, df):
        return df.withColumn("text", F.lit("")) if "text" in df.columns else df

    def clashing(name, df):
        df = df.withColumns({c: F.lit("x") for c in ("tokens", "kind", "what", "piece", "n", "p", "_block", "label", "whole", "about", "rate") if c not in df.columns})
        return df.unionByName(df.limit(5))

    return {
        "none": _write(spark, data, str(base / "none"), lambda n, df: df.limit(0)),
        "nulls": _write(spark, data, str(base / "nulls"), nulls),
        "empty": _write(spark, data, str(base / "empty"), empty_texts),
        "clash": _write(spark, data, str(base / "clash"), clashing),
    }


@pytest.mark.parametrize("kind", ["none", "nulls", "empty", "clash"])
def test_queries_on_edge_tables(spark, folders, kind):
    for name, f in queries.QUERIES.items():
        rows = f(spark, folders[kind]).collect()
        if kind in ("none", "nulls", "empty") and name.endswith("_found"):
            assert rows == [], (name, rows[:3])


def test_repeated_rows_change_nothing_found(spark, data, folders):
    for name in ("p2_found", "p4_found", "p6_found", "p8_found"):
        a = {tuple(r) for r in queries.QUERIES[name](spark, data).collect()}
        b = {tuple(r) for r in queries.QUERIES[name](spark, folders["clash"]).collect()}
        assert a == b, name
    assert os.path.isdir(folders["none"])


def test_very_long_text():
    t = "Nothing is here at all, said the old man to the other. " * 8000
    found = pii.find([t + "Call +1 241 555 0170 if the door is locked."])[0]
    assert [k for k, _, _ in found] == ["phone"]
