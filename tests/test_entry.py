import importlib.util
import re

import pytest

import __spark_entry__ as entry


def test_names_and_sql_match():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and "flagship" in q
    assert any(re.match(r"p\d+_", n) for n in q) == (importlib.util.find_spec("gristmill.llm") is not None)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_catalogue_against_sql(spark, data):
    """Every query with SQL gives the same rows as that SQL on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    import os

    from gristmill.plans import catalogue

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(data):
        c.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")

    def plain(v):
        return repr(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else repr(v)

    wrong = []
    for name, sql in catalogue.SQL.items():
        df = catalogue.QUERIES[name](spark, data)
        cols = sorted(df.columns)
        got = sorted(tuple(plain(r[x]) for x in cols) for r in df.collect())
        r = c.execute(sql)
        names = [x[0] for x in r.description]
        want = sorted(tuple(plain(row[names.index(x)]) for x in cols) for row in r.fetchall())
        if sorted(names) != cols or got != want:
            wrong.append(name)
    assert wrong == []


def test_catalogue_without_sql_runs(spark, data):
    from gristmill.plans import catalogue

    for name, f in catalogue.QUERIES.items():
        if name not in catalogue.SQL:
            f(spark, data).write.format("noop").mode("overwrite").save()
