"""Every query of the engine's own operators over the tables of a directory, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gristmill.plans import flow_queries, more_queries, retrieval_queries, selection_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = text_queries.QUERIES | retrieval_queries.QUERIES | selection_queries.QUERIES | more_queries.QUERIES | flow_queries.QUERIES
SQL: dict[str, str] = text_queries.SQL | retrieval_queries.SQL | selection_queries.SQL | more_queries.SQL | flow_queries.SQL
