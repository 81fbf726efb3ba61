"""Ingestion: metadata filters, change detection, status, and chunks of structured blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators import chunking


def condition(where: dict) -> Column:
    """A filter as a predicate: ``{"a": v, "b": {"$eq": v}}``, ``$in``, ``$and``.

    Conditions are joined by AND. An operator other than these passes every row.
    """
    parts = [F.lit(True)]
    for k, v in where.items():
        if k == "$and":
            parts += [condition(x) for x in v]
        elif isinstance(v, dict):
            if "$eq" in v:
                parts.append(F.col(k) == v["$eq"])
            elif "$in" in v:
                parts.append(F.col(k).isin(v["$in"]))
        else:
            parts.append(F.col(k) == v)
    return reduce(lambda a, b: a & b, parts)


def matching(df: DataFrame, where: dict | None) -> DataFrame:
    return df.where(condition(where)) if where else df


def where_clause(clause: str, numeric: list[str]) -> str:
    """A WHERE clause for tables of text alone: LIKE takes any case, and columns named numeric are compared as numbers."""
    parts = re.split(r"('(?:[^']|'')*')", clause)
    for i in range(0, len(parts), 2):
        p = re.sub(r"\bLIKE\b", "ILIKE", parts[i], flags=re.I)
        for c in numeric:
            p = re.sub(rf"\b{re.escape(c)}\b(?=\s*(?:[<>=!]))", f"try_cast({c} AS DOUBLE)", p)
        parts[i] = p
    return "".join(parts)


def changed(files: DataFrame, seen: DataFrame, process_unchanged: bool = False) -> DataFrame:
    """Files that are new or whose hash is another than the one seen at their path; seen: (file_path, prev)."""
    if process_unchanged:
        return files
    return files.join(seen.select("file_path", "prev"), "file_path", "left").where(F.col("prev").isNull() | F.col("file_hash").isNull() | (F.col("prev") != F.col("file_hash"))).drop("prev")


def totals(log: DataFrame) -> DataFrame:
    """(file_id, inserted, skipped, skip_status, status) over redelivered log rows counted once.

    ``ALL`` where as many were skipped as inserted or none inserted, ``NONE`` where none were
    skipped, else ``PARTIAL``; ``ALL`` is not OK.
    """
    t = log.dropDuplicates().groupBy("file_id").agg(F.sum(F.coalesce("inserted", F.lit(0))).alias("inserted"), F.sum(F.coalesce("skipped", F.lit(0))).alias("skipped"))
    every = (F.col("skipped") == F.col("inserted")) | (F.col("inserted") == 0)
    t = t.withColumn("skip_status", F.when(every, "ALL").when(F.col("skipped") == 0, "NONE").otherwise("PARTIAL"))
    return t.withColumn("status", F.when(every, "NOT_OK").otherwise("OK"))


def table_chunks(blocks: DataFrame, limit: int = chunking.TABLE) -> DataFrame:
    """(block_id, my_chunk, text) of the tables among blocks, packed under a token limit with their header."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for block, cells, head, caption in zip(b["block_id"], b["table_rows"], b["header_rows"], b["caption"]):
                cells = [[None if c is None else str(c) for c in r] for r in cells]
                head = 0 if head is None or pd.isna(head) else int(head)
                rows += [(block, i, t) for i, t in enumerate(chunking.table_rows(cells, head, limit, caption or ""), 1)]
            yield pd.DataFrame(rows, columns=["block_id", "my_chunk", "text"])

    return blocks.where(F.size("table_rows") > 0).select("block_id", "table_rows", "header_rows", "caption").mapInPandas(run, "block_id bigint, my_chunk int, text string")


def page_chunks(blocks: DataFrame, limit: int = chunking.PDF) -> DataFrame:
    """(block_id, my_chunk, text): each page's text with its label and title, split over the limit; my_chunk runs on through a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, block, page, label, text in zip(b["file_id"], b["block_id"], b["page_number"], b["page_label"], b["text"]):
                rows += [(f, block, page, i, t) for i, t in enumerate(chunking.pages([(label or str(page), text)], limit))]
            yield pd.DataFrame(rows, columns=["file_id", "block_id", "page_number", "i", "text"])

    pages = blocks.where("page_number > 0 and text <> ''").select("file_id", "block_id", "page_number", "page_label", "text")
    out = pages.mapInPandas(run, "file_id bigint, block_id bigint, page_number int, i int, text string")
    w = Window.partitionBy("file_id").orderBy("page_number", "block_id", "i")
    return out.withColumn("my_chunk", F.row_number().over(w)).select("block_id", "my_chunk", "text")


def excluded(listed: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    """The list of excluded paths (file_path) after some are added and then some removed; each once, in one spelling of slashes."""
    path = lambda df: df.select(F.regexp_replace("file_path", r"\\", "/").alias("file_path")).where("trim(file_path) <> ''")
    out = path(listed)
    if add is not None:
        out = out.unionByName(path(add))
    out = out.distinct()
    return out.join(path(remove).distinct(), "file_path", "left_anti") if remove is not None else out


def allowed(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Files whose path is not on the list of excluded paths."""
    f = files.withColumn("_path", F.regexp_replace("file_path", r"\\", "/"))
    return f.join(listed.select(F.col("file_path").alias("_path")), "_path", "left_anti").drop("_path")


def stored(documents: DataFrame, ttl: str, most: int) -> DataFrame:
    """What a store keeps of its documents: those not older than ttl before its newest, and of these the newest within ``most`` bytes.

    documents: (store, doc_id, at, bytes). The oldest go first; of equal times the lower doc_id.
    """
    per = Window.partitionBy("store")
    fresh = documents.withColumn("_newest", F.max("at").over(per)).where(F.col("at") >= F.col("_newest") - F.expr(f"interval {ttl}"))
    held = F.sum(F.coalesce("bytes", F.lit(0))).over(per.orderBy(F.desc("at"), F.desc("doc_id")).rowsBetween(Window.unboundedPreceding, 0))
    return fresh.withColumn("_held", held).where(F.col("_held") <= most).drop("_newest", "_held")
