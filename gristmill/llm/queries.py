"""The queries of this subpackage over the tables of a directory, and SQL for those SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import encoding, language, leaks, mixing, ocr, pii, splitting, tokens
from gristmill.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_items(table(spark, d, "blocks", "block_id", "text"))


def p1_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.masked(table(spark, d, "blocks", "block_id", "text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_or_departing(table(spark, d, "files"), table(spark, d, "blocks"), table(spark, d, "lang_samples"))


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(table(spark, d, "files"), table(spark, d, "blocks"), table(spark, d, "lang_samples"))[0]


def p2_passages(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(table(spark, d, "files"), table(spark, d, "blocks"), table(spark, d, "lang_samples"))[1]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.found(table(spark, d, "blocks", "file_id", "block_id", "block_no", "page_number", "text"))


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    return ocr.repaired(table(spark, d, "blocks", "file_id", "block_id", "block_no", "page_number", "text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_blocks(table(spark, d, "blocks", "block_id", "text"))


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restored(table(spark, d, "blocks", "block_id", "text"))


def p5_budget(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_budget(table(spark, d, "files"), table(spark, d, "blocks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_leaks(spark, d).select("doc_id", "item_id").distinct()


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p7_repeats(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "sources"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "sources"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_documents(table(spark, d, "documents"), table(spark, d, "sources"), with_text=False)
    return pieces.where("piece_no = 2").select("doc_id").distinct()


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_documents(table(spark, d, "documents"), table(spark, d, "sources"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_masked": p1_masked,
    "p2_found": p2_found,
    "p2_files": p2_files,
    "p2_passages": p2_passages,
    "p3_found": p3_found,
    "p3_repaired": p3_repaired,
    "p4_found": p4_found,
    "p4_restored": p4_restored,
    "p5_budget": p5_budget,
    "p6_found": p6_found,
    "p6_leaks": p6_leaks,
    "p7_repeats": p7_repeats,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_pieces": p8_pieces,
}

def _plain(c: str) -> str:
    """A text without markup, accents, invisible characters and case."""
    bare = rf"regexp_replace(regexp_replace({c}, '<!--[^<]*-->|</?[A-Za-z][^<>]*>|&(#[0-9]+|[A-Za-z]+);', '', 'g'), '\]\([^()\s]+\)', '', 'g')"
    return rf"regexp_replace(strip_accents(lower({bare})), '[\x{{0300}}-\x{{036F}}\x{{00AD}}\x{{200B}}-\x{{200F}}\x{{2060}}-\x{{2064}}\x{{FEFF}}*_`~]', '', 'g')"


SQL: dict[str, str] = {
    # every run of eight words of every item is looked for in the letters of every document
    "p6_found": rf"""WITH it AS (SELECT item_id, regexp_extract_all({_plain('text')}, '[\p{{L}}\p{{N}}]+') AS w FROM benchmark WHERE length(text) > 0),
     ru AS (SELECT item_id, len(w) AS n, unnest(range(1, greatest(len(w)-7, 1)+1)) AS i, w FROM it WHERE len(w) > 0), rr AS (SELECT item_id, n, i, least(8, n) AS k, array_to_string(w[i:i+7], '') AS run FROM ru),
     dw AS (SELECT doc_id, regexp_replace({_plain('text')}, '[^\p{{L}}\p{{N}}]+', '', 'g') AS s FROM documents WHERE text <> ''),
     hit AS (SELECT DISTINCT doc_id, item_id, n, unnest(range(i, i+k)) AS p FROM dw JOIN rr ON contains(s, run))
     SELECT doc_id, item_id FROM hit GROUP BY doc_id, item_id, n HAVING count(DISTINCT p) >= 0.5 * n""",
    # all texts are clearly above or below their limit, so pieces of words stand for tokens
    "p8_found": r"SELECT DISTINCT d.doc_id FROM documents d JOIN sources s USING (source) WHERE len(regexp_extract_all(d.text, '[A-Za-z]{1,5}|[0-9]{1,3}|[^\sA-Za-z0-9]')) > s.max_tokens",
}
