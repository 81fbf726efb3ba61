"""Files as sources: folders of documents, tables of text, and the formats they are written in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gristmill.functions import parse as P

#: Extensions of text that are read, beside those of documents and images.
TEXT = ("txt", "md", "py", "c", "h", "cpp", "csv", "log")
DOCUMENTS = ("pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "html", "htm")
IMAGES = ("png", "jpg", "jpeg", "gif", "bmp", "tiff", "webp")


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = TEXT) -> DataFrame:
    """(path, modificationTime, length, content) of the files under a folder with one of the extensions.

    The listing is Spark's own; the extension decides before any content is read.
    """
    glob = "*.{" + ",".join(sorted({*extensions, *(x.upper() for x in extensions)})) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)


def decode(data: bytes | None) -> str | None:
    """UTF-8, else the first of a few encodings under which the text reads as words, else Latin-1."""
    if data is None:
        return None
    for bom, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(bom):
            return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    best, score = None, -1.0
    for name in ("cp1252", "cp850", "mac_roman"):
        try:
            t = data.decode(name)
        except UnicodeDecodeError:
            continue
        odd = [c for c in t if ord(c) > 127]
        s = sum(c.isalpha() and c.lower() in "àáâãäåæçèéêëìíîïñòóôõöøœùúûüýß" or c in "’“”«»–—€" for c in odd) / max(1, len(odd))
        if s > score:
            best, score = t, s
    return best if best is not None and score >= 0.5 else data.decode("latin-1")


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    return content.map(decode)


def read_text(spark: SparkSession, root: str, extensions: tuple[str, ...] = TEXT) -> DataFrame:
    """(file_path, file_type, text, file_hash) of text files; valid UTF-8 is decoded in the JVM."""
    f = scan(spark, root, extensions)
    text = F.when(F.expr("is_valid_utf8(content)"), F.decode("content", "utf-8")).otherwise(decoded(F.when(~F.expr("is_valid_utf8(content)"), F.col("content"))))
    return f.select(F.col("path").alias("file_path"), F.lower(F.substring_index("path", ".", -1)).alias("file_type"), text.alias("text"), F.sha2("content", 256).alias("file_hash"))


def read_html(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, text) of web pages without their furniture."""
    f = scan(spark, root, ("html", "htm"))
    return f.select(F.col("path").alias("file_path"), P.page_text(decoded("content")).alias("text"))


def _parts(data: bytes, names: str, block: str) -> list[str]:
    """The text of the elements called ``block`` in the parts of an office file whose names match, in order of their numbers."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        found = [n for n in z.namelist() if re.fullmatch(names, n)]
        for name in sorted(found, key=lambda n: [int(x) for x in re.findall(r"\d+", n)]):
            for e in ElementTree.fromstring(z.read(name)).iter():
                if e.tag.rsplit("}", 1)[-1] == block:
                    out.append("".join(t.text or "" for t in e.iter() if t.tag.rsplit("}", 1)[-1] == "t"))
    return [x for x in out if x.strip()]


def word_text(data: bytes) -> str:
    """The paragraphs of a Word document (docx), tables included, a line each."""
    return "\n".join(_parts(data, r"word/document\.xml", "p"))


def slides_text(data: bytes) -> str:
    """The paragraphs of the slides of a presentation (pptx) in order, a line each."""
    return "\n".join(_parts(data, r"ppt/slides/slide\d+\.xml", "p"))


def sheet_text(data: bytes) -> str:
    """The rows of the sheets of a workbook (xlsx), a line each with `` | `` between cells; shared strings are put in."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    local = lambda e: e.tag.rsplit("}", 1)[-1]
    lines = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if local(si) == "si"]
        for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group())):
            for row in ElementTree.fromstring(z.read(name)).iter():
                if local(row) != "row":
                    continue
                cells = []
                for c in row:
                    text = "".join(t.text or "" for t in c.iter() if local(t) in ("v", "t"))
                    cells.append(shared[int(text)] if c.get("t") == "s" and text.isdigit() and int(text) < len(shared) else text)
                if any(x.strip() for x in cells):
                    lines.append(" | ".join(cells))
    return "\n".join(lines)


#: Readers of office files that need no library beside Python's own.
READERS = {"docx": word_text, "pptx": slides_text, "xlsx": sheet_text}


def read_documents(spark: SparkSession, root: str, readers: dict | None = None) -> DataFrame:
    """(file_path, file_type, text) of office files and images, by a reader for each extension.

    readers: {extension: function of bytes to text}, run in Arrow batches, beside those in
    READERS. A type without a reader, and a file that its reader can't open, has null text.
    """
    readers = READERS | (readers or {})

    def opened(kind: str, data: bytes) -> str | None:
        try:
            return readers[kind](data) if kind in readers else None
        except Exception:  # noqa: BLE001 - whatever a damaged file does to a reader, the other files are read
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kind = b["path"].str.rsplit(".", n=1).str[-1].str.lower()
            text = [opened(k, c) for k, c in zip(kind, b["content"])]
            yield pd.DataFrame({"file_path": b["path"], "file_type": kind, "text": text})

    return scan(spark, root, DOCUMENTS + IMAGES).select("path", "content").mapInPandas(run, "file_path string, file_type string, text string")


def write_classification(df: DataFrame, path: str, mode: str = "append") -> None:
    """Rows by status as text tables with ``;`` and every field quoted; lists as ``a, b``, maps as ``k: v``, null as empty."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        s = F.array_join(c, ", ") if kind == "array" else F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string"))), ", ") if kind == "map" else c.cast("string")
        cols.append(c.alias(f.name) if f.name == "Status" else F.coalesce(s, F.lit("")).alias(f.name))
    df.select(*cols).write.mode(mode).partitionBy("Status").option("sep", ";").option("quoteAll", "true").option("header", "true").option("escape", '"').csv(path)


def read_classification(spark: SparkSession, path: str, where: str | None = None, numeric: tuple[str, ...] = ("WordCount",)) -> DataFrame:
    """A classification table as text, filtered by a WHERE clause as users write it; rows without a path are left out.

    Tables whose later files have more columns are read with all of them.
    """
    from gristmill.operators.ingest import where_clause

    df = spark.read.option("sep", ";").option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true").option("inferSchema", "false").csv(path)
    if where:
        df = df.where(F.expr(where_clause(where, [c for c in numeric if c in df.columns])))
    return df.where(F.trim(F.coalesce(F.col("FilePath"), F.lit(""))) != "") if "FilePath" in df.columns else df


def coerced(df: DataFrame, column: str) -> DataFrame:
    """A column of text as a whole number, else a number, else the text: three columns of which one is set."""
    c = F.trim(F.col(column))
    whole = F.expr(f"try_cast(trim(`{column}`) as bigint)")
    number = F.expr(f"try_cast(trim(`{column}`) as double)")
    return df.withColumn(f"{column}_int", F.when(c.rlike(r"^[+-]?\d+$"), whole)).withColumn(f"{column}_float", F.when(~c.rlike(r"^[+-]?\d+$"), number)).withColumn(f"{column}_text", F.when(whole.isNull() & number.isNull(), F.col(column)))


def append_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both with the columns of both; what one lacks is null."""
    return old.unionByName(new, allowMissingColumns=True)
