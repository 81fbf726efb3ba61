"""Cutting documents into chunks: packers whose state runs along a text, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words per chunk and overlaps.
RECURSIVE, RECURSIVE_OVERLAP = 256, 32
WINDOW, SLIDING, SLIDING_OVERLAP, HEADING, PDF, TABLE = 256, 256, 3, 256, 200, 512
_SENTENCE = re.compile(r"(?<=\w{2}[.!?])\s+|(?:^|\n)\s*[•\-\*●◦▪]\s+|\n{2,}|\n(?=[A-Z])")


def sentences(text: str) -> list[str]:
    return [s.strip() for s in _SENTENCE.split(text or "") if s.strip()]


def count(s: str) -> int:
    return len(s.split())


def pack(parts: list[str], limit: int) -> list[str]:
    """Parts in order, joined while they stay within the limit of words; a longer part stands alone."""
    out: list[str] = []
    have, n = [], 0
    for p in parts:
        k = count(p)
        if have and n + k > limit:
            out.append(" ".join(have))
            have, n = [], 0
        have.append(p)
        n += k
    return out + ([" ".join(have)] if have else [])


def sentence_windows(text: str, limit: int = WINDOW) -> list[str]:
    return pack(sentences(text), limit)


def sliding(text: str, limit: int = SLIDING, overlap: int = SLIDING_OVERLAP) -> list[str]:
    """Windows of sentences within the limit that step on by all but ``overlap`` of them.

    Windows go on to be made until their start passes the end, so the tail comes in shrinking windows.
    """
    parts = sentences(text)
    out, i = [], 0
    while i < len(parts):
        n = j = 0
        while i + j < len(parts) and (j == 0 or n + count(parts[i + j]) <= limit):
            n += count(parts[i + j])
            j += 1
        out.append(" ".join(parts[i : i + j]))
        i += max(1, j - overlap)
    return out


def recursive(text: str, limit: int = RECURSIVE, overlap: int = RECURSIVE_OVERLAP, separators: tuple[str, ...] = ("\n", " ", ".")) -> list[str]:
    """Split at the first separator that is there, pieces still too long at the next; pieces packed with an overlap of words."""
    if count(text) <= limit:
        return [text.strip()] if text.strip() else []
    sep = next((s for s in separators if s in text), None)
    if sep is None:
        w = text.split()
        return [" ".join(w[i : i + limit]) for i in range(0, len(w), limit)]
    small: list[str] = []
    rest = separators[separators.index(sep) + 1 :]
    for p in text.split(sep):
        small += recursive(p, limit, overlap, rest) if count(p) > limit else [p.strip()] if p.strip() else []
    out: list[str] = []
    have: list[str] = []
    for p in small:
        if have and sum(map(count, have)) + count(p) > limit:
            out.append(" ".join(have))
            while have and (sum(map(count, have)) > overlap or sum(map(count, have)) + count(p) > limit):
                have.pop(0)
        have.append(p)
    return out + ([" ".join(have)] if have else [])


def headings(text: str, limit: int = HEADING, mode: str = "suffix") -> list[str]:
    """Sections under their heading trail; a heading clears those deeper than it. Long sections are split."""
    trail: dict[int, str] = {}
    sections: list[tuple[str, list[str]]] = [("", [])]
    for line in (text or "").splitlines():
        m = re.match(r"(#{1,6})\s+(.*\S)", line)
        if m:
            level = len(m[1])
            trail = {k: v for k, v in trail.items() if k < level} | {level: m[2]}
            sections.append((" > ".join(trail[k] for k in sorted(trail)), []))
        else:
            sections[-1][1].append(line)
    out = []
    for path, lines in sections:
        body = "\n".join(lines).strip()
        if not body:
            continue
        mark = f"[section: {path}]" if path and mode != "off" else ""
        for piece in recursive(body, max(50, limit - count(mark)), 0) if count(body) > limit else [body]:
            out.append(f"{mark}\n{piece}" if mark and mode == "prefix" else f"{piece}\n{mark}" if mark else piece)
    return out


def pages(parts: list[tuple[str, str]], limit: int = PDF) -> list[str]:
    """A chunk per page with its label and first line as title; split if over the limit."""
    out = []
    for label, text in parts:
        body = (text or "").strip()
        if not body:
            continue
        title = body.splitlines()[0].strip()[:80]
        for piece in recursive(body, limit, 0) if count(body) > limit else [body]:
            out.append(f"Page {label}: {title}\n{piece}")
    return out


def table_rows(rows: list[list[str]] | None, header_rows: int = 0, limit: int = TABLE, caption: str = "") -> list[str]:
    """Rows as lines under the token limit, the header repeated in each chunk; a row over the limit is cut by columns."""
    if not rows:
        return []
    line = lambda r: " | ".join((c or "").strip() for c in r)
    cost = lambda s: int(count(s) * 1.3)
    head = [line(r) for r in rows[: header_rows or 0]]
    base = sum(map(cost, head)) + cost(caption)
    out, have, n = [], [], base

    def put():
        if have:
            out.append("\n".join(([caption] if caption else []) + head + have))

    for r in rows[header_rows or 0 :]:
        s = line(r)
        if have and n + cost(s) > limit:
            put()
            have, n = [], base
        while base + cost(s) > limit and len(r) > 1:
            lo, hi = 1, len(r) - 1
            while lo < hi:  # the most columns that fit
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if base + cost(line(r[:mid])) <= limit else (lo, mid - 1)
            have.append(line(r[:lo]))
            put()
            have, n, r = [], base, r[lo:]
            s = "(continued) " + line(r)
        have.append(s)
        n += cost(s)
    put()
    if not out and head:
        out.append("\n".join(([caption] if caption else []) + head))
    return out


def merge_short(parts: list[str], least: int = 15) -> list[str]:
    """Neighbouring parts joined until each has at least the words asked for; a short tail joins the last."""
    out: list[str] = []
    have: list[str] = []
    for p in parts:
        have.append(p)
        if sum(map(count, have)) >= least:
            out.append(" ".join(have))
            have = []
    if have:
        if out:
            out[-1] = out[-1] + " " + " ".join(have)
        else:
            out.append(" ".join(have))
    return out


#: Which chunker a type of file goes to.
ROUTES = {"md": headings, "docx": headings, "txt": sentence_windows, "html": sentence_windows, "log": recursive, "csv": recursive, "pdf": sliding, "pptx": sentence_windows}


def route(file_type: str | None) -> Callable[[str], list[str]]:
    return ROUTES.get((file_type or "").lower().lstrip("."), recursive)


def chunked(documents: DataFrame, chunker: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(doc_id, my_chunk, text) of documents (doc_id, text, file_type); my_chunk counts from 1.

    Without a chunker each document goes to the one of its file type. Null and empty texts have no chunks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t, kind in zip(b["doc_id"], b["text"], b["file_type"]):
                if t:
                    rows += [(d, i, c) for i, c in enumerate((chunker or route(kind))(t), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "my_chunk", "text"])

    kind = F.col("file_type") if "file_type" in documents.columns else F.lit("")
    return documents.select(F.col("doc_id").cast("bigint"), "text", kind.alias("file_type")).mapInPandas(run, "doc_id bigint, my_chunk int, text string")
