"""Drawing records from sources to target shares of the total tokens.

With R(s) the tokens of source s and w(s) its wanted share, the total is the largest that every
source can fill: the least of max_repeats(s) * R(s) / w(s) over the sources, or a smaller total
if one is given. A record of s is then used r(s) = w(s) * total / R(s) times: floor(r) times
for certain, and once more with the fractional probability that is left.

Which records get the extra use is drawn by the cube method. The vector of inclusion
probabilities moves through the null space of the balancing constraints (the number of records
and their tokens, both in every source), each step until a probability reaches 0 or 1. Within a
source the probabilities are equal, so with three undecided records of t1, t2, t3 tokens the
null space is spanned by (t3 - t2, t1 - t3, t2 - t1). The flight runs in parallel over hashed
blocks of each source and leaves at most two undecided records in a block. Those of all blocks
of a source, and a fixed small number held back from its first block, fly once more; the last
two land on the outcome nearest to balance, and swaps within this small pool even out the rest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.tokens import VOCABULARY, with_tokens
from gristmill.session import durable

#: Records of a block of one source.
BLOCK = 50_000
#: Records of a source's first block that wait for the last flight, so that the landing has some to choose from.
HELD = 128
_CERTAIN = 1e-9


def _draw(state: int) -> tuple[int, float]:
    """A step of a small generator (64-bit xorshift with multiplication) and its number from 0 to 1."""
    state ^= state >> 12
    state ^= (state << 25) & 0xFFFFFFFFFFFFFFFF
    state ^= state >> 27
    return state, ((state * 2685821657736338717) >> 11 & ((1 << 53) - 1)) / (1 << 53)


def fly(p: list[float], tokens: list[float], seed: int) -> list[float]:
    """The flight phase: at most two of the probabilities stay between 0 and 1.

    The sum of p and the sum of p * tokens are those of the start.
    """
    p, state = list(p), seed or 1
    open_: list[int] = []
    for nxt in range(len(p)):
        if _CERTAIN < p[nxt] < 1 - _CERTAIN:
            open_.append(nxt)
        while len(open_) == 3:
            a, b, c = open_
            u = (tokens[c] - tokens[b], tokens[a] - tokens[c], tokens[b] - tokens[a])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            ahead = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(open_, u) if x)
            back = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(open_, u) if x)
            state, z = _draw(state)
            step = ahead if z * (ahead + back) < back else -back
            for i, x in zip(open_, u):
                p[i] += step * x
                if p[i] < _CERTAIN:
                    p[i] = 0.0
                elif p[i] > 1 - _CERTAIN:
                    p[i] = 1.0
            open_ = [i for i in open_ if 0.0 < p[i] < 1.0]
    return p


def land(p: list[float], tokens: list[float], due: float) -> list[float]:
    """Rounds the few that are left, then swaps used and unused records while that brings the tokens nearer to what is due.

    A swap keeps the number of records. Of equal outcomes the first holds.
    """
    out = np.array(p)
    t = np.array(tokens)
    open_ = np.flatnonzero((out > 0.0) & (out < 1.0))
    n = float(out[open_].sum())
    shut = np.setdiff1d(np.arange(len(out)), open_)
    rest = due - float(out[shut] @ t[shut])
    outcomes = [[k >> j & 1 for j in range(len(open_))] for k in range(1 << len(open_))]
    out[open_] = min(outcomes, key=lambda o: (round(abs(sum(o) - n), 6) >= 1, abs(float(np.dot(o, t[open_])) - rest), o))
    while True:
        off = due - float(out @ t)
        used, free = np.flatnonzero(out == 1.0), np.flatnonzero(out == 0.0)
        if abs(off) < 0.5 or not len(used) or not len(free):
            return out.tolist()
        # for each used record the free ones whose tokens lie on both sides of what would settle it
        order = free[np.argsort(t[free], kind="stable")]
        goal = t[used] + off
        above = np.searchsorted(t[order], goal, "left")
        best = None
        for at in (above - 1, above):
            ok = np.flatnonzero((at >= 0) & (at < len(order)))
            if len(ok):
                at = np.searchsorted(t[order], t[order[at[ok]]], "left")  # the first of equal ones
                left = np.abs(goal[ok] - t[order[at]])
                k = int(left.argmin())
                if best is None or (left[k], used[ok[k]], order[at[k]]) < best:
                    best = (left[k], used[ok[k]], order[at[k]])
        if best[0] >= abs(off) - 1e-9:
            return out.tolist()
        out[best[1]], out[best[2]] = 0.0, 1.0


def _flight(final: bool, seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_order", "doc_id"], kind="stable")
        t, p = [float(x) for x in rows["tokens"]], rows["p"].tolist()
        start = (seed * 0x9E3779B97F4A7C15 + len(t) * 0xD1B54A32D192ED03 + (0 if final else int(key[1])) + 7) & 0xFFFFFFFFFFFFFFFF
        if not final:
            held = HELD if key[1] == 0 else 0
            fixed = len(t) - min(held, len(t))
            rows["p"] = fly(p[:fixed], t[:fixed], start) + p[fixed:]
        else:
            flown = fly(p, t, start)
            # only records of the landing pool take part in swaps; of the others there are at most two a block
            rows["p"] = land(flown, t, sum(x * y for x, y in zip(p, t)))
        return rows

    return run


def mix(documents: DataFrame, sources: DataFrame, total: int | None = None, path: str = VOCABULARY, seed: int = 1, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(repeats, shares): how often each record is used, and wanted and actual shares per source.

    In: documents (doc_id, source, text), sources (source, target_share, max_repeats), one row
    each. repeats: doc_id, source, tokens, repeats, a row for each document, also of 0 repeats.
    shares: source, target_share, max_repeats, records, tokens, used_records, used_tokens,
    actual_share, a row for each source. Documents of an unknown or null source, and sources
    with a share or cap that is null or not above 0, are used 0 times. A source with a share
    but without tokens cannot be drawn from and is left out of the total; its actual share is
    0. Null and empty texts have 0 tokens and are used like the others of their source. Rows
    with the same doc_id are records of their own.
    """
    counted = durable(with_tokens(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text"), "text", "doc_id", "source", path=path))
    size = counted.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("tokens").alias("tokens"))
    want = sources.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    per = want.join(size, "source", "left").fillna(0, ["records", "tokens"])
    usable = (F.col("target_share") > 0) & (F.col("max_repeats") > 0) & (F.col("tokens") > 0)
    every_source = Window.partitionBy(F.lit(0))  # as many rows as the sources table has
    room = F.min(F.when(usable, F.col("max_repeats") * F.col("tokens") / F.col("target_share"))).over(every_source)
    if total is not None:
        room = F.least(room, F.lit(float(total)))
    rate = per.withColumn("_total", room).select(
        "source",
        F.when(usable, F.least(F.col("target_share") * F.col("_total") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0).alias("rate"),
        F.greatest(F.lit(1), F.ceil(F.col("records") / block)).cast("int").alias("blocks"),
    )
    due = counted.join(rate, "source", "left").select(
        "doc_id",
        "source",
        "tokens",
        F.floor(F.coalesce("rate", F.lit(0.0)) + 1e-9).cast("int").alias("base"),
        F.greatest(F.lit(0.0), F.coalesce("rate", F.lit(0.0)) - F.floor(F.coalesce("rate", F.lit(0.0)) + 1e-9)).alias("p"),
        F.xxhash64("doc_id", F.lit(seed)).alias("_order"),
        F.coalesce("blocks", F.lit(1)).alias("blocks"),
    )
    schema = "doc_id bigint, source string, tokens bigint, base int, p double, _order bigint, _block int"
    sure, drawn = due.where("p <= 1e-9"), due.where("p > 1e-9").withColumn("_block", F.pmod("_order", "blocks").cast("int")).drop("blocks")
    flown = durable(drawn.groupBy("source", "_block").applyInPandas(_flight(False, seed), schema))
    # at most two rows of each block are left, and the few held back from the first
    landed = flown.where("p > 0 and p < 1").groupBy("source").applyInPandas(_flight(True, seed), schema)
    whole = flown.where("p <= 0 or p >= 1").unionByName(landed)
    repeats = whole.select("doc_id", "source", "tokens", (F.col("base") + F.col("p").cast("int")).alias("repeats")).unionByName(
        sure.select("doc_id", "source", "tokens", F.col("base").alias("repeats"))
    )
    used = repeats.groupBy("source").agg(F.sum("repeats").alias("used_records"), F.sum(F.col("repeats") * F.col("tokens")).alias("used_tokens"))
    shares = per.join(used, "source", "left").fillna(0, ["used_records", "used_tokens"])
    every = F.sum("used_tokens").over(every_source)
    shares = shares.withColumn("_all", every).select(
        "source", "target_share", "max_repeats", "records", "tokens", "used_records", "used_tokens",
        F.when(F.col("_all") > 0, F.col("used_tokens") / F.col("_all")).otherwise(0.0).alias("actual_share"),
    )
    return repeats, shares
