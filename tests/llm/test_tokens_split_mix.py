import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.llm import mixing, splitting, tokens


@pytest.fixture(scope="module")
def reference(vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    c = tokens.counter(vocabulary)
    return c, tiktoken.Encoding("t", pat_str=tokens.SPLIT, mergeable_ranks=c.ranks, special_tokens={})


def test_counts_are_exact(reference):
    c, enc = reference

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t 'aetsrllve019.,-_é")), max_size=60))
    def same(text):
        assert c.count(text) == len(enc.encode_ordinary(text))

    same()
    for t in ["", "a   b\n\n c\t", "x" * 3000, "日本語😀", "don't we'll I'M", "　\x1ca\x85b", "ab" * 2000 + "\n" * 50]:
        assert c.count(t) == len(enc.encode_ordinary(t))
    assert c.count(None) == 0


def test_budget_cube(spark, reference):
    c, _ = reference
    files = spark.createDataFrame(
        [(1, "local", "DE", "/srv/corpus/Fauna/2020/a.md", "x"), (2, "web", "", "https://h/fauna/b", "y"), (3, "local", "de_DE", "/srv/corpus/fauna/c", "z"), (3, "local", "de_DE", "/srv/corpus/fauna/c", "z")],
        "file_id bigint, source string, meta_language string, file_path string, tokens string",
    )
    blocks = spark.createDataFrame([(1, "Hallo Welt"), (1, None), (2, "hello there world"), (9, "orphan")], "file_id bigint, text string")
    rows = {(r["source"], r["language"], r["domain"]): (r["files"], r["blocks"], r["tokens"]) for r in tokens.token_budget(files, blocks).collect()}
    n = c.count
    assert rows["local", "de", "fauna"] == (2, 2, n("Hallo Welt"))
    assert rows["web", "und", "fauna"] == (1, 1, n("hello there world"))
    assert rows["none", "und", "none"] == (1, 1, n("orphan"))
    assert rows["*", "*", "*"] == (4, 4, n("Hallo Welt") + n("hello there world") + n("orphan"))
    assert tokens.token_budget(files.limit(0), blocks.limit(0)).where("level <> 'all'").count() == 0


def _texts():
    r = random.Random(4)
    for _ in range(25):
        parts = []
        for _ in range(r.randint(1, 12)):
            parts.append(" ".join(r.choice(["alpha", "beta,", "gamma.", "delta!", "Übung", "x" * r.randint(1, 30)]) for _ in range(r.randint(1, 60))))
        yield r.choice(["\n\n", "\n", " ", "\n# Head\n"]).join(parts)
    yield "y" * 5000
    yield "z" * 900 + " end. " + "日" * 400


def _brute(strength, lo, hi):
    best = max(strength[lo : hi + 1])
    return max(i for i in range(lo, hi + 1) if strength[i] == best)


@pytest.mark.parametrize("limit,overlap", [(20, 0), (50, 10), (64, 16), (7, 100)])
def test_pieces_cover_and_keep_the_limit(reference, limit, overlap):
    c, _ = reference
    s = splitting.Splitter(c)
    for t in _texts():
        p = s.split(t, limit, overlap)
        assert p[0][0] == 0 and p[-1][1] == len(t)
        assert all(c.count(t[a:b]) == n and (n <= limit or b - a == 1) for a, b, n in p)
        assert all(x[1] >= y[0] and y[1] > x[1] and y[0] > x[0] for x, y in zip(p, p[1:]))
        if overlap == 0:
            assert "".join(t[a:b] for a, b, _ in p) == t


def test_cuts_are_the_strongest_boundary_of_the_window(reference):
    c, _ = reference
    s = splitting.Splitter(c)
    r = random.Random(8)
    text = " ".join(r.choice(["one", "two,", "three.", "four\n\nfive", "six"]) for _ in range(600))
    units = splitting.UNIT.findall(text)
    codes = s.codes(units)
    strength = [0] + [max(int(codes[i]) >> 4 & 15, int(codes[i - 1]) & 15) for i in range(1, len(units))] + [0]
    cum, at = [0], [0]
    for u, k in zip(units, codes.tolist()):
        cum.append(cum[-1] + (k >> 8))
        at.append(at[-1] + len(u))
    i = 0
    for a, b, n in s.split(text, 100, 0)[:-1]:
        hi = max(k for k in range(len(cum)) if cum[k] <= cum[i] + 100)
        lo = min(k for k in range(len(cum)) if cum[k] >= cum[i] + 50)
        j = _brute(strength, lo, hi)
        assert (a, b, n) == (at[i], at[j], cum[j] - cum[i])
        i = j


def test_split_documents_edges(spark, reference):
    docs = spark.createDataFrame([(1, "s", "word " * 200, "x"), (2, "s", "", "x"), (3, "s", None, "x"), (4, "other", "word " * 200, "x"), (5, None, "short", "x"), (1, "s", "word " * 200, "x")], "doc_id bigint, source string, text string, max_tokens string")
    lim = spark.createDataFrame([("s", 50, 5), ("n", None, None)], "source string, max_tokens int, overlap_tokens int")
    out = splitting.split_documents(docs, lim).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
        assert r["tokens"] <= 50 or r["doc_id"] in (4, 5)
    assert set(by) == {1, 4, 5} and len(by[4]) == 1 and len(by[1]) == 2 * max(r["pieces"] for r in by[1])
    assert splitting.split_documents(docs.limit(0), lim).count() == 0 and splitting.split_documents(docs, lim.limit(0)).count() == 4


def test_flight_keeps_both_sums():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 50, 400):
        p, t = [r.random() for _ in range(n)], [float(r.randint(0, 500)) for _ in range(n)]
        q = mixing.fly(p, t, 9)
        assert sum(0 < x < 1 for x in q) <= 2
        assert sum(q) == pytest.approx(sum(p)) and sum(a * b for a, b in zip(q, t)) == pytest.approx(sum(a * b for a, b in zip(p, t)))
    same = mixing.fly([0.5] * 10, [7.0] * 10, 3)
    assert sum(same) == pytest.approx(5)


def test_inclusion_is_fair():
    r = random.Random(2)
    t = [float(r.randint(1, 300)) for _ in range(20)]
    hits = [0.0] * 20
    for k in range(1, 1500):
        for i, x in enumerate(mixing.fly([0.3] * 20, t, k * 7919)):
            hits[i] += x
    assert all(abs(h / 1499 - 0.3) < 0.06 for h in hits)


def test_mix_shares_caps_and_edges(spark, reference):
    r = random.Random(5)
    rows = [(i, r.choice(["big", "big", "big", "mid"]), "tok " * r.randint(1, 80)) for i in range(400)] + [(500 + i, "small", "tok " * 20) for i in range(10)]
    rows += [(900, "unknown", "x y"), (901, None, "x y"), (902, "big", None), (903, "big", ""), (904, "zero", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("tokens", F.lit("clash"))
    src = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("empty", 0.0, 2), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    for block in (50_000, 40):
        rep, shares = mixing.mix(docs, src, block=block)
        got = rep.collect()
        cap = {"big": 1, "mid": 2, "small": 3}
        assert len(got) == len(rows) and all(0 <= x["repeats"] <= cap.get(x["source"], 0) for x in got)
        share = {x["source"]: x for x in shares.collect()}
        assert share["empty"]["used_tokens"] == 0 and all(abs(share[s]["actual_share"] - w) < 0.005 for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.2)))
    again = {x["doc_id"]: x["repeats"] for x in mixing.mix(docs, src)[0].collect()}
    assert again == {x["doc_id"]: x["repeats"] for x in mixing.mix(docs, src)[0].collect()}
    assert mixing.mix(docs.limit(0), src)[0].count() == 0 and all(x["used_tokens"] == 0 for x in mixing.mix(docs.limit(0), src)[1].collect())


@pytest.mark.parametrize("limit,overlap", [(100, 60), (100, 90), (40, 39)])
def test_large_overlaps_are_kept(reference, limit, overlap):
    c, _ = reference
    t = " ".join(["one two three four five six seven, eight nine ten."] * 60)
    p = splitting.Splitter(c).split(t, limit, overlap)
    shared = [c.count(t[y[0] : x[1]]) for x, y in zip(p, p[1:])]
    assert all(n <= limit for _, _, n in p) and p[-1][1] == len(t)
    assert all(x[1] > y[0] and y[0] > x[0] and y[1] > x[1] for x, y in zip(p, p[1:]))
    slack = min(overlap / 4, (limit - overlap) / 8)
    assert all(abs(n - overlap) <= slack + 4 for n in shared)


def test_landing_finds_the_best_swap_and_takes_little_memory():
    import tracemalloc

    r = random.Random(6)
    for n in (6, 30):
        t = [float(r.randint(1, 40)) for _ in range(n)]
        p = [float(r.random() < 0.5) for _ in range(n)]
        due = sum(t) / 2 + 0.3
        got = mixing.land(p, t, due)
        assert sum(got) == sum(p)
        swaps = [abs(due - sum(x * y for x, y in zip(got, t)) - (t[j] - t[i])) for i in range(n) for j in range(n) if got[i] == 1 and got[j] == 0]
        off = abs(due - sum(x * y for x, y in zip(got, t)))
        assert off < 0.5 or not swaps or min(swaps) >= off - 1e-6  # no swap would come nearer
    t = [float(r.randint(1, 5000)) for _ in range(20_000)]
    p = [float(i % 2) for i in range(20_000)]
    tracemalloc.start()
    mixing.land(p, t, sum(t) / 2 + 777.0)
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
