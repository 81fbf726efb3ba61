import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gristmill.operators import fusion as R
from gristmill.operators import retrieval as V


def test_bm25_against_formula(spark):
    texts = {"c1": "red fish red", "c2": "blue fish", "c3": "", "c4": "red bird sings", "c5": "green"}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
    q = spark.createDataFrame([(1, "red red fish"), (2, "nothing"), (3, None)], "query_id bigint, text string")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in V.Bm25Index(chunks).query(q, 10).collect()}
    toks = {k: v.split() for k, v in texts.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(t for v in toks.values() for t in set(v))
    want = {}
    for c, v in toks.items():
        s = 0.0
        for t in "red red fish".split():
            tf = v.count(t)
            if tf:
                s += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(v) / avg))
        if s > 0:
            want[1, c] = s
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_vector_scores_exact_with_ties(spark):
    r = random.Random(3)
    vec = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(100, [0.0] * 8), (101, [1.0] + [0.0] * 7), (102, [2.0] + [0.0] * 7)]
    v = spark.createDataFrame(vec, "chunk_id bigint, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0] + [0.0] * 7)], "query_id bigint, embedding array<float>")
    got = [(x["chunk_id"], x["hit_rank"]) for x in V.vector_scores(q, v, 5).orderBy("hit_rank").collect()]
    assert [c for c, _ in got[:2]] == [101, 102] and len(got) == 5


def _walk(edges, chunk_entities, seeds, hops):
    dist, front = {s: 0 for s in seeds}, list(seeds)
    weight = Counter()
    for d in range(1, hops + 1):
        nxt = []
        for u in front:
            for v, w in edges[u].items():
                weight[v] += w
                if v not in dist:
                    dist[v] = d
                    nxt.append(v)
        front = nxt
    scores = {}
    for c, es in chunk_entities.items():
        hit = [e for e in es if e in dist]
        if hit:
            scores[c] = float(sum(weight[e] for e in hit))
    return scores


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_graph_against_walk(spark, seed):
    r = random.Random(seed)
    ce = {f"c{i}": r.sample("abcdefgh", r.randint(1, 3)) for i in range(12)}
    rows = spark.createDataFrame([(c, e) for c, es in ce.items() for e in es], "chunk_id string, entity string")
    edges = defaultdict(Counter)
    for es in ce.values():
        for a in es:
            for b in es:
                if a != b:
                    edges[a][b] += 1
    seeds = spark.createDataFrame([(1, "a"), (1, "b"), (2, "zz")], "query_id bigint, entity string")
    got = {x["chunk_id"]: x["score"] for x in V.graph_scores(seeds, V.entity_edges(rows), rows, 2).collect()}
    known = [s for s in "ab" if any(s in es for es in ce.values())]
    assert got == _walk(edges, ce, known, 2)


def test_verb_noun(spark):
    q = spark.createDataFrame([(1, ["build"], ["hive"]), (2, ["fly"], ["xx"])], "query_id bigint, verbs array<string>, nouns array<string>")
    c = spark.createDataFrame([("a", ["build"], ["hive"]), ("b", ["build"], []), ("c", [], ["hive"]), ("d", ["fly"], [])], "chunk_id string, verbs array<string>, nouns array<string>")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in V.verb_noun_scores(q, c, 10).collect()}
    assert got == {(1, "a"): pytest.approx(3.25), (2, "d"): pytest.approx(1.2)}


def test_rrf_and_order_of_sources(spark):
    rows = [(1, "vector", "final", 1, "x"), (1, "bm25", "final", 2, "x"), (1, "bm25", "final", 1, "y"), (1, "graph", "seed", 3, "x")]
    h = spark.createDataFrame(rows, "query_id bigint, retriever string, leg string, hit_rank int, chunk_id string")
    got = {r["chunk_id"]: (r["rrf_score"], r["sources"]) for r in R.reciprocal_rank(h).collect()}
    assert got["x"] == (pytest.approx(1 / 61 + 1 / 62 + 1 / 63), "vector,bm25,graph") and got["y"][0] == pytest.approx(1 / 61)


def test_threshold_boost_and_fallback(spark):
    cols = "query_id bigint, chunk_id string, file_path string, source string, raw double, retrieval_score double"
    # 'a' is alone in its file and passes by the boost; 'w' is a web row without one
    df = spark.createDataFrame([(1, "a", "f1", "local", -0.1, 0.3), (1, "b", "f2", "local", 0.5, 0.2), (1, "c", "f2", "local", -0.1, 0.1), (1, "w", "f3", "web", -0.1, 0.9)], cols)
    assert {r["chunk_id"] for r in R.above_threshold(df, 0.5).collect()} == {"a", "b"}
    low = spark.createDataFrame([(1, "a", "f1", "local", -2.0, 0.3), (1, "w", "f3", "web", 3.0, 0.9)], cols)
    assert {r["chunk_id"]: r["kept_score"] for r in R.above_threshold(low, 0.5).collect()} == {"a": 0.3, "w": 0.9}
    assert {r["chunk_id"] for r in R.above_threshold(low, 0.5, fallback=False).collect()} == {"w"}


def _greedy(texts, scores, t):
    kept = []
    for c in sorted(texts, key=lambda c: (-scores[c], c)):
        a = set(texts[c].lower().split())
        if not any(a and len(a & set(texts[k].lower().split())) / len(a | set(texts[k].lower().split())) >= t for k in kept):
            kept.append(c)
    return set(kept)


@pytest.mark.parametrize("seed", [1, 2])
def test_drop_duplicates_is_greedy(spark, seed):
    r = random.Random(seed)
    base = [" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + str(i) for i in range(12)) for _ in range(6)]
    texts, scores = {}, {}
    for i in range(30):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = "q" + str(r.randint(0, 3))
        texts[f"c{i:02}"], scores[f"c{i:02}"] = " ".join(w), r.random()
    pool = spark.createDataFrame([(1, c, texts[c], scores[c]) for c in texts] + [(2, "n", None, 0.1)], "query_id bigint, chunk_id string, text string, rrf_score double")
    got = {x["chunk_id"] for x in R.drop_duplicates(pool, threshold=0.7).where("query_id = 1").collect()}
    assert got == _greedy(texts, scores, 0.7)


def test_drop_duplicates_follows_long_chains(spark):
    texts = {f"c{i:02}": " ".join(f"w{k}" for k in range(i, i + 12)) for i in range(27)}
    scores = {c: -float(i) for i, c in enumerate(texts)}
    pool = spark.createDataFrame([(1, c, texts[c], scores[c]) for c in texts], "query_id bigint, chunk_id string, text string, rrf_score double")
    got = {x["chunk_id"] for x in R.drop_duplicates(pool, threshold=0.8).collect()}
    assert got == _greedy(texts, scores, 0.8) == {f"c{i:02}" for i in range(0, 27, 2)}


def test_drop_duplicates_query_takes_whole_pools(spark, data, tmp_path):
    import __spark_entry__ as entry

    n = 60
    hit, chunk = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("hits", "chunks"))
    h, c = hit.where("run_at is not null and score is not null and leg = 'final'").first().asDict(), chunk.first().asDict()
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(10))
    spark.createDataFrame([h | {"retriever": "vector", "hit_rank": i, "chunk_id": f"c{i}", "score": 1.0 / i} for i in range(1, n + 1)], hit.schema).write.parquet(f"{tmp_path}/hits.parquet")
    spark.createDataFrame([c | {"chunk_id": f"c{i}", "text": text(5 if i == n else i)} for i in range(1, n + 1)], chunk.schema).write.parquet(f"{tmp_path}/chunks.parquet")
    got = [r["chunk_id"] for r in entry.queries()["fuse_drop_duplicates"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(f"c{i}" for i in range(1, n))


def test_interleave_and_caps(spark):
    rows = [(1, "en", "e1", 0.9), (1, "en", "e2", 0.8), (1, "de", "d1", 0.7), (1, "fr", "f1", 0.95)]
    df = spark.createDataFrame(rows, "query_id bigint, language string, chunk_id string, rrf_score double")
    assert [r["chunk_id"] for r in R.interleave(df, 4).orderBy("position").collect()] == ["f1", "e1", "d1", "e2"]
    pool = spark.createDataFrame([(1, "a", "f1", 0.9), (1, "b", "f1", 0.8), (1, "c", "f1", 0.7), (1, "d", "f2", 0.95)], "query_id bigint, chunk_id string, file_path string, kept_score double")
    assert [r["chunk_id"] for r in R.capped_by_file(pool, 2, 3).orderBy("position").collect()] == ["a", "b", "d"]
    assert {r["chunk_id"] for r in R.single_document(pool).collect()} == {"a", "b", "c"}


def test_min_max_of_equal_scores(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0)], "query_id bigint, chunk_id string, raw double")
    assert [r["scaled"] for r in R.min_max(df).collect()] == [0.0, 0.0]


def test_plans_limit_groups_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, "a", 1.0)], "query_id bigint, chunk_id string, score double")
    plan = V.top_k(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert F is not None
