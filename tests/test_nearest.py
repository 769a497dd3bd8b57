"""Block-wise search against plain loops."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from lexmill.operators import nearest, retrieval


def half_up(x):
    return float(Decimal(repr(float(x))).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def cosine(a, b):
    if None in a or None in b:
        return 0.0
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    norm = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
    return half_up(dot(a, b) / norm) if norm > 0 else 0.0


def plain(vectors, queries, k, score):
    out = {}
    for q, a in queries:
        every = sorted((-s, i) for i, b in vectors for s in [score(a, b)] if s is not None)
        out.update({(q, i): (n + 1, -s) for n, (s, i) in enumerate(every[:k])})
    return out


def told(df):
    return {(r.query_id, r.id): (r["rank"], r.score) for r in df.collect()}


def test_rounds_as_spark_does():
    x = np.array([0.1234565, 0.1234575, -0.1234565, 0.0000005, 1.0, -0.0, 0.12345649999999999])
    assert nearest.rounded(x).tolist() == [half_up(v) for v in x]


@pytest.fixture
def small_blocks(monkeypatch):
    for name, rows in (("QUERIES", 7), ("VECTORS", 50), ("TEXTS", 20), ("_TILE", 64)):
        monkeypatch.setattr(nearest, name, rows)


def test_dense_search_in_blocks(spark, small_blocks):
    rng = random.Random(1)
    vectors = [(i, [float(rng.randint(-3, 3)) for _ in range(3)]) for i in range(200)] + [(300 + i, [1.0, 1.0, 1.0]) for i in range(60)]
    vectors += [(400, [0.0] * 3), (401, [1.0, None, 2.0]), (402, []), (403, [1.0, 2.0])]
    df = spark.createDataFrame([*vectors, (500, None)], "vec_id long, v array<double>")
    queries = [(q, v) for q, v in vectors if q % 5 == 0 or q > 399]
    got = told(retrieval.dense_topk(df, df.where("vec_id % 5 = 0 or vec_id > 399"), 6, "vec_id", "v", "vec_id", "v"))
    assert got == plain(vectors, queries, 6, lambda a, b: cosine(a, b) if len(a) == len(b) else None)


def test_plan_does_not_grow_with_the_queries(spark):
    # former version: one join, and one scan of all vectors, for each 512 queries
    df = spark.range(1500).selectExpr("id", "array(id * 1.0D, 1.0D) v")
    plan = retrieval.dense_topk(df, df, 2, "id", "v", "id", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range") == 2 and "Join" not in plan


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    some = spark.createDataFrame([(1, [1.0])], "id long, v array<double>")
    assert retrieval.dense_topk(none, some, 3, "id", "v", "id", "v").count() == 0
    assert retrieval.dense_topk(some, none, 3, "id", "v", "id", "v").count() == 0


def test_words_in_blocks(spark, small_blocks):
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "b", "cc", "d1", "é"] + [f"w{i}" for i in range(40)])
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(90)] + [(200 + i, "a b b") for i in range(40)] + [(300, None), (301, "")]
    asked = [(q, " ".join(word() for _ in range(rng.randint(0, 8)))) for q in range(20)] + [(50, "b a a"), (51, None), (52, "none of these")]
    corpus, queries = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asked, "q long, t string")
    for best, scores in ((retrieval.bm25_topk, retrieval.bm25_scores), (retrieval.overlap_topk, retrieval.overlap_scores)):
        every = {}
        for r in scores(corpus, queries, "id", "text", "q", "t").collect():
            every.setdefault(r.query_id, []).append((-round(r.score, 6), r.id))
        want = {(q, i): (n + 1, -s) for q, held in every.items() for n, (s, i) in enumerate(sorted(held)[:5])}
        got = told(best(corpus, queries, 5, "id", "text", "q", "t"))
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=2e-6) for x in got) and len(got) > 80


@pytest.mark.parametrize("name", ["bm25_topk", "wiki_lexical", "rrf_fusion", "retrieval_metrics", "hybrid_search"])
def test_no_row_a_text_and_query(spark, sf, name):
    # former version: postings joined with the queries' terms, a row for each text, query and shared term
    from lexmill import registry

    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "tf#" not in plan


def test_run_hashes_tell_runs_apart(spark):
    from pyspark.sql import functions as F

    from lexmill.functions import text as T

    rows = [("a b c d",), ("b c d",), ("ab c d",), ("a b",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string").select("t", T.run_hashes(3)(F.split("t", " ")).alias("h"))
    got = {r.t: r.h for r in df.coalesce(1).collect()}
    assert [len(got[t] or []) for (t,) in rows] == [2, 1, 1, 0, 0, 0]
    assert got["a b c d"][1] == got["b c d"][0] != got["ab c d"][0] and got["a b c d"][0] != got["ab c d"][0]
