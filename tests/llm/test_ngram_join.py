import random

import pytest
from pyspark.sql import functions as F

from lexmill.llm import ngram_join
from lexmill.llm.ngram_join import ngram_jaccard_join

from .brute import components

SCHEMA = "doc_id long, text string, key string, N int, pivot string"


def found(spark, rows, **options):
    out, edges = ngram_jaccard_join(spark.createDataFrame([(i, t, "k", 1, "p") for i, t in rows], SCHEMA), **options)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
    assert edges.columns == ["a", "b"]
    return got


def test_matches_all_pairs_on_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, rows) == components(rows)


@pytest.mark.parametrize("combo_size,block_tokens", [(250, 400_000), (20, 300), (60, 500)])
def test_large_groups_in_several_blocks(spark, monkeypatch, combo_size, block_tokens):
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    rng = random.Random(combo_size)
    rows = []
    for g in range(3):
        base = [f"w{rng.randrange(4000)}" for _ in range(60 + 20 * g)]
        for _ in range(45):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(t)))
    shared = [f"s{i}" for i in range(50)]
    rows += [(1000 + i, " ".join(shared + [f"u{rng.randrange(10**6)}" for _ in range(30)])) for i in range(60)]
    assert found(spark, rows, combo_size=combo_size, block_tokens=block_tokens) == components(rows)


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "Only four words here"), (5, "only FOUR words  here"), (6, "one"), (7, "one one one one one one"), (8, "É é"), (9, "é é"), (10, long), (11, long + " tail"), (12, "one")]
    assert found(spark, rows) == components(rows)


def test_empty_table_and_null_ids(spark):
    assert found(spark, []) == {}
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    out, _ = ngram_jaccard_join(df)
    assert sorted(map(tuple, out.collect()), key=str) == [(3, 2, 3), (3, 2, 3), (None, 2, None)]
    assert out.where(F.col("component_id").isNull()).count() == 1
