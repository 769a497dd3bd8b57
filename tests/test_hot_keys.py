"""Keys that many rows share: the former versions made a row a pair, 10**10 of them here, and did not end."""

import random
import re

from pyspark.sql import functions as F

from lexmill.operators import evidence, workflow

MANY = 100_000


def test_entities_of_one_alias(spark):
    rows = spark.range(MANY)
    entities = rows.select(F.col("id").alias("entity_id"), F.concat(F.lit("name "), "id").alias("name_key"), F.array(F.lit("brand"), F.concat(F.lit("own "), "id")).alias("alias_keys"))
    key = F.when(F.col("id") % 4 == 0, "brand").when(F.col("id") % 4 == 1, F.concat(F.lit("name "), "id")).when(F.col("id") % 4 == 2, F.concat(F.lit("own "), "id"))
    told = evidence.resolve_entities(rows.select(F.col("id").alias("proposal_id"), key.alias("name_key")), entities)
    assert {(r.decision, r.k, r["count"]) for r in told.groupBy("decision", (F.col("entity_id") == F.col("proposal_id")).alias("k")).count().collect()} == {("ambiguous", None, MANY // 4), ("exact", True, MANY // 4), ("alias", True, MANY // 4), ("new", None, MANY // 4)}


def test_entities_told_apart_over_keys_and_nulls(spark):
    entities = spark.createDataFrame([(1, "a", ["x", "x"]), (1, "a", []), (2, "b", ["x", "a"]), (None, "c", None), (3, "c", [])], "entity_id long, name_key string, alias_keys array<string>")
    proposals = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c"), (4, "b"), (4, "a"), (5, None)], "proposal_id long, name_key string")
    got = sorted((r.proposal_id, r.entity_id, r.decision) for r in evidence.resolve_entities(proposals, entities).distinct().collect())
    assert got == [(1, 1, "exact"), (2, None, "ambiguous"), (3, 3, "exact"), (4, None, "ambiguous"), (5, None, "new")]


def test_topics_of_one_title_and_one_frequent_word(spark):
    made = spark.range(MANY).select(F.lit("w").alias("workspace_id"), "id", F.when(F.col("id") % 2 == 0, "Hot bolt").otherwise(F.concat(F.lit("bolt part"), F.col("id").cast("string"))).alias("title"))
    titles = made.withColumnRenamed("id", "title_id").withColumn("title", F.upper("title"))
    got = workflow.best_topic_match(made.withColumnRenamed("id", "entry_id"), titles)
    assert got.where("score = 1 and entry_id = if(title_id % 2 = 0, 0, title_id)").count() == got.count() == MANY


def test_topics_equal_all_pairs(spark):
    rng = random.Random(4)
    made = lambda n: [(rng.choice("uv"), i, " ".join(rng.choice(["a", "B", "cc", "d", "e", "é", "f"]) for _ in range(rng.randint(0, 7)))) for i in range(n)]
    entries, titles = [*made(120), (None, 900, "a b")], [*made(120), (None, 901, "a b"), ("u", 902, None)]
    words = lambda t: set(re.findall(r"\w+", t.lower()))
    want = {}
    for w, i, t in titles:
        pairs = [(-1.0 if t.strip().lower() == u.strip().lower() else -len(words(t) & words(u)) / len(words(t) | words(u)), j) for v, j, u in entries if t and w and v == w and words(t) & words(u)]
        if pairs and min(pairs)[0] <= -0.6:
            want[i] = (min(pairs)[1], round(-min(pairs)[0], 9))
    e, t = spark.createDataFrame(entries, "workspace_id string, entry_id long, title string"), spark.createDataFrame(titles, "workspace_id string, title_id long, title string")
    assert {r.title_id: (r.entry_id, round(r.score, 9)) for r in workflow.best_topic_match(e, t).collect()} == want
