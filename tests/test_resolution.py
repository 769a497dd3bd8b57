import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import resolution as R
from lexmill.operators.validation import Fix, Rule, judge, report, validate

RELATIONS = "relation_id string, source long, target long, status string"


def test_decisions_and_audit(spark):
    relations = spark.createDataFrame([("a", 1, 2, "pending"), ("b", 2, 3, "pending"), ("c", 3, 4, "rejected"), ("d", 5, 6, "pending")], RELATIONS)
    told = [("a", "reject", "x", 2), ("a", "confirm", "y", 1), ("b", "maybe", "x", 1), ("b", "ignore", "x", None), ("c", "confirm", "x", 1), ("z", "confirm", "x", 1)]
    after, audit = R.decide(relations, spark.createDataFrame(told, "relation_id string, decision string, actor string, at int"))
    assert {r.relation_id: r.status for r in after.collect()} == {"a": "confirmed", "b": "ignored", "c": "rejected", "d": "pending"}
    got = sorted((r.relation_id, r.action, r.old_status, r.new_status, r.actor) for r in audit.collect())
    assert got[:4] == [("a", "decided", "pending", "confirmed", "y"), ("a", "late", "pending", "pending", "x"), ("b", "decided", "pending", "ignored", "x"), ("b", "unknown_decision", "pending", "pending", "x")]
    assert got[4:] == [("c", "not_pending", "rejected", "rejected", "x"), ("z", "unknown_relation", None, None, "x")]


@pytest.mark.parametrize("seed", range(2))
def test_groups_equal_plain(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"r{k}", rng.randrange(60), rng.randrange(60), rng.choice(["confirmed", "confirmed", "pending"])) for k in range(45)]
    pairs += [(f"c{k}", 100 + k, 101 + k, "confirmed") for k in range(40)] + [("n", None, 1, "confirmed")]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for _, a, b, s in pairs:
        if s == "confirmed" and a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r.node: r.grp for r in R.groups(spark.createDataFrame(pairs, RELATIONS)).collect()}
    assert got == {i: root(i) for i in list(up)}
    assert R.groups(spark.createDataFrame([], RELATIONS)).count() == 0


def test_canonical_rewrite_and_states(spark):
    papers = spark.createDataFrame([(1, 5), (2, 9), (3, 9), (4, 1), (5, 1), (7, 0)], "id long, fields int")
    relations = spark.createDataFrame([("a", 1, 2, "confirmed"), ("b", 2, 3, "confirmed"), ("c", 4, 5, "pending"), ("d", 3, 99, "confirmed")], RELATIONS)
    mapping = R.canonical(papers, relations, "id", [-F.col("fields")])
    assert sorted(map(tuple, mapping.collect())) == [(1, 2), (3, 2)]
    chunks = spark.createDataFrame([("x", 1), ("x", 1), ("y", None), ("z", 2), ("w", 3)], "chunk string, paper long")
    led, audit = R.rewrite(chunks, "chunks", "chunk", "paper", mapping)
    assert sorted(map(tuple, led.collect()), key=str) == [("w", 2), ("x", 2), ("x", 2), ("y", None), ("z", 2)] and led.columns == chunks.columns
    assert sorted((r.row_key, r.old_value, r.new_value) for r in audit.collect()) == [("w", "3", "2"), ("x", "1", "2"), ("x", "1", "2")]
    states = {r.id: (r.state, r.canonical) for r in R.record_states(papers, relations, mapping, "id").collect()}
    assert states == {1: ("merged", 2), 2: ("active", 2), 3: ("merged", 2), 4: ("duplicate_pending", 4), 5: ("duplicate_pending", 5), 7: ("active", 7)}


def rules():
    return [Rule("one", "low", "error", F.col("x") < 0), Rule("one", "odd", "warning", F.col("x") % 2 == 1), Rule("two", "big", "error", F.col("x") > 10)]


def test_stages_cut_short_and_nulls_pass(spark):
    rows = spark.createDataFrame([(-3,), (3,), (12,), (13,), (None,)], "x int")
    got = {r.x: ([i.issue for i in r["issues"]], r.stage) for r in judge(rows, rules()).collect()}
    assert got == {-3: (["low"], "one"), 3: (["odd"], "two"), 12: (["big"], "two"), 13: (["odd", "big"], "two"), None: ([], "two")}


def test_recheck_is_bounded_and_ends(spark):
    rows = spark.createDataFrame([(k,) for k in (11, 12, 19, -1, 2)], "x int")
    fixes = [Fix("big", F.col("x") != 19, {"x": F.col("x") - 1}), Fix("low", F.lit(True), {"x": F.col("x")})]
    got = {(r.x, r.rounds, tuple(r.mended), tuple(i.issue for i in r["issues"])) for r in validate(rows, rules(), fixes, rounds=5).collect()}
    assert got == {(10, 1, ("big",), ()), (10, 2, ("big", "big"), ()), (19, 0, (), ("odd", "big")), (-1, 0, (), ("low",)), (2, 0, (), ())}
    once = {(r.x, r.rounds) for r in validate(rows, rules(), fixes, rounds=1).collect()}
    assert once == {(10, 1), (11, 1), (19, 0), (-1, 0), (2, 0)}
    told = report(validate(rows.withColumn("g", F.lit(1)), rules(), fixes), ["g"]).first()
    assert (told.rows, told.failed, told.rechecked, told.status) == (5, 2, 2, "failed")
    assert validate(rows.limit(0), rules(), fixes).count() == 0


def test_no_table_of_keys_is_broadcast(spark, sf):
    # former version: labels, groups and mappings were broadcast, by the small size of their files
    from lexmill import registry

    for name in ("duplicate_states", "merged_orders", "merge_audit"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
