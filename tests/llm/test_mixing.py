import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill.llm.mixing import mix_sources, ranks, row_hash

SCHEMA = "doc_id long, text string, source string, size string, RANK int"


def plain(rows, weights, share=1.5, most=2.0):
    """[(id, text, source)] mixed by sorting: (id, size, taken) in any order, and {source: (size, target)}."""
    sized = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in rows]
    total = defaultdict(int)
    for _, n, s in sized:
        total[s] += n
    budget, capped = share * sum(total.values()), set()
    while True:
        free = [s for s in total if s not in capped and weights.get(s, 0)]
        level = (budget - sum(most * total[s] for s in capped)) / sum(weights[s] for s in free) if free else 0.0
        more = {s for s in free if level * weights[s] > most * total[s]}
        if not more:
            break
        capped |= more
    target = {s: most * total[s] if s in capped else level * weights.get(s, 0) for s in total}

    def place(i):
        return int(hashlib.md5(("-" if i is None else str(i)).encode()).hexdigest()[:15], 16)

    out = []
    for s in total:
        times = target[s] // total[s] if total[s] else 0
        left, before = target[s] - times * total[s], 0
        groups = defaultdict(list)
        for i, n, z in sized:
            if z == s:
                groups[place(i)].append((i, n))
        for h in sorted(groups):
            here = sum(n for _, n in groups[h])
            part = 1.0 if before + here <= left else max(0.0, (left - before) / here) if here else 0.0
            out += [(i, n, int(times * n + (n if part == 1.0 else int(n * part + 0.5)))) for i, n in groups[h]]
            before += here
    return out, {s: (total[s], target[s]) for s in total}


def check(spark, rows, weights, **options):
    df = spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], SCHEMA).repartition(3)
    w = spark.createDataFrame([(s, float(x)) for s, x in weights.items()], "source string, weight double")
    got = mix_sources(df, w, **options).collect()
    want, by_source = plain(rows, weights, **options)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.size, r.taken) for r in got), key=key) == sorted(want, key=key)
    sums = defaultdict(int)
    for r in got:
        assert (r.source_size, r.target) == (by_source[r.source][0], pytest.approx(by_source[r.source][1]))
        assert 0 <= r.taken <= options.get("most", 2.0) * r.size
        sums[r.source] += r.taken
    return sums, by_source


def test_hot_source_and_targets(spark):
    rows = [(k, "w " * (k * 7919 % 90 + 1), "hot" if k % 3 else f"s{k % 7}") for k in range(900)]
    sums, told = check(spark, rows, {"hot": 5, **{f"s{k}": k % 3 + 1 for k in range(7)}})
    assert all(abs(sums[s] - target) <= 1 for s, (_, target) in told.items())
    assert max(t / n for n, t in told.values()) == 2.0 and min(t / n for n, t in told.values()) < 1.5
    assert sum(sums.values()) == pytest.approx(1.5 * sum(n for n, _ in told.values()), abs=len(sums))


def test_edge_rows(spark):
    rows = [(1, None, None), (2, "", "a"), (3, " \t ", "a"), (4, "one two", None), (5, "x " * 50_000, "a"), (5, "x y", "a"), (None, "n u l l", "b"), (None, "n u", "b"), (6, "naïve Éa b", "c")]
    rows += [(9, "same row", "d")] * 20
    check(spark, rows, {None: 1, "a": 2, "b": 1, "c": 1, "d": 5})
    check(spark, rows, {"a": 2, "d": 5}, share=0.4)  # a source without a weight gets nothing
    check(spark, [(1, None, "a")], {"a": 1})
    empty = spark.createDataFrame([], SCHEMA)
    weights = spark.createDataFrame([], "source string, weight double")
    assert mix_sources(empty, weights).count() == 0 and ranks(empty, "source").count() == 0


def test_smaller_budget_is_nested(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    weights = ranks(docs, "source").withColumn("weight", F.col("rank") % 3 + 1)
    small = {r.doc_id: r.taken for r in mix_sources(docs, weights, share=0.3).collect()}
    large = {r.doc_id: r.taken for r in mix_sources(docs, weights, share=0.9).collect()}
    assert all(n <= large[i] for i, n in small.items()) and sum(small.values()) < sum(large.values())


def test_equal_leading_bits_are_refined(spark):
    """Ids chosen so that the threshold's first bucket holds many: the levels below decide."""
    ids = spark.range(200_000).select("id", row_hash(F.col("id")).alias("h")).where("shiftright(h, 50) = 5").select("id")
    rows = [(r.id, "a b c", "s") for r in ids.collect()]
    assert len(rows) > 100
    sums, told = check(spark, rows, {"s": 1}, share=0.5)
    assert abs(sums["s"] - told["s"][1]) <= 1


def test_ranks(spark):
    rows = [("b",), (None,), ("a",), ("é",), ("Z",), ("b",), ("",)]
    got = {r.source: r["rank"] for r in ranks(spark.createDataFrame(rows, "source string"), "source").collect()}
    assert got == {"": 0, "Z": 1, "a": 2, "b": 3, "é": 4, None: 5}
