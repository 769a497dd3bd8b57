import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill.llm.merkle import fold, leaf_digest, merkle_manifest, proof_digests

SCHEMA = "doc_id long, source string, text string, digest string, GRP int, idx int"


def digest():
    return leaf_digest(F.col("doc_id"), F.col("source"), F.col("text"))


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, arity):
    """(root, siblings of each node up to it, lowest level first)."""
    sides, members = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, above = [], []
        for a in range(0, len(nodes), arity):
            run = nodes[a : a + arity]
            for k in range(len(run)):
                for m in members[a + k]:
                    sides[m].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h(*run))
            above.append([m for k in range(len(run)) for m in members[a + k]])
        nodes, members = up, above
    return nodes[0], sides


def plain(rows, arity):
    groups = defaultdict(list)
    for i, s, t in rows:
        groups[s].append(((i is not None, i or 0), leaf(i, s, t), i, t))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(groups[s], key=lambda x: x[:2])], arity) for s in order}
    root, tops = tree([trees[s][0] for s in order], arity)
    return sorted((x[1], trees[s][0], root, str(trees[s][1][k] + tops[g])) for g, s in enumerate(order) for k, x in enumerate(sorted(groups[s], key=lambda x: x[:2])))


def check(spark, rows, arity=16):
    df = spark.createDataFrame([(i, s, t, "x", 1, 2) for i, s, t in rows], SCHEMA).repartition(3)
    got = merkle_manifest(df, digest(), arity=arity, keep=["text"])
    back = got.select("*", fold(F.col("leaf"), F.col("proof")).alias("folded"), proof_digests(F.col("proof")).alias("digests")).collect()
    assert sorted((r.leaf, r.subroot, r.root, str([tuple(p) for p in r.proof])) for r in back) == plain(rows, arity)
    assert sorted(map(str, ((r.doc_id, r.source, r.text) for r in back))) == sorted(map(str, rows))
    for r in back:
        assert r.folded == r.root and r.digests == "".join(a + b for a, b in r.proof)
        if any(r.proof):
            assert r.leaf != r.root
    return back


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1], [40, 1, 300, 16], [256, 257]])
def test_sizes(spark, sizes):
    check(spark, [(k * 3, f"s{g}", f"text {k}") for g, n in enumerate(sizes) for k in range(n)])


@pytest.mark.parametrize("arity", [2, 3])
def test_other_arity_and_many_groups(spark, arity):
    check(spark, [(k, "hot" if k % 3 == 0 else f"s{k % 23}", "t") for k in range(150)], arity)


def test_edge_rows(spark):
    rows = [(None, None, None), (None, "a", "x"), (1, None, ""), (1, "", "é\U0001f600"), (1, "a", "y" * 300_000), (2, "a", "-"), (2, "a", None), (2, "S", "1:a")]
    check(spark, rows + [(7, "a", "equal rows")] * 19)
    assert merkle_manifest(spark.createDataFrame([], SCHEMA), digest()).count() == 0


def test_a_change_is_seen(spark):
    rows = spark.createDataFrame([(k, "a" if k % 2 else "b", f"T{k}") for k in range(50)], "doc_id long, source string, text string")
    told = merkle_manifest(rows, digest(), keep=["text"])
    other = leaf_digest(F.col("doc_id"), F.col("source"), F.lower("text"))
    assert told.where(fold(other, F.col("proof")) == F.col("root")).count() == 0
    assert told.select("root").distinct().count() == 1
