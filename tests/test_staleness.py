import random
from collections import defaultdict

import pytest

from lexmill.operators import staleness


def frames(spark, edges, versions):
    return spark.createDataFrame(edges, "upstream string, downstream string, used int"), spark.createDataFrame(versions, "node string, version int")


def plain(edges, versions):
    version = dict(versions)
    causes, down = defaultdict(list), defaultdict(set)
    for u, d, used in edges:
        if u is None or d is None:
            continue
        down[u].add(d)
        if u not in version:
            causes[d].append((0, u))
        elif version[u] != used:
            causes[d].append((1, u))
    found = {d: (["missing", "outdated"][min(c)[0]], min(c)[1], 1) for d, c in causes.items()}
    level, depth = set(found), 1
    while level:
        depth += 1
        new = {}
        for u in sorted(level):
            for d in down[u] - set(found):
                new.setdefault(d, ("upstream", u, depth))
        found.update(new)
        level = set(new)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_with_circles(spark, seed):
    rng = random.Random(seed)
    names = [f"n{k}" for k in range(40)]
    edges = [(rng.choice(names), rng.choice(names), 0 if rng.random() < 0.05 else 1) for _ in range(60)]
    edges += [edges[0], (None, "n1", 1), ("n1", None, 1)]
    versions = [(n, 1) for n in names if rng.random() > 0.04]
    got = {r.node: (r.reason, r.via, r.depth) for r in staleness.stale_nodes(*frames(spark, edges, versions)).collect()}
    assert got == plain(edges, versions)


def test_chain_nulls_and_empty(spark):
    edges, versions = frames(spark, [(f"n{k}", f"n{k + 1}", 1) for k in range(12)] + [("x", "y", None)], [(f"n{k}", 1) for k in range(1, 12)] + [("x", None)])
    got = {r.node: (r.reason, r.depth) for r in staleness.stale_nodes(edges, versions).collect()}
    assert got == {f"n{k}": ("missing" if k == 1 else "upstream", k) for k in range(1, 13)}
    assert staleness.stale_nodes(edges.limit(0), versions).count() == 0


def test_states_and_archiving(spark):
    edges, versions = frames(spark, [("a", "b", 1), ("b", "c", 1), ("d", "e", 1)], [(n, 1) for n in "abd"])
    nodes = spark.createDataFrame([(n,) for n in "abcde"], "node string")
    assert {r.state for r in staleness.node_states(nodes, edges, versions).collect()} == {"current"}
    gone = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.reason, r.depth) for r in staleness.archive_effects(edges, versions, gone).collect()} == {("b", "missing", 1), ("c", "upstream", 2)}
