"""What is out of date because something that it was built from, near or far, has changed or gone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.sources.checkpoints import written

#: Reasons, the gravest first.
REASONS = ["missing", "outdated", "upstream"]


def stale_nodes(edges: DataFrame, versions: DataFrame) -> DataFrame:
    """node, reason, via, depth of every node that is stale.

    edges: upstream, downstream and used, the version of upstream that downstream was built from; versions: node and its
    current version. A node is stale at depth 1 where an upstream has no row in versions (missing) or another version than
    the one used (outdated; null is a version like others), and at depth n + 1 where an upstream is stale at depth n
    (upstream). Of several causes the gravest counts, then the smallest upstream, always at the least depth.

    One pass over the edges a level, from the nodes found last: nodes found before are left out, so circles end and each
    node is reached once. The driver sees one count a level. Repeated edges and null ends change nothing.
    """
    links = edges.where("upstream is not null and downstream is not null").select("upstream", "downstream", "used").distinct()
    current = versions.select(F.col("node").alias("upstream"), "version", F.lit(True).alias("there"))
    judged = links.join(current, "upstream", "left")
    rank = F.when(F.col("there").isNull(), 0).when(~F.col("version").eqNullSafe(F.col("used")), 1)
    links = written(judged.select("upstream", "downstream", rank.alias("cause")).distinct())
    frontier = written(links.where("cause is not null").groupBy(F.col("downstream").alias("node")).agg(F.min(F.struct("cause", "upstream")).alias("z")).select("node", "z.cause", F.col("z.upstream").alias("via"), F.lit(1).alias("depth")))
    levels = [frontier]
    hops = links.select("upstream", "downstream")
    found = frontier.select("node")
    depth = 1
    while frontier.limit(1).count():
        depth += 1
        step = hops.join(frontier.select(F.col("node").alias("upstream")), "upstream").groupBy(F.col("downstream").alias("node")).agg(F.min("upstream").alias("via"))
        frontier = written(step.join(found, "node", "left_anti").select("node", F.lit(2).alias("cause"), "via", F.lit(depth).alias("depth")))
        levels.append(frontier)
        found = found.unionAll(frontier.select("node"))
    reasons = F.array(*map(F.lit, REASONS))
    return reduce(DataFrame.unionAll, levels).select("node", F.get(reasons, F.col("cause")).alias("reason"), "via", "depth")


def node_states(nodes: DataFrame, edges: DataFrame, versions: DataFrame) -> DataFrame:
    """nodes (node and more) with state (current or stale), reason, via and depth."""
    told = stale_nodes(edges, versions)
    return nodes.join(told, "node", "left").withColumn("state", F.when(F.col("reason").isNull(), "current").otherwise("stale"))


def archive_effects(edges: DataFrame, versions: DataFrame, removed: DataFrame) -> DataFrame:
    """What archiving the nodes of `removed` (node) would make stale that is not stale now: node, reason, via, depth."""
    after = stale_nodes(edges, versions.join(removed.select("node"), "node", "left_anti"))
    return after.join(stale_nodes(edges, versions).select("node"), "node", "left_anti")
