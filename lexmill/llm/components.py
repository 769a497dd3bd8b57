"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable. Nulls and self loops are left out; no edge gives no row.

    Each round takes the least label among neighbours and then the label's own label, so a chain of length n takes
    about log n rounds. Labels stay a table throughout; the driver sees one count a round.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    both = saved(e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = saved(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("component").alias("c")), "v").groupBy("u").agg(F.min("c").alias("c"))
        hooked = labels.join(near, labels.node == near.u).select("node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        up = labels.select(F.col("node").alias("p"), F.col("component").alias("above"))
        step = saved(hooked.join(up, hooked.component == up.p, "left").select("node", "old", F.least("component", F.coalesce("above", "component")).alias("component")))
        if not step.where("old <> component").limit(1).count():
            return step.select("node", "component")
        labels = step.select("node", "component")
