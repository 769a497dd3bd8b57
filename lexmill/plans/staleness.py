"""Staleness queries: customers, orders, lines and suppliers' pages as a graph of what is built from what."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import staleness
from lexmill.registry import query
from lexmill.sources.tables import table

_GRAPH = """e AS (SELECT DISTINCT * FROM (
  SELECT 'c' || o_custkey AS upstream, 'o' || o_orderkey AS downstream, 1 AS used FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'l' || l_orderkey || '-' || l_linenumber, CASE WHEN l_quantity >= 50 THEN 0 ELSE 1 END FROM lineitem
  UNION ALL SELECT 'l' || l_orderkey || '-' || l_linenumber, 's' || l_suppkey, 1 FROM lineitem)),
v AS (SELECT 'c' || c_custkey AS node, CASE WHEN c_acctbal < -500 THEN 2 ELSE 1 END AS version FROM customer WHERE c_custkey % 50 <> 7
  UNION ALL SELECT 'o' || o_orderkey, 1 FROM orders UNION ALL SELECT DISTINCT 'l' || l_orderkey || '-' || l_linenumber, 1 FROM lineitem)"""


@query("stale_entries", f"""WITH RECURSIVE {_GRAPH},
j AS (SELECT downstream AS node, min(CASE WHEN v.node IS NULL THEN 0 WHEN version IS DISTINCT FROM used THEN 1 END) AS cause FROM e LEFT JOIN v ON v.node = upstream GROUP BY 1 HAVING cause IS NOT NULL),
r AS (SELECT node, 1 AS depth FROM j UNION SELECT e.downstream, r.depth + 1 FROM r JOIN e ON e.upstream = r.node WHERE r.depth < 6),
d AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1),
via AS (SELECT d.node, min(CASE WHEN d.depth > 1 THEN CASE WHEN u.depth = d.depth - 1 THEN e.upstream END ELSE CASE WHEN (CASE WHEN v.node IS NULL THEN 0 WHEN version IS DISTINCT FROM used THEN 1 END) = j.cause THEN e.upstream END END) AS via
  FROM d JOIN e ON e.downstream = d.node LEFT JOIN d u ON u.node = e.upstream LEFT JOIN v ON v.node = e.upstream LEFT JOIN j ON j.node = d.node GROUP BY 1)
SELECT d.node, CASE WHEN d.depth > 1 THEN 'upstream' WHEN j.cause = 0 THEN 'missing' ELSE 'outdated' END AS reason, via, d.depth::INTEGER AS depth FROM d JOIN via ON via.node = d.node LEFT JOIN j ON j.node = d.node""")
def stale_entries(spark: SparkSession, d: str) -> DataFrame:
    """Orders, lines and pages that are stale because a customer is gone or changed, or an order was read in an old version."""
    orders, lines, customers = (table(spark, d, t) for t in ("orders", "lineitem", "customer"))
    name = lambda kind, *parts: F.concat(F.lit(kind), F.concat_ws("-", *[F.col(p).cast("string") for p in parts]))
    line = name("l", "l_orderkey", "l_linenumber")
    edge = lambda df, up, down, used: df.select(up.alias("upstream"), down.alias("downstream"), used.alias("used"))
    one: Column = F.lit(1)
    edges = [edge(orders, name("c", "o_custkey"), name("o", "o_orderkey"), one), edge(lines, name("o", "l_orderkey"), line, F.when(F.col("l_quantity") >= 50, 0).otherwise(1)), edge(lines, line, name("s", "l_suppkey"), one)]
    versions = [customers.where("c_custkey % 50 <> 7").select(name("c", "c_custkey").alias("node"), F.when(F.col("c_acctbal") < -500, 2).otherwise(1).alias("version")), orders.select(name("o", "o_orderkey"), one), lines.select(line, one).distinct()]
    return staleness.stale_nodes(reduce(DataFrame.unionAll, edges), reduce(DataFrame.unionAll, versions))
