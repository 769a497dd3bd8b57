"""Resolution queries: neighbouring customers of one nation and segment as relations, decided, merged, and led to in orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators import resolution
from lexmill.registry import query
from lexmill.sources.tables import table

_RELATIONS = """n AS (SELECT c_custkey AS source, lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS target FROM customer),
rel AS (SELECT source, target, CASE (source + target) % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'rejected' ELSE 'confirmed' END AS status FROM n WHERE target IS NOT NULL),
e AS (SELECT source AS u, target AS v FROM rel WHERE status = 'confirmed' UNION ALL SELECT target, source FROM rel WHERE status = 'confirmed'),
r AS (SELECT u AS root, u AS node FROM e UNION SELECT r.root, e.v FROM r JOIN e ON e.u = r.node),
g AS (SELECT node, min(root) AS grp FROM r GROUP BY 1),
m AS (SELECT c_custkey AS old, first_value(c_custkey) OVER (PARTITION BY grp ORDER BY c_acctbal DESC, c_custkey) AS new FROM g JOIN customer ON c_custkey = node)"""


def _merged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    customers = table(spark, d, "customer")
    after = F.lead("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey"))
    pairs = customers.select(F.col("c_custkey").alias("source"), after.alias("target")).where("target is not null")
    relations = pairs.select(F.concat_ws("-", "source", "target").alias("relation_id"), "source", "target", F.lit("pending").alias("status"))
    what = F.when((F.col("source") + F.col("target")) % 5 == 1, "reject").when((F.col("source") + F.col("target")) % 5 > 1, "confirm")
    made = relations.select("relation_id", what.alias("decision"), F.lit("curator").alias("actor"), F.lit(1).alias("at")).where("decision is not null")
    late = made.where("decision = 'confirm'").withColumn("decision", F.lit("reject")).withColumn("at", F.lit(2))
    relations, _ = resolution.decide(relations, made.unionAll(late))
    return customers, relations, resolution.canonical(customers, relations, "c_custkey", [-F.col("c_acctbal")])


@query("duplicate_states", f"""WITH RECURSIVE {_RELATIONS},
p AS (SELECT source AS k FROM rel WHERE status = 'pending' UNION SELECT target FROM rel WHERE status = 'pending')
SELECT c_custkey, CASE WHEN new <> c_custkey THEN 'merged' WHEN k IS NOT NULL THEN 'duplicate_pending' ELSE 'active' END AS state, coalesce(new, c_custkey) AS canonical FROM customer LEFT JOIN m ON old = c_custkey LEFT JOIN p ON k = c_custkey""")
def duplicate_states(spark: SparkSession, d: str) -> DataFrame:
    """Customers after decisions: merged into the one of their group with the largest balance, waiting, or active."""
    customers, relations, mapping = _merged(spark, d)
    return resolution.record_states(customers, relations, mapping, "c_custkey")


@query("merge_audit", f"WITH RECURSIVE {_RELATIONS} SELECT 'orders' AS table_name, o_orderkey::VARCHAR AS row_key, 'o_custkey' AS column_name, old::VARCHAR AS old_value, new::VARCHAR AS new_value FROM orders JOIN m ON old = o_custkey AND new <> old")
def merge_audit(spark: SparkSession, d: str) -> DataFrame:
    """Every order led from a merged customer to the one that stays."""
    return resolution.rewrite(table(spark, d, "orders"), "orders", "o_orderkey", "o_custkey", _merged(spark, d)[2])[1]


@query("merged_orders", f"WITH RECURSIVE {_RELATIONS} SELECT coalesce(new, o_custkey) AS o_custkey, count(*) AS orders, min(o_orderkey) AS first_order FROM orders LEFT JOIN m ON old = o_custkey GROUP BY 1")
def merged_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders by the customer that stays."""
    led, _ = resolution.rewrite(table(spark, d, "orders"), "orders", "o_orderkey", "o_custkey", _merged(spark, d)[2])
    return led.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.min("o_orderkey").alias("first_order"))
