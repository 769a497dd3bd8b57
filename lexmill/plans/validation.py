"""Validation queries: order lines judged in stages, mended where a rule allows, and judged again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.validation import Fix, Rule, report, validate
from lexmill.registry import query
from lexmill.sources.tables import table


def _judged(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"), F.round(F.col("l_discount") * 100).cast("int").alias("disc"), F.round(F.col("l_tax") * 100).cast("int").alias("tax"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line_status"))
    sizes = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    rows = lines.join(sizes, "l_partkey", "left")
    rules = [
        Rule("structural", "quantity_range", "error", F.col("q") > 44),
        Rule("evidence", "no_part", "error", F.col("p_size").isNull()),
        Rule("evidence", "large_part", "warning", F.col("p_size") > 45),
        Rule("cross_field", "rates_exceed", "error", F.col("disc") + F.col("tax") > 14),
        Rule("semantic", "returned_while_open", "error", (F.col("flag") == "R") & (F.col("line_status") == "O")),
    ]
    fixes = [Fix("quantity_range", F.col("q") < 50, {"q": F.col("q") - 2}), Fix("rates_exceed", F.col("tax") > 5, {"tax": F.col("tax") - 1, "q": F.col("q") - 1}), Fix("returned_while_open", F.col("q") % 2 == 0, {"flag": F.lit("N")})]
    return validate(rows, rules, fixes, rounds=3)


_RULES = "CASE WHEN q > 44 THEN 'structural' WHEN p_size IS NULL THEN 'evidence' WHEN disc + tax > 14 THEN 'cross_field' ELSE 'semantic' END"
_ERROR = "CASE WHEN q > 44 THEN 'quantity_range' WHEN p_size IS NULL THEN 'no_part' WHEN disc + tax > 14 THEN 'rates_exceed' WHEN flag = 'R' AND line_status = 'O' THEN 'returned_while_open' END"
_VALIDATED = f"""v0 AS MATERIALIZED (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::INTEGER AS q, round(l_discount * 100)::INTEGER AS disc, round(l_tax * 100)::INTEGER AS tax, l_returnflag AS flag, l_linestatus AS line_status, p_size, 0 AS n, []::VARCHAR[] AS mended FROM lineitem LEFT JOIN part ON p_partkey = l_partkey),
""" + ",\n".join(f"""w{k} AS (SELECT *, {_ERROR} AS err FROM v{k - 1}),
m{k} AS MATERIALIZED (SELECT *, coalesce(n = {k - 1} AND ((err = 'quantity_range' AND q < 50) OR (err = 'rates_exceed' AND tax > 5) OR (err = 'returned_while_open' AND q % 2 = 0)), false) AS fix FROM w{k}),
v{k} AS MATERIALIZED (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN fix AND err = 'quantity_range' THEN q - 2 WHEN fix AND err = 'rates_exceed' THEN q - 1 ELSE q END AS q, disc, CASE WHEN fix AND err = 'rates_exceed' THEN tax - 1 ELSE tax END AS tax, CASE WHEN fix AND err = 'returned_while_open' THEN 'N' ELSE flag END AS flag, line_status, p_size, CASE WHEN fix THEN n + 1 ELSE n END AS n, CASE WHEN fix THEN list_append(mended, err) ELSE mended END AS mended FROM m{k})""" for k in (1, 2, 3)) + f""",
z AS MATERIALIZED (SELECT *, {_ERROR} AS err, {_RULES} AS stage, q <= 44 AND p_size > 45 AS large FROM v3)"""


@query("validation_rows", f"WITH {_VALIDATED} SELECT l_orderkey, l_linenumber, l_partkey, q, tax, flag, list_filter([CASE WHEN large THEN 'large_part' END, err], lambda x: x IS NOT NULL) AS issues, stage, n AS rounds, mended FROM z")
def validation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each line with its issues, the stage it came to, and what was mended on the way."""
    return _judged(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "q", "tax", "flag", F.transform("issues", lambda i: i["issue"]).alias("issues"), "stage", "rounds", "mended")


@query("validation_report", f"""WITH {_VALIDATED}, g AS (SELECT l_orderkey, count(*) AS rows, count(err) AS failed, count(*) FILTER (large) AS warned, count(*) FILTER (n > 0) AS rechecked FROM z GROUP BY 1)
SELECT *, CASE WHEN failed > 0 THEN 'failed' WHEN rechecked > 0 THEN 'rechecked' WHEN warned > 0 THEN 'warned' ELSE 'passed' END AS status FROM g""")
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    return report(_judged(spark, d), ["l_orderkey"])
