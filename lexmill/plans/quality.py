"""Acceptance and quality queries: rates, roll-ups, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import rate
from lexmill.operators import metrics
from lexmill.registry import query
from lexmill.sources.tables import table


@query("label_accuracy", """WITH x AS (SELECT lang, quality AS expected, CASE WHEN n_chars >= 400 THEN 1 ELSE 0 END AS predicted FROM documents LEFT JOIN labels USING (doc_id))
SELECT lang, count(*) AS fields, count(expected) AS judged, count(CASE WHEN expected = predicted THEN 1 END) AS matched, round(count(CASE WHEN expected = predicted THEN 1 END) / nullif(count(expected), 0), 4) AS match_rate FROM x GROUP BY 1""")
def label_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """How well length predicts quality, by language; missing labels are not judged."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    fields = docs.join(labels, "doc_id", "left").select("lang", F.col("quality").alias("expected"), F.when(F.col("n_chars") >= 400, 1).otherwise(0).alias("predicted"))
    return metrics.acceptance(fields, ["lang"])


@query("metrics_rollup", """SELECT CASE WHEN grouping(event_type) = 0 THEN 'event_type' WHEN grouping(user_id) = 0 THEN 'user_id' ELSE 'overall' END AS grain, coalesce(event_type, user_id::VARCHAR) AS key, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY GROUPING SETS ((), (event_type), (user_id))""")
def metrics_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Mean value overall, by event type and by user, in one pass."""
    return metrics.mean_by_grains(table(spark, d, "events"), "value", ["event_type", "user_id"])


@query("unit_benchmark", """SELECT event_type, count(*) AS units, count(CASE WHEN value < 5 THEN 1 END) AS failed, round(count(CASE WHEN value < 5 THEN 1 END) / count(*), 4) AS failure_rate, round(avg(value), 6) AS mean_runtime, max(value) AS max_runtime FROM events GROUP BY 1""")
def unit_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Counts, failures and run times of each kind of unit."""
    failed = F.count_if(F.col("value") < 5)
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("units"), failed.alias("failed"), rate(failed, F.count("*")).alias("failure_rate"), F.round(F.avg("value"), 6).alias("mean_runtime"), F.max("value").alias("max_runtime"))


@query("unit_quality", """SELECT source, count(CASE WHEN lang = 'en' THEN 1 END) AS en, count(CASE WHEN lang = 'de' THEN 1 END) AS de, count(CASE WHEN lang = 'fr' THEN 1 END) AS fr, count(CASE WHEN lang = 'es' THEN 1 END) AS es, round(count(CASE WHEN n_chars < 100 THEN 1 END) / count(*), 6) AS short_ratio FROM documents GROUP BY 1""")
def unit_quality(spark: SparkSession, d: str) -> DataFrame:
    """Type counts as columns, and a ratio, for each source."""
    kinds = [F.count_if(F.col("lang") == k).alias(k) for k in ("en", "de", "fr", "es")]
    return table(spark, d, "documents").groupBy("source").agg(*kinds, F.round(F.count_if(F.col("n_chars") < 100) / F.count("*"), 6).alias("short_ratio"))


@query("coverage_status", """SELECT source, count(*) AS total, count(quality) AS ready, count(*) - count(quality) AS missing, CASE WHEN count(quality) = 0 THEN 'missing' WHEN count(quality) = count(*) THEN 'complete' ELSE 'partial' END AS status FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def coverage_status(spark: SparkSession, d: str) -> DataFrame:
    """Labelled and missing documents of each source, and what that makes of it."""
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    ready, total = F.count("quality"), F.count("*")
    status = F.when(ready == 0, "missing").when(ready == total, "complete").otherwise("partial")
    return joined.groupBy("source").agg(total.alias("total"), ready.alias("ready"), (total - ready).alias("missing"), status.alias("status"))


@query("freeze_decision", """WITH x AS (SELECT source, count(CASE WHEN quality = 0 THEN 1 END) AS errors, count(CASE WHEN toxic = 1 THEN 1 END) AS reviews FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, errors, reviews, CASE WHEN errors > 5 THEN 'blocked' WHEN reviews > 0 THEN 'review' ELSE 'ready' END AS decision FROM x""")
def freeze_decision(spark: SparkSession, d: str) -> DataFrame:
    """Three-state decision for each source from its errors and review items."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("errors"), F.count_if(F.col("toxic") == 1).alias("reviews"))
    return x.withColumn("decision", F.when(F.col("errors") > 5, "blocked").when(F.col("reviews") > 0, "review").otherwise("ready"))


@query("gold_scale", """SELECT source, count(*) AS n, count(DISTINCT text) AS distinct_texts, count(DISTINCT lang) AS languages, count(*) > count(DISTINCT text) AS has_duplicates FROM documents GROUP BY 1""")
def gold_scale(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct texts and languages of each source."""
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("text").alias("distinct_texts"), F.countDistinct("lang").alias("languages")).withColumn("has_duplicates", F.col("n") > F.col("distinct_texts"))


@query("diff_summary", """SELECT c_nationkey, count(DISTINCT c_mktsegment) AS segments, list_sort(list(DISTINCT c_mktsegment)) AS found FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1""")
def diff_summary(spark: SparkSession, d: str) -> DataFrame:
    """Keys under which values differ, and the values."""
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.countDistinct("c_mktsegment").alias("segments"), F.sort_array(F.collect_set("c_mktsegment")).alias("found")).where("segments > 1")


@query("order_revenue", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def order_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Filtered, partially aggregated sums over the largest fact table: the plain shape of a roll-up."""
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
