"""Evidence queries: provenance checks, entity resolution, gold fields, freshness, and layout of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import layout
from lexmill.operators import evidence
from lexmill.registry import query
from lexmill.sources.tables import table


@query(
    "evidence_check",
    """WITH r AS (SELECT doc_id AS ref_id, CASE WHEN doc_id % 7 = 0 THEN -doc_id - 1 ELSE doc_id END AS block_id, CASE WHEN doc_id % 5 = 0 THEN 'none' ELSE source END AS paper_id, (doc_id % 3)::INT AS s, (doc_id % 3 + 40)::INT AS e,
  CASE WHEN doc_id % 2 = 0 THEN substring(text, (doc_id % 3 + 1)::INT, 40) ELSE upper(substring(text, (doc_id % 3 + 1)::INT, 40)) END AS quote FROM documents),
j AS (SELECT r.*, d.doc_id IS NOT NULL AS there, d.source AS b_paper, d.text AS b_text FROM r LEFT JOIN documents d ON d.doc_id = r.block_id),
k AS (SELECT *, e <= length(b_text) AS ranged FROM j)
SELECT ref_id, 'missing_block' AS issue FROM k WHERE NOT there
UNION ALL SELECT ref_id, 'wrong_paper' FROM k WHERE there AND b_paper IS DISTINCT FROM paper_id
UNION ALL SELECT ref_id, 'bad_range' FROM k WHERE there AND NOT coalesce(ranged, false)
UNION ALL SELECT ref_id, 'quote_mismatch' FROM k WHERE there AND ranged AND quote IS NOT NULL AND substring(b_text, s + 1, e - s) <> quote""",
)
def evidence_check(spark: SparkSession, d: str) -> DataFrame:
    """References into documents, some of them broken, and what is wrong with each."""
    docs = table(spark, d, "documents")
    start = (F.col("doc_id") % 3).cast("int")
    said = F.substring(F.col("text"), start + 1, F.lit(40))
    refs = docs.select(
        F.col("doc_id").alias("ref_id"),
        F.when(F.col("doc_id") % 7 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("block_id"),
        F.when(F.col("doc_id") % 5 == 0, "none").otherwise(F.col("source")).alias("paper_id"),
        start.alias("char_start"),
        (start + 40).alias("char_end"),
        F.when(F.col("doc_id") % 2 == 0, said).otherwise(F.upper(said)).alias("quote"),
    )
    return evidence.evidence_issues(refs, docs.select(F.col("doc_id").alias("block_id"), F.col("source").alias("paper_id"), "text"))


@query("field_mismatch", "SELECT coalesce(c.k, o.k) AS custkey, CASE WHEN o.k IS NULL THEN 'missing' ELSE 'unknown' END AS issue FROM (SELECT c_custkey AS k FROM customer) c FULL JOIN (SELECT DISTINCT o_custkey + 10 AS k FROM orders) o ON c.k = o.k WHERE c.k IS NULL OR o.k IS NULL")
def field_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an order, and orders (keys moved on by ten) without a customer."""
    expected = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"))
    return evidence.field_mismatch(expected, table(spark, d, "orders").select((F.col("o_custkey") + 10).alias("custkey")), ["custkey"])


@query(
    "gold_fields",
    """SELECT d.doc_id, coalesce(CASE WHEN l.doc_id IS NULL THEN NULL WHEN quality = 1 THEN 'reported' ELSE 'not_reported' END, 'missing') = x.e AS status_match,
  CASE WHEN d.lang IN ('en', 'de') AND l.doc_id IS NOT NULL AND (quality = 1) = (x.e = 'reported') THEN toxic::VARCHAR IN ('0') END AS value_match,
  CASE WHEN l.doc_id IS NULL THEN 'no_prediction' WHEN (quality = 1) = (x.e = 'reported') THEN NULL WHEN x.e = 'not_reported' THEN 'invented' ELSE 'overlooked' END AS mismatch
FROM documents d JOIN (SELECT doc_id, CASE WHEN n_chars >= 400 THEN 'reported' ELSE 'not_reported' END AS e FROM documents) x USING (doc_id) LEFT JOIN labels l USING (doc_id)""",
)
def gold_fields(spark: SparkSession, d: str) -> DataFrame:
    """Labels as predictions of a status that length stands for; values are judged in two languages."""
    gold = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") >= 400, "reported").otherwise("not_reported").alias("expected_status"), F.when(F.col("lang").isin("en", "de"), F.array(F.lit("0"))).alias("acceptable"))
    predicted = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "reported").otherwise("not_reported").alias("status"), F.col("toxic").cast("string").alias("value"))
    return evidence.evaluate_fields(gold, predicted, ["doc_id"])


@query(
    "entity_resolution",
    """WITH e AS (SELECT p_partkey AS entity_id, lower(p_name) AS k, 0 AS tier FROM part UNION ALL SELECT p_partkey, lower(p_brand), 1 FROM part),
q AS (SELECT p_partkey AS proposal_id, CASE p_partkey % 3 WHEN 0 THEN lower(p_name) WHEN 1 THEN lower(p_brand) ELSE 'no such ' || p_partkey END AS k FROM part),
h AS (SELECT proposal_id, tier, count(DISTINCT entity_id) AS n, min(entity_id) AS id FROM q JOIN e USING (k) GROUP BY 1, 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY tier) AS rn FROM h) WHERE rn = 1)
SELECT q.proposal_id, CASE WHEN n = 1 THEN id END AS entity_id, CASE WHEN n IS NULL THEN 'new' WHEN n > 1 THEN 'ambiguous' WHEN tier = 0 THEN 'exact' ELSE 'alias' END AS decision FROM q LEFT JOIN b USING (proposal_id)""",
)
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Names proposed for parts, resolved by name first, then by brand as an alias."""
    part = table(spark, d, "part")
    entities = part.select(F.col("p_partkey").alias("entity_id"), F.lower("p_name").alias("name_key"), F.array(F.lower("p_brand")).alias("alias_keys"))
    third = F.col("p_partkey") % 3
    key = F.when(third == 0, F.lower("p_name")).when(third == 1, F.lower("p_brand")).otherwise(F.concat(F.lit("no such "), F.col("p_partkey").cast("string")))
    return evidence.resolve_entities(part.select(F.col("p_partkey").alias("proposal_id"), key.alias("name_key")), entities)


@query(
    "build_freshness",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unsupported' WHEN o_totalprice < 1000 THEN 'missing' WHEN o_orderpriority LIKE '1%' THEN 'error' WHEN o_custkey % 4 = 0 THEN 'stale' WHEN o_orderkey % 9 = 0 THEN 'error' ELSE 'ready' END AS state FROM orders""",
)
def build_freshness(spark: SparkSession, d: str) -> DataFrame:
    """State of each order as if it were a build, the first reason winning."""
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") != "P").alias("supported"), (F.col("o_totalprice") >= 1000).alias("built"), (~F.col("o_orderpriority").startswith("1")).alias("provenance_ok"), F.lit(0).alias("expected"), (F.col("o_custkey") % 4 == 0).cast("int").alias("fingerprint"), (F.col("o_orderkey") % 9 != 0).alias("build_ok"))
    return evidence.freshness(rows).select("o_orderkey", "state")


@query("turn_order", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY sha256('7' || chr(31) || event_id), event_id) AS turn, sha256('7' || chr(31) || event_type) AS group_key FROM events")
def turn_order(spark: SparkSession, d: str) -> DataFrame:
    """Events of all types in turn, in an order drawn by seed."""
    return evidence.interleave(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 7).select("event_id", "turn", "group_key")


@query("line_kinds", rf"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS s FROM documents)
SELECT CASE WHEN trim(s) = '' THEN 'blank' WHEN regexp_matches(s, '{layout.NOISE}') THEN 'noise' WHEN regexp_matches(s, '{layout.ABSTRACT}') THEN 'abstract' WHEN regexp_matches(s, '{layout.AFFILIATION}') THEN 'affiliation' ELSE 'text' END AS kind, count(*) AS n FROM l WHERE s IS NOT NULL GROUP BY 1""")
def line_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of documents are of each kind."""
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("s"))
    return lines.groupBy(layout.line_kind(F.col("s")).alias("kind")).agg(F.count("*").alias("n"))


@query("block_requests", "SELECT request_id, pos, o_orderkey AS block_id, o_totalprice FROM (SELECT l_suppkey AS request_id, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) - 1 AS pos FROM lineitem) JOIN orders ON o_orderkey = l_orderkey")
def block_requests(spark: SparkSession, d: str) -> DataFrame:
    """Orders asked for by each supplier's lines, a row a request, in the order of their keys."""
    pos = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey")) - 1
    asked = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("request_id"), pos.cast("long").alias("pos"), F.col("l_orderkey").alias("block_id"))
    blocks = table(spark, d, "orders").select(F.col("o_orderkey").alias("block_id"), "o_totalprice")
    return evidence.requested_blocks(asked, blocks).select("request_id", "pos", "block_id", "o_totalprice")
