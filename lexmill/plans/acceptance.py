"""Acceptance operators over the driver's tables, and over stated rows worked out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import acceptance as A
from lexmill.operators import metrics
from lexmill.plans.cases import spread, spread_sql
from lexmill.registry import query
from lexmill.sources.tables import table


@query("variant_metrics", """WITH a AS (SELECT p_size AS q, p_partkey AS id, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part),
b AS (SELECT p_size AS q, p_partkey AS id, row_number() OVER (PARTITION BY p_size ORDER BY p_name, p_partkey) AS rank FROM part),
l AS (SELECT * FROM a WHERE rank <= 20), n AS (SELECT * FROM b WHERE rank <= 20),
f AS (SELECT q, id, l.rank AS ra, n.rank AS rb, coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + n.rank), 0) AS s FROM l FULL JOIN n USING (q, id)),
h AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 12) DESC, ra NULLS LAST, rb NULLS LAST) AS rank FROM f),
e AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END, CASE WHEN id % 2 = 0 THEN id END DESC, rank) AS rank FROM h WHERE rank <= 30),
v AS (SELECT 'bm25' AS variant, q, id, rank FROM l WHERE rank <= 10 UNION ALL SELECT 'dense', q, id, rank FROM n WHERE rank <= 10 UNION ALL SELECT 'hybrid', q, id, rank FROM h WHERE rank <= 10 UNION ALL SELECT 'hybrid_rerank', q, id, rank FROM e WHERE rank <= 10),
g AS (SELECT p_size AS q, p_partkey AS id, count(*) OVER (PARTITION BY p_size) AS n_gold FROM part WHERE p_brand = 'Brand#11' OR p_partkey % 5 = 0),
gq AS (SELECT DISTINCT q, n_gold FROM g),
m AS (SELECT variant, q, count(*) AS hits, min(rank) AS first FROM v JOIN g USING (q, id) GROUP BY 1, 2),
w AS (SELECT DISTINCT variant FROM v)
SELECT w.variant, count(*) AS queries, round(avg(coalesce(hits / n_gold, 0)), 6) AS recall, round(avg(coalesce(1.0 / first, 0)), 6)::DOUBLE AS mrr FROM w CROSS JOIN gq LEFT JOIN m ON m.variant = w.variant AND m.q = gq.q GROUP BY 1""")
def variant_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Parts of each size ranked by price and by name, fused and reranked: mean recall and reciprocal rank of each variant."""
    p = table(spark, d, "part").select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("id"), "p_retailprice", "p_name", "p_brand")
    ranked = lambda *order: p.withColumn("rank", F.row_number().over(A.Window.partitionBy("query_id").orderBy(*order))).where("rank <= 20").select("query_id", "id", "rank")
    scores = p.where("id % 2 = 0").select("query_id", "id", F.col("id").cast("double").alias("rerank_score"))
    hits = A.search_variants(ranked(F.col("p_retailprice").desc(), "id"), ranked("p_name", "id"), scores, 10)
    gold = p.where("p_brand = 'Brand#11' or id % 5 = 0").select("query_id", "id")
    both = hits.select("variant").distinct().crossJoin(F.broadcast(gold.select("query_id").distinct()))  # four rows by the queries
    keyed = lambda df: df.withColumn("query_id", F.struct("variant", "query_id"))
    scored = metrics.ranking_metrics(keyed(hits), keyed(both.join(gold, "query_id")).select("query_id", "id"), 10)
    return scored.groupBy("query_id.variant").agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("mrr"), 6).alias("mrr"))


_VARIANTS = ["bm25", "dense", "hybrid", "hybrid_rerank"]


@query("acceptance_rules", """WITH a AS (SELECT avg(r) FILTER (n = 1) AS r1, avg(r) FILTER (n = 2) AS r2, avg(r) FILTER (n = 3) AS r3, avg(r) FILTER (n = 4) AS r4, avg(m) FILTER (n = 1) AS m1, avg(m) FILTER (n = 2) AS m2, avg(m) FILTER (n = 4) AS m4,
  avg(r) FILTER (n = 1 AND f = 'R') AS er1, avg(r) FILTER (n = 2 AND f = 'R') AS er2, avg(m) FILTER (n = 1 AND f = 'R') AS em1, avg(m) FILTER (n = 2 AND f = 'R') AS em2, count(*) FILTER (f = 'N') AS zh
  FROM (SELECT l_linenumber AS n, l_quantity / 50 AS r, l_discount * 10 AS m, l_returnflag AS f FROM lineitem WHERE l_linenumber <= 4))
SELECT unnest([1, 2, 3, 4, 5]) AS rule, unnest(['hybrid_recall >= best single', 'hybrid_rerank mrr >= best single', 'rerank does not hurt recall', 'exact_term keeps bm25 advantage', 'zh (cross-language) results exist']) AS name,
  unnest([greatest(r3, r4) >= greatest(r1, r2), m4 >= greatest(m1, m2), r4 >= r3 - 0.05, er1 >= er2 OR em1 >= em2, zh > 0]) AS passed FROM a""")
def acceptance_rules(spark: SparkSession, d: str) -> DataFrame:
    """The five rules over means of lines by line number, as variants; returned lines as exact terms, flag N as Chinese."""
    lines = table(spark, d, "lineitem").where("l_linenumber <= 4")
    measured = lambda df, grain, key: df.groupBy(F.get(F.array(*map(F.lit, _VARIANTS)), F.col("l_linenumber") - 1).alias("variant")).agg(F.avg(F.col("l_quantity") / 50).alias("recall"), F.avg(F.col("l_discount") * 10).alias("mrr")).select(F.lit(grain).alias("grain"), F.lit(key).cast("string").alias("key"), "variant", F.lit("ok").alias("status"), "recall", "mrr")
    parts = [measured(lines, "overall", None), measured(lines.where("l_returnflag = 'R'"), "type", "exact_term"), measured(lines.where("l_returnflag = 'N'"), "language", "zh")]
    return A.acceptance_rules(parts[0].unionAll(parts[1]).unionAll(parts[2]))


_GOLD = [
    (0, "a#", "T", "x/a#.pdf", "s", "1", True, "evaluated", [("f", "explicit", "correct", "required", "[1]"), ("f", None, "odd", "required", None), (None, "explicit", "correct", "maybe", None)]),
    (1, "a#", "", "../a.pdf", "none", "1", None, "template", [("f", None, "correct", "optional", None), ("g", None, "not_evaluated", "optional", None)]),
    (2, "b#", "T", "C:\\a#.pdf", "s", "1", True, "draft", []),
]


@query("gold_issues", spread_sql("""(0, 1, 'field_id_duplicate'), (0, 1, 'field_expected_status_null'), (0, 1, 'field_invalid_value_judgement'), (0, 2, 'field_missing_required_key'), (0, 2, 'field_invalid_evidence_expectation'),
(1, NULL, 'paper_missing_required_key'), (1, NULL, 'paper_id_duplicate'), (1, NULL, 'pdf_path_invalid'), (1, NULL, 'gold_schema_not_found'), (1, 0, 'template_field_invalid'), (2, NULL, 'paper_missing_required_key'), (2, NULL, 'pdf_path_invalid')""", "paper_no, field_no, issue", "", "paper_no"))
def gold_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues of gold papers, a set for each supplier, worked out by hand."""
    field = "array<struct<field_id:string,expected_status:string,value_judgement:string,evidence_expectation:string,acceptable:string>>"
    papers = spread(spark, d, _GOLD, f"paper_no int, paper_id string, title string, pdf_path string, schema_id string, schema_version string, selected boolean, gold_status string, fields {field}", "paper_no")
    return A.gold_issues(papers, ["s"])


_UNITS = [(1, '{"status":"passed","page_count":3#,"runtime_s":1.5#,"duplicate_ratio":0.1}'), (2, '{"status":"odd","page_count":-1,"runtime_s":"x","duplicate_ratio":1.5}'), (3, '{"status":null,"page_count":2.5,"runtime_s":null}'), (4, "[]")]


@query("unit_records", spread_sql("(1::BIGINT, ''), (2, 'illegal status;bad page_count;bad runtime_s;bad duplicate_ratio'), (3, 'bad page_count'), (4, 'missing status;missing page_count')", "unit_id, issues", "", "unit_id"))
def unit_records(spark: SparkSession, d: str) -> DataFrame:
    """Issues of unit records, a set for each supplier, worked out by hand."""
    rows = spread(spark, d, _UNITS, "unit_id long, raw string", "unit_id")
    return A.unit_record_issues(rows, ["status", "page_count"]).select("unit_id", F.array_join("issues", ";").alias("issues"))


_LINES = [(1, '{"annotator":"Kim","paper":"p#","parser":"x","item":"order","score":3,"date":"d"}'), (2, " "), (3, "{oops"), (4, "[1]"), (5, '{"annotator":" Bot ","paper":"","parser":"x","item":"odd","score":7,"date":3}'), (6, '{"annotator":"Kim","paper":"p","parser":"x","item":"order","score":2.5}')]


@query("annotation_issues", spread_sql("(3::BIGINT, 'not JSON'), (4, 'not an object'), (5, 'missing paper;reserved annotator;unknown item;bad score;bad date'), (6, 'bad score')", "line_no, issues", "", "line_no"))
def annotation_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues of annotation lines, a set for each supplier, worked out by hand."""
    rows = spread(spark, d, _LINES, "line_no long, line string", "line_no")
    return A.annotation_issues(rows, ["order"], ["bot"]).select("line_no", F.array_join("issues", ";").alias("issues"))


@query("report_status", """WITH i AS (SELECT l_orderkey AS k, bool_or(l_returnflag = 'R') AS e, bool_or(l_returnflag = 'A') AS w FROM lineitem GROUP BY 1)
SELECT o_orderkey AS report_id, CASE WHEN e THEN 'failed' WHEN o_orderstatus = 'P' THEN 'needs_recheck' WHEN w THEN 'warning' ELSE 'passed' END AS status FROM orders LEFT JOIN i ON k = o_orderkey""")
def report_status(spark: SparkSession, d: str) -> DataFrame:
    """Orders as reports, returned lines as errors, pending ones to recheck."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), "o_orderstatus")
    flag = F.col("l_returnflag")
    return A.report_status(o, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.when(flag == "R", "error").when(flag == "A", "warning").otherwise("note").alias("severity")), o.where("o_orderstatus = 'P'"))


_FIELDS = [("p", "control_type", "Bus Scheduling"), ("p", "holding_upper_bound", "60"), ("q", "rl_paradigm", " sarl "), ("q", "agent_definition", "each bus acts"), ("q", "centralized_or_decentralized", "Decentralized"), ("r", "control_type", "Speed Control"), ("r", "holding_lower_bound", "5"), ("s", "control_type", "mixed scheduling"), ("s", "holding_upper_bound", "9")]
_SECTION = {"control_type": "research_problem", "holding_upper_bound": "control_constraints", "holding_lower_bound": "control_constraints", "rl_paradigm": "rl_formulation", "agent_definition": "rl_formulation", "centralized_or_decentralized": "rl_formulation"}


@query("consistency_issues", spread_sql("('p#', '1'), ('q#', '2,4'), ('r#', '3')", "paper_id, rules", "paper_id"))
def consistency_issues(spark: SparkSession, d: str) -> DataFrame:
    """Rules between fields, a set for each supplier, worked out by hand."""
    rows = [(f"{p}#", f"{_SECTION[f]}.{f}", v, "explicit") for p, f, v in _FIELDS]
    found = A.consistency_issues(spread(spark, d, rows, "paper_id string, field_id string, value string, status string"))
    return found.select("paper_id", F.array_join(F.col("rules").cast("array<string>"), ",").alias("rules"))


@query("snapshot_issues", """WITH p AS (SELECT c_custkey AS page_id, c_acctbal AS paper_id FROM customer WHERE c_custkey % 10 <> 0), e AS (SELECT p_partkey AS entity_id, p_name AS key FROM part WHERE p_partkey % 9 <> 0),
l AS (SELECT o_orderkey AS link_id, o_custkey AS page_id, o_orderkey % 200 + 1 AS entity_id, o_orderpriority AS relation FROM orders),
r AS (SELECT 'duplicate_page' AS kind, page_id AS id, row_number() OVER (PARTITION BY paper_id ORDER BY page_id) AS n FROM p UNION ALL SELECT 'duplicate_entity', entity_id, row_number() OVER (PARTITION BY key ORDER BY entity_id) FROM e
UNION ALL SELECT 'duplicate_link', link_id, row_number() OVER (PARTITION BY page_id, entity_id, relation ORDER BY link_id) FROM l UNION ALL SELECT 'missing_page', link_id, 2 FROM l WHERE page_id NOT IN (SELECT page_id FROM p) UNION ALL SELECT 'missing_entity', link_id, 2 FROM l WHERE entity_id NOT IN (SELECT entity_id FROM e))
SELECT kind, id::VARCHAR AS id FROM r WHERE n > 1""")
def snapshot_issues(spark: SparkSession, d: str) -> DataFrame:
    """Customers as pages, parts as entities, orders as links; some are not in the snapshot."""
    pages = table(spark, d, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("page_id"), F.col("c_acctbal").alias("paper_id"))
    entities = table(spark, d, "part").where("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("key"))
    links = table(spark, d, "orders").select(F.col("o_orderkey").alias("link_id"), F.col("o_custkey").alias("page_id"), (F.col("o_orderkey") % 200 + 1).alias("entity_id"), F.col("o_orderpriority").alias("relation"))
    return A.snapshot_issues(pages, entities, links)


@query("vector_issues", """SELECT 'page' AS kind, doc_id AS object_id, CASE WHEN vec_id IS NULL THEN 'vector_index_missing' ELSE 'vector_index_incompatible' END AS issue FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE vec_id IS NULL OR len(embedding) - vec_id % 2 <> 64""")
def vector_issues(spark: SparkSession, d: str) -> DataFrame:
    """Documents that need a vector of 64; every second one has lost a component."""
    v = table(spark, d, "embeddings").select(F.lit("page").alias("kind"), F.col("vec_id").alias("object_id"), F.slice("embedding", F.lit(1), (F.size("embedding") - F.col("vec_id") % 2).cast("int")).alias("vector"))
    return A.vector_issues(table(spark, d, "documents").select(F.lit("page").alias("kind"), F.col("doc_id").alias("object_id")), v, 64)


@query("supporting_links", """WITH c AS (SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')), e AS (SELECT p_partkey FROM part WHERE p_size > 5 AND p_partkey % 7 <> 0)
SELECT l_partkey AS evidence_id, list_sort(list(DISTINCT l_orderkey)) AS claim_ids FROM lineitem WHERE l_returnflag <> 'A' AND l_orderkey IN (SELECT * FROM c) AND l_partkey IN (SELECT * FROM e) GROUP BY 1""")
def supporting_links(spark: SparkSession, d: str) -> DataFrame:
    """Orders as claims, parts as evidence, their lines as links."""
    s = F.col("o_orderstatus")
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.when(s == "F", "Supported").when(s == "P", "accepted").otherwise("proposed").alias("status"))
    small, lost = F.col("p_size") <= 5, F.col("p_partkey") % 7 == 0
    evidence = table(spark, d, "part").select(F.col("p_partkey").alias("evidence_id"), F.when(small, "rejected").alias("status"), F.when(lost, False).alias("admitted"), F.lit(None).cast("boolean").alias("resolvable"), F.lit(True).alias("accessible"), F.col("p_name").alias("provenance"))
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("evidence_id"), F.when(F.col("l_returnflag") == "A", "refutes").when(F.col("l_returnflag") == "R", "supports").alias("relation"))
    return A.supporting_links(claims, evidence, links)


@query("put_once", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'added' WHEN o_orderstatus = 'P' THEN 'conflict' ELSE 'same' END AS outcome FROM orders""")
def put_once(spark: SparkSession, d: str) -> DataFrame:
    """Orders put again, those pending with another status."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    known = o.where("o_orderkey % 3 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return A.put_once(known, o, "o_orderkey", ["o_orderstatus", "o_custkey"]).select("o_orderkey", "outcome")


@query("search_fields", """SELECT l_orderkey AS paper_id, l_returnflag AS field_id, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_returnflag IN ('R', 'A') GROUP BY 1, 2, o_totalprice ORDER BY o_totalprice DESC, l_orderkey, CASE l_returnflag WHEN 'R' THEN 1 ELSE 2 END LIMIT 40""")
def search_fields(spark: SparkSession, d: str) -> DataFrame:
    """The first forty flags of finished orders, the dearest first."""
    fields = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_returnflag").alias("field_id")).agg(F.count("*").alias("n"))
    papers = table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"), F.struct(-F.col("o_totalprice"), "o_orderkey").alias("position"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("open").alias("status"))
    return A.search_fields(fields, papers, ["R", "A"], 40).select("paper_id", "field_id", "n")


@query("hit_papers", """WITH h AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'page' WHEN 'click' THEN 'entity' ELSE 'other' END AS t, user_id AS o FROM events),
g AS (SELECT event_id, o AS page FROM h WHERE t = 'page' UNION ALL SELECT event_id, o_orderkey FROM h JOIN orders ON o_custkey = o WHERE t = 'entity'),
f AS (SELECT event_id, o_custkey AS paper FROM g JOIN orders ON o_orderkey = page WHERE o_custkey % 2 = 0)
SELECT h.event_id AS hit_id, coalesce(list_sort(list(DISTINCT paper) FILTER (paper IS NOT NULL)), []) AS paper_ids FROM h LEFT JOIN f ON f.event_id = h.event_id GROUP BY 1""")
def hit_papers(spark: SparkSession, d: str) -> DataFrame:
    """Events as hits on orders (pages) or on customers (entities), even customers as members."""
    e = F.col("event_type")
    hits = table(spark, d, "events").select(F.col("event_id").alias("hit_id"), F.when(e == "view", "page").when(e == "click", "entity").otherwise("other").alias("type"), F.col("user_id").alias("object_id"))
    o = table(spark, d, "orders")
    members = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("paper_id"))
    return A.hit_papers(hits, o.select(F.col("o_orderkey").alias("page_id"), F.col("o_custkey").alias("paper_id")), o.select(F.col("o_orderkey").alias("page_id"), F.col("o_custkey").alias("entity_id")), members)


@query("timeline_artifacts", """WITH e AS (SELECT event_id, user_id % 5 AS run, CASE WHEN event_id % 3 <> 0 THEN user_id END AS s, event_id % 300 AS q FROM events)
SELECT event_id, 'q' || c.c_custkey AS question, CASE WHEN x.o_orderkey IS NOT NULL THEN x.o_orderpriority END AS query_text, CASE WHEN p.p_partkey % 50 % 5 = run AND (s IS NULL OR s = p.p_partkey % 50) THEN p.p_name END AS statement
FROM e LEFT JOIN customer c ON c.c_custkey = s AND c.c_custkey % 5 = run LEFT JOIN orders x ON x.o_orderkey = q AND x.o_custkey % 5 = run AND (s IS NULL OR s = x.o_custkey) LEFT JOIN part p ON p.p_partkey = q AND p.p_partkey % 50 IN (SELECT c_custkey FROM customer)""")
def timeline_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Events of runs that name customers (sessions), orders (queries) and parts (claims)."""
    events = table(spark, d, "events").select("event_id", (F.col("user_id") % 5).alias("run_id"), F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("session_id"), (F.col("event_id") % 300).alias("query_id"), (F.col("event_id") % 300).alias("claim_id"))
    sessions = table(spark, d, "customer").select(F.col("c_custkey").alias("session_id"), (F.col("c_custkey") % 5).alias("run_id"), F.concat(F.lit("q"), "c_custkey").alias("question"))
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("session_id"), F.col("o_orderpriority").alias("text"))
    claims = table(spark, d, "part").select(F.col("p_partkey").alias("claim_id"), (F.col("p_partkey") % 50).alias("session_id"), F.col("p_name").alias("text"))
    return A.timeline_artifacts(events, sessions, asked, claims)


_SELECTED = [("p#", "title", " A  Study # "), ("p#", "doi", " https://doi.org/10.1/ABC#. "), ("p#", "publication_year", "2020"), ("q#", "publication_year", "1700"), ("q#", "arxiv_id", "arXiv:2312.01234v2"), ("q#", "venue", " J "), ("q#", "abstract", " On #. ")]


@query("materialize", spread_sql("('p#', 'A  Study #', 'a study #', 'https://doi.org/10.1/ABC#.', '10.1/abc#', NULL, 2020, NULL, NULL), ('q#', NULL, NULL, NULL, NULL, '2312.01234v2', NULL, 'J', 'On #.')", "paper_id, title, normalized_title, doi, normalized_doi, arxiv_id, publication_year, venue, abstract", "paper_id, title, normalized_title, doi, normalized_doi, abstract"))
def materialize(spark: SparkSession, d: str) -> DataFrame:
    """Papers of candidates, a set for each supplier, worked out by hand."""
    return A.materialize(spread(spark, d, _SELECTED, "paper_id string, field string, value string"), 2026)


@query("author_rows", r"""WITH p AS (SELECT p_partkey, list_filter([p_brand, CASE WHEN p_size > 25 THEN ' ' ELSE p_name END, p_type], lambda x: trim(x) <> '') AS a FROM part)
SELECT p_partkey AS paper_id, generate_subscripts(a, 1)::INT AS author_order, unnest(a) AS full_name, lower(unnest(a)) AS normalized_name FROM p""")
def author_rows(spark: SparkSession, d: str) -> DataFrame:
    """Parts' labels as authors, some blank."""
    return A.author_rows(table(spark, d, "part").select(F.col("p_partkey").alias("paper_id"), F.array("p_brand", F.when(F.col("p_size") > 25, " ").otherwise(F.col("p_name")), "p_type").alias("authors")))


@query("provider_facts", """SELECT o_orderkey AS paper_id, o_orderstatus AS provider, CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 5 = 0 THEN 'doi_mismatch' END AS error, o_orderkey % 4 <> 0 AND o_orderkey % 6 <> 0 AND o_orderkey % 7 <> 0 AS complete FROM orders""")
def provider_facts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as answers of providers: some without a DOI, title or authors, some with another paper's DOI."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    doi = F.when(k % 4 != 0, F.concat(F.lit("https://doi.org/10.1/X"), F.when(k % 5 == 0, k + 1).otherwise(k)))
    parsed = o.select(k.alias("paper_id"), F.col("o_orderstatus").alias("provider"), doi.alias("doi"), F.when(k % 6 != 0, "t").otherwise("").alias("title"), F.when(k % 7 != 0, F.array().cast("array<string>")).alias("authors"), F.lit("2020").alias("year"))
    return A.provider_facts(parsed, o.select(k.alias("paper_id"), F.concat(F.lit("10.1/x"), k).alias("normalized_doi")))


@query("capabilities", """WITH w AS (SELECT n_nationkey AS k, n_regionkey <> 0 AS active, n_nationkey % 3 <> 0 AS bound, n_nationkey % 4 AS members, n_nationkey % 2 AS missing, ['ready', 'missing', 'stale', 'error'][n_nationkey % 4 + 1] AS s FROM nation),
b AS (SELECT *, active AND bound AND members > 0 AS build FROM w)
SELECT k AS workspace_id, array_to_string(list_filter([CASE WHEN active THEN 'paper_access' END, CASE WHEN active AND members > 0 THEN 'evidence_access' END, CASE WHEN active AND bound THEN 'schema_read' END, CASE WHEN build THEN 'wiki_build' END, CASE WHEN build AND s = 'ready' THEN 'wiki_read' END], lambda x: x IS NOT NULL), ',') AS can,
array_to_string(list_filter([CASE WHEN build AND missing > 0 THEN 'materialize_schema_runs' END, CASE WHEN build AND s = 'missing' THEN 'build_base_wiki' END, CASE WHEN build AND s = 'stale' THEN 'rebuild_base_wiki' END, CASE WHEN build AND s = 'error' THEN 'repair_base_wiki' END], lambda x: x IS NOT NULL), ',') AS todo FROM b""")
def capabilities(spark: SparkSession, d: str) -> DataFrame:
    """Nations as workspaces in several states."""
    k = F.col("n_nationkey")
    state = F.element_at(F.array(*map(F.lit, ["ready", "missing", "stale", "error"])), (k % 4 + 1).cast("int"))
    w = table(spark, d, "nation").select(k.alias("workspace_id"), F.when(F.col("n_regionkey") != 0, "active").otherwise("archived").alias("status"), (k % 3 != 0).alias("bound"), (k % 4).alias("members"), (k % 2).alias("missing_runs"), state.alias("wiki_status"))
    return A.capabilities(w).select("workspace_id", F.array_join("can", ",").alias("can"), F.array_join("todo", ",").alias("todo"))


@query("conversation_view", """SELECT conv_id AS conversation_id, turn AS sequence, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'pause_requested' WHEN o_orderstatus = 'O' THEN 'running' ELSE o_orderstatus END AS display_status FROM conversations LEFT JOIN orders ON o_orderkey = conv_id * 2 + turn""")
def conversation_view(spark: SparkSession, d: str) -> DataFrame:
    """Turns with the state of the order that stands for their run."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise(F.col("o_orderstatus")).alias("status"))
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("sequence"), (F.col("conv_id") * 2 + F.col("turn")).alias("run_id"))
    return A.conversation_view(turns, o, o.where("run_id % 2 = 0")).select("conversation_id", "sequence", "display_status")


@query("page_summaries", """SELECT p_partkey, p_name || CASE WHEN p_size > 25 THEN '' ELSE ' | Authors: ' || p_brand || ', ' || p_type END || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' | Year: ' || (2000 + p_size) END || ' | Fields: a=' || CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE p_size::VARCHAR END || ' [explicit]; b="x" [unclear]' AS summary FROM part""")
def page_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Parts as pages with two fields."""
    card = lambda f, v, s: F.struct(F.lit(f).alias("field_id"), v.alias("value"), F.lit(s).alias("status"))
    size = F.col("p_size")
    people = F.when(size > 25, F.array().cast("array<string>")).otherwise(F.array("p_brand", "p_type"))
    fields = F.array(card("a", F.when(F.col("p_partkey") % 3 != 0, size.cast("string")), "explicit"), card("b", F.lit('"x"'), "unclear"))
    return table(spark, d, "part").select("p_partkey", A.page_summary(F.col("p_name"), people, F.when(F.col("p_partkey") % 2 != 0, size + 2000), fields).alias("summary"))
