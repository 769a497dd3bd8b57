"""Workflow operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import workflow as W
from lexmill.plans.cases import spread, spread_sql
from lexmill.registry import query
from lexmill.sources.tables import table


@query("below_target", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice / 300000.0 < 0.9")
def below_target(spark: SparkSession, d: str) -> DataFrame:
    """Finished orders whose price, over a scale, is under the target recall."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit("hybrid_rerank").alias("variant"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("open").alias("status"), (F.col("o_totalprice") / 300000.0).alias("recall"))
    return W.below_target(rows).select("o_orderkey", "o_totalprice")


@query("recall_episodes", r"""WITH s AS (SELECT conv_id * 1000 + turn AS memory_id, turn AS created_at, len(list_intersect(['help', 'the', 'with', 'please'], regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) / 4 AS relevance FROM conversations)
SELECT memory_id, created_at, round(relevance, 6)::DOUBLE AS relevance FROM s WHERE relevance > 0 ORDER BY relevance DESC, created_at, memory_id LIMIT 50""")
def recall_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Turns that share most words with a stated query, the oldest first."""
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("memory_id"), F.col("turn").alias("created_at"), "text")
    return W.recall_episodes(rows, "Help the with please", 50).select("memory_id", "created_at", F.round("relevance", 6).alias("relevance"))


@query("topic_match", r"""WITH e AS (SELECT p_size AS ws, p_partkey AS id, p_name AS title, list_distinct(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+')) AS w FROM part WHERE p_partkey % 2 = 0),
t AS (SELECT p_size AS ws, p_partkey AS id, p_name AS title, list_distinct(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+')) AS w FROM part WHERE p_partkey % 2 = 1),
s AS (SELECT t.ws AS workspace_id, t.id AS title_id, e.id AS entry_id, CASE WHEN lower(trim(t.title)) = lower(trim(e.title)) THEN 1.0 ELSE len(list_intersect(t.w, e.w)) / len(list_distinct(list_concat(t.w, e.w))) END::DOUBLE AS score FROM t JOIN e ON e.ws = t.ws AND len(list_intersect(t.w, e.w)) > 0)
SELECT workspace_id, title_id, entry_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, title_id ORDER BY score DESC, entry_id) AS rn FROM s WHERE score >= 0.6) WHERE rn = 1""")
def topic_match(spark: SparkSession, d: str) -> DataFrame:
    """For each odd part the even part of its size whose name is about the same."""
    part = table(spark, d, "part").select(F.col("p_size").alias("workspace_id"), "p_partkey", F.col("p_name").alias("title"))
    even, odd = part.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "entry_id"), part.where("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "title_id")
    return W.best_topic_match(even, odd).withColumn("score", F.round("score", 6))


@query("fan_out", """WITH l AS (SELECT o_orderpriority AS query_id, o_custkey AS paper_id, o_orderkey AS chunk_id, o_totalprice AS global_score, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS local_rank FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY global_score DESC, paper_id, chunk_id) AS rank FROM l WHERE local_rank <= 2)
SELECT query_id, paper_id, chunk_id, global_score, local_rank, rank FROM r WHERE rank <= 25""")
def fan_out(spark: SparkSession, d: str) -> DataFrame:
    """The two latest orders of each customer and priority, then the 25 dearest of each priority."""
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("query_id"), F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("chunk_id"), F.col("o_orderdate").alias("local_score"), F.col("o_totalprice").alias("global_score"))
    return W.fan_out(rows, 2, 25).drop("local_score")


@query("evidence_numbers", "SELECT o_custkey, o_orderkey, 'E' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS evidence_id FROM orders")
def evidence_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Orders of each customer numbered E1, E2, ... by priority."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("rank"))
    return W.number_candidates(rows, ["o_custkey"], ["o_orderkey"]).drop("rank")


@query("converge_endpoints", """WITH p AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < 2000 THEN 'duplicate_candidate' ELSE 'archived' END AS status FROM customer),
r AS (SELECT o_custkey AS a, o_orderkey % 1500 + 1 AS b FROM orders WHERE o_orderstatus = 'P'),
o AS (SELECT a AS id FROM r UNION SELECT b FROM r)
SELECT id, CASE WHEN status = 'duplicate_candidate' AND id NOT IN (SELECT id FROM o WHERE id IS NOT NULL) THEN 'active' ELSE status END AS status FROM p""")
def converge_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Customers as papers, orders as relations, pending ones still open."""
    papers = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 2000, "duplicate_candidate").otherwise("archived").alias("status"))
    relations = table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), (F.col("o_orderkey") % 1500 + 1).alias("target_id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("decided").alias("status"))
    return W.converge_endpoints(papers, relations)


@query("distinct_candidates", r"""WITH c AS (SELECT event_id, user_id AS paper_id, event_type, lower(trim(regexp_replace(event_type || CASE WHEN event_id % 2 = 0 THEN '  A ' ELSE ' a' END, '\s+', ' ', 'g'))) AS v FROM events)
SELECT paper_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, v ORDER BY event_id) AS rn FROM c) WHERE rn = 1""")
def distinct_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Events as candidates of a free field, equal but for case and blanks."""
    value = F.concat("event_type", F.when(F.col("event_id") % 2 == 0, "  A ").otherwise(" a"))
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("paper_id"), F.lit(1).alias("file_id"), F.lit("venue").alias("field"), value.alias("value"), F.lit("t").alias("source_type"), F.lit("l").alias("source_location"))
    return W.distinct_candidates(rows, ["event_id"]).select("paper_id", "event_id")


@query("set_primary", """WITH f AS (SELECT o_custkey AS paper_id, o_orderkey AS file_id, o_orderstatus = 'O' AS is_primary FROM orders), c AS (SELECT paper_id, max(file_id) AS chosen FROM f WHERE paper_id % 3 = 0 GROUP BY 1)
SELECT f.paper_id, file_id, CASE WHEN chosen IS NULL THEN is_primary ELSE file_id = chosen END AS is_primary FROM f LEFT JOIN c ON c.paper_id = f.paper_id""")
def set_primary(spark: SparkSession, d: str) -> DataFrame:
    """Orders as files; every third customer makes the last one primary."""
    files = table(spark, d, "orders").select(F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("file_id"), (F.col("o_orderstatus") == "O").alias("is_primary"))
    return W.set_primary(files, files.where("paper_id % 3 = 0").groupBy("paper_id").agg(F.max("file_id").alias("file_id")))


@query("build_fingerprints", """WITH m AS (SELECT DISTINCT c_nationkey AS w, c_custkey AS p FROM customer), r AS (SELECT o_custkey AS p, max(o_orderkey) AS run FROM orders GROUP BY 1),
j AS (SELECT w, m.p, run FROM m LEFT JOIN r ON r.p = m.p)
SELECT w AS workspace_id, sha256('{"membership":[' || string_agg(p::VARCHAR, ',' ORDER BY p) || '],"schema":{"hash":"h","id":"s","version":"1"},"schema_runs":[' || string_agg('{"paper_id":' || p || ',"run_id":' || coalesce(run::VARCHAR, 'null') || '}', ',' ORDER BY p) || '],"workspace_id":' || w || '}') AS fingerprint FROM j GROUP BY w""")
def build_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Nations as workspaces of customers, the last order as each one's run."""
    members = table(spark, d, "customer").select(F.col("c_nationkey").alias("workspace_id"), F.lit("s").alias("schema_id"), F.lit("1").alias("schema_version"), F.lit("h").alias("schema_hash"), F.col("c_custkey").alias("paper_id"))
    return W.build_fingerprints(members, table(spark, d, "orders").select(F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("run_id")))


@query("collect_episodes", """WITH a AS (SELECT DISTINCT l_orderkey AS q FROM lineitem WHERE l_returnflag = 'R'), g AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AND o_orderkey IN (SELECT q FROM a) AS good FROM orders)
SELECT o_custkey AS run_id, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (good), []) AS useful, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (NOT good), []) AS failed FROM g GROUP BY 1""")
def collect_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Customers as runs, orders as their queries, returned lines as admitted evidence."""
    asked = table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("query_id"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"))
    return W.collect_episodes(asked, table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("source_query_id")))


@query("membership_revisions", """WITH c AS (SELECT user_id AS workspace_id, event_type AS paper_id, event_id AS "at", CASE WHEN value > 50 THEN 'add' ELSE 'remove' END AS op FROM events),
l AS (SELECT *, coalesce(lag(op) OVER (PARTITION BY workspace_id, paper_id ORDER BY "at"), 'remove') AS was FROM c)
SELECT workspace_id, paper_id, op, "at", row_number() OVER (PARTITION BY workspace_id ORDER BY "at", paper_id) AS revision FROM l WHERE op <> was""")
def membership_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Events as changes of a user's members."""
    return W.membership_revisions(table(spark, d, "events").select(F.col("user_id").alias("workspace_id"), F.col("event_type").alias("paper_id"), F.when(F.col("value") > 50, "add").otherwise("remove").alias("op"), F.col("event_id").alias("at")))


@query("reconcile_turns", """WITH t AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'O' THEN 'created' WHEN 'F' THEN 'completed' ELSE 'cancelled' END AS run_status, CASE WHEN o_custkey % 2 = 0 THEN 'preparing' ELSE 'done' END AS turn_status, o_totalprice > 100000 AS has_answer FROM orders)
SELECT run_id, CASE WHEN run_id % 10 <> 0 AND run_status = 'created' AND turn_status = 'preparing' THEN 'failed' ELSE run_status END AS new_run,
CASE WHEN run_id % 10 = 0 OR turn_status = 'done' THEN turn_status WHEN run_status = 'completed' AND has_answer THEN 'completed' ELSE 'failed' END AS new_turn FROM t""")
def reconcile_turns(spark: SparkSession, d: str) -> DataFrame:
    """Orders as runs with a turn each; every tenth is still active."""
    state = F.when(F.col("o_orderstatus") == "O", "created").when(F.col("o_orderstatus") == "F", "completed").otherwise("cancelled")
    turns = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), state.alias("run_status"), F.when(F.col("o_custkey") % 2 == 0, "preparing").otherwise("done").alias("turn_status"), (F.col("o_totalprice") > 100000).alias("has_answer"))
    return W.reconcile_turns(turns, turns.where("run_id % 10 = 0")).select("run_id", "new_run", "new_turn")


@query("in_use", "SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal >= 9000)")
def in_use(spark: SparkSession, d: str) -> DataFrame:
    """Parts that a supplier of means has delivered."""
    spaces = table(spark, d, "supplier").select(F.col("s_suppkey").alias("workspace_id"), F.when(F.col("s_acctbal") < 9000, "deleted").otherwise("active").alias("status"))
    return W.in_use(table(spark, d, "part").select(F.col("p_partkey").alias("id")), table(spark, d, "lineitem").select(F.col("l_suppkey").alias("workspace_id"), F.col("l_partkey").alias("paper_id")), spaces)


@query("maintenance_items", """SELECT 'no_order' AS kind, c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'no_label', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def maintenance_items(spark: SparkSession, d: str) -> DataFrame:
    """Customers without a pending order, documents without a label."""
    key = lambda t, c: table(spark, d, t).select(F.col(c).alias("key"))
    pending = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key"))
    return W.maintenance_items({"no_order": (key("customer", "c_custkey"), pending), "no_label": (key("documents", "doc_id"), key("labels", "doc_id"))}, "key")


@query("import_trace", """WITH s AS (SELECT o_orderkey AS paper_id, unnest([1, 2, 3, 4, 5, 6]) AS n FROM orders), f AS (SELECT paper_id, n, CASE WHEN n = 3 AND paper_id % 4 = 0 THEN NULL ELSE n <> 5 OR paper_id % 7 <> 0 END AS ok FROM s),
b AS (SELECT *, min(CASE WHEN ok THEN 9 ELSE n END) OVER (PARTITION BY paper_id) AS bad FROM f)
SELECT paper_id, string_agg(['stored', 'read', 'candidates', 'selected', 'identity', 'gate'][n] || ':' || CASE WHEN n > bad THEN 'skipped' WHEN ok THEN 'done' WHEN ok IS NULL THEN 'pending' ELSE 'failed' END, ',' ORDER BY n) AS steps FROM b GROUP BY 1""")
def import_trace(spark: SparkSession, d: str) -> DataFrame:
    """Orders as imports that wait for candidates or fail in identity."""
    k, yes = F.col("o_orderkey"), F.lit(True)
    jobs = table(spark, d, "orders").select(k.alias("paper_id"), yes.alias("stored"), yes.alias("read"), F.when(k % 4 != 0, yes).alias("candidates"), yes.alias("selected"), (k % 7 != 0).alias("identity"), yes.alias("gate"))
    return W.import_trace(jobs).select("paper_id", F.array_join(F.transform("steps", lambda s: F.concat(s["step"], F.lit(":"), s["state"])), ",").alias("steps"))


@query("clean_aliases", r"""WITH s AS (SELECT p_brand AS id, trim(regexp_replace(p_type, '\s+', ' ', 'g')) AS s, p_partkey AS pos FROM part), f AS (SELECT id, lower(s) AS k, arg_min(s, pos) AS s, min(pos) AS pos FROM s GROUP BY 1, 2)
SELECT id AS entity_id, coalesce(list(s ORDER BY pos) FILTER (s <> '' AND k <> 'economy'), []) AS aliases FROM f GROUP BY 1""")
def clean_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Brands with the types they come in, as aliases."""
    return W.clean_aliases(table(spark, d, "part").select(F.col("p_brand").alias("entity_id"), F.lit("Economy").alias("canonical"), F.col("p_type").alias("spelling"), F.col("p_partkey").alias("pos")))


@query("gold_structure", """WITH g AS (SELECT doc_id, list_filter([CASE WHEN source IS NULL OR source = '' THEN 'empty_paper' END, CASE WHEN text IS NULL OR text = '' THEN 'empty_query' END, CASE WHEN lang IS NULL OR lang NOT IN ('en', 'fr') THEN 'illegal_type' END, CASE WHEN doc_id % 5 = 0 THEN 'no_gold_blocks' END, CASE WHEN doc_id % 5 = 1 THEN 'empty_block_id' END], lambda x: x IS NOT NULL) AS issues FROM documents)
SELECT doc_id AS query_id, issues FROM g WHERE len(issues) > 0""")
def gold_structure(spark: SparkSession, d: str) -> DataFrame:
    """Documents as gold queries: their language as type, blocks by their id."""
    r = F.col("doc_id") % 5
    ids = F.when(r == 0, F.array().cast("array<string>")).when(r == 1, F.array(F.lit(""))).otherwise(F.array(F.lit("b")))
    return W.gold_structure(table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("source").alias("paper_id"), F.col("text").alias("query"), F.col("lang").alias("query_type"), ids.alias("gold_block_ids")), ["en", "fr"])


@query("select_one", """SELECT o_custkey, o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) ELSE false END AS is_selected FROM orders""")
def select_one(spark: SparkSession, d: str) -> DataFrame:
    """Every second customer selects the last order."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lit(False).alias("is_selected"))
    return W.select_one(o, o.where("o_custkey % 2 = 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey")), "o_custkey", "o_orderkey")


@query("commit_promotions", "SELECT l_orderkey AS run_id, count(*) AS entries FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def commit_promotions(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders that are not finished."""
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id"))
    return W.commit_promotions(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id")), done).groupBy("run_id").agg(F.count("*").alias("entries"))


@query("compatible_runs", "SELECT c_custkey AS paper_id, n_regionkey IS NOT NULL AND c_nationkey % 5 <> 0 AND c_mktsegment = 'BUILDING' AND (CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 1 END) IS NOT DISTINCT FROM (CASE WHEN c_nationkey % 2 = 0 THEN NULL ELSE 1 END) AS compatible FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def compatible_runs(spark: SparkSession, d: str) -> DataFrame:
    """Customers as runs, nations as workspaces, every fifth without a binding."""
    runs = table(spark, d, "customer").select(F.col("c_nationkey").alias("workspace_id"), F.col("c_custkey").alias("paper_id"), F.col("c_mktsegment").alias("schema_id"), F.when(F.col("c_custkey") % 3 != 0, 1).alias("version"), F.lit("h").alias("hash"))
    bound = table(spark, d, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("workspace_id"), F.lit("BUILDING").alias("schema_id"), F.when(F.col("n_nationkey") % 2 != 0, 1).alias("version"), F.lit("h").alias("hash"))
    return W.compatible_runs(runs, bound).select("paper_id", "compatible")


@query("line_map", """WITH s AS (SELECT conv_id, turn, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS n FROM conversations), e AS (SELECT *, sum(n + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS last_line FROM s WHERE n > 0)
SELECT conv_id, turn, (last_line - n)::BIGINT AS first_line, last_line::BIGINT AS last_line FROM e""")
def line_map(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each turn in its conversation as rendered."""
    turns = table(spark, d, "conversations")
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return W.line_map(turns, "conv_id", "turn", lines).select("conv_id", "turn", F.col("first_line").cast("long"), F.col("last_line").cast("long"))


_VALUES = [(1, '"a#"', "string"), (2, "3#", "number"), (3, "true", "number"), (4, "true", "boolean"), (5, "[1, #]", "list"), (6, '{"a":#}', "object"), (7, "null", "number"), (8, '"x"', "enum"), (9, '"y#"', "enum"), (10, "2.5#1", "number"), (11, '""', "string"), (12, "[]", "list"), (13, "{}", "object"), (14, "{oops#", "object")]
_SQL_VALUES = spread_sql(", ".join(f"({i}, '{v}', '{t}')" for i, v, t in _VALUES), "id, v, t", "v", "id")


@query("value_types", f"""WITH v AS (SELECT id, v, t, CASE WHEN json_valid(v) THEN json_type(v) END AS j FROM ({_SQL_VALUES}))
SELECT id::BIGINT AS id, coalesce(j = 'NULL' OR CASE t WHEN 'string' THEN j = 'VARCHAR' WHEN 'number' THEN j IN ('UBIGINT', 'BIGINT', 'DOUBLE') WHEN 'boolean' THEN j = 'BOOLEAN' WHEN 'list' THEN j = 'ARRAY' WHEN 'object' THEN j = 'OBJECT' WHEN 'enum' THEN v = '"x"' END, false) AS fits, v NOT IN ('null', '""', '[]', '{{}}') AS says FROM v""")
def value_types(spark: SparkSession, d: str) -> DataFrame:
    """JSON values with suppliers' keys in them: whether each has its field's type, and whether it says something."""
    rows = spread(spark, d, _VALUES, "id long, v string, t string", "id")
    return rows.select("id", W.json_matches_type(F.col("v"), F.col("t"), F.array(F.lit("x"))).alias("fits"), W.is_assertive(F.col("v")).alias("says"))


@query("field_queries", "SELECT p_partkey, array_to_string(list_filter([trim(p_brand), trim(p_name), trim(CASE WHEN p_size > 25 THEN ' ' ELSE p_type END)], lambda x: x <> ''), ' | ') AS q FROM part")
def field_queries(spark: SparkSession, d: str) -> DataFrame:
    """Parts' labels joined into query texts."""
    return table(spark, d, "part").select("p_partkey", W.field_query(F.col("p_brand"), F.col("p_name"), F.when(F.col("p_size") > 25, " ").otherwise(F.col("p_type"))).alias("q"))


_FILES = ["2312.01234v#.pdf", "2313.0123#.pdf", "arXiv_1706.03762.pdf#", "notes#.2312.01234.pdf", "2312.01234", "#.pdf", "", "arxiv-2401.00001v1#.x"]


@query("filename_ids", spread_sql("('2312.01234v#.pdf', '2312.01234v#'), ('2313.0123#.pdf', NULL), ('arXiv_1706.03762.pdf#', '1706.03762'), ('notes#.2312.01234.pdf', NULL), ('2312.01234', NULL), ('#.pdf', NULL), ('', NULL), ('arxiv-2401.00001v1#.x', '2401.00001v1#')", "name, arxiv", "name, arxiv"))
def filename_ids(spark: SparkSession, d: str) -> DataFrame:
    """arXiv ids of file names with suppliers' keys in them, worked out by hand."""
    return spread(spark, d, [(f,) for f in _FILES], "name string").select("name", W.filename_arxiv(F.col("name")).alias("arxiv"))


_MESSAGES = [
    (1, '{"message":{"title":["A study of #"],"author":[{"given":"Ann","family":"Lee"},{"family":"Ode"},{}],"issued":{"date-parts":[[2021,4]]},"container-title":["J"],"publisher":"P#","DOI":"10.1/X#","abstract":"<jats:p>On  buses #.</jats:p>"}}'),
    (2, '{"message":{"published-print":{"date-parts":[[2019]]},"issued":{"date-parts":[[2018]]}}}'),
    (3, "not json"),
]


@query("provider_fields", spread_sql("(1::BIGINT, 'A study of #', 'Ann Lee;Ode', 2021, 'J', 'P#', '10.1/X#', 'On buses #.'), (2, NULL, '', 2019, NULL, NULL, NULL, NULL), (3, NULL, '', NULL, NULL, NULL, NULL, NULL)", "id, title, authors, year, venue, publisher, doi, abstract", "title, publisher, doi, abstract", "id"))
def provider_fields(spark: SparkSession, d: str) -> DataFrame:
    """Unified fields of providers' messages with suppliers' keys in them, worked out by hand."""
    rows = spread(spark, d, _MESSAGES, "id long, raw string", "id").select("id", W.crossref_fields(F.col("raw")).alias("f"))
    return rows.select("id", "f.title", F.array_join("f.authors", ";").alias("authors"), "f.year", "f.venue", "f.publisher", "f.doi", "f.abstract")


_WORKS = [
    ("openalex", '{"display_name":"A study #","authorships":[{"author":{"display_name":"Ann Lee"}},{"author":null},{}],"publication_year":2021,"primary_location":{"source":{"display_name":"J"}},"doi":"https://doi.org/10.1/X"}'),
    ("openalex", "[]"),
    ("openalex", '{"title":"C","primary_location":null,"locations":[{"source":null},{"source":{"display_name":"L"}}]}'),
    ("semantic", '{"title":"B study","authors":[{"name":"Bo Ode #"},{"name":""}],"year":2019,"venue":"","journal":"K","externalIds":{"DOI":"10.1/Y"}}'),
    ("semantic", "not json"),
]


@query("provider_works", spread_sql("('openalex', 'A study #', 'Ann Lee', 2021, 'J', 'https://doi.org/10.1/X'), ('openalex', NULL, '', NULL, NULL, NULL), ('openalex', 'C', '', NULL, 'L', NULL), ('semantic', 'B study', 'Bo Ode #', 2019, 'K', '10.1/Y'), ('semantic', NULL, '', NULL, NULL, NULL)", "provider, title, authors, year, venue, doi", "title, authors"))
def provider_works(spark: SparkSession, d: str) -> DataFrame:
    """Unified fields of works of the other two providers with suppliers' keys in them, worked out by hand."""
    rows = spread(spark, d, _WORKS, "provider string, raw string")
    f = F.when(F.col("provider") == "openalex", W.openalex_fields(F.col("raw"))).otherwise(W.semantic_scholar_fields(F.col("raw")))
    return rows.select("provider", f.alias("f")).select("provider", "f.title", F.array_join("f.authors", ";").alias("authors"), "f.year", "f.venue", "f.doi")
