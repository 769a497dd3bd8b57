"""Record queries: normalization, candidates, duplicates, joins and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import ledger, matching, records
from lexmill.plans.cases import spread, spread_sql
from lexmill.registry import query
from lexmill.sources.tables import table

_DASH = T.DASHES


@query("title_normalize", f"""SELECT doc_id, nullif(trim(trim(regexp_replace(regexp_replace(lower(string_split(text, chr(10))[1]), '[{_DASH}]+', ' ', 'g'), '\\s+', ' ', 'g')), '.,;:!?"''()[]{{}}'), '') AS title FROM documents""")
def title_normalize(spark: SparkSession, d: str) -> DataFrame:
    """First line of each document as a normalized title."""
    first = F.element_at(F.split("text", "\n"), 1)
    return table(spark, d, "documents").select("doc_id", T.normalize_title(first).alias("title"))


_IDS = [" https://doi.org/10.1/ABC#. ", "doi:10.1000/xyz#;", "http://dx.doi.org/10.5/Q#", "10.7/plain.#", " ", "arXiv:2313.01234", "2312.01234v2", "2301.00001", "arxiv: 2301.123", "https://dx.doi.org/doi:10.#/x"]


@query("identifier_normalize", f"""WITH v AS ({spread_sql(", ".join(f"('{x}')" for x in _IDS), "raw", "raw")})
SELECT raw, nullif(rtrim(trim(regexp_replace(lower(trim(raw)), '^(https://doi\\.org/|http://dx\\.doi\\.org/|https://dx\\.doi\\.org/|doi:)', '')), '.,;:'), '') AS doi,
  coalesce(regexp_matches(nullif(trim(regexp_replace(lower(trim(raw)), '^arxiv:', '')), ''), '^[0-9]{{2}}(0[1-9]|1[0-2])\\.[0-9]{{4,5}}(v[0-9]+)?$'), false) AS arxiv_ok FROM v""")
def identifier_normalize(spark: SparkSession, d: str) -> DataFrame:
    """DOI and arXiv forms with suppliers' keys in them."""
    return spread(spark, d, [(x,) for x in _IDS], "raw string").select("raw", T.normalize_doi(F.col("raw")).alias("doi"), T.valid_arxiv(F.col("raw")).alias("arxiv_ok"))


@query("html_text", r"SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')))::BIGINT AS n, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    """Length and digest of each page without its tags."""
    t = T.strip_tags(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(t).cast("long").alias("n"), F.sha2(t, 256).alias("digest"))


@query("stable_ids", "SELECT c_custkey, 'entity_' || sha256('entity' || chr(31) || c_mktsegment || chr(31) || c_name) AS entity_id FROM customer")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", T.stable_id("entity", F.col("c_mktsegment"), F.col("c_name")).alias("entity_id"))


@query("exact_duplicates", "SELECT sha256(text) AS sha256, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return records.exact_duplicates(table(spark, d, "documents"), "doc_id", F.col("text"))


@query("secret_scan", r"SELECT doc_id, len(regexp_extract_all(text, 'AKIA[0-9A-Z]{16}'))::BIGINT AS key_shaped, regexp_matches(text, '(?i)(password|token|secret)\s*[=:]') AS named FROM documents WHERE regexp_matches(text, 'AKIA[0-9A-Z]{16}') OR regexp_matches(text, '(?i)(password|token|secret)\s*[=:]')")
def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold key-shaped values or named secrets."""
    shape, named = "AKIA[0-9A-Z]{16}", r"(?i)(password|token|secret)\s*[=:]"
    docs = table(spark, d, "documents").where(F.col("text").rlike(shape) | F.col("text").rlike(named))
    return docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(shape), F.lit(0))).cast("long").alias("key_shaped"), F.col("text").rlike(named).alias("named"))


@query("candidate_argmax", """SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (
SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END, l_quantity DESC, l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_discount, l_tax) AS rn FROM lineitem) WHERE rn = 1""")
def candidate_argmax(spark: SparkSession, d: str) -> DataFrame:
    """One line of each order and flag, by tier, quantity as confidence, price as recency, then ids."""
    lines = table(spark, d, "lineitem")
    order = [F.when(F.col("l_linestatus") == "F", 0).otherwise(1), F.col("l_quantity").desc(), F.col("l_extendedprice").desc(), *map(F.col, ("l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax"))]
    return records.argmax(lines, ["l_orderkey", "l_returnflag"], order).select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query("candidate_trace", "SELECT l_orderkey, count(*) AS candidates, bool_or(l_returnflag = 'R') AS any_selected, max(l_quantity) AS best FROM lineitem GROUP BY 1")
def candidate_trace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("candidates"), F.bool_or(F.col("l_returnflag") == "R").alias("any_selected"), F.max("l_quantity").alias("best"))


@query("provider_priority", """SELECT p_partkey, coalesce(a.s, b.s) AS price FROM part LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a ON a.l_partkey = p_partkey LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON b.l_partkey = p_partkey""")
def provider_priority(spark: SparkSession, d: str) -> DataFrame:
    """Best value of the first provider that has one, in one pass over the providers' rows."""
    best = table(spark, d, "lineitem").where("l_returnflag in ('A', 'R')").groupBy("l_partkey").agg(F.coalesce(F.max(F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice"))), F.max("l_extendedprice")).alias("price"))
    return table(spark, d, "part").join(best, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "price")


@query("listing_page", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def listing_page(spark: SparkSession, d: str) -> DataFrame:
    """Third page of a filtered listing, newest price first."""
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(100).limit(50)


@query("citation_resolve", "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def citation_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the names behind their keys."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("o_orderkey", "c_name", "n_name", "r_name")


@query("orphan_scan", "SELECT p_partkey AS key, 'part' AS kind FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT s_suppkey, 'supplier' FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem) UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT doc_id, 'document' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT o_orderkey, 'order' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphan_scan(spark: SparkSession, d: str) -> DataFrame:
    """Parts, suppliers, customers, orders and documents that nothing refers to: not sold, not ordered, without lines, not labelled."""
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    part = records.orphans(table(spark, d, "part").withColumn("l_partkey", F.col("p_partkey")), line, "l_partkey").select(F.col("p_partkey").alias("key"), F.lit("part").alias("kind"))
    supplier = records.orphans(table(spark, d, "supplier").withColumn("l_suppkey", F.col("s_suppkey")), line, "l_suppkey").select(F.col("s_suppkey").alias("key"), F.lit("supplier").alias("kind"))
    customer = records.orphans(table(spark, d, "customer").withColumn("o_custkey", F.col("c_custkey")), orders, "o_custkey").select(F.col("c_custkey").alias("key"), F.lit("customer").alias("kind"))
    document = records.orphans(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("key"), F.lit("document").alias("kind"))
    order = records.orphans(orders.withColumn("l_orderkey", F.col("o_orderkey")), line, "l_orderkey").select(F.col("o_orderkey").alias("key"), F.lit("order").alias("kind"))
    return part.unionByName(supplier).unionByName(customer).unionByName(document).unionByName(order)


@query("related_entities", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_shared FROM lineitem WHERE l_suppkey <> 1 AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1) GROUP BY 1")
def related_entities(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that share parts with supplier 1."""
    return records.related(table(spark, d, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey", 1)


@query("reference_audit", """SELECT l_orderkey AS link_id, 'dangling_page' AS issue FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT l_orderkey, 'dangling_entity' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT l_orderkey, 'duplicate_id' FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def reference_audit(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose order or part is missing, and ids that occur twice."""
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("link_id"), F.col("l_orderkey").alias("page_id"), F.col("l_partkey").alias("entity_id"))
    return records.audit_references(links, table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id")), table(spark, d, "part").select(F.col("p_partkey").alias("entity_id")))


@query("gate_blockers", """SELECT p_partkey, list_filter([CASE WHEN p_retailprice >= 1000 THEN NULL ELSE 'price' END, CASE WHEN p_size <= 25 THEN NULL ELSE 'size' END, CASE WHEN n IS NOT NULL THEN NULL ELSE 'unsold' END], lambda x: x IS NOT NULL) AS blockers,
p_retailprice >= 1000 AND p_size <= 25 AND n IS NOT NULL AS ready FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def gate_blockers(spark: SparkSession, d: str) -> DataFrame:
    """Ordered reasons why a part does not pass a gate."""
    sold = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    rows = table(spark, d, "part").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left")
    checks = [("price", F.col("p_retailprice") >= 1000), ("size", F.col("p_size") <= 25), ("unsold", F.col("n").isNotNull())]
    return ledger.blockers(rows, checks).select("p_partkey", "blockers", "ready")


@query("promotion_new", "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'O')")
def promotion_new(spark: SparkSession, d: str) -> DataFrame:
    """Orders without an open line: runs that were not processed yet."""
    done = table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"))
    return records.orphans(table(spark, d, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")))
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
    parts = [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("paper_detail", """SELECT o_orderkey, o_totalprice, list({'part': l_partkey, 'quantity': l_quantity} ORDER BY l_partkey, l_quantity, l_extendedprice) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def paper_detail(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their lines nested, in order of part and quantity."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity")))).alias("lines"))
    return table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_totalprice", "lines")


def _titled(spark: SparkSession, d: str) -> DataFrame:
    """documents as records: the normalized first line as title, the language as author."""
    first = T.normalize_title(F.substring_index("text", "\n", 1))
    none = F.lit(None).cast("string")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), none.alias("doi"), none.alias("arxiv"), first.alias("title"), F.array("lang").alias("authors"))


@query("near_dup_classes", f"""WITH t AS (SELECT doc_id AS id, lang, nullif(trim(trim(regexp_replace(regexp_replace(lower(string_split(text, chr(10))[1]), '[{_DASH}]+', ' ', 'g'), '\\s+', ' ', 'g')), '.,;:!?"''()[]{{}}'), '') AS title FROM documents)
SELECT id, CASE WHEN title IS NOT NULL THEN min(id) OVER (PARTITION BY title, lang) END AS title_class, CASE WHEN title IS NOT NULL THEN count(*) OVER (PARTITION BY title, lang) END AS title_size FROM t""")
def near_dup_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one first line and language as classes, a row a document."""
    return matching.record_classes(_titled(spark, d)).select("id", "title_class", "title_size")


@query("near_dup_pairs")
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classes of one language whose first lines are alike; letters are compared one by one, so tests check it against all pairs."""
    return matching.similar_records(_titled(spark, d), least=0.95, shared=0)
