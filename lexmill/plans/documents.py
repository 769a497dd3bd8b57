"""Document queries: chunks, duplicate ratios, coverage, section paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import chunking, documents
from lexmill.registry import query
from lexmill.sources.tables import table


def _lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("order", "text"))


_TOKENS = """(len(regexp_extract_all({0}, '[A-Za-z0-9]+(?:[''\\-][A-Za-z0-9]+)*')) + len(regexp_extract_all({0}, '[一-鿿぀-ヿ]')))"""


@query("chunk_pack", f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS ord, unnest(string_split(text, chr(10))) AS t FROM documents),
n AS (SELECT *, {_TOKENS.format("t")} AS n FROM l),
s AS (
  SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id, ord ORDER BY i) AS i, x, {_TOKENS.format("x")} AS n
  FROM (SELECT doc_id, ord, unnest(range(len(xs))) AS i, unnest(xs) AS x FROM (SELECT *, regexp_extract_all(t, '[^.!?]*[.!?][ ]*|[^.!?]+') AS xs FROM n WHERE n > 900))),
j AS (
  SELECT doc_id, ord, i, x, 1 AS g, n AS held FROM s WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.ord, s.i, s.x, CASE WHEN j.held + s.n <= 900 THEN j.g ELSE j.g + 1 END, CASE WHEN j.held + s.n <= 900 THEN j.held + s.n ELSE s.n END
  FROM j JOIN s ON s.doc_id = j.doc_id AND s.ord = j.ord AND s.i = j.i + 1),
w AS (SELECT doc_id, ord, g, string_agg(x, '' ORDER BY i) AS t FROM j GROUP BY doc_id, ord, g),
p AS (SELECT *, CASE WHEN length(t) > 1 THEN greatest(1, ({_TOKENS.format("t")} + 899) // 900) ELSE 1 END AS parts FROM w),
q AS (SELECT *, greatest(1, length(t) // parts) AS size, unnest(range(parts)) AS k FROM p),
f AS (SELECT doc_id, ord, g * 100000 + k AS sub, CASE WHEN k = parts - 1 THEN substr(t, k * size + 1) ELSE substr(t, k * size + 1, size) END AS t, true AS part FROM q),
u AS (
  SELECT doc_id, ord, t, part, {_TOKENS.format("t")} AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ord, sub) AS rn
  FROM (SELECT doc_id, ord, 0 AS sub, t, false AS part FROM n WHERE n <= 900 UNION ALL SELECT doc_id, ord, sub, t, part FROM f)),
c AS (
  SELECT doc_id, rn, ord, t, n, part, 1 AS chunk_no, n AS held FROM u WHERE rn = 1
  UNION ALL
  SELECT u.doc_id, u.rn, u.ord, u.t, u.n, u.part,
    CASE WHEN u.part OR c.part OR c.held + u.n > 900 OR (c.held + u.n > 650 AND c.held >= 400) THEN c.chunk_no + 1 ELSE c.chunk_no END,
    CASE WHEN u.part OR c.part OR c.held + u.n > 900 OR (c.held + u.n > 650 AND c.held >= 400) THEN u.n ELSE c.held + u.n END
  FROM c JOIN u ON u.doc_id = c.doc_id AND u.rn = c.rn + 1)
SELECT doc_id, chunk_no::BIGINT AS chunk_no, sum(n)::BIGINT AS token_count, 'b' || min(ord) AS first_block, 'b' || max(ord) AS last_block, sha256(string_agg(t, chr(10) || chr(10) ORDER BY rn)) AS digest
FROM c GROUP BY doc_id, chunk_no""")
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each document packed into chunks, as the paragraphs of one section."""
    blocks = F.transform(F.split("text", "\n"), lambda t, i: F.struct(F.concat(F.lit("b"), i.cast("string")).alias("block_id"), F.lit("paragraph").alias("block_type"), t.alias("text")))
    docs = table(spark, d, "documents").select("doc_id", blocks.alias("blocks"))
    out = chunking.chunk_documents(docs, "doc_id", columns=["chunk_no", "token_count", "source_refs", "body_text"])
    return out.select("doc_id", "chunk_no", "token_count", F.element_at("source_refs", 1)["block_id"].alias("first_block"), F.element_at("source_refs", -1)["block_id"].alias("last_block"), F.sha2("body_text", 256).alias("digest"))


@query("chunk_tables", f"""WITH RECURSIVE o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, '| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' |' AS line FROM orders),
c AS (SELECT c_custkey, n_name || ' > ' || c_name AS prefix, 'Segment ' || c_mktsegment AS para, 'Table 1: orders of ' || c_name AS cap, '| order | status | priority |' || chr(10) || '| --- | --- | --- |' AS head FROM customer JOIN nation ON n_nationkey = c_nationkey),
d AS (
  SELECT c.*, coalesce(n, 0) AS lines, coalesce(chr(10) || body, '') AS body, 60 - {_TOKENS.format("prefix")} AS room, {_TOKENS.format("para")} AS np, {_TOKENS.format("head")} + {_TOKENS.format("cap")} AS fixed,
    {_TOKENS.format("coalesce(body, '')")} AS nb, {_TOKENS.format("prefix")} AS npre
  FROM c LEFT JOIN (SELECT o_custkey, count(*) AS n, string_agg(line, chr(10) ORDER BY k) AS body FROM o GROUP BY o_custkey) ON o_custkey = c_custkey),
r AS (SELECT c_custkey, k, line, {_TOKENS.format("line")} AS n, fixed, room FROM o JOIN d ON o_custkey = c_custkey WHERE fixed + nb > room),
g AS (
  SELECT c_custkey, k, line, n, 0 AS grp, n AS held FROM r WHERE k = 0
  UNION ALL
  SELECT r.c_custkey, r.k, r.line, r.n, CASE WHEN r.fixed + g.held + r.n > r.room THEN g.grp + 1 ELSE g.grp END, CASE WHEN r.fixed + g.held + r.n > r.room THEN r.n ELSE g.held + r.n END
  FROM g JOIN r ON r.c_custkey = g.c_custkey AND r.k = g.k + 1),
t AS (
  SELECT c_custkey, grp, string_agg(line, chr(10) ORDER BY k) AS body, sum(n) AS n, CASE WHEN grp = 0 THEN 0 ELSE min(k) + 1 END AS row_start, max(k) + 2 AS row_end
  FROM g GROUP BY c_custkey, grp),
x AS (
  SELECT c_custkey, 1 AS chunk_no, npre + np AS token_count, NULL::BIGINT AS row_start, NULL::BIGINT AS row_end, NULL::VARCHAR AS caption_text, para AS body FROM d WHERE fixed + nb > room OR np + fixed + nb > room OR (np + fixed + nb > 40 AND np >= 20)
  UNION ALL
  SELECT c_custkey, CASE WHEN np + fixed + nb > room OR (np + fixed + nb > 40 AND np >= 20) THEN 2 ELSE 1 END, npre + fixed + nb + CASE WHEN np + fixed + nb > room OR (np + fixed + nb > 40 AND np >= 20) THEN 0 ELSE np END, NULL, NULL, cap,
    CASE WHEN np + fixed + nb > room OR (np + fixed + nb > 40 AND np >= 20) THEN '' ELSE para || chr(10) || chr(10) END || head || body || chr(10) || chr(10) || cap FROM d WHERE fixed + nb <= room
  UNION ALL
  SELECT d.c_custkey, 2 + grp, npre + fixed + n, row_start, row_end, cap, head || chr(10) || t.body || chr(10) || chr(10) || cap FROM d JOIN t ON t.c_custkey = d.c_custkey)
SELECT x.c_custkey, chunk_no::BIGINT AS chunk_no, x.token_count::BIGINT AS token_count, row_start::BIGINT AS table_row_start, row_end::BIGINT AS table_row_end, caption_text, prefix AS context_prefix, sha256(x.body) AS digest FROM x JOIN d ON d.c_custkey = x.c_custkey""")
def chunk_tables(spark: SparkSession, d: str) -> DataFrame:
    """Customers as documents: a paragraph, and a table of orders with its caption ahead of it, cut between rows at 60 tokens."""
    line = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), "o_orderstatus", F.lit(" | "), "o_orderpriority", F.lit(" |"))
    lines = table(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda s: s["line"]).alias("lines"))
    customers = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    full = customers.join(lines, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
    path = F.array("n_name", "c_name")

    def block(name: str, kind: str, text: Column, parent: Column | None = None, rows: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(F.lit(name).alias("block_id"), F.lit(kind).alias("block_type"), F.lit("s").alias("section_id"), path.alias("section_path"), text.alias("text"), (none if parent is None else parent).cast("string").alias("parent_id"), (none if rows is None else rows).cast("int").alias("rows"))

    rows = F.array_join(F.concat(F.array(F.lit("| order | status | priority |"), F.lit("| --- | --- | --- |")), "lines"), "\n")
    blocks = F.array(block("c", "caption", F.concat(F.lit("Table 1: orders of "), "c_name"), F.lit("t")), block("p", "paragraph", F.concat(F.lit("Segment "), "c_mktsegment")), block("t", "table", rows, None, F.size("lines") + 1))
    out = chunking.chunk_documents(full.select("c_custkey", blocks.alias("blocks")), "c_custkey", target=20, soft=40, hard=60)
    return out.select("c_custkey", "chunk_no", "token_count", "table_row_start", "table_row_end", "caption_text", "context_prefix", F.sha2("body_text", 256).alias("digest"))


@query("dup_ratio", r"""WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS t FROM documents),
c AS (SELECT source, lower(trim(regexp_replace(regexp_replace(regexp_replace(replace(t, chr(173), ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', ' ', 'g'), '([A-Za-z])-\s+([a-z])', '\1\2', 'g'), '\s+', ' ', 'g'))) AS norm FROM l),
g AS (SELECT source, norm, count(*) AS n FROM c GROUP BY 1, 2)
SELECT source, sum(n)::BIGINT AS blocks, coalesce(sum(CASE WHEN n > 1 AND norm <> '' THEN n END), 0)::BIGINT AS duplicates, round(coalesce(sum(CASE WHEN n > 1 AND norm <> '' THEN n END), 0) / sum(n), 6) AS ratio FROM g GROUP BY 1""")
def dup_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Share of each source's lines that occur more than once in it."""
    return documents.duplicate_ratio(_lines(spark, d), ["source"], F.col("text"))


@query("page_coverage", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents)
SELECT doc_id AS doc, count(*) AS page_count, round(count(CASE WHEN length(trim(t)) >= 40 THEN 1 END) / count(*), 6) AS ratio FROM l GROUP BY 1""")
def page_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of each document's lines with 40 characters or more; lines stand for pages."""
    lines = _lines(spark, d).select(F.col("doc_id").alias("doc"), (F.col("order") + 1).alias("page"), "text")
    pages = lines.groupBy("doc").agg(F.count("*").alias("page_count"))
    return documents.page_coverage(lines, pages, 40).select("doc", "page_count", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))


@query("section_paths", """WITH RECURSIVE s AS (
  SELECT 0 AS lvl, 'r' || r_regionkey AS id, NULL::VARCHAR AS parent, r_name AS title FROM region
  UNION ALL SELECT 1, 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 2, 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier),
up AS (SELECT id, [title] AS path, 0 AS depth FROM s WHERE parent IS NULL UNION ALL SELECT s.id, list_append(up.path, s.title), up.depth + 1 FROM s JOIN up ON s.parent = up.id)
SELECT id AS section_id, path, depth FROM up""")
def section_paths(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and suppliers as a section tree, with each one's path from the root."""
    paper = F.lit("p").alias("paper_id")
    r = table(spark, d, "region").select(paper, F.concat(F.lit("r"), "r_regionkey").alias("section_id"), F.lit(None).cast("string").alias("parent_section_id"), F.col("r_name").alias("title"))
    n = table(spark, d, "nation").select(paper, F.concat(F.lit("n"), "n_nationkey").alias("section_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_section_id"), F.col("n_name").alias("title"))
    s = table(spark, d, "supplier").select(paper, F.concat(F.lit("s"), "s_suppkey").alias("section_id"), F.concat(F.lit("n"), "s_nationkey").alias("parent_section_id"), F.col("s_name").alias("title"))
    return documents.section_paths(r.unionByName(n).unionByName(s), spark).select("section_id", "path", "depth")


@query("clean_text", r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(173), ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', ' ', 'g'), '([A-Za-z])-\s+([a-z])', '\1\2', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents""")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(T.clean_text(F.col("text")), 256).alias("digest"))
