"""Building documents: queries over the driver's tables and over stated pages worked out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import building as B
from lexmill.plans.cases import spread, spread_sql
from lexmill.registry import query
from lexmill.sources.tables import table


@query("section_stack", """WITH b AS (SELECT conv_id, turn, role = 'user' AS head, (turn * 7 + conv_id) % 4 + 1 AS level FROM conversations),
s AS (SELECT conv_id, turn, head, level, max(CASE WHEN head THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS section_id FROM b)
SELECT conv_id, turn, section_id, CASE WHEN head THEN (SELECT max(p.turn) FROM b p WHERE p.head AND p.conv_id = s.conv_id AND p.turn < s.turn AND p.level < s.level) END AS parent_id FROM s""")
def section_stack(spark: SparkSession, d: str) -> DataFrame:
    """Turns as blocks, the user's as headings of four levels."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "heading").otherwise("paragraph").alias("block_type"), ((F.col("turn") * 7 + F.col("conv_id")) % 4 + 1).cast("int").alias("level"))
    return B.section_stack(rows, "conv_id", "turn").select("conv_id", "turn", "section_id", "parent_id")


_EVENT_BLOCKS = """b AS (SELECT user_id AS p, event_id AS o, CASE event_type WHEN 'error' THEN 'caption' WHEN 'view' THEN 'table' WHEN 'click' THEN 'figure' ELSE 'paragraph' END AS t FROM events),
l AS (SELECT *, max(CASE WHEN t <> 'caption' THEN o END) OVER (PARTITION BY p ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM b),
k AS (SELECT l.*, CASE WHEN l.t = 'caption' AND x.t IN ('table', 'figure') THEN prev END AS parent FROM l LEFT JOIN b x ON x.o = l.prev),
c AS (SELECT parent, list(o ORDER BY o) AS ids FROM k WHERE parent IS NOT NULL GROUP BY 1)"""


def _event_blocks(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    kind = F.when(e == "error", "caption").when(e == "view", "table").when(e == "click", "figure").otherwise("paragraph")
    return table(spark, d, "events").select(F.col("user_id").alias("paper_id"), F.col("event_id").alias("order"), F.col("event_id").alias("block_id"), kind.alias("block_type"))


@query("link_captions", f"WITH {_EVENT_BLOCKS} SELECT o AS block_id, k.parent AS parent_block_id, coalesce(ids, []) AS caption_block_ids FROM k LEFT JOIN c ON c.parent = k.o")
def link_captions(spark: SparkSession, d: str) -> DataFrame:
    """Events as blocks, errors as captions of the view or click before them."""
    return B.link_captions(_event_blocks(spark, d)).select("block_id", "parent_block_id", "caption_block_ids")


@query("bind_captions", f"""WITH {_EVENT_BLOCKS},
h AS (SELECT o, p, CASE WHEN o % 2 = 0 THEN coalesce(ids, []) ELSE [] END AS ids FROM b LEFT JOIN c ON c.parent = b.o WHERE t IN ('table', 'figure')),
listed AS (SELECT o, unnest(ids) AS cap FROM h),
pointed AS (SELECT h.o, k.o AS cap FROM h JOIN k ON k.parent = h.o AND k.o % 3 <> 0 WHERE h.o NOT IN (SELECT o FROM listed)),
bound AS (SELECT * FROM listed UNION ALL SELECT * FROM pointed)
SELECT b.o AS block_id, coalesce(list(cap ORDER BY cap) FILTER (cap IS NOT NULL), []) AS captions FROM b LEFT JOIN bound ON bound.o = b.o WHERE b.o NOT IN (SELECT cap FROM bound) GROUP BY 1""")
def bind_captions(spark: SparkSession, d: str) -> DataFrame:
    """Units of those blocks where odd parents have no list and every third caption has lost its pointer."""
    linked = B.link_captions(_event_blocks(spark, d))
    lists = F.when(F.col("block_id") % 2 == 0, F.col("caption_block_ids")).otherwise(F.array().cast("array<bigint>"))
    rows = linked.withColumn("caption_block_ids", lists).withColumn("parent_block_id", F.when(F.col("block_id") % 3 != 0, F.col("parent_block_id")))
    return B.bind_captions(rows).select("block_id", "captions")


@query("prefix_compaction", r"""WITH p AS (SELECT p_partkey, [p_brand, p_name, p_type] AS path, len(regexp_extract_all(p_brand, '[A-Za-z0-9]+(?:[''\-][A-Za-z0-9]+)*')) AS a, len(regexp_extract_all(p_name, '[A-Za-z0-9]+(?:[''\-][A-Za-z0-9]+)*')) AS b, len(regexp_extract_all(p_type, '[A-Za-z0-9]+(?:[''\-][A-Za-z0-9]+)*')) AS c FROM part)
SELECT p_partkey, array_to_string(path[1:CASE WHEN a + b + c < 4 THEN 3 WHEN a + b < 4 THEN 2 ELSE 1 END], ' > ') AS prefix, a + b + c >= 4 AS compacted FROM p""")
def prefix_compaction(spark: SparkSession, d: str) -> DataFrame:
    """Parts' labels as section paths of fewer than four tokens."""
    return table(spark, d, "part").select("p_partkey", B.compact_prefix(F.array("p_brand", "p_name", "p_type"), 4).alias("z")).select("p_partkey", F.array_join("z.items", " > ").alias("prefix"), "z.compacted")


@query("chunk_context", r"""WITH c AS (SELECT conv_id, turn, 'c' || conv_id || ' > ' || role AS prefix, [w FOR w IN regexp_extract_all(text, '[A-Za-z0-9]+(?:[''\-][A-Za-z0-9]+)*')] AS ws FROM conversations)
SELECT conv_id, turn, prefix AS context_prefix, (2 + least(len(ws), 28))::INT AS token_count, false AS compacted FROM c""")
def chunk_context(spark: SparkSession, d: str) -> DataFrame:
    """Turns as chunks of thirty tokens with their conversation and role before them."""
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("paper_id"), F.concat_ws("-", "turn", "role").alias("section_id"), "turn", "role", F.col("text").alias("body_text"))
    paths = t.select("paper_id", "section_id", F.array(F.concat(F.lit("c"), F.col("paper_id")), "role").alias("path"))
    return B.chunk_context(t, paths, 30).select(F.col("paper_id").alias("conv_id"), "turn", "context_prefix", "token_count", "compacted")


@query("parse_validation", r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS pos FROM l),
x AS (SELECT doc_id, t, pos, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE pos // 5 + 1 END AS page, CASE WHEN pos % 6 = 0 THEN 'heading' ELSE 'paragraph' END AS kind, trim(regexp_replace(t, '\s+', ' ', 'g')) AS n FROM b),
p AS (SELECT doc_id, ((count(*) + 4) // 5 + CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 0 END) AS pages, count(*) AS blocks, sum(length(t)) AS chars, sum(length(t) - length(replace(t, chr(65533), ''))) AS bad, count(*) FILTER (regexp_matches(t, '(?i)\b(table|tab\.?|figure|fig\.?|eq\.?)\s*\d')) AS hints FROM x GROUP BY 1),
g AS (SELECT doc_id, count(*) FILTER (c >= 10) AS meaningful, count(*) FILTER (c > 0) AS filled FROM (SELECT doc_id, page, sum(length(t)) AS c FROM x WHERE page IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT doc_id, sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS repeated FROM (SELECT doc_id, n, count(*) AS k FROM x WHERE n <> '' GROUP BY 1, 2) GROUP BY 1),
j AS (SELECT d.doc_id, pages, blocks, chars, bad, hints, filled, coalesce(repeated, 0) AS repeated, CASE WHEN d.doc_id % 19 <> 0 THEN coalesce(meaningful, 0) / pages END AS ratio FROM documents d LEFT JOIN p USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'parser_status' WHEN doc_id % 13 = 0 THEN 'canonical_document' ELSE array_to_string(list_filter([CASE WHEN doc_id % 17 = 0 THEN 'page_count' END, CASE WHEN blocks IS NULL OR ratio < 0.05 THEN 'near_empty_body' END, CASE WHEN doc_id % 23 = 0 AND blocks > 0 THEN 'structure_valid' END], lambda v: v IS NOT NULL), ',') END AS failed,
array_to_string(list_filter([CASE WHEN ratio < 0.8 THEN 'meaningful_text_page_ratio' END, CASE WHEN doc_id % 19 = 0 THEN 'provenance_missing' END, CASE WHEN bad > 0.01 * chars THEN 'replacement_char_ratio' END, CASE WHEN repeated > 0.15 * blocks THEN 'suspicious_duplicate_ratio' END, CASE WHEN pages > 4 AND doc_id % 3 = 0 THEN 'zero_headings' END, CASE WHEN doc_id % 19 <> 0 AND pages - filled >= 2 THEN 'empty_body_pages' END, CASE WHEN doc_id % 29 = 0 THEN 'parser_quality' END, CASE WHEN hints > 0 THEN 'structure_missing' END], lambda v: v IS NOT NULL), ',') AS soft FROM j)
SELECT doc_id AS paper_id, CASE WHEN failed <> '' THEN 'failed' WHEN soft <> '' THEN 'degraded' ELSE 'passed' END AS status, failed, CASE WHEN failed <> '' THEN '' ELSE soft END AS degraded FROM f""")
def parse_validation(spark: SparkSession, d: str) -> DataFrame:
    """Documents as parses: lines as blocks, five to a page; some lack a document, pages, headings or a good structure."""
    docs = table(spark, d, "documents")
    k = F.col("doc_id")
    lines = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    no_page = F.array().cast("array<int>")
    first = F.when((F.col("pos") == 0) & (k % 23 == 0), "").otherwise(F.concat_ws("-", k, "pos"))
    blocks = lines.select(k.alias("paper_id"), first.alias("block_id"), F.when(F.col("pos") % 6 == 0, "heading").otherwise("paragraph").alias("block_type"), F.col("pos").alias("position"), F.col("pos").alias("order"), "text", F.when(k % 19 == 0, no_page).otherwise(F.array((F.floor(F.col("pos") / 5) + 1).cast("int"))).alias("pages"))
    n = F.size(F.split("text", "\n"))
    pages = (F.floor((n + 4) / 5) + F.when(k % 7 == 0, 3).otherwise(0)).cast("int")
    parses = docs.select(k.alias("paper_id"), F.when(k % 11 == 0, "error").otherwise("ok").alias("parser_status"), (k % 13 != 0).alias("has_document"), (pages + F.when(k % 17 == 0, 1).otherwise(0)).alias("source_pages"), pages.alias("page_count"), F.when(k % 29 == 0, F.array(F.lit("good"), F.lit(" Poor "))).alias("quality"))
    sections = blocks.where("block_type = 'heading' and paper_id % 3 <> 0").select("paper_id", F.col("position").alias("section_id"), F.lit(None).cast("int").alias("parent_section_id"), F.col("block_id").alias("heading_block_id"))
    out = B.parse_validation(parses, blocks, sections)
    return out.select("paper_id", "status", F.array_join("failed", ",").alias("failed"), F.array_join("degraded", ",").alias("degraded"))


_PAGES = {
    "plain": ["Vol. 3", "", "A study of tram-", "lines in town #", "Ann Lee, Bo Ode", "Cy Fox", "University of X", "Abstract"],
    "long": ["One two three", "four five six", "seven eight nine", "ten of them all", "eleven and more", "", "Dee Poe"],
    "none": ["", "Abstract", "12"],
    "stop": ["This is a sentence and no title.", "Ann Lee"],
}


@query("first_page", spread_sql("('plain#', 'A study of tram lines in town #', 'Ann Lee;Bo Ode;Cy Fox'), ('long#', 'One two three four five six seven eight nine ten of them all', 'eleven;more'), ('none#', NULL, ''), ('stop#', NULL, '')", "paper_id, title, authors", "paper_id, title"))
def first_page(spark: SparkSession, d: str) -> DataFrame:
    """Titles and authors of first pages, a set for each supplier, worked out by hand."""
    rows = [(f"{p}#", i, s) for p, lines in _PAGES.items() for i, s in enumerate(lines)]
    return B.first_page(spread(spark, d, rows, "paper_id string, pos int, line string")).select("paper_id", "title", F.array_join("authors", ";").alias("authors"))


_FILES = [
    (1, " A Study # ", "Ann Lee; Bo Ode", "x doi 10.1234/AB.c#, y", "Intro 2021\nAbstract\nThis is an abstract of more than thirty letters.\nIntroduction\nx arXiv:2312.01234v2", "1706.03762.pdf"),
    (2, " ", None, None, "Abstract\nToo short.\n1. One", "2313.01234.pdf"),
]


@query("metadata_candidates", spread_sql("""(1::BIGINT, 'title', 'A Study #', 'metadata.title', 0.8::DOUBLE), (1, 'author', 'Ann Lee', 'metadata.author', 0.6), (1, 'author', 'Bo Ode', 'metadata.author', 0.6), (1, 'doi', '10.1234/ab.c#', 'metadata.keywords', 0.95), (1, 'publication_year', '2021', 'first_pages_text', 0.5),
(1, 'abstract', 'This is an abstract of more than thirty letters.', 'first_pages_text', 0.4), (1, 'arxiv_id', '2312.01234v2', 'first_pages_text', 0.95), (1, 'arxiv_id', '1706.03762', 'file_name', 0.9)""", "file_id, field, value, source, confidence", "value", "file_id"))
def metadata_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of files, a set for each supplier, worked out by hand."""
    return B.metadata_candidates(spread(spark, d, _FILES, "file_id long, title string, author string, keywords string, text string, file_name string", "file_id"))
