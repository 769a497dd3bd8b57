"""Retrieval queries: benchmark passages against documents, and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import metrics, retrieval
from lexmill.registry import query
from lexmill.sources.tables import table

_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_BM25 = f"""
tok AS (SELECT doc_id, unnest({_TOK.format("text")}) AS term FROM documents),
len AS (SELECT doc_id, len({_TOK.format("text")}) AS doc_len FROM documents),
stats AS (SELECT count(*) AS docs, avg(doc_len) AS avgdl FROM len),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOK.format("text")}) AS term FROM benchmark) GROUP BY 1, 2),
scored AS (
  SELECT q.item_id AS query_id, tf.doc_id AS id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * times * 2.5 * tf / (tf + 1.5 * (0.25 + 0.75 * doc_len / avgdl))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc_id) CROSS JOIN stats GROUP BY 1, 2),
bm25 AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 20)"""
_OVERLAP = r"""
qw AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+'))) AS w FROM benchmark),
dw AS (SELECT doc_id AS id, unnest(list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+'))) AS w FROM documents),
ov AS (SELECT query_id, id, count(*) AS score FROM qw JOIN dw USING (w) GROUP BY 1, 2),
overlap AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ov) WHERE rank <= 20)"""


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25_topk(table(spark, d, "documents"), table(spark, d, "benchmark"), 20, "doc_id", "text", "item_id", "text")


def _overlap(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.overlap_topk(table(spark, d, "documents"), table(spark, d, "benchmark"), 20, "doc_id", "text", "item_id", "text")


@query("bm25_topk", f"WITH {_BM25} SELECT query_id, id, rank, score FROM bm25")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark passage as a query: its 20 best documents."""
    return _bm25(spark, d).select("query_id", "id", "rank", "score")


@query("bm25_terms", f"WITH {_BM25} SELECT term, df, round(ln(1 + (docs - df + 0.5) / (df + 0.5)), 6) AS idf FROM df CROSS JOIN stats")
def bm25_terms(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and weight of every term of the corpus."""
    postings, stats = retrieval.bm25_postings(table(spark, d, "documents"), "doc_id", "text")
    idf = F.round(F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6)
    return postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats)).select("term", "df", idf.alias("idf"))


@query("wiki_lexical", f"WITH {_OVERLAP} SELECT query_id, id, rank, score FROM overlap")
def wiki_lexical(spark: SparkSession, d: str) -> DataFrame:
    """Documents by distinct words shared with each benchmark passage."""
    return _overlap(spark, d).select("query_id", "id", "rank", "score")


@query(
    "rrf_fusion",
    f"""WITH {_BM25}, {_OVERLAP},
f AS (SELECT query_id, id, b.rank AS rank_a, o.rank AS rank_b, coalesce(1.0 / (60 + b.rank), 0) + coalesce(1.0 / (60 + o.rank), 0) AS s FROM bm25 b FULL JOIN overlap o USING (query_id, id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, rank_a NULLS LAST, rank_b NULLS LAST) AS rrf_rank FROM f)
SELECT query_id, id, rank_a, rank_b, round(s::DOUBLE, 9) AS score, rrf_rank FROM r WHERE rrf_rank <= 8""",
)
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """BM25 and word overlap fused by reciprocal ranks: the 8 best of each query."""
    return retrieval.rrf(_bm25(spark, d), _overlap(spark, d), 8).withColumn("score", F.round("score", 9))


@query(
    "retrieval_metrics",
    f"""WITH {_BM25},
gold AS (SELECT b.item_id AS query_id, l.doc_id AS id FROM benchmark b JOIN (SELECT DISTINCT query_id, id FROM bm25) x ON x.query_id = b.item_id JOIN labels l ON l.doc_id = x.id AND l.quality = 1),
need AS (SELECT query_id, count(*) AS n FROM gold GROUP BY 1),
got AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM bm25 JOIN gold USING (query_id, id) WHERE rank <= 10 GROUP BY 1)
SELECT query_id, round(coalesce(hits / n, 0), 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr,
  round(coalesce(dcg / list_sum(list_transform(range(1, least(10, n) + 1), lambda r: 1 / log2(r + 1))), 0), 6) AS ndcg
FROM need LEFT JOIN got USING (query_id)""",
)
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Recall, MRR and nDCG at 10 of BM25, with the good documents among a passage's 20 hits as gold."""
    ranked = _bm25(spark, d).select("query_id", "id", "rank")
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    m = metrics.ranking_metrics(ranked, ranked.join(good, "id").select("query_id", "id"), 10)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


@query(
    "dense_topk",
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS id, round(list_dot_product(embedding::DOUBLE[], qv) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(qv, qv))), 6) AS score FROM embeddings, q)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 20""",
)
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 20 vectors nearest by exact cosine to each of the stated queries: vectors whose id is divisible by 50."""
    v = table(spark, d, "embeddings")
    return retrieval.dense_topk(v, v.where("vec_id % 50 = 0"), 20, "vec_id", "embedding", "vec_id", "embedding")


@query("grep_lines", r"SELECT doc_id AS id, n AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE regexp_matches(line, '[Ll]icen[cs]e')")
def grep_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents that name a licence, with their numbers."""
    return retrieval.grep_lines(table(spark, d, "documents"), "[Ll]icen[cs]e").select("id", F.col("line_no").cast("long").alias("line_no"), "line")


@query("context_window", """WITH t AS (SELECT conv_id, turn, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
a AS (SELECT conv_id, turn AS anchor, pos AS at_pos FROM t WHERE turn = last)
SELECT t.conv_id, a.anchor, t.turn, t.role, t.n FROM t JOIN a ON a.conv_id = t.conv_id AND t.pos BETWEEN at_pos - 2 AND at_pos + 1""")
def context_window(spark: SparkSession, d: str) -> DataFrame:
    """Two turns before the last of each conversation and one after, clamped."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return retrieval.context_window(turns, last, "conv_id", "turn", 2, 1).select("conv_id", "anchor", "turn", "role", "n")


@query("source_fusion", """WITH h AS (SELECT 'agentic' AS source, doc_id AS id, n_chars AS score FROM documents WHERE lang = 'en' UNION ALL SELECT 'base', doc_id, n_chars FROM documents WHERE lang <> 'en'),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS local_rank FROM h)
SELECT source, id, score, local_rank, round(1.0 / (60 + local_rank), 9)::DOUBLE AS fused FROM r WHERE local_rank <= 10 ORDER BY local_rank, source, id LIMIT 10""")
def source_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Two sources of hits merged by local rank, never added up."""
    docs = table(spark, d, "documents")
    hits = docs.select(F.when(F.col("lang") == "en", "agentic").otherwise("base").alias("source"), F.col("doc_id").alias("id"), F.col("n_chars").alias("score"))
    return retrieval.fuse_sources(hits, 10).withColumn("fused", F.round("fused", 9))


@query("query_languages", r"SELECT doc_id, CASE WHEN regexp_matches(text, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3040}-\x{30ff}]') THEN 'zh' ELSE 'en' END AS query_lang, (len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''\-][A-Za-z0-9]+)*')) + len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]')))::BIGINT AS tokens FROM documents")
def query_languages(spark: SparkSession, d: str) -> DataFrame:
    """Approximate tokens and query language of every document."""
    return table(spark, d, "documents").select("doc_id", T.query_language(F.col("text")).alias("query_lang"), T.token_count(F.col("text")).cast("long").alias("tokens"))
