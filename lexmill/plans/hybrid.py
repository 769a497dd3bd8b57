"""Hybrid search of documents for benchmark passages, by words and hashed vectors of the same texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import acceptance, hybrid, metrics, retrieval
from lexmill.plans.retrieval import _BM25, _TOK
from lexmill.registry import query
from lexmill.sources.checkpoints import written
from lexmill.sources.tables import table


def _dense_sql(docs: str) -> str:
    """near (query_id, id, rank up to 20): exact cosine of hashed vectors; docs names a table doc_id, text."""
    sums = "SELECT {0}, slot, sum(sign * n) AS v FROM (SELECT {0}, ('0x' || substr(md5(term), 1, 6))::BIGINT % 64 AS slot, CASE WHEN ('0x' || substr(md5(term), 7, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS sign, n FROM (SELECT {0}, term, count(*) AS n FROM (SELECT {0}, unnest({1}) AS term FROM {2}) GROUP BY ALL)) GROUP BY ALL"
    return f"""
dv AS ({sums.format("doc_id", _TOK.format("text"), docs)}), qv AS ({sums.format("item_id", _TOK.format("text"), "benchmark")}),
dn AS (SELECT doc_id, sqrt(sum(v * v)::DOUBLE) AS n FROM dv GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(v * v)::DOUBLE) AS n FROM qv GROUP BY 1),
dots AS (SELECT item_id, doc_id, sum(qv.v * dv.v)::DOUBLE AS dot FROM qv JOIN dv USING (slot) GROUP BY 1, 2),
every AS (SELECT qn.item_id, dn.doc_id, CASE WHEN qn.n * dn.n > 0 THEN round(coalesce(dot, 0) / (dn.n * qn.n), 6) ELSE 0 END AS score FROM qn CROSS JOIN dn LEFT JOIN dots ON dots.item_id = qn.item_id AND dots.doc_id = dn.doc_id),
near AS (SELECT item_id AS query_id, doc_id AS id, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM every) WHERE rank <= 20)"""


_FUSED = """
f AS (SELECT query_id, id, b.rank AS ra, o.rank AS rb, coalesce(1.0::DOUBLE / (60 + b.rank), 0) + coalesce(1.0::DOUBLE / (60 + o.rank), 0) AS s FROM bm25 b FULL JOIN near o USING (query_id, id)),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, ra NULLS LAST, rb NULLS LAST) AS rank FROM f)"""


@query("hybrid_metrics", f"""WITH {_BM25}, {_dense_sql("documents")}, {_FUSED},
qs AS (SELECT item_id, list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')) AS ws FROM benchmark),
ds AS (SELECT doc_id, list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')) AS ws FROM documents),
c AS (SELECT h.*, len(list_intersect(qs.ws, ds.ws)) AS rs FROM h JOIN qs ON qs.item_id = query_id JOIN ds ON ds.doc_id = id WHERE h.rank <= 20),
e AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rs = 0, rs DESC, rank) AS rank FROM c),
v AS (SELECT 'bm25' AS variant, query_id, id, rank FROM bm25 WHERE rank <= 10 UNION ALL SELECT 'dense', query_id, id, rank FROM near WHERE rank <= 10 UNION ALL SELECT 'hybrid', query_id, id, rank FROM h WHERE rank <= 10 UNION ALL SELECT 'hybrid_rerank', query_id, id, rank FROM e WHERE rank <= 10),
t AS (SELECT doc_id, {_TOK.format("text")} AS ts FROM documents),
wn AS (SELECT DISTINCT doc_id AS id, unnest(list_transform(range(1, len(ts) - 6), lambda i: array_to_string(ts[i:i + 7], ' '))) AS w FROM t WHERE len(ts) >= 8),
g AS (SELECT item_id AS query_id, id FROM (SELECT item_id, array_to_string(({_TOK.format("text")})[1:8], ' ') AS w FROM benchmark) JOIN wn USING (w)),
need AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1),
m AS (SELECT variant, query_id, count(*) AS hits, min(rank) AS first FROM v JOIN g USING (query_id, id) GROUP BY 1, 2),
w AS (SELECT DISTINCT variant FROM v)
SELECT w.variant, count(*) AS queries, round(avg(coalesce(hits / n, 0)), 6) AS recall, round(avg(coalesce(1.0 / first, 0)), 6)::DOUBLE AS mrr FROM w CROSS JOIN need LEFT JOIN m ON m.variant = w.variant AND m.query_id = need.query_id GROUP BY 1""")
def hybrid_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Four variants of searching documents for each passage: mean recall and reciprocal rank at 10. A document is sought if
    it holds the passage's first eight words in a row; fused hits are reranked by distinct words shared."""
    docs, asked = table(spark, d, "documents"), table(spark, d, "benchmark")
    words = written(hybrid.ranked_by_words(docs, asked, 20, "doc_id", "text", "item_id", "text"))
    near = written(hybrid.ranked_by_vectors(hybrid.hashed_vectors(docs, "doc_id", "text"), asked, 20, "item_id", "text"))
    fused = retrieval.rrf(words, near, 20, candidates=20).select("query_id", "id")
    texts = lambda df, key, name: df.select(F.col(key).alias(name), T.word_set(F.col("text")).alias(f"{name}_ws"))
    found = docs.join(F.broadcast(fused.select(F.col("id").alias("doc_id")).distinct()), "doc_id", "left_semi")  # 20 texts a passage at most
    scores = fused.join(texts(found, "doc_id", "id"), "id").join(F.broadcast(texts(asked, "item_id", "query_id")), "query_id")
    scores = scores.select("query_id", "id", F.size(F.array_intersect("id_ws", "query_id_ws")).cast("double").alias("rerank_score")).where("rerank_score > 0")
    hits = acceptance.search_variants(words, near, scores, 10, candidates=20)
    tokens = docs.select(F.col("doc_id").alias("id"), T.bm25_tokens(F.col("text")).alias("ts")).where("size(ts) >= 8")
    begins = asked.select(F.col("item_id").alias("query_id"), F.slice(T.bm25_tokens(F.col("text")), 1, 8).alias("b")).withColumn("h", F.explode(T.run_hashes(8)("b")))
    windows = tokens.select("id", "ts", F.posexplode(T.run_hashes(8)("ts")).alias("p", "h"))
    gold = written(windows.join(F.broadcast(begins), "h").where(F.slice("ts", F.col("p") + 1, 8) == F.col("b")).select("query_id", "id").distinct())
    both = hits.select("variant").distinct().crossJoin(gold.select("query_id").distinct())  # four rows by the queries
    keyed = lambda df: df.withColumn("query_id", F.struct("variant", "query_id"))
    scored = metrics.ranking_metrics(keyed(hits), keyed(both.join(gold, "query_id")).select("query_id", "id"), 10)
    return scored.groupBy("query_id.variant").agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("mrr"), 6).alias("mrr"))


def _indexed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """documents, and an index of them that was built before src0 was added, src1 cut and src2 written anew, and with
    fewer dimensions for src3."""
    docs = table(spark, d, "documents")
    old = docs.where("source <> 'src0' and not (source = 'src1' and doc_id % 3 = 0)").withColumn("text", F.when((F.col("source") == "src2") & (F.col("doc_id") % 2 == 0), F.upper("text")).otherwise(F.col("text")))
    most = hybrid.build_index(old.where("source <> 'src3'"), "source", "doc_id", "text")
    return docs, most.unionByName(hybrid.build_index(old.where("source = 'src3'"), "source", "doc_id", "text", dims=16))


_STATE = "CASE source WHEN 'src0' THEN 'missing' WHEN 'src1' THEN CASE WHEN new > 0 THEN 'stale' ELSE 'ok' END WHEN 'src2' THEN CASE WHEN changed > 0 THEN 'stale' ELSE 'ok' END WHEN 'src3' THEN 'dimension' ELSE 'ok' END"
_STATES = f"""st AS (SELECT source AS grp, {_STATE} AS state, new, changed FROM (SELECT source, count(*) FILTER (source = 'src0' OR (source = 'src1' AND doc_id % 3 = 0)) AS new, count(*) FILTER (source = 'src2' AND doc_id % 2 = 0 AND upper(text) <> text) AS changed FROM documents GROUP BY 1))"""


@query("index_states", f"WITH {_STATES} SELECT grp, state, new, changed, 0::BIGINT AS gone FROM st")
def index_states(spark: SparkSession, d: str) -> DataFrame:
    docs, index = _indexed(spark, d)
    return hybrid.index_states(docs, index, "source", "doc_id", "text")


@query("hybrid_search", f"""WITH {_STATES}, sound AS (SELECT doc_id, text FROM documents JOIN st ON grp = source AND state = 'ok'), {_BM25}, {_dense_sql("sound")}, {_FUSED}
SELECT query_id, h.id, rank, ra AS rank_words, rb AS rank_vectors, grp, state, CASE WHEN state = 'ok' THEN 'hybrid' ELSE 'words' END AS method FROM h JOIN documents ON doc_id = h.id JOIN st ON grp = source WHERE rank <= 8""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The 8 best documents of each passage; sources whose index is missing, stale or of another size by words alone."""
    docs, index = _indexed(spark, d)
    return hybrid.hybrid_search(docs, index, table(spark, d, "benchmark"), "source", "doc_id", "text", "item_id", "text")
