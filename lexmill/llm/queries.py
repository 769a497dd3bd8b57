"""The operators applied to the driver's tables: one query opN_<name> each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import contamination
from .language_id import identify_languages
from .license_scan import license_scan
from .merkle import fold as folded
from .merkle import leaf_digest, merkle_manifest, proof_digests
from .mixing import mix_sources, ranks
from .ngram_join import ngram_jaccard_join
from .packing import pack
from .phrases import collocations
from .pii import find_pii
from .quality import quality
from .toxicity import toxicity
from .url_filter import filter_urls
from .vector_search import nearest_neighbours


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))[0]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds: the held-out split of the contracts."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: a shelf holds 400 ids of a source and language, and four sections. A document that speaks of a
    licence is a licence file, of its section where its id is odd, else of the shelf; the others inherit from the section,
    and where that has none from the shelf."""
    docs = _table(spark, sf_dir, "documents")
    shelf = F.concat_ws("/", "source", "lang", F.concat(F.lit("shelf"), F.floor(F.col("doc_id") / 400).cast("string")))
    section = F.concat_ws("/", shelf, F.concat(F.lit("section"), F.floor(F.col("doc_id") / 100).cast("string")))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    states = F.coalesce(F.col("text").rlike("[Ll]icen[cs]e"), F.lit(False))
    home = F.when(states & (F.col("doc_id") % 2 == 0), shelf).otherwise(section)
    return license_scan(docs, F.concat(home, F.when(states, F.lit("/LICENSE-")).otherwise(F.lit("/")), name))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold("doc_id", 4) == 2
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxicity(docs, labels.where(~held), calibrate=fold("doc_id", 4) == 1)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "log_ratio", "word_log_ratio")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents")).withColumn("keep", F.col("score") >= 0.5)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False).drop("ids")


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"), k=20)


#: Fixed values of op9's contract.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold("doc_id", 5) == 0
    return identify_languages(docs, train=~held).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


#: Fixed values of op11's contract: weights of the sources in their order, again and again.
SOURCE_WEIGHTS = [5, 2, 1]


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    dealt = F.element_at(F.array(*map(F.lit, SOURCE_WEIGHTS)), (F.col("rank") % len(SOURCE_WEIGHTS) + 1).cast("int"))
    weights = ranks(docs.select("source"), "source").select("source", dealt.alias("weight"))
    return mix_sources(docs, weights).select("doc_id", "size", "source_size", "target", "taken")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf with its proof; rows whose fold is 0 are folded again from the leaf of a text in lower case."""
    docs = _table(spark, sf_dir, "documents")
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when(fold("doc_id", 5) == 0, leaf_digest(*others, F.translate("text", UPPER, LOWER)))
    rows = docs.select("*", changed.alias("changed"))
    told = merkle_manifest(rows, leaf_digest(*others, F.col("text")), keep=["changed"])
    again = folded(F.coalesce("changed", "leaf"), F.col("proof"))
    out = told.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_digests(F.col("proof")), 256).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_decontamination": op2_decontamination,
    "op3_pii": op3_pii,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_vector_search": op8_vector_search,
    "op9_url_filter": op9_url_filter,
    "op10_language_id": op10_language_id,
    "op11_source_mix": op11_source_mix,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLES: dict[str, str] = {
    "op7_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
e AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
r AS (SELECT x AS root, y AS node FROM e UNION SELECT r.root, e.y FROM r JOIN e ON e.x = r.node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT node, min(root) AS c FROM r GROUP BY node) m ON m.node = w.doc_id
""",
    "op11_source_mix": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT source, source_size, [5.0, 2.0, 1.0][(k - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap, k FROM s),
o AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
    coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS held,
    sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM w),
l AS (SELECT arg_min((budget - held) / rest, (cap / w, k)) FILTER ((budget - held) / rest * w <= cap) AS lam FROM o),
t AS (
  SELECT source, source_size, least(cap, coalesce(lam, 1e300) * w) AS target,
    coalesce(floor(least(cap, coalesce(lam, 1e300) * w) / nullif(source_size, 0)), 0) AS times
  FROM w, l),
c AS (
  SELECT doc_id, size, source_size, target, times, target - times * source_size AS left_over,
    sum(size) OVER (PARTITION BY d.source ORDER BY h) AS until, sum(size) OVER (PARTITION BY d.source, h) AS here
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (times * size + CASE WHEN until <= left_over THEN size WHEN until - here >= left_over THEN 0
  ELSE floor(size * ((left_over - (until - here)) / here) + 0.5) END)::BIGINT AS taken
FROM c
""",
    "op12_merkle_manifest": r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i)),
d AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) AS c,
    concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS front,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents, crc_table),
leaves AS (
  SELECT doc_id, source, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(c, 4294967295) % 5 = 0 THEN sha256(front || coalesce(strlen(low) || ':' || low, '-')) END AS changed
  FROM d),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM leaves),
tree AS (
  SELECT 0 AS level, source, idx, n, leaf AS digest FROM ranked
  UNION ALL
  SELECT level + 1, source, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY level, source, idx // 16, n),
subroots AS (
  SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS level, idx, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM upper_tree WHERE n > 1 GROUP BY level, idx // 16, n),
steps AS (
  SELECT level, source, idx, coalesce(string_agg(digest, '' ORDER BY idx) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '' ORDER BY idx) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM tree WHERE n > 1 WINDOW w AS (PARTITION BY level, source, idx // 16 ORDER BY idx)),
upper_steps AS (
  SELECT level, idx, coalesce(string_agg(digest, '' ORDER BY idx) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '' ORDER BY idx) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM upper_tree WHERE n > 1 WINDOW w AS (PARTITION BY level, idx // 16 ORDER BY idx)),
path AS (
  SELECT k.doc_id, k.source, k.idx AS leaf_idx, s.level, s.l, s.r FROM ranked k JOIN steps s ON s.source IS NOT DISTINCT FROM k.source AND s.idx = k.idx // (16 ** s.level)::BIGINT
  UNION ALL
  SELECT k.doc_id, k.source, k.idx, 1000 + s.level, s.l, s.r FROM ranked k JOIN subroots g ON g.source IS NOT DISTINCT FROM k.source
    JOIN upper_steps s ON s.idx = g.idx // (16 ** s.level)::BIGINT),
whole AS (
  SELECT source, leaf_idx, sha256(string_agg(l || r, '' ORDER BY level)) AS proof_sha256,
    list(l ORDER BY level) AS ls, list(r ORDER BY level) AS rs
  FROM path GROUP BY source, leaf_idx),
told AS (
  SELECT k.doc_id, k.leaf, g.digest AS subroot, u.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(changed, leaf), list_transform(range(1, len(coalesce(ls, [])) + 1), lambda i: ls[i] || '|' || rs[i])),
      lambda acc, s: sha256(split_part(s, '|', 1) || acc || split_part(s, '|', 2))) AS folded_root
  FROM ranked k JOIN subroots g ON g.source IS NOT DISTINCT FROM k.source JOIN upper_tree u ON u.n = 1
  LEFT JOIN whole p ON p.source IS NOT DISTINCT FROM k.source AND p.leaf_idx = k.idx)
SELECT *, folded_root = root AS verified FROM told
""",
    "op13_phrase_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS MATERIALIZED (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) r(k) WHERE len(ws) >= k),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
x AS MATERIALIZED (
  SELECT lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS front, array_to_string(ws[cut + 1:], ' ') AS back
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1)),
c AS (
  SELECT x.lang, x.phrase, x.a, l.a AS l, r.a AS r, ((2000000::HUGEINT * x.a) // (l.a + r.a))::BIGINT AS score, cut
  FROM x JOIN f l ON l.lang = x.lang AND l.phrase = front JOIN f r ON r.lang = x.lang AND r.phrase = back),
b AS (SELECT lang, phrase, any_value(a) AS a, arg_min(struct_pack(l := l, r := r, score := score), (score, cut)) AS z FROM c GROUP BY lang, phrase),
parts AS (SELECT lang, a, k AS longer_k, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))))) AS phrase FROM f WHERE k > 2),
cover AS (SELECT lang, phrase, max(a) AS longer FROM parts GROUP BY lang, phrase),
o AS (
  SELECT b.lang, b.phrase, b.a, z.l AS l, z.r AS r, n.n, z.score AS score, row_number() OVER (PARTITION BY b.lang ORDER BY z.score DESC, b.a DESC, b.phrase) AS rank
  FROM b JOIN n ON n.lang = b.lang LEFT JOIN cover v ON v.lang = b.lang AND v.phrase = b.phrase
  WHERE v.longer IS NULL OR 100 * v.longer < 80 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
""",
}
