"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame with the columns of docs, but for packing.

docs has at least doc_id, text and lang; n_chars, where present, follows the text. A stage reads what its predecessor kept
and decides row by row: rows that repeat an id or lack one are told apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import leaks
from .language_id import UNKNOWN, identify_languages
from .ngram_join import ngram_jaccard_join
from .packing import pack
from .pii import find_pii
from .queries import fold, tokenizer_path
from .shared import fresh, saved

SURE = 0.95  # score of a language from which it replaces another one given


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null texts, or no letter); lang becomes the language found where it was null or
    where the score is at least SURE. Automata learn from the labelled folds."""
    rest = [c for c in docs.columns if c != "text"]
    plain = docs.select(*[F.col(c).alias(f"given{k}") for k, c in enumerate(docs.columns)])
    name = {c: f"given{k}" for k, c in enumerate(docs.columns)}
    found = identify_languages(plain, name["doc_id"], name["text"], name["lang"], fold(name["doc_id"], 5) != 0, with_text=True, keep=[name[c] for c in rest])
    given = F.col(f"kept{rest.index('lang')}")
    lang = F.when(given.isNull() | (F.col("score") >= SURE), F.col("lang_pred")).otherwise(given)
    out = {"text": F.col("text"), "lang": lang} | {c: F.col(f"kept{k}") for k, c in enumerate(rest) if c != "lang"}
    return found.where(F.col("lang_pred") != UNKNOWN).select(*[out[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component, that with the smallest id (null last); documents without a word are alone."""
    (key,) = fresh(docs, "row_key")
    keyed = saved(docs.withColumn(key, F.monotonically_increasing_id()))
    found, _ = ngram_jaccard_join(keyed, id_col=key)
    found = saved(found.where("n_shingles > 0").select("doc_id", "component_id"))
    order = F.struct(F.col("given").isNull().alias("lost"), "given", "row")
    ids = keyed.select(F.col(key).alias("row"), F.col("doc_id").alias("given"))
    first = found.join(ids, found.doc_id == ids.row).groupBy("component_id").agg(F.min(order).alias("z")).select(F.col("z.row").alias("stays"))
    later = saved(found.join(first, found.doc_id == first.stays, "left_anti").select(F.col("doc_id").alias("gone")))
    return keyed.join(later, keyed[key] == later.gone, "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item."""
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = saved(found.select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("gone_text")).distinct())
    return docs.join(found, docs.doc_id.eqNullSafe(found.gone) & (F.xxhash64(docs.text) == found.gone_text), "left_anti")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; no document goes."""
    plain = docs.select(*[F.col(c).alias(f"given{k}") for k, c in enumerate(docs.columns)])
    name = {c: f"given{k}" for k, c in enumerate(docs.columns)}
    found = find_pii(plain, name["doc_id"], name["text"], redacted=True, keep=[n for c, n in name.items() if c != "text"])
    out = {c: F.col(n) for c, n in name.items()} | {"text": F.col("redacted")}
    if "n_chars" in out:
        out["n_chars"] = F.length("redacted").cast(docs.schema["n_chars"].dataType)
    return found.select(*[out[c].alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in sequences of 2048 tokens. Executors still hold what the earlier stages took, so
    tasks have a smaller store of words and less text in work than by default."""
    return pack(docs, tokenizer_path(), keep_ids=False, text_bytes=1 << 19, words_kept=100_000).drop("ids")
