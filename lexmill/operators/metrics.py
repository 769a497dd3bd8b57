"""Retrieval-quality and acceptance metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import rate


def ranking_metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """query_id, recall, mrr, ndcg at k of ranked (query_id, id, rank) against gold (query_id, id), binary relevance.

    Queries come from gold; one without a hit scores 0.
    """
    need = gold.distinct().groupBy("query_id").agg(F.count("*").alias("n_gold"))
    hit = ranked.where(F.col("rank") <= k).join(gold.distinct(), ["query_id", "id"], "left_semi")
    got = hit.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_gold")).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return need.join(got, "query_id", "left").select("query_id", zero(F.col("hits") / F.col("n_gold")).alias("recall"), zero(1 / F.col("first")).alias("mrr"), zero(F.col("dcg") / ideal).alias("ndcg"))


def coverage_metrics(hits: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """Coverage of gold blocks by hits (query_id, rank, block_id): a block counts at its first rank alone, gains are shares
    of the gold blocks, and the ideal is the unnormalized one."""
    need = gold.distinct().groupBy("query_id").agg(F.count("*").alias("n_gold"))
    first = hits.join(gold.distinct(), ["query_id", "block_id"], "left_semi").groupBy("query_id", "block_id").agg(F.min("rank").alias("rank"))
    got = first.groupBy("query_id").agg(
        F.count_if(F.col("rank") <= 5).alias("c5"),
        F.count_if(F.col("rank") <= k).alias("ck"),
        F.min(F.when(F.col("rank") <= k, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1))).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_gold")).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return need.join(got, "query_id", "left").select("query_id", zero(F.col("c5") / F.col("n_gold")).alias("recall_5"), zero(F.col("ck") / F.col("n_gold")).alias("recall_10"), zero(1 / F.col("first")).alias("mrr_10"), zero(F.col("dcg") / F.col("n_gold") / ideal).alias("ndcg_10"))


def mean_by_grains(df: DataFrame, value: str, grains: list[str]) -> DataFrame:
    """Mean of value overall and by each grain alone, to six places, in one pass over grouping sets."""
    sets = [[], *[[g] for g in grains]]
    parts = df.groupingSets([[F.col(c) for c in s] for s in sets], *grains).agg(F.round(F.avg(value), 6).alias("mean"), F.count("*").alias("n"), F.grouping_id().alias("gid"))
    width = len(grains)
    ids = {(1 << width) - 1: "overall"} | {((1 << width) - 1) ^ (1 << (width - 1 - i)): g for i, g in enumerate(grains)}
    name = reduce(lambda acc, kv: acc.when(F.col("gid") == kv[0], kv[1]), list(ids.items())[1:], F.when(F.col("gid") == (1 << width) - 1, "overall"))
    return parts.select(name.alias("grain"), F.coalesce(*[F.col(g).cast("string") for g in grains]).alias("key"), "mean", "n")


def acceptance(fields: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates of judged fields (expected, predicted): null rates where nothing was judged."""
    match = F.col("expected").eqNullSafe(F.col("predicted"))
    judged = F.count_if(F.col("expected").isNotNull())
    return fields.groupBy(*by).agg(F.count("*").alias("fields"), judged.alias("judged"), F.count_if(match & F.col("expected").isNotNull()).alias("matched"), rate(F.count_if(match & F.col("expected").isNotNull()), judged).alias("match_rate"))
