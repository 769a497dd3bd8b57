"""Mixing sources to target weights by hash-threshold histograms.

A source whose target exceeds its size is taken whole as often as it fits, and the rest of the target is filled by the rows
whose hash lies below a threshold. Words are summed by source and leading bits of the hash; the bucket in which the rest
runs out is the only one that the next level looks into, by the bits that follow. Nothing is sorted, the last pass is a
filter, and a smaller budget takes a subset of what a larger one takes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import places, saved

HASH_BITS = 60
LEVEL_BITS = 10  # of a level's buckets: 1,024 rows of a source at most


def words(text: Column) -> Column:
    """Number of white-space delimited words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash(id_col: Column) -> Column:
    """60 bits of the md5 of an id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("-")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _key(source: Column) -> Column:
    """Never null, in the order of source with null last."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source.cast("string")))


def ranks(sources: DataFrame, col: str) -> DataFrame:
    """col and its `rank` from 0, null last."""
    spread = sources.select(F.col(col), _key(F.col(col)).alias("k")).distinct()
    return places(spread.withColumn("grp", F.lit("")), ["k"]).select(col, F.col("idx").alias("rank"))


def targets(sizes: DataFrame, share: float, most: float) -> DataFrame:
    """sizes (key, weight, source_size) with `target`: share of all sizes dealt by weight, at most `most` times a size.

    With level = words a unit of weight, a source holds min(cap, level * weight). The level is raised until the capped
    sources and the others together hold the budget; the driver sees three sums a round.
    """
    cap = most * F.col("source_size")
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("weight")).first()
    budget, weight, level = share * total[0], total[1], None
    new = budget / weight if weight else 0.0
    while new != level:
        level = new
        above = cap < level * F.col("weight")
        held, rest = sizes.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)), F.sum(F.when(~above, F.col("weight")))).first()
        new = (budget - held) / rest if rest else level
    return sizes.withColumn("target", F.least(cap, F.lit(float(level)) * F.col("weight")))


def _thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(key, edge, part): rows of a source with a hash below edge are in, those at it in part. rows: key, h, size."""
    found, rest = [], plan.where("rest > 0").select("key", "rest")
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        bucket = F.shiftright("h", shift)
        sums = rows.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high"))
        run = F.sum("words").over(Window.partitionBy("key").orderBy("bucket"))
        filled = sums.join(rest, "key").withColumn("until", run).withColumn("before", F.col("until") - F.col("words"))
        edge = saved(filled.where("before <= rest and rest < until"))
        found.append(edge.where("low = high").select("key", F.col("low").alias("edge"), ((F.col("rest") - F.col("before")) / F.col("words")).alias("part")))
        open_ = edge.where("low < high").select("key", F.col("bucket").alias("at"), (F.col("rest") - F.col("before")).alias("rest"))
        if not open_.limit(1).count():
            break
        rows = saved(rows.join(open_.select("key", "at"), "key").where(bucket == F.col("at")).select("key", "h", "size"))
        rest = open_.select("key", "rest")
    return reduce(DataFrame.unionAll, found)


def mix_sources(docs: DataFrame, weights: DataFrame, share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: its id, source, size in words, source_size, target of its source, and taken: the words of it in
    the mix, repeats counted, at most `most` times its size, rounded up.

    weights has source_col and `weight` (above 0), a row for each source, null too; a source without a weight gets nothing.
    Whole documents are taken, but for the one at a source's threshold, of which as many words are taken as the target
    still lacks: a source's sum is its target to within a word. Rows that share their id share their hash; where the
    threshold falls on such rows, each is taken in the same part (rounded, so the sum can miss the target by half a word
    a row). Null ids share one hash. Null and empty texts have size 0 and are taken never. Sources without words get
    target 0. The mix depends on ids and sizes alone, so reruns agree. Extra columns play no part; an empty table
    gives no row.
    """
    source = F.col(source_col)
    slim = saved(docs.select(F.col(id_col).alias("id"), source.alias("source"), _key(source).alias("key"), words(F.col(text_col)).alias("size"), row_hash(F.col(id_col)).alias("h")))
    weighed = weights.select(_key(source).alias("key"), F.col("weight").cast("double").alias("weight"))
    sizes = saved(slim.groupBy("key").agg(F.sum("size").alias("source_size")).join(weighed, "key", "left").fillna(0.0, ["weight"]))
    whole = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0))
    plan = targets(sizes, share, most).withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = saved(plan)
    plan = saved(plan.join(_thresholds(slim.select("key", "h", "size"), plan), "key", "left"))
    once = F.when(F.col("h") < F.col("edge"), F.col("size")).when(F.col("h") == F.col("edge"), F.floor(F.col("size") * F.col("part") + 0.5)).otherwise(F.lit(0))
    taken = (F.col("whole") * F.col("size") + once).cast("long")
    return slim.join(plan, "key").select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"))
