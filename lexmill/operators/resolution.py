"""Decided duplicates merged: decisions, groups of confirmed relations, canonical records, and keys rewritten with an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.sources.checkpoints import written


def _shuffled(df: DataFrame) -> DataFrame:
    """df to be joined by its keys: keys and labels pack so well that by the size of their files they would be broadcast, through
    the driver, whatever their number."""
    return df.hint("merge")


# States of a relation, and decisions with the state that each leads to.
PENDING = "pending"
DECISIONS = {"confirm": "confirmed", "reject": "rejected", "ignore": "ignored"}


def decide(relations: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations with their new status, audit: relation_id, action, old_status, new_status, actor, at).

    relations: relation_id, source, target, status; decisions: relation_id, decision, actor, at. Of several decisions on
    one relation the first counts (at, then actor, then decision; null times last). What cannot be done changes nothing and
    is audited too: action is `unknown_relation`, `unknown_decision`, `not_pending` or `late` instead of `decided`.
    """
    order = Window.partitionBy("relation_id").orderBy(F.col("known").desc(), F.col("at").asc_nulls_last(), "actor", "decision")
    known = F.coalesce(F.col("decision").isin(list(DECISIONS)), F.lit(False))
    told = decisions.withColumn("known", known).withColumn("n", F.row_number().over(order)).join(_shuffled(relations.select("relation_id", F.col("status").alias("old_status"))), "relation_id", "left")
    action = F.when(F.col("old_status").isNull(), "unknown_relation").when(~F.col("known"), "unknown_decision").when(F.col("old_status") != PENDING, "not_pending").when(F.col("n") > 1, "late").otherwise("decided")
    state = F.create_map(*[F.lit(x) for pair in DECISIONS.items() for x in pair])
    audit = told.withColumn("action", action).withColumn("new_status", F.when(F.col("action") == "decided", state[F.col("decision")]).otherwise(F.col("old_status")))
    audit = audit.select("relation_id", "action", "old_status", "new_status", "actor", "at")
    done = audit.where("action = 'decided'").select("relation_id", F.col("new_status").alias("decided"))
    return relations.join(_shuffled(done), "relation_id", "left").withColumn("status", F.coalesce("decided", "status")).drop("decided"), audit


def groups(relations: DataFrame) -> DataFrame:
    """node and its group, the smallest node that confirmed relations (source, target) lead to. Nulls and relations of a
    record with itself are left out. Each round takes the least label of the neighbours and that label's own label, so long
    chains close in few rounds; the driver sees one count a round."""
    e = relations.where("status = 'confirmed' and source <> target").select("source", "target")
    both = written(e.unionAll(e.select("target", "source")).toDF("u", "v").distinct())
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("grp")))
    while True:
        near = both.join(_shuffled(labels.select(F.col("node").alias("v"), F.col("grp").alias("g"))), "v").groupBy("u").agg(F.min("g").alias("g"))
        hooked = labels.join(_shuffled(near), labels.node == near.u).select("node", F.col("grp").alias("old"), F.least("grp", "g").alias("grp"))
        up = labels.select(F.col("node").alias("p"), F.col("grp").alias("above"))
        step = written(hooked.join(_shuffled(up), hooked.grp == up.p, "left").select("node", "old", F.least("grp", F.coalesce("above", "grp")).alias("grp")))
        if not step.where("old <> grp").limit(1).count():
            return step.select("node", "grp")
        labels = step.select("node", "grp")


def canonical(records: DataFrame, relations: DataFrame, key: str, best: list[Column]) -> DataFrame:
    """old and new: the key of each merged record and of the record of its group that comes first by `best`, ties to the
    smaller key. Records outside of any group, and those that stay, have no row; relations to unknown records join nothing.
    """
    known = records.select(F.col(key).alias("node"))
    sound = relations.join(_shuffled(known.select(F.col("node").alias("source"))), "source", "left_semi").join(_shuffled(known.select(F.col("node").alias("target"))), "target", "left_semi")
    member = records.join(_shuffled(groups(sound)), F.col(key) == F.col("node"))
    order = [F.struct(*[c.alias(f"o{i}") for i, c in enumerate(best)], F.col(key).alias("k"))]
    first = member.groupBy("grp").agg(F.min(order[0])["k"].alias("new"))
    return member.select("grp", F.col(key).alias("old")).join(_shuffled(first), "grp").where("old <> new").select("old", "new")


def rewrite(table: DataFrame, name: str, key: str, column: str, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table with `column` led to the canonical keys, audit: table_name, row_key, column_name, old_value, new_value of
    every row changed). mapping: old, new. Rows are neither lost nor repeated; nulls stay."""
    led = table.join(_shuffled(mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))), F.col(column) == F.col("_old"), "left")
    text = lambda c: F.col(c).cast("string")
    audit = led.where("_new is not null").select(F.lit(name).alias("table_name"), text(key).alias("row_key"), F.lit(column).alias("column_name"), text(column).alias("old_value"), text("_new").alias("new_value"))
    return led.withColumn(column, F.coalesce("_new", column)).select(table.columns), audit


def record_states(records: DataFrame, relations: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """key, state, canonical: `merged` records with where they went, `duplicate_pending` ones that a pending relation
    touches, and `active` ones."""
    pending = relations.where(F.col("status") == PENDING)
    touched = pending.select(F.col("source").alias(key)).unionAll(pending.select(F.col("target").alias(key))).distinct().withColumn("_p", F.lit(True))
    told = records.select(key).join(_shuffled(mapping.select(F.col("old").alias(key), F.col("new").alias("canonical"))), key, "left").join(_shuffled(touched), key, "left")
    state = F.when(F.col("canonical").isNotNull(), "merged").when(F.col("_p"), "duplicate_pending").otherwise("active")
    return told.select(key, state.alias("state"), F.coalesce("canonical", key).alias("canonical"))
