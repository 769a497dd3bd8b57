"""Run ledgers, traces, staleness and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_events(events: DataFrame, run: str, order: list[str]) -> DataFrame:
    """Sequence from 1 within each run."""
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy(run).orderBy(*order)))


def latest(events: DataFrame, run: str, order: list[str], keep: list[str]) -> DataFrame:
    """The last event of each run, with map-side combination instead of a sort."""
    top = F.max(F.struct(*order, *[c for c in keep if c not in order])).alias("_m")
    return events.groupBy(run).agg(top).select(run, *[F.col(f"_m.{c}").alias(c) for c in keep])


def next_sequence(rows: DataFrame, by: str, sequence: str) -> DataFrame:
    return rows.groupBy(by).agg((F.coalesce(F.max(sequence), F.lit(0)) + 1).alias("next_sequence"))


def recent(rows: DataFrame, by: str, sequence: str, n: int) -> DataFrame:
    """The last n rows of each group, numbered oldest first."""
    back = Window.partitionBy(by).orderBy(F.col(sequence).desc())
    kept = rows.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= n)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(sequence))).drop("_back")


def stale_entries(entries: DataFrame, claims: DataFrame, evidence: DataFrame, versions: DataFrame, links: DataFrame) -> DataFrame:
    """entry_id, stale, reasons. An entry is stale if one of its claims or pieces of evidence is gone, a source's version
    has changed, a claim has no support among its evidence, or a later entry supersedes it."""
    ref = entries.select("entry_id", F.explode_outer("claim_ids").alias("claim_id"))
    claim_gone = ref.join(claims.where("status <> 'withdrawn'").select("claim_id", F.lit(True).alias("ok")), "claim_id", "left").where("claim_id is not null and ok is null").select("entry_id", F.lit("claim").alias("reason"))
    ev = entries.select("entry_id", F.explode_outer("evidence_ids").alias("evidence_id")).where("evidence_id is not null")
    held = ev.join(evidence.select("evidence_id", "paper_id", "source_version"), "evidence_id", "left")
    ev_gone = held.where("paper_id is null").select("entry_id", F.lit("evidence").alias("reason"))
    moved = held.join(versions.select("paper_id", F.col("source_version").alias("now")), "paper_id", "left").where("paper_id is not null and not (source_version <=> now)").select("entry_id", F.lit("version").alias("reason"))
    backed = links.where("relation = 'supports'").select("claim_id", "evidence_id").join(ev, "evidence_id").select("entry_id", "claim_id").distinct()
    bare = ref.where("claim_id is not null").join(backed, ["entry_id", "claim_id"], "left_anti").select("entry_id", F.lit("support").alias("reason"))
    newer = entries.where("supersedes is not null").select(F.col("supersedes").alias("entry_id"), F.lit("superseded").alias("reason"))
    reasons = claim_gone.unionByName(ev_gone).unionByName(moved).unionByName(bare).unionByName(newer).groupBy("entry_id").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
    return entries.select("entry_id").join(reasons, "entry_id", "left").select("entry_id", F.col("reasons").isNotNull().alias("stale"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def blockers(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Names of the failed checks in their order, and whether the gate is open."""
    named = F.array_compact(F.array(*[F.when(F.coalesce(~ok, F.lit(True)), name) for name, ok in checks]))
    return rows.withColumn("blockers", named).withColumn("ready", F.size("blockers") == 0)


def elimination_schedule(candidates: int, rounds: int, final: int, entry: int = 50) -> list[int]:
    """Removals of each round: the rest spread over the rounds left, rounded up."""
    left, out = min(entry, candidates), []
    goal = min(final, left)
    for r in range(rounds, 0, -1):
        if left <= goal:
            break
        out.append(-(-(left - goal) // r))
        left -= out[-1]
    return out


def group_quotas(groups: DataFrame, quota: Column, by: str = "batch") -> DataFrame:
    """Largest-remainder shares of a batch's quota by group size; each group keeps one member.

    groups: batch, pos, size. The shares are floors, then one more each by falling remainder where room is left; a second
    round of the same kind takes what the first could not place.
    """
    total = Window.partitionBy(by)
    room = F.col("size") - 1
    exact = F.col("quota") * F.col("size") / F.sum("size").over(total)
    g = groups.withColumn("quota", quota).withColumn("exact", exact).withColumn("share", F.least(F.floor("exact"), room)).withColumn("frac", F.col("exact") - F.floor("exact"))
    # Unplaced units go round by round in order of the remainder: unit n of a group comes before unit n + 1 of any.
    g = g.withColumn("left", F.col("quota") - F.sum("share").over(total))
    units = g.select(by, "pos", "frac", "left", F.explode(F.when(room > F.col("share"), F.sequence(F.lit(1), (room - F.col("share")).cast("int")))).alias("unit"))
    turn = Window.partitionBy(by).orderBy("unit", F.round("frac", 12).desc(), "pos")
    given = units.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= F.col("left")).groupBy(by, "pos").agg(F.count("*").alias("more"))
    return g.join(given, [by, "pos"], "left").select(by, "pos", "size", (F.col("share") + F.coalesce("more", F.lit(0))).cast("long").alias("quota"))
