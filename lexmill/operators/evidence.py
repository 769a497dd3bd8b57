"""Evidence, provenance and acceptance checks: issues come out as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _issues(rows: DataFrame, keys: list[str], checks: list[tuple[str, Column]]) -> DataFrame:
    """One row for each failed check of each row; a check that is null has failed."""
    named = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks]))
    return rows.select(*keys, F.explode(named).alias("issue"))


def evidence_issues(refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(ref_id, issue) of refs (ref_id, paper_id, block_id, char_start, char_end, quote) against blocks (block_id, paper_id,
    text): missing_block, else wrong_paper, bad_range and quote_mismatch. Offsets are code points, end exclusive."""
    own = blocks.select("block_id", F.col("paper_id").alias("b_paper"), F.col("text").alias("b_text"))
    both = refs.join(own, "block_id", "left")
    there = F.col("b_paper").isNotNull()
    ranged = (F.col("char_start") >= 0) & (F.col("char_start") < F.col("char_end")) & (F.col("char_end") <= F.length("b_text"))
    said = F.substring(F.col("b_text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    quoted = F.col("quote").isNull() | ~F.coalesce(ranged, F.lit(False)) | (said == F.col("quote"))
    return _issues(both, ["ref_id"], [("missing_block", there), ("wrong_paper", ~there | (F.col("b_paper") == F.col("paper_id"))), ("bad_range", ~there | ranged), ("quote_mismatch", ~there | quoted)])


def block_lookup(requests: DataFrame, blocks: DataFrame, ids: str = "block_ids") -> DataFrame:
    """Blocks asked for by a list of ids (request_id, ids) with their position in it; unknown ids are left out."""
    asked = requests.select("request_id", F.posexplode(ids).alias("pos", "block_id"))
    return asked.join(blocks, "block_id")


def requested_blocks(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks asked for by rows (request_id, pos, block_id): for requests too long for one list; unknown ids are left out."""
    return asked.join(blocks, "block_id")


def field_mismatch(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side alone: missing (expected only) or unknown (found only)."""
    a = expected.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = found.select(*keys).distinct().withColumn("_b", F.lit(True))
    return a.join(b, keys, "full").where("_a is null or _b is null").select(*keys, F.when(F.col("_b").isNull(), "missing").otherwise("unknown").alias("issue"))


def evaluate_fields(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Gold fields with predictions: status_match, value_match (null unless values are judged) and the kind of mismatch.

    gold: expected_status, acceptable (array, null: not judged); predicted: status, value. A field without a prediction is
    `missing`.
    """
    both = gold.join(predicted, keys, "left")
    status = F.coalesce("status", F.lit("missing"))
    match = status == F.col("expected_status")
    value = F.when(F.col("acceptable").isNotNull() & match & F.col("value").isNotNull(), F.array_contains("acceptable", F.col("value")))
    kind = F.when(match, None).when(status == "missing", "no_prediction").when(F.col("expected_status") == "not_reported", "invented").when(status == "not_reported", "overlooked").otherwise("other")
    return both.select(*keys, match.alias("status_match"), value.alias("value_match"), kind.alias("mismatch"))


def duplicate_links(links: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Links with the last one of each key kept, as an upsert leaves them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return links.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def admission(evidence: DataFrame, queries: DataFrame, versions: DataFrame) -> DataFrame:
    """(evidence_id, issue): evidence whose query is unknown or of another session, or whose source version has moved."""
    q = queries.select("query_id", F.col("session_id").alias("q_session"))
    v = versions.select("paper_id", F.col("source_version").alias("now"))
    rows = evidence.join(q, "query_id", "left").join(v, "paper_id", "left")
    known = F.col("q_session").isNotNull()
    return _issues(rows, ["evidence_id"], [("unknown_query", known), ("other_session", ~known | (F.col("q_session") == F.col("session_id"))), ("unknown_source", F.col("now").isNotNull()), ("moved_source", F.col("now").isNull() | F.col("now").eqNullSafe(F.col("source_version")))])


def traceable(refs: DataFrame) -> DataFrame:
    """(ref_id, issue): refs that lack a block, a quote, pages or a section path."""
    full = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return _issues(refs, ["ref_id"], [("no_block", F.col("block_id") != ""), ("no_quote", F.trim("quote") != ""), ("no_pages", full("pages")), ("no_section", full("section_path"))])


def resolve_entities(proposals: DataFrame, entities: DataFrame) -> DataFrame:
    """proposal_id, entity_id, decision of proposals (proposal_id, name_key) against entities (entity_id, name_key, alias_keys):
    a canonical name first, else an alias; several entities are ambiguous, none is new."""
    canon = entities.select("entity_id", F.col("name_key").alias("key"), F.lit(0).alias("tier"))
    alias = entities.select("entity_id", F.explode("alias_keys").alias("key"), F.lit(1).alias("tier"))
    # a key's entities are one row before proposals meet them: two differ where least and greatest do
    held = canon.unionByName(alias).groupBy("key", "tier").agg(F.min("entity_id").alias("least"), F.max("entity_id").alias("most"))
    hits = proposals.join(held, proposals.name_key == F.col("key")).groupBy("proposal_id", "tier").agg(F.min("least").alias("entity_id"), F.max("most").alias("most"))
    best = hits.groupBy("proposal_id").agg(F.min(F.struct("tier", "entity_id", "most")).alias("h"))
    sole = F.col("h.entity_id") == F.col("h.most")
    decision = F.when(F.col("h").isNull(), "new").when(~F.coalesce(sole, F.lit(False)), "ambiguous").when(F.col("h.tier") == 0, "exact").otherwise("alias")
    return proposals.select("proposal_id").join(best.hint("merge"), "proposal_id", "left").select("proposal_id", F.when(sole, F.col("h.entity_id")).alias("entity_id"), decision.alias("decision"))


def same_topic(pairs: DataFrame, a: Column, b: Column, least: float = 0.6) -> DataFrame:
    """Pairs with `score`, the Jaccard overlap of their word arrays, where it reaches `least`; equal arrays score 1."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    score = F.when(F.size(F.array_union(x, y)) > 0, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)
    return pairs.withColumn("score", score).where(F.col("score") >= least)


def freshness(rows: DataFrame) -> DataFrame:
    """Adds `state`, the first that holds: unsupported, missing, error, stale, ready. Columns: supported, built, provenance_ok,
    fingerprint, expected, build_ok."""
    state = (
        F.when(~F.coalesce("supported", F.lit(False)), "unsupported")
        .when(~F.coalesce("built", F.lit(False)), "missing")
        .when(~F.coalesce("provenance_ok", F.lit(False)), "error")
        .when(~F.coalesce(F.col("fingerprint") == F.col("expected"), F.lit(False)), "stale")
        .when(~F.coalesce("build_ok", F.lit(False)), "error")
        .otherwise("ready")
    )
    return rows.withColumn("state", state)


def interleave(rows: DataFrame, group: str, item: str, seed: int) -> DataFrame:
    """Groups take turns, in an order of groups and of each one's items drawn by seed: adds `turn` and `group_key`, by
    which a range sort gives the whole order without a task that holds all rows."""
    key = lambda c: F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), F.col(c).cast("string")), 256)
    turn = F.row_number().over(Window.partitionBy(group).orderBy(key(item), item))
    return rows.withColumn("turn", turn).withColumn("group_key", key(group))
