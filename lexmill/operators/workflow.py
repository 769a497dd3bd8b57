"""Workflow over records: identity decisions, ledgers, episodes, gold and snapshot checks, builds.

Nulls in keys match nothing unless a docstring says otherwise; ties fall to the smaller key named last in each order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T

TARGET_RECALL = 0.90
SAME_TOPIC = 0.6


def _issues(pairs: list[tuple[str, Column]]) -> Column:
    """Names whose condition holds (null: not), in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]))


def below_target(results: DataFrame, variant: str = "hybrid_rerank") -> DataFrame:
    """Completed queries of the default variant (variant, status, recall) under the target; a null recall counts as 0."""
    return results.where((F.col("variant") == variant) & (F.col("status") == "ok") & (F.coalesce("recall", F.lit(0.0)) < TARGET_RECALL))


def recall_episodes(records: DataFrame, query: str, k: int) -> DataFrame:
    """The k records (memory_id, created_at, text) that share most words with the query, with their share of its words.

    An empty query gives all records, with 0; else records without a shared word are left out. Ties: the oldest first,
    then the id. Null texts share nothing.
    """
    terms = F.array_distinct(F.regexp_extract_all(F.lower(F.lit(query)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    words = F.coalesce(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.array().cast("array<string>"))
    scored = records.withColumn("relevance", F.size(F.array_intersect(terms, words)) / F.greatest(F.size(terms), F.lit(1)))
    return scored.where((F.col("relevance") > 0) | (F.size(terms) == 0)).orderBy(F.col("relevance").desc(), "created_at", "memory_id").limit(k)


def best_topic_match(entries: DataFrame, titles: DataFrame) -> DataFrame:
    """title_id, entry_id, score: for each title the entry of its workspace with the largest Jaccard similarity of words,
    1 where the titles are equal but for case and outer blanks; at least SAME_TOPIC, ties to the smaller entry_id.

    Equal titles of a workspace are compared as one. Titles meet entries by the rarest of their words, as many as any pair that
    reaches SAME_TOPIC must share one of, so frequent words bring no pairs. Titles without a word match nothing.
    """
    words = lambda c: F.array_sort(T.word_set(F.col(c)))
    known = lambda df, n: df.select("workspace_id", f"{n}_id", F.lower(F.trim("title")).alias("title"), words("title").alias("words")).where("workspace_id is not null and size(words) > 0")
    e = known(entries, "entry").groupBy("workspace_id", "title", "words").agg(F.min("entry_id").alias("entry_id"))
    every = known(titles, "title")
    t = every.select("workspace_id", "title", "words").distinct()
    often = e.select("workspace_id", F.explode("words").alias("w")).groupBy("workspace_id", "w").agg(F.count("*").alias("n"))
    order = Window.partitionBy("workspace_id", "title", "words").orderBy("n", "w")
    some = F.size("words") - F.ceil(F.lit(SAME_TOPIC) * F.size("words") - 1e-9) + 1

    def rare(df: DataFrame) -> DataFrame:
        held = df.withColumn("w", F.explode("words")).join(often, ["workspace_id", "w"], "left").fillna(0, ["n"])
        return held.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= some).drop("_rn", "n")

    a, b = rare(t), rare(e).withColumnsRenamed({"title": "e_title", "words": "e_words"})
    fits = (F.size("words") * SAME_TOPIC <= F.size("e_words") + 1e-9) & (F.size("e_words") * SAME_TOPIC <= F.size("words") + 1e-9)
    met = a.join(b, ["workspace_id", "w"]).where(fits).drop("w").distinct()
    both = F.size(F.array_intersect("words", "e_words"))
    score = F.when(F.col("title") == F.col("e_title"), 1.0).otherwise(both / (F.size("words") + F.size("e_words") - both))
    best = met.withColumn("score", score).where(F.col("score") >= SAME_TOPIC).groupBy("workspace_id", "title", "words").agg(F.min(F.struct(-F.col("score"), "entry_id", "score")).alias("m"))
    return every.join(best.hint("merge"), ["workspace_id", "title", "words"]).select("workspace_id", "title_id", "m.entry_id", "m.score")


def fan_out(hits: DataFrame, per_paper: int, k: int) -> DataFrame:
    """Hits (query_id, paper_id, chunk_id, local_score, global_score): the per_paper best of each paper by its own score,
    then the k best of each query by the global one. Local scores of two papers are never compared."""
    own = Window.partitionBy("query_id", "paper_id").orderBy(F.col("local_score").desc(), "chunk_id")
    few = hits.withColumn("local_rank", F.row_number().over(own)).where(F.col("local_rank") <= per_paper)
    every = Window.partitionBy("query_id").orderBy(F.col("global_score").desc(), "paper_id", "chunk_id")
    return few.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= k)


def number_candidates(hits: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Hits with evidence_id E1, E2, ... by rank; equal ranks keep the order of the columns given."""
    w = Window.partitionBy(*by).orderBy("rank", *order)
    return hits.withColumn("evidence_id", F.concat(F.lit("E"), F.row_number().over(w).cast("string")))


def converge_endpoints(papers: DataFrame, relations: DataFrame) -> DataFrame:
    """Papers (id, status) after decisions on relations (source_id, target_id, status): one that waits for a decision
    (duplicate_candidate) and has no pending relation left is active; others stay as they are."""
    pending = relations.where("status = 'pending'").select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct().withColumn("_open", F.lit(True))
    return papers.join(pending, "id", "left").withColumn("status", F.when((F.col("status") == "duplicate_candidate") & F.col("_open").isNull(), "active").otherwise(F.col("status"))).drop("_open")


def canonical_value(field: Column, value: Column) -> Column:
    """The value by which two candidates of a field are the same; nulls and blanks: empty."""
    plain = F.lower(T.collapse(value))
    return F.coalesce(F.when(field == "title", T.normalize_title(value, fold=False)).when(field == "doi", T.normalize_doi(value)).when(field == "arxiv_id", T.normalize_arxiv(value)).when(field == "publication_year", F.coalesce(F.trim(value).try_cast("int").cast("string"), F.trim(value))).otherwise(plain), F.lit(""))


def distinct_candidates(candidates: DataFrame, order: list[str]) -> DataFrame:
    """Candidates (paper_id, file_id, field, value, source_type, source_location) without those that repeat the canonical
    value of an earlier one of the same field and source."""
    keyed = candidates.withColumn("_value", canonical_value(F.col("field"), F.col("value")))
    w = Window.partitionBy("paper_id", "file_id", "field", "source_type", "source_location", "_value").orderBy(*order)
    return keyed.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_value")


def set_primary(files: DataFrame, chosen: DataFrame) -> DataFrame:
    """files (paper_id, file_id, is_primary) after chosen (paper_id, file_id) became primary: one a paper. A choice of a
    file that the paper has not changes nothing."""
    real = chosen.join(files.select("paper_id", "file_id"), ["paper_id", "file_id"], "left_semi").select("paper_id", F.col("file_id").alias("_chosen"))
    return files.join(real, "paper_id", "left").withColumn("is_primary", F.coalesce(F.col("file_id") == F.col("_chosen"), F.col("is_primary"))).drop("_chosen")


def promotion_issues(candidates: DataFrame) -> DataFrame:
    """candidate_id, issues: candidates (status, workspace_id, agent_run_id, own_workspace_id, own_run_id, claim_ids,
    evidence_ids; claim_evidence and evidence_claims: maps of id to ids of those eligible) whose references do not agree
    both ways. No issue: accepted."""
    claims, evidence = F.coalesce("claim_ids", F.array().cast("array<string>")), F.coalesce("evidence_ids", F.array().cast("array<string>"))
    empty = F.array().cast("array<string>")
    one_way = F.exists(claims, lambda c: ~F.arrays_overlap(F.coalesce(F.element_at("claim_evidence", c), empty), evidence))
    other_way = F.exists(evidence, lambda e: ~F.arrays_overlap(F.coalesce(F.element_at("evidence_claims", e), empty), claims))
    unknown_claim = F.exists(claims, lambda c: ~F.map_contains_key("claim_evidence", c))
    unknown_evidence = F.exists(evidence, lambda e: ~F.map_contains_key("evidence_claims", e))
    found = [("not_proposed", ~F.col("status").eqNullSafe("proposed")), ("other_workspace", ~F.col("workspace_id").eqNullSafe(F.col("own_workspace_id"))), ("other_run", ~F.col("agent_run_id").eqNullSafe(F.col("own_run_id"))), ("no_provenance", (F.size(claims) == 0) | (F.size(evidence) == 0)), ("unknown_claim", unknown_claim), ("unknown_evidence", unknown_evidence), ("claims_disagree", one_way), ("evidence_unrelated", other_way)]
    return candidates.select("candidate_id", _issues(found).alias("issues"))


def canonical_hash(payload: Column) -> Column:
    """SHA-256 of a struct's compact JSON with the fields of it and of what it holds in the order of their names; nulls are
    kept. Maps must have text keys."""
    return F.sha2(F.to_json(F.to_variant_object(payload)), 256)


def build_fingerprints(members: DataFrame, runs: DataFrame) -> DataFrame:
    """workspace_id, fingerprint over the inputs of a build: workspace and schema (members: workspace_id, schema_id,
    schema_version, schema_hash, paper_id) and each paper's run (runs: paper_id, run_id; none: null). The order of rows and
    repeated ones make no difference."""
    both = members.distinct().join(runs.groupBy("paper_id").agg(F.max("run_id").alias("run_id")), "paper_id", "left")
    each = both.groupBy("workspace_id", "schema_id", "schema_version", "schema_hash").agg(F.sort_array(F.collect_list(F.struct("paper_id", "run_id"))).alias("runs"))
    schema = F.struct(F.col("schema_hash").alias("hash"), F.col("schema_id").alias("id"), F.col("schema_version").alias("version"))
    return each.select("workspace_id", canonical_hash(F.struct(F.col("runs.paper_id").alias("membership"), schema.alias("schema"), F.col("runs").alias("schema_runs"), "workspace_id")).alias("fingerprint"))


def collect_episodes(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """run_id, useful, failed: sorted query ids of each run (queries: run_id, query_id, status). A query is useful if it
    succeeded and evidence (source_query_id) was admitted from it; else it failed."""
    admitted = evidence.select(F.col("source_query_id").alias("query_id")).distinct().withColumn("_has", F.lit(True))
    good = F.coalesce((F.col("status") == "success") & F.col("_has"), F.lit(False))
    both = queries.join(admitted, "query_id", "left")
    return both.groupBy("run_id").agg(F.sort_array(F.collect_list(F.when(good, F.col("query_id")))).alias("useful"), F.sort_array(F.collect_list(F.when(~good, F.col("query_id")))).alias("failed"))


def membership_revisions(changes: DataFrame) -> DataFrame:
    """Changes (workspace_id, paper_id, op: add or remove, at) that took effect, with the workspace's revision after each,
    from 1. Adding a member, or removing one that is none, has no effect."""
    own = Window.partitionBy("workspace_id", "paper_id").orderBy("at")
    effective = changes.withColumn("_was", F.coalesce(F.lag("op").over(own), F.lit("remove"))).where(F.col("op") != F.col("_was")).drop("_was")
    return effective.withColumn("revision", F.row_number().over(Window.partitionBy("workspace_id").orderBy("at", "paper_id")))


def reconcile_turns(turns: DataFrame, active: DataFrame) -> DataFrame:
    """Turns (run_id, run_status, turn_status, has_answer) after a restart, with new_run and new_turn. A run created but
    never begun fails with its turn; a turn left open by an ended run takes the run's end, and fails if a completed run
    has no answer. Runs in active (run_id) stay."""
    live = active.select("run_id").distinct().withColumn("_live", F.lit(True))
    t = turns.join(live, "run_id", "left")
    idle = F.col("_live").isNull()
    orphan = idle & (F.col("run_status") == "created") & (F.col("turn_status") == "preparing")
    ended = idle & F.col("run_status").isin("completed", "failed", "cancelled") & F.col("turn_status").isin("preparing", "running")
    answer = F.when((F.col("run_status") == "completed") & F.col("has_answer"), "completed").otherwise("failed")
    return t.withColumn("new_run", F.when(orphan, "failed").otherwise(F.col("run_status"))).withColumn("new_turn", F.when(orphan, "failed").when(ended, answer).otherwise(F.col("turn_status"))).drop("_live")


def in_use(papers: DataFrame, memberships: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Papers (id) that a workspace not deleted holds: they cannot be deleted."""
    alive = workspaces.where("status <> 'deleted'").select("workspace_id")
    held = memberships.join(alive, "workspace_id", "left_semi").select(F.col("paper_id").alias("id"))
    return papers.join(held, "id", "left_semi")


def maintenance_items(checks: dict[str, tuple[DataFrame, DataFrame]], key: str) -> DataFrame:
    """kind, key of rows of each check's left side that its right side lacks."""
    found = [a.join(b.select(key).distinct(), key, "left_anti").select(F.lit(kind).alias("kind"), key) for kind, (a, b) in checks.items()]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def import_trace(jobs: DataFrame) -> DataFrame:
    """paper_id, steps: the six steps of an import in order, each done, skipped after a step that is not, or failed. jobs:
    paper_id and a boolean for each step (null: not reached)."""
    names = ["stored", "read", "candidates", "selected", "identity", "gate"]
    state, ok = [], F.lit(True)
    for n in names:
        state.append(F.struct(F.lit(n).alias("step"), F.when(~ok, "skipped").when(F.col(n), "done").when(F.col(n).isNull(), "pending").otherwise("failed").alias("state")))
        ok = ok & F.coalesce(F.col(n), F.lit(False))
    return jobs.select("paper_id", F.array(*state).alias("steps"))


def clean_aliases(names: DataFrame) -> DataFrame:
    """entity_id, aliases: spellings (entity_id, canonical, spelling, pos) in order, single-spaced, without repeats but for
    case and without the canonical name itself. An entity whose spellings all go keeps an empty list."""
    spelt = names.withColumn("_s", T.collapse(F.col("spelling"))).withColumn("_k", F.lower("_s"))
    good = (F.col("_s") != "") & (F.col("_k") != F.lower(T.collapse(F.col("canonical"))))
    first = spelt.groupBy("entity_id", "_k").agg(F.min(F.struct("pos", "_s")).alias("z"), F.first(good).alias("good"))
    kept = F.array_sort(F.collect_list(F.when(F.col("good"), F.col("z"))))
    return first.groupBy("entity_id").agg(F.transform(kept, lambda z: z["_s"]).alias("aliases"))


def gold_structure(gold: DataFrame, types: list[str]) -> DataFrame:
    """query_id, issues of gold queries (query_id, paper_id, query, query_type, gold_block_ids) that are not well formed."""
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    ids = F.col("gold_block_ids")
    found = [("empty_paper", blank("paper_id")), ("empty_query", blank("query")), ("illegal_type", ~F.coalesce(F.col("query_type").isin(types), F.lit(False))), ("no_gold_blocks", F.coalesce(F.size(ids) == 0, F.lit(True)) | ids.isNull()), ("empty_block_id", F.exists(ids, lambda b: F.coalesce(b == "", F.lit(True))))]
    return gold.select("query_id", _issues(found).alias("issues")).where(F.size("issues") > 0)


def select_one(records: DataFrame, chosen: DataFrame, owner: str, key: str) -> DataFrame:
    """records with is_selected true for the chosen record of an owner and false for its others; owners without a choice
    stay as they are."""
    picked = chosen.select(owner, F.col(key).alias("_picked"))
    return records.join(picked, owner, "left").withColumn("is_selected", F.when(F.col("_picked").isNotNull(), F.col(key) == F.col("_picked")).otherwise(F.col("is_selected"))).drop("_picked")


def commit_promotions(entries: DataFrame, cycles: DataFrame) -> DataFrame:
    """Entries (run_id, ...) of runs whose promotion was not committed before (cycles: run_id): each run once."""
    return entries.join(cycles.select("run_id"), "run_id", "left_anti")


def compatible_runs(runs: DataFrame, bindings: DataFrame) -> DataFrame:
    """runs (workspace_id, paper_id, schema_id, version, hash) with compatible: whether they match the workspace's binding
    in all three, nulls matching nulls. Runs of a workspace without binding do not."""
    b = bindings.select("workspace_id", F.struct("schema_id", "version", "hash").alias("_b"))
    return runs.join(b, "workspace_id", "left").withColumn("compatible", F.col("_b").isNotNull() & F.struct("schema_id", "version", "hash").eqNullSafe(F.col("_b"))).drop("_b")


def line_map(blocks: DataFrame, by: str, order: str, lines: Column) -> DataFrame:
    """first_line and last_line of each block in its document's rendering: its lines and a blank one after them. Blocks
    without a line have no entry."""
    sized = blocks.withColumn("_n", lines).where("_n > 0")
    end = F.sum(F.col("_n") + 1).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sized.withColumn("last_line", end).withColumn("first_line", F.col("last_line") - F.col("_n")).drop("_n")


def json_matches_type(value: Column, kind: Column, options: Column | None = None) -> Column:
    """Whether a JSON text has the type named (string, number, boolean, enum, list, object). JSON null and a null text
    always have it; a boolean is no number; text that is no JSON has none."""
    v = F.try_parse_json(value)
    shape = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    told = F.when(kind == "string", shape == "STRING").when(kind == "number", shape.rlike("^(BIGINT|DOUBLE|DECIMAL)")).when(kind == "boolean", shape == "BOOLEAN").when(kind == "list", shape.startswith("ARRAY")).when(kind == "object", shape.startswith("OBJECT"))
    if options is not None:
        told = F.when(kind == "enum", (shape == "STRING") & F.array_contains(options, text)).otherwise(told)
    return F.coalesce(value.isNull() | (shape == "VOID") | told, F.lit(False))


def is_assertive(value: Column) -> Column:
    """Whether a JSON text says something: not null, nor an empty string, list or object."""
    return F.coalesce(~F.trim(value).rlike(r'^(null|""|\[\s*\]|\{\s*\})$'), F.lit(False))


def field_query(*parts: Column) -> Column:
    """The parts that are not blank, trimmed and joined by a bar."""
    return F.array_join(F.filter(F.array(*[F.trim(p) for p in parts]), lambda p: p != ""), " | ")


def filename_arxiv(name: Column) -> Column:
    """The arXiv id that a file name without its extension is, normalised; null if none or not valid."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    found = T.normalize_arxiv(F.when(stem.rlike(r"^(?i)(arxiv[:_-]?)?[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?$"), F.regexp_replace(stem, r"^(?i)arxiv[:_-]?", "")))
    return F.when(T.valid_arxiv(found), found)


def crossref_fields(raw: Column) -> Column:
    """Title, authors, year, venue, publisher, doi and abstract of a provider's JSON message; nulls where it has none."""
    get = lambda p: F.get_json_object(raw, p)
    people = F.from_json(get("$.message.author"), "array<struct<given:string,family:string>>")
    names = F.filter(F.transform(people, lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))), lambda n: n != "")
    year = F.coalesce(*[get(f"$.message['{k}']['date-parts'][0][0]").try_cast("int") for k in ("published-print", "published-online", "issued", "created")])
    return F.struct(get("$.message.title[0]").alias("title"), F.coalesce(names, F.array().cast("array<string>")).alias("authors"), year.alias("year"), get("$.message['container-title'][0]").alias("venue"), get("$.message.publisher").alias("publisher"), get("$.message.DOI").alias("doi"), _plain(get("$.message.abstract")).alias("abstract"))


def _plain(markup: Column) -> Column:
    return F.nullif(T.strip_tags(markup), F.lit(""))


def _work(title: Column, names: Column, year: Column, venue: Column, doi: Column, abstract: Column) -> Column:
    people = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n != "")
    return F.struct(title.alias("title"), people.alias("authors"), year.try_cast("int").alias("year"), venue.alias("venue"), F.lit(None).cast("string").alias("publisher"), doi.alias("doi"), abstract.alias("abstract"))


def openalex_fields(raw: Column) -> Column:
    """The fields of crossref_fields from a work of the second provider, whose publisher is never told; the venue is that of
    the primary place, else of the best open one, else of the first place that has one."""
    get = lambda p: F.nullif(F.get_json_object(raw, p), F.lit(""))
    people = F.from_json(get("$.authorships"), "array<struct<author:struct<display_name:string>>>")
    places = F.transform(F.from_json(get("$.locations"), "array<struct<source:struct<display_name:string>>>"), lambda p: p["source"]["display_name"])
    venue = F.coalesce(get("$.primary_location.source.display_name"), get("$.best_oa_location.source.display_name"), F.get(F.filter(places, lambda v: v != ""), F.lit(0)))
    return _work(F.coalesce(get("$.title"), get("$.display_name")), F.transform(people, lambda a: a["author"]["display_name"]), get("$.publication_year"), venue, get("$.doi"), T.rebuild_abstract(F.from_json(F.get_json_object(raw, "$.abstract_inverted_index"), "map<string,array<int>>")))


def semantic_scholar_fields(raw: Column) -> Column:
    """The fields of crossref_fields from a paper of the third provider; a DOI may stand among its outer ids."""
    get = lambda p: F.nullif(F.get_json_object(raw, p), F.lit(""))
    people = F.from_json(get("$.authors"), "array<struct<name:string>>")
    return _work(get("$.title"), F.transform(people, lambda a: a["name"]), get("$.year"), F.coalesce(get("$.venue"), get("$.journal")), F.coalesce(get("$.doi"), get("$.externalIds.DOI")), _plain(get("$.abstract")))
