"""Acceptance: search variants and their rules, checks of gold, records, annotations and snapshots, promotion, projections.

Checks return one row for each issue, or an array of names; nulls are issues only where a docstring says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import retrieval

# States of fields, judgements, kinds of annotations and units, and the fields that a unit record needs.
FIELD_STATUSES = ["explicit", "inferred", "unclear", "not_found", "not_applicable", "conflicting"]
JUDGEMENTS = ["correct", "partially_correct", "incorrect", "not_evaluated"]
EXPECTATIONS = ["required", "optional", "not_required"]
UNIT_STATUSES = ["passed", "degraded", "failed", "timeout", "dependency_missing", "error"]
UNIT_COUNTS = ["page_count", "section_count", "block_count"]
UNIT_RATIOS = ["meaningful_page_ratio", "replacement_char_ratio", "duplicate_ratio", "provenance_page_coverage", "bbox_coverage", "caption_relation_completeness"]
MULTI_AGENT = ["multiple", "multi-agent", "each bus", "several"]
NO_HOLDING = ["speed control", "stop skipping"]
RERANK_LOSS = 0.05


def _names(pairs: list[tuple[str, Column]]) -> Column:
    """Names whose condition holds (null: not), in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]))


def search_variants(lexical: DataFrame, dense: DataFrame | None, scores: DataFrame, k: int, candidates: int = 30) -> DataFrame:
    """variant, query_id, id, rank of bm25, dense, hybrid (fused by reciprocal ranks) and hybrid_rerank (the fused ones by
    scores: query_id, id, rerank_score), the k best each. Lists have query_id, id, rank; without a dense list it is an error:
    a hybrid search never falls back to words alone."""
    if dense is None:
        raise ValueError("the dense list is unavailable")
    fused = retrieval.rrf(lexical, dense, candidates, candidates=candidates)
    parts = {
        "bm25": lexical.where(F.col("rank") <= k),
        "dense": dense.where(F.col("rank") <= k),
        "hybrid": fused.where(F.col("rrf_rank") <= k).withColumn("rank", F.col("rrf_rank")),
        "hybrid_rerank": retrieval.rerank(fused, scores, k).withColumn("rank", F.col("final_rank")),
    }
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("variant"), "query_id", "id", F.col("rank").cast("long").alias("rank"))
        out = rows if out is None else out.unionByName(rows)
    return out


def acceptance_rules(summary: DataFrame) -> DataFrame:
    """rule, name, passed of summary (grain: overall, type or language; key; variant; status; recall; mrr): null where the
    variants that a rule compares are not there. Repeated rows count by their best."""
    def best(grain: str, key: str | None, variant: str, metric: str) -> Column:
        here = (F.col("grain") == grain) & F.col("key").eqNullSafe(F.lit(key)) & (F.col("variant") == variant)
        return F.max(F.when(here, F.col(metric)))

    pick = {f"{v}_{m}": best("overall", None, v, m) for v in ("bm25", "dense", "hybrid", "hybrid_rerank") for m in ("recall", "mrr")}
    exact = {f"exact_{v}_{m}": best("type", "exact_term", v, m) for v in ("bm25", "dense") for m in ("recall", "mrr")}
    zh = F.count_if((F.col("grain") == "language") & (F.col("key") == "zh") & (F.col("status") == "ok"))
    one = summary.agg(*[c.alias(n) for n, c in {**pick, **exact}.items()], zh.alias("zh"))
    c = F.col
    kept = [c("exact_bm25_recall") >= c("exact_dense_recall"), c("exact_bm25_mrr") >= c("exact_dense_mrr")]
    none = c("exact_bm25_recall").isNull() & c("exact_dense_recall").isNull() & c("exact_bm25_mrr").isNull() & c("exact_dense_mrr").isNull()
    rules = [
        ("hybrid_recall >= best single", F.greatest("hybrid_recall", "hybrid_rerank_recall") >= F.greatest("bm25_recall", "dense_recall")),
        ("hybrid_rerank mrr >= best single", c("hybrid_rerank_mrr") >= F.greatest("bm25_mrr", "dense_mrr")),
        ("rerank does not hurt recall", c("hybrid_rerank_recall") >= c("hybrid_recall") - RERANK_LOSS),
        ("exact_term keeps bm25 advantage", F.when(~none, F.coalesce(kept[0], F.lit(False)) | F.coalesce(kept[1], F.lit(False)))),
        ("zh (cross-language) results exist", c("zh") > 0),
    ]
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(n).alias("name"), p.alias("passed")) for i, (n, p) in enumerate(rules, 1)])).alias("r")).select("r.*")


def gold_issues(papers: DataFrame, schemas: list[str]) -> DataFrame:
    """paper_no, field_no (null: the paper itself), issue of gold papers: paper_no, paper_id, title, pdf_path, schema_id,
    schema_version, selected, gold_status, fields (array of field_id, expected_status, value_judgement,
    evidence_expectation, acceptable). A null in a required key is an issue; of equal paper ids all but the first are."""
    blank = lambda c: F.coalesce(c == "", F.lit(True))
    path = F.col("pdf_path")
    again = F.row_number().over(Window.partitionBy("paper_id").orderBy("paper_no")) > 1
    own = _names(
        [("paper_missing_required_key", F.exists(F.array("paper_id", "title", "pdf_path", "schema_id", "schema_version"), blank) | F.col("selected").isNull() | (F.coalesce(F.size("fields"), F.lit(0)) == 0))]
        + [("paper_id_duplicate", ~blank(F.col("paper_id")) & again)]
        + [("pdf_path_invalid", path.rlike(r"^([A-Za-z]:|[/\\])|(^|[/\\])\.\.([/\\]|$)"))]
        + [("gold_schema_not_found", ~blank(F.col("schema_id")) & ~F.col("schema_id").isin(schemas))]
    )
    marked = papers.withColumn("_own", own)
    f = F.col("f")
    odd = lambda c, allowed: c.isNotNull() & ~c.isin(allowed)
    template, draft = F.col("gold_status") == "template", F.col("gold_status") == "draft"
    again_f = F.row_number().over(Window.partitionBy("paper_no", "f.field_id").orderBy("field_no")) > 1
    each = marked.select("paper_no", "gold_status", F.posexplode("fields").alias("field_no", "f"))
    judged = [(f["value_judgement"] != "not_evaluated"), f["expected_status"].isNotNull(), f["acceptable"].isNotNull()]
    issues = _names(
        [("field_missing_required_key", F.exists(F.array(f["field_id"], f["value_judgement"], f["evidence_expectation"]), blank))]
        + [("field_id_duplicate", ~blank(f["field_id"]) & again_f)]
        + [("field_expected_status_null", f["expected_status"].isNull() & ~F.coalesce(template | draft, F.lit(False)))]
        + [("field_invalid_expected_status", odd(f["expected_status"], FIELD_STATUSES)), ("field_invalid_value_judgement", odd(f["value_judgement"], JUDGEMENTS)), ("field_invalid_evidence_expectation", odd(f["evidence_expectation"], EXPECTATIONS))]
        + [("template_field_invalid", template & F.coalesce(T.any_of(*judged), F.lit(False)))]
    )
    of_papers = marked.select("paper_no", F.lit(None).cast("int").alias("field_no"), F.explode("_own").alias("issue"))
    return of_papers.unionByName(each.withColumn("_i", issues).select("paper_no", "field_no", F.explode("_i").alias("issue")))


def unit_record_issues(records: DataFrame, required: list[str]) -> DataFrame:
    """unit_id, issues of records (unit_id, raw: a JSON object): missing fields, an unknown status, counts and run times
    below 0 or no numbers, ratios outside 0 to 1. JSON nulls are well; text that is no object lacks every field."""
    v = F.try_parse_json("raw")
    keys = F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>"))
    get = lambda k: F.try_variant_get(v, f"$.{k}", "double")
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    there = lambda k: F.coalesce(kind(k) != "VOID", F.lit(False))
    whole, number = (lambda k: kind(k) == "BIGINT"), (lambda k: kind(k).rlike("^(BIGINT|DOUBLE|DECIMAL)"))
    status = F.try_variant_get(v, "$.status", "string")
    found = [F.transform(F.array_except(F.array(*map(F.lit, required)), keys), lambda k: F.concat(F.lit("missing "), k))]
    found.append(_names([("illegal status", status.isNotNull() & ~status.isin(UNIT_STATUSES))] + [(f"bad {k}", there(k) & ~F.coalesce(whole(k) & (get(k) >= 0), F.lit(False))) for k in UNIT_COUNTS]))
    found.append(_names([("bad runtime_s", there("runtime_s") & ~F.coalesce(number("runtime_s") & (get("runtime_s") >= 0), F.lit(False)))] + [(f"bad {k}", there(k) & ~F.coalesce(number(k) & get(k).between(0, 1), F.lit(False))) for k in UNIT_RATIOS]))
    return records.select("unit_id", F.concat(*found).alias("issues"))


def annotation_issues(lines: DataFrame, items: list[str], reserved: list[str]) -> DataFrame:
    """line_no, issues of annotation lines (line_no, line: JSON) that are not well; blank lines are skipped."""
    v = F.try_parse_json("line")
    get = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    kind = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")), F.lit("VOID"))
    score = F.try_variant_get(v, "$.score", "double")
    told = _names(
        [(f"missing {k}", F.coalesce(get(k) == "", F.lit(True))) for k in ("annotator", "paper", "parser", "item")]
        + [("reserved annotator", F.lower(T.strip(get("annotator"))).isin(reserved)), ("unknown item", (kind("item") != "VOID") & ~F.coalesce(get("item").isin(items), F.lit(False)))]
        + [("bad score", (kind("score") != "VOID") & ~((kind("score") == "BIGINT") & F.coalesce(score.between(1, 5), F.lit(False)))), ("bad date", ~kind("date").isin("VOID", "STRING"))]
    )
    shape = F.schema_of_variant(v)
    issues = F.when(v.isNull(), F.array(F.lit("not JSON"))).when(~shape.startswith("OBJECT"), F.array(F.lit("not an object"))).otherwise(told)
    return lines.where(T.strip(F.col("line")) != "").select("line_no", issues.alias("issues")).where(F.size("issues") > 0)


def report_status(reports: DataFrame, issues: DataFrame, rechecks: DataFrame) -> DataFrame:
    """report_id, status of every report: failed by an error among its issues (report_id, severity), else needs_recheck by a
    recheck (report_id), else warning by a warning, else passed."""
    told = issues.groupBy("report_id").agg(F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("_e"), F.coalesce(F.bool_or(F.col("severity") == "warning"), F.lit(False)).alias("_w"))
    again = rechecks.select("report_id").distinct().withColumn("_r", F.lit(True))
    both = reports.select("report_id").join(told, "report_id", "left").join(again, "report_id", "left")
    return both.select("report_id", F.when(F.col("_e"), "failed").when(F.col("_r"), "needs_recheck").when(F.col("_w"), "warning").otherwise("passed").alias("status"))


def consistency_issues(fields: DataFrame) -> DataFrame:
    """paper_id, rules: numbers of the four rules between fields (paper_id, field_id, value, status) that a paper breaks:
    scheduling with a holding bound, one agent described as several, a control without holding with bounds, and one agent
    executed decentrally. Papers that break none are left out; of repeated fields the greatest value counts."""
    names = {"control": "research_problem.control_type", "upper": "control_constraints.holding_upper_bound", "lower": "control_constraints.holding_lower_bound", "paradigm": "rl_formulation.rl_paradigm", "agent": "rl_formulation.agent_definition", "central": "rl_formulation.centralized_or_decentralized"}
    wide = fields.groupBy("paper_id").agg(*[F.max(F.when(F.col("field_id") == f, F.struct("value", "status"))).alias(n) for n, f in names.items()])
    low = lambda n: F.lower(T.strip(F.col(f"{n}.value")))
    says = lambda n: F.coalesce((F.col(f"{n}.value") != "") & F.col(f"{n}.status").isin("explicit", "inferred"), F.lit(False))
    alone = low("paradigm") == "sarl"
    broken = [
        low("control").contains("scheduling") & ~low("control").rlike("mixed|holding") & says("upper"),
        alone & low("agent").rlike("|".join(MULTI_AGENT)),
        low("control").isin(NO_HOLDING) & (says("upper") | says("lower")),
        alone & (low("central") == "decentralized"),
    ]
    return wide.select("paper_id", F.array_compact(F.array(*[F.when(b, F.lit(i)) for i, b in enumerate(broken, 1)])).alias("rules")).where(F.size("rules") > 0)


def snapshot_issues(pages: DataFrame, entities: DataFrame, links: DataFrame) -> DataFrame:
    """kind, id of what a snapshot may not hold: second pages of a paper (page_id, paper_id), second entities of a name
    (entity_id, key: the name's identity), second links of one relation (link_id, page_id, entity_id, relation), and links
    to a page or entity that is not there. The smallest id is the first; rows without an id are no rows."""
    def repeated(df: DataFrame, kind: str, key: list[str], id_col: str) -> DataFrame:
        again = F.row_number().over(Window.partitionBy(*key).orderBy(id_col)) > 1
        return df.where(F.col(id_col).isNotNull()).withColumn("_again", again).where("_again").select(F.lit(kind).alias("kind"), F.col(id_col).cast("string").alias("id"))

    lost = lambda kind, other, key: links.join(other.select(key), key, "left_anti").select(F.lit(kind).alias("kind"), F.col("link_id").cast("string").alias("id"))
    parts = [repeated(entities, "duplicate_entity", ["key"], "entity_id"), repeated(links, "duplicate_link", ["page_id", "entity_id", "relation"], "link_id"), lost("missing_page", pages, "page_id"), lost("missing_entity", entities, "entity_id")]
    out = repeated(pages, "duplicate_page", ["paper_id"], "page_id")
    for p in parts:
        out = out.unionByName(p)
    return out


def vector_issues(required: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """kind, object_id, issue: objects (kind, object_id) without a vector (kind, object_id, vector), or whose vector is null
    or of another dimension. Repeated vectors: any of them will do."""
    held = vectors.groupBy("kind", "object_id").agg(F.bool_or(F.coalesce(F.size("vector") == dimension, F.lit(False))).alias("_fits"))
    both = required.select("kind", "object_id").distinct().join(held, ["kind", "object_id"], "left")
    issue = F.when(F.col("_fits").isNull(), "vector_index_missing").when(~F.col("_fits"), "vector_index_incompatible")
    return both.select("kind", "object_id", issue.alias("issue")).where("issue is not null")


def supporting_links(claims: DataFrame, evidence: DataFrame, links: DataFrame) -> DataFrame:
    """evidence_id, claim_ids (sorted): evidence that can be promoted with the claims it supports. Claims (claim_id, status)
    must be supported or accepted; evidence (evidence_id, status, admitted, resolvable, accessible, provenance) neither
    rejected nor ineligible, none of its flags false (null: true) and its provenance not empty; links (claim_id,
    evidence_id, relation) must support."""
    good = claims.where(F.lower("status").isin("supported", "accepted")).select("claim_id")
    flag = lambda c: F.coalesce(c, F.lit(True))
    sound = evidence.where(~F.lower(F.coalesce("status", F.lit("admitted"))).isin("rejected", "ineligible") & flag("admitted") & flag("resolvable") & flag("accessible") & (F.coalesce("provenance", F.lit("")) != "")).select("evidence_id")
    tied = links.where(F.lower(F.coalesce("relation", F.lit("supports"))) == "supports").join(good, "claim_id", "left_semi").join(sound, "evidence_id", "left_semi")
    return tied.groupBy("evidence_id").agg(F.sort_array(F.collect_set("claim_id")).alias("claim_ids"))


def put_once(known: DataFrame, incoming: DataFrame, key: str, content: list[str]) -> DataFrame:
    """incoming with outcome: added if its key is new, same if the known record is equal in content (nulls equal nulls),
    else conflict. Keys are unique on both sides."""
    old = known.select(key, F.struct(*content).alias("_old"))
    outcome = F.when(F.col("_old").isNull(), "added").when(F.col("_old").eqNullSafe(F.struct(*content)), "same").otherwise("conflict")
    return incoming.join(old, key, "left").withColumn("outcome", outcome).drop("_old")


def search_fields(fields: DataFrame, papers: DataFrame, wanted: list[str] | None, limit: int) -> DataFrame:
    """The first `limit` fields (paper_id, field_id, ...) of ready papers (paper_id, position, status), in the order of the
    papers and of the wanted fields, of field ids where none are named."""
    ready = papers.where("status = 'ready'").select("paper_id", "position")
    rows = fields.join(ready, "paper_id")
    if wanted is None:
        return rows.orderBy("position", "field_id").limit(limit)
    place = F.array_position(F.array(*map(F.lit, wanted)), F.col("field_id"))
    return rows.where(place > 0).orderBy("position", place).limit(limit)


def hit_papers(hits: DataFrame, pages: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """hit_id, paper_ids (sorted, members alone) of hits (hit_id, type, object_id): a page's paper, or those of the pages
    that name an entity (links: page_id, entity_id). Hits without such a paper, or of another type, keep an empty list."""
    of_page = hits.where("type = 'page'").select("hit_id", F.col("object_id").alias("page_id"))
    of_entity = hits.where("type = 'entity'").select("hit_id", F.col("object_id").alias("entity_id")).join(links.select("page_id", "entity_id"), "entity_id").select("hit_id", "page_id")
    found = of_page.unionByName(of_entity).join(pages.select("page_id", "paper_id"), "page_id").join(members.select("paper_id"), "paper_id", "left_semi")
    lists = found.groupBy("hit_id").agg(F.sort_array(F.collect_set("paper_id")).alias("paper_ids"))
    kind = dict(pages.dtypes)["paper_id"]
    return hits.select("hit_id").join(lists, "hit_id", "left").select("hit_id", F.coalesce("paper_ids", F.array().cast(f"array<{kind}>")).alias("paper_ids"))


def timeline_artifacts(events: DataFrame, sessions: DataFrame, queries: DataFrame, claims: DataFrame) -> DataFrame:
    """event_id with what its run owns of the ids it names (events: event_id, run_id, session_id, query_id, claim_id):
    question, query_text, statement. Records (query_id or claim_id, session_id, text) of sessions (session_id, run_id,
    question) of another run, or of another session where the event names one, give null."""
    own = sessions.select("session_id", F.col("run_id").alias("_run"), "question")
    out = events.join(own, "session_id", "left").withColumn("question", F.when(F.col("_run") == F.col("run_id"), F.col("question"))).drop("_run")
    for key, records, name in (("query_id", queries, "query_text"), ("claim_id", claims, "statement")):
        owned = records.join(own.drop("question"), "session_id").select(key, F.col("session_id").alias("_session"), "_run", F.col("text").alias("_text"))
        fits = (F.col("_run") == F.col("run_id")) & (F.col("session_id").isNull() | (F.col("session_id") == F.col("_session")))
        out = out.join(owned, key, "left").withColumn(name, F.when(fits, F.col("_text"))).drop("_session", "_run", "_text")
    return out.select("event_id", "question", "query_text", "statement")


def materialize(selected: DataFrame, now_year: int) -> DataFrame:
    """paper_id with the columns that its selected candidates (paper_id, field, value) fill: title, normalized_title, doi,
    normalized_doi, arxiv_id, publication_year (null if not plausible), venue, abstract. One candidate a field; fields
    without one are null."""
    value = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    wide = selected.groupBy("paper_id").agg(*[value(f).alias(f) for f in ("title", "doi", "arxiv_id", "publication_year", "venue", "abstract")])
    year = F.when(T.plausible_year(F.col("publication_year"), now_year), F.trim("publication_year").try_cast("int"))
    return wide.select("paper_id", T.strip(F.col("title")).alias("title"), T.normalize_title(F.col("title"), fold=False).alias("normalized_title"), T.strip(F.col("doi")).alias("doi"), T.normalize_doi(F.col("doi")).alias("normalized_doi"), T.normalize_arxiv(F.col("arxiv_id")).alias("arxiv_id"), year.alias("publication_year"), T.strip(F.col("venue")).alias("venue"), T.strip(F.col("abstract")).alias("abstract"))


def author_rows(papers: DataFrame) -> DataFrame:
    """paper_id, author_order from 1, full_name, normalized_name of papers (paper_id, authors); blank names are skipped."""
    named = F.filter("authors", lambda a: T.strip(a) != "")
    rows = papers.select("paper_id", F.posexplode(named).alias("pos", "full_name"))
    return rows.select("paper_id", (F.col("pos") + 1).alias("author_order"), "full_name", T.normalize_author(F.col("full_name"), fold=False).alias("normalized_name"))


def provider_facts(parsed: DataFrame, papers: DataFrame) -> DataFrame:
    """paper_id, provider, error, complete of what providers say (paper_id, provider, doi, title, authors, year) of papers
    (paper_id, normalized_doi): error is doi_mismatch where both name a DOI and they differ; complete if DOI, title and year
    are given and the authors, maybe none, are known."""
    both = parsed.join(papers.select("paper_id", "normalized_doi"), "paper_id", "left")
    said = T.normalize_doi(F.col("doi"))
    full = (F.coalesce("doi", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "") & F.col("authors").isNotNull() & (F.coalesce("year", F.lit("")) != "")
    return both.select("paper_id", "provider", F.when(F.coalesce(said != F.col("normalized_doi"), F.lit(False)), "doi_mismatch").alias("error"), full.alias("complete"))


def capabilities(workspaces: DataFrame) -> DataFrame:
    """workspace_id, can (names of what it allows) and todo (recommended actions) of workspaces: workspace_id, status, bound,
    members, missing_runs (counts), wiki_status."""
    active, bound, filled = F.col("status") == "active", F.coalesce("bound", F.lit(False)), F.coalesce("members", F.lit(0)) > 0
    build = active & bound & filled
    can = [("paper_access", active), ("evidence_access", active & filled), ("schema_read", active & bound), ("wiki_build", build), ("wiki_read", build & (F.col("wiki_status") == "ready"))]
    todo = [("materialize_schema_runs", build & (F.coalesce("missing_runs", F.lit(0)) > 0)), ("build_base_wiki", build & (F.col("wiki_status") == "missing")), ("rebuild_base_wiki", build & (F.col("wiki_status") == "stale")), ("repair_base_wiki", build & (F.col("wiki_status") == "error"))]
    return workspaces.select("workspace_id", _names(can).alias("can"), _names(todo).alias("todo"))


def conversation_view(turns: DataFrame, runs: DataFrame, paused: DataFrame) -> DataFrame:
    """turns (conversation_id, sequence, run_id) with display_status: their run's (run_id, status), pause_requested where it
    is running and asked to pause (paused: run_id); null without a run."""
    asked = paused.select("run_id").distinct().withColumn("_p", F.lit(True))
    both = turns.join(runs.select("run_id", F.col("status").alias("_s")), "run_id", "left").join(asked, "run_id", "left")
    return both.withColumn("display_status", F.when((F.col("_s") == "running") & F.col("_p"), "pause_requested").otherwise(F.col("_s"))).drop("_s", "_p")


def page_summary(title: Column, authors: Column, year: Column, fields: Column) -> Column:
    """One line of a page: title, authors, year and its fields (array of field_id, value as JSON, status) in order."""
    cards = F.transform(fields, lambda c: F.concat(c["field_id"], F.lit("="), F.coalesce(c["value"], F.lit("null")), F.lit(" ["), c["status"], F.lit("]")))
    return F.concat_ws(" | ", title, F.when(F.size(authors) > 0, F.concat(F.lit("Authors: "), F.array_join(authors, ", "))), F.concat(F.lit("Year: "), year.cast("string")), F.when(F.size(fields) > 0, F.concat(F.lit("Fields: "), F.array_join(cards, "; "))))
