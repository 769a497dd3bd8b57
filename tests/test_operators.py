"""Operators on small literal rows, with results worked out by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lexmill.functions import citations as C
from lexmill.functions import layout as L
from lexmill.functions import text as T
from lexmill.operators import documents, evidence, ledger, metrics, records, retrieval, workflow
from lexmill.sources import tables


def one(spark, column, **values):
    """A column over one row of literals."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_normalizers(spark):
    assert one(spark, T.normalize_doi(F.col("x")), x=" https://doi.org/10.1/ABC. ") == "10.1/abc"
    assert one(spark, T.valid_arxiv(F.col("x")), x="2313.01234") is False
    assert one(spark, T.valid_arxiv(F.col("x")), x="2312.01234v2") is True
    assert one(spark, T.token_count(F.col("x")), x="reward-based RL 公交") == 4
    assert one(spark, T.normalize_title(F.col("x")), x="  Ｄeep–Learning:  A \"Survey\" ") == "deep learning: a \"survey"


def test_elimination_and_quotas(spark):
    assert ledger.elimination_schedule(50, 3, 10) == [14, 13, 13]
    groups = spark.createDataFrame([(1, k, n) for k, n in enumerate([5, 3, 1])], "batch int, pos int, size long")
    got = {r.pos: r.quota for r in ledger.group_quotas(groups, F.lit(4)).collect()}
    assert sum(got.values()) == 4 and got[2] == 0 and all(got[k] < n for k, n in enumerate([5, 3, 1]))


def test_rrf_and_repeated_query_words(spark):
    ranked = spark.createDataFrame([("q", 7, 1), ("q", 8, 2)], "query_id string, id long, rank int")
    top = retrieval.rrf(ranked, ranked.where("id = 7"), 8).orderBy("rrf_rank").first()
    assert top.id == 7 and top.score == pytest.approx(2 / 61)
    corpus = spark.createDataFrame([(1, "bus lane"), (2, "tram line")], "id long, text string")
    asked = spark.createDataFrame([("once", "bus"), ("twice", "bus bus")], "q string, t string")
    got = {r.query_id: r.score for r in retrieval.bm25_scores(corpus, asked, "id", "text", "q", "t").collect()}
    assert got["twice"] == pytest.approx(2 * got["once"])


def test_coverage_and_duplicates(spark):
    hits = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b")], "query_id string, rank int, block_id string")
    gold = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, block_id string")
    m = metrics.coverage_metrics(hits, gold).first()
    assert m.recall_10 == 1.0 and m[-1] == pytest.approx(0.5)
    rows = spark.createDataFrame([("p", t) for t in ("a", "a", "b", "")], "p string, t string")
    assert documents.duplicate_ratio(rows, ["p"], F.col("t")).first().ratio == 0.5
    assert one(spark, T.rate(F.lit(1), F.lit(0)), x=0) is None


def test_identity_scores(spark):
    pair = ("a", "b", None, None, None, None, "transit planning", "transit planning", ["x"], ["y"])
    cols = "a_id string, b_id string, a_doi string, b_doi string, a_arxiv string, b_arxiv string, a_title string, b_title string, a_authors array<string>, b_authors array<string>"
    r = records.score_pairs(spark.createDataFrame([pair], cols)).first()
    assert r.score == pytest.approx(0.70) and r.relation_type == "related"


def test_context_window_is_clamped(spark):
    rows = spark.createDataFrame([("p", k) for k in range(5)], "g string, o int")
    at = spark.createDataFrame([("p", 0)], "g string, o int")
    assert retrieval.context_window(rows, at, "g", "o", 2, 1).count() == 2


def test_evidence_issues(spark):
    blocks = spark.createDataFrame([("b1", "p1", "one two three")], "block_id string, paper_id string, text string")
    refs = [("ok", "p1", "b1", 4, 7, "two"), ("said", "p1", "b1", 4, 7, "too"), ("far", "p1", "b1", 4, 70, "two"), ("other", "p2", "b1", 4, 7, None), ("gone", "p1", "b9", 0, 1, "x"), ("null", "p1", None, None, None, None)]
    got = evidence.evidence_issues(spark.createDataFrame(refs, "ref_id string, paper_id string, block_id string, char_start int, char_end int, quote string"), blocks)
    assert sorted(map(tuple, got.collect())) == [("far", "bad_range"), ("gone", "missing_block"), ("null", "missing_block"), ("other", "wrong_paper"), ("said", "quote_mismatch")]


def test_admission_and_traceable(spark):
    ev = spark.createDataFrame([(1, "q1", "s1", "p1", "v1"), (2, "q9", "s1", "p1", "v1"), (3, "q1", "s2", "p1", "v0"), (4, "q1", "s1", "p9", "v1")], "evidence_id int, query_id string, session_id string, paper_id string, source_version string")
    q = spark.createDataFrame([("q1", "s1")], "query_id string, session_id string")
    v = spark.createDataFrame([("p1", "v1")], "paper_id string, source_version string")
    assert sorted(map(tuple, evidence.admission(ev, q, v).collect())) == [(2, "unknown_query"), (3, "moved_source"), (3, "other_session"), (4, "unknown_source")]
    refs = spark.createDataFrame([(1, "b", "q", [1], ["s"]), (2, "", " ", [], None)], "ref_id int, block_id string, quote string, pages array<int>, section_path array<string>")
    assert sorted(r.issue for r in evidence.traceable(refs).collect()) == ["no_block", "no_pages", "no_quote", "no_section"]


def test_same_topic_and_upsert(spark):
    pairs = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "b", "c"]), (2, ["a", "b"], ["b", "c"]), (3, [], [])], "k int, x array<string>, y array<string>")
    assert [(r.k, r.score) for r in evidence.same_topic(pairs, F.col("x"), F.col("y")).collect()] == [(1, 1.0)]
    old, new = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, x string"), spark.createDataFrame([(2, 1, "c")], "k int, v int, x string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"], "v").collect())) == [(1, 1, "a"), (2, 1, "c")]


BIB = "@article{k, title = {On {Bus} Lanes}, author = {Ada Lovelace and Hopper, Grace M.}, year = 1999, journal = \"J. Transit\", volume={7}, pages={1--9}}"
RIS = "TY  - JOUR\nTI  - On Bus Lanes\nAU  - Lovelace, Ada\nPY  - 1999/05/\nVL  - 7\nER  - "


def test_citations(spark):
    b = one(spark, C.bibtex(F.col("x")), x=BIB)
    assert (b.title, b.year, b.journal, b.volume, b.doi) == ("On Bus Lanes", "1999", "J. Transit", "7", None)
    assert b.authors == ["Lovelace, Ada", "Hopper, Grace M."]
    r = one(spark, C.ris(F.col("x")), x=RIS)
    assert (r.title, r.year, r.volume, r.authors) == ("On Bus Lanes", "1999", "7", ["Lovelace, Ada"])
    assert [one(spark, C.citation_format(F.col("x")), x=x) for x in (BIB, RIS, "[{}]", "Doe, J.")] == ["bibtex", "ris", "csl_json", "text"]
    row = spark.range(1).select(C.bibtex(F.lit(BIB)).alias("b")).select("b.*")
    parts = [F.col(c) for c in ("authors", "year", "title", "journal", "volume", "pages", "doi")]
    apa, mla, gb = row.select(*[C.render(s, *parts) for s in ("apa", "mla", "gb_t")]).first()
    assert apa == "Lovelace, A., & Hopper, G. M. (1999). On Bus Lanes. J. Transit, 7, 1--9."
    assert mla == 'Lovelace, Ada, and Hopper, Grace M.. "On Bus Lanes." J. Transit, vol. 7, 1999, pp. 1--9.'
    assert gb == "Lovelace A, Hopper G M. On Bus Lanes[J]. J. Transit, 1999, 7: 1--9."
    with pytest.raises(ValueError):
        C.render("other", *parts)
    assert one(spark, C.issued(F.col("x")), x=[2020, 3]) == "2020-03"
    assert one(spark, C.warnings(F.array().cast("array<string>"), F.lit("1999"), F.lit(None).cast("string")), x=0) == ["missing_authors", "missing_title"]


def test_layout(spark):
    kinds = [("Figure 2: Lanes", 10.0), ("- an item", 10.0), ("E = m * c^2 + ∑ x", 10.0), ("1.2 Results", 10.0), ("Methods", 14.0), ("We ran it on data.", 10.0)]
    got = spark.createDataFrame(kinds, "t string, s double").select(L.block_kind(F.col("t"), F.col("s"), F.lit(10.0))).collect()
    assert [r[0] for r in got] == ["caption", "list", "equation", "heading", "heading", "paragraph"]
    assert one(spark, L.table_markdown(F.col("x")), x=[["a", "b|c"], ["1", "2"]]) == "| a | b c |\n| --- | --- |\n| 1 | 2 |"
    assert one(spark, L.split_authors(F.col("x")), x="Ada Lovelace1,*, Grace Hopper² and A. Turing") == ["Ada Lovelace", "Grace Hopper²", "A. Turing"]
    assert one(spark, L.block_markdown(F.lit("heading"), F.col("x"), F.lit(2)), x="T") == "## T"


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("p1", "r1", 1), ("p1", "r2", 2), ("p2", "r1", 3)], "paper_id string, run_id string, x int")
    tables.write_run(df, f"{tmp_path}/runs")
    tables.write_run(df.where("run_id = 'r2'").withColumn("x", F.lit(9)), f"{tmp_path}/runs")
    pointers = spark.createDataFrame([("p1", "r2"), ("p2", "r1")], "paper_id string, run_id string")
    back = tables.current_runs(spark.read.parquet(f"{tmp_path}/runs"), pointers)
    assert sorted((r.paper_id, r.run_id, r.x) for r in back.collect()) == [("p1", "r2", 9), ("p2", "r1", 3)]
    for name, data in (("a.pdf", b"%PDF-1.7 x"), ("b.pdf", b""), ("c.pdf", b"hello")):
        (tmp_path / "up").mkdir(exist_ok=True)
        (tmp_path / "up" / name).write_bytes(data)
    assert sorted(str(r.rejected) for r in tables.uploads(spark, f"{tmp_path}/up").collect()) == ["None", "not_pdf"]  # the reader passes over b.pdf, which is empty


def test_section_paths_deep_orphan_and_circle(spark):
    rows = [("p", f"s{i}", f"s{i - 1}" if i else None, str(i)) for i in range(60)]
    rows += [("p", "o", "gone", "O"), ("p", "under", "o", "U"), ("p", "x", "y", "X"), ("p", "y", "x", "Y"), ("q", "s1", None, "Q")]
    df = spark.createDataFrame(rows, "paper_id string, section_id string, parent_section_id string, title string")
    got = {(r.paper_id, r.section_id): r.path for r in documents.section_paths(df, spark).collect()}
    assert len(got) == len(rows) and got["p", "s59"] == [str(i) for i in range(60)]
    assert got["p", "o"] == ["O"] and got["p", "under"] == ["O", "U"] and got["p", "x"] == ["X"] and got["p", "y"] == ["Y"] and got["q", "s1"] == ["Q"]
    assert documents.section_paths(df.limit(0), spark).count() == 0


def test_promotion_issues_and_nulls(spark):
    schema = "candidate_id int, status string, workspace_id string, agent_run_id string, own_workspace_id string, own_run_id string, claim_ids array<string>, evidence_ids array<string>, claim_evidence map<string,array<string>>, evidence_claims map<string,array<string>>"
    links = ({"c": ["e"], "d": ["f"]}, {"e": ["c"], "f": ["d"]})
    rows = [(1, "proposed", "w", "r", "w", "r", ["c"], ["e"], *links), (2, "proposed", "w", "r", "w", "r", ["c"], ["f"], *links), (3, None, "v", "r", "w", "r", None, ["zz"], *links)]
    got = {r.candidate_id: r.issues for r in workflow.promotion_issues(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: [], 2: ["claims_disagree", "evidence_unrelated"], 3: ["not_proposed", "other_workspace", "no_provenance", "unknown_evidence", "evidence_unrelated"]}


def test_white_space_of_any_kind_is_stripped(spark):
    row = spark.range(1).select(T.normalize_doi(F.lit("\t https://doi.org/10.1/ABC. \n")).alias("doi"), T.collapse(F.lit(" a  b\t")).alias("c")).first()
    assert (row.doi, row.c) == ("10.1/abc", "a b")


def test_canonical_hash_ignores_the_order_of_fields(spark):
    inner = lambda *f: F.struct(*[F.lit(v).alias(n) for n, v in f])
    a = F.struct(F.lit(1).alias("a"), F.array(inner(("x", "é"), ("y", 2))).alias("b"), F.lit(None).cast("string").alias("c"), F.create_map(F.lit("k"), F.lit(1), F.lit("j"), F.lit(2)).alias("m"))
    b = F.struct(F.create_map(F.lit("j"), F.lit(2), F.lit("k"), F.lit(1)).alias("m"), F.lit(None).cast("string").alias("c"), F.array(inner(("y", 2), ("x", "é"))).alias("b"), F.lit(1).alias("a"))
    row = spark.range(1).select(workflow.canonical_hash(a).alias("a"), workflow.canonical_hash(b).alias("b")).first()
    assert row.a == row.b == hashlib.sha256('{"a":1,"b":[{"x":"é","y":2}],"c":null,"m":{"j":2,"k":1}}'.encode()).hexdigest()


def test_word_set_folds(spark):
    rows = [("Straße ﬁne Ⅻ", ["strasse", "fine", "xii"]), ("ABC abc ＡＢＣ", ["abc"]), ("plain A a", ["plain", "a"]), (None, None), ("", [])]
    got = spark.createDataFrame([(t,) for t, _ in rows], "t string").coalesce(1).select(T.word_set(F.col("t")).alias("w")).collect()
    assert [r.w for r in got] == [w for _, w in rows]
