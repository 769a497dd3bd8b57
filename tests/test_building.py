"""Edge cases of building and acceptance operators on small literal rows."""

import pytest
from pyspark.sql import functions as F

from lexmill.operators import acceptance, building

BLOCKS = "paper_id string, block_id string, block_type string, position int, order int, text string, pages array<int>"
PARSES = "paper_id string, parser_status string, has_document boolean, source_pages int, page_count int, quality array<string>"
SECTIONS = "paper_id string, section_id string, parent_section_id string, heading_block_id string"


def test_trim_keeps_whole_tokens(spark):
    rows = [("one two-x three", 2), ("公交 bus", 1), ("word " * 900, 899), ("a b", 5), ("a b", 0), (None, 3), ("", 3)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, n int").select(building.trim_tokens(F.col("t"), F.col("n"))).collect()]
    assert got == ["one two-x ", "公", "word " * 899, "a b", "", None, ""]


def test_prefix_of_null_and_empty_paths(spark):
    rows = [(None,), ([],), ([None, "a b"],), (["a b c d", "e"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "p array<string>").select(building.compact_prefix(F.col("p"), 3)).collect()]
    assert [(r["items"], r["compacted"]) for r in got] == [([], False), ([], False), ([None, "a b"], False), (["a b c d"], True)]


def test_deep_sections_and_null_levels(spark):
    rows = [("p", i, "heading", None if i == 3 else i) for i in range(1, 6)] + [("p", 6, "paragraph", None), ("q", 1, "paragraph", None)]
    got = {(r.paper_id, r.order): (r.section_id, r.parent_id) for r in building.section_stack(spark.createDataFrame(rows, "paper_id string, order int, block_type string, level int")).collect()}
    assert got == {("p", 1): (1, None), ("p", 2): (2, 1), ("p", 3): (3, None), ("p", 4): (4, 3), ("p", 5): (5, 4), ("p", 6): (5, None), ("q", 1): (None, None)}


def test_validation_of_bad_order_pages_and_empty_tables(spark):
    blocks = [("a", "1", "heading", 1, 2, "A title of it", [2]), ("a", "2", "odd", 2, 1, "body text here", [9]), ("b", "1", "paragraph", 1, 1, "see Table 1 �", None), ("b", "2", "paragraph", 2, 2, None, None)]
    parses = [("a", "ok", True, 2, 2, None), ("b", "ok", True, None, 2, None), ("c", "ok", True, 1, 1, None), ("d", "ok", None, 1, 1, None)]
    sections = [("a", "s", "lost", "1")]
    got = {r.paper_id: r for r in building.parse_validation(spark.createDataFrame(parses, PARSES), spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(sections, SECTIONS)).collect()}
    assert got["a"].failed == ["reading_order", "provenance_legal", "structure_valid"] and got["a"].degraded == []
    assert got["b"].status == "degraded" and got["b"].degraded == ["provenance_missing", "replacement_char_ratio", "structure_missing"]
    assert got["c"].failed == ["near_empty_body"] and got["d"].failed == ["canonical_document"]
    empty = building.parse_validation(spark.createDataFrame([], PARSES), spark.createDataFrame([], BLOCKS), spark.createDataFrame([], SECTIONS))
    assert empty.count() == 0


def test_hybrid_search_needs_a_dense_list(spark):
    ranked = spark.createDataFrame([("q", 1, 1)], "query_id string, id long, rank int")
    scores = spark.createDataFrame([], "query_id string, id long, rerank_score double")
    with pytest.raises(ValueError):
        acceptance.search_variants(ranked, None, scores, 5)
    assert acceptance.search_variants(ranked, ranked, scores, 5).count() == 4


def test_rules_without_variants_are_unknown(spark):
    none = spark.createDataFrame([], "grain string, key string, variant string, status string, recall double, mrr double")
    assert [r.passed for r in acceptance.acceptance_rules(none).orderBy("rule").collect()] == [None, None, None, None, False]


def test_abstracts_and_name_lines(spark):
    long = "Buses bunch when headways are short,\nand this paper says why."
    texts = [f"Title\n\n Abstract.\n\n{long}\n\nmore", f"ABSTRACT:\n{long}\n1 Introduction\nx", f"Abstract\n{long}\nIntroduction: x", f"Abstract\n{long}", "Abstract\n\n \n", "\n\n", "", None, "Abstract\nshort\n\n", f"Abstract\n{long}\nI. FIRST"]
    got = [r.a for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(building.abstract(F.col("t")).alias("a")).collect()]
    want = long.replace("\n", " ")
    assert got == [want, want, want, None, None, None, None, None, None, want]
    lines = {"Ann Lee, Bo Ode": True, "Ann Lee and Bo Ode": True, "Ann Lee1 Bo Ode2": True, "Ann Lee": True, "Óg Dara*": True, "Ann Lee a": True, "A study of buses": False, "And then": False, "buses and": False, "": False, "  ": False, "Transit Networks Today": False}
    got = {r.t: r.a for r in spark.createDataFrame([(t,) for t in lines], "t string").select("t", building.author_like(F.col("t")).alias("a")).collect()}
    assert got == lines | {"And then": got["And then"]}
