import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lexmill.llm import stages
from lexmill.llm.queries import tokenizer_path

from .brute import components
from .test_decontamination import brute as leaks
from .test_pii import plain


def test_stages_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out = stages.saved(out)
        got = {r.doc_id: r.text for r in out.collect()}
        assert out.count() == len(got)
        if name == "language_id":
            left = {i: t for i, t in left.items() if re.search(r"[^\W\d_]", t or "")}
        elif name == "ngram_jaccard_join":
            left = keep_first(left)
        elif name == "benchmark_decontamination":
            gone = {d for d, _ in leaks(list(left.items()), items)}
            assert gone
            left = {i: t for i, t in left.items() if i not in gone}
        else:
            assert got.keys() == left.keys()
            for i, t in got.items():
                assert not plain(t) and (t == left[i] or plain(left[i]) or re.search(r"\d", left[i]))
            assert {r.n_chars for r in out.collect()} == {len(t) for t in got.values()}
            left = got
        assert got == left, name
        docs = out
    tok = Tokenizer.from_file(tokenizer_path())
    want = {i: tok.encode(t, add_special_tokens=False).ids + [1] for i, t in left.items()}
    by = defaultdict(list)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect():
        by[r.doc_id].append(r)
    assert by.keys() == want.keys()
    for i, rs in by.items():
        assert sorted(x for r in rs for x in range(r.start, r.start + r.length)) == list(range(len(want[i])))
        for r in rs:
            assert r.ids_crc32 == zlib.crc32(np.array(want[i][r.start : r.start + r.length], "<u4").tobytes())


def keep_first(left):
    found = components(list(left.items()))
    return {i: t for i, t in left.items() if found[i][1] == i}


def test_run_equals_stages_and_empty_tables(spark, sf, tmp_path):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 100 and "sequence_id" in got.columns
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


WORDS = "one quiet morning the old ferry left the harbour with nine sleepy travellers and a crate of oranges on its deck"


def test_edge_rows(spark, sf):
    rows = [(1, None, "en"), (2, "", None), (3, "12 34", "en"), (4, "some text a@b.co here", "en"), (5, "some text a@b.co here", "en"), (None, "lost id here", "en")]
    df = spark.createDataFrame([(i, t, lang, "x", 3, "y", 7) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, spans string, gone int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stages.saved(stage(spark, df, sf))
    assert {(r.doc_id, r.text, r.n_chars, r.spans, r.gone) for r in df.collect()} == {(4, "some text [EMAIL] here", 22, "y", 7), (None, "lost id here", 12, "y", 7)}


def test_rows_that_repeat_an_id_or_lack_one(spark, sf):
    """No text is lost with another one of its id, and no copy stays."""
    other = WORDS.replace("ferry", "balloon").replace("oranges", "lemons").replace("morning", "night")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(5, WORDS), (5, WORDS), (3, WORDS), (5, other), (None, other), (None, WORDS), (7, item), (7, "clean words of the seventh"), (None, item), (8, "word " * 60_000)]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    kept = sorted((r.doc_id or 0, r.text) for r in stages.near_duplicates(spark, df, sf).collect())
    assert kept == sorted([(3, WORDS), (5, other), (7, item), (7, "clean words of the seventh"), (8, "word " * 60_000)])
    clean = sorted((r.doc_id or 0, r.text) for r in stages.decontamination(spark, df, sf).collect())
    assert clean == sorted((i or 0, t) for i, t in rows if t != item)
    assert stages.pii(spark, df, sf).count() == stages.language_id(spark, df, sf).count() == len(rows)


def test_language_found_is_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 400")
    lost = docs.withColumn("given", F.col("lang")).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    got = stages.language_id(spark, lost, sf)
    assert got.columns == lost.columns and got.where("lang is null").count() == 0
    assert got.where("lang = given").count() >= 0.97 * got.count() == 0.97 * docs.count()
