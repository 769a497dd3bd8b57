"""Corpus pipeline over `documents`: stages, their composition, and no single SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import stages
from lexmill.llm.shared import drop_tables, saved, tables_written

STAGES = [
    ("language_id", stages.language_id),
    ("ngram_jaccard_join", stages.near_duplicates),
    ("benchmark_decontamination", stages.decontamination),
    ("pii", stages.pii),
    ("packing", stages.packing),
]

#: Packing needs a tokenizer's ids and language ID a suffix automaton: SQL has neither. tests/llm checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over `documents`, each written as Parquet and reread. What a stage wrote on its way, and its
    input, goes as soon as its output is written."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        with tables_written() as inner:
            out = stage(spark, docs, sf_dir)
        with tables_written() as outer:
            docs = saved(out)
        drop_tables(spark, inner + held)
        held = outer
    return STAGES[-1][1](spark, docs, sf_dir)
