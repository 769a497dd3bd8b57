"""Readers and writers of tables, files and versioned runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_UPLOAD = 100 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files with their digest and the first reason to reject them: too large, or no PDF. Empty files give no row."""
    files = spark.read.format("binaryFile").load(path)
    head = F.substring("content", 1, 5)
    why = F.when(F.col("length") > MAX_UPLOAD, "too_large").when(head != F.lit(b"%PDF-"), "not_pdf")
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), why.alias("rejected"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines under an explicit schema; a missing or malformed record fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_run(df: DataFrame, path: str, paper: str = "paper_id", run: str = "run_id") -> None:
    """Writes runs of papers, each into its own partition; those of other papers and runs stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(paper, run).parquet(path)


def current_runs(runs: DataFrame, pointers: DataFrame, paper: str = "paper_id", run: str = "run_id") -> DataFrame:
    """Rows of each paper's current run."""
    return runs.join(pointers.select(paper, run), [paper, run], "left_semi")


def gold_queries(spark: SparkSession, path: str) -> DataFrame:
    """Gold retrieval queries with one row for each gold block."""
    schema = "paper_id string, query string, query_type string, gold_block_ids array<string>"
    return json_lines(spark, path, schema).select("paper_id", "query", "query_type", F.explode_outer("gold_block_ids").alias("block_id"))


def upsert(current: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """Last version of each key over both tables; changes win ties."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.col(version).desc(), F.col("_new").desc())
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")
