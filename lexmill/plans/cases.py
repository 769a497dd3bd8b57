"""Worked-out cases spread over the suppliers: each supplier has every case, with its key in the ids and the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.sources.tables import table

STEP = 1000  # between the numeric ids of two suppliers


def spread(spark: SparkSession, d: str, rows: list[tuple], schema: str, number: str | None = None) -> DataFrame:
    """rows for each supplier: `#` in text columns becomes its key, and the column `number` goes up by STEP a key."""
    cases = spark.createDataFrame(rows, schema)
    out = table(spark, d, "supplier").select("s_suppkey").crossJoin(F.broadcast(cases))  # a fixed number of rows
    for name, kind in cases.dtypes:
        if kind == "string":
            out = out.withColumn(name, F.replace(F.col(name), F.lit("#"), F.col("s_suppkey").cast("string")))
        elif name == number:
            out = out.withColumn(name, (F.col(name) + F.col("s_suppkey") * STEP).cast(kind))
    return out.drop("s_suppkey")


def spread_sql(values: str, columns: str, texts: str = "", number: str = "") -> str:
    """The rows of VALUES values as columns, spread in the same way."""
    wide = [t.strip() for t in texts.split(",") if t.strip()]
    shown = [f"replace({c}, '#', s_suppkey::VARCHAR) AS {c}" if c in wide else f"{c} + s_suppkey * {STEP} AS {c}" if c == number else c for c in (x.strip() for x in columns.split(","))]
    return f"SELECT {', '.join(shown)} FROM (VALUES {values}) cases({columns}) CROSS JOIN supplier"
