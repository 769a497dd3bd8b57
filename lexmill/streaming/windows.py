"""Event-time windows that read the same in batch and as a stream, and a numbered trace as stateful processing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, size: str) -> DataFrame:
    """Counts and sums of each event type in windows of a fixed size."""
    grouped = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of each user, closed by a gap."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def event_stream(spark: SparkSession, path: str, schema, late: str = "10 minutes", files: int = 1) -> DataFrame:
    """A file stream of events with a watermark: rows later than `late` are dropped from windows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def numbered_trace(events: DataFrame) -> DataFrame:
    """Each event with its number within its user, kept as state between micro-batches; order is by time, then id, within
    a batch, and by arrival between batches."""

    def number(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"], kind="stable")
        rows = rows[["user_id", "event_id"]].assign(sequence=range(last + 1, last + 1 + len(rows)))
        state.update((last + len(rows),))
        yield rows

    return events.groupBy("user_id").applyInPandasWithState(number, "user_id long, event_id long, sequence long", "last long", "append", GroupStateTimeout.NoTimeout)
