"""A ledger of events that survives restarts: numbered once, written once, read from any place on.

Events are numbered by key as state with an expiry. Each micro-batch goes into a folder of its own, and counts from the
moment that its marker exists; a batch that is replayed finds the marker and changes nothing, and one that died half way is
written anew. The same commit serves promotions: the entries of a run and the mark that the run is done appear together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def numbered_events(events: DataFrame, key: str, event: str, time: str, forget: str = "7 days") -> DataFrame:
    """key, event, time and sequence, from 1 by key without gaps: events of one micro-batch by time and then event, later
    batches behind earlier ones. An event that its key has seen gets no second number.

    events is a stream with a watermark on `time`. A key that has no event until the watermark has passed its last one by
    `forget` is forgotten: state does not grow with all keys ever seen, and a later event of the key begins at 1 again.
    Within that time the ids of a key's events are kept, so a key's state grows with its events of that time.
    """
    span = int(pd.Timedelta(forget).total_seconds() * 1000)
    kinds = dict(events.dtypes)

    def number(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, latest, seen = state.get if state.exists else (0, 0, [])
        known = set(seen)
        rows = pd.concat(list(parts)).sort_values([time, event], kind="stable").drop_duplicates(event)
        rows = rows[~rows[event].isin(known)]
        if len(rows):
            latest = max(latest, int(rows[time].max().timestamp() * 1000))
        seen = [*seen, *rows[event].tolist()]
        state.update((last + len(rows), latest, seen))
        state.setTimeoutTimestamp(max(latest + span, state.getCurrentWatermarkMs() + 1))
        yield rows[[key, event, time]].assign(sequence=range(last + 1, last + 1 + len(rows)))

    return events.groupBy(key).applyInPandasWithState(number, f"{key} {kinds[key]}, {event} {kinds[event]}, {time} timestamp, sequence long", f"last long, latest long, seen array<{kinds[event]}>", "append", GroupStateTimeout.EventTimeTimeout)


def _at(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commit_once(rows: DataFrame, root: str, unit: str) -> bool:
    """Add rows to the ledger at root as one unit (a batch or a run), once: False where the unit is there already.

    The rows are written before the marker is created, which fails if it exists. Rows of a unit without a marker are no part
    of the ledger, and are written over when the unit comes again.
    """
    spark = rows.sparkSession
    marker, fs = _at(spark, f"{root.rstrip('/')}/_units/{unit}")
    if fs.exists(marker):
        return False
    rows.write.mode("overwrite").parquet(f"{root.rstrip('/')}/data/unit={unit}")
    fs.create(marker, False).close()
    return True


def batch_writer(root: str, prefix: str = "batch") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch is a unit named by its number. A batch that is in the ledger already is run without
    being written, as the state of the stream is kept by running it."""

    def write(rows: DataFrame, number: int) -> None:
        if not commit_once(rows, root, f"{prefix}-{number:012d}"):
            rows.write.format("noop").mode("overwrite").save()

    return write


def units(spark: SparkSession, root: str) -> list[str]:
    folder, fs = _at(spark, f"{root.rstrip('/')}/_units")
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def read_ledger(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """Rows of all units with a marker, and the unit of each."""
    paths = [f"{root.rstrip('/')}/data/unit={u}" for u in units(spark, root)]
    if not paths:
        return spark.createDataFrame([], schema).withColumn("unit", F.lit(None).cast("string"))
    return spark.read.schema(schema).option("basePath", f"{root.rstrip('/')}/data").parquet(*paths).withColumn("unit", F.regexp_extract(F.col("_metadata.file_path"), r"/unit=([^/]*)/", 1))


def read_trace(trace: DataFrame, run: str | None = None, session: str | None = None, after: int | None = None) -> DataFrame:
    """Events of a run or a session (all, if neither is named) with a sequence above `after`, in order of run and sequence."""
    out = trace
    for column, value in (("run_id", run), ("session_id", session)):
        out = out if value is None else out.where(F.col(column) == value)
    return (out if after is None else out.where(F.col("sequence") > after)).orderBy("run_id", "sequence")


def pending_promotions(candidates: DataFrame, ledger: DataFrame, run: str = "run_id", entry: str = "entry_id") -> DataFrame:
    """Candidates of runs that have not been promoted yet, one of each entry, without those that the ledger holds."""
    fresh = candidates.join(ledger.select(run).distinct(), run, "left_anti")
    return fresh.dropDuplicates([run, entry]).join(ledger.select(entry).distinct(), entry, "left_anti").select(candidates.columns)
