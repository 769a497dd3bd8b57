"""Restarts and replays of the ledger change nothing."""

import shutil

import pytest
from pyspark.sql import functions as F

from lexmill.sources.tables import table
from lexmill.streaming import ledger, windows


def start(spark, schema, tmp_path, root, fail_at=None):
    stream = windows.event_stream(spark, f"{tmp_path}/in", schema, late="3650 days").select("user_id", "event_id", "ts")
    write = ledger.batch_writer(root)

    def batch(rows, number):
        if number == fail_at:
            rows.limit(5).write.mode("overwrite").parquet(f"{root}/data/unit=batch-{number:012d}")  # dies half way, without a marker
            raise RuntimeError("executor lost")
        write(rows, number)

    q = ledger.numbered_events(stream, "user_id", "event_id", "ts", "3650 days").writeStream.foreachBatch(batch).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination()


def rows(spark, root, schema):
    return sorted(tuple(r) for r in ledger.read_ledger(spark, root, schema).select("user_id", "event_id", "sequence").collect())


def test_restart_and_replay_equal_batch(spark, sf, tmp_path):
    events = table(spark, sf, "events").orderBy("ts").limit(600)
    root = f"{tmp_path}/ledger"
    schema = spark.createDataFrame([], "user_id long, event_id long, ts timestamp, sequence long").schema
    for k in range(3):
        part = events.where(f"event_id % 3 = {k}")
        (part if k else part.unionAll(part.limit(7))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="executor lost"):
        start(spark, events.schema, tmp_path, root, fail_at=1)
    assert ledger.units(spark, root) == ["batch-000000000000"]
    first = rows(spark, root, schema)
    start(spark, events.schema, tmp_path, root)  # from the checkpoint: batch 1 again, then the rest
    whole = rows(spark, root, schema)
    assert len(ledger.units(spark, root)) >= 3 and set(first) <= set(whole)
    assert sorted(e for _, e, _ in whole) == sorted(r.event_id for r in events.select("event_id").collect())
    by_user = {}
    for u, _, n in whole:
        by_user.setdefault(u, []).append(n)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by_user.values())
    last = max(int(p.name) for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):  # the last batch's commit is lost: it is replayed
        (tmp_path / "check" / "commits" / name).unlink(missing_ok=True)
    start(spark, events.schema, tmp_path, root)
    assert rows(spark, root, schema) == whole
    got = [(r.run_id, r.sequence) for r in ledger.read_trace(ledger.read_ledger(spark, root, schema).withColumnRenamed("user_id", "run_id"), run=whole[0][0], after=1).collect()]
    assert got == [(whole[0][0], n) for n in range(2, len(by_user[whole[0][0]]) + 1)]


def test_commit_once_and_promotions(spark, tmp_path):
    root = f"{tmp_path}/wiki"
    df = spark.createDataFrame([("r1", "e1"), ("r1", "e1"), ("r1", "e2"), ("r2", "e2")], "run_id string, entry_id string")
    empty = ledger.read_ledger(spark, root, df.schema)
    assert empty.count() == 0 and ledger.units(spark, root) == []
    assert ledger.commit_once(ledger.pending_promotions(df.where("run_id = 'r1'"), empty), root, "r1")
    assert not ledger.commit_once(df, root, "r1")
    held = ledger.read_ledger(spark, root, df.schema)
    assert sorted((r.run_id, r.entry_id, r.unit) for r in held.collect()) == [("r1", "e1", "r1"), ("r1", "e2", "r1")]
    assert ledger.pending_promotions(df, held).count() == 0
    more = df.unionAll(spark.createDataFrame([("r3", "e3"), ("r1", "late")], df.schema))
    assert [(r.run_id, r.entry_id) for r in ledger.pending_promotions(more, held).collect()] == [("r3", "e3")]
    df.write.parquet(f"{root}/data/unit=dead")  # a writer that died before its marker
    assert ledger.read_ledger(spark, root, df.schema).count() == 2
    shutil.rmtree(f"{root}/data/unit=r1")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        ledger.read_ledger(spark, root, df.schema).count()


def test_a_silent_key_is_forgotten(spark, tmp_path):
    schema = "user_id long, event_id long, ts timestamp"
    days = ["2024-01-01", "2024-01-02", "2024-02-01", "2024-03-01", "2024-03-02"]
    for k, (user, day) in enumerate(zip([1, 1, 2, 2, 1], days, strict=True)):
        spark.createDataFrame([(user, k)], "user_id long, event_id long").withColumn("ts", F.lit(day).cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*").withWatermark("ts", "1 day")
        q = ledger.numbered_events(stream, "user_id", "event_id", "ts", "10 days").writeStream.foreachBatch(ledger.batch_writer(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
    out = spark.createDataFrame([], f"{schema}, sequence long").schema
    got = {r.event_id: r.sequence for r in ledger.read_ledger(spark, f"{tmp_path}/out", out).collect()}
    assert got == {0: 1, 1: 2, 2: 1, 3: 2, 4: 1}  # the watermark passed user 1, and user 2 not before event 3
