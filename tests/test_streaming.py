"""Streams give what their batch forms give."""

from lexmill.sources.tables import table
from lexmill.streaming import windows


def _split(spark, sf, path, parts=3):
    events = table(spark, sf, "events")
    for k in range(parts):
        events.where(f"event_id % {parts} = {k}").coalesce(1).write.mode("append").parquet(str(path))
    return events


def _run(stream, name, mode, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/check-{name}").trigger(availableNow=True).start()
    q.awaitTermination()


def test_windows_equal_batch(spark, sf, tmp_path):
    events = _split(spark, sf, tmp_path / "in")
    _run(windows.tumbling(windows.event_stream(spark, f"{tmp_path}/in", events.schema, late="3650 days"), "1 hour"), "hourly", "complete", tmp_path)
    key = lambda r: (r.window_start, r.event_type, r.n, round(r.total, 6))
    assert sorted(map(key, spark.table("hourly").collect())) == sorted(map(key, windows.tumbling(events, "1 hour").collect()))


def test_trace_numbers_each_user_without_gaps(spark, sf, tmp_path):
    events = _split(spark, sf, tmp_path / "in")
    stream = windows.event_stream(spark, f"{tmp_path}/in", events.schema, late="3650 days")
    _run(windows.numbered_trace(stream.select("user_id", "event_id", "ts")), "trace", "append", tmp_path)
    got = spark.table("trace").collect()
    assert len(got) == events.count()
    by_user: dict[int, list[int]] = {}
    for r in got:
        by_user.setdefault(r.user_id, []).append(r.sequence)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by_user.values())
