"""Event and conversation queries: ledgers, traces, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import ledger
from lexmill.registry import query
from lexmill.sources.tables import table
from lexmill.streaming import windows


@query("trace_sequence", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events")
def trace_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Events numbered within each user."""
    return ledger.number_events(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "sequence")


@query("latest_event", "SELECT user_id, event_id, event_type, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'running' ELSE 'waiting' END AS phase FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_event(spark: SparkSession, d: str) -> DataFrame:
    """Last event of each user and the phase it stands for."""
    last = ledger.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["ts", "event_id", "event_type"])
    phase = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "running").otherwise("waiting")
    return last.select("user_id", "event_id", "event_type", phase.alias("phase"))


@query("next_sequence", "SELECT conv_id, coalesce(max(turn), 0) + 1 AS next_sequence FROM conversations GROUP BY 1")
def next_sequence(spark: SparkSession, d: str) -> DataFrame:
    return ledger.next_sequence(table(spark, d, "conversations"), "conv_id", "turn")


@query("recent_turns", """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 3""")
def recent_turns(spark: SparkSession, d: str) -> DataFrame:
    """The last three turns of each conversation, oldest first."""
    return ledger.recent(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 3).select("conv_id", "turn", "role", "position")


@query("timeline_json", """SELECT event_id, user_id, json_extract_string(props, '$.page') AS page, CASE WHEN lower(event_type) LIKE '%purchase%' THEN 'done' WHEN lower(event_type) LIKE '%click%' THEN 'action' ELSE 'note' END AS kind FROM events WHERE event_id > 100""")
def timeline_json(spark: SparkSession, d: str) -> DataFrame:
    """Events after a sequence number with a field of their JSON payload and a display kind."""
    low = F.lower("event_type")
    kind = F.when(low.contains("purchase"), "done").when(low.contains("click"), "action").otherwise("note")
    return table(spark, d, "events").where("event_id > 100").select("event_id", "user_id", F.get_json_object("props", "$.page").alias("page"), kind.alias("kind"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts and sums of each event type: the batch form of the streaming query."""
    return windows.tumbling(table(spark, d, "events"), "1 hour").withColumn("total", F.round("total", 6))


@query("event_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user, closed by 30 minutes of silence."""
    return windows.sessions(table(spark, d, "events"), "30 minutes")


@query("group_quotas", """WITH g AS (SELECT n_regionkey AS batch, n_nationkey AS pos, count(c_custkey) AS size FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2 HAVING count(c_custkey) > 0),
q AS (SELECT *, (sum(size) OVER (PARTITION BY batch) // 3) AS quota FROM g),
e AS (SELECT *, quota * size / sum(size) OVER (PARTITION BY batch) AS exact FROM q),
s AS (SELECT *, floor(exact) AS share, exact - floor(exact) AS frac FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY round(frac, 12) DESC, pos) AS turn, quota - sum(share) OVER (PARTITION BY batch) AS unplaced FROM s)
SELECT batch, pos, size, (share + CASE WHEN turn <= unplaced THEN 1 ELSE 0 END)::BIGINT AS quota FROM r""")
def group_quotas(spark: SparkSession, d: str) -> DataFrame:
    """A third of each region's customers removed, shared out among nations by largest remainder."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    sizes = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("batch"), F.col("n_nationkey").alias("pos")).agg(F.count("*").alias("size"))
    from pyspark.sql import Window

    return ledger.group_quotas(sizes, F.floor(F.sum("size").over(Window.partitionBy("batch")) / 3))
