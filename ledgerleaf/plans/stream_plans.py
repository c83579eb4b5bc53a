"""Queries that run streams over the event table to their end, in files that follow each other in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerleaf.operators.report import RATES
from ledgerleaf.plans import sql_views as v
from ledgerleaf.plans.sql_views import q
from ledgerleaf.sources import views
from ledgerleaf.streaming import stream as s

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Days of a file; days from here on are in the last one.
DAYS, PARTS = 8, 4


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return add


def events(spark, d):
    """The event table as a stream of a file a batch, each of some days."""
    part = F.least(F.lit(PARTS - 1), F.expr(f"(dayofyear(ts) - 1) div {DAYS}"))
    return s.read_stream(spark, s.in_files(views.table(spark, d, "events"), part, PARTS), files=1)


@query("t1_stream_counts", "SELECT user_id AS doc_id, event_type AS type, count(*) AS n, false AS is_partial FROM events GROUP BY 1, 2")
def _(spark, d):
    own = events(spark, d).select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("type"), "ts")
    last = s.final_state(s.run_updates(s.stream_counts(own, ["doc_id", "type"])), ["w", "doc_id", "type"])
    return last.groupBy("doc_id", "type").agg(F.sum("n").alias("n"), F.bool_or("is_partial").alias("is_partial"))


T1_BATCHES = f"""
WITH days AS (
  SELECT user_id, event_type, CAST(ts AS DATE) AS day, least({PARTS - 1}, (dayofyear(ts) - 1) // {DAYS}) AS part FROM events
)
SELECT CAST(part AS BIGINT) AS batch, count(DISTINCT (user_id, event_type, day)) AS n_states, count(*) AS n, part < (SELECT max(part) FROM days) AS is_partial
FROM days GROUP BY part
"""


@query("t1_partial_states", T1_BATCHES)
def _(spark, d):
    own = events(spark, d).select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("type"), "ts")
    states = s.run_updates(s.stream_counts(own, ["doc_id", "type"]))
    return states.groupBy("batch").agg(F.count(F.lit(1)).alias("n_states"), F.sum("n").alias("n"), F.bool_or("is_partial").alias("is_partial"))


T2 = """
SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page_number,
  concat_ws(chr(10), lag(substr(text, 1, 50), 2) OVER w, lag(substr(text, 1, 50)) OVER w) AS context
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
"""


@query("t2_stream_context", T2)
def _(spark, d):
    rows = views.table(spark, d, "conversations")
    feed = s.read_stream(spark, s.in_files(rows, F.least(F.lit(PARTS - 1), F.expr("turn div 2")), PARTS), files=1)
    own = feed.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_number"), "text")
    return s.run_available(s.stream_context(own, 2, 50), "append", timers=True)


LIMIT = 0.02
T3 = f"""
SELECT doc_id, CAST(day AS VARCHAR)[1:10] AS day, round(cost, 8) AS cost, n, cost > {LIMIT} AS over_budget
FROM (
  SELECT doc_id, date_trunc('day', ts) AS day, CAST(sum(input_tokens) * 1.25 + sum(output_tokens) * 10.0 + sum(image_tokens) * 2.0 AS DOUBLE) / 1000000 AS cost, count(*) AS n
  FROM v_calls GROUP BY 1, 2
)
"""


@query("t3_stream_cost", q(T3, v.CALLS))
def _(spark, d):
    tokens = F.floor(F.col("value") * 10).cast("long")
    image = F.when(F.col("event_type") == "view", 100).otherwise(0)
    own = events(spark, d).select(F.col("user_id").alias("doc_id"), "ts", tokens.alias("input_tokens"), F.expr("cast(floor(value * 10) as bigint) div 2").alias("output_tokens"), image.alias("image_tokens"))
    out = s.final_state(s.run_updates(s.stream_cost(own, RATES, limit=LIMIT)), ["doc_id", "start"])
    return out.select("doc_id", F.date_format("start", "yyyy-MM-dd").alias("day"), F.round("cost", 8).alias("cost"), "n", "over_budget")


@query("t4_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    return s.run_available(s.stream_dedup(events(spark, d).select("ts", "user_id", "event_type"), ["user_id", "event_type"]), "append")


T5 = """
SELECT source, event_id, status
FROM (SELECT *, lag(status) OVER (PARTITION BY source ORDER BY ts, event_id) AS before FROM v_status)
WHERE before IS NULL OR before <> status
"""


@query("t5_stream_status", q(T5, v.STATUS))
def _(spark, d):
    status = F.when(F.col("event_type") == "error", "offline").otherwise("online")
    own = events(spark, d).select(F.col("user_id").cast("long").alias("source"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), status.alias("status"))
    return s.status_feed(own)


@query("t6_stream_progress", "SELECT user_id AS doc_id, max_by(event_type, struct_pack(ts, event_id)) AS stage, count(*) AS n_events FROM events GROUP BY 1")
def _(spark, d):
    own = events(spark, d).select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("stage"), "ts", "event_id")
    days = s.final_state(s.run_updates(s.stream_progress(own)), ["doc_id", "w"])
    return days.groupBy("doc_id").agg(F.max_by("stage", "at").alias("stage"), F.sum("n_events").alias("n_events"))


X3 = f"SELECT least({PARTS - 1}, (dayofyear(ts) - 1) // {DAYS}) AS batch, count(*) AS input_rows, true AS timed FROM events GROUP BY 1"


@query("x3_stream_progress", X3)
def _(spark, d):
    own = events(spark, d).select("ts", "user_id", "event_type")
    with s.ProgressTable(spark) as progress:
        s.run_available(s.stream_dedup(own, ["user_id", "event_type"]), "append")
    return progress.table().where("input_rows > 0").select("batch", "input_rows", (F.col("duration_ms") > 0).alias("timed"))
