"""Streaming queries run to completion over the events table, and caption markers."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import markers
from vellum.session import table
from vellum.streaming import queues


def stream_sessions(spark, d):
    return queues.finished(queues.sessions(queues.event_stream(spark, d)))


def stream_lease(spark, d):
    return queues.finished(queues.lease(queues.event_stream(spark, d), 6 * 3600))


def stream_deadletter(spark, d):
    """Messages made of events: every kind of fault is among them."""
    e = queues.event_stream(spark, d)
    k = F.col("event_id")
    payload = F.when(k % 7 == 0, F.lit("{broken")).otherwise(F.format_string('{"task_type":"%s","schema_version":%d,"%s":%d}', F.when(k % 5 == 0, "other").otherwise("paper_parse"), k % 3 + 1, F.when(k % 11 == 0, "x").otherwise("job_id"), k))
    good, dead = queues.split_messages(e.select("event_id", payload.alias("payload")))
    return queues.finished(dead.select("event_id", "reason"))


def marker_detect(spark, d):
    p = table(spark, d, "part")
    cap = F.concat(F.lit("Figure. (a) "), F.col("p_name"), F.lit("; (b-d) p < 0.05 shared (e) "), F.col("p_type"), F.lit(" n = 3 (f) end."))
    return markers.segments(markers.detect_markers(p.select("p_partkey", cap.alias("caption")), "caption"), ["p_partkey"], "caption").drop("caption")


QUERIES = {f.__name__: f for f in (stream_sessions, stream_lease, stream_deadletter, marker_detect)}
ORACLE = {
    "stream_deadletter": """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'bad_json' WHEN event_id % 5 = 0 THEN 'unknown_task' WHEN event_id % 3 = 2 THEN 'unknown_version' ELSE 'no_target' END AS reason
FROM events WHERE event_id % 7 = 0 OR event_id % 5 = 0 OR event_id % 3 = 2 OR event_id % 11 = 0""",
}
