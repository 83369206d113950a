"""Streams drained over all events; the batch form is their oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans.common import registry
from quern.session import shared_path
from quern.streaming import queue

QUERIES, SQL, query = registry()


def _drained(spark, stream, name, mode="complete"):
    return queue.drained(stream, shared_path(spark, name), shared_path(spark, f"{name}-state"), mode)


@query("t05_stream_latest_state", "SELECT user_id, count(*) AS n, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def _(spark, sf):
    return _drained(spark, queue.counts_by_key(queue.event_stream(spark, sf), "user_id"), "latest")


@query("t05_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, sf):
    s = queue.deduplicated(queue.event_stream(spark, sf), ["user_id", "event_type"], "3650 days")
    return _drained(spark, s.select("user_id", "event_type"), "dedup", "append")


@query("ext_stream_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    out = _drained(spark, queue.windowed(queue.event_stream(spark, sf)), "windows")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))
