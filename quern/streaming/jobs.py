"""The job queue as keyed state: one state a job key, with a timer for its next run.

A stream of requests and outcomes goes in, the decisions come out. A key is enqueued once;
a retryable failure waits attempts x 60 seconds on a timer and is then queued again; a final
failure or a success closes the key. The state is Spark's and survives restarts from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Events in: what happens to a job at a time. ``kind`` is enqueue, start, done, retry (a failure that may pass) or fail.
EVENTS = "key string, at timestamp, kind string"
#: Decisions out: the status that the job has from that time on, its attempts, and when it may run next.
DECISIONS = "key string, at timestamp, status string, attempts int, next_run timestamp"
_STATE = "status string, attempts int"
_ORDER = {"enqueue": 0, "start": 1, "retry": 2, "fail": 3, "done": 4}


class Jobs(StatefulProcessor):
    """Transitions of one job. What does not fit its status is answered with the status unchanged, as ``ignored``."""

    def __init__(self, wait_seconds: int = 60):
        self.wait = wait_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        events["order"] = events["kind"].map(_ORDER).fillna(9)
        out = []
        status, attempts = self.job.get() if self.job.exists() else (None, 0)
        for at, kind in events.sort_values(["at", "order"])[["at", "kind"]].itertuples(index=False):
            following = None
            if kind == "enqueue" and status is None:
                status = "queued"
            elif kind == "start" and status == "queued":
                status, attempts = "processing", attempts + 1
            elif kind == "done" and status == "processing":
                status = "completed"
            elif kind == "fail" and status == "processing":
                status = "failed"
            elif kind == "retry" and status == "processing":
                status = "waiting"
                due = int(at.timestamp() * 1000) + attempts * self.wait
                following = pd.Timestamp(due, unit="ms")
                self.handle.registerTimer(due)
            else:
                out.append((at, "ignored", attempts, None))
                continue
            out.append((at, status, attempts, following))
        if status is not None:
            self.job.update((status, attempts))
        yield self._rows(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, attempts = self.job.get() if self.job.exists() else (None, 0)
        if status == "waiting":
            self.job.update(("queued", attempts))
            at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
            yield self._rows(key[0], [(at, "queued", attempts, at)])

    @staticmethod
    def _rows(key: str, rows: list) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["at", "status", "attempts", "next_run"])
        frame.insert(0, "key", key)
        return frame.astype({"attempts": "int32", "at": "datetime64[us]", "next_run": "datetime64[us]"})

    def close(self) -> None:
        pass


def decisions(events: DataFrame, delay: str = "0 seconds", wait_seconds: int = 60) -> DataFrame:
    """The stream of decisions on a stream of events (key, at, kind). Timers run on event time, behind a watermark of ``delay``."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = events.select(F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at"), "kind").where("key is not null and at is not null")
    return stream.withWatermark("at", delay).groupBy("key").transformWithStateInPandas(Jobs(wait_seconds), DECISIONS, "append", "eventTime")


def claimable(found: DataFrame, now) -> DataFrame:
    """The queued jobs that are due at ``now``, earliest first: each key's last decision counts."""
    last = found.where("status <> 'ignored'").groupBy("key").agg(F.max(F.struct("at", "attempts", "status", "next_run")).alias("d")).select("key", "d.*")
    return last.where((F.col("status") == "queued") & (F.coalesce("next_run", "at") <= F.lit(now))).orderBy(F.coalesce("next_run", "at"), "key")
