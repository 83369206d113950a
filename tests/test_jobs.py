"""Keyed job state with timers, over restarts."""

import datetime as dt

from quern.streaming import jobs, queue

T = dt.datetime(2024, 1, 1)


def at(seconds):
    return T + dt.timedelta(seconds=seconds)


def test_jobs_with_timers_over_restarts(spark, tmp_path):
    source = f"{tmp_path}/events.parquet"

    def send(*events):
        spark.createDataFrame([(k, at(s), kind) for k, s, kind in events], jobs.EVENTS).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
        return queue.drained(jobs.decisions(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/check", "append")

    send(("a", 0, "enqueue"), ("a", 1, "enqueue"), ("a", 2, "start"), ("a", 3, "retry"), ("b", 0, "enqueue"), ("b", 1, "done"))
    first = {(r["key"], r["status"], r["attempts"], r["next_run"]) for r in run().collect()}
    assert first == {("a", "queued", 0, None), ("a", "ignored", 0, None), ("a", "processing", 1, None), ("a", "waiting", 1, at(63)), ("b", "queued", 0, None), ("b", "ignored", 0, None)}
    # Another process goes on from the checkpoint; time passes when events come.
    send(("a", 10, "enqueue"), ("b", 30, "start"))
    run()
    send(("c", 200, "enqueue"))
    run()
    send(("c", 400, "start"))
    found = run()
    rows = [(r["key"], r["status"], r["attempts"], r["at"]) for r in found.collect()]
    assert [r for r in rows if r[:2] == ("a", "queued")] == [("a", "queued", 0, at(0)), ("a", "queued", 1, at(63))]
    assert ("b", "processing", 1, at(30)) in rows and sum(r[0] == "a" and r[1] == "ignored" for r in rows) == 2
    assert [r["key"] for r in jobs.claimable(found, at(63)).collect()] == ["a"] and jobs.claimable(found, at(62)).count() == 0
