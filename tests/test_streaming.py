import datetime as dt

from quern.streaming import queue


def events(n, start=0):
    at = dt.datetime(2024, 1, 1)
    return [(start + i, at + dt.timedelta(minutes=i), (start + i) % 3, ["view", "error", "click"][i % 3], float(i), '{"k": 1}') for i in range(n)]


SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_jobs_are_processed_once_over_restarts(spark, tmp_path):
    source, out, check = f"{tmp_path}/events.parquet", f"{tmp_path}/out", f"{tmp_path}/check"
    spark.createDataFrame(events(30), SCHEMA).repartition(3).write.parquet(source)
    queue.run_jobs(queue.event_stream(spark, str(tmp_path)), out, check)
    spark.createDataFrame(events(10, 30), SCHEMA).coalesce(1).write.mode("append").parquet(source)
    queue.run_jobs(queue.event_stream(spark, str(tmp_path)), out, check)
    got = [r["event_id"] for r in spark.read.parquet(out).collect()]
    assert sorted(got) == list(range(40))


def test_stream_state_equals_batch(spark, tmp_path):
    rows = events(50) + events(20)  # the first 20 come twice
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    stream = queue.event_stream(spark, str(tmp_path))
    first = queue.drained(queue.deduplicated(stream, ["event_id"], "1 day").select("event_id"), f"{tmp_path}/first", f"{tmp_path}/c1", "append")
    assert sorted(r["event_id"] for r in first.collect()) == list(range(50))
    counts = queue.drained(queue.counts_by_key(stream, "user_id"), f"{tmp_path}/counts", f"{tmp_path}/c2")
    want = {}
    for r in rows:
        want[r[2]] = want.get(r[2], 0) + 1
    assert {r["user_id"]: r["n"] for r in counts.collect()} == want


def test_claims_skip_done_jobs_and_put_failed_ones_last(spark):
    batch = spark.createDataFrame(events(6), SCHEMA)
    done = batch.where("event_id = 0").select("event_id")
    assert [r["event_id"] for r in queue.claims(batch, done).collect()] == [2, 3, 5, 1, 4]
