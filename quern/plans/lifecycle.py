"""Lifecycle queries over events and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import lifecycle as lc, overlay
from quern.plans import sql as s
from quern.plans.common import registry
from quern.session import table

QUERIES, SQL, query = registry()


@query("g13_publication", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) THEN 'published' ELSE 'archived' END AS publication FROM orders")
def _(spark, sf):
    return lc.published(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey")


@query("m06_knowledge_history", s.with_(s.RUNS) + "SELECT knowledge_id, count(*) AS revision, arg_max(status, run_id) AS status, arg_max(value, run_id) AS value FROM runs WHERE knowledge_id IS NOT NULL GROUP BY 1")
def _(spark, sf):
    r = overlay.runs(spark, sf).where("knowledge_id is not null")
    n = r.groupBy("knowledge_id").agg(F.count("*").alias("revision"))
    return lc.latest(r.select("knowledge_id", "run_id", "status", "value"), "knowledge_id", "run_id").join(n, "knowledge_id").select("knowledge_id", "revision", "status", "value")


@query("m07_stale_revision", s.with_(s.RUNS) + "SELECT run_id, user_id, revision, based_on <> revision - 1 AS stale FROM (SELECT run_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY run_id) AS revision, row_number() OVER (PARTITION BY user_id ORDER BY run_id) - 1 - (run_id % 3 = 0)::INT AS based_on FROM runs)")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("run_id")
    r = overlay.runs(spark, sf).select("run_id", "user_id").withColumn("based_on", F.row_number().over(w) - 1 - (F.col("run_id") % 3 == 0).cast("int"))
    return lc.revisions(r, "user_id", "run_id").select("run_id", "user_id", "revision", "stale")


@query("q07_idempotent_runs", s.with_(s.RUNS) + "SELECT run_id, CASE WHEN r = 1 THEN 'created' WHEN d = f THEN 'duplicate' ELSE 'conflict' END AS decision FROM (SELECT run_id, row_number() OVER w AS r, event_type AS d, first_value(event_type) OVER w AS f FROM runs WINDOW w AS (PARTITION BY user_id, knowledge_id ORDER BY run_id))")
def _(spark, sf):
    r = overlay.runs(spark, sf).withColumn("key", F.concat_ws("/", "user_id", F.coalesce(F.col("knowledge_id").cast("string"), F.lit("-"))))
    return lc.idempotent(r, "key", "run_id", "event_type").select("run_id", "decision")


@query("t02_retry_backoff", s.with_(s.RUNS) + "SELECT run_id, attempts, CASE WHEN attempts + 1 < 5 THEN epoch_us(created_at) // 1000000 + attempts * 60 END AS next_s FROM (SELECT run_id, created_at, row_number() OVER (PARTITION BY user_id ORDER BY run_id) AS attempts FROM runs WHERE status = 'failed')")
def _(spark, sf):
    f = overlay.runs(spark, sf).where("status = 'failed'").withColumn("attempts", F.row_number().over(Window.partitionBy("user_id").orderBy("run_id")))
    at = F.floor(F.unix_micros(lc.retry_at(F.col("attempts"), F.col("created_at"))) / 1_000_000).cast("long")
    return f.select("run_id", "attempts", at.alias("next_s"))


@query("t05_idempotent_enqueue", s.with_(s.RUNS) + "SELECT user_id, knowledge_id, min(run_id) AS run_id FROM runs GROUP BY 1, 2")
def _(spark, sf):
    return overlay.runs(spark, sf).groupBy("user_id", "knowledge_id").agg(F.min("run_id").alias("run_id"))


_TURN = "CASE event_type WHEN 'view' THEN 'ask' WHEN 'click' THEN 'confirm' WHEN 'purchase' THEN 'correct' WHEN 'signup' THEN 'skip' ELSE 'unknown' END"


@query("m01_learning_turns", f"""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, {_TURN} AS k FROM events),
 f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 'open' AS state FROM events UNION ALL SELECT f.user_id, e.n, CASE WHEN f.state='confirmed' AND k <> 'correct' THEN 'confirmed' WHEN k='confirm' THEN 'confirmed' WHEN k='correct' THEN 'open' WHEN k='skip' THEN 'skipped' WHEN k='unknown' THEN 'clarify' ELSE 'asked' END FROM f JOIN e ON e.user_id=f.user_id AND e.n=f.n+1)
 SELECT user_id, arg_max(state, n) AS state, max(n) AS turns FROM f GROUP BY 1""")
def _(spark, sf):
    kind = F.when(F.col("event_type") == "view", "ask").when(F.col("event_type") == "click", "confirm").when(F.col("event_type") == "purchase", "correct").when(F.col("event_type") == "signup", "skip").otherwise("unknown")
    return lc.folded_turns(table(spark, sf, "events").withColumn("k", kind), "user_id", "event_id", "k")
