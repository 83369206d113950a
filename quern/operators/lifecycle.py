"""State machines as event logs folded to their latest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; ties cannot be, for order is unique."""
    others = [c for c in log.columns if c not in (key, order)]
    return log.groupBy(key).agg(F.max(F.struct(order, *others)).alias("m")).select(key, "m.*")


def published(log: DataFrame, key: str, version: str) -> DataFrame:
    """Every version with its status: the newest of a key is published, the others archived."""
    newest = F.max(version).over(Window.partitionBy(key))
    return log.withColumn("publication", F.when(F.col(version) == newest, "published").otherwise("archived"))


def revisions(log: DataFrame, key: str, order: str) -> DataFrame:
    """Adds revision (from 1) and whether the revision an edit was based on is stale."""
    w = Window.partitionBy(key).orderBy(order)
    return log.withColumn("revision", F.row_number().over(w)).withColumn("stale", F.col("based_on") != F.col("revision") - 1)


def retry_at(attempts: Column, failed_at: Column, most: int = 5) -> Column:
    """Next start after attempts * 60 s; null once attempts + 1 reaches ``most``."""
    return F.when(attempts + 1 < most, F.timestamp_seconds(F.unix_micros(failed_at.cast("timestamp")) / 1e6 + attempts * 60))


def idempotent(requests: DataFrame, key: str, order: str, digest: str) -> DataFrame:
    """Decision for each request: the first of a key is created; later ones with its digest
    return it, others conflict."""
    first = F.first(digest).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    at = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return requests.withColumn("decision", F.when(at == 1, "created").when(F.col(digest) == first, "duplicate").otherwise("conflict"))


def folded_turns(events: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """(key, state, turns): a learning session folded over its ordered events: correct and
    unknown reopen it, confirm closes what is open, skip moves on, the rest asks."""
    step = """aggregate(e, named_struct('state', 'open', 'turns', 0), (a, x) -> named_struct(
      'state', case when a.state = 'confirmed' and x.k <> 'correct' then 'confirmed'
                    when x.k = 'confirm' then 'confirmed' when x.k = 'correct' then 'open'
                    when x.k = 'skip' then 'skipped' when x.k = 'unknown' then 'clarify' else 'asked' end,
      'turns', a.turns + 1))"""
    g = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(kind).alias("k")))).alias("e"))
    return g.select(key, F.expr(step).alias("s")).select(key, "s.state", F.col("s.turns").alias("turns"))


def claimed(inbox: DataFrame, jobs: DataFrame, now: Column, workers: str) -> DataFrame:
    """(worker, kind, id): what each worker takes next: the oldest queued message of its inbox, and only without one the
    document job that is longest due. inbox: worker, id, status, at; jobs: worker, id, status, at (when it is due)."""
    ready = inbox.where("status = 'queued'").select(workers, F.lit(0).alias("p"), F.lit("message").alias("kind"), "id", "at").unionByName(
        jobs.where("status = 'queued'").where(F.col("at") <= now).select(workers, F.lit(1).alias("p"), F.lit("document").alias("kind"), "id", "at"))
    first = ready.groupBy(workers).agg(F.min(F.struct("p", "at", "id", "kind")).alias("m"))
    return first.select(workers, F.col("m.kind").alias("kind"), F.col("m.id").alias("id"))


def recovered(jobs: DataFrame, alive: DataFrame) -> DataFrame:
    """jobs (worker, status) after a crash: what a worker that is not alive was processing is queued again."""
    there = alive.select("worker").distinct().withColumn("there", F.lit(True))
    lost = (F.col("status") == "processing") & F.col("there").isNull()
    return jobs.join(there, "worker", "left").withColumn("status", F.when(lost, "queued").otherwise(F.col("status"))).drop("there")


def alive(beats: DataFrame, now: Column, seconds: int = 60) -> DataFrame:
    """(worker, last, alive): the last heartbeat (worker, at in seconds) of each worker, and whether it is at most ``seconds`` old."""
    last = beats.groupBy("worker").agg(F.max("at").alias("last"))
    return last.withColumn("alive", now - F.col("last") <= seconds)
