"""Queues, proposals, chains and transitions of the review workflow."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quern.session import dealt


@F.pandas_udf(StringType())
def nfkc_name(text: pd.Series) -> pd.Series:
    """Compatibility form, lower case, without spaces."""
    import unicodedata

    return pd.Series([None if x is None else "".join(unicodedata.normalize("NFKC", x).lower().split()) for x in text], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def explicit_chain(text: pd.Series) -> pd.Series:
    """Outer to inner names of a chain stated in prose: "A belongs to B", "B's A", "A > B"; null without one."""
    import re

    def one(said):
        said = (said or "").strip().rstrip(".")
        if ">" in said:
            parts = [p.strip() for p in said.split(">")]
        elif m := re.fullmatch(r"(.+?) (?:belongs to|is part of) (?:the )?(.+)", said, re.I):
            parts = [m[2].strip(), m[1].strip()]
        elif m := re.fullmatch(r"(.+?)['’]s (.+)", said):
            parts = [m[1].strip(), m[2].strip()]
        else:
            return None
        return parts if len(parts) > 1 and all(parts) else None

    return pd.Series([one(x) for x in text], dtype=object)


def first_error(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, else ok."""
    return reduce(lambda c, r: c.when(r[1], r[0]), rules[1:], F.when(rules[0][1], rules[0][0])).otherwise("ok")


def transition(current: Column, event: Column, allowed: dict[str, tuple[str, str]]) -> Column:
    """allowed: event -> (state it may come from, state it leads to); other events change nothing."""
    out = current
    for name, (source, target) in allowed.items():
        out = F.when((event == name) & (current == source), target).otherwise(out)
    return out


def next_item(items: DataFrame, by: str, order: list[Column]) -> DataFrame:
    return items.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("__r = 1").drop("__r")


def reused_or_new(requests: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """The active session of each key, or a new one named by the request."""
    a = active.groupBy(key).agg(F.max("session_id").alias("__active"))
    return requests.join(a, key, "left").select(key, F.coalesce("__active", "request_id").alias("session_id"), F.col("__active").isNull().alias("opened"))


def limited_starts(requests: DataFrame, key: str, at: str, order: str, per_minute: float = 30, cooldown: DataFrame | None = None) -> DataFrame:
    """requests with starts (seconds): each begins no sooner than it comes and 60 / per_minute seconds after the
    one before it, the first not before its key's cooldown is over. cooldown: key, until.

    The chain start[i] = max(at[i], start[i-1] + step) is a running maximum of at[j] - j * step, so no fold is needed."""
    step = 60.0 / per_minute
    rows = requests if cooldown is None else requests.join(cooldown.select(F.col(key).alias("__key"), "until"), F.col(key) == F.col("__key"), "left").drop("__key")
    w = Window.partitionBy(key).orderBy(at, order)
    own = F.col(at).cast("double") if cooldown is None else F.greatest(F.col(at).cast("double"), F.coalesce("until", F.lit(0.0)))
    rows = rows.withColumn("__i", F.row_number().over(w) - 1).withColumn("__own", own - F.col("__i") * step)
    best = F.max("__own").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("starts", best + F.col("__i") * step).drop("__i", "__own")
    return out if cooldown is None else out.drop("until")


def cooldowns(failures: DataFrame, key: str, at: str, message: str, window: float = 300.0) -> DataFrame:
    """(key, until): ``window`` seconds after the last failure that was a rate limit."""
    return failures.where(F.contains(message, F.lit("429"))).groupBy(key).agg((F.max(at).cast("double") + window).alias("until"))


def until_limited(results: DataFrame, run: str, order: str, error: str) -> DataFrame:
    """results with outcome: each run stops at its first rate limit (429). What came before is in the checkpoint
    (saved) or the list of failures (failed); that one and all later ones wait for the next run (pending)."""
    limited = F.contains(F.coalesce(error, F.lit("")), F.lit("429"))
    stopped = F.max(limited).over(Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return results.withColumn("outcome", F.when(stopped, "pending").when(F.col(error).isNotNull(), "failed").otherwise("saved"))


def unfinished(rows: DataFrame, checkpoint: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no record of the checkpoint has with the same key, hash and text; a changed row runs again."""
    return rows.join(checkpoint.select(*keys).distinct(), keys, "left_anti")


def migrations(files: DataFrame, applied: DataFrame) -> DataFrame:
    """(name, checksum, state) of files (name, sql): to apply, applied, or mismatch if an applied one has changed."""
    known = applied.select("name", F.col("checksum").alias("__known"))
    f = files.withColumn("checksum", F.sha2("sql", 256)).join(known, "name", "left")
    return f.select("name", "checksum", F.when(F.col("__known").isNull(), "apply").when(F.col("__known") == F.col("checksum"), "applied").otherwise("mismatch").alias("state"))


def imported_roles(entries: DataFrame, known: tuple[str, ...], default: str = "unconfirmed_claim") -> DataFrame:
    """(case_id, message_index, role, reason): one role for each message of a case, the last stated (seq); words outside the
    vocabulary become the default, indexes that are no numbers -1, reasons are cut to 400 characters."""
    index = F.coalesce(F.trim("message_index").try_cast("int"), F.lit(-1))
    role = F.when(F.col("role").isin(*known), F.col("role")).otherwise(default)
    rows = entries.where(F.col("case_id").isNotNull()).select("case_id", index.alias("message_index"), "seq", role.alias("role"), F.left(F.coalesce("reason", F.lit("")), F.lit(400)).alias("reason"))
    return rows.groupBy("case_id", "message_index").agg(F.max(F.struct("seq", "role", "reason")).alias("m")).select("case_id", "message_index", "m.role", "m.reason")


def repeated_pairs(rows: DataFrame, by: str, item: str, least: int = 2) -> DataFrame:
    """(a, b, n): pairs a < b of items that ``least`` groups or more hold. rows: by, item; repeated rows count once.
    Rows and pairs are dealt over as many tasks as their numbers need."""
    x = dealt(rows.select(F.col(by).alias("g"), F.col(item).alias("a")).where("g is not null and a is not null"), rows.count(), "g").distinct()
    n = x.groupBy("g").agg(F.count("*").alias("n")).agg(F.expr("cast(sum(n * (n - 1) / 2) as long)")).first()[0] or 0
    pairs = x.join(x.withColumnRenamed("a", "b"), "g").where("a < b").select("a", "b")
    return dealt(pairs, n, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
