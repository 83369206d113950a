"""Numbers and pages over whole tables, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import kept


def numbered(df: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "number") -> DataFrame:
    """df with ``name``: the place of each row, from 1, in the order of its group (of all rows without ``by``).

    Rows are dealt into ranges of (group, order), sorted there and written; what a range holds of a group
    is counted, and the counts of the ranges before it are added. A large group thus spreads over
    ranges. ``order`` should end in something unique, as equal rows share a range."""
    by = by or []
    keys = [F.col(c) for c in by] + order
    rows = kept(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    held = rows.groupBy("_range", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # One row for each range and group: a group has as many as it spans ranges.
    before = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offset = held.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    offset = offset.select(F.col("_range").alias("_in"), *[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], "_first", "_before")
    same = F.col("_range") == F.col("_in")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    return rows.join(offset, same).select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name))


def page(df: DataFrame, number: int, size: int, name: str = "number") -> DataFrame:
    """Rows of one page (from 1) of a numbered table."""
    return df.where(F.col(name).between((number - 1) * size + 1, number * size))


def following(df: DataFrame, key: str, last, size: int) -> DataFrame:
    """The next ``size`` rows by ``key`` after ``last`` (None: the first ones): pages by key, where no row before is read."""
    rest = df if last is None else df.where(F.col(key) > F.lit(last))
    return rest.orderBy(key).limit(size)
