"""Review groups: lossless aggregates with provenance, conflicts, members, events, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import squeezed

#: Keys that name a single case say nothing about a group.
CASE_PREFIX = "telegram.case."


def fact_key(value: Column) -> Column:
    return squeezed(value)


def group_key(titles: Column) -> Column:
    """A key from the sorted normalised titles, for groups without a key of their own."""
    return F.concat(F.lit("telegram.group."), F.left(F.sha1(F.array_join(F.array_sort(F.transform(titles, squeezed)), "|")), F.lit(16)))


def aggregated(members: DataFrame) -> DataFrame:
    """(group_id, knowledge_key, title, primary_id, members, frequency, mixed): the key that most members have,
    the first seen among equals; the title of the member of highest frequency, then least id.
    members: group_id, id, position, knowledge_key, title, frequency."""
    own = F.when((F.col("knowledge_key") != "") & ~F.col("knowledge_key").startswith(CASE_PREFIX), F.col("knowledge_key"))
    keyed = members.withColumn("own", own)
    top = (keyed.where("own is not null").groupBy("group_id", "own").agg(F.count("*").alias("n"), F.min("position").alias("first"))
           .groupBy("group_id").agg(F.max_by("own", F.struct("n", -F.col("first"))).alias("key"), (F.count("*") > 1).alias("mixed")))
    g = members.groupBy("group_id").agg(
        F.max_by(F.struct("title", "id"), F.struct("frequency", -F.col("id"))).alias("p"), F.count("*").alias("members"), F.sum("frequency").alias("frequency"),
        F.collect_list(F.coalesce("title", F.col("knowledge_key"), F.lit(""))).alias("titles"))
    return g.join(top, "group_id", "left").select("group_id", F.coalesce("key", group_key(F.col("titles"))).alias("knowledge_key"), F.col("p.title").alias("title"),
                                                  F.col("p.id").alias("primary_id"), "members", "frequency", F.coalesce("mixed", F.lit(False)).alias("mixed"))


def facts(members: DataFrame) -> DataFrame:
    """(group_id, fact_type, fact_key, value, source_id, kept): one row for each value and source,
    so that nothing is lost; ``kept`` marks the first seen of each key, which the aggregate shows.
    members: group_id, id, position, values map<string, array<string>>."""
    rows = members.select("group_id", "id", "position", F.explode("values").alias("fact_type", "l")).select("*", F.posexplode("l").alias("at", "value"))
    rows = rows.withColumn("fact_key", fact_key(F.col("value")))
    w = Window.partitionBy("group_id", "fact_type", "fact_key").orderBy("position", "at")
    return rows.select("group_id", "fact_type", "fact_key", "value", F.col("id").alias("source_id"), (F.row_number().over(w) == 1).alias("kept"), "position", "at")


def unions(all_facts: DataFrame) -> DataFrame:
    """(group_id, fact_type, values): the kept values in the order in which they were first seen."""
    kept = all_facts.where("kept").groupBy("group_id", "fact_type").agg(F.array_sort(F.collect_list(F.struct("position", "at", "value"))).alias("l"))
    return kept.select("group_id", "fact_type", F.transform("l", lambda x: x["value"]).alias("values"))


def fact_cards(rows: DataFrame) -> DataFrame:
    """One card for each (group_id, fact_type, fact_key): the first value, included if all rows are selected,
    in conflict if any is, and all sources in order. rows: these, fact_id, value, selected, conflict, source_id."""
    return rows.groupBy("group_id", "fact_type", "fact_key").agg(
        F.min_by("value", "fact_id").alias("text"), F.bool_and(F.coalesce("selected", F.lit(True))).alias("included"),
        F.bool_or(F.coalesce("conflict", F.lit(False))).alias("conflict"), F.transform(F.array_sort(F.collect_list(F.struct("fact_id", "source_id"))), lambda x: x["source_id"]).alias("sources"))


def negative_conflicts(cases: DataFrame, examples: DataFrame) -> DataFrame:
    """(group_id, example_id, case_ids): a group that holds two or more cases of one example that says they
    do not belong together. cases: group_id, case_id. examples: example_id, case_ids array."""
    pairs = examples.select("example_id", F.explode(F.array_distinct("case_ids")).alias("case_id"))
    hit = cases.distinct().join(pairs, "case_id").groupBy("group_id", "example_id").agg(F.array_sort(F.collect_set("case_id")).alias("case_ids"))
    return hit.where(F.size("case_ids") >= 2)


def members_of(groups: DataFrame, similarity: Column) -> DataFrame:
    """Members of new groups (group_id, position): the first is the seed with similarity 1, the others that with it."""
    return groups.withColumn("similarity", F.when(F.col("position") == 0, 1.0).otherwise(similarity)).withColumn("membership", F.lit("included"))


def merged_cases(members: DataFrame, cases: DataFrame) -> DataFrame:
    """(group_id, case_id, case_position): the cases of all members, each once, numbered from 0 in the order of
    member and position. cases: id, case_id, case_position."""
    rows = members.select("group_id", "id").join(cases, "id").groupBy("group_id", "case_id").agg(F.min(F.struct("id", "case_position")).alias("o"))
    return rows.select("group_id", "case_id", (F.row_number().over(Window.partitionBy("group_id").orderBy("o", "case_id")) - 1).alias("case_position"))


def groupable(candidates: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """candidates (id, review, state) that can join a new group: reviewable drafts, not canonical for a group
    and not an included member of an open or published one. groups: group_id, canonical_id, status; members: group_id, id, membership."""
    live = groups.where("status in ('open', 'published')").select("group_id")
    held = members.where("membership = 'included'").join(live, "group_id", "left_semi").select("id")
    canonical = groups.select(F.col("canonical_id").alias("id")).where("id is not null")
    ready = candidates.where((F.col("state") == "draft") & F.col("review").isin("pending", "needs_review"))
    return ready.join(held, "id", "left_anti").join(canonical, "id", "left_anti")


def recomputed(groups: DataFrame, members: DataFrame) -> DataFrame:
    """groups (group_id, status) with the state that their members lead to: no included member closes an open
    group, a member in conflict blocks it, and only open, unblocked groups can be approved. members: group_id, membership, conflict."""
    g = members.where("membership = 'included'").groupBy("group_id").agg(F.count("*").alias("included"), F.bool_or(F.coalesce("conflict", F.lit(False))).alias("blocked"))
    n = F.coalesce("included", F.lit(0))
    status = F.when((F.col("status") == "open") & (n == 0), "closed").otherwise(F.col("status"))
    return groups.join(g, "group_id", "left").select("group_id", status.alias("status"), n.alias("included"), F.coalesce("blocked", F.lit(False)).alias("blocked"),
                                                     ((status == "open") & (n > 0) & ~F.coalesce("blocked", F.lit(False))).alias("approvable"))


def publication_queue(candidates: DataFrame, versions: DataFrame) -> DataFrame:
    """(id, version_no): the latest version of each approved candidate, if it is a draft. candidates: id, review; versions: id, version_no, status."""
    last = versions.groupBy("id").agg(F.max(F.struct("version_no", "status")).alias("v"))
    return candidates.where("review = 'approved'").select("id").join(last, "id").where("v.status = 'draft'").select("id", "v.version_no")


def preferred_case(rows: DataFrame) -> DataFrame:
    """(case_id, candidate_id): the candidate of a case; one that stands for a group comes before the case's own (CASE-...), then the least id."""
    order = F.struct(F.col("candidate_id").startswith("CASE-"), F.col("id"))
    return rows.groupBy("case_id").agg(F.min_by("candidate_id", order).alias("candidate_id"))


def changed_fields(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old, new): an event for each field that a saved review changed."""
    b = before.select(F.col(key).alias("__k"), *[F.col(f).cast("string").alias(f"__{f}") for f in fields])
    j = after.join(b, F.col(key) == F.col("__k"))
    events = F.array(*[F.when(~F.equal_null(F.col(f).cast("string"), F.col(f"__{f}")), F.struct(F.lit(f).alias("field"), F.col(f"__{f}").alias("old"), F.col(f).cast("string").alias("new"))) for f in fields])
    return j.select(key, F.explode(F.filter(events, lambda x: x.isNotNull())).alias("e")).select(key, "e.field", "e.old", "e.new")


def appended_events(known: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """new with seq: events number on from the last known one of their key."""
    last = known.groupBy(key).agg(F.max("seq").alias("last"))
    return new.join(last, key, "left").withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(order)) + F.coalesce("last", F.lit(0))).drop("last")
