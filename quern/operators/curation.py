"""Curation of candidates: keys of prompts and texts, similarity with a fallback, limits, new units, splits, merges, detail bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import phrases, vectors as v
from quern.operators.retrieval import top
from quern.operators.workflow import first_error

#: Proposals in these states hold their text against a repeated one.
LIVE = ("pending_confirmation", "pending_clarification", "confirmed")


def prompt_hash(messages: Column) -> Column:
    """SHA-256 of messages, array<struct<content, role>>, as compact JSON with sorted keys; null fields are kept as null."""
    return F.sha2(F.to_json(messages, {"ignoreNullFields": "false"}), 256)


def content_key(text: Column, model: Column | None = None) -> Column:
    """SHA-256 of a text, after the name of the model if its vector is meant; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.sha2(text if model is None else F.concat(model, text), 256)


def similarity(left: Column, right: Column, left_tokens: Column, right_tokens: Column) -> Column:
    """The dot product of two stored unit vectors; without one of them the share of common tokens, 0 if a side has none."""
    both = (F.coalesce(F.size(left), F.lit(0)) > 0) & (F.coalesce(F.size(right), F.lit(0)) > 0)
    none = (F.size(left_tokens) <= 0) | (F.size(right_tokens) <= 0)
    return F.when(both, v.dot(left, right)).when(none, 0.0).otherwise(v.jaccard(left_tokens, right_tokens))


def over_limit(limits: dict[str, int]) -> Column:
    """The names of the columns that are longer than they may be, in the order given. For fields that are
    refused, not cut; fields that may be cut are cut with ``left``."""
    return F.filter(F.array(*[F.when(F.length(name) > most, name) for name, most in limits.items()]), lambda x: x.isNotNull())


def new_units(units: DataFrame, proposals: DataFrame) -> DataFrame:
    """units (version_id, position, title, content) that no live proposal of their version says already,
    the first of those that say the same. proposals: version_id, status, title, content."""
    mark = phrases.fingerprint(F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    known = proposals.where(F.col("status").isin(*LIVE)).select("version_id", mark.alias("fingerprint")).distinct()
    first = units.withColumn("fingerprint", mark).groupBy("version_id", "fingerprint").agg(F.min(F.struct("position", "title", "content")).alias("u"))
    return first.join(known, ["version_id", "fingerprint"], "left_anti").select("version_id", "u.position", "u.title", "u.content", "fingerprint")


def split(cases: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What becomes of requests (candidate_id, case_ids) to move cases to a candidate of their own, and the
    cases (candidate_id, case_id, case_position) afterwards.

    The first is (candidate_id, error, new_id, moved): nothing_selected, unknown_candidate, not_attached, nothing_left or
    ok. The new id is the candidate's with the least free suffix -S1, -S2, ... Moved cases are numbered from 0 by case_id, those
    that stay from 0 in their order. Of several requests of a candidate the least list counts; other candidates stay as they are."""
    wanted = F.array_sort(F.array_distinct(F.filter(F.coalesce("case_ids", F.expr("cast(array() as array<bigint>)")), lambda x: x.isNotNull())))
    asked = requests.groupBy("candidate_id").agg(F.min(wanted).alias("wanted"))
    held = cases.select("candidate_id", "case_id").distinct()
    total = held.groupBy("candidate_id").agg(F.count("*").alias("total"))
    hits = (asked.select("candidate_id", F.explode("wanted").alias("case_id")).join(held, ["candidate_id", "case_id"])
            .groupBy("candidate_id").agg(F.count("*").alias("hits")))
    parts = total.select(F.regexp_extract("candidate_id", r"^(.*)-S([1-9][0-9]*)$", 1).alias("base"),
                         F.regexp_extract("candidate_id", r"^(.*)-S([1-9][0-9]*)$", 2).try_cast("int").alias("suffix"))
    taken = parts.where("suffix is not null").groupBy(F.col("base").alias("candidate_id")).agg(F.collect_set("suffix").alias("taken"))
    rows = asked.join(total, "candidate_id", "left").join(hits, "candidate_id", "left").join(taken, "candidate_id", "left")
    used = F.coalesce("taken", F.expr("cast(array() as array<int>)"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size(used) + 1), used))
    error = first_error([("nothing_selected", F.size("wanted") == 0), ("unknown_candidate", F.col("total").isNull()),
                         ("not_attached", F.coalesce("hits", F.lit(0)) < F.size("wanted")), ("nothing_left", F.col("hits") == F.col("total"))])
    checked = rows.select("candidate_id", error.alias("error"), F.concat("candidate_id", F.lit("-S"), free).alias("new_id"), "wanted")
    checked = checked.withColumn("new_id", F.when(F.col("error") == "ok", F.col("new_id")))
    good = checked.where("error = 'ok'").select("candidate_id", "new_id", "wanted")
    stay = cases.join(good, "candidate_id", "left_anti").select("candidate_id", "case_id", "case_position")
    moves = F.array_contains("wanted", F.col("case_id"))
    touched = cases.join(good, "candidate_id").select(F.when(moves, F.col("new_id")).otherwise(F.col("candidate_id")).alias("candidate_id"), "case_id",
                                                      F.when(~moves, F.col("case_position")).alias("at"))
    number = F.row_number().over(Window.partitionBy("candidate_id").orderBy("at", "case_id")) - 1
    after = stay.unionByName(touched.select("candidate_id", "case_id", number.alias("case_position")))
    return checked.select("candidate_id", "error", "new_id", F.when(F.col("error") == "ok", F.size("wanted")).otherwise(0).alias("moved")), after


def merge(candidates: DataFrame, knowledge: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What becomes of requests (candidate_id, target_id) to join a candidate to published knowledge, and the
    candidates (candidate_id, status, duplicate_of) and knowledge (candidate_id, version_no, status, allowed) afterwards.

    The first is (candidate_id, target_id, version_no, error): no_target, unknown_candidate, into_itself, not_published, not_allowed or ok, the
    version being the target's last published one. Of several requests of a candidate the least target counts. A merged
    candidate is a duplicate of its target, and what it had published is archived and no longer allowed."""
    last = (knowledge.where("status = 'published'").groupBy(F.col("candidate_id").alias("target_id"))
            .agg(F.max(F.struct("version_no", "allowed")).alias("v")).withColumn("published", F.lit(True)))
    known = candidates.select("candidate_id", F.lit(True).alias("known")).distinct()
    asked = requests.groupBy("candidate_id").agg(F.min("target_id").alias("target_id"))
    rows = asked.join(known, "candidate_id", "left").join(last, "target_id", "left")
    error = first_error([("no_target", F.coalesce("target_id", F.lit("")) == ""), ("unknown_candidate", F.col("known").isNull()),
                         ("into_itself", F.col("target_id") == F.col("candidate_id")), ("not_published", F.col("published").isNull()),
                         ("not_allowed", ~F.coalesce("v.allowed", F.lit(False)))])
    checked = rows.select("candidate_id", "target_id", F.col("v.version_no").alias("version_no"), error.alias("error"))
    good = checked.where("error = 'ok'").select("candidate_id", F.col("target_id").alias("into"))
    gone = F.col("into").isNotNull()
    c = candidates.join(good, "candidate_id", "left").select("candidate_id", F.when(gone, "merged").otherwise(F.col("status")).alias("status"),
                                                             F.coalesce("into", "duplicate_of").alias("duplicate_of"))
    k = knowledge.join(good, "candidate_id", "left").select(
        "candidate_id", "version_no", F.when(gone & (F.col("status") == "published"), "archived").otherwise(F.col("status")).alias("status"),
        (F.col("allowed") & ~gone).alias("allowed"))
    return checked, c, k


def with_neighbours(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, block_no, text) with the text before and after each in its document."""
    w = Window.partitionBy("doc_id").orderBy("block_no")
    return blocks.select("doc_id", "block_no", "text", F.lag("text").over(w).alias("before"), F.lead("text").over(w).alias("after"))


def bundles(candidates: DataFrame, cases: DataFrame, messages: DataFrame, roles: DataFrame, relations: DataFrame, evidence: DataFrame, blocks: DataFrame,
            events: DataFrame, most_events: int = 100, role: str = "unconfirmed_claim") -> DataFrame:
    """Each candidate with all that a reviewer needs: candidate_id, cases, evidence, events.

    cases, in order of case_position: (case_position, case_id, messages (message_index, author, text, role), relations (source, target,
    relation)). A message without a role has ``role``. evidence, in order of evidence_id: (evidence_id, doc_id, block_no, text, before, after),
    the texts null where the block is gone. events: the last ``most_events``, newest first.
    Lists are empty where there is nothing.

    candidates: candidate_id. cases: candidate_id, case_id, case_position. messages: case_id, message_index, author, text. roles:
    candidate_id, case_id, message_index, role. relations: case_id, source, target, relation. evidence: candidate_id, evidence_id, doc_id,
    block_no. events: candidate_id, event_id, created_at, event_type."""
    ids = candidates.select("candidate_id").where("candidate_id is not null").distinct()
    cases = cases.join(ids, "candidate_id", "left_semi")
    said = (cases.select("candidate_id", "case_id").join(messages, "case_id").join(roles, ["candidate_id", "case_id", "message_index"], "left")
            .groupBy("candidate_id", "case_id").agg(F.array_sort(F.collect_list(F.struct(
                "message_index", "author", "text", F.coalesce("role", F.lit(role)).alias("role")))).alias("messages")))
    linked = relations.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("source", "target", "relation"))).alias("relations"))
    whole = cases.join(said, ["candidate_id", "case_id"], "left").join(linked, "case_id", "left")
    whole = whole.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct(
        "case_position", "case_id", F.coalesce("messages", F.array()).alias("messages"), F.coalesce("relations", F.array()).alias("relations")))).alias("cases"))
    cited = blocks.join(evidence.select("doc_id").distinct(), "doc_id", "left_semi")
    shown = (evidence.join(with_neighbours(cited), ["doc_id", "block_no"], "left").groupBy("candidate_id")
             .agg(F.array_sort(F.collect_list(F.struct("evidence_id", "doc_id", "block_no", "text", "before", "after"))).alias("evidence")))
    late = (top(events, ["candidate_id"], [F.desc("created_at"), F.desc("event_id")], most_events).groupBy("candidate_id")
            .agg(F.sort_array(F.collect_list(F.struct("created_at", "event_id", "event_type")), asc=False).alias("events")))
    out = ids.join(whole, "candidate_id", "left").join(shown, "candidate_id", "left").join(late, "candidate_id", "left")
    return out.select("candidate_id", *[F.coalesce(c, F.array()).alias(c) for c in ("cases", "evidence", "events")])
