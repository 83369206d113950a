"""Facts, batches and case memory: segmentation, stems, contracts, merging."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quern.session import dealt
from quern.functions import text as t

# Endings in the order in which they are tried, and words that make a fact unclear.
ENDINGS = ("иями", "ами", "ями", "ого", "ему", "ому", "ией", "иям", "иях", "ие", "ия", "ью", "ов", "ев", "ах", "ях", "ом", "ем", "ам", "ям",
           "ой", "ей", "ы", "и", "а", "я", "у", "ю", "е", "о", "ь")
UNCERTAIN = ("大概", "可能", "应该", "也许", "看情况", "probably", "maybe")
VAGUE_VERSION = ("新版", "旧版", "老版", "新版本", "旧版本", "以前")
VAGUE_DIFFERENCE = ("不一样", "有区别", "有差异", "不同")
CONFIDENCE = {"very high": 0.95, "high": 0.85, "medium": 0.6, "low": 0.3, "very low": 0.1}


def stem(token: Column) -> Column:
    """Lower case, ё as е, white space squeezed, without outer punctuation and without the first ending that leaves more than three letters."""
    folded = F.trim(F.regexp_replace(F.replace(F.lower(token), F.lit("ё"), F.lit("е")), r"(?U)\s+", " "))
    word = F.regexp_replace(folded, r"^[.,!?;:()\[\]{}\"'«»]+|[.,!?;:()\[\]{}\"'«»]+$", "")
    endings = F.expr("array(" + ", ".join(f"'{e}'" for e in ENDINGS) + ")")
    ending = F.try_element_at(F.filter(endings, lambda e: F.endswith(word, e) & (F.length(word) > F.length(e) + 3)), F.lit(1))
    return F.left(word, F.length(word) - F.coalesce(F.length(ending), F.lit(0)))


def segments(text: Column) -> Column:
    """Numbered items, else bullets, else paragraphs, else key-value lines, else sentences."""
    whole = F.trim(F.regexp_replace(text, r"\r\n?", "\n"))

    def cut(pattern):
        marked = F.regexp_replace(whole, pattern, "\x01")
        return F.filter(F.transform(F.split(marked, "\x01"), lambda x: F.trim(x, F.lit(" \n\t"))), lambda x: x != "")

    numbered, bullet = r"(?m)^\s*\d+[.)、]\s*", r"(?m)^\s*[-*•]\s+"
    several = lambda p: F.regexp_count(whole, F.lit(p)) >= 2
    paragraphs = cut(r"\n\s*\n")
    lines = F.filter(F.transform(F.split(whole, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    parts = cut(numbered)
    # A heading before the first number stays with the first item.
    headed = F.when(whole.rlike(r"^\s*\d+[.)、]"), parts).otherwise(
        F.concat(F.array(F.concat_ws("\n", parts[0], F.try_element_at(parts, F.lit(2)))), F.slice(parts, 3, 1_000_000)))
    return (F.when(whole == "", F.array().cast("array<string>")).when(several(numbered), headed).when(several(bullet), cut(bullet))
            .when(F.size(paragraphs) >= 2, paragraphs).when(F.regexp_count(whole, F.lit(r"(?m)^[^:\n]{1,40}[:：]\s*\S")) >= 3, lines)
            .otherwise(cut(r"(?<=[.!?。！？])\s+")))


@F.pandas_udf(ArrayType(IntegerType()))
def confirmed_numbers(text: pd.Series, total: pd.Series) -> pd.Series:
    """Numbers that a reply confirms: all, the first n, or listed ones; null if it confirms none."""

    def one(said, n):
        said = (said or "").strip().lower()
        if not said or not n or n <= 0:
            return None
        if any(w in said for w in ("全部", "所有", "all")):
            return list(range(1, int(n) + 1))
        first = re.search(r"确认\s*前\s*(\d+)", said)
        if first:
            return list(range(1, min(int(first[1]), int(n)) + 1))
        listed = re.search(r"(?:确认|正确|保留)\s*(?:第\s*)?([0-9、,，和及\s-]+)\s*(?:项|条)", said)
        found = sorted({int(x) for x in re.findall(r"\d+", listed[1])}) if listed else []
        return [x for x in found if 1 <= x <= n] or None

    return pd.Series([one(a, b) for a, b in zip(text, total)], dtype=object)


def clarity(text: Column) -> Column:
    """Why a fact cannot be stored as it is, or clear."""
    return (F.when(t.mentions(text, list(UNCERTAIN)), "uncertain").when(t.mentions(text, list(VAGUE_VERSION)), "vague_version")
            .when(t.mentions(text, list(VAGUE_DIFFERENCE)), "vague_difference").otherwise("clear"))


def model_confidence(value: Column) -> Column:
    """A number clamped to 0..1, or a word's; 0 for anything else. value: string."""
    words = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    number = F.trim(value).try_cast("double")
    return F.coalesce(F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))), words[F.lower(F.trim(value))], F.lit(0.0))


def decision(same_key: Column, same_text: Column, longer: Column, contradicts: Column) -> Column:
    """The comparison contract of a fact against what is known."""
    return F.when(~same_key, "NEW").when(contradicts, "CONFLICT").when(same_text, "CONFIRM").when(longer, "ENRICH").otherwise("UNCLEAR")


def proposal_status(decision_: Column) -> Column:
    return F.when(decision_ == "UNCLEAR", "pending_clarification").when(decision_ == "CONFLICT", "conflict").when(decision_ == "CONFIRM", "confirmed").otherwise("pending_confirmation")


def merged_neighbours(units: DataFrame, by: str, order: str, tokens: str) -> DataFrame:
    """(by, order, unit): a unit that shares two terms, and a quarter of the smaller side, with
    the one before it belongs to the same unit."""
    w = Window.partitionBy(by).orderBy(order)
    before = F.lag(tokens).over(w)
    shared = F.size(F.array_intersect(tokens, before))
    related = F.coalesce((shared >= 2) & (shared / F.least(F.size(tokens), F.size(before)) >= 0.25), F.lit(False))
    return units.withColumn("__new", (~related).cast("int")).withColumn("unit", F.sum("__new").over(w)).drop("__new")


def memory_status(quality: Column, verified: Column, context: Column) -> Column:
    return F.when(quality.isin("non_question", "low_value"), "rejected").when(verified, "verified").when(context, "needs_context").otherwise("ai_derived")


def guarded_refresh(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Imported values replace current ones only while the row is untouched by people."""
    n = new.select(F.col(key).alias("__k"), F.col("value").alias("__v"))
    untouched = (F.col("review") == "pending") & (F.col("state") == "draft")
    return current.join(n, F.col(key) == F.col("__k"), "left").select(
        key, "review", "state", F.when(untouched & F.col("__v").isNotNull(), F.col("__v")).otherwise(F.col("value")).alias("value"))


def scope_level(models: Column, conditions: Column, answered: Column, brand: Column) -> Column:
    return (F.when(~answered, "single_case").when((F.size(models) > 0) & (F.size(conditions) > 0), "model_condition").when(F.size(models) > 0, "model")
            .when(brand.isNotNull(), "brand").otherwise("generic"))


def filled(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """primary with the columns that secondary has too taken from there where they are null, empty text or an empty list."""
    shared = [c for c in secondary.columns if c != key and c in primary.columns]
    two = secondary.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in shared])

    def one(c: str) -> Column:
        kind = primary.schema[c].dataType.typeName()
        empty = F.col(c).isNull() | (F.trim(F.col(c)) == "" if kind == "string" else F.size(F.col(c)) == 0 if kind == "array" else F.lit(False))
        return F.when(empty, F.coalesce(F.col(f"__{c}"), F.col(c))).otherwise(F.col(c)).alias(c)

    j = primary.join(two, F.col(key) == F.col("__k"), "left")
    return j.select(*[one(c) if c in shared else F.col(c) for c in primary.columns])


def fallback_candidates(cases: DataFrame, covered: DataFrame) -> DataFrame:
    """(candidate_id, case_id): a candidate for each case that no row covers, CASE- and six digits or more."""
    text = F.col("case_id").cast("string")
    return cases.select("case_id").distinct().join(covered, "case_id", "left_anti").select(
        F.concat(F.lit("CASE-"), F.lpad(text, F.greatest(F.lit(6), F.length(text)), F.lit("0"))).alias("candidate_id"), "case_id")


def manual_relations(requests: DataFrame, messages: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with error, relations after them). A request (case_id, source, target, relation) needs a known
    relation and two different messages of its case; accepted ones take the place of known relations of their key,
    as manual and with confidence 1. messages: case_id, message_id; known: the key, origin, confidence."""
    key = ["case_id", "source", "target", "relation"]
    m = messages.select(F.col("case_id").alias("c"), F.col("message_id").alias("m")).distinct()
    j = requests
    for side in ("source", "target"):
        hit = m.withColumn(f"{side}_known", F.lit(True))
        j = j.join(hit, (F.col("case_id") == F.col("c")) & (F.col(side) == F.col("m")), "left").drop("c", "m")
    error = (F.when(~F.coalesce(F.col("relation").isin("answers", "confirm_success", "confirm_failure"), F.lit(False)), "unknown_relation")
             .when(F.coalesce(F.col("source") == F.col("target"), F.lit(True)), "same_message").when(F.col("source_known").isNull() | F.col("target_known").isNull(), "not_of_this_case").otherwise("ok"))
    checked = j.withColumn("error", error).drop("source_known", "target_known")
    new = checked.where("error = 'ok'").select(*key).distinct()
    return checked, known.join(new, key, "left_anti").unionByName(new.select(*key, F.lit("manual").alias("origin"), F.lit(1.0).alias("confidence")))


def compacted(analyses: DataFrame, most: int = 8, chars: int = 700) -> DataFrame:
    """(case_id, question, claims, roles): an analysis cut to the size of a prompt: the first claims, each cut, and how many
    messages have each role. analyses: case_id, question, claims array<string>, roles array<string>."""
    roles = F.filter("roles", lambda x: x != "")
    counts = F.transform(F.array_sort(F.array_distinct(roles)), lambda r: F.concat_ws("=", r, F.size(F.filter(roles, lambda x: x == r)).cast("string")))
    return analyses.select("case_id", F.left("question", F.lit(chars)).alias("question"), F.transform(F.slice("claims", 1, most), lambda x: F.left(x, F.lit(chars))).alias("claims"), counts.alias("roles"))


def corrected_sources(sources: DataFrame, corrections: DataFrame) -> DataFrame:
    """sources (knowledge_id, evidence_id, relation, active, resolution) with those that a correction names (knowledge_id, evidence_id) rejected."""
    hit = corrections.select("knowledge_id", "evidence_id").distinct().withColumn("hit", F.lit(True))
    gone = F.coalesce("hit", F.lit(False)) & F.col("active")
    return sources.join(hit, ["knowledge_id", "evidence_id"], "left").withColumn("resolution", F.when(gone, "rejected").otherwise(F.col("resolution"))) \
        .withColumn("active", F.col("active") & ~gone).drop("hit")


def retired(knowledge: DataFrame, sources: DataFrame, corrections: DataFrame) -> DataFrame:
    """knowledge (id, trust, active) where corrected, provisional rows without any active support left are inactive."""
    after = corrected_sources(sources, corrections)
    support = after.where("active and relation = 'supports'").select(F.col("knowledge_id").alias("id")).distinct().withColumn("held", F.lit(True))
    named = corrections.select(F.col("knowledge_id").alias("id")).distinct().withColumn("corrected", F.lit(True))
    j = knowledge.join(named, "id", "left").join(support, "id", "left")
    gone = F.coalesce("corrected", F.lit(False)) & F.col("active") & (F.col("trust") == "provisional") & F.col("held").isNull()
    return j.withColumn("active", F.col("active") & ~gone).drop("corrected", "held")


def session_summary(sessions: DataFrame, proposals: DataFrame, batches: DataFrame) -> DataFrame:
    """(thread_id, learned, corrected, unresolved, total, processed, failed) since each session (thread_id, started_at) began:
    confirmed facts once each by their squeezed text, in order of their first proposal. proposals: thread_id, proposal_id, status,
    content, at; batches: thread_id, total, processed, failed, at."""
    own = sessions.select("thread_id", "started_at")
    p = dealt(proposals, proposals.count(), "thread_id").join(own, "thread_id").where("at >= started_at")
    facts = p.where("status = 'confirmed'").groupBy("thread_id", t.squeezed(F.col("content")).alias("k")).agg(F.min(F.struct("proposal_id", "content")).alias("f"))
    learned = facts.groupBy("thread_id").agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["content"]).alias("learned"))
    outcomes = p.groupBy("thread_id").agg(F.count_if(F.col("status") == "corrected").alias("corrected"), F.count_if(F.col("status").isin("unknown", "skipped")).alias("unresolved"))
    covered = dealt(batches, batches.count(), "thread_id").join(own, "thread_id").where("at >= started_at").groupBy("thread_id").agg(*[F.sum(c).alias(c) for c in ("total", "processed", "failed")])
    j = own.join(learned, "thread_id", "left").join(outcomes, "thread_id", "left").join(covered, "thread_id", "left")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("corrected", "unresolved", "total", "processed", "failed")]
    return j.select("thread_id", F.coalesce("learned", F.array().cast("array<string>")).alias("learned"), *numbers)
