"""Roles, relations and question/answer pairs of conversation threads.

A thread is a group of rows (conv_id, idx, author, root_author, text); windows are per
thread, and every rule is one expression over its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns that decide results.
POSITIVE = r"(?iuU)(?:помогло|помог|заработал[оаи]?|работа(?:ет|ло|ет)|получилось|решено|всё работает|все работает|спасибо.*(?:работ|помог)|worked|works|fixed|solved)"
NEGATIVE = r"(?iuU)(?:не помог|не заработ|не работает|не получилось|не реш|ошибк|still|doesn't work|not working)"
QUESTION = r"(?iuU)^(?:как|где|что|сколько|какой|какая|какие|можно ли|почему|подскажите|уточните|how|where|what|which|can we|is there)\b"
INSTRUCTION = (r"(?iuU)(?:^|\s)(?:проверьте|проверь|укажите|отправьте|отправь|перейдите|перейди|нажмите|нажми|включите|включи|откройте|открой|установите|установи|"
               r"обновите|обнови|сбросьте|сбрось|замените|замени|check|please|send|open|go to|click|install|update|reset)\b")
HYPOTHESIS = r"(?iuU)(?:возможно|вероятно|скорее всего|похоже|может быть|если я правильно|probably|perhaps|might be|seems)"


def _same(a: Column, b: Column) -> Column:
    return F.lower(F.trim(F.coalesce(a, F.lit("")))) == F.lower(F.trim(F.coalesce(b, F.lit(""))))


def is_customer() -> Column:
    named = F.trim(F.coalesce("root_author", F.lit(""))) != ""
    return F.when(named, _same(F.col("author"), F.col("root_author"))).otherwise(F.col("idx") == 0)


def is_question(text: Column) -> Column:
    return text.contains("?") | text.contains("？") | F.trim(text).rlike(QUESTION)


def positive(text: Column) -> Column:
    return text.rlike(POSITIVE) & ~text.rlike(NEGATIVE)


def role(reply: Column | None = None) -> Column:
    """Customer turns by position and content, others by wording; a reply counts as an instruction."""
    text = F.trim("text")
    instructs = text.rlike(INSTRUCTION) if reply is None else text.rlike(INSTRUCTION) | reply.isNotNull()
    customer = F.when((F.col("idx") == 0) | is_question(text), "user_report").when(positive(text), "confirmed_resolution").otherwise("observed_result")
    other = F.when(text.rlike(HYPOTHESIS), "engineer_hypothesis").when(instructs, "engineer_instruction").when(text == "", "irrelevant").otherwise("unconfirmed_claim")
    return F.when(is_customer(), customer).otherwise(other)


def evidence_status(role_: Column, text: Column) -> Column:
    negative = text.rlike(NEGATIVE)
    return F.when((role_ == "confirmed_resolution") & ~negative, "confirmed_success").when(negative | (role_ == "confirm_failure"), "confirmed_failure") \
        .when(role_.isin("engineer_instruction", "engineer_hypothesis", "unconfirmed_claim", "observed_result"), "supports").otherwise("context_only")


def result_relations(messages: DataFrame) -> DataFrame:
    """(conv_id, source_idx, target_idx, relation_type, confidence): each reported result with
    the nearest engineer message before it."""
    thread = Window.partitionBy("conv_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    engineer = F.col("role").isin("engineer_instruction", "engineer_hypothesis", "unconfirmed_claim")
    rows = messages.withColumn("role", role()).withColumn("target", F.last(F.when(engineer, F.col("idx")), ignorenulls=True).over(thread))
    success = F.col("role") == "confirmed_resolution"
    return (rows.where(F.col("role").isin("confirmed_resolution", "observed_result") & F.col("target").isNotNull() & (success | F.col("text").rlike(NEGATIVE)))
            .select("conv_id", F.col("idx").alias("source_idx"), F.col("target").alias("target_idx"),
                    F.when(success, "confirm_success").otherwise("confirm_failure").alias("relation_type"), F.when(success, 0.92).otherwise(0.88).alias("confidence")))


def merged_relations(relations: DataFrame) -> DataFrame:
    """One row of each (source, target, type): the source of highest priority, manual over
    native over inferred; ties keep the first."""
    order = F.when(F.col("source") == "manual", 3).when(F.col("source") == "telegram", 2).otherwise(1)
    best = F.max_by(F.struct("source", "confidence"), F.struct(order, -F.col("seq")))
    return relations.groupBy("conv_id", "source_idx", "target_idx", "relation_type").agg(best.alias("b")).select(
        "conv_id", "source_idx", "target_idx", "relation_type", "b.source", "b.confidence")


def atomic_qa(messages: DataFrame) -> DataFrame:
    """Each customer question with the replies and feedback up to the next one."""
    thread = Window.partitionBy("conv_id").orderBy("idx")
    asks = is_customer() & ((F.col("idx") == 0) | is_question(F.trim("text")))
    rows = messages.withColumn("customer", is_customer()).withColumn("asks", asks).withColumn("position", F.sum(F.col("asks").cast("int")).over(thread)).where("position > 0")
    said = F.trim("text") != ""
    reply, feedback = ~F.col("customer") & said, F.col("customer") & ~F.col("asks") & said
    groups = rows.groupBy("conv_id", "position").agg(
        F.min_by("text", F.when(F.col("asks"), F.col("idx"))).alias("question"), F.count_if(reply).alias("n_replies"), F.count_if(feedback).alias("n_feedback"),
        F.array_sort(F.collect_list(F.when(reply, F.struct("idx", F.trim("text").alias("t"))))).alias("answers"),
        F.count_if(feedback & positive(F.col("text"))).alias("good"))
    status = F.when(F.col("good") > 0, "confirmed_resolution").when(F.col("n_feedback") > 0, "observed_result").when(F.col("n_replies") > 0, "engineer_answer").otherwise("unanswered")
    return groups.select("conv_id", "position", F.trim("question").alias("question"), "n_replies", "n_feedback",
                         F.array_join(F.transform("answers", lambda a: a["t"]), "\n").alias("answer_text"), status.alias("status"))


def thread_status(messages: DataFrame) -> DataFrame:
    rows = messages.withColumn("customer", is_customer())
    feedback = F.col("customer") & (F.col("idx") > 0)
    return rows.groupBy("conv_id").agg(
        F.when(F.count_if(feedback & positive(F.col("text"))) > 0, "confirmed_resolution").when(F.count_if(feedback) > 0, "observed_result")
        .when(F.count_if(~F.col("customer") & (F.trim("text") != "")) > 0, "engineer_answer").otherwise("unanswered").alias("status"))
