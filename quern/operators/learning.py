"""Document learning and batches: contexts and jobs, outcomes, confirmation, guarded records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.phrases import unseen
from quern.functions.text import squeezed
from quern.operators.documents import packed_contexts
from quern.operators.workflow import first_error

# Vocabularies and limits.
TRUST = ("official_source", "user_confirmed", "provisional", "conflicted")
DECISIONS = ("NEW", "CONFIRM", "ENRICH", "CONFLICT", "UNCLEAR")
OPENING = ("pending_confirmation", "pending_clarification")
MOST_ATTEMPTS = 5
TERMINAL = ("DocumentError", "DocumentLearnError")
KINDS = ("fact", "procedure", "rule", "experience")


def learn_contexts(blocks: DataFrame, budget: int = 8000, states: tuple[str, ...] = ("pending",)) -> DataFrame:
    """(version_id, context_key, block_ids, n_chars): blocks that wait for learning, by section, in
    order, in parts of at most ``budget`` characters; a longer block is a part of its own.
    blocks: version_id, block_id, ord, section, state, text."""
    ready = blocks.where(F.col("state").isin(*states)).withColumn("g", F.struct("version_id", "section")).withColumn("n", F.length("text"))
    parts = packed_contexts(ready, "g", "ord", "n", budget)
    both = ready.join(parts, ["g", "ord"]).groupBy("version_id", "section", "part").agg(
        F.array_sort(F.collect_list(F.struct("ord", "block_id"))).alias("b"), F.sum("n").alias("n_chars"))
    key = F.concat_ws("#", "section", "part")
    return both.select("version_id", key.alias("context_key"), F.transform("b", lambda x: x["block_id"]).alias("block_ids"), "n_chars")


def queued_jobs(blocks: DataFrame, jobs: DataFrame, budget: int = 8000, reset: bool = False) -> DataFrame:
    """The jobs to add (version_id, context_key, block_ids, n_chars, idempotency_key): one for each
    context, none whose key is taken. With ``reset`` shelved (evidence_only) blocks wait again and
    finished learn jobs no longer hold their keys; queued and running ones do.

    jobs: idempotency_key, stage, status."""
    contexts = learn_contexts(blocks, budget, ("pending", "evidence_only") if reset else ("pending",))
    key = F.left(F.concat(F.lit("learn:"), F.col("version_id").cast("string"), F.lit(":"), squeezed(F.col("context_key"))), F.lit(200))
    taken = jobs.where("not (stage = 'learn' and status in ('completed', 'failed'))") if reset else jobs
    return contexts.withColumn("idempotency_key", key).join(taken.select("idempotency_key"), "idempotency_key", "left_anti")


def job_blocks(jobs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(job_id, block_id, ord, text): the blocks that a job names and its version still has; a null text is empty."""
    named = jobs.select("job_id", "version_id", F.explode("block_ids").alias("block_id")).distinct()
    return named.join(blocks, ["version_id", "block_id"]).select("job_id", "block_id", "ord", F.coalesce("text", F.lit("")).alias("text"))


def job_outcomes(jobs: DataFrame) -> DataFrame:
    """jobs (stage, attempts, error, message) with their next status and what becomes of the
    version: an error ends the job if it is one of the documents' own or no attempt is left, else the
    job is queued again after attempts * 60 s. ``error`` null means success."""
    failed = F.col("error").isNotNull()
    terminal = F.col("error").isin(*TERMINAL) | (F.col("attempts") + 1 >= MOST_ATTEMPTS)
    status = F.when(~failed, "completed").when(terminal, "failed").otherwise("queued")
    version = F.when(failed & terminal, F.when(F.col("stage") == "parse", "failed").when(F.col("stage") == "learn", "learning_failed"))
    return jobs.select("*", status.alias("next_status"), F.when(failed & ~terminal, (F.col("attempts") + 1) * 60).alias("delay"),
                       version.alias("version_status"), F.left("message", F.lit(2000)).alias("said"))


def shelved(blocks: DataFrame, contexts: DataFrame, cited: DataFrame) -> DataFrame:
    """blocks with their state after a learn step: pending ones with text that a context held and
    no unit cites become evidence_only, with the reason. contexts: block_id; cited: block_id."""
    unused = contexts.select("block_id").distinct().join(cited, "block_id", "left_anti").withColumn("unused", F.lit(True))
    moves = F.coalesce("unused", F.lit(False)) & (F.col("state") == "pending") & (F.trim("text") != "")
    return blocks.join(unused, "block_id", "left").withColumn("reason", F.when(moves, "no unit extracted; kept as evidence")) \
        .withColumn("state", F.when(moves, "evidence_only").otherwise(F.col("state"))).drop("unused")


def completed_versions(versions: DataFrame, jobs: DataFrame, blocks: DataFrame) -> DataFrame:
    """versions (version_id, status) with learning ones complete once no learn job is open and no block is pending."""
    waiting = (jobs.where("stage = 'learn' and status in ('queued', 'processing')").select("version_id")
               .unionByName(blocks.where("state = 'pending'").select("version_id")).distinct().withColumn("waits", F.lit(True)))
    done = (F.col("status") == "learning") & F.col("waits").isNull()
    return versions.join(waiting, "version_id", "left").withColumn("status", F.when(done, "complete").otherwise(F.col("status"))).drop("waits")


def confirmations(proposals: DataFrame) -> DataFrame:
    """proposals with outcome, title, content and source_kind of their confirmation.

    proposals: proposal_id, status, version_id, authenticity, unit_title, fact_text, edited (new
    content or null), sources array<struct<block_id, excerpt>>. A second confirmation finds
    the first (already); others need a pending document proposal that keeps a source."""
    outcome = first_error([
        ("not_a_document_proposal", F.col("version_id").isNull()), ("already", F.col("status") == "confirmed"),
        ("not_pending", F.col("status") != "pending_confirmation"), ("empty_content", F.trim("edited") == ""),
        ("no_source", F.coalesce(F.size("sources"), F.lit(0)) < 1)])
    line = F.trim(F.split_part(F.trim("fact_text"), F.lit("\n"), F.lit(1)))
    title = F.coalesce(F.nullif(F.left(F.trim("unit_title"), F.lit(200)), F.lit("")), F.nullif(F.left(line, F.lit(200)), F.lit("")), F.lit("Document unit"))
    kind = F.when(F.col("authenticity").isin("official_vendor", "confirmed_copy"), "official_document").otherwise("other")
    return proposals.select("*", outcome.alias("outcome"), title.alias("title"), F.coalesce(F.trim("edited"), F.trim("fact_text")).alias("content"),
                            kind.alias("source_kind"))


def confirmed_links(confirmed: DataFrame) -> DataFrame:
    """(proposal_id, block_id, source_kind, excerpt): the sources of what ``confirmations`` accepts, each block once."""
    rows = confirmed.where("outcome = 'ok'").select("proposal_id", "source_kind", F.posexplode("sources").alias("at", "s"))
    return rows.groupBy("proposal_id", F.col("s.block_id").alias("block_id")).agg(
        F.first("source_kind").alias("source_kind"), F.min_by("s.excerpt", "at").alias("excerpt"))


def known_blocks(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """blocks whose state is knowledge once a confirmed unit cites them, if they were proposed or pending."""
    cited = links.select("block_id").distinct().withColumn("cited", F.lit(True))
    moves = F.coalesce("cited", F.lit(False)) & F.col("state").isin("proposal", "pending")
    return blocks.join(cited, "block_id", "left").withColumn("state", F.when(moves, "knowledge").otherwise(F.col("state"))).drop("cited")


def created_knowledge(facts: DataFrame) -> DataFrame:
    """facts (trust) with error for an unknown trust and active, which conflicted knowledge is not."""
    return facts.withColumn("error", first_error([("unknown_trust", ~F.coalesce(F.col("trust").isin(*TRUST), F.lit(False)))])) \
        .withColumn("active", F.col("trust") != "conflicted")


def linked_sources(known: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new to add: the first of each (knowledge_id, evidence_id, relation) that is not
    known, its excerpt cut to 4000 characters. new: these, seq, excerpt."""
    key = ["knowledge_id", "evidence_id", "relation"]
    first = new.groupBy(*key).agg(F.min_by("excerpt", "seq").alias("excerpt"), F.min("seq").alias("seq"))
    return first.join(known.select(*key), key, "left_anti").withColumn("excerpt", F.left("excerpt", F.lit(4000)))


def opened_proposals(facts: DataFrame) -> DataFrame:
    """facts (decision, status) with error for words outside the vocabularies, and the trust proposed."""
    error = first_error([("unknown_decision", ~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False))),
                         ("invalid_status", ~F.coalesce(F.col("status").isin(*OPENING), F.lit(False)))])
    return facts.withColumn("error", error).withColumn("proposed_trust", F.when(F.col("decision") == "CONFLICT", "conflicted").otherwise("provisional"))


def fact_list(decision: Column, clarity: Column) -> Column:
    """The list of a bulk turn that a fact goes to."""
    return F.when(decision == "CONFLICT", "conflict").when((decision == "UNCLEAR") | (clarity != "clear"), "unclear").otherwise("clear")


def bulk_lists(facts: DataFrame) -> DataFrame:
    """(batch_id, clear, unclear, conflict): the segment numbers of a batch's facts by list, each once, in
    order. facts: batch_id, segment_no, decision, clarity."""
    f = facts.withColumn("list", fact_list(F.col("decision"), F.col("clarity")))
    return f.groupBy("batch_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("list") == n, F.col("segment_no")))).alias(n) for n in ("clear", "unclear", "conflict")])


def _together() -> Column:
    """May a proposal be confirmed with its batch?"""
    return ~F.col("paused") & (F.col("status") == "pending_confirmation") & ~F.col("derived") & ~F.col("individual")


def batch_counts(proposals: DataFrame) -> DataFrame:
    """(batch_id, clear, unclear): what a batch can confirm together, and what needs a turn of its own.
    proposals: batch_id, status, paused, derived, individual."""
    alone = ~F.col("paused") & ((F.col("status") == "pending_clarification") | ((F.col("status") == "pending_confirmation") & (F.col("derived") | F.col("individual"))))
    return proposals.groupBy("batch_id").agg(F.count_if(_together()).alias("clear"), F.count_if(alone).alias("unclear"))


def batch_confirmed(proposals: DataFrame, selected: DataFrame) -> DataFrame:
    """proposals with their status after a batch is confirmed: all that can be confirmed together, or
    only the selected segments. selected: batch_id, numbers array<int> (null: all); other batches stay."""
    chosen = selected.select(F.col("batch_id").alias("__b"), "numbers")
    hit = F.col("__b").isNotNull() & _together() & (F.col("numbers").isNull() | F.coalesce(F.array_contains("numbers", F.col("segment_no")), F.lit(False)))
    return proposals.join(chosen, F.col("batch_id") == F.col("__b"), "left").withColumn("status", F.when(hit, "confirmed").otherwise(F.col("status"))).drop("__b", "numbers")


def latest_of_stage(jobs: DataFrame) -> DataFrame:
    """The job of the largest id for each version and stage."""
    w = Window.partitionBy("version_id", "stage").orderBy(F.desc("job_id"))
    return jobs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def unit_errors(units: DataFrame, blocks: DataFrame, headings: DataFrame) -> DataFrame:
    """units with error: the first rule that a unit breaks, or ok. Sources must be blocks of the unit's version with verbatim
    excerpts; identifiers and longer numbers must occur in the version's title or blocks.

    units: unit_id, version_id, title, kind, content, steps array, trigger, result, sources array<struct<block_id, excerpt>>.
    blocks: version_id, block_id, text; headings: version_id, heading (title and key)."""
    said = units.select("unit_id", "version_id", F.explode("sources").alias("s")).select("unit_id", "version_id", F.col("s.block_id").alias("block_id"), F.col("s.excerpt").alias("excerpt"))
    held = said.join(blocks.select("version_id", "block_id", "text"), ["version_id", "block_id"], "left")
    quoted = F.contains(squeezed(F.col("text")), squeezed(F.trim("excerpt")))
    checks = held.groupBy("unit_id").agg(
        F.bool_or(F.col("text").isNull()).alias("strange"), F.bool_or(F.trim("excerpt") == "").alias("no_excerpt"), F.bool_or(~F.coalesce(quoted, F.lit(True))).alias("not_verbatim"))
    # Only the identifiers and numbers of a version's texts are gathered, each once, not the texts.
    tokens = blocks.select("version_id", "text").unionByName(headings.select("version_id", F.col("heading").alias("text"))).select(
        "version_id", F.explode(unseen(F.coalesce("text", F.lit("")), F.lit(""))).alias("token")).distinct().groupBy("version_id").agg(F.collect_list("token").alias("known"))
    j = units.join(checks, "unit_id", "left").join(tokens, "version_id", "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    new = F.array_except(unseen(F.concat_ws("\n", "title", "content"), F.lit("")), F.coalesce("known", F.array().cast("array<string>")))
    steps = F.size(F.filter(F.coalesce("steps", F.array().cast("array<string>")), lambda x: F.trim(x) != ""))
    error = first_error([
        ("no_title", blank("title")), ("unknown_kind", ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))), ("no_content", blank("content")),
        ("no_steps", (F.col("kind") == "procedure") & (steps == 0)), ("incomplete_rule", (F.col("kind") == "rule") & (blank("trigger") | blank("result"))),
        ("no_source", F.coalesce(F.size("sources"), F.lit(0)) < 1), ("block_of_another_version", F.col("strange")), ("empty_excerpt", F.col("no_excerpt")),
        ("not_verbatim", F.col("not_verbatim")), ("unseen_identifier", F.size(new) > 0)])
    return j.withColumn("error", error).select(*units.columns, "error")
