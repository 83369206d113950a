"""Decisions over retrieval results, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = {"technical": "retry", "wrong_scope": "fix_scope", "missing_knowledge": "add_knowledge", "retrieval_miss": "tune_retrieval",
           "clarify": "ask_user", "none": "none"}


def triage(n_candidates: Column, n_excluded_version: Column, n_excluded_model: Column, n_eligible: Column, models: Column) -> Column:
    """Why a question has no candidates, and what to ask; answerable otherwise."""
    return (F.when(n_candidates > 0, "answerable").when(n_excluded_version > 0, "missing_version").when(n_excluded_model > 0, "model_not_covered")
            .when(n_eligible == 0, "no_eligible_evidence").when(F.size(models) == 0, "missing_model").otherwise("model_not_covered"))


def fallback(asks_source: Column, high_risk: Column, n_candidates: Column) -> Column:
    return F.when(asks_source, "explicit_check").when(high_risk & (n_candidates > 0), "high_risk_verify").when(n_candidates == 0, "no_knowledge")


def failure_category(feedback: Column, status: Column, n_candidates: Column) -> Column:
    """A feedback label outranks what the run itself shows."""
    return (F.when(feedback == "wrong_scope", "wrong_scope").when(feedback == "missing", "missing_knowledge").when(status == "failed", "technical")
            .when(status == "needs_clarification", "clarify").when((status == "no_knowledge") & (n_candidates > 0), "retrieval_miss")
            .when(status == "no_knowledge", "missing_knowledge").otherwise("none"))


def action(category: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[category]


def valid_citations(cited: Column, n_evidence: Column) -> Column:
    """Cited indexes in range, in order, once each."""
    return F.array_sort(F.array_distinct(F.filter(cited, lambda i: (i >= 1) & (i <= n_evidence))))


def ceiling(kind: Column, scope: Column, confidence: Column) -> Column:
    """Confidence limited by the source and the scope of the evidence."""
    top = F.when(kind == "case", 0.5).otherwise(0.95)
    return F.when(scope == "conflict", 0.0).otherwise(F.least(confidence, top, F.when(scope == "family", 0.8).when(scope == "unspecified", 0.7).otherwise(1.0)))


def critical_flags(status: Column, n_citations: Column, text: Column) -> Column:
    """Names of what a finished answer gets wrong."""
    return F.filter(F.array(F.when((status == "answered") & (n_citations == 0), "answer_without_citation"), F.when((status == "failed") & (text != ""), "text_after_failure"),
                            F.when(F.length(text) > 4000, "too_long")), lambda x: x.isNotNull())


def evidence_payload(hits: DataFrame) -> DataFrame:
    """hits (qid, rank, id, title, content, entity_name, sources array<struct<source_kind, excerpt,
    source_label, source_locator>>) as they go to generation: an index from 0 in order of rank and
    each field at its length."""
    from pyspark.sql import Window

    index = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "id")) - 1
    cut = lambda c, n: F.left(F.trim(F.coalesce(c, F.lit(""))), F.lit(n))
    sources = F.transform(F.coalesce("sources", F.array().cast(hits.schema["sources"].dataType)), lambda x: F.struct(
        F.coalesce(x["source_kind"], F.lit("")).alias("source_kind"), cut(x["excerpt"], 1000).alias("excerpt"),
        cut(x["source_label"], 300).alias("source_label"), cut(x["source_locator"], 500).alias("source_locator")))
    return hits.select("qid", index.alias("index"), F.col("id").alias("knowledge_id"), cut(F.col("title"), 500).alias("title"), cut(F.col("content"), 2000).alias("content"),
                       cut(F.col("entity_name"), 200).alias("entity"), sources.alias("sources"))


def evidence_snapshot(payload: DataFrame, cited: DataFrame) -> DataFrame:
    """(qid, place, evidence_index, knowledge_id, title, content): copies of what was cited, in order of
    citation; indexes out of range are left out. cited: qid, indexes array<int>."""
    wanted = cited.select("qid", F.posexplode("indexes").alias("place", "index"))
    return wanted.join(payload, ["qid", "index"]).select("qid", "place", F.col("index").alias("evidence_index"), "knowledge_id", "title", "content")


def joined_snapshots(first: DataFrame, checked: DataFrame) -> DataFrame:
    """The snapshot of an answer with that of the originals which verified it behind it; indexes go on.
    Both: qid, evidence_index, title."""
    size = first.groupBy("qid").agg(F.count("*").alias("base"))
    moved = checked.join(size, "qid", "left").select("qid", (F.col("evidence_index") + F.coalesce("base", F.lit(0))).alias("evidence_index"), "title")
    return first.select("qid", F.col("evidence_index").cast("long").alias("evidence_index"), "title").unionByName(moved)


def after_originals(answer_status: Column, n_evidence: Column, too_large: Column, llm_failed: Column, decision: Column, conflict: Column, reason: Column) -> Column:
    """struct<answer_status, reason_code> after originals were read. An answer is verified or contradicted
    by them, never lowered by an empty or failed reading; reason_code is null where nothing changes."""
    out = lambda status, code: F.struct(F.lit(status).alias("answer_status") if isinstance(status, str) else status.alias("answer_status"),
                                        (code if isinstance(code, Column) else F.lit(code).cast("string")).alias("reason_code"))
    answered = F.coalesce(answer_status == "answered", F.lit(False))
    same = out(answer_status, None)
    return (F.when(n_evidence == 0, same).when(too_large, out("needs_clarification", "document_section_too_large")).when(llm_failed, same)
            .when(decision == "answered", out("answered", F.when(answered, "document_verified_answer").otherwise("grounded_document_fallback")))
            .when(conflict, out("unsupported", "knowledge_document_conflict")).when(answered, same)
            .otherwise(out("unsupported", F.coalesce(F.nullif(reason, F.lit("")), F.lit("document_insufficient")))))


def failure_reason(error: Column, status_code: Column, message: Column) -> Column:
    """The reason code of a failed model call, from its error's name, status and message."""
    return (F.when(F.contains(F.lower(error), F.lit("timeout")), "llm_timeout").when(status_code == 429, "llm_rate_limited")
            .when((error == "ValueError") & F.contains(message, F.lit("JSON")), "llm_bad_response").otherwise("llm_error"))


def retrieval_trace(questions: DataFrame, eligible: DataFrame, hits: DataFrame, excluded: DataFrame) -> DataFrame:
    """(qid, models, versions, n_eligible, candidate_ids, excluded): what a retrieval saw. questions: qid, models,
    versions; eligible: id; hits: qid, id, rank; excluded: qid, id, reason."""
    n = eligible.agg(F.count("*")).scalar()
    found = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("candidate_ids"))
    out = excluded.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "reason"))), lambda x: F.concat_ws(":", x["id"].cast("string"), x["reason"])).alias("excluded"))
    none = F.array()
    return (questions.withColumn("n_eligible", n).join(found, "qid", "left").join(out, "qid", "left")
            .select("qid", "models", "versions", "n_eligible", F.coalesce("candidate_ids", none.cast("array<long>")).alias("candidate_ids"),
                    F.coalesce("excluded", none.cast("array<string>")).alias("excluded")))


def ask_for_model(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, scopes): questions that name no model while their hits state two or more different scopes.
    hits: qid, scope (null or empty: not restricted); questions: qid, models array."""
    g = hits.where("scope <> ''").groupBy("qid").agg(F.array_sort(F.collect_set(F.upper("scope"))).alias("scopes")).where(F.size("scopes") >= 2)
    return g.join(questions.where(F.size("models") == 0), "qid", "left_semi")


# The statuses of answers and the categories of golden cases with their quotas.
STATUSES = ("answered", "needs_clarification", "unsupported", "service_error")
QUOTA = {"answerable": 15, "clarify": 5, "unsupported": 5, "boundary": 5}


def customer_text(status: Column, answer: Column, question: Column, unsupported: Column, failure: str, unknown: str, service_error: str) -> Column:
    """The one text that a customer sees for each status, with a standing text where the run has none."""
    or_ = lambda *c: F.trim(F.coalesce(*[F.nullif(x, F.lit("")) if isinstance(x, Column) else F.lit(x) for x in c]))
    return (F.when(status == "answered", or_(answer, service_error)).when(status == "needs_clarification", or_(question, unknown))
            .when(status == "unsupported", or_(unsupported, answer, failure)).otherwise(F.lit(service_error)))


def unsupported_status(route: Column) -> Column:
    """Without support an unknown route asks back; any other says that there is none."""
    return F.when(route == "unknown", "needs_clarification").otherwise("unsupported")


def qualified(answer: Column, asked: Column, found: Column) -> Column:
    """An answer that holds for one model says so if the question named none. asked, found: arrays of models."""
    model = F.try_element_at(found, F.lit(1))
    said = F.concat(F.lit("Если речь о "), model, F.lit(", порядок такой: "), F.rtrim(answer), F.lit(" Если у вас другая модель, укажите её — порядок может отличаться."))
    return F.when((F.size(asked) == 0) & (F.size(found) > 0), said).otherwise(answer)


def golden_errors(samples: DataFrame, required: list[str]) -> DataFrame:
    """(sample_key, error) for each rule that a golden sample (sample_key, question, expected_answer_status, ...) breaks."""
    from pyspark.sql import Window

    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    again = F.count("*").over(Window.partitionBy("sample_key")) > 1
    rules = [F.when(F.col(c).isNull(), F.concat(F.lit("missing "), F.lit(c))) for c in required]
    rules += [F.when(blank("sample_key"), "empty_key"), F.when(~blank("sample_key") & F.col("__again"), "repeated_key"),
              F.when(~F.coalesce(F.col("expected_answer_status").isin(*STATUSES), F.lit(False)), "unexpected_status")]
    return samples.withColumn("__again", again).select("sample_key", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("error"))


def sidecar_errors(cases: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_key, error) of cases (sample_key, category, expected_answer_status) against their samples."""
    from pyspark.sql import Window

    known = samples.select(F.col("sample_key").alias("k"), F.col("expected_answer_status").alias("golden")).distinct()
    j = cases.withColumn("again", F.count("*").over(Window.partitionBy("sample_key")) > 1).join(known, F.col("sample_key") == F.col("k"), "left")
    status, there = F.col("expected_answer_status"), F.col("k").isNotNull()
    label = F.create_map(*[F.lit(x) for kv in {"answerable": "answered", "clarify": "needs_clarification", "unsupported": "unsupported"}.items() for x in kv])[F.col("category")]
    rules = [F.when(~there, "unknown_sample"), F.when(there & F.col("again"), "repeated_key"), F.when(there & ~F.coalesce(F.col("category").isin(*QUOTA), F.lit(False)), "unknown_category"),
             F.when(there & ~F.coalesce(status.isin(*STATUSES), F.lit(False)), "unexpected_status").when(there & (status != F.col("golden")), "disagrees"),
             F.when(there & label.isNotNull() & ~F.equal_null(label, status), "category_and_status")]
    return j.select("sample_key", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("error"))


def quota_errors(cases: DataFrame, quota: dict[str, int] | None = None) -> DataFrame:
    """(category, n, least) of categories with fewer cases than their quota, those without any included."""
    spark = cases.sparkSession
    least = spark.createDataFrame(list((quota or QUOTA).items()), "category string, least int")
    n = cases.groupBy("category").agg(F.count("*").alias("n"))
    return least.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), "least").where("n < least")


def source_selection(refuse: Column, clarify: Column, expected_keys: Column, expected_id: Column, ids: Column, keys: Column, scopes: Column) -> Column:
    """Did an answer choose the right evidence? Refusals choose nothing but conflicts, clarifications nothing,
    others the expected keys, or the expected row, or anything."""
    none = F.size(ids) == 0
    return (F.when(refuse, none | F.forall(scopes, lambda x: x == "conflict")).when(clarify, none)
            .when(F.size(expected_keys) > 0, F.size(F.array_except(expected_keys, keys)) == 0)
            .when(expected_id.isNotNull(), F.coalesce(F.array_contains(ids, expected_id), F.lit(False))).otherwise(F.lit(True)))


def golden_pass(expected: Column, actual: Column, selected: Column, supported: Column) -> Column:
    """Status and selection agree; an expected answer must also be supported."""
    return (actual == expected) & selected & (supported | (expected != "answered"))


def scored(results: DataFrame) -> DataFrame:
    """results (refuse, clarify, expected_status, expected_keys, expected_id, actual_status, ids, keys, scopes, supported) with
    selection_pass, status_pass, golden_pass and applicability_pass."""
    c = {n: F.col(n) for n in results.columns}
    chosen = source_selection(c["refuse"], c["clarify"], c["expected_keys"], c["expected_id"], c["ids"], c["keys"], c["scopes"])
    r = results.withColumn("selection_pass", chosen).withColumn("status_pass", c["actual_status"] == c["expected_status"])
    return r.withColumn("golden_pass", golden_pass(c["expected_status"], c["actual_status"], F.col("selection_pass"), c["supported"])) \
        .withColumn("applicability_pass", (c["actual_status"] == "answered") & F.col("selection_pass") & F.forall("scopes", lambda x: x != "conflict"))


def latest_results(results: DataFrame) -> DataFrame:
    """One row for each (run_id, model_name, sample_key): the last written (seq), as an upsert leaves it."""
    key = ["run_id", "model_name", "sample_key"]
    others = [x for x in results.columns if x not in (*key, "seq")]
    return results.groupBy(*key).agg(F.max(F.struct("seq", *others)).alias("m")).select(*key, "m.*")


def recent_failures(runs: DataFrame, feedback: DataFrame, now: Column, days: int = 7, limit: int = 50) -> DataFrame:
    """The latest runs that failed and were not judged good, within ``days`` (1 to 90), at most ``limit`` (1 to 200), with their latest
    open feedback, category and default action. runs: run_id, status, answer_status, verdict, at, n_candidates; feedback:
    feedback_id, run_id, kind, status."""
    days, limit = max(1, min(days, 90)), max(1, min(limit, 200))
    bad = (F.col("answer_status").isin("unsupported", "service_error") | (F.col("status") == "failed")) & F.coalesce(F.col("verdict") == "fail", F.lit(True))
    latest = runs.where(bad).where(F.col("at") >= now - F.make_interval(days=F.lit(days))).orderBy(F.desc("run_id")).limit(limit)
    open_ = feedback.where("status = 'open'").groupBy("run_id").agg(F.max(F.struct("feedback_id", "kind")).alias("f"))
    j = latest.join(open_, "run_id", "left")
    category = failure_category(F.col("f.kind"), F.col("status"), F.col("n_candidates"))
    return j.select("run_id", "status", "answer_status", F.col("f.feedback_id").alias("feedback_id"), category.alias("category"), action(category).alias("action"))


def retests(feedback: DataFrame, runs: DataFrame) -> DataFrame:
    """The runs to start again (question, context, retest_of, feedback_id) for feedback (feedback_id, run_id, correction): the old
    question in its old context; the correction is no part of them. Feedback on unknown runs has none. runs: run_id, question, context map."""
    j = feedback.select("feedback_id", "run_id").join(runs.select("run_id", "question", "context"), "run_id")
    link = F.create_map(F.lit("retest_of"), F.col("run_id").cast("string"), F.lit("feedback_id"), F.col("feedback_id").cast("string"))
    kept = F.map_filter(F.coalesce("context", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("retest_of", "feedback_id"))
    return j.select("question", F.map_concat(kept, link).alias("context"), F.col("run_id").alias("retest_of"), "feedback_id")
