"""Answer decisions and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as t
from quern.operators import answering as a, overlay, retrieval as r
from quern.plans import sql as s
from quern.plans.common import registry
from quern.plans.retrieval import ELIGIBLE, lexical_sql
from quern.session import table

QUERIES, SQL, query = registry()

_N = f"n AS (SELECT q.qid, q.question, (SELECT count(*) FROM scored x WHERE x.qid = q.qid AND x.lexical >= 0.2) AS n FROM questions q)"
_WITH = s.with_(s.KNOWLEDGE, s.SOURCES, ELIGIBLE, s.QUESTIONS, lexical_sql("eligible", "concat_ws(' ', title, content, entity_name)", "entity_name"), _N)


def counted(spark, sf):
    """Questions with their number of candidates of at least 0.2."""
    ok = r.eligible(overlay.knowledge(spark, sf), overlay.sources(spark, sf))
    q = overlay.questions(spark, sf)
    n = r.lexical_scores(q, ok, F.concat_ws(" ", "title", "content", "entity_name")).where("lexical >= 0.2").groupBy("qid").agg(F.count("*").alias("n"))
    return q.join(n, "qid", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("q01_triage", _WITH + "SELECT qid, CASE WHEN n > 0 THEN 'answerable' WHEN qid % 5 = 1 THEN 'missing_version' WHEN qid % 5 = 2 THEN 'model_not_covered' WHEN (SELECT count(*) FROM eligible) = 0 THEN 'no_eligible_evidence' ELSE 'missing_model' END AS outcome FROM n")
def _(spark, sf):
    ok = r.eligible(overlay.knowledge(spark, sf), overlay.sources(spark, sf)).agg(F.count("*")).scalar()
    c = counted(spark, sf)
    out = a.triage(F.col("n"), (F.col("qid") % 5 == 1).cast("int"), (F.col("qid") % 5 == 2).cast("int"), F.col("ok"), F.array().cast("array<string>"))
    return c.withColumn("ok", ok).select("qid", out.alias("outcome"))


@query("q04_fallback_trigger", _WITH + "SELECT qid, coalesce(CASE WHEN " + " OR ".join(f"contains(lower(question), '{w}')" for w in t.SOURCE_WORDS) + " THEN 'explicit_check' WHEN (" + " OR ".join(f"contains(lower(question), '{w}')" for w in t.RISK_WORDS) + ") AND n > 0 THEN 'high_risk_verify' WHEN n = 0 THEN 'no_knowledge' END, 'none') AS fallback FROM n")
def _(spark, sf):
    q = F.col("question")
    return counted(spark, sf).select("qid", F.coalesce(a.fallback(t.mentions(q, t.SOURCE_WORDS), t.mentions(q, t.RISK_WORDS), F.col("n")), F.lit("none")).alias("fallback"))


@query("a19_recall_at_5", _WITH + "SELECT count(*) AS questions, count(*) FILTER (WHERE hit) AS hits FROM (SELECT q.qid, bool_or(coalesce(x.id % 7 = q.qid % 7, false)) AS hit FROM questions q LEFT JOIN (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY same_model DESC, round(lexical, 9) DESC, id) AS rank FROM scored) WHERE rank <= 5) x ON x.qid = q.qid GROUP BY 1)")
def _(spark, sf):
    ok = r.eligible(overlay.knowledge(spark, sf), overlay.sources(spark, sf))
    q = overlay.questions(spark, sf)
    scored = r.lexical_scores(q, ok, F.concat_ws(" ", "title", "content", "entity_name"))
    best = r.top(scored, ["qid"], [F.desc("same_model"), F.desc(F.round("lexical", 9)), F.asc("id")], 5)
    hit = q.join(best.select("qid", "id"), "qid", "left").groupBy("qid").agg(F.bool_or(F.coalesce(F.col("id") % 7 == F.col("qid") % 7, F.lit(False))).alias("hit"))
    return hit.agg(F.count("*").alias("questions"), F.count_if("hit").alias("hits"))


_FEEDBACK = "CASE WHEN run_id % 11 = 0 THEN 'wrong_scope' WHEN run_id % 13 = 0 THEN 'missing' END"
_CATEGORY = f"CASE WHEN {_FEEDBACK} = 'wrong_scope' THEN 'wrong_scope' WHEN {_FEEDBACK} = 'missing' THEN 'missing_knowledge' WHEN status='failed' THEN 'technical' WHEN status='needs_clarification' THEN 'clarify' WHEN status='no_knowledge' AND knowledge_id > 50 THEN 'retrieval_miss' WHEN status='no_knowledge' THEN 'missing_knowledge' ELSE 'none' END"


def _failures(spark, sf):
    feedback = F.when(F.col("run_id") % 11 == 0, "wrong_scope").when(F.col("run_id") % 13 == 0, "missing")
    return overlay.runs(spark, sf).withColumn("category", a.failure_category(feedback, F.col("status"), (F.col("knowledge_id") > 50).cast("int")))


@query("q10_failure_category", s.with_(s.RUNS) + f"SELECT run_id, category, CASE category WHEN 'technical' THEN 'retry' WHEN 'wrong_scope' THEN 'fix_scope' WHEN 'missing_knowledge' THEN 'add_knowledge' WHEN 'retrieval_miss' THEN 'tune_retrieval' WHEN 'clarify' THEN 'ask_user' ELSE 'none' END AS action FROM (SELECT *, {_CATEGORY} AS category FROM runs)")
def _(spark, sf):
    return _failures(spark, sf).select("run_id", "category", a.action(F.col("category")).alias("action"))


@query("a22_failures_by_category", s.with_(s.RUNS) + f"SELECT category, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT *, {_CATEGORY} AS category FROM runs) WHERE category <> 'none' GROUP BY 1")
def _(spark, sf):
    return _failures(spark, sf).where("category <> 'none'").groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("q03_citation_validation", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_filter(list(l_linenumber), lambda i: i >= 1 AND i <= 3))), ',') AS cited FROM lineitem GROUP BY 1")
def _(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("c"))
    return g.select("l_orderkey", F.array_join(a.valid_citations(F.col("c"), F.lit(3)), ",").alias("cited"))


@query("q09_critical_flags", s.with_(s.RUNS) + "SELECT run_id, concat_ws(',', CASE WHEN status='answered' AND coalesce(knowledge_id, 0) % 4 = 0 THEN 'answer_without_citation' END, CASE WHEN status='failed' AND event_type <> '' THEN 'text_after_failure' END) AS flags FROM runs")
def _(spark, sf):
    f = a.critical_flags(F.col("status"), F.coalesce("knowledge_id", F.lit(0)) % 4, F.col("event_type"))
    return overlay.runs(spark, sf).select("run_id", F.array_join(f, ",").alias("flags"))


@query("f56_confidence_ceiling", "SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN 0.0 ELSE least(p_size / 50.0, CASE WHEN p_size % 2 = 0 THEN 0.5 ELSE 0.95 END, CASE p_partkey % 4 WHEN 1 THEN 0.8 WHEN 2 THEN 0.7 ELSE 1.0 END) END::DOUBLE AS confidence FROM part")
def _(spark, sf):
    kind = F.when(F.col("p_size") % 2 == 0, "case").otherwise("verified")
    scope = F.element_at(F.array(*[F.lit(x) for x in ("exact", "family", "unspecified", "conflict")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", a.ceiling(kind, scope, F.col("p_size") / 50.0).alias("confidence"))


@query("q12_golden_integrity", "SELECT item_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN c > 1 THEN 'repeated' ELSE 'ok' END AS state FROM (SELECT item_id, text, count(*) OVER (PARTITION BY text) AS c FROM benchmark)")
def _(spark, sf):
    from pyspark.sql import Window

    b = table(spark, sf, "benchmark").withColumn("c", F.count("*").over(Window.partitionBy("text")))
    return b.select("item_id", F.when(F.col("text").isNull() | (F.trim("text") == ""), "empty").when(F.col("c") > 1, "repeated").otherwise("ok").alias("state"))
