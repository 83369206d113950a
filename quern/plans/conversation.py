"""Conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import conversation as c, overlay
from quern.plans import sql as s
from quern.plans.common import registry

QUERIES, SQL, query = registry()

_POS, _NEG = "(?i)(?:worked|works|fixed|solved)", "(?i)(?:still|doesn''t work|not working)"
_Q = r"(?i)^(?:how|where|what|which|can we|is there)\b"
_INS = r"(?i)(?:^|\s)(?:check|please|send|open|go to|click|install|update|reset)\b"
_HYP = "(?i)(?:probably|perhaps|might be|seems)"
_ROLES = f"""roles AS (SELECT *, CASE WHEN customer THEN CASE WHEN idx = 0 OR asks THEN 'user_report' WHEN good THEN 'confirmed_resolution' ELSE 'observed_result' END
 ELSE CASE WHEN regexp_matches(text, '{_HYP}') THEN 'engineer_hypothesis' WHEN regexp_matches(trim(text), '{_INS}') THEN 'engineer_instruction' WHEN trim(text)='' THEN 'irrelevant' ELSE 'unconfirmed_claim' END END AS role
 FROM (SELECT *, contains(text,'?') OR regexp_matches(trim(text), '{_Q}') AS asks, regexp_matches(text,'{_POS}') AND NOT bad AS good
 FROM (SELECT *, lower(trim(author)) = lower(trim(root_author)) AS customer, regexp_matches(text,'{_NEG}') AS bad FROM spoken)))"""
#: Conversations with words that the rules know, so that each rule has rows.
_SPOKEN = """spoken AS (SELECT conv_id, turn, idx, author, root_author, text || CASE (turn + conv_id) % 6 WHEN 0 THEN ' it works now' WHEN 1 THEN ' please reset it' WHEN 2 THEN ' still broken' WHEN 3 THEN ' probably' WHEN 4 THEN ' really?' ELSE '' END AS text FROM messages)"""


def spoken(spark, sf):
    endings = F.element_at(F.array(*[F.lit(x) for x in (" it works now", " please reset it", " still broken", " probably", " really?", "")]), ((F.col("turn") + F.col("conv_id")) % 6 + 1).cast("int"))
    return overlay.messages(spark, sf).withColumn("text", F.concat("text", endings))


_WITH = s.with_(s.MESSAGES, _SPOKEN, _ROLES)


@query("c02_message_roles", _WITH + "SELECT conv_id, turn, role FROM roles")
def _(spark, sf):
    return spoken(spark, sf).select("conv_id", "turn", c.role().alias("role"))


@query("c03_evidence_status", _WITH + "SELECT conv_id, turn, CASE WHEN role='confirmed_resolution' AND NOT bad THEN 'confirmed_success' WHEN bad THEN 'confirmed_failure' WHEN role IN ('engineer_instruction','engineer_hypothesis','unconfirmed_claim','observed_result') THEN 'supports' ELSE 'context_only' END AS status FROM roles")
def _(spark, sf):
    return spoken(spark, sf).withColumn("role", c.role()).select("conv_id", "turn", c.evidence_status(F.col("role"), F.col("text")).alias("status"))


_RESULTS = """results AS (SELECT r.conv_id, r.idx AS source_idx, max(e.idx) AS target_idx, CASE WHEN r.role='confirmed_resolution' THEN 'confirm_success' ELSE 'confirm_failure' END AS relation_type,
 CASE WHEN r.role='confirmed_resolution' THEN 0.92 ELSE 0.88 END AS confidence FROM roles r JOIN roles e ON e.conv_id=r.conv_id AND e.idx < r.idx AND e.role IN ('engineer_instruction','engineer_hypothesis','unconfirmed_claim')
 WHERE r.role='confirmed_resolution' OR (r.role='observed_result' AND r.bad) GROUP BY r.conv_id, r.idx, r.role)"""


@query("c04_result_relations", _WITH + ", " + _RESULTS + " SELECT conv_id, source_idx, target_idx, relation_type, CAST(confidence AS DOUBLE) AS confidence FROM results")
def _(spark, sf):
    return c.result_relations(spoken(spark, sf))


@query("c04_reply_relations", _WITH + """ SELECT a.conv_id, a.idx AS source_idx, b.idx AS target_idx, CASE WHEN a.role='engineer_instruction' AND b.role='user_report' THEN 'answers' ELSE 'reply_to' END AS relation_type
 FROM roles a JOIN roles b ON a.conv_id=b.conv_id AND b.idx = a.idx - 1""")
def _(spark, sf):
    r = spoken(spark, sf).withColumn("role", c.role())
    b = r.select(F.col("conv_id").alias("c"), (F.col("idx") + 1).alias("i"), F.col("idx").alias("target_idx"), F.col("role").alias("b_role"))
    kind = F.when((F.col("role") == "engineer_instruction") & (F.col("b_role") == "user_report"), "answers").otherwise("reply_to")
    return r.join(b, (F.col("conv_id") == F.col("c")) & (F.col("idx") == F.col("i"))).select("conv_id", F.col("idx").alias("source_idx"), "target_idx", kind.alias("relation_type"))


@query("c05_merged_relations", _WITH + ", " + _RESULTS + """ SELECT conv_id, source_idx, target_idx, relation_type, source, confidence FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, source_idx, target_idx, relation_type ORDER BY p DESC, seq) AS r FROM (
 SELECT conv_id, source_idx, target_idx, relation_type, 'inferred' AS source, CAST(confidence AS DOUBLE) AS confidence, 1 AS p, 1 AS seq FROM results
 UNION ALL SELECT conv_id, source_idx, target_idx, relation_type, 'manual', 1.0, 3, 2 FROM results WHERE source_idx % 2 = 0
 UNION ALL SELECT conv_id, source_idx, target_idx, relation_type, 'telegram', 0.5, 2, 3 FROM results)) WHERE r = 1""")
def _(spark, sf):
    base = c.result_relations(spoken(spark, sf)).withColumn("source", F.lit("inferred")).withColumn("seq", F.lit(1))
    manual = base.where("source_idx % 2 = 0").withColumn("source", F.lit("manual")).withColumn("confidence", F.lit(1.0)).withColumn("seq", F.lit(2))
    native = base.withColumn("source", F.lit("telegram")).withColumn("confidence", F.lit(0.5)).withColumn("seq", F.lit(3))
    return c.merged_relations(base.unionByName(manual).unionByName(native))


@query("c06_atomic_qa", _WITH + """, seg AS (SELECT *, CAST(sum(CASE WHEN customer AND (idx=0 OR asks) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY idx) AS BIGINT) AS position FROM roles)
 SELECT conv_id, position, trim(min(CASE WHEN customer AND (idx=0 OR asks) THEN text END)) AS question, count(*) FILTER (WHERE NOT customer AND trim(text) <> '') AS n_replies,
 count(*) FILTER (WHERE customer AND NOT (idx=0 OR asks) AND trim(text) <> '') AS n_feedback, coalesce(string_agg(trim(text), chr(10) ORDER BY idx) FILTER (WHERE NOT customer AND trim(text) <> ''), '') AS answer_text,
 CASE WHEN bool_or(customer AND NOT (idx=0 OR asks) AND good) THEN 'confirmed_resolution' WHEN count(*) FILTER (WHERE customer AND NOT (idx=0 OR asks) AND trim(text) <> '') > 0 THEN 'observed_result'
 WHEN count(*) FILTER (WHERE NOT customer AND trim(text) <> '') > 0 THEN 'engineer_answer' ELSE 'unanswered' END AS status FROM seg WHERE position > 0 GROUP BY 1, 2""")
def _(spark, sf):
    return c.atomic_qa(spoken(spark, sf))


@query("c07_thread_status", _WITH + """ SELECT conv_id, CASE WHEN bool_or(customer AND idx > 0 AND good) THEN 'confirmed_resolution' WHEN bool_or(customer AND idx > 0) THEN 'observed_result'
 WHEN bool_or(NOT customer AND trim(text) <> '') THEN 'engineer_answer' ELSE 'unanswered' END AS status FROM roles GROUP BY 1""")
def _(spark, sf):
    return c.thread_status(spoken(spark, sf))


@query("c09_thread_workbook", _WITH + " SELECT conv_id, count(*) AS n_messages, count(*) FILTER (WHERE customer) AS n_customer, min(CASE WHEN idx=0 THEN left(text, 40) END) AS root_question, string_agg(role, ',' ORDER BY idx) AS roles FROM roles GROUP BY 1")
def _(spark, sf):
    r = spoken(spark, sf).withColumn("role", c.role()).withColumn("customer", c.is_customer())
    return r.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.count_if("customer").alias("n_customer"), F.min(F.when(F.col("idx") == 0, F.left("text", F.lit(40)))).alias("root_question"),
                                    F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "role"))), lambda x: x["role"]), ",").alias("roles"))


@query("c12_provenance_sync", _WITH + " SELECT conv_id, idx, role FROM roles r WHERE NOT EXISTS (SELECT 1 FROM results x WHERE x.conv_id=r.conv_id AND x.source_idx=r.idx)".replace("results", "(" + _RESULTS[_RESULTS.index("(") + 1:-1] + ")"))
def _(spark, sf):
    m = spoken(spark, sf)
    known = c.result_relations(m).select("conv_id", F.col("source_idx").alias("idx"))
    return m.withColumn("role", c.role()).join(known, ["conv_id", "idx"], "left_anti").select("conv_id", "idx", "role")
