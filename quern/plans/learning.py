"""Document learning, batches, answers after retrieval, and the organisation of entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as t
from quern.operators import answering as a, knowledge as k, learning as le, organization as o, overlay, retrieval as r, workflow as w
from quern.plans import sql as s
from quern.plans.common import registry
from quern.plans.retrieval import ELIGIBLE, lexical_sql
from quern.session import table

QUERIES, SQL, query = registry()

#: Blocks as learning sees them, and the jobs that are there before.
LBLOCKS = """lblocks AS (
 SELECT b.doc_id AS version_id, b.doc_id * 1000000000 + b.block_no AS block_id, b.block_no AS ord, 's' || (b.block_no // 10) AS section,
  CASE l.quality WHEN 1 THEN 'pending' WHEN 0 THEN 'evidence_only' ELSE 'needs_review' END AS state, b.text
 FROM blocks b LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = b.doc_id)"""
LJOBS = """ljobs AS (
 SELECT doc_id AS version_id, 'learn:' || doc_id || ':s0#1' AS idempotency_key, 'learn' AS stage, CASE WHEN toxic = 1 THEN 'queued' ELSE 'completed' END AS status
 FROM labels WHERE toxic = 1 OR quality = 0)"""


def _contexts_sql(states: str, budget: int) -> str:
    over = f"f.used > 0 AND f.used + o.n > {budget}"
    return f"""ordered AS (
 SELECT version_id, block_id, section, ord, length(text) AS n, row_number() OVER (PARTITION BY version_id, section ORDER BY ord) AS r FROM lblocks WHERE state IN ({states})),
folded AS (
 SELECT version_id, section, r, block_id, n, n AS used, 1 AS part FROM ordered WHERE r = 1
 UNION ALL
 SELECT o.version_id, o.section, o.r, o.block_id, o.n, CASE WHEN {over} THEN o.n ELSE f.used + o.n END, CASE WHEN {over} THEN f.part + 1 ELSE f.part END
 FROM folded f JOIN ordered o ON o.version_id = f.version_id AND o.section = f.section AND o.r = f.r + 1),
contexts AS (
 SELECT version_id, section || '#' || part AS context_key, count(*) AS n_blocks, min(block_id) AS first_block, CAST(sum(n) AS BIGINT) AS n_chars FROM folded GROUP BY version_id, section, part)"""


def blocks(spark, sf):
    quality = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    state = F.when(F.col("quality") == 1, "pending").when(F.col("quality") == 0, "evidence_only").otherwise("needs_review")
    return overlay.blocks(spark, sf).join(quality, "doc_id", "left").select(
        F.col("doc_id").alias("version_id"), (F.col("doc_id") * 1000000000 + F.col("block_no")).alias("block_id"), F.col("block_no").alias("ord"),
        F.concat(F.lit("s"), F.floor(F.col("block_no") / 10)).alias("section"), state.alias("state"), "text")


def jobs(spark, sf):
    return table(spark, sf, "labels").where("toxic = 1 or quality = 0").select(
        F.col("doc_id").alias("version_id"), F.concat(F.lit("learn:"), "doc_id", F.lit(":s0#1")).alias("idempotency_key"), F.lit("learn").alias("stage"),
        F.when(F.col("toxic") == 1, "queued").otherwise("completed").alias("status"))


@query("d11_queued_jobs", s.with_(s.BLOCKS, LBLOCKS, LJOBS, _contexts_sql("'pending'", 400), recursive=True) + """
SELECT version_id, context_key, n_blocks, first_block, n_chars FROM contexts
WHERE 'learn:' || version_id || ':' || context_key NOT IN (SELECT idempotency_key FROM ljobs)""")
def _(spark, sf):
    out = le.queued_jobs(blocks(spark, sf), jobs(spark, sf), 400)
    return out.select("version_id", "context_key", F.size("block_ids").alias("n_blocks"), F.array_min("block_ids").alias("first_block"), "n_chars")


@query("d11_requeued_jobs", s.with_(s.BLOCKS, LBLOCKS, LJOBS, _contexts_sql("'pending', 'evidence_only'", 400), recursive=True) + """
SELECT version_id, context_key, n_blocks, first_block, n_chars FROM contexts
WHERE 'learn:' || version_id || ':' || context_key NOT IN (SELECT idempotency_key FROM ljobs WHERE status = 'queued')""")
def _(spark, sf):
    out = le.queued_jobs(blocks(spark, sf), jobs(spark, sf), 400, reset=True)
    return out.select("version_id", "context_key", F.size("block_ids").alias("n_blocks"), F.array_min("block_ids").alias("first_block"), "n_chars")


@query("d15_job_blocks", s.with_(s.BLOCKS, LBLOCKS, _contexts_sql("'pending'", 400), recursive=True) + """
SELECT f.version_id AS job_id, f.block_id, b.ord, length(b.text) AS n FROM folded f JOIN lblocks b ON b.block_id = f.block_id WHERE f.section = 's0' AND f.part = 1""")
def _(spark, sf):
    b = blocks(spark, sf)
    named = le.learn_contexts(b, 400).where("context_key = 's0#1'").select(
        F.col("version_id").alias("job_id"), "version_id", F.concat("block_ids", F.array(F.lit(-1).cast("long"))).alias("block_ids"))
    return le.job_blocks(named, b).select("job_id", "block_id", "ord", F.length("text").alias("n"))


@query("d14_job_outcomes", s.with_(s.RUNS) + """
SELECT run_id, CASE WHEN NOT failed THEN 'completed' WHEN ends THEN 'failed' ELSE 'queued' END AS next_status, CASE WHEN failed AND NOT ends THEN (attempts + 1) * 60 END AS delay,
 CASE WHEN failed AND ends THEN CASE stage WHEN 'parse' THEN 'failed' ELSE 'learning_failed' END END AS version_status
FROM (SELECT run_id, status = 'failed' AS failed, run_id % 6 AS attempts, CASE WHEN run_id % 2 = 0 THEN 'learn' ELSE 'parse' END AS stage,
 status = 'failed' AND (user_id % 3 = 0 OR run_id % 6 >= 4) AS ends FROM runs)""")
def _(spark, sf):
    error = F.when(F.col("status") == "failed", F.when(F.col("user_id") % 3 == 0, "DocumentError").otherwise("OSError"))
    rows = overlay.runs(spark, sf).select("run_id", F.when(F.col("run_id") % 2 == 0, "learn").otherwise("parse").alias("stage"), (F.col("run_id") % 6).alias("attempts"),
                                          error.alias("error"), F.col("event_type").alias("message"))
    return le.job_outcomes(rows).select("run_id", "next_status", "delay", "version_status")


@query("d04_shelved_blocks", s.with_(s.BLOCKS, LBLOCKS) + """
SELECT block_id, CASE WHEN moves THEN 'evidence_only' ELSE state END AS state, CASE WHEN moves THEN 'no unit extracted; kept as evidence' END AS reason
FROM (SELECT *, state = 'pending' AND ord < 5 AND ord % 2 = 1 AND trim(text) <> '' AS moves FROM lblocks)""")
def _(spark, sf):
    b = blocks(spark, sf)
    return le.shelved(b, b.where("ord < 5").select("block_id"), b.where("ord % 2 = 0").select("block_id")).select("block_id", "state", "reason")


@query("d05_completed_versions", s.with_(s.BLOCKS, LBLOCKS, LJOBS) + """
SELECT doc_id AS version_id, CASE WHEN doc_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM ljobs j WHERE j.version_id = d.doc_id AND j.status = 'queued')
 AND NOT EXISTS (SELECT 1 FROM lblocks b WHERE b.version_id = d.doc_id AND b.state = 'pending') THEN 'complete' WHEN doc_id % 2 = 0 THEN 'learning' ELSE 'parsed' END AS status
FROM documents d""")
def _(spark, sf):
    v = table(spark, sf, "documents").select(F.col("doc_id").alias("version_id"), F.when(F.col("doc_id") % 2 == 0, "learning").otherwise("parsed").alias("status"))
    return le.completed_versions(v, jobs(spark, sf), blocks(spark, sf))


def _proposals(spark, sf):
    block = lambda n: F.struct((F.col("doc_id") * 1000000000 + n).alias("block_id"), F.left("text", F.lit(20 + n)).alias("excerpt"))
    sources = F.when(F.col("doc_id") % 13 == 0, F.array().cast("array<struct<block_id:bigint,excerpt:string>>")).otherwise(F.array(block(0), block(1), block(0)))
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("proposal_id"), F.when(F.col("doc_id") % 3 == 0, "confirmed").when(F.col("doc_id") % 17 == 0, "rejected").otherwise("pending_confirmation").alias("status"),
        F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")).alias("version_id"), F.when(F.col("doc_id") % 2 == 0, "official_vendor").otherwise("unknown").alias("authenticity"),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source")).alias("unit_title"), F.col("text").alias("fact_text"),
        F.when(F.col("doc_id") % 11 == 0, " ").when(F.col("doc_id") % 11 == 1, " edited ").alias("edited"), sources.alias("sources"))


_OUTCOMES = """outcomes AS (
 SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'not_a_document_proposal' WHEN doc_id % 3 = 0 THEN 'already' WHEN doc_id % 17 = 0 THEN 'not_pending' WHEN doc_id % 11 = 0 THEN 'empty_content'
  WHEN doc_id % 13 = 0 THEN 'no_source' ELSE 'ok' END AS outcome, CASE WHEN doc_id % 2 = 0 THEN 'official_document' ELSE 'other' END AS source_kind, source, text FROM documents)"""


@query("d13_confirmations", s.with_(_OUTCOMES) + """
SELECT doc_id AS proposal_id, outcome, source_kind, coalesce(nullif(left(trim(CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END), 200), ''),
 nullif(left(trim(split_part(trim(text), chr(10), 1)), 200), ''), 'Document unit') AS title,
 CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 11 = 1 THEN 'edited' ELSE trim(text) END AS content FROM outcomes""")
def _(spark, sf):
    return le.confirmations(_proposals(spark, sf)).select("proposal_id", "outcome", "source_kind", "title", "content")


@query("d13_confirmed_links", s.with_(_OUTCOMES) + """
SELECT doc_id AS proposal_id, doc_id * 1000000000 + n AS block_id, source_kind, left(text, CAST(20 + n AS BIGINT)) AS excerpt FROM outcomes, (VALUES (0), (1)) v(n) WHERE outcome = 'ok'""")
def _(spark, sf):
    return le.confirmed_links(le.confirmations(_proposals(spark, sf)))


@query("d13_known_blocks", s.with_(s.BLOCKS, LBLOCKS, _OUTCOMES) + """
SELECT block_id, CASE WHEN state = 'pending' AND ord IN (0, 1) AND version_id IN (SELECT doc_id FROM outcomes WHERE outcome = 'ok') THEN 'knowledge' ELSE state END AS state FROM lblocks""")
def _(spark, sf):
    return le.known_blocks(blocks(spark, sf), le.confirmed_links(le.confirmations(_proposals(spark, sf)))).select("block_id", "state")


@query("m16_linked_sources", """
WITH new AS (SELECT doc_id AS knowledge_id, doc_id AS evidence_id, CASE WHEN toxic = 1 THEN 'contradicts' ELSE 'supports' END AS relation FROM labels
 UNION ALL SELECT doc_id, doc_id, 'supports' FROM labels)
SELECT DISTINCT knowledge_id, evidence_id, relation FROM new n
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = n.knowledge_id AND n.relation = 'contradicts')""")
def _(spark, sf):
    la = table(spark, sf, "labels").withColumn("evidence_id", F.col("doc_id")).withColumnRenamed("doc_id", "knowledge_id")
    said = la.select("knowledge_id", "evidence_id", F.when(F.col("toxic") == 1, "contradicts").otherwise("supports").alias("relation"), F.lit(1).alias("seq"), F.lit("a").alias("excerpt"))
    again = la.select("knowledge_id", "evidence_id", F.lit("supports").alias("relation"), F.lit(2).alias("seq"), F.lit("b").alias("excerpt"))
    known = la.where("toxic = 1").select("knowledge_id", "evidence_id", F.lit("contradicts").alias("relation"))
    return le.linked_sources(known, said.unionByName(again)).select("knowledge_id", "evidence_id", "relation")


@query("m16_created_knowledge", s.with_(s.KNOWLEDGE) + """
SELECT id, CASE WHEN id % 9 = 0 THEN 'unknown_trust' ELSE 'ok' END AS error, CASE WHEN id % 9 = 0 THEN true ELSE trust <> 'conflicted' END AS active FROM knowledge""")
def _(spark, sf):
    rows = overlay.knowledge(spark, sf).select("id", F.when(F.col("id") % 9 == 0, "rumour").otherwise(F.col("trust")).alias("trust"))
    return le.created_knowledge(rows).select("id", "error", "active")


_FACTS = """facts AS (SELECT doc_id AS batch_id, block_no AS segment_no, CASE WHEN contains(text, ' e') THEN 'CONFLICT' WHEN length(text) < 20 THEN 'UNCLEAR' ELSE 'NEW' END AS decision,
 contains(lower(text), 'maybe') OR contains(lower(text), 'probably') AS vague FROM blocks),
lists AS (SELECT batch_id, segment_no, CASE WHEN decision = 'CONFLICT' THEN 'conflict' WHEN decision = 'UNCLEAR' OR vague THEN 'unclear' ELSE 'clear' END AS list FROM facts)"""


@query("m10_bulk_lists", s.with_(s.BLOCKS, _FACTS) + "SELECT batch_id, " + ", ".join(
    f"coalesce(string_agg(CAST(segment_no AS VARCHAR), ',' ORDER BY segment_no) FILTER (WHERE list = '{n}'), '') AS {n}" for n in ("clear", "unclear", "conflict")) + " FROM lists GROUP BY 1")
def _(spark, sf):
    decision = F.when(F.contains("text", F.lit(" e")), "CONFLICT").when(F.length("text") < 20, "UNCLEAR").otherwise("NEW")
    facts = overlay.blocks(spark, sf).select(F.col("doc_id").alias("batch_id"), F.col("block_no").alias("segment_no"), decision.alias("decision"), k.clarity(F.col("text")).alias("clarity"))
    return le.bulk_lists(facts).select("batch_id", *[F.array_join(n, ",").alias(n) for n in ("clear", "unclear", "conflict")])


_BATCH = """proposals AS (SELECT event_id, user_id AS batch_id, event_id % 10 AS segment_no, CASE WHEN event_type IN ('view', 'click') THEN 'pending_confirmation'
 WHEN event_type = 'signup' THEN 'pending_clarification' ELSE 'rejected' END AS status, event_id % 11 = 0 AS paused, event_id % 4 = 0 AS derived, event_id % 7 = 0 AS individual FROM events)"""


def _batch(spark, sf):
    status = F.when(F.col("event_type").isin("view", "click"), "pending_confirmation").when(F.col("event_type") == "signup", "pending_clarification").otherwise("rejected")
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("batch_id"), (F.col("event_id") % 10).cast("int").alias("segment_no"), status.alias("status"),
                                             (F.col("event_id") % 11 == 0).alias("paused"), (F.col("event_id") % 4 == 0).alias("derived"), (F.col("event_id") % 7 == 0).alias("individual"))


@query("m17_batch_counts", s.with_(_BATCH) + """
SELECT batch_id, count(*) FILTER (WHERE NOT paused AND status = 'pending_confirmation' AND NOT derived AND NOT individual) AS clear,
 count(*) FILTER (WHERE NOT paused AND (status = 'pending_clarification' OR (status = 'pending_confirmation' AND (derived OR individual)))) AS unclear FROM proposals GROUP BY 1""")
def _(spark, sf):
    return le.batch_counts(_batch(spark, sf))


@query("m17_batch_confirm", s.with_(_BATCH) + """
SELECT event_id, CASE WHEN NOT paused AND status = 'pending_confirmation' AND NOT derived AND NOT individual
 AND (batch_id % 2 = 0 OR (batch_id % 3 = 0 AND segment_no IN (1, 2, 3))) THEN 'confirmed' ELSE status END AS status FROM proposals""")
def _(spark, sf):
    b = _batch(spark, sf)
    numbers = F.when(F.col("batch_id") % 2 != 0, F.array(*[F.lit(n) for n in (1, 2, 3)]))
    selected = b.select("batch_id").distinct().where("batch_id % 2 = 0 or batch_id % 3 = 0").withColumn("numbers", numbers)
    return le.batch_confirmed(b, selected).select("event_id", "status")


def _hits(spark, sf):
    ok = r.eligible(overlay.knowledge(spark, sf), overlay.sources(spark, sf))
    sources = overlay.sources(spark, sf).where("resolution = 'accepted'").groupBy("knowledge_id").agg(F.collect_list(F.struct(
        F.col("relation").alias("source_kind"), F.lit("x" * 1200).alias("excerpt"), F.lit(None).cast("string").alias("source_label"), F.lit("p. 1").alias("source_locator"))).alias("sources"))
    return ok.join(sources, F.col("id") == F.col("knowledge_id"), "left").select(
        (F.col("id") % 40).alias("qid"), F.col("id").alias("rank"), "id", "title", "content", "entity_name", "sources")


_PAYLOAD = """payload AS (SELECT id % 40 AS qid, row_number() OVER (PARTITION BY id % 40 ORDER BY id) - 1 AS "index", id AS knowledge_id, left(trim(title), 500) AS title,
 left(trim(content), 2000) AS content, (SELECT count(*) FROM sources x WHERE x.knowledge_id = e.id AND x.resolution = 'accepted') AS n_sources FROM eligible e)"""


@query("q13_evidence_payload", s.with_(s.KNOWLEDGE, s.SOURCES, ELIGIBLE, _PAYLOAD) + 'SELECT qid, "index", knowledge_id, title, content, n_sources, n_sources * 1000 AS excerpt_chars FROM payload')
def _(spark, sf):
    p = a.evidence_payload(_hits(spark, sf))
    chars = F.aggregate("sources", F.lit(0), lambda x, y: x + F.length(y["excerpt"]))
    return p.select("qid", "index", "knowledge_id", "title", "content", F.size("sources").alias("n_sources"), chars.alias("excerpt_chars"))


@query("q05_evidence_snapshot", s.with_(s.KNOWLEDGE, s.SOURCES, ELIGIBLE, _PAYLOAD) + """
SELECT qid, place, "index" AS evidence_index, knowledge_id, title FROM payload JOIN (VALUES (0, 2), (1, 0), (2, 9999)) v(place, i) ON i = "index" """)
def _(spark, sf):
    p = a.evidence_payload(_hits(spark, sf))
    cited = p.select("qid").distinct().withColumn("indexes", F.array(*[F.lit(n) for n in (2, 0, 9999)]))
    return a.evidence_snapshot(p, cited).select("qid", "place", "evidence_index", "knowledge_id", "title")


@query("q06_after_originals", """
SELECT event_id, CASE WHEN n = 0 OR failed THEN status WHEN large THEN 'needs_clarification' WHEN decision = 'answered' THEN 'answered' WHEN conflict THEN 'unsupported'
 WHEN status = 'answered' THEN status ELSE 'unsupported' END AS answer_status,
 CASE WHEN n = 0 THEN NULL WHEN large THEN 'document_section_too_large' WHEN failed THEN NULL
 WHEN decision = 'answered' THEN CASE WHEN status = 'answered' THEN 'document_verified_answer' ELSE 'grounded_document_fallback' END
 WHEN conflict THEN 'knowledge_document_conflict' WHEN status = 'answered' THEN NULL ELSE 'document_insufficient' END AS reason_code
FROM (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'answered' ELSE 'unsupported' END AS status, event_id % 5 AS n, event_id % 7 = 0 AS large, event_id % 6 = 0 AND event_id % 7 <> 0 AS failed,
 CASE WHEN event_id % 3 = 0 THEN 'answered' ELSE 'unsupported' END AS decision, event_id % 4 = 0 AS conflict FROM events)""")
def _(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id")
    out = a.after_originals(F.when(F.col("event_type") == "purchase", "answered").otherwise("unsupported"), i % 5, i % 7 == 0, (i % 6 == 0) & (i % 7 != 0),
                            F.when(i % 3 == 0, "answered").otherwise("unsupported"), i % 4 == 0, F.lit(""))
    return e.select("event_id", out.alias("o")).select("event_id", "o.answer_status", "o.reason_code")


@query("q14_failure_reasons", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'llm_timeout' WHEN 'click' THEN 'llm_rate_limited' WHEN 'view' THEN 'llm_bad_response' ELSE 'llm_error' END AS reason FROM events""")
def _(spark, sf):
    kind = F.col("event_type")
    error = F.when(kind == "error", "ReadTimeout").when(kind == "view", "ValueError").otherwise("OSError")
    reason = a.failure_reason(error, F.when(kind == "click", 429), F.when(kind == "view", "no JSON object").otherwise(kind))
    return table(spark, sf, "events").select("event_id", reason.alias("reason"))


_RANKED = "row_number() OVER (PARTITION BY qid ORDER BY same_model DESC, round(lexical, 9) DESC, id) AS rank"


@query("q14_retrieval_trace", s.with_(s.KNOWLEDGE, s.SOURCES, ELIGIBLE, s.QUESTIONS, lexical_sql("eligible", "concat_ws(' ', title, content, entity_name)", "entity_name")) + f"""
SELECT q.qid, (SELECT count(*) FROM eligible) AS n_eligible,
 coalesce((SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) FROM (SELECT *, {_RANKED} FROM scored) z WHERE rank <= 3 AND z.qid = q.qid), '') AS candidates,
 coalesce((SELECT string_agg(doc_id || ':contradicted', ',' ORDER BY doc_id) FROM labels WHERE toxic = 1 AND doc_id % 50 = q.qid), '') AS excluded
FROM questions q""")
def _(spark, sf):
    ok = r.eligible(overlay.knowledge(spark, sf), overlay.sources(spark, sf))
    q = overlay.questions(spark, sf)
    text = F.concat_ws(" ", "title", "content", "entity_name")
    hits = r.top(r.lexical_scores(q, ok, text), ["qid"], [F.desc("same_model"), F.desc(F.round("lexical", 9)), F.asc("id")], 3)
    out = table(spark, sf, "labels").where("toxic = 1").select((F.col("doc_id") % 50).alias("qid"), F.col("doc_id").alias("id"), F.lit("contradicted").alias("reason"))
    asked = q.select("qid", t.scope_models(F.col("question")).alias("models"), t.version_tokens(F.col("question")).alias("versions"))
    return a.retrieval_trace(asked, ok, hits, out).select("qid", "n_eligible", F.array_join("candidate_ids", ",").alias("candidates"), F.array_join("excluded", ",").alias("excluded"))


@query("q02_ask_for_model", """
SELECT p_size AS qid, string_agg(DISTINCT upper(p_brand), ',' ORDER BY upper(p_brand)) AS scopes FROM part WHERE p_partkey % 4 <> 0 AND p_size % 3 <> 0
GROUP BY 1 HAVING count(DISTINCT upper(p_brand)) >= 2""")
def _(spark, sf):
    p = table(spark, sf, "part")
    hits = p.select(F.col("p_size").alias("qid"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).otherwise("").alias("scope"))
    named = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("DS-1"))).otherwise(F.array().cast("array<string>"))
    asked = p.select(F.col("p_size").alias("qid"), named.alias("models")).distinct()
    return a.ask_for_model(hits, asked).select("qid", F.array_join("scopes", ",").alias("scopes"))


def _entities(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("entity_id"), F.concat(F.lit("SRC "), "n_nationkey").alias("name"))


@query("h09_entity_backfill", s.with_(s.KNOWLEDGE) + """
SELECT DISTINCT entity_name AS name FROM knowledge WHERE active AND trust = 'user_confirmed' AND trim(entity_name) <> ''
AND lower(replace(entity_name, ' ', '')) NOT IN (SELECT 'src' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0)""")
def _(spark, sf):
    return o.entity_links(overlay.knowledge(spark, sf), _entities(spark, sf).where("entity_id % 2 = 0"))[0].select("name")


@query("h09_entity_links", s.with_(s.KNOWLEDGE) + """
SELECT id, entity_name, n_nationkey IS NOT NULL AS known FROM knowledge LEFT JOIN nation ON 'src' || n_nationkey = lower(replace(entity_name, ' ', ''))
 AND n_nationkey % 2 = 0 WHERE active AND trust = 'user_confirmed' AND trim(entity_name) <> ''""")
def _(spark, sf):
    kn, have = overlay.knowledge(spark, sf), _entities(spark, sf).where("entity_id % 2 = 0")
    new, links = o.entity_links(kn, have)
    named = new.withColumn("known", F.lit(False)).unionByName(have.withColumn("known", F.lit(True)))
    return links.join(named, "entity_id").join(kn.select("id", "entity_name"), "id").where(o.name_key(F.col("name")) == o.name_key(F.col("entity_name"))).select("id", "entity_name", "known")


_MOVES = """moves AS (
 SELECT 'S' || s_suppkey AS child, 'N' || (s_suppkey % 25) AS parent, CASE WHEN s_suppkey % 5 = 0 THEN 'unknown_kind' WHEN s_suppkey % 11 = 0 THEN 'needs_a_source' WHEN s_suppkey % 7 = 0 THEN 'untrusted_source' ELSE 'ok' END AS error FROM supplier
 UNION ALL SELECT 'N' || c_nationkey, 'C' || min(c_custkey), 'ok' FROM customer GROUP BY c_nationkey
 UNION ALL SELECT 'X' || r_regionkey, 'R' || r_regionkey, 'ok' FROM region)"""


def _moves(spark, sf):
    k_ = F.col("s_suppkey")
    error = o.provenance_error(F.when(k_ % 5 == 0, "rumour").otherwise("user_confirmed"), F.lit("stated"), F.when(k_ % 11 != 0, k_),
                               F.when(k_ % 11 != 0, F.when(k_ % 7 == 0, "provisional").otherwise("official_source")), F.lit(True))
    a_ = table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("child"), F.concat(F.lit("N"), k_ % 25).alias("parent"), error.alias("error"))
    b_ = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("c")).select(
        F.concat(F.lit("N"), "c_nationkey").alias("child"), F.concat(F.lit("C"), "c").alias("parent"), F.lit("ok").alias("error"))
    c_ = table(spark, sf, "region").select(F.concat(F.lit("X"), "r_regionkey").alias("child"), F.concat(F.lit("R"), "r_regionkey").alias("parent"), F.lit("ok").alias("error"))
    return a_.unionByName(b_).unionByName(c_).withColumn("seq", F.lit(1))


_DECIDED = """decided AS (SELECT m.child, m.parent, e.parent AS before, CASE WHEN error <> 'ok' THEN error WHEN m.parent LIKE 'C%' THEN 'cycle' WHEN e.parent = m.parent THEN 'unchanged'
 WHEN e.parent IS NULL THEN 'created' ELSE 'moved' END AS decision FROM moves m LEFT JOIN edges e ON e.child = m.child)"""


@query("h10_moves", s.with_(s.EDGES, _MOVES, _DECIDED) + "SELECT child, parent, before, decision FROM decided")
def _(spark, sf):
    return o.moved(overlay.edges(spark, sf), _moves(spark, sf))


@query("h10_move_parent", s.with_(s.EDGES, _MOVES, _DECIDED) + """
SELECT coalesce(e.child, d.child) AS child, coalesce(d.parent, e.parent) AS parent FROM edges e FULL JOIN (SELECT * FROM decided WHERE decision IN ('moved', 'created')) d ON d.child = e.child""")
def _(spark, sf):
    e = overlay.edges(spark, sf)
    return o.after_moves(e, o.moved(e, _moves(spark, sf))).select("child", "parent")


@query("h12_proposal_checks", """
SELECT n_nationkey, CASE n_nationkey % 8 WHEN 0 THEN 'ok' WHEN 1 THEN 'no_parent_relation_said' WHEN 2 THEN 'no_quote' WHEN 3 THEN 'quote_not_in_evidence' WHEN 4 THEN 'ambiguous' WHEN 5 THEN 'needs_a_move'
 WHEN 6 THEN 'unknown_target' ELSE 'unchanged' END AS error FROM nation""")
def _(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    case = F.col("n_nationkey") % 8
    said = F.concat("n_name", F.lit(" belongs to "), "r_name")
    quote = F.when(case == 1, F.concat_ws(" and ", "n_name", "r_name")).when(case == 2, " ").otherwise(said)
    p = n.select("n_nationkey", F.when(case == 7, "NO_CHANGE").otherwise("CREATE_RELATION").alias("action"), F.col("n_name").alias("subject"), F.col("r_name").alias("target"),
                 F.lit(None).cast("string").alias("new_entity"), quote.alias("evidence_quote"), F.when(case == 4, "ambiguous").otherwise("explicit").alias("confidence"), F.lit("stated").alias("reason"),
                 F.when(case == 3, "nothing").otherwise(F.concat(F.lit("It is said: "), quote)).alias("content"), F.array().cast("array<string>").alias("excerpts"),
                 F.col("n_name").alias("current_entity"), F.when(case == 5, "ELSEWHERE").alias("current_parent"), (case != 6).alias("target_known"), F.lit(True).alias("target_active"))
    return o.checked(p).select("n_nationkey", "error")


@query("h13_reviews", s.with_(s.KNOWLEDGE) + """
SELECT id, CASE WHEN trust <> 'user_confirmed' THEN 'NO_CHANGE' WHEN id % 3 = 0 THEN 'APPLY_CHAIN' WHEN id % 3 = 1 THEN 'APPLY_PROPOSAL' ELSE 'LINK_ONLY' END AS action FROM knowledge""")
def _(spark, sf):
    said = F.when(F.col("id") % 3 == 0, F.concat(F.lit("part belongs to "), "id"))
    error = F.when(F.col("id") % 3 == 1, "ok").otherwise("no_quote")
    return overlay.knowledge(spark, sf).select("id", o.review(F.col("trust"), w.explicit_chain(said), error).alias("action"))


@query("m19_provenance_rules", s.with_(s.KNOWLEDGE) + """
SELECT id, CASE WHEN id % 6 = 0 THEN 'unknown_kind' WHEN id % 7 = 0 THEN 'no_text' WHEN id % 5 = 0 THEN 'needs_a_source' WHEN trust <> 'user_confirmed' THEN 'untrusted_source'
 WHEN NOT active THEN 'inactive_source' WHEN id % 6 = 1 THEN 'needs_official_source' ELSE 'ok' END AS error FROM knowledge""")
def _(spark, sf):
    i = F.col("id")
    kind = F.when(i % 6 == 0, "rumour").when(i % 6 == 1, "official_source").otherwise("user_confirmed")
    given = F.when(i % 5 != 0, i)
    return overlay.knowledge(spark, sf).select("id", o.provenance_error(kind, F.when(i % 7 == 0, " ").otherwise("said"), given, F.when(i % 5 != 0, F.col("trust")), F.col("active")).alias("error"))
