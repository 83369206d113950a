"""Sentences, facts, units, answers and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import phrases as p
from quern.operators import answering as a, intents, knowledge as k, learning as le, lifecycle as lc, names, overlay, retrieval as r
from quern.plans import sql as s
from quern.plans.common import registry
from quern.session import table

QUERIES, SQL, query = registry()


def _pick(of: str, *values):
    """One of the values by the remainder of a column."""
    return F.element_at(F.array(*[F.lit(x) for x in values]), (F.col(of) % len(values) + 1).cast("int"))


@query("f14_stable_markers", """
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'ds-2cd1,h.265,poe' WHEN 1 THEN 'onvif' ELSE '' END AS markers FROM part""")
def _(spark, sf):
    said = _pick("p_size", "DS-2CD1 with H.265, PoE.", "only ONVIF!", "plain words")
    return table(spark, sf, "part").select("p_partkey", F.array_join(p.stable_markers(said), ",").alias("markers"))


@query("f20_russian_prose", """
SELECT p_partkey, p_size % 4 <> 3 AS prose, p_size % 4 = 0 AS qualifier FROM part""")
def _(spark, sf):
    said = F.concat(_pick("p_size", "при питании PoE ", "если device включен ", "камера 支持 ", "no "), F.lit("H.265"))
    return table(spark, sf, "part").select("p_partkey", p.russian_prose(said).alias("prose"), p.russian_qualifier(said).alias("qualifier"))


@query("f19_needs_context", "SELECT p_partkey, p_size % 4 IN (0, 2) AS needs FROM part")
def _(spark, sf):
    said = _pick("p_size", "Что для этого нужно докупить?", "Как настроить камеру?", "А этот поддерживает?", "А этот поддерживает?")
    models = F.when(F.col("p_size") % 4 == 3, F.array(F.lit("DS-1"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "part").select("p_partkey", p.needs_context(said, models).alias("needs"))


@query("f25_split_conjunctions", """
SELECT p_partkey, unnest(CASE WHEN p_size % 2 = 0 THEN [p_name || ' supports ' || p_type || '.', p_name || ' has ' || p_brand || '.'] ELSE [p_name || ' supports ' || p_type || ' and ' || p_brand || '.'] END) AS part FROM part""")
def _(spark, sf):
    said = F.concat("p_name", F.lit(" supports "), "p_type", F.when(F.col("p_size") % 2 == 0, " and has ").otherwise(" and "), "p_brand", F.lit("."))
    return table(spark, sf, "part").select("p_partkey", F.explode(p.conjoined_parts(said)).alias("part"))


@query("f27_covering_span", """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type || ' / ' || p_brand END AS span FROM part""")
def _(spark, sf):
    source = F.concat(F.lit("~~"), "p_type", F.lit(" / "), "p_brand", F.lit("~~"))
    said = F.array(F.col("p_brand"), F.concat(F.lit(" "), "p_type"), F.lit(""), F.when(F.col("p_size") % 5 == 0, "missing").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", p.covering_span(source, said).alias("span"))


@query("f29_unseen_numbers", r"""
SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(text, '[0-9]{3,}')), lambda x: NOT list_contains(seen, x))) AS n_unseen
FROM (SELECT doc_id, regexp_replace(text, '[A-Za-z./()-]', ' ', 'g') AS text, regexp_extract_all(substr(regexp_replace(text, '[A-Za-z./()-]', ' ', 'g'), 1, 500), '[0-9]{3,}') AS seen FROM documents)""")
def _(spark, sf):
    plain = F.regexp_replace("text", "[A-Za-z./()-]", " ")  # numbers only: an identifier is then a number too
    found = F.filter(p.unseen(plain, F.substring(plain, 1, 500)), lambda x: x.rlike("^[0-9]{3,}$"))
    return table(spark, sf, "documents").select("doc_id", F.size(F.array_distinct(found)).cast("long").alias("n_unseen"))


@query("f31_rendered_units", """
SELECT p_partkey, p_name || chr(10) || '适用范围：models: ' || p_brand || CASE p_size % 3 WHEN 0 THEN chr(10) || '1. ' || p_type || chr(10) || '2. check' || chr(10) || '预期结果：done'
 WHEN 1 THEN chr(10) || '警告：hot；sharp' || chr(10) || '触发条件：' || p_type || chr(10) || '结论：' || p_brand ELSE chr(10) || '现象与结果：seen' END AS content FROM part""")
def _(spark, sf):
    kind = _pick("p_size", "procedure", "rule", "experience")
    d = {"models": F.array("p_brand"), "ordered_steps": F.array(F.col("p_type"), F.lit(" "), F.lit("check")), "expected_result": F.lit("done"), "trigger": F.col("p_type"), "result": F.col("p_brand"),
         "observation": F.lit(" seen "), "warnings": F.when(F.col("p_size") % 3 == 1, F.array(F.lit("hot"), F.lit("sharp")))}
    return table(spark, sf, "part").select("p_partkey", p.rendered_unit(F.col("p_name"), kind, d).alias("content"))


@query("f33_signature_guard", """
SELECT doc_id, CASE WHEN coalesce(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') = '' THEN 'empty' WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 240 THEN 'too_long'
 WHEN contains(lower(text), 'the') THEN 'model' WHEN regexp_matches(text, '\\b([0-9]{1,3}[.]){3}[0-9]{1,3}\\b') THEN 'address' ELSE 'ok' END AS error FROM documents""".replace("\\\\", "\\"))
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", p.signature_error(F.col("text"), F.array(F.lit("The"), F.lit(""))).alias("error"))


@query("f36_compose_conditions", """
SELECT p_partkey, p_name || ' — ' || CASE WHEN contains(lower(p_name), lower(p_type)) THEN '' ELSE p_type || '; ' END || p_brand AS content FROM part""")
def _(spark, sf):
    conditions = F.array(F.upper("p_name"), F.col("p_brand"), F.concat(F.lower("p_brand"), F.lit(" ")), F.lit(" "))
    return table(spark, sf, "part").select("p_partkey", p.composed_content(F.concat("p_name", F.lit(" ;.")), F.col("p_type"), conditions).alias("content"))


@query("f39_claim_normalisation", """
SELECT p_partkey, unnest([p_name || ':other', p_type || ':procedure', p_brand || ':other']) AS claim FROM part WHERE p_size % 5 <> 0
UNION ALL SELECT p_partkey, p_name || ':other' FROM part WHERE p_size % 5 = 0""")
def _(spark, sf):
    objects = F.concat(F.lit(', {"claim": " '), "p_type", F.lit('", "claim_type": "procedure"}, {"claim": "'), "p_brand", F.lit('"}'))
    said = F.concat(F.lit('["'), "p_name", F.lit(' ", " "'), F.when(F.col("p_size") % 5 != 0, objects).otherwise(', {"claim_type": "x"}, {"claim": " "}'), F.lit("]"))
    rows = table(spark, sf, "part").select("p_partkey", F.explode(p.claims(said)).alias("c"))
    return rows.select("p_partkey", F.concat_ws(":", "c.claim", "c.claim_type").alias("claim"))


@query("f41_proposal_fingerprint", "SELECT p_partkey, sha256(lower(p_name) || chr(10) || lower(p_type)) AS fingerprint FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", p.fingerprint(F.concat(F.lit(" "), F.upper("p_name")), F.concat("p_type", F.lit("\t "))).alias("fingerprint"))


@query("f43_block_hash", s.with_(s.BLOCKS) + """
SELECT doc_id, block_no, sha256('{"layout": {"row": ' || block_no || '}, "text": ' || CAST(to_json(text) AS VARCHAR) || '}') AS h FROM blocks""")
def _(spark, sf):
    layout = F.concat(F.lit('{"row": '), "block_no", F.lit("}"))
    return overlay.blocks(spark, sf).select("doc_id", "block_no", p.content_hash(F.col("text"), layout).alias("h"))


@query("g01_focus_and_families", r"""
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([array_to_string(regexp_extract_all(lower(p_brand), '[a-z]+'), ' '), 'ds x'], lambda x: x <> ''))), ',') AS families,
 p_size % 2 = 0 AS compatible FROM part""")
def _(spark, sf):
    families = p.model_families(F.array(F.col("p_brand"), F.lit("DS-2 X 7"), F.lit("123")))
    other = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("ds x"))).otherwise(F.array(F.lit("nobody")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(families, ",").alias("families"), p.families_compatible(families, other).alias("compatible"))


@query("r14_rerank_merge", """
SELECT p_size AS qid, p_partkey AS id, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey % 7 = 0 DESC, coalesce(s_acctbal, -1) DESC, p_retailprice DESC, p_partkey) AS rank
FROM part LEFT JOIN supplier ON s_suppkey = p_partkey AND s_suppkey % 2 = 0""")
def _(spark, sf):
    hits = table(spark, sf, "part").select(F.col("p_size").alias("qid"), F.col("p_partkey").alias("id"), (F.col("p_partkey") % 7 == 0).alias("exact"), F.col("p_retailprice").alias("rrf"))
    scores = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").join(hits.select("qid", "id"), F.col("s_suppkey") == F.col("id")).select("qid", "id", F.col("s_acctbal").alias("score"))
    return r.reranked(hits, scores).select("qid", "id", "rank")


@query("r15_title_containment", """
WITH q AS (SELECT n_nationkey AS qid, n_name || ' in ' || (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) || '?' AS question FROM nation),
rows_ AS (SELECT n_nationkey AS id, n_name AS title FROM nation UNION ALL SELECT 100 + r_regionkey, r_name FROM region),
scored AS (SELECT qid, id, CASE WHEN title <> '' AND contains(lower(question), lower(title)) THEN 1 ELSE 0 END AS hit FROM q, rows_)
SELECT * FROM (SELECT qid, id, hit, row_number() OVER (PARTITION BY qid ORDER BY hit DESC, id) AS rank FROM scored) WHERE rank <= 12""")
def _(spark, sf):
    n, g = table(spark, sf, "nation"), table(spark, sf, "region")
    asked = n.join(g, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("qid"), F.concat("n_name", F.lit(" in "), "r_name", F.lit("?")).alias("question"))
    rows = n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("title")).unionByName(g.select((F.col("r_regionkey") + 100).cast("long").alias("id"), F.col("r_name").alias("title")))
    return r.by_title(asked, rows, 12)


@query("q08_customer_text", """
SELECT event_id, CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'service error' ELSE CASE WHEN event_id % 3 = 0
 THEN 'Если речь о DS-1, порядок такой: ok Если у вас другая модель, укажите её — порядок может отличаться.' ELSE 'ok' END END
 WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'which?' ELSE 'name the model' END WHEN 'click' THEN 'no evidence' ELSE 'service error' END AS said FROM events""")
def _(spark, sf):
    i, kind = F.col("event_id"), F.col("event_type")
    none = F.array().cast("array<string>")
    answer = F.when(i % 4 == 0, " ").otherwise(a.qualified(F.lit("ok "), none, F.when(i % 3 == 0, F.array(F.lit("DS-1"))).otherwise(none)))
    status = F.when(kind == "purchase", "answered").when(kind == "view", "needs_clarification").when(kind == "click", "unsupported").otherwise("failed")
    said = a.customer_text(status, F.when(kind == "purchase", F.nullif(F.trim(answer), F.lit(""))), F.when(i % 2 == 0, "which?"), F.lit(""), "no evidence", "name the model", "service error")
    return table(spark, sf, "events").select("event_id", said.alias("said"))


@query("q12_sidecar_errors", """
WITH c AS (SELECT event_id AS k, CASE event_id % 5 WHEN 0 THEN 'answerable' WHEN 1 THEN 'clarify' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'boundary' ELSE 'other' END AS category,
 CASE WHEN event_id % 3 = 0 THEN 'answered' WHEN event_id % 3 = 1 THEN 'unsupported' ELSE 'unknown' END AS status, event_id % 2 = 0 AS there FROM events)
SELECT k AS sample_key, 'unknown_sample' AS error FROM c WHERE NOT there
UNION ALL SELECT k, 'unknown_category' FROM c WHERE there AND category = 'other'
UNION ALL SELECT k, CASE WHEN status = 'unknown' THEN 'unexpected_status' ELSE 'disagrees' END FROM c WHERE there AND (status = 'unknown' OR status <> 'answered')
UNION ALL SELECT k, 'category_and_status' FROM c WHERE there AND ((category = 'answerable' AND status <> 'answered') OR category = 'clarify' OR (category = 'unsupported' AND status <> 'unsupported'))""")
def _(spark, sf):
    e = table(spark, sf, "events")
    cases = e.select(F.col("event_id").alias("sample_key"), _pick("event_id", "answerable", "clarify", "unsupported", "boundary", "other").alias("category"),
                     _pick("event_id", "answered", "unsupported", "unknown").alias("expected_answer_status"))
    samples = e.where("event_id % 2 = 0").select(F.col("event_id").alias("sample_key"), F.lit("answered").alias("expected_answer_status"))
    return a.sidecar_errors(cases, samples)


@query("q17_result_scoring", """
SELECT p_partkey, selection, expected = actual AS status_pass, expected = actual AND selection AND (expected <> 'answered' OR p_size % 7 <> 0) AS golden_pass, actual = 'answered' AND selection AND p_size % 3 <> 1 AS applicability_pass
FROM (SELECT p_partkey, p_size, CASE WHEN p_size % 4 = 0 THEN 'unsupported' ELSE 'answered' END AS expected, CASE WHEN p_size % 5 = 0 THEN 'unsupported' ELSE 'answered' END AS actual,
 CASE WHEN p_size % 4 = 0 THEN p_size % 3 = 1 WHEN p_size % 4 = 1 THEN false WHEN p_size % 4 = 2 THEN p_size % 6 <> 0 ELSE true END AS selection FROM part)""")
def _(spark, sf):
    z = F.col("p_size")
    rows = table(spark, sf, "part").select(
        "p_partkey", (z % 4 == 0).alias("refuse"), (z % 4 == 1).alias("clarify"), F.when(z % 4 == 0, "unsupported").otherwise("answered").alias("expected_status"),
        F.when(z % 4 == 2, F.array(F.lit("key"))).otherwise(F.array().cast("array<string>")).alias("expected_keys"), F.when(z % 4 == 3, F.col("p_partkey")).alias("expected_id"),
        F.when(z % 5 == 0, "unsupported").otherwise("answered").alias("actual_status"), F.array("p_partkey").alias("ids"),
        F.when(z % 6 == 0, F.array(F.lit("other"))).otherwise(F.array(F.lit("key"), F.lit("b"))).alias("keys"), F.array(F.when(z % 3 == 1, "conflict").otherwise("exact")).alias("scopes"), (z % 7 != 0).alias("supported"))
    return a.scored(rows).select("p_partkey", F.col("selection_pass").alias("selection"), "status_pass", "golden_pass", "applicability_pass")


@query("q18_latest_results", "SELECT user_id AS run_id, event_type AS model_name, event_id % 3 AS sample_key, max(event_id) AS seq, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2, 3")
def _(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("model_name"), (F.col("event_id") % 3).alias("sample_key"), F.col("event_id").alias("seq"), "value")
    return a.latest_results(rows)


@query("c10_taxonomy_merge", """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END AS category, CASE WHEN p_size % 3 = 0 THEN p_container ELSE 'x' END AS family FROM part""".replace("p_container", "p_name"))
def _(spark, sf):
    x = table(spark, sf, "part")
    have = x.select("p_partkey", F.when(F.col("p_size") % 2 == 0, " ").otherwise(F.col("p_brand")).alias("category"), F.when(F.col("p_size") % 3 != 0, "x").alias("family"))
    return k.filled(have, x.select("p_partkey", F.col("p_type").alias("category"), F.col("p_name").alias("family"), F.lit(1).alias("unused")), "p_partkey")


@query("c13_uncovered_cases", "SELECT 'CASE-' || lpad(CAST(conv_id AS VARCHAR), CAST(greatest(6, length(CAST(conv_id AS VARCHAR))) AS INTEGER), '0') AS candidate_id, conv_id AS case_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return k.fallback_candidates(table(spark, sf, "conversations").select(F.col("conv_id").alias("case_id")), table(spark, sf, "labels").select(F.col("doc_id").alias("case_id")))


def _relations(spark, sf):
    m = table(spark, sf, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("message_id"))
    requests = m.select("case_id", F.col("message_id").alias("source"), (F.col("message_id") + F.col("message_id") % 2).alias("target"),
                        F.when(F.col("case_id") % 5 == 0, "likes").otherwise("answers").alias("relation"))
    known = m.where("message_id = 1").select("case_id", F.col("message_id").alias("source"), (F.col("message_id") + 1).alias("target"), F.lit("answers").alias("relation"), F.lit("inferred").alias("origin"), F.lit(0.5).alias("confidence"))
    return k.manual_relations(requests, m, known)


_CHECKED = """checked AS (SELECT conv_id AS case_id, turn AS source, turn + turn % 2 AS target, CASE WHEN conv_id % 5 = 0 THEN 'unknown_relation' WHEN turn % 2 = 0 THEN 'same_message'
 WHEN NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1) THEN 'not_of_this_case' ELSE 'ok' END AS error FROM conversations a)"""


@query("c18_manual_relations", s.with_(_CHECKED) + "SELECT case_id, source, target, error FROM checked")
def _(spark, sf):
    return _relations(spark, sf)[0].select("case_id", "source", "target", "error")


@query("c18_corrected_relations", s.with_(_CHECKED) + """
SELECT case_id, source, target, 'manual' AS origin, 1.0::DOUBLE AS confidence FROM checked WHERE error = 'ok'
UNION ALL SELECT conv_id, turn, turn + 1, 'inferred', 0.5::DOUBLE FROM conversations c WHERE turn = 1
 AND NOT EXISTS (SELECT 1 FROM checked k WHERE k.case_id = c.conv_id AND k.source = 1 AND k.target = 2 AND k.error = 'ok')""")
def _(spark, sf):
    return _relations(spark, sf)[1].select("case_id", "source", "target", "origin", "confidence")


@query("c17_compacted_analyses", """
SELECT conv_id AS case_id, left(q, 20) AS question, array_to_string(list_slice(claims, 1, 3), '|') AS claims, roles FROM (
 SELECT conv_id, arg_min(coalesce(text, ''), turn) AS q, list(left(coalesce(text, ''), 20) ORDER BY turn) AS claims,
 (SELECT string_agg(role || '=' || n, ',' ORDER BY role) FROM (SELECT role, count(*) AS n FROM conversations b WHERE b.conv_id = a.conv_id GROUP BY 1) x) AS roles FROM conversations a GROUP BY 1)""")
def _(spark, sf):
    m = table(spark, sf, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    l_ = m.groupBy(F.col("conv_id").alias("case_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("l"))
    rows = l_.select("case_id", F.col("l")[0]["text"].alias("question"), F.transform("l", lambda x: x["text"]).alias("claims"), F.transform("l", lambda x: x["role"]).alias("roles"))
    out = k.compacted(rows, 3, 20)
    return out.select("case_id", "question", F.array_join("claims", "|").alias("claims"), F.array_join("roles", ",").alias("roles"))


@query("m14_retire_knowledge", s.with_(s.KNOWLEDGE, s.SOURCES) + """
SELECT id, active AND NOT (id % 2 = 0 AND trust = 'provisional' AND NOT EXISTS (SELECT 1 FROM sources x WHERE x.knowledge_id = k.id AND x.relation = 'supports' AND x.knowledge_id % 4 <> 0)) AS active FROM knowledge k""")
def _(spark, sf):
    kn = overlay.knowledge(spark, sf)
    sources = overlay.sources(spark, sf).select("knowledge_id", F.col("knowledge_id").alias("evidence_id"), "relation", F.lit(True).alias("active"), "resolution")
    corrections = kn.where("id % 2 = 0").select(F.col("id").alias("knowledge_id"), F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(-1).alias("evidence_id"))
    return k.retired(kn.select("id", "trust", "active"), sources, corrections).select("id", "active")


@query("m11_session_summary", """
WITH st AS (SELECT user_id, min(event_id) + 5 AS started FROM events GROUP BY 1),
p AS (SELECT e.* FROM events e JOIN st ON st.user_id = e.user_id AND event_id >= started)
SELECT st.user_id AS thread_id, coalesce((SELECT string_agg('fact ' || z, ',' ORDER BY first) FROM (SELECT event_id % 4 AS z, min(event_id) AS first FROM p WHERE p.user_id = st.user_id AND event_type = 'purchase' GROUP BY 1) x), '') AS learned,
 (SELECT count(*) FROM p WHERE p.user_id = st.user_id AND event_type = 'click') AS corrected, (SELECT count(*) FROM p WHERE p.user_id = st.user_id AND event_type = 'error') AS unresolved,
 coalesce((SELECT CAST(sum(event_id % 10) AS BIGINT) FROM p WHERE p.user_id = st.user_id), 0) AS total FROM st""")
def _(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("user_id", "thread_id")
    sessions = e.groupBy("thread_id").agg((F.min("event_id") + 5).alias("started_at"))
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "confirmed").when(kind == "click", "corrected").when(kind == "error", "unknown").otherwise("pending")
    content = F.concat(F.lit("fact "), F.col("event_id") % 4)
    facts = e.select("thread_id", F.col("event_id").alias("proposal_id"), status.alias("status"), content.alias("content"), F.col("event_id").alias("at"))
    batches = e.select("thread_id", (F.col("event_id") % 10).alias("total"), F.lit(0).alias("processed"), F.lit(0).alias("failed"), F.col("event_id").alias("at"))
    return k.session_summary(sessions, facts, batches).select("thread_id", F.array_join("learned", ",").alias("learned"), "corrected", "unresolved", "total")


@query("t01_claim_order", """
SELECT user_id AS worker, CASE WHEN m IS NOT NULL THEN 'message' ELSE 'document' END AS kind, coalesce(m, d) AS id FROM (
 SELECT user_id, min(event_id) FILTER (WHERE event_type = 'view' AND event_id % 3 = 0) AS m, min(event_id) FILTER (WHERE event_type = 'click' AND event_id <= 4000) AS d FROM events GROUP BY 1) WHERE coalesce(m, d) IS NOT NULL""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("worker"), F.col("event_id").alias("id"), "event_type", F.col("event_id").alias("at"))
    queued = F.lit("queued").alias("status")
    inbox = e.where("event_type = 'view'").select("worker", "id", F.when(F.col("id") % 3 == 0, "queued").otherwise("done").alias("status"), "at")
    return lc.claimed(inbox, e.where("event_type = 'click'").select("worker", "id", queued, "at"), F.lit(4000), "worker")


@query("t03_crash_recovery", s.with_(s.RUNS) + """
SELECT run_id, CASE WHEN status = 'started' AND (SELECT max(r.run_id) FROM runs r WHERE r.user_id = x.user_id) < (SELECT max(run_id) FROM runs) - 300 THEN 'queued' WHEN status = 'started' THEN 'processing' ELSE status END AS status FROM runs x""")
def _(spark, sf):
    x = overlay.runs(spark, sf).withColumn("worker", F.col("user_id"))
    now = x.agg(F.max("run_id")).scalar()
    up = lc.alive(x.select("worker", F.col("run_id").alias("at")), now, 300).where("alive")
    jobs = x.withColumn("status", F.when(F.col("status") == "started", "processing").otherwise(F.col("status")))
    return lc.recovered(jobs, up).select("run_id", "status")


@query("d02_unit_validation", s.with_(s.BLOCKS) + """
SELECT b.doc_id * 1000000000 + b.block_no AS unit_id, CASE WHEN block_no % 10 = 1 THEN 'no_title' WHEN block_no % 10 = 2 THEN 'unknown_kind' WHEN trim(text) = '' THEN 'no_content' WHEN block_no % 10 = 3 THEN 'no_steps'
 WHEN block_no % 10 = 4 THEN 'incomplete_rule' WHEN block_no % 10 = 5 THEN 'no_source' WHEN block_no % 10 = 6 THEN 'block_of_another_version' WHEN block_no % 10 = 7 THEN 'not_verbatim' WHEN block_no % 10 = 8 THEN 'unseen_identifier' ELSE 'ok' END AS error
FROM blocks b WHERE block_no < 12""")
def _(spark, sf):
    b = overlay.blocks(spark, sf).withColumnRenamed("doc_id", "version_id").withColumn("block_id", F.col("version_id") * 1000000000 + F.col("block_no"))
    n = F.col("block_no") % 10
    source = F.struct(F.when(n == 6, F.lit(-1).cast("long")).otherwise(F.col("block_id")).alias("block_id"), F.when(n == 7, F.lit("never said ~~")).otherwise(F.concat(F.lit(" "), F.substring("text", 1, 40))).alias("excerpt"))
    units = b.where("block_no < 12").select(
        F.col("block_id").alias("unit_id"), "version_id", F.when(n == 1, " ").otherwise("Unit").alias("title"), F.when(n == 2, "guess").when(n == 3, "procedure").when(n == 4, "rule").otherwise("fact").alias("kind"),
        F.when(n == 8, F.concat("text", F.lit(" ZQ-99881"))).otherwise(F.col("text")).alias("content"), F.array(F.lit(" ")).alias("steps"), F.lit("when").alias("trigger"), F.lit(None).cast("string").alias("result"),
        F.when(n != 5, F.array(source)).alias("sources"))
    heads = b.select("version_id").distinct().withColumn("heading", F.lit("manual 2024"))
    return le.unit_errors(units, b.select("version_id", "block_id", "text"), heads).select("unit_id", "error")


@query("j05_names_in_documents", """
WITH names AS (SELECT DISTINCT array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') AS name FROM benchmark)
SELECT doc_id, name, CAST((length(lower(text)) - length(replace(lower(text), lower(name), ''))) / length(lower(name)) AS BIGINT) AS places
FROM documents JOIN names ON name <> '' AND contains(lower(text), lower(name))""")
def _(spark, sf):
    """The first three words of each benchmark item as names, in whole documents."""
    opening = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    wanted = table(spark, sf, "benchmark").select(opening.alias("name")).distinct()
    return names.found(table(spark, sf, "documents"), "doc_id", "text", wanted, "name")


@query("f38_intent_contract", """
WITH said AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS first, lower(p_type) AS kind, p_size % 4 AS turn FROM part)
SELECT p_partkey, CASE WHEN turn = 3 THEN 'family is unknown' WHEN turn = 2 AND NOT contains(lower(first), kind) THEN 'feature is not in the question' END AS error,
 CASE WHEN turn < 2 OR (turn = 2 AND contains(lower(first), kind)) THEN 'capacity_limit.check_limit' || CASE turn WHEN 1 THEN '' ELSE '.' || first END END AS knowledge_key
FROM said""")
def _(spark, sf):
    """Replies about parts: grounded, without a feature, with words of another column as evidence, of an unknown family."""
    turn, first = F.col("p_size") % 4, F.split_part("p_name", F.lit(" "), F.lit(1))
    said = {"family": F.when(turn == 3, "parts").otherwise("Capacity Limit"), "action": F.lit("check-limit"),
            "feature": F.when(turn != 1, first), "feature_evidence": F.when(turn == 2, F.col("p_type")).when(turn != 1, F.upper(first)),
            "object_type": F.lit("accessory"), "context_status": F.lit("standalone"), "key_specificity": F.lit("specific")}
    fields = F.struct(*[said.get(f, F.lit(None).cast("string")).alias(f) for f in intents.FIELDS])
    reply = F.to_json(fields, {"ignoreNullFields": "false"})
    rows = table(spark, sf, "part").select("p_partkey", reply.alias("reply"), F.concat(F.lit("How many of "), first, F.lit("?")).alias("question"),
                                           F.array("p_brand").alias("models"))
    return intents.intents(rows).select("p_partkey", "error", "intent.knowledge_key")
