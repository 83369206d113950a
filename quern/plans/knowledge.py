"""Facts, case memory, review and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import phrases, vectors as v
from quern.operators import conversation as c, knowledge as k, overlay, retrieval as r
from quern.plans import sql as s
from quern.plans.common import registry
from quern.plans.conversation import _WITH as THREADS, spoken
from quern.plans.retrieval import ELIGIBLE
from quern.session import table

QUERIES, SQL, query = registry()


@query("f17_stems", "SELECT n_name, lower(n_name) AS stem FROM nation")
def _(spark, sf):
    return table(spark, sf, "nation").select("n_name", k.stem(F.concat(F.lit("«"), "n_name", F.lit("ами»,"))).alias("stem"))


@query("f22_segments")
def _(spark, sf):
    """Segments of whole documents; the order of rules has no SQL form."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(k.segments(F.col("text"))).alias("segment_no", "text"))


@query("f24_batch_confirmation", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '1,2,3' WHEN 1 THEN '1,2' ELSE '1,3' END AS numbers FROM part")
def _(spark, sf):
    said = F.element_at(F.array(F.lit("All good"), F.lit("确认前2项"), F.lit("确认第1、3、9项")), F.col("p_size") % 3 + 1)
    return table(spark, sf, "part").select("p_partkey", F.array_join(k.confirmed_numbers(said, F.lit(3)), ",").alias("numbers"))


@query("f34_clarity", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'vague_version' WHEN 2 THEN 'vague_difference' ELSE 'clear' END AS clarity FROM part")
def _(spark, sf):
    ending = F.element_at(F.array(*[F.lit(x) for x in (" maybe", " 老版", " 不同", " ok")]), F.col("p_size") % 4 + 1)
    return table(spark, sf, "part").select("p_partkey", k.clarity(F.concat("p_name", ending)).alias("clarity"))


@query("f56_model_confidence", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 0.85 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE p_size / 100.0 END::DOUBLE AS confidence FROM part")
def _(spark, sf):
    value = F.when(F.col("p_size") % 4 == 0, " High").when(F.col("p_size") % 4 == 1, "7").when(F.col("p_size") % 4 == 2, "unclear").otherwise((F.col("p_size") / 100.0).cast("string"))
    return table(spark, sf, "part").select("p_partkey", k.model_confidence(value).alias("confidence"))


@query("m02_m03_fact_decisions", "SELECT p_partkey, decision, CASE decision WHEN 'UNCLEAR' THEN 'pending_clarification' WHEN 'CONFLICT' THEN 'conflict' WHEN 'CONFIRM' THEN 'confirmed' ELSE 'pending_confirmation' END AS status FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'NEW' WHEN p_size > 45 THEN 'CONFLICT' WHEN p_size % 3 = 0 THEN 'CONFIRM' WHEN length(p_name) > 14 THEN 'ENRICH' ELSE 'UNCLEAR' END AS decision FROM part)")
def _(spark, sf):
    d = k.decision(F.col("p_partkey") % 5 != 0, F.col("p_size") % 3 == 0, F.length("p_name") > 14, F.col("p_size") > 45)
    return table(spark, sf, "part").select("p_partkey", d.alias("decision")).withColumn("status", k.proposal_status(F.col("decision")))


_TERMS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 3))"


@query("m04_w08_merge_neighbours", s.with_(s.BLOCKS) + f"""SELECT doc_id, block_no, CAST(sum(CASE WHEN coalesce(shared >= 2 AND shared / least(len(t), len(p)) >= 0.25, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY block_no) AS BIGINT) AS unit
 FROM (SELECT *, len(list_intersect(t, p)) AS shared FROM (SELECT doc_id, block_no, t, lag(t) OVER (PARTITION BY doc_id ORDER BY block_no) AS p FROM (SELECT doc_id, block_no, {_TERMS} AS t FROM blocks)))""")
def _(spark, sf):
    terms = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: F.length(x) > 3))
    b = overlay.blocks(spark, sf).select("doc_id", "block_no", terms.alias("t"))
    return k.merged_neighbours(b, "doc_id", "block_no", "t").select("doc_id", "block_no", "unit")


@query("c11_case_memory", THREADS + """ SELECT conv_id, question, context, CASE WHEN conv_id % 5 = 0 THEN 'rejected' WHEN conv_id % 5 = 1 THEN 'verified' WHEN conv_id % 5 = 2 THEN 'needs_context' ELSE 'ai_derived' END AS status FROM (
 SELECT conv_id, arg_min(trim(text), idx) AS question, coalesce(string_agg('[' || role || '] ' || trim(text), chr(10) ORDER BY idx) FILTER (WHERE idx > first), '') AS context FROM (SELECT *, min(idx) FILTER (WHERE trim(text) <> '') OVER (PARTITION BY conv_id) AS first FROM roles) WHERE trim(text) <> '' GROUP BY 1)""")
def _(spark, sf):
    m = spoken(spark, sf).withColumn("role", c.role()).where(F.trim("text") != "")
    g = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("idx", "role", F.trim("text").alias("t")))).alias("l"))
    context = F.array_join(F.transform(F.slice("l", 2, 1_000_000), lambda x: F.concat(F.lit("["), x["role"], F.lit("] "), x["t"])), "\n")
    quality = F.when(F.col("conv_id") % 5 == 0, "low_value").otherwise("good")
    return g.select("conv_id", F.col("l")[0]["t"].alias("question"), context.alias("context"), k.memory_status(quality, F.col("conv_id") % 5 == 1, F.col("conv_id") % 5 == 2).alias("status"))


@query("c16_guarded_import", "SELECT o_orderkey, review, state, CASE WHEN review = 'pending' AND state = 'draft' AND o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS value FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'approved' END AS review, CASE WHEN o_totalprice > 50000 THEN 'draft' ELSE 'published' END AS state FROM orders)")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "pending").otherwise("approved").alias("review"),
                                          F.when(F.col("o_totalprice") > 50000, "draft").otherwise("published").alias("state"), F.lit("old").alias("value"))
    return k.guarded_refresh(o, o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("new").alias("value")), "o_orderkey")


@query("c08_scope_level", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'single_case' WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'model_condition' WHEN p_size % 2 = 0 THEN 'model' WHEN p_size > 25 THEN 'brand' ELSE 'generic' END AS level FROM part")
def _(spark, sf):
    some = lambda ok: F.when(ok, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "part").select("p_partkey", k.scope_level(some(F.col("p_size") % 2 == 0), some(F.col("p_size") % 3 == 0), F.col("p_size") % 7 != 0, F.when(F.col("p_size") > 25, F.col("p_brand"))).alias("level"))


@query("r10_one_running_rank", "SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY kind, vec_id) AS rank FROM (SELECT vec_id, label, 0 AS kind FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, label, 1 FROM embeddings WHERE vec_id % 3 = 1)")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    both = e.where("vec_id % 3 = 0").select("vec_id", "label", F.lit(0).alias("kind")).unionByName(e.where("vec_id % 3 = 1").select("vec_id", "label", F.lit(1).alias("kind")))
    return both.select("vec_id", F.row_number().over(Window.partitionBy("label").orderBy("kind", "vec_id")).alias("rank"))


@query("r13_evidence_assembly", s.with_(s.KNOWLEDGE, s.SOURCES, ELIGIBLE) + "SELECT source_kind, count(*) AS n FROM (SELECT 'verified' AS source_kind, id FROM eligible UNION ALL SELECT 'case', conv_id FROM conversations WHERE role='assistant' UNION ALL SELECT 'document', doc_id FROM documents) GROUP BY 1")
def _(spark, sf):
    a = r.eligible(overlay.knowledge(spark, sf), overlay.sources(spark, sf)).select(F.lit("verified").alias("source_kind"))
    b = table(spark, sf, "conversations").where("role = 'assistant'").select(F.lit("case").alias("source_kind"))
    d = table(spark, sf, "documents").select(F.lit("document").alias("source_kind"))
    return a.unionByName(b).unionByName(d).groupBy("source_kind").agg(F.count("*").alias("n"))


@query("f54_f55_lexical_and_jaccard", "SELECT p_partkey, round(len(list_intersect(x, y)) / sqrt(len(x)::DOUBLE * len(y)), 6) AS lexical, round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS x, list_distinct(string_split(p_name || ' ' || p_type, ' ')) AS y FROM part)")
def _(spark, sf):
    x, y = F.array_distinct(F.split("p_name", " ")), F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type"), " "))
    shared = F.size(F.array_intersect(x, y))
    return table(spark, sf, "part").select("p_partkey", F.round(v.lexical(shared, F.size(x), F.size(y), F.lit(False)), 6).alias("lexical"), F.round(v.jaccard(x, y), 6).alias("jaccard"))


@query("f32_reject_if_longer", "SELECT doc_id, length(text) > 1000 AS rejected FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.length("text") > 1000).alias("rejected"))


@query("f13_f14_synonym_tokens", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split(lower(q), ' '), lambda x: length(x) > 1 AND x NOT IN ('http','https','www','com')), lambda x: CASE x WHEN 'pwd' THEN 'password' WHEN 'pass' THEN 'password' WHEN 'forgot' THEN 'reset' WHEN 'nvr' THEN 'recorder' ELSE x END))), ',') AS tokens FROM (SELECT p_partkey, p_name || CASE p_size % 4 WHEN 0 THEN ' PWD' WHEN 1 THEN ' forgot pass' WHEN 2 THEN ' a www nvr' ELSE '' END AS q FROM part)")
def _(spark, sf):
    q = F.concat("p_name", F.element_at(F.array(*[F.lit(x) for x in (" PWD", " forgot pass", " a www nvr", "")]), F.col("p_size") % 4 + 1))
    return table(spark, sf, "part").select("p_partkey", F.array_join(phrases.topic_tokens(q), ",").alias("tokens"))


@query("q16_golden_preparation", "SELECT item_id, coalesce(a.source, b.source, 'reference') AS origin FROM benchmark LEFT JOIN documents a ON a.doc_id = item_id AND a.lang = 'en' LEFT JOIN documents b ON b.doc_id = item_id + 1 AND b.lang = 'fr'")
def _(spark, sf):
    d = table(spark, sf, "documents")
    a = d.where("lang = 'en'").select(F.col("doc_id").alias("ka"), F.col("source").alias("sa"))
    b = d.where("lang = 'fr'").select(F.col("doc_id").alias("kb"), F.col("source").alias("sb"))
    q = table(spark, sf, "benchmark")
    return q.join(a, F.col("item_id") == F.col("ka"), "left").join(b, F.col("item_id") + 1 == F.col("kb"), "left").select("item_id", F.coalesce("sa", "sb", F.lit("reference")).alias("origin"))


@query("w02_rank_positions", "SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS rank FROM lineitem")
def _(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    return table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.row_number().over(w).alias("rank"))


@query("w04_last_before", "SELECT event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_id < e.event_id AND p.event_type = 'click') AS last_click FROM events e WHERE event_type = 'purchase'")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return table(spark, sf, "events").select("event_id", "event_type", last.alias("last_click")).where("event_type = 'purchase'").drop("event_type")


@query("a17_segment_coverage", s.with_(s.BLOCKS) + "SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE block_no % 2 = 0) AS confirmed, string_agg(CAST(block_no AS VARCHAR), ',' ORDER BY block_no) FILTER (WHERE block_no % 2 = 1) AS missing FROM blocks GROUP BY 1")
def _(spark, sf):
    odd = F.array_sort(F.collect_list(F.when(F.col("block_no") % 2 == 1, F.col("block_no"))))
    return overlay.blocks(spark, sf).groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(F.col("block_no") % 2 == 0).alias("confirmed"), F.nullif(F.array_join(odd, ","), F.lit("")).alias("missing"))


@query("a18_workbook_summary", THREADS + " SELECT count(DISTINCT conv_id) AS threads, count(*) AS messages, count(*) FILTER (WHERE role='confirmed_resolution') AS confirmations FROM roles")
def _(spark, sf):
    m = spoken(spark, sf).withColumn("role", c.role())
    return m.agg(F.count_distinct("conv_id").alias("threads"), F.count("*").alias("messages"), F.count_if(F.col("role") == "confirmed_resolution").alias("confirmations"))


@query("a23_inbox_summary", "SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS pending, count(*) FILTER (WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS new_this_week FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts")).scalar()
    fresh = e.withColumn("fresh", F.col("ts") > last - F.expr("interval 7 days"))
    return fresh.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("pending"), F.count_if("fresh").alias("new_this_week"))


@query("p11_completed_payload", "SELECT doc_id, coalesce(nullif(trim(lang), ''), 'und') AS lang, coalesce(source, 'unknown') AS source, coalesce(n_chars, 0) AS n_chars FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("und")).alias("lang"), F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


@query("p12_scope_applicability", "SELECT p_partkey, NOT (p_size % 3 > 0 AND p_size % 4 > 0 AND p_brand <> p_type AND p_size % 5 > 0) AS applicable FROM part")
def _(spark, sf):
    from quern.functions.scope import applicable

    stated = F.when(F.col("p_size") % 3 > 0, F.array("p_brand")).otherwise(F.array().cast("array<string>"))
    asked = F.when(F.col("p_size") % 4 > 0, F.when(F.col("p_size") % 5 > 0, F.array("p_type")).otherwise(F.array("p_brand"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "part").select("p_partkey", applicable(stated, asked).alias("applicable"))


@query("p14_already_asked", "SELECT a.conv_id, a.turn, max(b.conv_id) AS asked_in FROM conversations a LEFT JOIN conversations b ON a.text = b.text AND b.conv_id < a.conv_id GROUP BY 1, 2")
def _(spark, sf):
    w = Window.partitionBy("text").orderBy("conv_id").rangeBetween(Window.unboundedPreceding, -1)
    before = F.when(F.col("text").isNotNull(), F.max("conv_id").over(w))
    return table(spark, sf, "conversations").select("conv_id", "turn", before.alias("asked_in"))


@query("p16_human_edits_protect", "SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN 'human' ELSE 'machine' END AS owner FROM documents d")
def _(spark, sf):
    edited = table(spark, sf, "labels").select("doc_id").distinct().withColumn("hit", F.lit(True))
    return table(spark, sf, "documents").join(edited, "doc_id", "left").select("doc_id", F.when(F.col("hit"), "human").otherwise("machine").alias("owner"))


@query("p02_gate_difference", s.with_(s.KNOWLEDGE, s.SOURCES, ELIGIBLE) + "SELECT (SELECT count(*) FROM knowledge k WHERE active AND trust IN ('official_source','user_confirmed') AND EXISTS (SELECT 1 FROM sources x WHERE x.knowledge_id=k.id AND x.relation='supports' AND x.resolution='accepted')) AS counted, (SELECT count(*) FROM eligible) AS eligible")
def _(spark, sf):
    kn, so = overlay.knowledge(spark, sf), overlay.sources(spark, sf)
    supports = so.where("relation = 'supports' and resolution = 'accepted'")
    loose = kn.where("active").where(F.col("trust").isin("official_source", "user_confirmed")).join(supports, F.col("id") == F.col("knowledge_id"), "left_semi")
    both = loose.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(r.eligible(kn, so).select(F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.agg(F.sum("a").alias("counted"), F.sum("b").alias("eligible"))


@query("g12_alias_upsert", "SELECT p_brand AS alias, max(p_partkey) AS target FROM part GROUP BY 1 UNION ALL SELECT n_name, n_nationkey FROM nation WHERE n_name NOT IN (SELECT p_brand FROM part)")
def _(spark, sf):
    from quern.sources.files import upsert

    old = table(spark, sf, "nation").select(F.col("n_name").alias("alias"), F.col("n_nationkey").cast("long").alias("target"))
    return upsert(old, table(spark, sf, "part").groupBy(F.col("p_brand").alias("alias")).agg(F.max("p_partkey").alias("target")), "alias")


@query("g18_detail_bundle", "SELECT c_custkey, n_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey DESC) FROM (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderkey DESC LIMIT 3)) AS last_orders FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_join(F.slice(F.sort_array(F.collect_list("o_orderkey"), asc=False), 1, 3), ",").alias("l"))
    j = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", "n_name", F.coalesce("n", F.lit(0)).alias("orders"), F.col("l").alias("last_orders"))
