"""Queries of curation: keys, similarities, limits, units, splits, merges, bundles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import phrases
from quern.operators import curation as c, overlay, packages as p, review
from quern.plans import sql as s
from quern.plans.common import registry
from quern.session import table

QUERIES, SQL, query = registry()

_WORDS = r"regexp_replace(regexp_replace(lower(regexp_replace(coalesce(text, ''), '(?i)https?://\S+', ' ', 'g')), '[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\s]+', ' ', 'g'), '\s+', ' ', 'g')"
_STOP = "(" + ", ".join(f"'{w}'" for w in phrases.STOP_WORDS) + ")"
_SAME = "CASE x " + " ".join(f"WHEN '{w}' THEN '{name}'" for w, name in phrases.SYNONYMS.items()) + " ELSE x END"


@query("f13_topic_tokens", f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(
 list_filter(string_split(trim({_WORDS}), ' '), lambda x: length(x) > 1 AND x NOT IN {_STOP}), lambda x: {_SAME}), lambda x: x NOT IN {_STOP}))), ' ') AS tokens FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(phrases.topic_tokens(F.col("text")), " ").alias("tokens"))


@query("f32_refused_fields", """SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) > 1000 THEN 'text' END, CASE WHEN length(lang) > 2 THEN 'lang' END,
 CASE WHEN length(source) > 4 THEN 'source' END], lambda x: x IS NOT NULL), ',') AS refused, left(text, 100) AS excerpt FROM documents""")
def _(spark, sf):
    refused = F.array_join(c.over_limit({"text": 1000, "lang": 2, "source": 4}), ",")
    return table(spark, sf, "documents").select("doc_id", refused.alias("refused"), F.left("text", F.lit(100)).alias("excerpt"))


@query("f44_prompt_hash", """SELECT conv_id, sha256('[' || string_agg('{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}',
 ',' ORDER BY turn) || ']') AS prompt_hash FROM conversations GROUP BY 1""")
def _(spark, sf):
    said = F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("content"), "role")))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(said.alias("l"))
    return rows.select("conv_id", c.prompt_hash(F.transform("l", lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")))).alias("prompt_hash"))


@query("f46_content_keys", "SELECT doc_id, sha256(coalesce(text, '')) AS content_key, sha256('model-a' || coalesce(text, '')) AS vector_key FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", c.content_key(F.col("text")).alias("content_key"), c.content_key(F.col("text"), F.lit("model-a")).alias("vector_key"))


@query("f45_title_group_key", "SELECT p_type, 'telegram.group.' || left(sha1(string_agg(trim(lower(p_name)), '|' ORDER BY trim(lower(p_name)))), 16) AS group_key FROM part GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(F.collect_list("p_name").alias("l")).select("p_type", review.group_key(F.col("l")).alias("group_key"))


@query("f51_similarity_to_previous", """WITH d AS (SELECT p_partkey, lag(p_partkey) OVER w AS previous, list_distinct(string_split(lower(p_name), ' ')) AS t, lag(list_distinct(string_split(lower(p_name), ' '))) OVER w AS u
 FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)), e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE label % 2 = 0)
 SELECT p_partkey, previous, round(CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN list_dot_product(a.v, b.v) ELSE len(list_intersect(t, u))::DOUBLE / len(list_distinct(list_concat(t, u))) END, 6) AS similarity
 FROM d LEFT JOIN e a ON a.vec_id = p_partkey LEFT JOIN e b ON b.vec_id = previous WHERE previous IS NOT NULL""")
def _(spark, sf):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", phrases.topic_tokens(F.col("p_name")).alias("t"))
    parts = parts.select("p_partkey", "t", F.lag("p_partkey").over(w).alias("previous"), F.lag("t").over(w).alias("u")).where("previous is not null")
    e = table(spark, sf, "embeddings").where("label % 2 = 0").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = parts.join(e.select(F.col("vec_id").alias("p_partkey"), F.col("v").alias("x")), "p_partkey", "left").join(e.select(F.col("vec_id").alias("previous"), F.col("v").alias("y")), "previous", "left")
    return rows.select("p_partkey", "previous", F.round(c.similarity(F.col("x"), F.col("y"), F.col("t"), F.col("u")), 6).alias("similarity"))


_MARK = r"sha256(trim(regexp_replace(lower(title), '\s+', ' ', 'g')) || chr(10) || trim(regexp_replace(lower(text), '\s+', ' ', 'g')))"


@query("d03_new_units", s.with_(s.BLOCKS) + rf""", units AS (SELECT source, doc_id, block_no, {_MARK} AS mark FROM (SELECT *, source AS title FROM blocks)),
 stored AS (SELECT DISTINCT u.source, u.mark FROM units u JOIN labels l ON u.doc_id = l.doc_id WHERE l.quality = 1)
 SELECT source, doc_id, block_no FROM units u WHERE NOT EXISTS (SELECT 1 FROM stored x WHERE x.source = u.source AND x.mark = u.mark)
 QUALIFY row_number() OVER (PARTITION BY source, mark ORDER BY doc_id, block_no) = 1""")
def _(spark, sf):
    """A source is a version; blocks of documents with a good label are its stored units."""
    b = overlay.blocks(spark, sf).select(F.col("source").alias("version_id"), F.struct("doc_id", "block_no").alias("position"), F.col("source").alias("title"), F.col("text").alias("content"))
    labels = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "confirmed").otherwise("rejected").alias("status")).distinct()
    stored = b.withColumn("doc_id", F.col("position.doc_id")).join(labels, "doc_id").select("version_id", "status", "title", "content")
    return c.new_units(b, stored).select(F.col("version_id").alias("source"), "position.doc_id", "position.block_no")


_SPLITS = """held AS (SELECT 'C' || o_custkey AS candidate_id, o_orderkey AS case_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) - 1 AS case_position, o_totalprice > 150000 AS dear, o_custkey FROM orders),
 sums AS (SELECT candidate_id, count(*) AS n, count(*) FILTER (WHERE dear) AS k, min(o_custkey) % 7 = 0 AS foreign_case FROM held GROUP BY 1),
 checked AS (SELECT candidate_id, CASE WHEN k = 0 AND NOT foreign_case THEN 'nothing_selected' WHEN foreign_case THEN 'not_attached' WHEN k = n THEN 'nothing_left' ELSE 'ok' END AS error, k FROM sums)"""


def _split(spark, sf):
    """Customers are candidates and their orders cases; dear orders are to move, and every seventh customer asks for one that is not theirs."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))
    o = table(spark, sf, "orders").withColumn("case_position", F.row_number().over(w) - 1)
    cases = o.select(F.concat(F.lit("C"), F.col("o_custkey")).alias("candidate_id"), F.col("o_orderkey").alias("case_id"), "case_position")
    dear = F.collect_list(F.when(F.col("o_totalprice") > 150000, F.col("o_orderkey")))
    asked = o.groupBy("o_custkey").agg(dear.alias("l")).select(F.concat(F.lit("C"), F.col("o_custkey")).alias("candidate_id"),
                                                               F.when(F.col("o_custkey") % 7 == 0, F.concat("l", F.array(F.lit(-1).cast("long")))).otherwise(F.col("l")).alias("case_ids"))
    return c.split(cases, asked)


@query("g12_split_requests", s.with_(_SPLITS) + "SELECT candidate_id, error, CASE WHEN error = 'ok' THEN candidate_id || '-S1' END AS new_id, CASE WHEN error = 'ok' THEN k ELSE 0 END AS moved FROM checked")
def _(spark, sf):
    return _split(spark, sf)[0]


@query("g12_split_cases", s.with_(_SPLITS) + """SELECT h.candidate_id || CASE WHEN error = 'ok' AND dear THEN '-S1' ELSE '' END AS candidate_id, case_id,
 row_number() OVER (PARTITION BY h.candidate_id, error = 'ok' AND dear ORDER BY CASE WHEN error = 'ok' AND dear THEN 0 ELSE case_position END, case_id) - 1 AS case_position FROM held h JOIN checked c ON h.candidate_id = c.candidate_id""")
def _(spark, sf):
    return _split(spark, sf)[1]


_MERGES = """asked AS (SELECT 'P' || p_partkey AS candidate_id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'P' || min(p_partkey) OVER (PARTITION BY p_brand) END AS target_id, p_partkey % 3 AS m, p_size FROM part),
 merged AS (SELECT a.*, CASE WHEN target_id IS NULL THEN 'no_target' WHEN target_id = candidate_id THEN 'into_itself' WHEN CAST(substr(target_id, 2) AS BIGINT) % 3 = 2 THEN 'not_published'
 WHEN CAST(substr(target_id, 2) AS BIGINT) % 3 = 1 THEN 'not_allowed' ELSE 'ok' END AS error FROM asked a)"""


def _merge(spark, sf):
    """Parts are candidates with one version each; each asks to join the first of its brand."""
    parts = table(spark, sf, "part").withColumn("id", F.concat(F.lit("P"), F.col("p_partkey")))
    first = F.concat(F.lit("P"), F.min("p_partkey").over(Window.partitionBy("p_brand")))
    asked = parts.select(F.col("id").alias("candidate_id"), F.when(F.col("p_size") % 5 != 0, first).alias("target_id"))
    candidates = parts.select(F.col("id").alias("candidate_id"), F.lit("approved").alias("status"), F.lit(None).cast("string").alias("duplicate_of"))
    knowledge = parts.select(F.col("id").alias("candidate_id"), F.lit(1).alias("version_no"), F.when(F.col("p_partkey") % 3 == 2, "draft").otherwise("published").alias("status"), (F.col("p_partkey") % 3 == 0).alias("allowed"))
    return c.merge(candidates, knowledge, asked)


@query("g12_merge_requests", s.with_(_MERGES) + "SELECT candidate_id, target_id, error FROM merged")
def _(spark, sf):
    return _merge(spark, sf)[0].select("candidate_id", "target_id", "error")


@query("g12_merged_knowledge", s.with_(_MERGES) + """SELECT candidate_id, CASE WHEN m = 2 THEN 'draft' WHEN error = 'ok' THEN 'archived' ELSE 'published' END AS status, m = 0 AND error <> 'ok' AS allowed,
 CASE WHEN error = 'ok' THEN target_id END AS duplicate_of FROM merged""")
def _(spark, sf):
    _, candidates, knowledge = _merge(spark, sf)
    return knowledge.join(candidates.drop("status"), "candidate_id").select("candidate_id", "status", "allowed", "duplicate_of")


@query("g18_case_bundles", s.with_(s.BLOCKS) + """, near AS (SELECT doc_id, block_no, lag(block_no) OVER w AS b, lead(block_no) OVER w AS a FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY block_no))
 SELECT doc_id AS candidate_id, coalesce((SELECT string_agg(conv_id || '.' || turn || '=' || CASE WHEN turn % 2 = 0 THEN role ELSE 'unconfirmed_claim' END, ' ' ORDER BY conv_id, turn) FROM conversations c WHERE c.conv_id // 3 = d.doc_id), '') AS messages,
 coalesce((SELECT string_agg(conv_id || '.' || turn || '>' || (turn - 1), ' ' ORDER BY conv_id, turn) FROM conversations c WHERE c.conv_id // 3 = d.doc_id AND role = 'assistant'), '') AS relations,
 coalesce((SELECT string_agg(n.block_no || ':' || (b IS NOT NULL) || ':' || (a IS NOT NULL), ' ' ORDER BY n.block_no) FROM near n WHERE n.doc_id = d.doc_id AND n.block_no % 5 = 0), '') AS evidence,
 coalesce((SELECT string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY ts DESC, event_id DESC) FROM (SELECT * FROM events e WHERE e.user_id = d.doc_id ORDER BY ts DESC, event_id DESC LIMIT 100)), '') AS events FROM documents d""")
def _(spark, sf):
    """Documents are candidates, three conversations the cases of one, users' events theirs; a digest of each bundle."""
    m = table(spark, sf, "conversations").where("conv_id is not null")
    owner = F.expr("conv_id div 3").alias("candidate_id")
    cases = m.select(owner, F.col("conv_id").alias("case_id"), F.col("conv_id").alias("case_position")).distinct()
    messages = m.select(F.col("conv_id").alias("case_id"), F.col("turn").alias("message_index"), F.col("role").alias("author"), "text")
    roles = m.where("turn % 2 = 0").select(owner, F.col("conv_id").alias("case_id"), F.col("turn").alias("message_index"), "role")
    relations = m.where("role = 'assistant'").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("source"), (F.col("turn") - 1).alias("target"), F.lit("answers").alias("relation"))
    blocks = overlay.blocks(spark, sf).select("doc_id", F.col("block_no").cast("long").alias("block_no"), "text")
    evidence = blocks.where("block_no % 5 = 0").select(F.col("doc_id").alias("candidate_id"), F.col("block_no").alias("evidence_id"), "doc_id", "block_no")
    events = table(spark, sf, "events").select(F.col("user_id").alias("candidate_id"), "event_id", F.col("ts").alias("created_at"), "event_type")
    b = c.bundles(table(spark, sf, "documents").select(F.col("doc_id").alias("candidate_id")), cases, messages, roles, relations, evidence, blocks, events)
    said = F.expr("flatten(transform(cases, c -> transform(c.messages, m -> concat(c.case_id, '.', m.message_index, '=', m.role))))")
    links = F.expr("flatten(transform(cases, c -> transform(c.relations, r -> concat(c.case_id, '.', r.source, '>', r.target))))")
    shown = F.expr("transform(evidence, e -> concat(e.block_no, ':', e.before is not null, ':', e.after is not null))")
    return b.select("candidate_id", F.array_join(said, " ").alias("messages"), F.array_join(links, " ").alias("relations"),
                    F.array_join(shown, " ").alias("evidence"), F.array_join(F.expr("transform(events, e -> string(e.event_id))"), " ").alias("events"))


PACKAGES = {
    "metal": p.Package("Metals", "part.metal", words=("steel", "brass", "copper"), kind="support_process"),
    "first": p.Package("Brands", "part.first", prefix="Brand#1"),
    "named": p.Package("Named", "Brand#22", keys=("Brand#22", "Brand#23")),
}


@query("c15_package_cases", """SELECT package, case_id, row_number() OVER (PARTITION BY package ORDER BY case_id) - 1 AS position FROM (
 SELECT 'metal' AS package, p_partkey AS case_id FROM part WHERE regexp_matches(lower(p_brand || '|' || p_type || ' ' || p_name), 'steel|brass|copper')
 UNION ALL SELECT 'first', p_partkey FROM part WHERE starts_with(p_brand, 'Brand#1') UNION ALL SELECT 'named', p_partkey FROM part WHERE p_brand IN ('Brand#22', 'Brand#23')) x""")
def _(spark, sf):
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("case_id"), F.col("p_brand").alias("knowledge_key"), F.concat_ws(" ", "p_type", "p_name").alias("question"))
    return p.selected(items, PACKAGES)


@query("c15_thread_payloads", """SELECT conv_id AS case_id, string_agg(turn || ':' || CASE WHEN role = root THEN 'user' ELSE 'engineer' END || ':' || length(coalesce(text, '')), ' ' ORDER BY turn) AS payload
 FROM (SELECT *, (SELECT arg_min(b.role, b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.role <> 'system') AS root FROM conversations a) GROUP BY 1""")
def _(spark, sf):
    m = table(spark, sf, "conversations").where("conv_id is not null")
    root = F.min_by("role", F.when(F.col("role") != "system", F.col("turn")))
    cases = m.groupBy(F.col("conv_id").alias("case_id")).agg(root.alias("root_author"), F.min_by("text", "turn").alias("root_question"))
    none = F.lit(None).cast("string")
    messages = m.select(F.col("conv_id").alias("case_id"), F.col("turn").cast("int").alias("message_index"), F.col("role").alias("author"), "text", none.alias("file"), none.alias("photo"))
    told = F.expr("transform(messages, m -> concat(m.message_index, ':', m.actor, ':', length(m.text)))")
    return p.thread_payloads(cases, messages).select("case_id", F.array_join(told, " ").alias("payload"))


@query("c17_forced_keys", """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'part.metal' WHEN 1 THEN CASE WHEN p_brand IN ('Brand#22', 'Brand#23') THEN p_brand ELSE 'Brand#22' END ELSE p_brand END AS knowledge_key FROM part""")
def _(spark, sf):
    package = F.element_at(F.array(F.lit("metal"), F.lit("named"), F.lit("other")), F.col("p_size") % 3 + 1)
    return table(spark, sf, "part").select("p_partkey", p.forced_key(package, F.col("p_brand"), PACKAGES).alias("knowledge_key"))
