"""Review groups, events, publication, and the records around batch runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import vectors as v
from quern.operators import answering as a, documents as d, grouping as g, hierarchy as h, linkage, overlay, retrieval as r, review as rv, workflow as w
from quern.plans import sql as s
from quern.plans.common import registry
from quern.session import shared_path, table
from quern.sources import files, slides

QUERIES, SQL, query = registry()


def _members(spark, sf):
    c = overlay.candidates(spark, sf)
    key = F.when(F.col("id") % 3 == 0, F.concat(F.lit("telegram.case."), "id")).otherwise(F.col("knowledge_key"))
    return c.select(F.col("brand").alias("group_id"), "id", F.col("id").alias("position"), key.alias("knowledge_key"), "title", "frequency",
                    F.create_map(F.lit("question_patterns"), F.array("title", F.concat(F.lit(" "), F.upper("title"))), F.lit("conditions"), F.array("knowledge_key")).alias("values"))


@query("g04_lossless_merge", s.with_(s.CANDIDATES, """
own AS (SELECT brand, knowledge_key, count(*) AS n, min(id) AS first FROM candidates WHERE id % 3 <> 0 GROUP BY 1, 2)""") + """
SELECT c.brand AS group_id, (SELECT knowledge_key FROM own WHERE own.brand = c.brand ORDER BY n DESC, first LIMIT 1) AS knowledge_key,
 arg_max(title, frequency * 10000000 - id) AS title, arg_max(id, frequency * 10000000 - id) AS primary_id, count(*) AS members, CAST(sum(frequency) AS BIGINT) AS frequency,
 (SELECT count(*) FROM own WHERE own.brand = c.brand) > 1 AS mixed
FROM candidates c WHERE brand IN (SELECT brand FROM own) GROUP BY brand""")
def _(spark, sf):
    m = _members(spark, sf)
    named = m.where(~F.col("knowledge_key").startswith(rv.CASE_PREFIX)).select("group_id").distinct()
    return rv.aggregated(m).join(named, "group_id", "left_semi")


@query("g04_group_facts", s.with_(s.CANDIDATES) + """
SELECT group_id, fact_type, fact_key, count(*) AS sources, arg_min(value, position) AS value FROM (
 SELECT brand AS group_id, 'question_patterns' AS fact_type, lower(title) AS fact_key, title AS value, id * 10 AS position FROM candidates
 UNION ALL SELECT brand, 'question_patterns', lower(title), ' ' || upper(title), id * 10 + 1 FROM candidates
 UNION ALL SELECT brand, 'conditions', lower(knowledge_key), knowledge_key, id * 10 FROM candidates) GROUP BY 1, 2, 3""")
def _(spark, sf):
    values = F.create_map(F.lit("question_patterns"), F.array("title", F.concat(F.lit(" "), F.upper("title"))), F.lit("conditions"), F.array("knowledge_key"))
    rows = rv.facts(overlay.candidates(spark, sf).select(F.col("brand").alias("group_id"), "id", F.col("id").alias("position"), values.alias("values")))
    return rows.groupBy("group_id", "fact_type", "fact_key").agg(F.count("*").alias("sources"), F.max(F.when(F.col("kept"), F.col("value"))).alias("value"))


@query("g06_negative_pairs", """
WITH cases AS (SELECT DISTINCT l_suppkey AS group_id, l_orderkey AS case_id FROM lineitem)
SELECT group_id, o_custkey AS example_id, count(*) AS n FROM cases JOIN orders ON o_orderkey = case_id GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(spark, sf):
    cases = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("group_id"), F.col("l_orderkey").alias("case_id"))
    examples = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("example_id")).agg(F.collect_list("o_orderkey").alias("case_ids"))
    return rv.negative_conflicts(cases, examples).select("group_id", "example_id", F.size("case_ids").alias("n"))


@query("g07_g10_group_recompute", s.with_(s.CANDIDATES) + """
SELECT group_id, CASE WHEN status = 'open' AND n = 0 THEN 'closed' ELSE status END AS status, n AS included, blocked, status = 'open' AND n > 0 AND NOT blocked AS approvable FROM (
 SELECT brand AS group_id, CASE WHEN brand LIKE '%1' THEN 'published' ELSE 'open' END AS status, count(*) FILTER (WHERE size > 30) AS n, coalesce(bool_or(id % 17 = 0) FILTER (WHERE size > 30), false) AS blocked
 FROM candidates GROUP BY 1)""")
def _(spark, sf):
    c = overlay.candidates(spark, sf)
    groups = c.select(F.col("brand").alias("group_id")).distinct().withColumn("status", F.when(F.col("group_id").endswith("1"), "published").otherwise("open"))
    members = c.select(F.col("brand").alias("group_id"), F.when(F.col("size") > 30, "included").otherwise("removed").alias("membership"), (F.col("id") % 17 == 0).alias("conflict"))
    return rv.recomputed(groups, members)


@query("g14_publication_queue", """
SELECT o_custkey AS id, max(o_orderkey) AS version_no FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
GROUP BY 1 HAVING arg_max(o_orderstatus, o_orderkey) = 'O'""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, "approved").otherwise("pending").alias("review"))
    versions = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version_no"), F.when(F.col("o_orderstatus") == "O", "draft").otherwise("published").alias("status"))
    return rv.publication_queue(c, versions)


@query("g15_fact_cards", """
SELECT l_suppkey AS group_id, l_returnflag AS fact_type, l_linestatus AS fact_key, arg_min(CAST(l_partkey AS VARCHAR), (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey) AS text,
 bool_and(l_quantity > 1) AS included, bool_or(l_tax > 0.07) AS conflict, count(*) AS sources FROM lineitem GROUP BY 1, 2, 3""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("group_id"), F.col("l_returnflag").alias("fact_type"), F.col("l_linestatus").alias("fact_key"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000000 + F.col("l_partkey")).alias("fact_id"),
        F.col("l_partkey").cast("string").alias("value"), (F.col("l_quantity") > 1).alias("selected"), (F.col("l_tax") > 0.07).alias("conflict"), F.col("l_orderkey").alias("source_id"))
    return rv.fact_cards(rows).withColumn("sources", F.size("sources"))


@query("g16_grouping_candidates", s.with_(s.CANDIDATES) + """
SELECT id FROM candidates WHERE size % 4 <> 0 AND size % 3 <> 0 AND NOT (brand LIKE '%1' AND id % 2 = 0) AND NOT (brand LIKE '%2' AND id % 2 = 0) AND id NOT IN (SELECT s_suppkey FROM supplier)""")
def _(spark, sf):
    c = overlay.candidates(spark, sf)
    review = F.when(F.col("size") % 4 == 0, "rejected").when(F.col("size") % 4 == 1, "needs_review").otherwise("pending")
    ready = c.select("id", review.alias("review"), F.when(F.col("size") % 3 == 0, "published").otherwise("draft").alias("state"))
    kind = F.when(F.col("brand").endswith("1"), "open").when(F.col("brand").endswith("2"), "published").otherwise("closed")
    canonical = table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("group_id"), F.col("s_suppkey").alias("canonical_id"), F.lit("closed").alias("status"))
    groups = c.select(F.col("brand").alias("group_id"), F.lit(None).cast("long").alias("canonical_id"), kind.alias("status")).distinct().unionByName(canonical)
    members = c.select(F.col("brand").alias("group_id"), "id", F.when(F.col("id") % 2 == 0, "included").otherwise("removed").alias("membership"))
    return rv.groupable(ready, groups, members).select("id")


@query("g17_merged_cases", s.with_(s.CANDIDATES) + """
SELECT group_id, case_id, row_number() OVER (PARTITION BY group_id ORDER BY first, case_id) - 1 AS case_position FROM (
 SELECT brand AS group_id, l_orderkey AS case_id, min(id * 100 + l_linenumber) AS first FROM candidates JOIN lineitem ON l_partkey = id GROUP BY 1, 2)""")
def _(spark, sf):
    m = overlay.candidates(spark, sf).select(F.col("brand").alias("group_id"), "id")
    cases = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("case_position"))
    return rv.merged_cases(m, cases)


@query("g19_event_append", """
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) + coalesce((SELECT count(*) FROM events k WHERE k.user_id = e.user_id AND k.event_type = 'view'), 0) AS seq
FROM events e WHERE event_type <> 'view'""")
def _(spark, sf):
    e = table(spark, sf, "events")
    known = e.where("event_type = 'view'").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("seq"))
    return rv.appended_events(known, e.where("event_type <> 'view'").select("event_id", "user_id"), "user_id", "event_id")


@query("c19_case_lookup", """
SELECT l_orderkey AS case_id, coalesce(min(l_linenumber) FILTER (WHERE l_returnflag = 'R'), min(l_linenumber)) AS line FROM lineitem GROUP BY 1""")
def _(spark, sf):
    name = F.concat(F.when(F.col("l_returnflag") == "R", "GROUP-").otherwise("CASE-"), "l_linenumber")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), name.alias("candidate_id"), F.col("l_linenumber").alias("id"))
    return rv.preferred_case(rows).select("case_id", F.split_part("candidate_id", F.lit("-"), F.lit(2)).cast("int").alias("line"))


@query("m08_review_events", """
SELECT p_partkey, 'p_brand' AS field, p_brand AS old, upper(p_brand) || '!' AS "new" FROM part WHERE p_size > 25
UNION ALL SELECT p_partkey, 'p_type', p_type, NULL FROM part WHERE p_size % 2 = 0
UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR), CAST(p_size + 1 AS VARCHAR) FROM part WHERE p_partkey % 10 = 0""")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    after = p.select("p_partkey", F.when(F.col("p_size") > 25, F.concat(F.upper("p_brand"), F.lit("!"))).otherwise(F.col("p_brand")).alias("p_brand"),
                     F.when(F.col("p_size") % 2 != 0, F.col("p_type")).alias("p_type"), F.when(F.col("p_partkey") % 10 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))
    return rv.changed_fields(p, after, "p_partkey", ["p_brand", "p_type", "p_size"])


@query("t06_limited_starts", """
SELECT event_id, greatest(max(came - i * 5) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING), 0) + i * 5 AS starts FROM (
 SELECT event_id, user_id, CAST(event_id % 100 AS DOUBLE) AS came, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 100, event_id) - 1 AS i FROM events)""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", (F.col("event_id") % 100).alias("at"))
    return w.limited_starts(e, "user_id", "at", "event_id", 12).select("event_id", "starts")


@query("t08_until_limited", """
SELECT event_id, CASE WHEN max(CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) = 1 THEN 'pending'
 WHEN event_type = 'error' THEN 'failed' ELSE 'saved' END AS outcome FROM events""")
def _(spark, sf):
    said = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 3 == 0, "HTTP 429").otherwise("HTTP 500"))
    return w.until_limited(table(spark, sf, "events").withColumn("error", said), "user_id", "event_id", "error").select("event_id", "outcome")


@query("t07_resumable_checkpoint", """
SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) OR doc_id % 5 = 0""")
def _(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), "text")
    done = rows.join(table(spark, sf, "labels"), "doc_id", "left_semi").withColumn("hash", F.when(F.col("doc_id") % 5 == 0, "older").otherwise(F.coalesce("hash", F.lit(""))))
    return w.unfinished(rows.withColumn("hash", F.coalesce("hash", F.lit(""))), done, ["doc_id", "hash"]).select("doc_id")


@query("s14_migrations", """
SELECT n_name AS name, sha256(n_name || ';') AS checksum, CASE n_nationkey % 3 WHEN 0 THEN 'apply' WHEN 1 THEN 'applied' ELSE 'mismatch' END AS state FROM nation""")
def _(spark, sf):
    n = table(spark, sf, "nation")
    sql = F.concat("n_name", F.lit(";"))
    known = n.where("n_nationkey % 3 <> 0").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 1, F.sha2(sql, 256)).otherwise("older").alias("checksum"))
    return w.migrations(n.select(F.col("n_name").alias("name"), sql.alias("sql")), known)


@query("w06_group_limit", s.with_(s.CANDIDATES) + """
SELECT id, first_value(id) OVER (PARTITION BY knowledge_key, (r - 1) // 50 ORDER BY r) AS seed FROM (
 SELECT id, knowledge_key, row_number() OVER (PARTITION BY knowledge_key ORDER BY frequency DESC, id) AS r FROM candidates)""")
def _(spark, sf):
    items = overlay.candidates(spark, sf)
    none = items.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false")
    return linkage.greedy(items, none, 50, "knowledge_key")


@query("w07_packed_turns", """
WITH RECURSIVE o AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
f AS (SELECT conv_id, r, turn, n AS used, 1 AS part FROM o WHERE r = 1
 UNION ALL SELECT o.conv_id, o.r, o.turn, CASE WHEN f.used > 0 AND f.used + o.n > 300 THEN o.n ELSE f.used + o.n END, CASE WHEN f.used > 0 AND f.used + o.n > 300 THEN f.part + 1 ELSE f.part END
 FROM f JOIN o ON o.conv_id = f.conv_id AND o.r = f.r + 1)
SELECT conv_id, turn, part FROM f""")
def _(spark, sf):
    m = table(spark, sf, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return d.packed_contexts(m, "conv_id", "turn", "n", 300)


@query("u01_recursive_union", s.with_(s.EDGES, """up AS (SELECT parent AS ancestor, child AS node, 1 AS depth FROM edges
 UNION ALL SELECT up.ancestor, e.child, up.depth + 1 FROM up JOIN edges e ON e.parent = up.node WHERE up.depth < 5)""", recursive=True) + "SELECT ancestor, node, depth FROM up")
def _(spark, sf):
    return h.closure(overlay.edges(spark, sf), 5).where("depth > 0")


@query("s01_dump_scan", "SELECT n_nationkey, n_name || '''s (' || n_regionkey || ', x)' AS said, n_regionkey FROM nation")
def _(spark, sf):
    said = F.concat("n_name", F.lit("''s ("), "n_regionkey", F.lit(", x)"))
    line = F.concat(F.lit('INSERT INTO "nation" VALUES('), "n_nationkey", F.lit(", '"), said, F.lit("', NULL, "), "n_regionkey", F.lit(");"))
    dump = table(spark, sf, "nation").select(line.alias("statement")).unionByName(spark.createDataFrame([("CREATE TABLE nation (x);",), ("INSERT INTO other VALUES(1);",)], "statement string"))
    rows = files.dump_rows(dump, "nation", ["n_nationkey", "said", "nothing", "n_regionkey"])
    return files.typed(rows.where("nothing is null").drop("nothing"), {"n_nationkey": "int", "n_regionkey": "int"})


@query("s02_typed_columns", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN true WHEN event_id % 3 = 1 THEN false END AS flag, CASE WHEN event_id % 5 <> 0 THEN user_id END AS owner, event_id % 4 <> 0 AS parsed FROM events""")
def _(spark, sf):
    i = F.col("event_id")
    text = table(spark, sf, "events").select(i.cast("string").alias("event_id"), F.when(i % 3 == 0, "1").when(i % 3 == 1, " No ").otherwise("perhaps").alias("flag"),
                                             F.when(i % 5 == 0, "none").otherwise(F.col("user_id").cast("string")).alias("user_id"), F.when(i % 4 == 0, "{broken").otherwise('{"k": 1}').alias("props"))
    out = files.typed(text, {"event_id": "long", "flag": "bool", "user_id": "long", "props": "json"}, {"user_id": "owner"})
    return out.select("event_id", "flag", "owner", F.col("props").isNotNull().alias("parsed"))


@query("s05_appended_checkpoint", "SELECT event_id, user_id FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, user_id FROM events WHERE event_type = 'click'")
def _(spark, sf):
    path = shared_path(spark, "checkpoint")
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    for kind in ("view", "click"):
        files.append_checkpoint(e.where(F.col("event_type") == kind).drop("event_type"), path)
    return spark.read.schema("event_id long, user_id long").json(path)


@query("s06_vector_cache", "SELECT vec_id, vec_id % 3 <> 0 AS cached, CASE WHEN vec_id % 3 <> 0 THEN round(list_sum(CAST(embedding AS DOUBLE[])), 4) END AS total FROM embeddings")
def _(spark, sf):
    path = shared_path(spark, "vectors")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("key"), "vec_id", F.col("embedding").alias("vector"))
    files.save_cache(e.where("vec_id % 7 = 0").select("key", "vector"), path)
    files.save_cache(e.where("vec_id % 3 <> 0").select("key", "vector"), path)  # the new cache takes the place of the old one
    have, missing = files.cached(e.select("key", "vec_id"), spark.read.parquet(path), "key")
    total = F.round(v.dot(F.col("vector"), F.transform("vector", lambda x: F.lit(1.0))), 4)
    return have.select("vec_id", F.lit(True).alias("cached"), total.alias("total")).unionByName(missing.select("vec_id", F.lit(False).alias("cached"), F.lit(None).cast("double").alias("total")))


@query("s11_slide_blocks", """
SELECT key, block_no, slide_no, block_type, section, text FROM (
 SELECT n_nationkey AS key, 1 AS block_no, 1 AS slide_no, 'heading' AS block_type, n_name AS section, n_name AS text FROM nation
 UNION ALL SELECT n_nationkey, 2, 1, 'paragraph', n_name, 'in ' || r_name || chr(10) || '<&> ' || n_regionkey FROM nation JOIN region ON r_regionkey = n_regionkey
 UNION ALL SELECT n_nationkey, 3, 1, 'note', n_name, 'said' FROM nation
 UNION ALL SELECT n_nationkey, 4, 2, 'other', 'Slide 2', '' FROM nation)""")
def _(spark, sf):
    @F.pandas_udf("binary")
    def made(name: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([slides.deck([(n, [b, "Notes: said"]), ("", [])]) for n, b in zip(name, body)])

    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = F.concat(F.lit("in "), "r_name", F.lit("\n<&> "), "n_regionkey")
    decks = n.select(F.col("n_nationkey").cast("long").alias("key"), made("n_name", body).alias("content"))
    return slides.slide_blocks(decks).select("key", "block_no", "slide_no", "block_type", "section", "text")


@query("r04_candidate_sources", """
SELECT doc_id AS knowledge_id, string_agg(CAST(source_id AS VARCHAR), ',' ORDER BY source_id) AS sources FROM (
 SELECT doc_id, doc_id * 10 AS source_id FROM labels WHERE quality = 1 AND doc_id % 4 <> 0 AND doc_id % 3 <> 0
 UNION ALL SELECT doc_id, doc_id * 10 + 1 FROM labels WHERE doc_id % 3 <> 0) GROUP BY 1""")
def _(spark, sf):
    la = table(spark, sf, "labels").withColumnRenamed("doc_id", "knowledge_id").withColumn("evidence_id", F.col("knowledge_id"))
    made = lambda n, resolution, on: la.select((F.col("knowledge_id") * 10 + n).alias("source_id"), "knowledge_id", "evidence_id", F.lit("manual").alias("source_kind"), F.lit("x").alias("excerpt"),
                                               F.lit("supports").alias("relation"), resolution.alias("resolution"), on.alias("active"))
    sources = made(0, F.when(F.col("quality") == 1, "accepted").otherwise("unresolved"), F.col("knowledge_id") % 4 != 0).unionByName(
        made(1, F.lit("accepted"), F.lit(True))).unionByName(made(2, F.lit("accepted"), F.lit(True)).withColumn("relation", F.lit("contradicts")))
    evidence = la.select("evidence_id", F.when(F.col("evidence_id") % 3 == 0, "redacted").otherwise("active").alias("status"), F.lit("l").alias("label"), F.lit("p").alias("locator")).distinct()
    out = r.answer_sources(sources, evidence)
    return out.select("knowledge_id", F.array_join(F.transform("sources", lambda x: x["source_id"].cast("string")), ",").alias("sources"))


@query("r08_published_knowledge", s.with_(s.KNOWLEDGE) + "SELECT id, entity_name FROM knowledge WHERE trust = 'user_confirmed' AND id % 3 <> 0")
def _(spark, sf):
    rows = overlay.knowledge(spark, sf).withColumn("publication", F.when(F.col("trust") == "user_confirmed", "published").otherwise("draft"))
    return r.usable_knowledge(rows.withColumn("answer_allowed", F.col("id") % 3 != 0)).select("id", "entity_name")


@query("r09_usable_memory", "SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) >= 3 AND conv_id % 2 = 0")
def _(spark, sf):
    m = table(spark, sf, "conversations").groupBy("conv_id").agg(F.when(F.count("*") >= 3, "verified").otherwise("ai_derived").alias("source_status"))
    return r.usable_memory(m.withColumn("answer_allowed", F.col("conv_id") % 2 == 0)).select("conv_id")


@query("r17_alias_keys", """
SELECT DISTINCT c_custkey AS qid, 'K' || (n_nationkey % 7) AS knowledge_key FROM customer JOIN nation ON contains(lower(c_mktsegment || ' in ' || (SELECT x.n_name FROM nation x WHERE x.n_nationkey = c_nationkey)), lower(n_name))
WHERE n_regionkey <> 2""")
def _(spark, sf):
    n = table(spark, sf, "nation")
    q = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("qid"), F.concat("c_mktsegment", F.lit(" in "), "n_name").alias("question"))
    aliases = n.select(F.col("n_name").alias("alias"), F.concat(F.lit("K"), F.col("n_nationkey") % 7).alias("knowledge_key"), (F.col("n_regionkey") != 2).alias("approved"))
    return r.alias_keys(q, aliases)


@query("d10_stored_diffs", s.with_(s.VERSIONS) + """
SELECT doc_id AS version_id, previous, CASE WHEN doc_id = previous THEN 'itself' WHEN NOT found THEN 'not_found' WHEN other THEN 'another_document' ELSE 'ok' END AS error,
 CASE WHEN doc_id <> previous AND found AND NOT other THEN 'lang,text' END AS changed FROM (
 SELECT v.doc_id, p.doc_id IS NOT NULL AS found, coalesce(p.source <> v.source, false) AS other, v.previous FROM (
  SELECT *, CASE WHEN doc_id % 5 = 0 THEN doc_id WHEN doc_id % 5 = 1 THEN -1 WHEN doc_id % 5 = 2 THEN doc_id - 1 ELSE previous_id END AS previous FROM versions WHERE previous_id IS NOT NULL) v
 LEFT JOIN documents p ON p.doc_id = v.previous)""")
def _(spark, sf):
    x = overlay.versions(spark, sf)
    i = F.col("doc_id")
    previous = F.when(i % 5 == 0, i).when(i % 5 == 1, F.lit(-1).cast("long")).when(i % 5 == 2, i - 1).otherwise(F.col("previous_id"))
    links = x.where("previous_id is not null").select(i.alias("version_id"), previous.alias("previous_id"))
    changes = x.select(i.alias("version_id"), F.explode(F.array(F.lit("text"), F.lit("lang"))).alias("section")).withColumn("change", F.lit("changed"))
    touched = x.select(i.alias("version_id"), i.alias("knowledge_id"))
    out = d.stored_diffs(x.select(i.alias("version_id"), F.col("source").alias("document_key")), links, changes, touched)
    return out.select("version_id", F.col("previous_id").alias("previous"), "error", F.array_join("changed", ",").alias("changed"))


@query("s12_persisted_counts", s.with_(s.BLOCKS) + """
SELECT doc_id AS version_id, count(DISTINCT md5(text)) AS blocks, count(DISTINCT CASE WHEN length(text) > 20 THEN md5(text) END) AS evidence, CAST(count(DISTINCT md5(text)) * 2 AS BIGINT) AS assets,
 count(DISTINCT CASE WHEN length(text) <= 5 THEN md5(text) END) AS needs_review FROM blocks GROUP BY 1""")
def _(spark, sf):
    b = overlay.blocks(spark, sf)
    rows = b.select(F.col("doc_id").alias("version_id"), F.md5("text").alias("block_key"), F.col("block_no").alias("ord"), F.lit(None).cast("int").alias("page_no"), F.col("block_no").alias("slide_no"),
                    F.when(F.length("text") > 20, F.col("text")).otherwise("").alias("text"), F.lit(2).cast("long").alias("n_assets"), F.when(F.length("text") <= 5, "short").otherwise("").alias("review_reason"))
    return d.persisted(rows)[1]


@query("q11_recent_failures", s.with_(s.RUNS) + """
SELECT run_id, CASE WHEN run_id % 4 = 0 THEN run_id + 7 END AS feedback_id, CASE WHEN run_id % 4 = 0 THEN 'wrong_scope' ELSE 'technical' END AS category FROM runs
WHERE status = 'failed' AND run_id % 3 <> 0 AND created_at >= (SELECT max(created_at) FROM runs) - INTERVAL 90 DAY ORDER BY run_id DESC LIMIT 200""")
def _(spark, sf):
    x = overlay.runs(spark, sf)
    runs = x.select("run_id", "status", F.when(F.col("status") == "failed", "service_error").otherwise("answered").alias("answer_status"), F.when(F.col("run_id") % 3 == 0, "pass").alias("verdict"),
                    F.col("created_at").alias("at"), F.lit(0).alias("n_candidates"))
    feedback = x.where("run_id % 4 = 0").select((F.col("run_id") + 7).alias("feedback_id"), "run_id", F.lit("wrong_scope").alias("kind"), F.lit("open").alias("status")).unionByName(
        x.select((F.col("run_id") + 9).alias("feedback_id"), "run_id", F.lit("missing").alias("kind"), F.lit("closed").alias("status"))).unionByName(
        x.where("run_id % 4 = 0").select((F.col("run_id") + 1).alias("feedback_id"), "run_id", F.lit("missing").alias("kind"), F.lit("open").alias("status")))
    return a.recent_failures(runs, feedback, x.agg(F.max("created_at")).scalar(), 365, 5000).select("run_id", "feedback_id", "category")


@query("q15_retests", "SELECT event_id AS retest_of, event_id + 1 AS feedback_id, 'asked ' || event_type AS question, 'feedback_id,lang,retest_of' AS keys FROM events WHERE event_id % 6 = 0")
def _(spark, sf):
    e = table(spark, sf, "events")
    runs = e.where("event_id % 2 = 0").select(F.col("event_id").alias("run_id"), F.concat(F.lit("asked "), "event_type").alias("question"), F.create_map(F.lit("lang"), F.lit("en"), F.lit("retest_of"), F.lit("0")).alias("context"))
    feedback = e.where("event_id % 3 = 0").select((F.col("event_id") + 1).alias("feedback_id"), F.col("event_id").alias("run_id"), F.lit("no, it is 7").alias("correction"))
    out = a.retests(feedback, runs)
    return out.select("retest_of", "feedback_id", "question", F.array_join(F.array_sort(F.map_keys("context")), ",").alias("keys"))


@query("g10_vote_errors", """
SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'missing' ELSE 'repeated' END AS error FROM part WHERE p_size % 5 = 0 OR p_size % 7 = 0 UNION ALL SELECT -s_suppkey - 1, 'unknown' FROM supplier""")
def _(spark, sf):
    x = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("cluster"), "p_size")
    once = x.where("p_size % 5 <> 0").select("cluster", "id")
    more = x.where("p_size % 7 = 0 and p_size % 5 <> 0").select(F.lit("again").alias("cluster"), "id")
    strange = table(spark, sf, "supplier").select(F.lit("odd").alias("cluster"), (-F.col("s_suppkey") - 1).alias("id"))
    return g.vote_errors(once.unionByName(more).unionByName(strange), x.select("id"))


@query("c14_imported_roles", """
SELECT conv_id AS case_id, CASE WHEN turn % 4 = 3 THEN -1 ELSE turn END AS message_index, arg_max(CASE WHEN role = 'system' THEN 'unconfirmed_claim' ELSE role END, turn) AS role FROM conversations GROUP BY 1, 2""")
def _(spark, sf):
    m = table(spark, sf, "conversations")
    rows = m.select(F.col("conv_id").alias("case_id"), F.when(F.col("turn") % 4 == 3, "x").otherwise(F.col("turn").cast("string")).alias("message_index"), F.col("turn").alias("seq"), "role", F.lit("r" * 500).alias("reason"))
    return w.imported_roles(rows, ("user", "assistant")).select("case_id", "message_index", "role")
