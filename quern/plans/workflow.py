"""Review workflow, queues, record checks and small lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import claims, text as t, vectors as v
from quern.operators import conversation as c, overlay, retrieval as r, workflow as w
from quern.plans import sql as s
from quern.plans.common import registry
from quern.plans.conversation import _WITH as THREADS, spoken
from quern.plans.text import ids
from quern.session import table

QUERIES, SQL, query = registry()


@query("f15_nfkc_names", "SELECT n_name, lower(replace(n_name, ' ', '')) AS name FROM nation")
def _(spark, sf):
    wide = F.translate("n_name", "ABCDEFG", "ＡＢＣＤＥＦＧ")
    return table(spark, sf, "nation").select("n_name", w.nfkc_name(F.concat(F.lit(" "), wide, F.lit("　"))).alias("name"))


@query("h08_explicit_chains", "SELECT n_name, r_name || '/' || n_name AS chain FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    said = F.when(F.col("n_nationkey") % 3 == 0, F.concat("n_name", F.lit(" belongs to "), "r_name", F.lit("."))).when(
        F.col("n_nationkey") % 3 == 1, F.concat("r_name", F.lit("'s "), "n_name")).otherwise(F.concat("r_name", F.lit(" > "), "n_name"))
    return n.select("n_name", F.array_join(w.explicit_chain(said), "/").alias("chain"))


@query("f08_retrieved_models", f"SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN {ids('p_brand')}[1] ELSE {ids('p_name || chr(32) || p_brand')}[1] END AS model FROM part")
def _(spark, sf):
    stated = F.when(F.col("p_size") % 3 == 0, F.try_element_at(t.identifiers(F.col("p_brand")), F.lit(1)))
    title = F.try_element_at(t.identifiers(F.concat_ws(" ", "p_name", "p_brand")), F.lit(1))
    return table(spark, sf, "part").select("p_partkey", F.coalesce(stated, title).alias("model"))


@query("c15_c17_packages", THREADS + " SELECT conv_id, count(DISTINCT text) AS evidence, min(left(text, 60)) AS first_text FROM roles WHERE trim(text) <> '' GROUP BY 1 HAVING count(*) >= 2")
def _(spark, sf):
    m = spoken(spark, sf).where(F.trim("text") != "")
    return m.groupBy("conv_id").agg(F.count_distinct("text").alias("evidence"), F.min(F.left("text", F.lit(60))).alias("first_text"), F.count("*").alias("n")).where("n >= 2").drop("n")


@query("c01_customer_turns", THREADS + " SELECT conv_id, count(*) FILTER (WHERE customer) AS customer_turns FROM roles GROUP BY 1")
def _(spark, sf):
    return spoken(spark, sf).groupBy("conv_id").agg(F.count_if(c.is_customer()).alias("customer_turns"))


@query("m09_pending_proposals", s.with_(s.RUNS) + "SELECT user_id, run_id, knowledge_id FROM runs WHERE status = 'needs_clarification' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY knowledge_id IS NULL, run_id DESC) = 1")
def _(spark, sf):
    p = overlay.runs(spark, sf).where("status = 'needs_clarification'")
    return w.next_item(p, "user_id", [F.col("knowledge_id").isNull(), F.desc("run_id")]).select("user_id", "run_id", "knowledge_id")


@query("m12_next_question", s.with_(s.RUNS) + "SELECT user_id, run_id, status FROM runs WHERE status IN ('needs_clarification', 'started') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY status = 'started', created_at, run_id) = 1")
def _(spark, sf):
    p = overlay.runs(spark, sf).where(F.col("status").isin("needs_clarification", "started"))
    return w.next_item(p, "user_id", [F.col("status") == "started", F.col("created_at"), F.col("run_id")]).select("user_id", "run_id", "status")


_MOVES = {"purchase": ("pending", "confirmed"), "error": ("pending", "rejected"), "click": ("paused", "pending")}


@query("m13_t09_transitions", "SELECT event_id, CASE WHEN event_type='purchase' AND st='pending' THEN 'confirmed' WHEN event_type='error' AND st='pending' THEN 'rejected' WHEN event_type='click' AND st='paused' THEN 'pending' ELSE st END AS state FROM (SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN 'pending' ELSE 'paused' END AS st FROM events)")
def _(spark, sf):
    state = F.when(F.col("event_id") % 2 == 0, "pending").otherwise("paused")
    return table(spark, sf, "events").select("event_id", w.transition(state, F.col("event_type"), _MOVES).alias("state"))


_LEAST = r"""CASE WHEN trim(text, E' \t\n\r\f') = '' THEN 0 ELSE greatest(1,
 len(regexp_extract_all(trim(text, E' \t\n\r\f'), '(?:^|[;；\n])\s*[^;；\n:：]{1,80}[：:]\s*[^;；\n]+')),
 len(list_filter(regexp_split_to_array(trim(text, E' \t\n\r\f'), '[;；\n]+'), lambda p: trim(p) <> '')),
 len(regexp_extract_all(text, '[。！？!?]'))) END"""


@query("f23_least_claims", f"SELECT doc_id, {_LEAST} AS n FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", claims.least_claims(F.col("text")).alias("n"))


@query("m05_m15_extraction_coverage", f"""SELECT doc_id, CASE WHEN n_lines = 0 THEN NULL WHEN n_lines < least THEN 'too_few_claims' END AS error FROM (
 SELECT doc_id, {_LEAST} AS least, len(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> '')) AS n_lines FROM documents)""")
def _(spark, sf):
    """Each line as a claim with a fact of its own: right unless a text shows more claims than lines."""
    d = table(spark, sf, "documents").select("doc_id", "text", F.filter(F.split("text", "\n"), lambda p: F.trim(p) != "").alias("lines"))
    said = F.transform("lines", lambda x, i: F.struct(x.alias("text"), F.array(i).alias("units"), F.lit("knowledge").alias("disposition")))
    error = claims.coverage_error(F.col("text"), F.col("lines"), F.lit(True), F.array().cast("array<string>"), said)
    return d.select("doc_id", F.when(F.size("lines") > 0, error).alias("error"))


@query("m18_session_reuse", "SELECT c.c_custkey, coalesce(o.m, -c.c_custkey) AS session_id, o.m IS NULL AS opened FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS m FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) o ON o.o_custkey = c.c_custkey")
def _(spark, sf):
    active = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("session_id"))
    return w.reused_or_new(table(spark, sf, "customer").select("c_custkey", (-F.col("c_custkey")).alias("request_id")), active, "c_custkey")


@query("g17_group_members", s.with_(s.CANDIDATES) + "SELECT id, knowledge_key, first AS canonical, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM (SELECT c.id, c.knowledge_key, m.first, list_distinct(string_split(c.title, ' ')) AS a, list_distinct(string_split(m.title, ' ')) AS b FROM candidates c JOIN (SELECT knowledge_key, min(id) AS first, arg_min(title, id) AS title FROM candidates GROUP BY 1) m USING (knowledge_key))")
def _(spark, sf):
    x = overlay.candidates(spark, sf)
    m = x.groupBy("knowledge_key").agg(F.min(F.struct("id", "title")).alias("m")).select("knowledge_key", F.col("m.id").alias("canonical"), F.col("m.title").alias("first_title"))
    words = lambda col: F.array_distinct(F.split(col, " "))
    return x.join(m, "knowledge_key").select("id", "knowledge_key", "canonical", F.round(v.jaccard(words("title"), words("first_title")), 6).alias("similarity"))


@query("j09_j10_blocked_pairs", "SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return w.repeated_pairs(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


@query("j13_p06_key_lookup", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def _(spark, sf):
    cust = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey", "c_name")
    return table(spark, sf, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("o01_o07_latest_suggestions", "SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500) ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, sf):
    latest = table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(500)
    return latest.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("o08_stable_ties", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS place FROM lineitem")
def _(spark, sf):
    win = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(win).alias("place"))


@query("p09_p10_status_mapping", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'partial' END AS status, nullif(trim(o_orderpriority), '5-LOW') IS DISTINCT FROM NULL AS urgent FROM orders")
def _(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in {"F": "finished", "O": "open"}.items() for x in kv])
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(names[F.col("o_orderstatus")], F.lit("partial")).alias("status"), F.nullif(F.trim("o_orderpriority"), F.lit("5-LOW")).isNotNull().alias("urgent"))


@query("p13_qualified_blocks", s.with_(s.BLOCKS) + "SELECT b.doc_id, b.block_no FROM blocks b JOIN labels l ON l.doc_id = b.doc_id WHERE l.quality = 1 AND coalesce(l.toxic, 0) = 0 AND trim(b.text) <> ''")
def _(spark, sf):
    ok = table(spark, sf, "labels").where("quality = 1 and coalesce(toxic, 0) = 0")
    return overlay.blocks(spark, sf).where(F.trim("text") != "").join(ok.select("doc_id"), "doc_id").select("doc_id", "block_no")


@query("s04_record_checks", "SELECT event_id, CASE WHEN props IS NULL THEN 'missing_field' WHEN c > 1 THEN 'repeated_key' ELSE 'ok' END AS state FROM (SELECT event_id, props, count(*) OVER (PARTITION BY event_id) AS c FROM events)")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("c", F.count("*").over(Window.partitionBy("event_id")))
    return e.select("event_id", w.first_error([("missing_field", F.col("props").isNull()), ("repeated_key", F.col("c") > 1)]).alias("state"))


@query("s13_s19_filtered_lists", s.with_(s.VERSIONS) + "SELECT source, doc_id FROM versions WHERE lang = 'de' QUALIFY row_number() OVER (PARTITION BY source ORDER BY version_no DESC) <= 5")
def _(spark, sf):
    x = overlay.versions(spark, sf).where("lang = 'de'")
    return r.top(x, ["source"], [F.desc("version_no")], 5).select("source", "doc_id")


@query("w03_question_segments", THREADS + " SELECT conv_id, idx, (SELECT min(n.idx) FROM roles n WHERE n.conv_id = q.conv_id AND n.idx > q.idx AND n.customer AND n.asks) AS next_question FROM roles q WHERE customer AND asks")
def _(spark, sf):
    win = Window.partitionBy("conv_id").orderBy("idx")
    asks = spoken(spark, sf).where(c.is_customer() & c.is_question(F.trim("text")))
    return asks.select("conv_id", "idx", F.lead("idx").over(win).alias("next_question"))


@query("u05_three_way_diff", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS change FROM (SELECT p_partkey AS k, p_size AS h FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT p_partkey AS k, p_size + (p_partkey % 5 = 0)::INT AS h FROM part WHERE p_partkey % 4 <> 0) b ON a.k = b.k")
def _(spark, sf):
    p = table(spark, sf, "part")
    a = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("ka"), F.col("p_size").alias("ha"))
    b = p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("kb"), (F.col("p_size") + (F.col("p_partkey") % 5 == 0).cast("int")).alias("hb"))
    change = F.when(F.col("ka").isNull(), "added").when(F.col("kb").isNull(), "removed").when(F.col("ha") != F.col("hb"), "changed").otherwise("same")
    return a.join(b, F.col("ka") == F.col("kb"), "full").select(F.coalesce("ka", "kb").alias("k"), change.alias("change"))


@query("f20_f19_script_share", "SELECT doc_id, round(len(regexp_extract_all(text, '[A-Za-z]'))::DOUBLE / greatest(length(text), 1), 6) AS latin, contains(lower(text), 'how') AS asks FROM documents")
def _(spark, sf):
    latin = F.regexp_count("text", F.lit("[A-Za-z]")) / F.greatest(F.length("text"), F.lit(1))
    return table(spark, sf, "documents").select("doc_id", F.round(latin, 6).alias("latin"), F.contains(F.lower("text"), F.lit("how")).alias("asks"))


_OPEN, _INDIVIDUAL = (" OR ".join(f"contains(lower(text), '{w}')" for w in words) for words in (claims.OPEN_LIST, claims.INDIVIDUAL))


@query("f35_individual_confirmation", f"SELECT doc_id, ({_OPEN}) AS open_list, ({_INDIVIDUAL}) AS individual FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", claims.open_list(F.col("text")).alias("open_list"), claims.needs_individual(F.col("text")).alias("individual"))


@query("f51_dot_or_lexical", "SELECT vec_id, round(coalesce(CASE WHEN vec_id % 4 > 0 THEN list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) END, 0.25), 6) AS score FROM embeddings")
def _(spark, sf):
    d = F.when(F.col("vec_id") % 4 > 0, v.dot(F.col("embedding"), F.col("embedding")))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.coalesce(d, F.lit(0.25)), 6).alias("score"))


@query("a27_sanity_checks", s.with_(s.CANDIDATES) + "SELECT count(*) = count(DISTINCT id) AS unique_ids, min(frequency) >= 0 AS non_negative, count(*) FILTER (WHERE knowledge_key IS NULL) = 0 AS keyed FROM candidates")
def _(spark, sf):
    return overlay.candidates(spark, sf).agg((F.count("*") == F.count_distinct("id")).alias("unique_ids"), (F.min("frequency") >= 0).alias("non_negative"), (F.count_if(F.col("knowledge_key").isNull()) == 0).alias("keyed"))
