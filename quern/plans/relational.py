"""Joins, aggregations, windows, orders, pages and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import overlay
from quern.plans import sql as s
from quern.plans.common import registry
from quern.session import table

QUERIES, SQL, query = registry()

STATUSES = ["started", "answered", "needs_clarification", "no_knowledge", "failed", "cancelled"]


@query("a01_status_counts_zero_filled", s.with_(s.RUNS) + "SELECT v.status, count(r.run_id) AS n FROM (SELECT unnest(['" + "','".join(STATUSES) + "']) AS status) v LEFT JOIN runs r ON r.status = v.status GROUP BY 1")
def _(spark, sf):
    known = spark.createDataFrame([(x,) for x in STATUSES], "status string")
    counts = overlay.runs(spark, sf).groupBy("status").agg(F.count("*").alias("n"))
    return known.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("a02_filtered_counts", "SELECT user_id, count(*) FILTER (WHERE event_type='error') AS errors, count(*) FILTER (WHERE value > 50) AS large, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 50).alias("large"), F.count("*").alias("n"))


@query("a03_a24_coverage", "SELECT count(DISTINCT d.doc_id) AS docs, count(DISTINCT l.doc_id) AS covered, count(DISTINCT d.doc_id) - count(DISTINCT l.doc_id) AS uncovered FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("l"))
    a = d.join(lab, F.col("doc_id") == F.col("l"), "left").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("l").alias("covered"))
    return a.withColumn("uncovered", F.col("docs") - F.col("covered"))


@query("a04_sum_with_coalesce", "SELECT p_partkey, coalesce(sum(l_quantity), 0) AS quantity FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'R' GROUP BY 1")
def _(spark, sf):
    r = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    return table(spark, sf, "part").join(r, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("q", F.lit(0.0)).alias("quantity"))


@query("a05_left_join_counts", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("a06_ordered_string_agg", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS nations FROM nation GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "; ").alias("nations"))


@query("a07_ordered_structs", "SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY 1")
def _(spark, sf):
    return (table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
            .select("l_orderkey", F.array_join(F.transform("x", lambda r: F.concat_ws(":", r["l_linenumber"], r["l_partkey"])), ",").alias("lines")))


@query("a08_min_and_any", "SELECT lower(p_brand) AS brand, min(p_partkey) AS first_id, bool_or(p_size > 45) AS any_large FROM part GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "part").groupBy(F.lower("p_brand").alias("brand")).agg(F.min("p_partkey").alias("first_id"), F.bool_or(F.col("p_size") > 45).alias("any_large"))


@query("a09_distinct_on_latest", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def _(spark, sf):
    return (table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("m"))
            .select("o_custkey", "m.o_orderkey", "m.o_orderstatus"))


@query("a10_preferred_then_newest", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority='1-URGENT') DESC, o_orderkey DESC) = 1")
def _(spark, sf):
    preferred = (F.col("o_orderpriority") == "1-URGENT").cast("int")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.struct(preferred.alias("p"), F.col("o_orderkey").alias("k")))["k"].alias("o_orderkey"))


@query("a11_latest_wins", s.with_(s.RUNS) + "SELECT user_id, arg_max(status, run_id) AS status FROM runs GROUP BY 1")
def _(spark, sf):
    return overlay.runs(spark, sf).groupBy("user_id").agg(F.max_by("status", "run_id").alias("status"))


@query("a12_distribution_maps", "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS distribution FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def _(spark, sf):
    n = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return (n.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "n"))).alias("l"))
            .select("user_id", F.array_join(F.transform("l", lambda x: F.concat_ws("=", x["event_type"], x["n"])), ",").alias("distribution")))


@query("a13_distinct_casefold_sort", "SELECT c_nationkey, string_agg(m, ',' ORDER BY lower(m), m) AS segments FROM (SELECT DISTINCT c_nationkey, c_mktsegment AS m FROM customer) GROUP BY 1")
def _(spark, sf):
    keyed = F.transform(F.collect_set("c_mktsegment"), lambda x: F.struct(F.lower(x).alias("l"), x.alias("v")))
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(keyed), lambda x: x["v"]), ",").alias("segments"))


@query("a14_key_groups", s.with_(s.CANDIDATES) + "SELECT knowledge_key, count(DISTINCT id) AS frequency, array_to_string(list_slice(list_sort(list(DISTINCT title)), 1, 3), '|') AS titles FROM candidates GROUP BY 1")
def _(spark, sf):
    return overlay.candidates(spark, sf).groupBy("knowledge_key").agg(F.count_distinct("id").alias("frequency"), F.array_join(F.slice(F.array_sort(F.collect_set("title")), 1, 3), "|").alias("titles"))


@query("a15_median_and_passes", "SELECT event_type, round(median(value), 6) AS median_value, count(*) FILTER (WHERE value >= 50) AS passes, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median_value"), F.count_if(F.col("value") >= 50).alias("passes"), F.count("*").alias("n"))


@query("a20_hit_at_k", "SELECT o_custkey, hit5, hit10 FROM (SELECT o_custkey, list_contains(list_slice(k, 1, 5), o_custkey % 7) AS hit5, list_contains(list_slice(k, 1, 10), o_custkey % 7) AS hit10 FROM (SELECT o_custkey, list(o_orderkey % 7 ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders GROUP BY 1))")
def _(spark, sf):
    k = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), F.col("o_orderkey").alias("k")))), lambda x: x["k"] % 7)
    hits = table(spark, sf, "orders").groupBy("o_custkey").agg(k.alias("k"))
    return hits.select("o_custkey", *[F.array_contains(F.slice("k", 1, n), F.col("o_custkey") % 7).alias(f"hit{n}") for n in (5, 10)])


@query("a21_status_pivot", s.with_(s.RUNS) + "SELECT event_type, count(*) FILTER (WHERE status='answered') AS answered, count(*) FILTER (WHERE status='failed') AS failed, count(*) FILTER (WHERE status='started') AS started FROM runs GROUP BY 1")
def _(spark, sf):
    p = overlay.runs(spark, sf).groupBy("event_type").pivot("status", ["answered", "failed", "started"]).count()
    return p.select("event_type", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("answered", "failed", "started")])


@query("a25_batch_status", "SELECT user_id, CASE WHEN bool_or(event_type='error') THEN 'failed' WHEN bool_or(event_type='click') THEN 'unclear' WHEN count(*) FILTER (WHERE event_type='purchase') > 0 THEN 'clear' ELSE 'completed' END AS status FROM events GROUP BY 1")
def _(spark, sf):
    has = lambda x: F.count_if(F.col("event_type") == x) > 0
    return table(spark, sf, "events").groupBy("user_id").agg(F.when(has("error"), "failed").when(has("click"), "unclear").when(has("purchase"), "clear").otherwise("completed").alias("status"))


@query("a26_frequency_histogram", s.with_(s.CANDIDATES) + "SELECT count(*) FILTER (WHERE n=1) AS singletons, count(*) FILTER (WHERE n>=2) AS at_least_2, count(*) FILTER (WHERE n>=3) AS at_least_3, count(*) FILTER (WHERE n>=5) AS at_least_5, count(*) FILTER (WHERE n>=10) AS at_least_10, max(n) AS most FROM (SELECT knowledge_key, count(*) AS n FROM candidates GROUP BY 1)")
def _(spark, sf):
    n = overlay.candidates(spark, sf).groupBy("knowledge_key").agg(F.count("*").alias("n"))
    return n.agg(F.count_if(F.col("n") == 1).alias("singletons"), *[F.count_if(F.col("n") >= k).alias(f"at_least_{k}") for k in (2, 3, 5, 10)], F.max("n").alias("most"))


@query("w01_renumber_positions", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey) - 1 AS position FROM lineitem")
def _(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_linenumber"), "l_partkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.row_number().over(w) - 1).alias("position"))


@query("w05_next_sequence", "SELECT conv_id, coalesce(max(turn), 0) + 1 AS next_turn FROM conversations GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg((F.coalesce(F.max("turn"), F.lit(0)) + 1).alias("next_turn"))


@query("w09_ordinal_labels", "SELECT n_name, 'TC-' || lpad(CAST(row_number() OVER (ORDER BY n_name) AS VARCHAR), 3, '0') AS topic FROM nation")
def _(spark, sf):
    return table(spark, sf, "nation").select("n_name", F.concat(F.lit("TC-"), F.lpad(F.row_number().over(Window.orderBy("n_name")).cast("string"), 3, "0")).alias("topic"))


@query("j06_first_after", "SELECT u.conv_id, u.turn, min(a.turn) AS answer_turn FROM conversations u LEFT JOIN conversations a ON a.conv_id=u.conv_id AND a.turn > u.turn AND a.role='assistant' WHERE u.role='user' GROUP BY 1, 2")
def _(spark, sf):
    after = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    following = F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(after)
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", following.alias("answer_turn")).where("role = 'user'").drop("role")


@query("j07_previous_next", "SELECT doc_id, lag(doc_id) OVER w AS previous_id, lead(doc_id) OVER w AS next_id FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def _(spark, sf):
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf, "documents").select("doc_id", F.lag("doc_id").over(w).alias("previous_id"), F.lead("doc_id").over(w).alias("next_id"))


@query("j08_scalar_subquery", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS largest FROM customer")
def _(spark, sf):
    for name in ("customer", "orders"):
        table(spark, sf, name).createOrReplaceTempView(f"__{name}")
    return spark.sql("SELECT c_custkey, (SELECT max(o_totalprice) FROM __orders WHERE o_custkey = c_custkey) AS largest FROM __customer")


@query("j03_j04_semi_anti", "SELECT c_custkey, 'with' AS kind FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='F') UNION ALL SELECT c_custkey, 'without' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='F')")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    on = F.col("c_custkey") == F.col("o_custkey")
    return c.join(o, on, "left_semi").withColumn("kind", F.lit("with")).unionByName(c.join(o, on, "left_anti").withColumn("kind", F.lit("without")))


@query("j01_three_tables", "SELECT n_name, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1, 2")
def _(spark, sf):
    o, c, n = (table(spark, sf, x) for x in ("orders", "customer", "nation"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("j02_left_display_name", "SELECT s_suppkey, coalesce(n_name, 'unknown') AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 2 = 0")
def _(spark, sf):
    n = table(spark, sf, "nation").where("n_nationkey % 2 = 0")
    return table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


@query("j11_unnest_ordinality", s.with_(s.BLOCKS) + "SELECT doc_id, block_no, length(text) AS n FROM blocks")
def _(spark, sf):
    return overlay.blocks(spark, sf).select("doc_id", "block_no", F.length("text").alias("n"))


@query("j12_update_from_join", "SELECT s_suppkey, CASE WHEN m IS NOT NULL THEN m ELSE s_acctbal END AS balance FROM supplier LEFT JOIN (SELECT l_suppkey, max(l_quantity) AS m FROM lineitem WHERE l_returnflag='A' GROUP BY 1) x ON l_suppkey = s_suppkey")
def _(spark, sf):
    m = table(spark, sf, "lineitem").where("l_returnflag = 'A'").groupBy("l_suppkey").agg(F.max("l_quantity").alias("m"))
    return table(spark, sf, "supplier").join(m, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("s_suppkey", F.coalesce("m", "s_acctbal").alias("balance"))


@query("o03_page_with_total", "SELECT o_orderkey, total, pages FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 25.0) AS BIGINT) AS pages FROM orders) WHERE r BETWEEN 51 AND 75")
def _(spark, sf):
    o = table(spark, sf, "orders")
    total = o.agg(F.count("*")).scalar()
    page = o.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25)
    return page.select("o_orderkey", total.alias("total"), F.ceil(total / 25).alias("pages"))


@query("o02_o04_ranked_queue", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, nullif(o_totalprice > 100000, false) DESC NULLS LAST, o_orderkey) AS place FROM orders")
def _(spark, sf):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    large = F.when(F.col("o_totalprice") > 100000, True)
    w = Window.partitionBy("o_custkey").orderBy(rank, large.desc_nulls_last(), "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).alias("place"))


@query("o05_topk_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def _(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf, "lineitem").withColumn("r", F.row_number().over(w)).where("r <= 3").select("l_suppkey", "l_orderkey", "l_linenumber")


@query("p03_search_ilike", "SELECT doc_id FROM documents WHERE text ILIKE '%mit license%' OR source ILIKE 'SRC1%'")
def _(spark, sf):
    return table(spark, sf, "documents").where(F.col("text").ilike("%mit license%") | F.col("source").ilike("SRC1%")).select("doc_id")


@query("p04_like_any", "SELECT p_partkey FROM part WHERE upper(p_name) LIKE '%A_%' OR upper(p_type) LIKE '%STEEL%'")
def _(spark, sf):
    return table(spark, sf, "part").where("upper(p_name) like any ('%A_%') or upper(p_type) like any ('%STEEL%')").select("p_partkey")


@query("p05_json_membership", "SELECT event_id FROM events WHERE CAST(props->>'$.k' AS BIGINT) IN (1, 5, 9)")
def _(spark, sf):
    return table(spark, sf, "events").where(F.get_json_object("props", "$.k").cast("long").isin(1, 5, 9)).select("event_id")


@query("p07_rolling_days", "SELECT user_id, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def _(spark, sf):
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts")).scalar()
    return e.where(F.col("ts") > last - F.expr("interval 7 days")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("p08_t04_liveness", "SELECT user_id, epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) <= 86400999999 AS alive FROM events GROUP BY 1")
def _(spark, sf):
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts")).scalar()
    seen = e.groupBy("user_id").agg(F.max("ts").alias("seen"))
    return seen.select("user_id", (F.unix_micros(last.cast("timestamp")) - F.unix_micros(F.col("seen").cast("timestamp")) <= 86_400_999_999).alias("alive"))


@query("u04_first_seen_dedup", "SELECT lower(p_name) AS k, arg_min(p_name, p_partkey) AS shown, count(*) AS n FROM part GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "part").groupBy(F.lower("p_name").alias("k")).agg(F.min_by("p_name", "p_partkey").alias("shown"), F.count("*").alias("n"))


@query("u02_u03_token_sets", "SELECT a.p_partkey, len(list_intersect(x, y)) AS both, len(list_distinct(list_concat(x, y))) AS either FROM (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS x, list_distinct(string_split(p_type, ' ')) AS y FROM part) a")
def _(spark, sf):
    x, y = F.split("p_name", " "), F.split("p_type", " ")
    return table(spark, sf, "part").select("p_partkey", F.size(F.array_intersect(x, y)).cast("long").alias("both"), F.size(F.array_union(x, y)).cast("long").alias("either"))
