"""Hierarchy queries over region, nation, customer and supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import hierarchy as h, overlay
from quern.plans import sql as s
from quern.plans.common import registry
from quern.session import table

QUERIES, SQL, query = registry()

_CLOSURE = """closure AS (SELECT node AS ancestor, node, 0 AS depth FROM (SELECT parent AS node FROM edges UNION SELECT child FROM edges)
 UNION ALL SELECT c.ancestor, e.child, c.depth + 1 FROM closure c JOIN edges e ON e.parent = c.node WHERE c.depth < 5)"""
_WITH = s.with_(s.EDGES, _CLOSURE, recursive=True)


@query("h01_entity_subtree", _WITH + "SELECT node, depth FROM closure WHERE ancestor = 'R1'")
def _(spark, sf):
    return h.subtree(overlay.edges(spark, sf), "R1")


@query("h02_ancestors", _WITH + "SELECT node, ancestor, depth FROM closure WHERE depth > 0")
def _(spark, sf):
    return h.closure(overlay.edges(spark, sf), 5).where("depth > 0").select("node", "ancestor", "depth")


_MOVES = "(SELECT 'N'||(c_custkey % 25) AS parent, 'R'||(c_custkey % 5) AS child FROM customer UNION SELECT 'C'||c_custkey, 'N'||(c_custkey % 25) FROM customer)"


@query("h03_would_create_cycle", _WITH + f"SELECT parent, child, EXISTS (SELECT 1 FROM closure c WHERE c.ancestor = m.child AND c.node = m.parent) AS would_cycle FROM {_MOVES} m")
def _(spark, sf):
    c = table(spark, sf, "customer")
    moves = c.select(F.concat(F.lit("N"), F.col("c_custkey") % 25).alias("parent"), F.concat(F.lit("R"), F.col("c_custkey") % 5).alias("child")).unionByName(
        c.select(F.concat(F.lit("C"), "c_custkey").alias("parent"), F.concat(F.lit("N"), F.col("c_custkey") % 25).alias("child"))).distinct()
    return h.would_cycle(overlay.edges(spark, sf), moves)


@query("h04_h06_subtree_counts", _WITH + "SELECT ancestor AS node, coalesce(CAST(sum(n) AS BIGINT), 0) AS total, coalesce(sum(n), 0) = 0 AS prunable FROM closure LEFT JOIN (SELECT 'C'||o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) ON k = node GROUP BY 1")
def _(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.concat(F.lit("C"), "o_custkey").alias("node")).agg(F.count("*").alias("n"))
    return h.subtree_counts(overlay.edges(spark, sf), n)


@query("h05_cycle_check", _WITH + "SELECT DISTINCT node FROM closure WHERE ancestor = node AND depth > 0")
def _(spark, sf):
    return h.cycles(overlay.edges(spark, sf))


@query("h07_neighbourhood", s.with_(s.EDGES) + """SELECT child AS node, 'parent' AS kind, parent AS other FROM edges
 UNION ALL SELECT parent, 'child', child FROM edges QUALIFY row_number() OVER (PARTITION BY parent ORDER BY child) <= 8
 UNION ALL SELECT a.child, 'sibling', b.child FROM edges a JOIN edges b ON a.parent = b.parent AND a.child <> b.child QUALIFY row_number() OVER (PARTITION BY a.child ORDER BY b.child) <= 8""")
def _(spark, sf):
    return h.neighbourhood(overlay.edges(spark, sf))


@query("inv_one_active_parent", s.with_(s.EDGES) + "SELECT child, count(*) AS n FROM edges GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    return overlay.edges(spark, sf).groupBy("child").agg(F.count("*").alias("n")).where("n > 1")


@query("h11_name_candidates", "SELECT n_name, r_name FROM nation, region WHERE contains(lower(n_name), lower(left(r_name, 1))) QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY r_name) <= 8")
def _(spark, sf):
    from quern.operators.retrieval import contained, top

    r = table(spark, sf, "region").select("r_name", F.lower(F.left("r_name", F.lit(1))).alias("initial"))
    found = contained(table(spark, sf, "nation"), "n_name", "n_name", r.select("initial").distinct(), "initial")
    return top(found.join(r, "initial"), ["n_name"], [F.asc("r_name")], 8).select("n_name", "r_name")


_CHANGES = """changes AS (SELECT 'N'||n_nationkey AS node, 'R'||((n_regionkey + 1) % 5) AS parent FROM nation WHERE n_nationkey % 3 = 0
 UNION ALL SELECT 'C'||c_custkey, 'N'||((c_nationkey + 7) % 25) FROM customer WHERE c_acctbal < 0
 UNION ALL SELECT 'S'||s_suppkey, 'C'||s_suppkey FROM supplier WHERE s_acctbal > 5000)"""
_AFTER = """after AS (SELECT coalesce(c.parent, e.parent) AS parent, child FROM edges e LEFT JOIN changes c ON c.node = e.child),
walk AS (SELECT node AS ancestor, node, 0 AS depth FROM (SELECT parent AS node FROM edges UNION SELECT child FROM edges)
 UNION ALL SELECT w.ancestor, a.child, w.depth + 1 FROM walk w JOIN after a ON a.parent = w.node)"""


@query("h10_closure_after_moves", s.with_(s.EDGES, _CHANGES, _AFTER, recursive=True) + "SELECT ancestor, node, depth FROM walk")
def _(spark, sf):
    """Nations change region, customers in debt change nation, and richer suppliers come under a customer."""
    n, c, u = (table(spark, sf, name) for name in ("nation", "customer", "supplier"))
    moves = (n.where("n_nationkey % 3 = 0").selectExpr("concat('N', n_nationkey) AS node", "concat('R', (n_regionkey + 1) % 5) AS parent")
             .unionByName(c.where("c_acctbal < 0").selectExpr("concat('C', c_custkey) AS node", "concat('N', (c_nationkey + 7) % 25) AS parent"))
             .unionByName(u.where("s_acctbal > 5000").selectExpr("concat('S', s_suppkey) AS node", "concat('C', s_suppkey) AS parent")))
    return h.moved(h.closure(overlay.edges(spark, sf)), moves)
