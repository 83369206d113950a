"""Grouping queries over parts and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import vectors as v
from quern.operators import grouping as g, linkage, overlay, pivots
from quern.plans import sql as s
from quern.plans.common import registry
from quern.session import table

QUERIES, SQL, query = registry()

_T = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> ''))"
_PAIRS = f"""t AS (SELECT id, brand, {_T.format('title')} AS t FROM candidates),
 prs AS (SELECT a, b, n_shared, n_shared / (na + nb - n_shared) AS jaccard FROM (SELECT x.id AS a, y.id AS b, len(list_intersect(x.t, y.t)) AS n_shared, len(x.t) AS na, len(y.t) AS nb FROM t x JOIN t y ON x.brand = y.brand AND x.id < y.id) WHERE n_shared >= 2 AND n_shared / (na + nb - n_shared) >= 0.3)"""


@query("g02_pair_predicate", s.with_(s.CANDIDATES, _PAIRS) + "SELECT a, b, n_shared, round(jaccard, 6) AS jaccard FROM prs")
def _(spark, sf):
    return g.pairs(overlay.candidates(spark, sf), "brand").withColumn("jaccard", F.round("jaccard", 6))


@query("g03_greedy_groups")
def _(spark, sf):
    """Items of one knowledge_key or near titles of one brand. Order-dependent; SQL has no form for it."""
    items, linked = g.alike(overlay.candidates(spark, sf), "brand", 0.5)
    return linkage.greedy(items, linked, key="knowledge_key", by="class")


_CLAIMS = "claims AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'is not ' || p_type ELSE 'is ' || p_type END AS text FROM part)"


@query("g05_contradictions", s.with_(_CLAIMS) + r"SELECT trim(regexp_replace(regexp_replace(lower(text), '\b(?:not|no|never|cannot)\b', ' ', 'g'), '\s+', ' ', 'g')) AS key, count(*) FILTER (WHERE NOT regexp_matches(lower(text), '\b(?:not|no|never|cannot)\b')) AS n_plain, count(*) FILTER (WHERE regexp_matches(lower(text), '\b(?:not|no|never|cannot)\b')) AS n_negated FROM claims GROUP BY 1 HAVING n_plain > 0 AND n_negated > 0")
def _(spark, sf):
    claim = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("is not "), "p_type")).otherwise(F.concat(F.lit("is "), "p_type"))
    return g.contradictions(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), claim.alias("text")))


@query("g08_complete_linkage")
def _(spark, sf):
    """Clusters of near vectors of a label; the pairs come from the pruned join."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    near = pivots.NearVectors(e, 0.8).pairs().withColumnRenamed("cosine", "similarity")
    return linkage.complete(e.select("id"), near)


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("f53_pruned_cosine_pairs", f"""SELECT a.vec_id AS a, b.vec_id AS b, round(greatest(-1, least(1, {_COS})), 6) AS cosine
 FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id > a.vec_id WHERE {_COS} >= 0.4""")
def _(spark, sf):
    """Every near pair of a label, by pivots; f50_all_cosine_pairs is the exact scan."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return pivots.NearVectors(e, 0.4).pairs().withColumn("cosine", F.round("cosine", 6))


@query("g09_medoids", "SELECT label AS cluster, arg_max(vec_id, d * 1e6 - vec_id * 1e-6) AS medoid, count(*) AS size FROM (SELECT a.label, a.vec_id, round(sum(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 9) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label GROUP BY 1, 2) GROUP BY 1")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    return g.medoids(e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))


@query("g11_match_scores", f"SELECT a, b, round(CASE WHEN ka = kb THEN 0.5 ELSE 0.0 END + CASE WHEN sa = sb THEN 0.28 ELSE -0.18 END + 0.12 + 0.4 * jaccard, 4) AS score FROM ({s.with_(s.CANDIDATES, _PAIRS)} SELECT prs.*, x.knowledge_key AS ka, y.knowledge_key AS kb, x.size AS sa, y.size AS sb FROM prs JOIN candidates x ON x.id = a JOIN candidates y ON y.id = b)")
def _(spark, sf):
    c = overlay.candidates(spark, sf)
    p = g.pairs(c, "brand", carried=("knowledge_key", "size"))
    same = lambda name: F.col(f"a_{name}") == F.col(f"b_{name}")
    return p.select("a", "b", g.match_score(same("knowledge_key"), same("size"), F.lit(True), F.col("jaccard")).alias("score"))
