"""Queries of the readers and record loaders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans.common import registry
from quern.session import table
from quern.sources import files

QUERIES, SQL, query = registry()


@query("s03_upsert", """SELECT c_custkey AS k, coalesce(n.v, 0) AS v, coalesce(n.o, 0) AS o FROM customer LEFT JOIN
 (SELECT o_custkey, max(o_orderkey) AS o, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1) n ON o_custkey = c_custkey""")
def _(spark, sf):
    """Customers get the price of their last order; most have several orders in the batch."""
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit(0.0).alias("v"), F.lit(0).cast("long").alias("o"))
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").cast("double").alias("v"), F.col("o_orderkey").cast("long").alias("o"))
    return files.upsert(old, new, "k", ["o"])


@query("s08_file_type", "SELECT kind, count(*) AS n FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'pptx' ELSE 'zip' END ELSE 'unknown' END AS kind FROM documents) GROUP BY 1")
def _(spark, sf):
    head = F.when(F.col("doc_id") % 3 == 0, F.lit("%PDF-1.7")).when(F.col("doc_id") % 3 == 1, F.lit("PK\x03\x04")).otherwise(F.lit("text"))
    name = F.when(F.col("doc_id") % 2 == 0, "a.PPTX").otherwise("a.docx")
    return table(spark, sf, "documents").groupBy(files.file_type(head.cast("binary"), name).alias("kind")).agg(F.count("*").alias("n"))


@query("s09_version_intake", """
SELECT key, label, hash, decision, count(*) AS n FROM (
 SELECT key, label, hash, CASE WHEN coalesce(known, CASE WHEN r > 1 THEN f END) IS NULL THEN 'created'
  WHEN coalesce(known, CASE WHEN r > 1 THEN f END) = hash THEN 'duplicate' ELSE 'conflict' END AS decision FROM (
 SELECT d.source AS key, d.lang AS label, sha256(d.text) AS hash, k.hash AS known,
  row_number() OVER w AS r, first_value(sha256(d.text)) OVER w AS f
  FROM documents d LEFT JOIN (SELECT DISTINCT source, lang, first_value(sha256(text)) OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS hash
   FROM documents WHERE lang = 'de') k ON k.source = d.source AND k.lang = d.lang
  WINDOW w AS (PARTITION BY d.source, d.lang ORDER BY d.doc_id, sha256(d.text)))) GROUP BY ALL""")
def _(spark, sf):
    """Every document asks for the label of its language under its source; the German labels are taken already."""
    d = table(spark, sf, "documents")
    f = d.select(F.col("source").alias("key"), F.col("lang").alias("label"), F.col("text").cast("binary").alias("content"), "doc_id")
    known = d.where("lang = 'de'").groupBy(F.col("source").alias("key"), F.col("lang").alias("label")).agg(F.max_by(F.sha2("text", 256), "doc_id").alias("hash"))
    return files.intake(f, known, [F.asc("doc_id")]).groupBy("key", "label", "hash", "decision").agg(F.count("*").alias("n"))


@query("s15_embedding_backlog", "SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 = 0)")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return files.embedding_backlog(d, d.where("doc_id % 4 = 0").select(F.sha2("text", 256).alias("hash")), "text").select("doc_id")


@query("s17_last_json", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '[{"in": ' || props || ', "s": "}"}, 2]' END AS found FROM events""")
def _(spark, sf):
    said = (F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("I think {broken: } so "), "props", F.lit(" done")))
            .when(F.col("event_id") % 3 == 1, F.concat(F.lit(' [{"in": '), "props", F.lit(', "s": "}"}, 2]\n'))).otherwise(F.lit("no {json")))
    return table(spark, sf, "events").select("event_id", files.last_json(said).alias("found"))


@query("s07_markdown_table", "SELECT '| ' || n_name || ' | ' || n_regionkey || ' |' AS line FROM nation")
def _(spark, sf):
    return files.markdown(table(spark, sf, "nation"), ["n_name", "n_regionkey"])
