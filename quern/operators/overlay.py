"""The entities of the engine laid over the driver's tables, in Spark; plans/sql.py has the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.session import table


def knowledge(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    return (table(spark, sf, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("content"),
        F.col("source").alias("entity_name"),
        F.when(toxic, "conflicted").when(F.col("quality") == 1, "user_confirmed").otherwise("provisional").alias("trust"),
        (~toxic).alias("active")))


def sources(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    supports = labels.select(F.col("doc_id").alias("knowledge_id"), F.lit("supports").alias("relation"),
                             F.when(F.col("quality") == 1, "accepted").otherwise("unresolved").alias("resolution"))
    contradicts = labels.where("toxic = 1").select(F.col("doc_id").alias("knowledge_id"), F.lit("contradicts").alias("relation"),
                                                   F.lit("accepted").alias("resolution"))
    return supports.unionByName(contradicts)


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 12), " ").alias("question"))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    thread = Window.partitionBy("conv_id").orderBy("turn")
    root = F.first(F.when(F.col("role") != "system", F.col("role")), ignorenulls=True).over(
        thread.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("author"), F.coalesce("text", F.lit("")).alias("text"),
                                                    (F.row_number().over(thread) - 1).alias("idx"), root.alias("root_author"))


def versions(spark: SparkSession, sf: str) -> DataFrame:
    own = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf, "documents").select("doc_id", "source", "lang", "text", F.row_number().over(own).alias("version_no"),
                                                F.lag("doc_id").over(own).alias("previous_id"))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")))
            .select("doc_id", "source", F.col("pos").alias("block_no"), F.col("col").alias("text")).where("text <> ''"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """parent -> child: regions, nations, customers and suppliers."""
    nation, customer, supplier = (table(spark, sf, t) for t in ("nation", "customer", "supplier"))
    return (nation.select(F.concat(F.lit("R"), "n_regionkey").alias("parent"), F.concat(F.lit("N"), "n_nationkey").alias("child"))
            .unionByName(customer.select(F.concat(F.lit("N"), "c_nationkey").alias("parent"), F.concat(F.lit("C"), "c_custkey").alias("child")))
            .unionByName(supplier.select(F.concat(F.lit("N"), "s_nationkey").alias("parent"), F.concat(F.lit("S"), "s_suppkey").alias("child"))))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Answer runs and feedback from events."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "answered") \
        .when(F.col("event_type") == "click", "needs_clarification").when(F.col("event_type") == "signup", "no_knowledge").otherwise("started")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("run_id"), "user_id", "event_type", F.col("ts").alias("created_at"), status.alias("status"), "value",
        F.get_json_object("props", "$.k").cast("long").alias("knowledge_id"))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("frequency"))
    return (table(spark, sf, "part").join(items, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("CASE-"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("candidate_id"),
        F.col("p_type").alias("knowledge_key"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"),
        F.coalesce("frequency", F.lit(0)).alias("frequency")))
