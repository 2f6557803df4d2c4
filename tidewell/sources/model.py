"""The memory model's tables, derived from the generic input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.tables import table

DAY_MS = 86_400_000
#: The moment that queries take for now, so that results don't depend on the clock.
NOW_MS = 1_706_745_600_000


def millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp, whatever the session's time zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamped memories, from events."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("rowid"),
        F.concat(F.lit("ev:"), F.col("event_id").cast("string")).alias("memory_id"),
        millis(F.col("ts")).alias("ts_ms"),
        F.col("event_type").alias("source_type"),
        F.concat_ws(" ", "event_type", "props").alias("content"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100)).alias("salience"),
        (F.col("event_id") % 10 / 10).alias("strength"),
        F.when(F.col("event_id") % 3 == 0, "hot").when(F.col("event_id") % 3 == 1, "warm").otherwise("cold").alias("tier"),
        F.when(F.col("event_id") % 17 == 0, "forgotten").otherwise("active").alias("status"),
        F.when(F.col("event_id") % 19 != 0, F.concat(F.lit("user-"), F.col("user_id").cast("string"))).alias("principal"),
        F.col("props").alias("context_json"),
    )


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with validity windows, from the order tables."""
    t = lambda name: table(spark, sf_dir, name)
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    columns = ["triple_id", "subject_id", "predicate", "object_id", "object_kind", "valid_from_ms", "valid_to_ms", "confidence", "status", "source_episode_id", "cluster_id"]
    null = F.lit(None).cast("long")
    begin = millis(F.col("o_orderdate"))
    priority = t("orders").select(
        text("p:", "o_orderkey"), text("customer-", "o_custkey"), F.lit("has_order_priority"), F.col("o_orderpriority"), F.lit("literal"), begin,
        F.when(F.col("o_orderkey") % 2 == 0, begin + 90 * DAY_MS), F.lit(0.5) + F.col("o_orderkey") % 50 / 100, F.when(F.col("o_orderkey") % 13 == 0, "superseded").otherwise("active"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey") % 1000), F.concat(F.lit("cl:"), (F.col("o_orderkey") % 12).cast("string")),
    )
    fixed = F.lit(788_918_400_000).cast("long")
    located = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        text("l:", "c_custkey"), text("customer-", "c_custkey"), F.lit("located_in"), F.concat(F.lit("nation-"), F.lower("n_name")), F.lit("entity"), fixed, null, F.lit(0.9), F.lit("active"),
        F.col("c_custkey") % 1000, F.lit(None).cast("string"),
    )
    part_of = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        text("r:", "n_nationkey"), F.concat(F.lit("nation-"), F.lower("n_name")), F.lit("part_of"), F.concat(F.lit("region-"), F.lower("r_name")), F.lit("entity"), fixed, null, F.lit(0.95), F.lit("active"), null, F.lit(None).cast("string"),
    )
    contains = t("lineitem").select(
        F.concat(F.lit("c:"), F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")), text("order-", "l_orderkey"), F.lit("contains"), text("part-", "l_partkey"), F.lit("entity"),
        millis(F.col("l_shipdate")), null, F.lit(0.6) + F.col("l_linenumber") / 20, F.lit("active"), F.col("l_orderkey") % 1000, F.lit(None).cast("string"),
    )
    placed = t("orders").select(
        text("b:", "o_orderkey"), text("customer-", "o_custkey"), F.lit("placed"), text("order-", "o_orderkey"), F.lit("entity"), begin, null, F.lit(0.8), F.lit("active"), F.col("o_orderkey") % 1000, F.lit(None).cast("string"),
    )
    parts = [x.toDF(*columns) for x in (priority, located, part_of, contains, placed)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def edges(facts: DataFrame) -> DataFrame:
    """Relationship edges of the active facts between entities; strength is the confidence, evidence one row."""
    live = facts.where((F.col("status") == "active") & (F.col("object_kind") == "entity"))
    return live.select(F.col("triple_id").alias("edge_id"), "subject_id", "predicate", "object_id", "valid_from_ms", "valid_to_ms", "confidence", F.col("confidence").alias("strength"), F.lit(1).cast("long").alias("evidence_count"), "source_episode_id")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cluster for each label of the embeddings."""
    labels = table(spark, sf_dir, "embeddings").groupBy("label").count()
    return labels.select(F.concat(F.lit("cl:"), F.col("label").cast("string")).alias("cluster_id"), (F.lit(0.5) + F.col("label") * 7 % 50 / 100).alias("coherence"), (F.lit(NOW_MS) - F.col("label").cast("long") * DAY_MS).alias("created_at_ms"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("cl:"), F.col("label").cast("string")).alias("cluster_id"), F.concat(F.lit("ev:"), F.col("vec_id").cast("string")).alias("memory_id"))


def abstractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clusters in three have an abstraction."""
    c = table(spark, sf_dir, "embeddings").select("label").distinct().where("label % 3 <> 0")
    label = F.col("label").cast("string")
    return c.select(F.concat(F.lit("ab:"), label).alias("abstraction_id"), F.concat(F.lit("cl:"), label).alias("cluster_id"), F.when(F.col("label") == 4, F.lit("I'm unable to provide assistance with that.")).otherwise(F.concat(F.lit("Theme "), label)).alias("content"))


def turns_as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored chunk table: each conversation is a document, each turn a chunk of it."""
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), "text", F.concat(F.lit("user-"), (F.col("conv_id") % 20).cast("string")).alias("ingested_by"))


def turn_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of turns_as_chunks; one in nine is forgotten."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    return c.select("doc_id", F.concat(F.lit("chat "), F.col("doc_id").cast("string")).alias("source"), F.when(F.col("doc_id") % 9 == 8, "forgotten").otherwise("active").alias("status"))


def fact_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of extracted facts, one an order."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    status = F.when(k % 4 == 0, "approved").when(k % 4 == 1, "dismissed").otherwise("needs_review")
    return o.select(
        text("rv:", "o_orderkey").alias("review_id"), text("f", "o_orderkey").alias("fingerprint"), text("cl:", "o_orderstatus").alias("cluster_id"), text("customer-", "o_custkey").alias("subject_id"), F.lit("placed").alias("predicate"), text("order-", "o_orderkey").alias("object_id"),
        F.lit("entity").alias("object_kind"), (k % 100 / 100).alias("confidence"), F.when(k % 2 == 0, "low_confidence").otherwise("weak_literal_claim").alias("reason_code"), status.alias("status"), millis(F.col("o_orderdate")).alias("created_at_ms"),
    )


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.concat(F.lit("customer-"), F.col("c_custkey").cast("string"))
    return c.select(F.col("c_name").alias("alias"), key.alias("canonical_id"), F.upper("c_name").alias("display_label"), F.lit("names").alias("source"), (F.col("c_custkey") % 10 / 10).alias("confidence"), F.col("c_custkey").alias("created_at_ms"), F.col("c_custkey").alias("updated_at_ms"))
