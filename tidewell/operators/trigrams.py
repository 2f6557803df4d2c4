"""Search inside ids by trigrams: `%q%`, prefixes and wildcards without reading all ids.

The index has, in folders by bucket, lists of the ids that hold each trigram, how often each trigram occurs, and a summary
row an id. A search takes the rarest trigrams of the query, reads their postings alone, meets them, tests the ids
that are left against the query itself, and reads the summaries of those from their buckets. A query without
three characters in a row between wildcards has no trigram and is tested against all summaries.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.facts import entity_refs, page
from tidewell.operators.lexical import block_rows
from tidewell.sources.segments import Store

#: Stands before an id, so that prefixes have trigrams of their own.
BEGIN = "\u0002"
#: Trigrams whose postings a search reads.
MOST_GRAMS = 4
_GRAMS = "gram string, ids array<string>, bucket int"


def grams(text: str) -> list[str]:
    """Distinct trigrams of the runs of text between wildcards, in their order."""
    runs = re.split(r"[%_\\]", text)
    return list(dict.fromkeys(run[i : i + 3] for run in runs for i in range(len(run) - 2)))


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def summaries(facts: DataFrame) -> DataFrame:
    """(entity_id, subject_count, object_count, fact_count, predicates) of the entities that active facts name."""
    said = entity_refs(facts).groupBy("entity_id", "predicate").agg(F.sum("as_subject").alias("s"), F.sum("as_object").alias("o"), F.count("*").alias("n"))  # before lists of predicates, for which rows are sorted
    return said.groupBy("entity_id").agg(F.sum("s").alias("subject_count"), F.sum("o").alias("object_count"), F.sum("n").alias("fact_count"), F.array_join(F.sort_array(F.collect_list("predicate")), ",").alias("predicates"))


def build(rows: DataFrame, path: str, id_col: str = "entity_id", buckets: int = 64) -> dict:
    """Indexes rows (distinct ids, other columns) and publishes the index."""
    spark = rows.sparkSession
    store = Store(spark, path)
    before = store.latest()
    held = store.write(rows.withColumn("bucket", _bucket(id_col, buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", id_col), "rows", "bucket")
    own = spark.read.parquet(f"{store.path}/{held}").select(F.col(id_col).alias("id")).where("id is not null")
    name = F.concat(F.lit(BEGIN), F.lower("id"))
    cut = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(name) - 2), lambda i: F.substr(name, i, F.lit(3))))
    said = own.where(F.char_length("id") >= 2).select("id", cut.alias("w"))
    blocks = said.mapInArrow(functools.partial(block_rows, False), "term string, ids array<string>, tfs array<int>, sizes array<int>").where("term is not null")
    found = blocks.select(F.col("term").alias("gram"), "ids").withColumn("bucket", _bucket("gram", buckets))
    # Lists by block of ids travel, not a row a trigram; a trigram of most ids is dealt over several tasks.
    postings = store.write(found.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram"), "grams", "bucket")
    counts = store.table({"segments": {"grams": [postings]}}, "grams", _GRAMS).groupBy("bucket", "gram").agg(F.sum(F.size("ids")).alias("n"))
    told = store.write(counts.repartition(buckets, "bucket").sortWithinPartitions("bucket", "gram"), "counts", "bucket")
    return store.publish({"seq": 0, "n_dead": 0, "buckets": buckets, "id_col": id_col, "segments": {"rows": [held], "grams": [postings], "counts": [told]}}, before)


def _candidates(store: Store, manifest: dict, wanted: list[str]) -> DataFrame | None:
    """(id) of the ids that hold the rarest of the wanted trigrams; none if nothing is wanted."""
    if not wanted:
        return None
    spark = store.spark
    asked = spark.createDataFrame([(g,) for g in wanted], "gram string").withColumn("bucket", _bucket("gram", manifest["buckets"])).collect()
    of = lambda grams: F.col("bucket").isin(sorted({r["bucket"] for r in grams})) & F.col("gram").isin([r["gram"] for r in grams])
    known = {r["gram"]: r["n"] for r in store.table(manifest, "counts", "gram string, n long, bucket int").where(of(asked)).collect()}
    if len(known) < len(asked):
        return spark.createDataFrame([], "id string")  # one of them stands in no id
    rare = sorted(asked, key=lambda r: (known[r["gram"]], r["gram"]))[:MOST_GRAMS]
    met = store.table(manifest, "grams", _GRAMS).where(of(rare)).select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return met.where(F.col("n") == len(rare)).select("id")


def matching(spark: SparkSession, path: str, test, wanted: list[str]) -> DataFrame:
    """Indexed rows whose id passes test (a function of the id's column), given trigrams that every such id holds."""
    store = Store(spark, path)
    manifest = store.latest()
    if manifest is None:
        raise LookupError(f"no index in {path}")
    rows, key = store.table(manifest, "rows"), manifest["id_col"]
    found = _candidates(store, manifest, wanted)
    if found is None:
        return rows.where(test(F.col(key))).drop("bucket")
    ids = found.where(test(F.col("id"))).withColumn("bucket", _bucket("id", manifest["buckets"]))
    places = [r[0] for r in ids.select("bucket").distinct().collect()]  # at most the buckets
    return rows.where(F.col("bucket").isin(places)).join(ids.select(F.col("id").alias(key)), key, "left_semi").drop("bucket")


def search(spark: SparkSession, path: str, query: str, limit: int = 20) -> DataFrame:
    """The rows that facts.entities() gives, from an index of summaries()."""
    q = query.strip().lower()
    rows = matching(spark, path, lambda c: F.lower(c).like(f"%{q}%"), grams(q))
    name = F.lower("entity_id")
    level = F.when(name == q, 0).when(name.like(f"{q}%"), 1).otherwise(2).cast("long")
    return rows.withColumn("match_score", level).orderBy("match_score", F.desc("fact_count"), "entity_id").limit(page(limit))


def with_prefix(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Indexed rows whose id begins with prefix, letter by letter."""
    return matching(spark, path, lambda c: c.startswith(prefix), grams(BEGIN + re.sub(r"[%_\\].*", "", prefix.lower(), flags=re.DOTALL)))
