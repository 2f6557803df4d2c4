"""Retrieval evaluation: a lexical ranker and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words that don't count.
STOP_WORDS = ("a", "an", "and", "are", "as", "be", "by", "does", "for", "from", "in", "is", "it", "of", "on", "or", "should", "the", "to", "what", "where", "which", "who", "with")


def counts(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, term, n) of ASCII letters and digits in lower case, without stop words."""
    words = F.explode(F.split(F.lower(text_col), "[^a-z0-9]+"))
    return rows.select(*keys, words.alias("term")).where((F.col("term") != "") & ~F.col("term").isin(*STOP_WORDS)).groupBy(*keys, "term").agg(F.count("*").alias("n"))


def lexical_ranks(cases: DataFrame, memories: DataFrame) -> DataFrame:
    """(case_id, memory_id, score, rank) of active memories (case_id, memory_id, text, tier, importance, status) for cases (case_id, query)."""
    live = memories.where("status = 'active'")
    q = counts(cases, ["case_id"], "query").withColumnRenamed("n", "wanted")
    total = q.groupBy("case_id").agg(F.sum("wanted").alias("total"))
    own = counts(live, ["case_id", "memory_id"], "text")
    met = own.join(q, ["case_id", "term"]).groupBy("case_id", "memory_id").agg(F.sum(F.least("n", "wanted")).alias("overlap"), F.sum(F.when(F.char_length("term") >= 6, 0.04).otherwise(0.02)).alias("specificity"))
    rows = live.join(total, "case_id", "left").join(met, ["case_id", "memory_id"], "left")
    bonus = F.when(F.col("tier").isin("decision", "preference"), 0.08).when(F.col("tier") == "semantic", 0.05).otherwise(0.0)
    score = F.coalesce(F.col("overlap") / F.col("total"), F.lit(0.0)) + F.coalesce("specificity", F.lit(0.0)) + bonus + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("importance"))) * 0.04
    scored = rows.select("case_id", "memory_id", F.round(score, 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "memory_id")).cast("long"))


def metrics(ranks: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """One row: recall at k, mean reciprocal rank and the share of cases whose first hit is expected."""
    hits = expected.join(ranks, ["case_id", "memory_id"], "left")
    by_case = hits.groupBy("case_id").agg((F.count_if(F.col("rank") <= k) / F.count("*")).alias("recall"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("mrr"), F.coalesce(F.min("rank") == 1, F.lit(False)).cast("int").alias("top"))
    return by_case.agg(F.round(F.avg("recall"), 6).alias("recall_at_k"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("top"), 6).alias("top_1"))


def support(hits: DataFrame, cases: DataFrame, expected: DataFrame, forbidden: DataFrame, k: int) -> DataFrame:
    """One row: share of cases with an expected memory within k, mean reciprocal rank of the first one, how many of those first ones the vector and the lexical side found, and the share of cases without a forbidden memory on top.

    hits: (case_id, memory_id, rank, vector_rank, lexical_rank), a side's rank null where it did not find the memory.
    """
    near = hits.where(F.col("rank") <= k)
    side = F.struct("rank", F.col("vector_rank").isNotNull().cast("int").alias("v"), F.col("lexical_rank").isNotNull().cast("int").alias("l"))
    first = near.join(expected, ["case_id", "memory_id"], "left_semi").groupBy("case_id").agg(F.min_by(side, "rank").alias("f"))
    wrong = hits.where("rank = 1").join(forbidden, ["case_id", "memory_id"], "left_semi").groupBy("case_id").agg(F.count("*").alias("wrong"))
    by_case = cases.select("case_id").join(first, "case_id", "left").join(wrong, "case_id", "left")
    mean = lambda c: F.round(F.coalesce(F.avg(F.coalesce(c, F.lit(0.0))), F.lit(0.0)), 6)
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return by_case.agg(
        mean(F.when(F.col("f").isNotNull(), F.lit(1.0))).alias("recall_at_k"), mean(1 / F.col("f.rank")).alias("mrr"), count("f.v").alias("vector_supported"), count("f.l").alias("lexical_supported"), F.round(1 - F.coalesce(F.avg(F.coalesce("wrong", F.lit(0))), F.lit(0.0)), 6).alias("top_1_safety")
    )
