"""Distinct counts that merge: a sketch by day and group, kept by day and united over any days.

A store (sources.segments) names for each day the one segment that holds it. A batch, late rows included, makes new
rows of its own days alone: it reads what is kept of those days, unites, and publishes. A batch that is
applied twice counts once, as its name is part of the version. Exact counters stand beside: `n` adds up.

A count has a standard error of 1.04 / sqrt(2 ** lg_k); BOUND is four of them. Rows without a time form the day `none`;
null values aren't counted, null groups are a group. Days are listed by the driver, so they have to be
few, as days are; groups are not bounded.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.segments import Store

#: log2 of a sketch's registers.
LG_K = 12
#: Share of the exact count by which an estimate may be off.
BOUND = 4 * 1.04 / 2 ** (LG_K / 2)
#: Names of batches that a version remembers; a batch is repeated, if at all, soon after.
MOST_BATCHES = 1000


def day_of(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("none"))


def sketches(rows: DataFrame) -> DataFrame:
    """(day, group, n, sketch) of rows (day, group, value). Partial sketches combine before the shuffle, so a hot day or group sends one a task."""
    return rows.groupBy("day", "group").agg(F.count("*").alias("n"), F.hll_sketch_agg("value", LG_K).alias("sketch"))


def united(parts: DataFrame, *by: str) -> DataFrame:
    """Rows of sketches() of several days or batches, added up by `by`."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch"))


def _folders(store: Store, manifest: dict, days: Iterable[str]) -> list[str]:
    return [f"{store.path}/{manifest['days'][d]}/part={d}" for d in sorted(days)]


def kept(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame | None:
    """(day, group, n, sketch) of the days from first to last; only their folders are read. None if nothing is kept of them."""
    store = Store(spark, path)
    manifest = store.latest()
    days = [d for d in (manifest["days"] if manifest else ()) if (first is None or d >= first) and (last is None or d <= last) and (d != "none" or first == last)]
    return spark.read.parquet(*_folders(store, manifest, days)) if days else None


def add(spark: SparkSession, path: str, batch: str, rows: DataFrame) -> list[str]:
    """Adds a batch of rows (day, group, value), unless it was added before; the days that it rewrote."""
    store = Store(spark, path)
    before = store.latest()
    if before is not None and batch in before["batches"]:
        return []
    days = sorted(r[0] for r in rows.select("day").distinct().collect())
    if not days:
        return []
    held = before["days"] if before else {}
    new = sketches(rows)
    if old := _folders(store, before, set(days) & set(held)) if before else []:
        new = united(spark.read.parquet(*old).unionByName(new), "day", "group")
    segment = store.write(new.withColumn("part", F.col("day")), "days", "part")
    owned = {**held, **dict.fromkeys(days, segment)}
    store.publish({"segments": {"days": sorted(set(owned.values()))}, "days": owned, "batches": [*(before["batches"] if before else []), batch][-MOST_BATCHES:]}, before)
    return days


def counted(parts: DataFrame, *by: str) -> DataFrame:
    """(by, n, about): the exact number of rows and the estimated number of different values."""
    return united(parts, *by).select(*by, "n", F.hll_sketch_estimate("sketch").alias("about"))


def held_to(estimates: DataFrame, exact: DataFrame, *by: str) -> DataFrame:
    """(by, n, exact, within): estimates beside exact counts (by, exact), and whether they keep to BOUND; nulls of `by` meet."""
    a, b = estimates.alias("a"), exact.alias("b")
    met = None
    for c in by:
        test = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        met = test if met is None else met & test
    return a.join(b, met).select(*[F.col(f"a.{c}").alias(c) for c in by], "n", "exact", (F.abs(F.col("about") - F.col("exact")) <= F.ceil(BOUND * F.col("exact"))).alias("within"))
