"""Sketches by day: late rows, repeated batches, pruned days, the bound."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import day_counts
from tidewell.sources.segments import Store

SCHEMA = "day string, group string, value long"


def counts(rows, *by):
    return sorted((tuple(r) for r in day_counts.counted(rows, *by).collect()), key=repr)


def test_late_rows_rewrite_their_days_alone(spark, tmp_path):
    rng, path = random.Random(5), f"file://{tmp_path}/c"
    rows = [(f"2024-01-0{rng.randint(1, 6)}", rng.choice(("a", "b", None)), rng.choice((None, *range(40)))) for _ in range(900)] + [("none", "a", 7)]
    late = [r for r in rows if r[0] == "2024-01-03"][:20] + [("2024-01-09", "b", 1)]
    assert day_counts.kept(spark, path) is None and day_counts.add(spark, path, "empty", spark.createDataFrame([], SCHEMA)) == []
    day_counts.add(spark, path, "one", spark.createDataFrame(rows, SCHEMA))
    store = Store(spark, path)
    before = store.latest()
    assert day_counts.add(spark, path, "two", spark.createDataFrame(late, SCHEMA)) == ["2024-01-03", "2024-01-09"]
    after = store.latest()
    assert {d for d in after["days"] if before["days"].get(d) != after["days"][d]} == {"2024-01-03", "2024-01-09"}
    assert day_counts.add(spark, path, "two", spark.createDataFrame(late, SCHEMA)) == [] and store.latest() == after
    whole = day_counts.sketches(spark.createDataFrame(rows + late, SCHEMA))
    for by in (("day", "group"), ("group",), ("day",)):
        assert counts(day_counts.kept(spark, path), *by) == counts(whole, *by)
    part = day_counts.kept(spark, path, "2024-01-02", "2024-01-03")
    assert {f.split("part=")[1].split("/")[0] for f in part.inputFiles()} == {"2024-01-02", "2024-01-03"}
    assert counts(part, "day") == counts(whole.where("day in ('2024-01-02', '2024-01-03')"), "day")


def test_killed_before_publishing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/c"
    day_counts.add(spark, path, "one", spark.createDataFrame([("2024-01-01", "a", 1)], SCHEMA))

    def killed(*_):
        raise RuntimeError("killed")

    more = spark.createDataFrame([("2024-01-01", "a", 2)], SCHEMA)
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(Store, "publish", killed)
        day_counts.add(spark, path, "two", more)
    assert counts(day_counts.kept(spark, path), "group") == [("a", 1, 1)]
    day_counts.add(spark, path, "two", more)
    assert counts(day_counts.kept(spark, path), "group") == [("a", 2, 2)]


def test_bound(spark):
    """United over 30 days, counts of up to 200,000 values keep to the bound, and nulls of a group meet."""
    rows = spark.range(600_000).select(F.format_string("2024-01-%02d", F.col("id") % 30 + 1).alias("day"), F.when(F.col("id") % 3 > 0, "g").alias("group"), (F.col("id") % 200_000).alias("value"))
    found = day_counts.held_to(day_counts.counted(day_counts.sketches(rows), "group"), rows.groupBy("group").agg(F.countDistinct("value").alias("exact")), "group").collect()
    assert {(r["group"], r["n"], r["exact"], r["within"]) for r in found} == {("g", 400_000, 200_000, True), (None, 200_000, 200_000, True)}
