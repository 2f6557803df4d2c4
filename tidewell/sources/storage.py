"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tidewell-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where that is unset and Spark runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or _own_dir()).rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage by a table in the shared folder, so that what reads it twice computes it once and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def _at(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    system, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    system, at = _at(spark, path)
    system.delete(at, True)


def discard(df: DataFrame) -> None:
    """Deletes what keep() wrote, once nothing reads it any more."""
    if path := getattr(df, "kept_path", None):
        delete(df.sparkSession, path)


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: int, limit: int, salts: int = 16) -> DataFrame:
    """left with the columns of right (distinct keys, none null), or nulls. Up to `limit` counted rows right is broadcast.

    Beyond, right goes to `salts` places a key and rows of left are dealt over them by their place in what was read, so that no
    key of left stays in one task, even of rows equal in all; rows of a null key meet nothing and stay where they are. left comes from
    tables by maps alone, so that a task that is run again deals its rows as before.
    """
    if rows <= limit:
        return left.join(F.broadcast(right), key, "left")
    dealt = left.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    copies = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = dealt.where(F.col(key).isNotNull()).join(copies, [key, "salt"], "left").drop("salt")
    blank = dealt.where(F.col(key).isNull()).drop("salt").select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in right.columns if c != key])
    return met.unionByName(blank)


def spread_anti(left: DataFrame, right: DataFrame, key: str, rows: int, limit: int) -> DataFrame:
    """left without the rows whose key right (one column, distinct, none null) has, as spread_join() does it; rows of a null key stay."""
    marked = right.toDF(key).withColumn("__lost", F.lit(True))
    return spread_join(left, marked, key, rows, limit).where("__lost is null").select(*left.columns)
