"""A durable queue of slow work, as calls of a model over clusters: leases, a time limit a call, retries with a limit, resumption.

Two append-only tables in a shared folder say everything: `leases` (item, owner, from, until) and `results`
(item, state, value, error, run, time). An item is done when a result says so; it is open when it is not done, has failed
fewer times than the limit, and nobody holds a lease on it that is younger than its last result and
has not run out. A run takes items chunk by chunk, so that what a lost driver had finished stays, and tries each
item once; what it held and didn't finish is open again when its lease runs out, or at once for a driver of its
name. Of two drivers that lease an item at a time the one with the earlier lease works on it.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.storage import keep, names_in

_LEASE = "item_id string, owner string, at_ms long, until_ms long"
_RESULT = "item_id string, state string, value string, error string, run string, at_ms long"


def _table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}") if names_in(spark, f"{path}/{name}") else spark.createDataFrame([], schema)


def results(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, value) of the items that are done; of several results the first."""
    done = _table(spark, path, "results", _RESULT).where("state = 'done'")
    return done.groupBy("item_id").agg(F.min_by("value", F.struct("at_ms", "run")).alias("value"))


def states(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, done, attempts, error, tried_ms, run): how items of any result stand; attempts: those that failed or ran out of time."""
    r = _table(spark, path, "results", _RESULT)
    return r.groupBy("item_id").agg(F.max(F.col("state") == "done").alias("done"), F.count_if(F.col("state") != "done").alias("attempts"), F.max_by("error", "at_ms").alias("error"), F.max("at_ms").alias("tried_ms"), F.max_by("run", "at_ms").alias("run"))


def parked(spark: SparkSession, path: str, most_attempts: int = 3) -> DataFrame:
    """(item_id, attempts, error) of items that are given up."""
    return states(spark, path).where(~F.col("done") & (F.col("attempts") >= most_attempts)).select("item_id", "attempts", "error")


def claim(spark: SparkSession, path: str, items: DataFrame, owner: str, now_ms: int, lease_ms: int, limit: int, most_attempts: int = 3, run: str = "") -> DataFrame:
    """Leases up to `limit` open items (item_id, other columns), fewest attempts first, and returns them; items that `run` has tried are left out."""
    known = states(spark, path)
    leases = _table(spark, path, "leases", _LEASE).join(known.select("item_id", "tried_ms"), "item_id", "left").where("tried_ms is null or at_ms > tried_ms")
    taken = leases.where((F.col("until_ms") > now_ms) & (F.col("owner") != owner)).select("item_id").distinct()
    found = items.join(known.select("item_id", "done", "attempts", "run"), "item_id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    free = found.where(~F.coalesce("done", F.lit(False)) & (F.col("attempts") < most_attempts) & (F.col("run").isNull() | (F.col("run") != run))).join(taken, "item_id", "left_anti")
    mine = keep(free.orderBy("attempts", "item_id").limit(limit).select(*items.columns), "queue-claim")
    mine.select("item_id", F.lit(owner).alias("owner"), F.lit(now_ms).cast("long").alias("at_ms"), F.lit(now_ms + lease_ms).cast("long").alias("until_ms")).write.mode("append").parquet(f"{path}/leases")
    live = _table(spark, path, "leases", _LEASE).join(known.select("item_id", "tried_ms"), "item_id", "left").where((F.col("until_ms") > now_ms) & (F.col("tried_ms").isNull() | (F.col("at_ms") > F.col("tried_ms"))))
    first = live.groupBy("item_id").agg(F.min_by("owner", F.struct("at_ms", "owner")).alias("holder"))
    return mine.join(first.where(F.col("holder") == owner).select("item_id"), "item_id", "left_semi")


def call(ask: Callable[[str], str], payload: str, seconds: float) -> tuple[str, str | None, str | None]:
    """(state, value, error) of one call within a time limit; a call that runs over it is left behind."""
    out: list[tuple[str, str | None, str | None]] = []

    def run():
        try:
            out.append(("done", ask(payload), None))
        except Exception as e:  # whatever a client raises is a failed attempt
            out.append(("failed", None, f"{type(e).__name__}: {e}"[:500]))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    return out[0] if out else ("deferred", None, f"no answer within {seconds:g} s")


def work(
    spark: SparkSession, path: str, items: DataFrame, client: Callable[[], Callable[[str], str]], owner: str, seconds: float = 60, lease_ms: int = 3_600_000, chunk: int = 1000, most_attempts: int = 3, most_chunks: int | None = None, clock: Callable[[], float] = time.time
) -> int:
    """Works through open items (item_id, payload), each at most once; how many chunks that took. client() makes the function on an executor. Results of a chunk are written together."""
    run, n = uuid.uuid4().hex, 0
    while most_chunks is None or n < most_chunks:
        now = int(clock() * 1000)
        mine = keep(claim(spark, path, items.select("item_id", "payload"), owner, now, lease_ms, chunk, most_attempts, run), "queue-chunk")
        if mine.isEmpty():
            return n

        def ask_all(batches):
            ask = client()
            for batch in batches:
                told = [call(ask, p, seconds) for p in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([t[i] for t in told], pa.string()) for i in range(3)]], names=["item_id", "state", "value", "error"])

        spread = max(1, spark.sparkContext.defaultParallelism)
        made = mine.repartition(spread).mapInArrow(ask_all, "item_id string, state string, value string, error string")
        made.select("item_id", "state", "value", "error", F.lit(run).alias("run"), F.lit(now).cast("long").alias("at_ms")).write.mode("append").parquet(f"{path}/results")
        n += 1
    return n
