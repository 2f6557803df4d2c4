"""Streaming: triggers by tenant, audit appends, outbox replay, incremental clustering, timers and signals.

State that must outlive a restart is the stream's own state store, or tables under the number of the batch
that wrote them, so that a replayed batch writes the same again.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.functions.text import day_bucket
from tidewell.operators import cluster
from tidewell.sources.storage import delete, discard, keep, names_in


def episodes_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def due_tenants(stream: DataFrame, rows: int = 50, seconds: float = 3600, tenant_col: str = "tenant_id") -> DataFrame:
    """(tenant_id, n, cause, at_ms): a row whenever a tenant has `rows` new rows, or some and `seconds` passed since its last one (or its first row).

    Counter and last time of a tenant are streaming state with a processing-time timer: they survive a restart, tenants
    don't wait for each other, and a quiet tenant is found without new rows. rows = 0 leaves only the time. State is one small row a
    tenant; rows are counted before they meet, so a tenant with most of the rows costs no more.
    """
    counted = stream.select(F.coalesce(F.col(tenant_col).cast("string"), F.lit("")).alias("tenant_id"))

    def step(key, frames, state):
        seen, last = state.get if state.exists else (0, None)
        now = state.getCurrentProcessingTimeMs()
        last = now if last is None else last
        seen += sum(len(f) for f in frames)
        cause = "rows" if rows and seen >= rows else "time" if seen and now - last >= 1000 * seconds else None
        if cause:
            yield pd.DataFrame({"tenant_id": [key[0]], "n": [seen], "cause": [cause], "at_ms": [now]})
            seen, last = 0, now
        state.update((seen, last))
        if seen:
            state.setTimeoutDuration(int(max(1, last + 1000 * seconds - now)))

    return counted.groupBy("tenant_id").applyInPandasWithState(step, "tenant_id string, n long, cause string, at_ms long", "seen long, last long", "append", "ProcessingTimeTimeout")


def run_due(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], rows: int = 50, seconds: float = 3600, tenant_col: str = "tenant_id", every: str = "1 second") -> StreamingQuery:
    """Runs work(due, batch_id) over the tenants that are due (tenant_id, n, cause, at_ms). A batch that is replayed after a crash comes with the same id."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            work(batch, batch_id)

    return due_tenants(stream, rows, seconds, tenant_col).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def append_batches(stream: DataFrame, path: str, checkpoint: str, keys: list[str], every: str | None = None, time_col: str | None = None, horizon: str = "7 days") -> StreamingQuery:
    """Appends rows whose keys did not come before, a folder a micro-batch, so that a replay overwrites what it wrote before.

    What came before is in the stream's own state store, beside the checkpoint: no batch reads earlier output. A key is
    remembered for `horizon` of event time (time_col: a timestamp or milliseconds since 1970), so the state is bounded by what
    comes within it, and rows older than that are left out as late; without a time column keys are remembered for ever. every:
    flush at this interval ("50 milliseconds"); none takes what is there and ends.
    """
    if time_col is None:
        fresh = stream.dropDuplicates(keys)
    else:
        at = F.col(time_col)
        at = F.timestamp_millis(at) if dict(stream.dtypes)[time_col] == "bigint" else at.cast("timestamp")
        fresh = stream.withColumn("__at", F.coalesce(at, F.current_timestamp())).withWatermark("__at", horizon).dropDuplicatesWithinWatermark(keys).drop("__at")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    out = fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def audit_writer(stream: DataFrame, path: str, checkpoint: str, every: str | None = "50 milliseconds", time_col: str | None = None) -> StreamingQuery:
    """Audit rows in small batches, each id once. A batch takes 64 rows or what came within the interval, as far as its source bounds it (maxFilesPerTrigger, maxOffsetsPerTrigger)."""
    return append_batches(stream, path, checkpoint, ["event_id"], every, time_col)


def periodic(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], interval: str) -> StreamingQuery:
    """Work at every interval, over what came since."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def replay(stream: DataFrame, path: str, checkpoint: str, time_col: str | None = None) -> StreamingQuery:
    """Outbox entries applied once each, by entry id, however often they are sent (within the horizon, where there is a time)."""
    return append_batches(stream, path, checkpoint, ["entry_id"], None, time_col)


def incremental_clusters(stream: DataFrame, folder: str, checkpoint: str, threshold: float, min_size: int = 2, max_size: int = 48) -> StreamingQuery:
    """Clusters rows (id, ts_ms, embedding; distinct ids) as they come; current_members() has what a full run over all rows so far would give.

    Rows lie by day; of each day the newest batch's labels (id, component) and members (cluster_id, id) are in
    force. A batch reads the folders of its own days only, forms pairs with new rows only, and joins components so far (cluster.grow). It writes
    its days under its own number, so a replay writes the same again; what the batch before the last wrote is then deleted.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = keep(batch.withColumn("day", day_bucket(F.col("ts_ms"))), "fresh-rows")
        days = [r[0] for r in fresh.select("day").distinct().collect()]  # a batch's days
        if not days:
            return
        rows = "id long, ts_ms long, embedding array<float>, batch_id long, day long"
        held = _of_days(spark, f"{folder}/rows", days, rows).where(F.col("batch_id") < batch_id)
        labels = _newest(spark, f"{folder}/labels", days, "id long, component long, batch_id long, day long", batch_id)
        grown = keep(cluster.grow(fresh.select("id", "day", "embedding"), held.select("id", "day", "embedding"), labels, threshold), "grown")
        times = held.select("id", "ts_ms").unionByName(fresh.select("id", "ts_ms"))
        timed = grown.join(times, "id").withColumn("whole", F.count("*").over(Window.partitionBy("component")))
        made = cluster.cut_components(timed.where("whole > 1").select("id", "component", "ts_ms"), min_size, max_size).join(grown.select("id", "day"), "id")
        for name, table in (("rows", fresh), ("labels", grown), ("members", made)):
            out = table.withColumn("batch_id", F.lit(batch_id).cast("long")).write.partitionBy("day", "batch_id").mode("overwrite").option("partitionOverwriteMode", "dynamic")
            out.parquet(f"{folder}/{name}")
        for name in ("labels", "members"):
            for day in days:
                at = f"{folder}/{name}/day={day}"
                for old in sorted(_batches(spark, at))[:-2]:
                    delete(spark, f"{at}/batch_id={old}")
        for table in (fresh, grown):
            discard(table)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batches(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removeprefix("batch_id=")) for n in names_in(spark, path) if n.startswith("batch_id=")]


def _of_days(spark: SparkSession, path: str, days: list[int], schema: str) -> DataFrame:
    """Rows of these days alone: other days' folders aren't even listed."""
    there = [f"{path}/day={d}" for d in days if names_in(spark, f"{path}/day={d}")]
    return spark.read.schema(schema).option("basePath", path).parquet(*there) if there else spark.createDataFrame([], schema)


def _newest(spark: SparkSession, path: str, days: list[int], schema: str, before: int | None = None) -> DataFrame:
    """Rows that the newest batch (before a number) has written of each of these days."""
    there = []
    for d in days:
        own = [b for b in _batches(spark, f"{path}/day={d}") if before is None or b < before]
        there += [f"{path}/day={d}/batch_id={max(own)}"] if own else []
    return spark.read.schema(schema).option("basePath", path).parquet(*there) if there else spark.createDataFrame([], schema)


def current_members(spark: SparkSession, folder: str, days: list[int] | None = None) -> DataFrame:
    """(cluster_id, id, day) in force, of these days or all. A day whose newest labels hold no cluster has none."""
    path = f"{folder}/members"
    days = days if days is not None else [int(n.removeprefix("day=")) for n in names_in(spark, path) if n.startswith("day=")]
    return _newest(spark, path, days, "cluster_id long, id long, batch_id long, day long").select("cluster_id", "id", "day")


def invalidations(batch: DataFrame, kind: str, now_ms: int) -> DataFrame:
    """What a batch makes stale, a row a tenant: a signal without payload."""
    return batch.groupBy("tenant_id").agg(F.count("*").alias("n")).select("tenant_id", F.lit(kind).alias("kind"), F.lit(now_ms).alias("ts_ms"))


def broadcast_invalidations(stream: DataFrame, path: str, checkpoint: str, kind: str, clock: Callable[[], float] = time.time) -> StreamingQuery:
    """Signals of each committed batch, written for whoever watches the folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        invalidations(batch, kind, int(clock() * 1000)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Rows a day and type, with late rows counted up to a bound."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
