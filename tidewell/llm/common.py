"""What several operators share: shared storage, batch sizes, words, hashes, components."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.storage import spread_anti, spread_join  # noqa: F401  for the operators

#: Rows that one Arrow batch may hold; texts may be long.
BATCH_ROWS = 256
#: Nodes up to which components() broadcasts their labels (16 bytes each).
MOST_NODES = 1_000_000
#: Upper-case ASCII letters to lower case, on UTF-8 bytes.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@functools.cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tidewell-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where that is unset and Spark runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or _own_dir()).rstrip("/")


_LIMIT = "spark.sql.execution.arrow.maxRecordsPerBatch"
_lock, _held = threading.Lock(), {}


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, Spark sends Python at most so many rows at a time; behind, the session is as it was.

    Only for actions that are over within it: a frame that is returned runs under its caller's settings. Where
    several threads are inside, the first one's limit holds, and the last one out puts the session's own back.
    """
    key = id(spark)
    with _lock:
        depth, before = _held.get(key, (0, None))
        if not depth:
            before = spark.conf.get(_LIMIT) if _LIMIT in spark.conf.getAll else None
            spark.conf.set(_LIMIT, str(rows))
        _held[key] = (depth + 1, before)
    try:
        yield
    finally:
        with _lock:
            depth, before = _held.pop(key)
            if depth > 1:
                _held[key] = (depth - 1, before)
            elif before is None:
                spark.conf.unset(_LIMIT)
            else:
                spark.conf.set(_LIMIT, before)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, as documents may be very long. Spark bounds what it sends at a time in bytes."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def need_free(df: DataFrame, names: Iterable[str]) -> None:
    """An error if df has columns of names that an operator adds."""
    if taken := sorted(set(names) & set(df.columns)):
        raise ValueError(f"columns {taken} exist already")


def keep(df: DataFrame, name: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it back, so a lost executor costs no recomputation. rows: as many go to Python at a time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with batches_of(spark, rows):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what keep() wrote, once nothing reads it any more."""
    path = getattr(df, "kept_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def bounded_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within limit, else as it is: Spark then shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long) as (node, component), the smallest node naming each.

    Every round a node takes the smallest label among its neighbours' and then its
    label's label (pointer jumping), so a chain of n nodes needs about log n rounds.
    Each round is written to the shared folder. Rows per round are linear in the edges; a label or
    node of very many rows is spread over tasks.
    """
    both = keep(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.a", "e.b")
        .distinct(),
        f"{name}-edges",
    )
    n = both.select("a").distinct().count()
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), f"{name}-labels")
    for _ in range(rounds):
        near = spread_join(both, labels.select(F.col("node").alias("b"), "label"), "b", n, MOST_NODES).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        stepped = keep(stepped, f"{name}-step")
        up = stepped.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = keep(spread_join(stepped, up, "label", n, MOST_NODES).select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), f"{name}-labels")
        discard(stepped)
        discard(labels)
        moved = jumped.where("old <> label").limit(1).count()
        labels = jumped.select("node", "label")
        labels.kept_path = jumped.kept_path
        if not moved:
            discard(both)
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
