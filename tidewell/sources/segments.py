"""Indexes as immutable segments under numbered manifests.

A segment is a Parquet table that is written once. A manifest is a small JSON file that names the segments
of one version of an index; it is written last, so whatever is killed before leaves the old version in
force. The newest manifest whose segments are all complete is the index; if one of them is damaged
or gone, the one before it is.

Rows of a segment carry `seq`, the number of the change that wrote them. A row is alive unless `dead` segments hold
its id with a larger number: a deletion adds such rows, a changed row adds them besides its new rows.

One writer at a time: a second one that publishes the same number gets an error.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that changed since the last compaction, up to which they are broadcast.
MOST_DEAD = 1_000_000


class Store:
    """The folder of an index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str):
        made = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return made.getFileSystem(self.spark._jsc.hadoopConfiguration()), made

    def _exists(self, path: str) -> bool:
        system, at = self._at(path)
        return system.exists(at)

    def versions(self) -> list[int]:
        """Numbers of all published manifests, the newest first."""
        system, at = self._at(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []
        return sorted((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), reverse=True)

    def read(self, version: int) -> dict:
        system, at = self._at(f"{self.path}/manifests/v{version:09d}.json")
        stream = system.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> dict | None:
        """The newest manifest that is whole: it can be read, and each of its segments was written to the end."""
        for version in self.versions():
            try:
                found = self.read(version)
            except ValueError:
                continue
            if all(self._exists(f"{self.path}/{s}/_SUCCESS") for paths in found["segments"].values() for s in paths):
                return found
        return None

    def write(self, rows: DataFrame, kind: str, by: str | None = None) -> str:
        """A new segment of rows; its name in the folder."""
        name = f"segments/{kind}-{uuid.uuid4().hex}"
        out = rows.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(f"{self.path}/{name}")
        return name

    def table(self, manifest: dict, kind: str, schema: str | None = None) -> DataFrame | None:
        """All rows of the segments of a kind; none if there are none. schema: for segments in folders, of which one of no rows has no file."""
        paths = manifest["segments"].get(kind, [])
        found = None
        for p in paths:  # each has partitions of its own
            df = (self.spark.read.schema(schema) if schema else self.spark.read).parquet(f"{self.path}/{p}")
            found = df if found is None else found.unionByName(df)
        return found

    def publish(self, manifest: dict, before: dict | None) -> dict:
        """Puts the next version in force."""
        version = max([0, *self.versions()]) + 1
        if before is not None and self.latest()["version"] != before["version"]:
            raise RuntimeError("the index was changed meanwhile")
        told = {**manifest, "version": version}
        system, target = self._at(f"{self.path}/manifests/v{version:09d}.json")
        _, draft = self._at(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        stream = system.create(draft, False)
        stream.write(bytearray(json.dumps(told).encode()))
        stream.close()
        if system.exists(target) or not system.rename(draft, target):
            system.delete(draft, False)
            raise RuntimeError(f"version {version} exists already")
        return told

    def vacuum(self, keep: int = 2) -> None:
        """Deletes manifests but the newest `keep`, then segments and drafts that none of those names."""
        left = self.versions()
        kept = {s for v in left[:keep] for paths in self.read(v)["segments"].values() for s in paths}
        for v in left[keep:]:
            system, at = self._at(f"{self.path}/manifests/v{v:09d}.json")
            system.delete(at, False)
        for folder, used in (("segments", kept), ("manifests", None)):
            system, at = self._at(f"{self.path}/{folder}")
            for s in system.listStatus(at) if system.exists(at) else []:
                name = s.getPath().getName()
                if (name.startswith("_") if used is None else f"{folder}/{name}" not in used):
                    system.delete(s.getPath(), True)

    def alive(self, rows: DataFrame, manifest: dict) -> DataFrame:
        """rows (id, seq, ...) without those that a later change made void. The changes are broadcast up to MOST_DEAD ids, else both sides are shuffled."""
        dead = self.table(manifest, "dead")
        if dead is None:
            return rows
        last = dead.groupBy("id").agg(F.max("seq").alias("dead_seq"))
        if manifest["n_dead"] <= MOST_DEAD:
            last = F.broadcast(last)
        met = rows.join(last, "id", "left")
        return met.where(F.col("dead_seq").isNull() | (F.col("dead_seq") <= F.col("seq"))).select(*rows.columns)


def pending(outbox: DataFrame, applied: int) -> tuple[DataFrame, int, int]:
    """Entries (entry_id, op, id) after `applied`: the last one of each id, their largest number (applied if none), and how many ids they name."""
    new = outbox.where(F.col("entry_id") > applied)
    last = new.groupBy("id").agg(F.max("entry_id").alias("entry_id"), F.max_by("op", "entry_id").alias("op"))
    row = last.agg(F.max("entry_id"), F.count("*")).first()
    return last, row[0] if row[0] is not None else applied, row[1]


def drift(expected: DataFrame, indexed: DataFrame) -> DataFrame:
    """By kind: ids (kind, id) that should be indexed, that are, the difference, and how many are missing and stale. One shuffle of ids."""
    sides = expected.select("kind", "id", F.lit(1).alias("e"), F.lit(0).alias("i")).unionByName(indexed.select("kind", "id", F.lit(0).alias("e"), F.lit(1).alias("i")))
    by_id = sides.groupBy("kind", "id").agg(F.max("e").alias("e"), F.max("i").alias("i"))
    return by_id.groupBy("kind").agg(
        F.sum("e").alias("expected"), F.sum("i").alias("indexed"), (F.sum("e") - F.sum("i")).alias("diff"), F.count_if((F.col("e") == 1) & (F.col("i") == 0)).alias("missing"), F.count_if((F.col("e") == 0) & (F.col("i") == 1)).alias("stale")
    )
