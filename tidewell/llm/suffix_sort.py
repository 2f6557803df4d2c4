"""Repeated strings by a difference-cover suffix sort whose every step is a Spark range sort.

suffix_dedup cuts down what has to be sorted before it sorts; this module sorts all suffixes of all documents,
as the algorithm has it, and gives the same marks. It moves some hundred bytes for each byte of text, so
the query doesn't use it; the README states its figures. Documents: rows (doc_id, text) of distinct ids,
none null; a null text is empty.

1. Sampled suffixes (places 1 and 2 mod 3 of a document) are range-sorted by their triples and named by the
   number of lesser triples: each task counts within its range, and sums over the ranges before it are added.
   Ranges end inside runs of equal triples where they must, so a hot triple is spread over tasks.
2. Each document's names, those of places 1 before those of places 2, are its next string; recursion goes on until a name
   covers LENGTH bytes, as no more is asked of the order.
3. The suffixes between are counted against either class of samples by range sorts of (symbol, rank behind)
   and of (two symbols, rank behind): the three counts add up to a place among all suffixes.
4. In that order neighbours are compared by their first LENGTH bytes; the earliest place of a group stays.

The driver holds a short row a range, and no task more than one document and one Arrow batch.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import keep, sliced, spread_join
from tidewell.llm.suffix_dedup import LENGTH

#: Groups up to which the earliest places are broadcast.
MOST_GROUPS = 1_000_000


def _emit(packed: DataFrame, make, names: list[str]) -> DataFrame:
    """Rows of numbers that make(d, *arrays) gives for each document of packed (d, arrays of 64-bit numbers)."""

    def run(batches):
        for batch in sliced(batches, 64):
            for d, *arrays in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                columns = make(d, *(np.frombuffer(a or b"", np.int64) for a in arrays))
                for i in range(0, len(columns[0]), 65536):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 65536], pa.int64()) for c in columns], names=names)

    return packed.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _packed(rows: DataFrame) -> DataFrame:
    """(d, v: 64-bit numbers) of rows (d, i, v), in order of i."""

    def run(batches):
        now, held = None, []
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["d", "v"])
        for batch in batches:
            d, v = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(d)) + 1).tolist(), len(d)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if j == i:
                    continue
                if d[i] != now:
                    if held:
                        yield out()
                    now, held = int(d[i]), []
                held.append(v[i:j].copy())
        if held:
            yield out()

    return rows.select("d", "i", "v").repartition("d").sortWithinPartitions("d", "i").mapInArrow(run, "d long, v binary")


def _in_ranges(rows: DataFrame, keys: list[str], step, name: str, schema: str) -> tuple[DataFrame, list[tuple[int, dict]]]:
    """rows range-sorted by keys, d and i, through step() a range, as a kept table with its range's number; and what each range's step ends with, in order."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        part, work = TaskContext.get().partitionId(), step()
        kinds = None
        for batch in batches:
            if batch.num_rows:
                made = work.add(batch)
                kinds = [c.type for c in made]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part), pa.int32()), pa.nulls(batch.num_rows, pa.string()), *made], names=["part", "summary", *names])
        if kinds:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([json.dumps(work.end())]), *[pa.nulls(1, k) for k in kinds]], names=["part", "summary", *names])

    kept = keep(rows.repartitionByRange(*keys, "d", "i").sortWithinPartitions(*keys, "d", "i").mapInArrow(run, f"part int, summary string, {schema}"), name, 65536)
    ends = [(r["part"], json.loads(r["summary"])) for r in kept.where("summary is not null").select("part", "summary").orderBy("part").collect()]  # a short row a range
    return kept.where("summary is null").drop("summary"), ends


class _Counts:
    """For each row of a sorted range: how many rows of each class have a lesser key."""

    def __init__(self, width: int):
        self.width, self.last, self.first = width, None, None
        self.total, self.start, self.in_first = np.zeros(3, np.int64), np.zeros(3, np.int64), True

    def add(self, batch):
        keys = np.stack([batch.column(k).to_numpy() for k in range(self.width)], 1)
        cls, d, i = (batch.column(self.width + k).to_numpy() for k in range(3))
        new = np.concatenate([[self.last is None or (keys[0] != self.last).any()], (keys[1:] != keys[:-1]).any(1)])
        if self.first is None:
            self.first = keys[0].tolist()
        own = np.eye(3, dtype=np.int64)[cls]
        before = self.total + np.cumsum(own, 0) - own
        at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        less = np.where((at < 0)[:, None], self.start, before[at])
        runs = np.cumsum(new) - (1 if self.last is None else 0)
        opening = (runs == 0) & self.in_first
        self.in_first = bool(opening[-1])
        self.last, self.start, self.total = keys[-1], less[-1], before[-1] + own[-1]
        return [pa.array(d), pa.array(i), pa.array(cls.astype(np.int32)), pa.array(opening), *(pa.array(less[:, k]) for k in range(3))]

    def end(self):
        return {"first": self.first, "last": self.last.tolist(), "total": self.total.tolist(), "start": self.start.tolist(), "one": self.in_first}


def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(d, i, cls, less0, less1, less2) of rows (keys, cls, d, i): rows of each class with a strictly lesser key, over all ranges."""
    told, ends = _in_ranges(rows.select(*keys, "cls", "d", "i"), keys, lambda: _Counts(len(keys)), "suffix-counted", "d long, i long, cls int, opening boolean, less0 long, less1 long, less2 long")
    base, last, last_start, table = np.zeros(3, np.int64), None, np.zeros(3, np.int64), []
    for part, end in ends:
        opening = last_start if end["first"] == last else base
        table.append((part, *base.tolist(), *opening.tolist()))
        last_start = opening if end["one"] else base + np.array(end["start"])
        last, base = end["last"], base + np.array(end["total"])
    offsets = rows.sparkSession.createDataFrame(table, "part int, b0 long, b1 long, b2 long, o0 long, o1 long, o2 long")
    met = told.join(F.broadcast(offsets), "part")  # a row a range
    return met.select("d", "i", "cls", *[F.when(F.col("opening"), F.col(f"o{k}")).otherwise(F.col(f"b{k}") + F.col(f"less{k}")).alias(f"less{k}") for k in range(3)])


def _samples(n: int) -> tuple[np.ndarray, int]:
    """Sampled places in the order of the next string, and how many of them are 1 mod 3; one more at the end where the last place would have no neighbour."""
    at = np.arange(n + (n % 3 == 1))
    one = at[at % 3 == 1]
    return np.concatenate([one, at[at % 3 == 2]]), len(one)


def ranks(packed: DataFrame, covered: int = 1) -> DataFrame:
    """(d, i, v): how many suffixes of the strings (d, v: numbers from 1 on) are less, of every suffix; equal ones may have equal counts."""

    def triples(d, s):
        at, _ = _samples(len(s))
        s = np.concatenate([s, np.zeros(3, np.int64)])
        return [s[at], s[at + 1], s[at + 2], np.zeros(len(at), np.int64), np.full(len(at), d), np.arange(len(at))]

    named = counted(_emit(packed, triples, ["a", "b", "c", "cls", "d", "i"]), ["a", "b", "c"]).select("d", "i", (F.col("less0") + 1).alias("v"))
    reduced = keep(_packed(named), "suffix-names")
    if 3 * covered < LENGTH:
        reduced = keep(_packed(ranks(reduced, 3 * covered).withColumn("v", F.col("v") + 1)), "suffix-ranks")
    both = keep(packed.join(reduced.withColumnRenamed("v", "r"), "d", "left"), "suffix-both")
    extra = packed.where(F.octet_length("v") / 8 % 3 == 1).count()  # ends that stand before all else

    def placed(s, r):
        at, _ = _samples(len(s))
        rank = np.zeros(len(s) + 3, np.int64)
        rank[at] = r
        return np.concatenate([s, np.zeros(3, np.int64)]), rank

    def against(other):
        def make(d, s, r):
            s, rank = placed(s, r)
            at = np.arange(len(s) - 3)
            at = at[(at % 3 == 0) | (at % 3 == other)]
            keys = [s[at], rank[at + 1]] if other == 1 else [s[at], s[at + 1], rank[at + 2]]
            return [*keys, at % 3, np.full(len(at), d), at]

        names = ["a", "b"] if other == 1 else ["a", "b", "c"]
        return counted(_emit(both, make, [*names, "cls", "d", "i"]), names)

    def samples(d, s, r):
        at, _ = _samples(len(s))
        keep_it = at < len(s)
        return [np.full(int(keep_it.sum()), d), at[keep_it], r[keep_it] - 1 - extra]

    one, two = against(1), against(2)
    parts = [
        one.select("d", "i", F.when(F.col("cls") == 0, F.col("less0") + F.col("less1")).otherwise(F.col("less0")).alias("v")),
        two.select("d", "i", F.when(F.col("cls") == 0, F.col("less2")).otherwise(F.col("less0")).alias("v")),
        _emit(both, samples, ["d", "i", "v"]),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("d", "i").agg(F.sum("v").alias("v"))


class _Prefixes:
    """Numbers of the groups of equal prefixes in a sorted range."""

    def __init__(self):
        self.first = self.last = None
        self.n = 0

    def add(self, batch):
        values = batch.column(3).to_pylist()
        new = [a != b for a, b in zip(values, [self.last, *values[:-1]], strict=True)]
        if self.first is None:
            self.first = values[0]
        group = self.n + np.cumsum(new)
        self.last, self.n = values[-1], int(group[-1])
        return [batch.column(1), batch.column(2), pa.array(group)]

    def end(self):
        return {"first": self.first.hex(), "last": self.last.hex(), "n": self.n}


def repeated_places(docs: DataFrame) -> DataFrame:
    """(doc_id, start) of the strings of LENGTH bytes that start earlier too, in documents (doc_id, text) of distinct ids."""
    texts = keep(docs.select(F.col("doc_id").cast("long").alias("d"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("t")), "suffix-texts")

    def widen(batches):
        for batch in sliced(batches, 64):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([(np.frombuffer(t, np.uint8).astype(np.int64) + 1).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["d", "v"])

    order = _packed(ranks(texts.where(F.octet_length("t") > 0).mapInArrow(widen, "d long, v binary")))
    both = texts.join(order, "d")

    def strings(batches):
        for batch in sliced(batches, 16):
            for d, t, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = np.frombuffer(v, np.int64)
                for i in range(0, len(t) - LENGTH + 1, 8192):
                    m = min(8192, len(t) - LENGTH + 1 - i)
                    yield pa.RecordBatch.from_arrays([pa.array(v[i : i + m]), pa.array(np.full(m, d)), pa.array(np.arange(i, i + m)), pa.array([t[k : k + LENGTH] for k in range(i, i + m)], pa.binary())], names=["v", "d", "i", "p"])

    rows = both.mapInArrow(strings, "v long, d long, i long, p binary")
    told, ends = _in_ranges(rows, ["v"], _Prefixes, "suffix-neighbours", "d long, i long, g long")
    table, base, last = [], 0, None
    for part, end in ends:
        base -= end["first"] == last
        table.append((part, base))
        base, last = base + end["n"], end["last"]
    named = told.join(F.broadcast(docs.sparkSession.createDataFrame(table, "part int, b long")), "part").select("d", "i", (F.col("g") + F.col("b")).alias("g"))  # a row a range
    first = keep(named.groupBy("g").agg(F.min(F.struct("d", "i")).alias("f"), F.count("*").alias("n")).where("n > 1").select("g", "f"), "suffix-first")
    met = spread_join(named, first, "g", first.count(), MOST_GROUPS)
    return met.where(F.col("f").isNotNull() & (F.struct("d", "i") != F.col("f"))).select(F.col("d").alias("doc_id"), F.col("i").alias("start"))
