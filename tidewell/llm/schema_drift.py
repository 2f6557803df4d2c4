"""Rewrites a folder of Parquet files whose schemas drifted into one evolved schema.

Columns are matched by their Parquet field ids alone. A file's footer tells its drift, four
bits: RENAMED (an id has another name), REORDERED (ids stand in another order), MISSING (ids are
not there), NARROW (an id has a type that widens without loss). Each bit has one transform on Arrow
data, and a file's migration is the chain of those that its bits ask for, in the order
widen, add, reorder, rename, fused into a single pass: a task streams a file batch by batch through
the chain, so a batch is touched once and no file is ever whole in memory. Files without drift stay as
they are, unread but for the footer.

A rewritten file appears under its final name only when it is complete, and the file it replaces is
deleted only after the list of all rewritten files is written. Every step can be done again: an
attempt that was lost leaves nothing but a file in a working folder, which is removed at the end. Between
the two steps a reader of the folder may see a file and what replaces it.

write_drifted() makes such a folder: rows in a total order, cut into files by their rank. Ranks come from a
range sort and the number of rows in each of its at most MOST_PARTS parts.

Nulls stay null; a column that was missing holds its default in every row, or null if it
has none. A file without rows becomes one without rows. A file that lacks field ids, has an id twice or
one the schema does not know, or a type that does not widen, is an error that names the file. Files of
names that begin with `_` or `.` are no data files. In write_drifted() a null id sorts first, rows of
equal ids follow a hash of all their columns, rows that are equal in all are interchangeable, and
other columns are ignored, whatever their names. No rows: no files and no result rows.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import BATCH_ROWS, keep, shared_dir
from tidewell.llm.warc import open_fs

RENAMED, REORDERED, MISSING, NARROW = 1, 2, 4, 8
#: Rows that a task holds of a file, and of a row group that it writes.
ROWS = 1 << 15
#: Parts of the range sort, whose row counts go to the driver.
MOST_PARTS = 1024
#: Type to the types that it widens to.
WIDENS = {pa.int8(): (pa.int16(), pa.int32(), pa.int64()), pa.int16(): (pa.int32(), pa.int64()), pa.int32(): (pa.int64(), pa.float64()), pa.float32(): (pa.float64(),), pa.string(): (pa.large_string(),), pa.binary(): (pa.large_binary(),)}
_ID = b"PARQUET:field_id"


@dataclass(frozen=True)
class Evolved:
    """The schema that files shall have: (name, type) of field ids 1, 2, ..., all nullable; defaults by id for columns that a file lacks."""

    columns: tuple[tuple[str, pa.DataType], ...]
    defaults: dict[int, object] = field(default_factory=dict)

    @property
    def schema(self) -> pa.Schema:
        return pa.schema([with_id(pa.field(name, kind), i) for i, (name, kind) in enumerate(self.columns, 1)])


def with_id(f: pa.Field, number: int) -> pa.Field:
    return f.with_nullable(True).with_metadata({_ID: str(number).encode()})


def ids_of(schema: pa.Schema) -> list[int]:
    """The field ids of a file's columns, in their order."""
    out = [int((f.metadata or {}).get(_ID, -1)) for f in schema]
    if min(out, default=0) < 0 or len(set(out)) < len(out):
        raise ValueError(f"field ids are missing or repeated: {out}")
    return out


def drift_of(schema: pa.Schema, evolved: Evolved) -> int:
    """The drift bits of a file's footer."""
    ids, want = ids_of(schema), evolved.schema
    if unknown := [i for i in ids if not 1 <= i <= len(want)]:
        raise ValueError(f"field ids {unknown} are not in the schema")
    bits = 0
    for f, i in zip(schema, ids, strict=True):
        goal = want.field(i - 1)
        if f.type != goal.type:
            if goal.type not in WIDENS.get(f.type, ()):
                raise ValueError(f"field {i}: {f.type} does not widen to {goal.type}")
            bits |= NARROW
        bits |= RENAMED * (f.name != goal.name)
    return bits | REORDERED * (ids != sorted(ids)) | MISSING * (len(ids) < len(want))


Transform = Callable[[pa.Table, Evolved], pa.Table]


def widen(table: pa.Table, evolved: Evolved) -> pa.Table:
    """Columns in the types of the schema."""
    want = evolved.schema
    for at, i in enumerate(ids_of(table.schema)):
        old, kind = table.schema.field(at), want.field(i - 1).type
        if old.type != kind:
            table = table.set_column(at, old.with_type(kind), table.column(at).cast(kind))
    return table


def add(table: pa.Table, evolved: Evolved) -> pa.Table:
    """Missing columns, with their defaults, each before the first that has a larger id in a table of rising ids, else at the end."""
    for i, f in enumerate(evolved.schema, 1):
        ids = ids_of(table.schema)
        if i not in ids:
            at = next((k for k, x in enumerate(ids) if x > i), len(ids)) if ids == sorted(ids) else len(ids)
            table = table.add_column(at, f, pa.repeat(pa.scalar(evolved.defaults.get(i), f.type), table.num_rows))
    return table


def reorder(table: pa.Table, evolved: Evolved) -> pa.Table:
    """Columns by rising ids."""
    ids = ids_of(table.schema)
    return table.select(sorted(range(len(ids)), key=ids.__getitem__))


def rename(table: pa.Table, evolved: Evolved) -> pa.Table:
    """Columns with the names of the schema."""
    return pa.Table.from_arrays(table.columns, schema=pa.schema([with_id(pa.field(evolved.columns[i - 1][0], f.type), i) for f, i in zip(table.schema, ids_of(table.schema), strict=True)]))


CHAIN: tuple[tuple[int, Transform], ...] = ((NARROW, widen), (MISSING, add), (REORDERED, reorder), (RENAMED, rename))


def migration(bits: int, evolved: Evolved) -> Callable[[Iterable[pa.Table]], Iterator[pa.Table]]:
    """The chain of the transforms that the bits ask for, as one lazy pass. Added columns of files that are reordered too find their place there."""
    steps = [f for bit, f in CHAIN if bits & bit]

    def run(tables: Iterable[pa.Table]) -> Iterator[pa.Table]:
        for table in tables:
            for step in steps:
                table = step(table, evolved)
            yield table

    return run


def batches_in(file: pq.ParquetFile, rows: int = ROWS) -> Iterator[pa.Table]:
    """A file's rows in order, so many at a time, with the footer's schema."""
    schema = file.schema_arrow
    for batch in file.iter_batches(batch_size=rows):
        yield pa.Table.from_batches([batch]).cast(schema)


def publish(system, source: str, target: str) -> None:
    """Gives a complete file its final name. Where another attempt was first its file stays: both hold the same rows."""
    from pyarrow import fs

    there = lambda path: system.get_file_info(path).type == fs.FileType.File
    if there(target):
        if there(source):
            system.delete_file(source)
        return
    try:
        system.move(source, target)
    except OSError:
        if not there(target):
            raise


def _tasks(files: DataFrame, per_task: int = 64) -> DataFrame:
    """files dealt over tasks: one each while they are few."""
    n = files.count()
    return files.repartition(max(1, min(n, max(4 * files.sparkSession.sparkContext.defaultParallelism, per_task, n // per_task))))


def rewrite(files: DataFrame, evolved: Evolved) -> DataFrame:
    """Rewrites files (path, other columns) in their folder; per file its other columns, start_path, start_columns, drift, path, rewritten.

    path: the file that holds the rows now; start_path is gone where rewritten.
    """
    spark, folder = files.sparkSession, f"_rewrite-{uuid.uuid4().hex}"
    others = [c for c in files.columns if c != "path"]
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "path"] + ["start_path string", "start_columns string", "drift int", "path string", "rewritten boolean"])
    listed = files.select("path", *others)

    def work(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for path in batch.column(0).to_pylist():
                system, where = open_fs(path)
                parent, _, name = where.rpartition("/")
                with system.open_input_file(where) as opened, pq.ParquetFile(opened) as file:
                    try:
                        bits = drift_of(file.schema_arrow, evolved)
                    except ValueError as e:
                        raise ValueError(f"{path}: {e}") from e
                    new = path
                    if bits:
                        new = f"{path.removesuffix('.parquet')}-evolved.parquet"
                        made, attempt = f"{parent}/{folder}/{name}", f"{parent}/{folder}/{uuid.uuid4().hex}"
                        system.create_dir(f"{parent}/{folder}", recursive=True)
                        with system.open_output_stream(attempt) as sink, pq.ParquetWriter(sink, evolved.schema, compression="zstd") as writer:
                            for table in migration(bits, evolved)(batches_in(file)):
                                writer.write_table(table, row_group_size=ROWS)
                        publish(system, attempt, made)
                    for column, x in zip(out, (path, ",".join(file.schema_arrow.names), bits, new, bits > 0), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *map(pa.array, out, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_()))], names=[*batch.schema.names[1:], "start_path", "start_columns", "drift", "path", "rewritten"])

    done = keep(_tasks(listed).mapInArrow(work, kinds), "rewrite-made")

    def finish(batches):
        for batch in batches:
            for start, new, rewritten in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("start_path", "path", "rewritten")), strict=True):
                if rewritten:
                    system, old = open_fs(start)
                    parent, _, name = old.rpartition("/")
                    publish(system, f"{parent}/{folder}/{name}", open_fs(new)[1])
                    if system.get_file_info(old).is_file:
                        system.delete_file(old)
            yield batch

    out = keep(_tasks(done).mapInArrow(finish, done.schema), "rewrite-done")
    _remove_working(out, folder, spark)
    return out


def _remove_working(done: DataFrame, folder: str, spark: SparkSession) -> None:
    """Deletes the working folder beside each file; folders are few beside files."""
    jvm = spark._jvm
    for (parent,) in done.where("rewritten").select(F.regexp_replace("start_path", "/[^/]*$", "")).distinct().toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(f"{parent}/{folder}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ranked(df: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """df with `rank` (from 0, in the order; the last ties by a hash of the row), and its number of rows.

    Rows are sorted by range and kept with their place in their part; a part's first rank
    is the number of rows in the parts before it, at most MOST_PARTS numbers.
    """
    spark = df.sparkSession
    parts = min(MOST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [f"__k{i}" for i in range(len(order))]
    # The last key parts rows that are equal in all, so that many copies of one row don't meet in one part.
    keyed = df.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)], F.xxhash64(*df.columns).alias("__row")).withColumn("__copy", F.xxhash64(F.monotonically_increasing_id()))
    by = [*[F.col(k).asc_nulls_first() for k in keys], F.col("__row"), F.col("__copy")]
    sorted_rows = keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop(*keys, "__row", "__copy").withColumn("__at", F.monotonically_increasing_id())
    kept = keep(sorted_rows, "ranked", BATCH_ROWS)
    part = F.shiftright("__at", 33)
    sizes = dict(kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts = dict(zip(sorted(sizes), itertools.accumulate((sizes[p] for p in sorted(sizes)), initial=0)))  # noqa: B905  one more than parts
    before = F.element_at(F.array(*[F.lit(starts.get(p, 0)).cast("long") for p in range(max(starts, default=0) + 1)]), part.cast("int") + 1)
    return kept.withColumn("rank", before + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at"), sum(sizes.values())


def drifted(evolved: Evolved, bits: int, missing: tuple[int, ...], narrow: dict[int, pa.DataType], swapped: tuple[int, int]) -> pa.Schema:
    """The schema of a file that drifts by these bits: ids whose columns are missing, narrower types by id, two ids that swap their names; reordered: all behind the first in reverse."""
    fields = list(evolved.schema)
    if bits & NARROW:
        fields = [with_id(f.with_type(narrow.get(i, f.type)), i) for i, f in enumerate(fields, 1)]
    if bits & RENAMED:
        a, b = (fields[i - 1].name for i in swapped)
        fields = [with_id(f.with_name({a: b, b: a}.get(f.name, f.name)), i) for i, f in enumerate(fields, 1)]
    if bits & MISSING:
        fields = [f for i, f in enumerate(fields, 1) if i not in missing]
    return pa.schema(fields[:1] + fields[:0:-1] if bits & REORDERED else fields)


def file_version(file_no: int, salt: str, kinds: int = 24, most: int = 15) -> int:
    """Drift bits that a file of this number is written with."""
    version = crc32(f"{salt}:{file_no}".encode()) % kinds
    return version if version <= most else 0


def write_drifted(rows: DataFrame, evolved: Evolved, order: list[Column], n_files: int, salt: str, **drift) -> DataFrame:
    """Writes rows into a new shared folder, row r of the order to file r div (1 + rows div n_files); (file_no, path) of the files.

    A file is written by one task, row group by row group; drift: the arguments of drifted().
    """
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/drift-{uuid.uuid4().hex}"
    names = [name for name, _ in evolved.columns]
    placed, n = ranked(rows.select(*names), order)
    per_file = 1 + n // n_files
    files = max(1, -(-n // per_file))
    full = placed.select(*names, F.expr(f"cast(rank div {per_file} as int)").alias("file_no"), "rank")

    def write(batches):
        system, where = open_fs(folder)
        system.create_dir(f"{where}/_attempts", recursive=True)
        open_no, writer, sink, schema, attempt, held, done = None, None, None, None, "", [], []

        def flush():
            table = pa.Table.from_batches(held)
            columns = [table.column(int(f.metadata[_ID]) - 1).cast(f.type, safe=False) for f in schema]
            writer.write_table(pa.Table.from_arrays(columns, schema=schema), row_group_size=ROWS)
            held.clear()

        def close():
            if held:
                flush()
            writer.close()
            sink.close()
            name = f"part-{open_no:05d}.parquet"
            publish(system, attempt, f"{where}/{name}")
            done.append((open_no, f"{folder}/{name}"))

        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column(len(names)).to_numpy()
            cuts = [0, *(i + 1 for i in (numbers[1:] != numbers[:-1]).nonzero()[0]), len(numbers)]
            for a, b in itertools.pairwise(cuts):
                if numbers[a] != open_no:
                    if writer is not None:
                        close()
                    open_no, attempt = int(numbers[a]), f"{where}/_attempts/{uuid.uuid4().hex}"
                    schema = drifted(evolved, file_version(open_no, salt), **drift)
                    sink = system.open_output_stream(attempt)
                    writer = pq.ParquetWriter(sink, schema, compression="zstd")
                piece = batch.slice(a, b - a)
                held.append(pa.RecordBatch.from_arrays([c.cast(kind) for c, (_, kind) in zip(piece.columns, evolved.columns, strict=False)], schema=evolved.schema))
                if sum(x.num_rows for x in held) >= ROWS:
                    flush()
        if writer is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.string())], names=["file_no", "path"])

    whole = full.repartitionById(files, F.col("file_no")).sortWithinPartitions("file_no", "rank")
    made = keep(whole.mapInArrow(write, "file_no int, path string"), "drift-files", ROWS)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_attempts")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return made


def texts_of(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """Values as text: times in microseconds, floating point as the integer below 2**20 times the value."""
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64())
    elif pa.types.is_floating(column.type):
        values = column.to_pylist()
        return pa.array([None if v is None else str(math.floor(1048576 * v)) if math.isfinite(1048576 * v) else str(v) for v in values], pa.string())
    return column.cast(pa.string())


def digests(files: DataFrame) -> DataFrame:
    """files (path, other columns) with what their rows are: columns (names), n_rows, n_nulls, ids_sha256 (of the first column), rows_sha256; read batch by batch."""
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema] + ["columns string", "n_rows long", "n_nulls long", "ids_sha256 string", "rows_sha256 string"])

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for path in batch.column(batch.schema.get_field_index("path")).to_pylist():
                system, where = open_fs(path)
                ids, rows, n, nulls = hashlib.sha256(), hashlib.sha256(), 0, 0
                with system.open_input_file(where) as opened, pq.ParquetFile(opened) as file:
                    names = file.schema_arrow.names
                    for table in file.iter_batches(batch_size=ROWS):
                        texts = [texts_of(c).fill_null("?") for c in table.columns]
                        if n and table.num_rows:
                            ids.update(b",")
                            rows.update(b"\n")
                        n, nulls = n + table.num_rows, nulls + sum(c.null_count for c in table.columns)
                        ids.update(",".join(texts[0].to_pylist()).encode())
                        rows.update("\n".join(pc.binary_join_element_wise(*texts, "|").to_pylist()).encode())
                for column, x in zip(out, (",".join(names), n, nulls, ids.hexdigest(), rows.hexdigest()), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=[*batch.schema.names, "columns", "n_rows", "n_nulls", "ids_sha256", "rows_sha256"])

    return _tasks(files).mapInArrow(run, kinds)
