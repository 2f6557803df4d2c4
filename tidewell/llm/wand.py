"""Ranked lexical search by Block-Max WAND over an index of compressed posting blocks.

Index: every task cuts the documents it reads into shards of bounded text and writes, per
shard and term, the postings (document, occurrences) in blocks of BLOCK. A block is a run
of variable-length bytes; beside it stand its last document and the largest impact in it. The
whole index is a table in the shared folder. Nothing of the corpus is shuffled for it, and a term that
stands in every document is as many rows as there are shards.

Search: the rows of the queries' terms meet by shard. A document's bound begins as the sum
of the block maxima that cover it, which takes no decompression (the shallow move). A shard whose
bounds together stay below the threshold is passed at once. Else terms are taken from
the largest bound to the smallest: only blocks that still cover a document at or above the
threshold are decompressed, and exact impacts replace their maxima, so bounds fall until what is
left is exact. The threshold is the k-th best score so far, carried through all shards of a task. So
WAND's pivot test is made for all documents of a shard at a time, on arrays, instead of for one
cursor position after another.

Queries are searched in blocks of bounded size; each is one broadcast and one pass over
the index. A task passes on k rows a query, which are cut to k again in two steps where tasks are many.

Every row of documents is one document, repeated rows too; one without terms (null, empty,
only other characters) is not counted and never found. A null doc_id is found like others and
stands before all ids at equal scores. Every row of queries is one query, repeated rows and null
ids too; one without terms finds nothing. Empty tables give no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewell.llm.common import keep, sliced
from tidewell.llm.decontamination import words_of

#: Postings of a block.
BLOCK = 128
#: UTF-8 bytes of texts, and documents, that a shard takes at most (one longer text is a shard of its own).
SHARD_BYTES = 32 << 20
SHARD_DOCS = 1 << 14
#: UTF-8 bytes of query texts that are searched in one pass.
MOST_BYTES = 4 << 20
#: Tasks up to which their best rows meet in one step.
MOST_TASKS = 256

_INDEX = "shard long, term string, n int, lens array<int>, lasts array<int>, peaks array<int>, sizes array<int>, data binary"


@dataclass
class Index:
    """The kept table, the number of documents with a term, and of all their terms."""

    table: DataFrame
    n_docs: int
    n_terms: int


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative numbers under 2**35 as bytes of seven bits, least first; the bytes that each takes."""
    sizes = 1 + sum((values >= 1 << 7 * i).astype(np.int64) for i in range(1, 5))
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i in range(int(sizes.max()) if len(sizes) else 0):
        has = sizes > i
        out[(ends - sizes + i)[has]] = (values[has] >> 7 * i & 127) | ((sizes[has] > i + 1).astype(np.int64) << 7)
    return out, sizes


def unpack(raw: np.ndarray) -> np.ndarray:
    """What pack() packed."""
    last = np.flatnonzero(raw < 128)
    if len(last) == len(raw):
        return raw.astype(np.int64)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, first)


def pace(lens: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The length part of a document's impacts."""
    return 100 - 25 + 25 * lens * n_docs // max(1, n_terms)


def impacts(tf: np.ndarray, paces: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * paces)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class _Shard:
    """Documents of a shard as they come, and their postings."""

    def __init__(self):
        self.ids, self.lens, self.counts, self.bytes = [], [], [], 0
        self.vocabulary = defaultdict(itertools.count().__next__)
        self.terms, self.tfs = [], []

    def add(self, id_, raw: bytes) -> None:
        words = words_of(raw)
        if not words:
            return
        found = Counter(words)
        self.ids.append(id_)
        self.lens.append(len(words))
        self.counts.append(len(found))
        self.terms.append(np.fromiter(map(self.vocabulary.__getitem__, found), np.int32, len(found)))
        self.tfs.append(np.fromiter(found.values(), np.int32, len(found)))
        self.bytes += len(raw)

    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or len(self.ids) >= SHARD_DOCS

    def rows(self, shard: int, n_docs: int, n_terms: int, schema: pa.Schema) -> pa.RecordBatch:
        """One row of the documents (no term), then one of each term, sorted. Documents are numbered by id, so that ties go to the least number."""
        order = sorted(range(len(self.ids)), key=lambda i: (False,) if self.ids[i] is None else (True, self.ids[i]))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        lens = np.array(self.lens, np.int64)[order]
        names = sorted(self.vocabulary)
        rank = np.empty(len(names), np.int64)
        rank[[self.vocabulary[x] for x in names]] = np.arange(len(names))
        term, doc, tf = rank[np.concatenate(self.terms)], np.repeat(number, self.counts), np.concatenate(self.tfs).astype(np.int64)
        by = np.lexsort((doc, term))
        term, doc, tf = term[by], doc[by], tf[by]
        n = np.bincount(term, minlength=len(names))
        starts = np.cumsum(n) - n
        step = np.diff(doc, prepend=-1)
        step[starts] = doc[starts] + 1
        raw, sizes = pack(np.stack([step, tf], 1).ravel())
        blocks = -(-n // BLOCK)  # of each term
        first = np.repeat(starts, blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        last = np.append(first[1:], len(doc)) - 1
        peaks = np.maximum.reduceat(impacts(tf, pace(lens, n_docs, n_terms)[doc]), first)
        taken = np.add.reduceat(sizes, 2 * first)
        cuts = np.concatenate(([0], np.cumsum(blocks)))
        data = np.concatenate(([0], np.cumsum(np.add.reduceat(sizes, 2 * starts))))

        def lists(values):  # none for the row of the documents
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], cuts)), pa.int32()), pa.array(values, pa.int32()))

        rows = len(names) + 1
        lens_of = pa.ListArray.from_arrays(pa.array([0] + [len(lens)] * rows, pa.int32()), pa.array(lens, pa.int32()))
        ids_of = pa.ListArray.from_arrays(pa.array([0] + [len(lens)] * rows, pa.int32()), pa.array([self.ids[i] for i in order], schema.field("ids").type.value_type))
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(np.concatenate(([0], data)).astype(np.int64)), pa.py_buffer(raw)])
        columns = {
            "shard": pa.array(np.full(rows, shard), pa.int64()),
            "term": pa.array([None, *names], pa.binary()).cast(pa.string()),
            "n": pa.array(np.concatenate(([len(lens)], n)), pa.int32()),
            "lens": lens_of,
            "lasts": lists(doc[last]),
            "peaks": lists(peaks),
            "sizes": lists(taken),
            "data": held.cast(pa.binary()),
            "ids": ids_of,
        }
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms. docs: (id, text)."""

    def count(batches):
        for batch in sliced(batches):
            sizes = [len(words_of(x)) for x in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["docs", "terms"])

    row = docs.select("text").mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all rows of docs."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n_docs, n_terms = corpus_size(named)
    out = T.StructType([*T.StructType.fromDDL(_INDEX).fields, T.StructField("ids", T.ArrayType(named.schema["id"].dataType))])
    schema = to_arrow_schema(out)

    def build(batches):
        task, made, shard = TaskContext.get().partitionId(), itertools.count(), _Shard()
        for batch in sliced(batches):
            for id_, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                shard.add(id_, raw)
                if shard.full():
                    yield shard.rows(task << 32 | next(made), n_docs, n_terms, schema)
                    shard = _Shard()
        if shard.ids:
            yield shard.rows(task << 32 | next(made), n_docs, n_terms, schema)

    return Index(keep(named.mapInArrow(build, out), "wand-index"), n_docs, n_terms)


class Postings:
    """The blocks of one term in one shard; decompressed ones stay for the queries that follow."""

    def __init__(self, n: int, lasts, peaks, sizes, data: bytes):
        self.lasts, self.peaks = np.asarray(lasts, np.int64), np.asarray(peaks, np.int64)
        self.before = np.concatenate(([-1], self.lasts[:-1]))
        self.spans, self.top, self.end = self.lasts - self.before, int(self.peaks.max()), int(self.lasts[-1]) + 1
        self.ends, self.raw = np.concatenate(([0], np.cumsum(sizes))), np.frombuffer(data, np.uint8)
        self.per = np.full(len(self.lasts), BLOCK)
        self.per[-1] = n - BLOCK * (len(self.lasts) - 1)
        self.opened = np.zeros(len(self.lasts), bool)
        self.docs, self.impacts = np.empty(n, np.int64), np.empty(n, np.int64)

    def read(self, wanted: np.ndarray, paces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of the wanted blocks (a flag each)."""
        missing = np.flatnonzero(wanted & ~self.opened)
        if len(missing):
            gaps = np.flatnonzero(np.diff(missing) > 1)
            for a, b in zip(missing[np.concatenate(([0], gaps + 1))], missing[np.append(gaps, len(missing) - 1)] + 1, strict=True):
                values = unpack(self.raw[self.ends[a] : self.ends[b]])
                docs, at = self.before[a] + np.cumsum(values[::2]), a * BLOCK
                self.docs[at : at + len(docs)] = docs
                self.impacts[at : at + len(docs)] = impacts(values[1::2], paces[docs])
            self.opened |= wanted
        if wanted.all():
            return self.docs, self.impacts
        kept = np.repeat(wanted, self.per)
        return self.docs[kept], self.impacts[kept]


def best_of(terms: list[tuple[Postings, int]], paces: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the k best documents of a shard that score at least `least` (above 0), best first, ties by number."""
    none = np.empty(0, np.int64)
    if sum(w * t.top for t, w in terms) < least:
        return none, none
    terms = sorted(terms, key=lambda x: -x[1] * x[0].top)
    bound, sure = np.zeros(len(paces), np.int64), np.zeros(len(paces), np.int64)
    for t, w in terms:
        bound[: t.end] += np.repeat(w * t.peaks, t.spans)
    for i, (t, w) in enumerate(terms):
        live = np.concatenate(([0], np.cumsum(bound >= least)))
        if not live[-1]:
            return none, none
        wanted = live[t.lasts + 1] > live[t.before + 1]
        if wanted.any():
            docs, gained = t.read(wanted, paces)
            bound[: t.end] -= np.repeat(w * t.peaks * wanted, t.spans)
            bound[docs] += w * gained
            sure[docs] += w * gained
            if not i % 4 and live[-1] > k:
                least = max(least, int(np.partition(sure, -k)[-k]))
    left = np.flatnonzero(bound >= least)
    left = left[np.argsort(-bound[left], kind="stable")[:k]]
    return left, bound[left]


def query_blocks(queries: DataFrame, most: int = MOST_BYTES) -> Iterator[list[tuple[int, object, list[tuple[str, int]]]]]:
    """queries (item, text) as lists of (number, item, terms and how often), each of bounded size; read partition by partition."""
    block, held, number = [], 0, 0
    for item, text in queries.where(F.col("text").isNotNull()).toLocalIterator():
        raw = text.encode()
        if block and held + len(raw) > most:
            yield block
            block, held = [], 0
        block.append((number, item, [(w.decode(), n) for w, n in Counter(words_of(raw)).items()]))
        held, number = held + len(raw), number + 1
    if block:
        yield block


def _rows_of(table: pa.Table):
    return zip(*(table.column(c).to_pylist() for c in ("shard", "term", "n", "lens", "lasts", "peaks", "sizes", "data", "ids")), strict=True)


def search_index(index: Index, queries: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = 20) -> DataFrame:
    """The k best documents of every row of queries: item_id, rank, doc_id, score."""
    spark, table, n_docs, n_terms = index.table.sparkSession, index.table, index.n_docs, index.n_terms
    named = queries.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    id_type, item_type = table.schema["ids"].dataType.elementType, named.schema["item"].dataType
    shards = table.where("term is null").count()
    tasks = max(1, min(shards, max(4 * spark.sparkContext.defaultParallelism, shards // 64)))
    found = T.StructType([T.StructField("number", T.LongType()), T.StructField("task", T.LongType()), T.StructField("item_id", item_type), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    schema, parts = to_arrow_schema(found), []
    for block in query_blocks(named) if n_docs else ():
        words = spark.createDataFrame(sorted({(w,) for _, _, terms in block for w, _ in terms}), "term string")
        df = dict(table.join(F.broadcast(words), "term", "left_semi").groupBy("term").agg(F.sum("n")).collect())
        weights = {w: weight(n_docs, n) for w, n in df.items()}
        asked = spark.sparkContext.broadcast([(number, item, [(w, n * weights[w]) for w, n in terms if weights.get(w, 0) > 0]) for number, item, terms in block])
        met = table.where("term is null").unionByName(table.where("term is not null").join(F.broadcast(words), "term", "left_semi").select(*table.columns))

        def search(batches, asked=asked):
            best = [[] for _ in asked.value]
            for ids, paces, terms in shards_of(batches, n_docs, n_terms):
                for own, (_, _, wanted) in zip(best, asked.value, strict=True):
                    here = [(terms[w], x) for w, x in wanted if w in terms]
                    if here:
                        docs, scores = best_of(here, paces, k, own[-1][0] if len(own) == k else 1)
                        if len(docs):
                            own += [(s, ids[d]) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
                            own.sort(key=lambda x: (-x[0], False) if x[1] is None else (-x[0], True, x[1]))
                            del own[k:]
            task = TaskContext.get().partitionId()
            for own, (number, item, _) in zip(best, asked.value, strict=True):
                if own:
                    columns = [[number] * len(own), [task] * len(own), [item] * len(own), [x for _, x in own], [s for s, _ in own]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        parts.append(met.select("shard", "term", "n", "lens", "lasts", "peaks", "sizes", "data", "ids").repartition(tasks, "shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first()).mapInArrow(search, found))
    if not parts:
        return spark.createDataFrame([], T.StructType([found["item_id"], T.StructField("rank", T.IntegerType()), found["doc_id"], found["score"]]))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    best_first = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    if tasks > MOST_TASKS:  # first among about the square root of the tasks
        some = Window.partitionBy("number", F.pmod("task", F.lit(math.isqrt(tasks)))).orderBy(*best_first)
        rows = rows.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k).drop("rank")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*best_first)))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def shards_of(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int) -> Iterator[tuple[list, np.ndarray, dict[str, Postings]]]:
    """Index rows sorted by shard, the documents' row first, as (ids, paces, postings by term) of each shard."""
    shard, ids, paces, terms = None, [], None, {}
    for batch in batches:
        for at, term, n, lens, lasts, peaks, sizes, data, own in _rows_of(batch):
            if at != shard:
                if terms:
                    yield ids, paces, terms
                shard, terms = at, {}
            if term is None:
                ids, paces = own, pace(np.asarray(lens, np.int64), n_docs, n_terms)
            else:
                terms[term] = Postings(n, lasts, peaks, sizes, data)
    if terms:
        yield ids, paces, terms


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 20) -> DataFrame:
    """build_index() and search_index()."""
    return search_index(build_index(docs, id_col, text_col), queries, item_col, item_text_col, k)
