"""Benchmark decontamination by Wu-Manber search over words.

The test strings are the 13-word windows of the benchmark items (an item of fewer
words is one window). They are grouped by length. For each length a shift table maps
the hash-free block of the last B words under the search head to how far the head may
jump; a block that no string holds lets it jump over nearly a whole window. At shift 0
the bucket of that suffix block lists the strings that end so, and a direct comparison
of all words confirms each occurrence.

Documents are never shuffled or rewritten: every task scans whole texts against the tables. The
benchmark is searched in blocks of items of bounded size, each one broadcast and one pass over the texts
as they came; a Python worker builds a block's tables once and keeps no other's. What a pass finds is
kept by digest of the text (equal texts have equal occurrences), for texts with occurrences only; the last
pass takes up what the ones before found and counts.

Nulls: a null text has no words; a null item id or an item without words gives no
string. Repeated rows are judged alike, one output row each. Empty tables give an
empty result or untouched documents. Other columns are never looked at by name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import keep, need_free, sliced, spread_join

WINDOW = 13
#: Words of a block of the shift table.
BLOCK = 3
#: UTF-8 bytes of item texts that one broadcast of search tables may hold.
MOST_BYTES = 4 << 20
#: Texts with occurrences in blocks before the last, up to which what was found is broadcast.
MOST_HITS = 100_000

#: Word bytes keep their value in lower case; all others become spaces.
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` in lower case; none of a null."""
    return [] if text is None else [w for w in text.translate(_WORDS).split(b" ") if w]


class Searcher:
    """Wu-Manber tables over (item_id, words) strings of one or more lengths."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW, block: int = BLOCK):
        strings: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
        for item, words in items:
            n = min(window, len(words))
            for i in range(len(words) - n + 1) if n else ():
                strings.setdefault(n, {}).setdefault(tuple(words[i : i + n]), set()).add(item)
        self.tables = []
        for n, found in sorted(strings.items()):
            b = min(block, n)
            shift: dict[tuple[bytes, ...], int] = {}
            bucket: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = {}
            for s in found:
                for end in range(b, n + 1):
                    key, jump = s[end - b : end], n - end
                    if shift.get(key, n) > jump:
                        shift[key] = jump
                bucket.setdefault(s[n - b :], []).append(s)
            self.tables.append((n, b, n - b + 1, shift, bucket, found))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(start, end) word spans of all occurrences, and the items they come from."""
        spans, items, size = [], set(), len(words)
        for n, b, far, shift, bucket, found in self.tables:
            head = n
            while head <= size:
                key = tuple(words[head - b : head])
                jump = shift.get(key, far)
                if jump:
                    head += jump
                    continue
                start = head - n
                for s in bucket[key]:
                    if tuple(words[start:head]) == s:
                        spans.append((start, head))
                        items |= found[s]
                head += 1
        return spans, items


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside at least one span."""
    total, reach = 0, 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int = MOST_BYTES) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark as lists of (item, words), each of bounded size, whatever the table's size; read partition by partition."""
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull())
    block, held = [], 0
    for item, text in rows.toLocalIterator():
        raw = text.encode()
        if block and held + len(raw) > most:
            yield block
            block, held = [], 0
        block.append((item, words_of(raw)))
        held += len(raw)
    yield block


_held: tuple[str, Searcher] | None = None


def searcher_of(key: str, items: list[tuple[str, list[bytes]]], window: int) -> Searcher:
    """The tables of a block, built once a Python worker; those of the block before go."""
    global _held
    if _held is None or _held[0] != key:
        _held = None
        _held = (key, Searcher(items, window))
    return _held[1]


def occurrences(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: list[str] | None = None, window: int = WINDOW) -> DataFrame:
    """Per row of docs: its carried columns, n_words, n_hit and items (sorted array of item ids).

    carry: the columns to keep (default: id_col only); n_words, n_hit, items and names with two underscores in
    front that the scan uses are an error among them.
    """
    spark = docs.sparkSession
    carry = carry if carry is not None else [id_col]
    need_free(docs.select(*carry), ["n_words", "n_hit", "items", "__text", "__spans", "__items", "__digest"])
    text, digest = F.col(text_col).alias("__text"), F.md5(text_col).alias("__digest")
    kept = docs.select(*[F.col(c) for c in carry], digest, text)
    found, block, blocks = None, None, item_blocks(benchmark, item_col, item_text_col)
    for after in blocks:
        if block is not None:
            found = _pass(docs.select(digest, text), block, window, found)
        block = after
    out = T.StructType([*kept.schema.fields[: len(carry)], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))])
    if found is None:
        kept = kept.drop("__digest").withColumns({"__spans": F.array().cast("array<int>"), "__items": F.array().cast("array<string>")})
    else:
        merged = keep(found.groupBy("__digest").agg(F.flatten(F.collect_set("spans")).alias("__spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("__items")), "decontamination-hits")
        kept = spread_join(kept, merged, "__digest", merged.count(), MOST_HITS).select(*carry, "__text", "__spans", "__items")
    shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

    def scan(batches):
        searcher = searcher_of(key, shared.value, window)
        for batch in sliced(batches):
            at = len(carry)
            texts, spans, items = batch.column(at).cast(pa.binary()).to_pylist(), batch.column(at + 1).to_pylist(), batch.column(at + 2).to_pylist()
            sizes, hits = [], []
            for i, raw in enumerate(texts):
                words = words_of(raw)
                before = spans[i] or []
                more, names = searcher.search(words)
                sizes.append(len(words))
                hits.append(covered([*zip(before[::2], before[1::2], strict=True), *more]))
                items[i] = sorted({*(items[i] or []), *names})
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(sizes, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string()))], names=[*batch.schema.names[:at], "n_words", "n_hit", "items"])

    return kept.mapInArrow(scan, out)


def _pass(texts: DataFrame, block: list[tuple[str, list[bytes]]], window: int, before: DataFrame | None) -> DataFrame:
    """(digest, spans, items) of the texts in which strings of a block occur, added to those of the blocks before."""
    shared, key = texts.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def scan(batches):
        searcher = searcher_of(key, shared.value, window)
        for batch in sliced(batches):
            found = [[], [], []]
            for digest, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                more, names = searcher.search(words_of(raw))
                if more:
                    for column, x in zip(found, (digest, [x for s in more for x in s], sorted(names)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, (pa.string(), pa.list_(pa.int32()), pa.list_(pa.string())), strict=True)], names=["__digest", "spans", "items"])

    own = keep(texts.mapInArrow(scan, "__digest string, spans array<int>, items array<string>"), "decontamination-pass")
    shared.destroy()
    return own if before is None else before.unionByName(own)


def is_contaminated(n_words: Column, n_hit: Column) -> Column:
    """At least a twentieth of the words lie inside benchmark windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated rows, columns as they were."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    found = occurrences(plain, benchmark, f"c{names.index(id_col)}", f"c{names.index(text_col)}", carry=plain.columns)
    return found.where(~is_contaminated(F.col("n_words"), F.col("n_hit"))).select(*plain.columns).toDF(*names)
