"""Removal of repeated substrings with suffix arrays by the difference-cover algorithm.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document of
smaller id, or earlier in the same one. Documents are read as UTF-8 and never run together.

Which strings need sorting. A document that repeats a whole text of a smaller id goes whole. Of the rest, each string of LENGTH bytes picks the least of the hashes of its GRAM-byte
pieces (winnowing); equal strings pick equal pieces, so only strings whose piece occurs again
somewhere can repeat. Tasks cut the documents into blocks and learn, by an exchange of piece hashes
with buckets, which of their pieces occur elsewhere. This filter loses nothing.

Sorting. The suffixes of what is left are ordered by the difference cover {1, 2} mod 3: the
sampled suffixes' triples are sorted and named, the names are sorted by recursion until
they are distinct, the suffixes between are sorted by their first symbol
and the sampled rank behind it, and both orders are merged. Neighbours in the order are
compared by their first LENGTH bytes. This is done by block first, so that of equal strings of a
block only the earliest goes on, and then over the blocks by pieces: all strings that pick a
piece meet in the piece's bucket. A passage that a third of all documents share so comes to
its bucket once a block.

Nulls: a null text is empty; rows with a null id come after all others, as one document. Rows of
one id are one document: of equal strings at the same start in both, neither is earlier; each row
is judged by its own text. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import discard, keep, sliced, spread_join

LENGTH = 100
GRAM = 32
BLOCK_BYTES = 1 << 20
BUCKET_BYTES = 4 << 20
#: Bytes that are hashed at a time, and copied texts' digests up to which they are broadcast; beyond, both sides are shuffled.
HASHED_BYTES = 1 << 16
MOST_COPIES = 1_000_000
#: Bytes that a bucket sorts at a time; more are cut by piece.
SORTED_BYTES = 256 << 10

_NULL_ID = np.iinfo(np.int64).max
_BLOCK = "block long, ids binary, lengths binary, text binary, places binary, hashes array<long>"


def _batch(rows, kinds, names):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names=names)


def _names(first: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Ranks of rows of non-negative numbers, equal rows alike, from 1 on."""
    key = first.astype(np.uint64)
    for column in more:
        width = int(column.max(initial=0)).bit_length()
        if int(key.max(initial=0)).bit_length() + width > 64:
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        key = (key << np.uint64(width)) | column.astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    out = np.empty(len(key), np.int32)
    out[order] = np.cumsum(np.concatenate([key[:1] == key[:1], key[1:] != key[:-1]]), dtype=np.int32)
    return out


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. symbols: numbers from 1 on; what lies past the end counts as 0."""
    n = len(symbols)
    s = np.zeros(n + 3, np.int32)
    s[:n] = symbols
    end = n + (n % 3 == 1)  # a sampled suffix at the end, so that every third one has a neighbour
    sampled = lambda x, k: np.concatenate([x[1 + k : end + k : 3], x[2 + k : end + k : 3]])
    sample = sampled(np.arange(n + 3), 0)
    named = _names(sampled(s, 0), sampled(s, 1), sampled(s, 2))
    if len(named) and named.max() < len(named):
        ranks = np.empty(len(named), np.int32)
        ranks[suffix_order(named)] = np.arange(1, len(named) + 1, dtype=np.int32)
        named = ranks
    rank = np.zeros(n + 4, np.int32)
    rank[sample] = named
    # Suffixes between the sampled ones, then all merged: against either class of samples, keys compare as the suffixes do.
    width, wide = int(rank.max()).bit_length(), int(s.max(initial=0)).bit_length()
    pair = lambda first, second: (first.astype(np.uint64) << np.uint64(width)) | second.astype(np.uint64)
    pairs = pair(s[:n:3], rank[1 : n + 1 : 3])
    sorted_pairs = np.argsort(pairs)
    rest, pairs = 3 * sorted_pairs, pairs[sorted_pairs]
    by_rank = np.zeros(int(rank.max()) + 1, np.int64)
    by_rank[named] = sample
    sample = by_rank[1:]
    sample = sample[sample < n]
    is_one = sample % 3 == 1
    ones, twos = sample[is_one], sample[~is_one]
    if 2 * wide + width <= 64:
        triple = lambda p: (s[p].astype(np.uint64) << np.uint64(wide + width)) | pair(s[p + 1], rank[p + 2])
        two_keys, rest_keys = triple(twos), triple(rest)
    else:
        both = _names(*[np.concatenate([x, y]) for x, y in ((s[twos], s[rest]), (s[twos + 1], s[rest + 1]), (rank[twos + 2], rank[rest + 2]))])
        two_keys, rest_keys = both[: len(twos)], both[len(twos) :]
    slots = np.arange(len(rest)) + np.searchsorted(pair(s[ones], rank[ones + 1]), pairs) + np.searchsorted(two_keys, rest_keys)
    order, free = np.empty(n, np.int64), np.ones(n, bool)
    order[slots] = rest
    free[slots] = False
    order[free] = sample
    return order


def repeated(text: np.ndarray, starts: np.ndarray, age: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the strings of `length` bytes at starts (ascending) equal one of smaller age."""
    if len(starts) < 2:
        return np.zeros(len(starts), bool)
    order = suffix_order(text.astype(np.int32) + 1)
    place = np.full(len(text), -1, np.int32)
    place[starts] = np.arange(len(starts), dtype=np.int32)
    sorted_starts = place[order]
    sorted_starts = sorted_starts[sorted_starts >= 0]
    at = starts[sorted_starts]
    # Adjacent prefixes, eight bytes at a time.
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.zeros(len(text), np.uint64)
    for k in range(8):
        words |= padded[k : k + len(text)].astype(np.uint64) << np.uint64(8 * k)
    live = np.arange(len(at) - 1)
    for k in [*range(0, length - 7, 8), length - 8]:
        live = live[words[at[live] + k] == words[at[live + 1] + k]]
    equal = np.zeros(len(at), bool)
    equal[live + 1] = True
    group = np.cumsum(~equal) - 1
    ages = age[sorted_starts]
    least = np.minimum.reduceat(ages, np.flatnonzero(~equal))
    out = np.zeros(len(starts), bool)
    out[sorted_starts] = ages > least[group]
    return out


def hashes_of(text: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place, by doubling."""
    h, k = text.astype(np.uint64), 1
    while k < GRAM:
        h = h[:-k] * np.uint64(0x9E3779B97F4A7C15) + (h[k:] ^ (h[k:] >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        k *= 2
    return h


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Starts of all strings of LENGTH bytes inside documents."""
    begins, sizes = np.cumsum(lengths) - lengths, np.maximum(lengths - LENGTH + 1, 0)
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def picks(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pieces that the strings at starts pick, how many strings in a row pick each, and the pieces' hashes."""
    span, found, values = LENGTH - GRAM + 1, [], []
    for begin in range(0, len(text), HASHED_BYTES):
        own = starts[np.searchsorted(starts, begin) : np.searchsorted(starts, begin + HASHED_BYTES)]
        if not len(own):
            continue
        h = hashes_of(text[begin : begin + HASHED_BYTES + LENGTH])
        key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        k = 1
        while 2 * k <= span:
            key = np.minimum(key[:-k], key[k:])
            k *= 2
        key = np.minimum(key[: len(key) - (span - k)], key[span - k :])
        at = (key[own - begin] & np.uint64(0xFFFFFF)).astype(np.int64)
        found.append(at + begin)
        values.append(h[at])
    if not found:
        return starts[:0], starts[:0], np.empty(0, np.uint64)
    at, values = np.concatenate(found), np.concatenate(values)
    new = np.flatnonzero(np.diff(at, prepend=-1))
    return at[new], np.diff(np.append(new, len(at))), values[new]


def hashes_at(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """hashes_of(text) at some places only."""
    pieces = text[places[:, None] + np.arange(GRAM)]
    return hashes_of(pieces.T)[0] if len(places) else np.empty(0, np.uint64)


def with_copies(docs: DataFrame) -> DataFrame:
    """Of rows (doc_id, text): with `copy`, true for rows of LENGTH bytes at least whose whole text a smaller id has too: all their bytes go, and they decide nothing."""
    own = docs.withColumn("h", F.when(F.octet_length("text") >= LENGTH, F.unhex(F.sha2("text", 256))))
    age = F.coalesce("doc_id", F.lit(_NULL_ID))
    least = keep(own.where("h is not null").groupBy("h").agg(F.min(age).alias("least"), F.max(age).alias("most")).where("most > least").select("h", "least"), "suffix-copies")
    joined = spread_join(own, least, "h", least.count(), MOST_COPIES)
    return joined.select("doc_id", "text", F.coalesce(age > F.col("least"), F.lit(False)).alias("copy"))


def blocks(docs: DataFrame) -> DataFrame:
    """Of rows (doc_id, text): a row a block with its texts, what its strings pick, and the distinct hashes of the picked pieces."""
    kinds = (pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64()))
    names = [x.split()[0] for x in _BLOCK.split(", ")]

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def close():
            nonlocal made
            block, made = (part << 32) | made, made + 1
            raw, lengths = b"".join(texts), np.array([len(t) for t in texts], np.int64)
            places, counts, values = picks(np.frombuffer(raw, np.uint8), starts_of(lengths))
            packed = zstandard.compress(np.stack([np.diff(places, prepend=0), counts]).astype(np.int32).tobytes(), 3)
            return _batch([(block, np.array(ids, np.int64).tobytes(), lengths.tobytes(), zstandard.compress(raw, 3), packed, np.unique(values).view(np.int64))], kinds, names)

        for batch in sliced(batches):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                text = text or b""
                if texts and size + len(text) > BLOCK_BYTES:
                    yield close()
                    ids, texts, size = [], [], 0
                ids.append(_NULL_ID if i is None else i)
                texts.append(text)
                size += len(text)
        if texts:
            yield close()

    return docs.mapInArrow(run, _BLOCK)


def elsewhere(made: DataFrame) -> DataFrame:
    """(block, shared: those of its hashes that another block has too). A hash comes once a block, so none holds more rows than there are blocks."""
    held = Window.partitionBy("h")
    pieces = made.select("block", F.explode("hashes").alias("h"))
    spread = pieces.withColumn("least", F.min("block").over(held)).withColumn("most", F.max("block").over(held)).where("least < most")
    return spread.groupBy("block").agg(F.collect_list("h").alias("shared"))


def by_group(df: DataFrame, key: str, work: Callable[[list[dict]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What work makes of the rows of each key. A group goes to Python on its own, so a batch never holds more than one block or bucket."""
    return df.groupBy(key).applyInArrow(lambda table: pa.Table.from_batches(list(work(table.to_pylist()))), schema)


def _groups(values: np.ndarray) -> list[np.ndarray]:
    """Places of each distinct value, sorted once."""
    order = np.argsort(values, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(values[order])) + 1) if len(values) else []


def _regions(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal stretches that strings at starts (ascending) cover."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.diff(starts) > LENGTH) + 1
    return starts[np.concatenate([[0], new])], starts[np.concatenate([new - 1, [len(starts) - 1]])] + LENGTH


def by_block(made: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """Of each block: its repeated starts (block, gone), and what of it goes to the buckets (block, bucket, contexts)."""
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    names = ["block", "bucket", "gone", "ids", "at", "counts", "hashes", "bytes"]

    def close(block, body, abroad):
        ids, lengths, raw = np.frombuffer(body[0], np.int64), np.frombuffer(body[1], np.int64), zstandard.decompress(body[2])
        text = np.frombuffer(raw, np.uint8)
        steps, runs = np.frombuffer(zstandard.decompress(body[3]), np.int32).reshape(2, -1).astype(np.int64)
        places = np.cumsum(steps)
        pieces = hashes_at(text, places)
        own, counts = np.unique(pieces, return_counts=True)
        wanted = np.union1d(abroad, own[counts > 1])
        known = lambda table, v: table[np.minimum(np.searchsorted(table, v), len(table) - 1)] == v if len(table) else np.zeros(len(v), bool)
        again, travels = known(wanted, pieces), known(abroad, pieces)
        starts = starts_of(lengths)[np.repeat(again, runs)]
        at, values, sent = (np.repeat(x[again], runs[again]) for x in (places, pieces, travels))
        begins, ends = _regions(starts)
        sizes = ends - begins
        shift = np.cumsum(sizes + 1) - (sizes + 1)
        pool = np.zeros(int((sizes + 1).sum()), np.uint8)
        index = np.arange(len(pool)) - np.repeat(shift, sizes + 1) + np.repeat(begins, sizes + 1)
        inside = index < np.repeat(ends, sizes + 1)
        pool[inside] = text[index[inside]]
        region = np.searchsorted(begins, starts, side="right") - 1
        doc = np.searchsorted(np.cumsum(lengths), starts, side="right")
        firsts = np.cumsum(lengths) - lengths
        order = np.unique(ids, return_inverse=True)[1]
        age = (order[doc].astype(np.int64) << 40) | (starts - firsts[doc])
        gone = repeated(pool, starts - begins[region] + shift[region], age)
        yield _batch([(block, -1, zstandard.compress(np.diff(starts[gone], prepend=0).astype(np.uint32).tobytes(), 1), None, None, None, None, None)], kinds, names)
        left = ~gone & sent
        starts, at, values, doc = starts[left], at[left], values[left], doc[left]
        if not len(starts):
            return
        cut = np.flatnonzero((np.diff(starts) != 1) | (np.diff(at) != 0)) + 1  # stretches of strings that pick the same piece
        run_at = np.concatenate([[0], cut])
        run_n = np.diff(np.append(run_at, len(starts)))
        bucket = (values[run_at] % np.uint64(buckets)).astype(np.int64)
        rows = []
        for k in _groups(bucket):
            b = int(bucket[k[0]])
            first, n = starts[run_at[k]], run_n[k]
            pieces = b"".join([raw[i:j] for i, j in zip(first.tolist(), (first + n + LENGTH - 1).tolist(), strict=True)])
            rows.append((block, b, None, ids[doc[run_at[k]]].tobytes(), np.stack([first, first - firsts[doc[run_at[k]]]]).astype(np.int64).tobytes(), n.astype(np.int32).tobytes(), values[run_at[k]].tobytes(), zstandard.compress(pieces, 3)))
        yield _batch(rows, kinds, names)

    def work(rows):
        body = next(([r[c] for c in ("ids", "lengths", "text", "places")] for r in rows if r["text"] is not None))
        shared = next((r["shared"] for r in rows if r["text"] is None), [])
        yield from close(rows[0]["block"], body, np.sort(np.array(shared, np.int64).view(np.uint64)))

    blank = lambda c: F.lit(None).cast("binary").alias(c)
    both = made.select("block", "ids", "lengths", "text", "places", F.lit(None).cast("array<long>").alias("shared")).unionByName(shared.select("block", blank("ids"), blank("lengths"), blank("text"), blank("places"), "shared"))
    return by_group(both, "block", work, "block long, bucket int, gone binary, ids binary, at binary, counts binary, hashes binary, bytes binary")


def by_bucket(told: DataFrame) -> DataFrame:
    """Of rows (block, bucket, contexts): (block, gone: starts whose string another block has earlier)."""

    def close(held):
        ids, firsts, places, own, hashes, blocks, pieces = [], [], [], [], [], [], []
        for block, i, at, counts, values, packed in held:
            n = np.frombuffer(counts, np.int32).astype(np.int64)
            at = np.frombuffer(at, np.int64).reshape(2, -1)
            ids.append(np.frombuffer(i, np.int64))
            own.append(n)
            places.append(at[0])
            firsts.append(at[1])
            hashes.append(np.frombuffer(values, np.uint64))
            blocks.append(np.full(len(n), block, np.int64))
            pieces.append(zstandard.decompress(packed))
        own, firsts, ids, blocks, places, hashes = (np.concatenate(x) for x in (own, firsts, ids, blocks, places, hashes))
        sizes = own + LENGTH - 1
        text = np.frombuffer(b"".join(pieces), np.uint8)
        begin = np.cumsum(sizes) - sizes
        order = np.unique(ids, return_inverse=True)[1].astype(np.int64)
        # The pieces of a bucket are sorted a part at a time.
        parts = -(-len(text) // SORTED_BYTES)
        part = (hashes >> np.uint64(20)) % np.uint64(parts)
        where, lost = [], []
        for k in _groups(part):
            n, size = own[k], sizes[k]
            shift = np.cumsum(size) - size
            pool = text[np.arange(int(size.sum())) + np.repeat(begin[k] - shift, size)]
            run = np.repeat(np.arange(len(k)), n)
            step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
            gone = repeated(pool, shift[run] + step, (order[k][run] << 40) | (firsts[k][run] + step))
            where.append(blocks[k][run[gone]])
            lost.append((places[k][run] + step)[gone])
        where, lost = np.concatenate(where), np.concatenate(lost)
        rows = [(int(where[k[0]]), zstandard.compress(np.diff(np.sort(lost[k]), prepend=0).astype(np.uint32).tobytes(), 1)) for k in _groups(where)]
        return _batch(rows, (pa.int64(), pa.binary()), ["block", "gone"])

    names = ("block", "ids", "at", "counts", "hashes", "bytes")
    return by_group(told.where("bucket >= 0").select("bucket", *names), "bucket", lambda rows: iter([close([tuple(r[c] for c in names) for r in rows])]), "block long, gone binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with texts, kept (binary: what is left)."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    joined = with_copies(named)
    made = keep(blocks(joined.where("not copy").select("doc_id", "text")), "suffix-blocks")
    told = keep(by_block(made, elsewhere(made), max(12, -(-size // BUCKET_BYTES))), "suffix-told")
    gone = told.where("bucket < 0").select("block", "gone").unionByName(by_bucket(told))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def close(body, found):
        ids, lengths, raw = np.frombuffer(body[0], np.int64), np.frombuffer(body[1], np.int64), zstandard.decompress(body[2])
        steps = np.zeros(len(raw) + 1, np.int32)
        for packed in found:
            starts = np.cumsum(np.frombuffer(zstandard.decompress(packed), np.uint32), dtype=np.int64)
            np.add.at(steps, starts, 1)
            np.add.at(steps, starts + LENGTH, -1)
        lost = np.cumsum(steps[:-1]) > 0
        text, rows, at = np.frombuffer(raw, np.uint8), [], 0
        for i, n in zip(ids.tolist(), lengths.tolist(), strict=True):
            own = lost[at : at + n]
            left = text[at : at + n][~own].tobytes() if own.any() else raw[at : at + n]
            spans = int(own[:1].sum()) + int((own[1:] & ~own[:-1]).sum())
            rows.append((None if i == _NULL_ID else i, n, n - len(left), spans, hashlib.sha256(left).hexdigest(), left if texts else None))
            at += n
        for i in range(0, len(rows), 256):
            yield _batch(rows[i : i + 256], kinds, names)

    def work(rows):
        body = next((r["ids"], r["lengths"], r["text"]) for r in rows if r["text"] is not None)
        yield from close(body, [r["gone"] for r in rows if r["text"] is None])

    blank = lambda c: F.lit(None).cast("binary").alias(c)
    both = made.select("block", "ids", "lengths", "text", blank("gone")).unionByName(gone.select("block", blank("ids"), blank("lengths"), blank("text"), "gone"))
    out = by_group(both, "block", work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    size = F.octet_length("text").cast("long")
    none = joined.where("copy").select("doc_id", size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.lit("" if texts else None).cast("binary").alias("kept"))
    out = out.unionByName(none)
    return out if texts else out.drop("kept")
