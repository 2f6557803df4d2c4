"""Line dedup with two Bloom filters: lines seen once, and lines seen in a second document.

1. Every task hashes its documents' line keys into two sparse bitmaps (once, twice).
   The bitmaps travel by segment, so each segment is merged in one place by
   twice = t1 | t2 | (o1 & o2); the merge streams and holds one segment.
2. The merged twice-filter goes to all tasks. Its size follows the number of lines up to
   MOST_BITS and then stays: a fuller filter only lets more lines pass to the next step.
3. Only keys that hit it are suspected. Their 16-byte digests and document ids shuffle,
   are counted exactly by key (with map-side combine), and the document that keeps a
   key is chosen. Ordinary lines never shuffle. Where confirmed keys are too many to broadcast,
   a line that very many documents share is spread over tasks.

A key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased. A key of at
least MIN_CHARS code points in at least MIN_DOCS documents loses all its lines but those in
the largest document id that holds it.

Nulls: a null text is one empty line and stays null; rows with a null id are neither
counted nor changed. Repeated rows of one id count as one document and are treated
alike. An empty table gives an empty result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import zlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import BATCH_ROWS, LOWER, batches_of, discard, keep, need_free, sliced, spread_join

MIN_CHARS = 20
MIN_DOCS = 3
BITS_PER_LINE = 16
SEGMENT_BITS = 1 << 20
#: 64 MB: the bound on what the filter broadcast may hold.
MOST_BITS = 1 << 29
#: Rows up to which exact results of the confirmation are broadcast; beyond, they are shuffled.
MOST_ROWS = 500_000

_ENDS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    key = line.strip(_ENDS)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return key.translate(LOWER)


def _digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def _keys(text: bytes | None, min_chars: int) -> set[bytes]:
    return set() if text is None else {k for line in text.split(b"\n") if (k := line_key(line, min_chars)) is not None}


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two bits a hash, both in the segment that its upper half names."""
    segments, low = bits // SEGMENT_BITS, hashes & np.uint64(0xFFFFFFFF)
    base = ((hashes >> np.uint64(40)) % np.uint64(segments)) * np.uint64(SEGMENT_BITS)
    return np.stack([base + (low & np.uint64(0xFFFFF)), base + ((hashes >> np.uint64(20)) & np.uint64(0xFFFFF))])


def _pack(places: np.ndarray) -> bytes:
    return zlib.compress(np.diff(places, prepend=0).astype(np.uint32).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), np.uint32), dtype=np.int64)


def filter_bits(lines: int) -> int:
    """Bits of either filter for so many lines; a power of two, at most MOST_BITS."""
    return min(MOST_BITS, max(SEGMENT_BITS, 1 << max(1, lines * BITS_PER_LINE - 1).bit_length()))


def twice_filter(docs: DataFrame, id_col: str, text_col: str, bits: int, min_chars: int) -> DataFrame:
    """Rows (segment, bitmap) of the twice-seen filter."""

    def seen(batches):
        found: list[np.ndarray] = []
        for batch in sliced(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            hashes = [xxhash.xxh3_64_intdigest(k) for i, t in zip(ids, texts, strict=True) if i is not None for k in _keys(t, min_chars)]
            found.append(_places(np.array(hashes, np.uint64), bits).ravel())
        places, counts = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
        again = places[counts > 1]
        n = bits // SEGMENT_BITS
        cuts = np.arange(n + 1, dtype=np.uint64) * np.uint64(SEGMENT_BITS)
        once_at, twice_at = np.searchsorted(places, cuts), np.searchsorted(again, cuts)
        rows = [(s, _pack(places[once_at[s] : once_at[s + 1]] - cuts[s]), _pack(again[twice_at[s] : twice_at[s + 1]] - cuts[s])) for s in range(n) if once_at[s] < once_at[s + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["segment", "once", "twice"])

    def merged(batches):
        now, once, twice = None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(np.packbits(twice, bitorder="little").tobytes(), 1)], pa.binary())], names=["segment", "bitmap"])

        for batch in sliced(batches):
            for segment, o, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment != now:
                    if now is not None:
                        yield done()
                    now, once, twice = segment, np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
                o = _unpack(o)
                twice[o[once[o]]] = True
                twice[_unpack(t)] = True
                once[o] = True
        if now is not None:
            yield done()

    sparse = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(seen, "segment int, once binary, twice binary")
    return sparse.repartition("segment").sortWithinPartitions("segment").mapInArrow(merged, "segment int, bitmap binary")


def dropped_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, int]:
    """(id, keys: digests of the line keys that the document loses), and the number of such pairs."""
    spark = docs.sparkSession
    lines = docs.agg(F.sum(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = filter_bits(lines)
    bitmap = bytearray(bits // 8)
    with batches_of(spark, BATCH_ROWS):
        segments = twice_filter(docs, id_col, text_col, bits, min_chars).collect()  # bounded by MOST_BITS
    for segment, packed in segments:
        at = segment * (SEGMENT_BITS // 8)
        bitmap[at : at + SEGMENT_BITS // 8] = zlib.decompress(packed)
    shared = spark.sparkContext.broadcast(bytes(bitmap))

    def suspects(batches):
        bitmap = np.frombuffer(shared.value, np.uint8)
        for batch in sliced(batches):
            ids, keys = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if i is None or not (own := list(_keys(text, min_chars))):
                    continue
                places = _places(np.array([xxhash.xxh3_64_intdigest(k) for k in own], np.uint64), bits)
                hit = ((bitmap[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(0)
                found = [_digest(own[j]) for j in np.flatnonzero(hit)]
                ids += [i] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(keys, pa.binary())], names=["id", "key"])

    kind = docs.schema[id_col].dataType
    found = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(suspects, T.StructType([T.StructField("id", kind), T.StructField("key", T.BinaryType())]))
    pairs = keep(found.distinct(), "line-suspects")  # repeated rows of one id say the same
    confirmed = keep(pairs.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).select("key", "keeper"), "line-confirmed")
    lost = spread_join(pairs, confirmed, "key", confirmed.count(), MOST_ROWS).where("id <> keeper")
    drops = keep(lost.groupBy("id").agg(F.collect_list("key").alias("keys")), "line-drops")
    discard(pairs)
    discard(confirmed)
    return drops, drops.agg(F.sum(F.size("keys"))).first()[0] or 0


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: bool = False) -> DataFrame:
    """docs with the text that is left; with counts also n_lines and n_dropped. Names that are taken then are an error."""
    if counts:
        need_free(docs, ["n_lines", "n_dropped"])
    names = docs.columns
    width = len(names)
    plain = docs.toDF(*[f"c{i}" for i in range(width)])
    at, of = names.index(id_col), names.index(text_col)
    drops, total = dropped_keys(plain, f"c{at}", f"c{of}", min_chars, min_docs)
    joined = spread_join(plain, drops.withColumnRenamed("id", f"c{at}"), f"c{at}", total, MOST_ROWS).select(*plain.columns, "keys")

    fields = [*plain.columns, "n_lines", "n_dropped"]

    def cut(batches):
        for batch in sliced(batches):
            texts, n_lines, n_dropped = batch.column(of).cast(pa.binary()).to_pylist(), [], []
            for i, (text, keys) in enumerate(zip(texts, batch.column(width).to_pylist(), strict=True)):
                lines = [b""] if text is None else text.split(b"\n")
                n_lines.append(len(lines))
                left = lines
                if keys:
                    lost = set(keys)
                    left = [x for x in lines if (k := line_key(x, min_chars)) is None or _digest(k) not in lost]
                    texts[i] = b"\n".join(left)
                n_dropped.append(len(lines) - len(left))
            columns = list(batch.columns[: width])
            columns[of] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=fields)

    out = joined.mapInArrow(cut, T.StructType([*plain.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))
    return out.toDF(*names, "n_lines", "n_dropped") if counts else out.select(*plain.columns).toDF(*names)
