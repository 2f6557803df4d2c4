"""Full-text search: postings and BM25 (Robertson; k1 = 1.2, b = 0.75)."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.stemmer import stem, stem_udf
from tidewell.functions.text import any_of, query_terms, words
from tidewell.sources.segments import MOST_DEAD, Store, pending
from tidewell.sources.segments import drift as segments_drift
from tidewell.sources.storage import keep

K1, B = 1.2, 0.75


#: Words of which postings are made at a time in a task.
BLOCK_WORDS = 2_000_000


def _blocks(docs: DataFrame, id_col: str, text_col: str, stemmed: bool) -> DataFrame:
    """Postings by block of neighbouring docs: a row (term, ids, tfs, sizes) for each term of a block, and one without term and tfs for all its docs.

    Words are counted where their text is read, so that lists of numbers are shuffled, not words.
    """
    said = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    return said.mapInArrow(functools.partial(block_rows, stemmed), f"term string, ids array<{_kind(docs, id_col)}>, tfs array<int>, sizes array<int>")


def _kind(docs: DataFrame, id_col: str) -> str:
    return docs.select(id_col).schema[0].dataType.simpleString()


def block_rows(stemmed: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, w: its words) as lists by term: (term, ids, tfs, sizes) for each block, and one row without term and tfs of all its ids."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch["w"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place = (np.cumsum(sizes) - sizes) // BLOCK_WORDS
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1), len(sizes)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if end > begin:
                yield from _block(batch["id"][begin:end], batch["w"][begin:end], sizes[begin:end], stemmed)


def _block(ids: pa.Array, texts: pa.Array, sizes: np.ndarray, stemmed: bool) -> Iterator[pa.RecordBatch]:
    """The rows of one block: occurrences sorted by term and doc, as numbers, and counted by runs."""
    n, coded = len(ids), pc.list_flatten(texts).dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    if stemmed:
        stems = pa.array([stem(t) for t in terms.to_pylist()], pa.string()).dictionary_encode()
        terms, code = stems.dictionary, stems.indices.to_numpy().astype(np.int64)[code]
    key = np.sort(code * n + np.repeat(np.arange(n), sizes))
    begins = np.flatnonzero(np.diff(key, prepend=-1))
    code, at = np.divmod(key[begins], n)
    offsets = np.searchsorted(code, np.arange(len(terms) + 1))
    names = ["term", "ids", "tfs", "sizes"]
    sizes = sizes.astype(np.int32)
    lists = [_lists(offsets, ids.take(pa.array(at))), _lists(offsets, np.diff(begins, append=len(key)).astype(np.int32)), _lists(offsets, sizes[at])]
    yield pa.RecordBatch.from_arrays([terms, *lists], names)
    yield pa.RecordBatch.from_arrays([pa.nulls(1, terms.type), _lists([0, n], ids), pa.nulls(1, lists[1].type), _lists([0, n], sizes)], names)


def _lists(offsets, values) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values) if isinstance(values, np.ndarray) else values)


def _unpacked(blocks: DataFrame, *others: str) -> DataFrame:
    """(others, id, tf, size): a row a posting."""
    rows = blocks.select(*others, F.explode(F.arrays_zip("ids", "tfs", "sizes")).alias("p"))
    return rows.select(*others, F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.sizes").alias("size"))


def postings(docs: DataFrame, id_col: str, text_col: str, stemmed: bool = False) -> DataFrame:
    """(term, id, tf, size): how often each document (distinct ids) holds each term, and its number of words. Stemming works on distinct words."""
    return _unpacked(_blocks(docs, id_col, text_col, stemmed).where("term is not null"), "term")


#: The bucket of rows without a term.
NO_TERM = -1


def _bucket(buckets: int) -> Column:
    return F.when(F.col("term").isNull(), NO_TERM).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))


def _write_postings(store: Store, blocks: DataFrame) -> str:
    """A segment of (bucket, term, ids, tfs, sizes, seq) in folders by bucket, files sorted by term. A bucket takes as many tasks as its size needs."""
    return store.write(blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term"), "postings", "bucket")


def _write_docs(store: Store, docs: DataFrame, id_col: str, text_col: str, stemmed: bool, buckets: int, seq: int) -> tuple[str, str]:
    """Segments of the docs' postings and of their sizes (id, size, seq); a null text is an empty one. Texts are read once: sizes come from the folder of NO_TERM."""
    blocks = _blocks(docs, id_col, text_col, stemmed).select(_bucket(buckets).alias("bucket"), "term", "ids", "tfs", "sizes", F.lit(seq).cast("long").alias("seq"))
    held = _write_postings(store, blocks)
    each = store.table({"segments": {"postings": [held]}}, "postings", _columns(_kind(docs, id_col))).where(F.col("bucket") == NO_TERM).select(F.explode(F.arrays_zip("ids", "sizes")).alias("d"), "seq")
    return held, store.write(each.select(F.col("d.ids").alias("id"), F.col("d.sizes").cast("long").alias("size"), "seq"), "docs")


def _columns(kind: str) -> str:
    return f"term string, ids array<{kind}>, tfs array<int>, sizes array<int>, seq long, bucket int"


def _postings_of(store: Store, manifest: dict) -> DataFrame:
    """Postings by block of all segments; one of no docs has no file to tell its columns."""
    return store.table(manifest, "postings", _columns(manifest["id_type"])).where(F.col("bucket") != NO_TERM)


def save_index(docs: DataFrame, path: str, id_col: str, text_col: str, stemmed: bool = False, buckets: int = 64) -> dict:
    """Writes postings of all docs (distinct ids) as a new base: files by bucket of terms, sorted by term, so that a query reads few row groups of few folders; then publishes it. A base that was there before stays until vacuum()."""
    store = Store(docs.sparkSession, path)
    before = store.latest()
    seq = before["seq"] + 1 if before else 0
    held, sizes = _write_docs(store, docs, id_col, text_col, stemmed, buckets, seq)
    manifest = {"seq": seq, "stemmed": stemmed, "buckets": buckets, "id_type": _kind(docs, id_col), "applied": before["applied"] if before else -1, "n_dead": 0, "segments": {"postings": [held], "docs": [sizes]}}
    n, total = store.table(manifest, "docs").agg(F.count("*"), F.sum("size")).first()
    return store.publish({**manifest, "n": n, "words": total or 0}, before)


def update_index(spark: SparkSession, path: str, changed: DataFrame, gone: DataFrame, id_col: str, text_col: str, applied: int | None = None) -> dict:
    """Adds a delta: `changed` rows (new ones too, distinct ids) replace those of their ids, and ids of `gone` go. Reads the sizes of documents, no other postings."""
    store = Store(spark, path)
    before = store.latest()
    if before is None:
        raise LookupError(f"no index in {path}")
    seq = before["seq"] + 1
    held, sizes = _write_docs(store, changed, id_col, text_col, before["stemmed"], before["buckets"], seq)
    ids = spark.read.parquet(f"{path}/{sizes}").select("id").unionByName(gone.select(F.col(id_col).alias("id"))).distinct()
    dead = store.write(ids.withColumn("seq", F.lit(seq).cast("long")), "dead")
    lost = store.alive(store.table(before, "docs"), before).join(spark.read.parquet(f"{path}/{dead}").select("id"), "id", "left_semi").agg(F.count("*"), F.sum("size")).first()
    new = spark.read.parquet(f"{path}/{sizes}").agg(F.count("*"), F.sum("size")).first()
    segments = {kind: [*before["segments"].get(kind, []), own] for kind, own in (("postings", held), ("docs", sizes), ("dead", dead))}
    n_dead = before["n_dead"] + spark.read.parquet(f"{path}/{dead}").count()
    told = {**before, "seq": seq, "segments": segments, "n_dead": n_dead, "n": before["n"] - lost[0] + new[0], "words": before["words"] - (lost[1] or 0) + (new[1] or 0), "applied": before["applied"] if applied is None else applied}
    return store.publish(told, before)


def replay_outbox(spark: SparkSession, path: str, outbox: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> int:
    """Applies outbox entries (entry_id, op: upsert or delete, id) that no version has applied yet, as one delta; how many ids changed.

    The last entry of an id counts; an upsert whose document is gone meanwhile is a deletion. The number applied is part of
    the version, so a replay after a crash applies each entry once.
    """
    before = Store(spark, path).latest()
    last, applied, n = pending(outbox, before["applied"])
    if not n:
        return 0
    wanted = last.where("op = 'upsert'").select(F.col("id").alias(id_col))
    changed = docs.join(F.broadcast(wanted) if n <= MOST_DEAD else wanted, id_col, "left_semi")  # texts stay where they are if they can
    gone = last.select(F.col("id").alias(id_col)).join(changed.select(id_col), id_col, "left_anti")
    update_index(spark, path, changed, gone, id_col, text_col, applied)
    return n


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring postings of one term and change as lists."""
    for batch in batches:
        if n := batch.num_rows:
            other = np.zeros(n - 1, bool)
            for c in ("bucket", "term", "seq"):
                other |= pc.not_equal(batch[c][1:], batch[c][:-1]).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.concatenate(([True], other)))
            offsets, first = np.append(begins, n), pa.array(begins)
            yield pa.RecordBatch.from_arrays([*(batch[c].take(first) for c in ("bucket", "term", "seq")), *(_lists(offsets, batch[c]) for c in ("id", "tf", "size"))], ["bucket", "term", "seq", "ids", "tfs", "sizes"])


def compact_index(spark: SparkSession, path: str) -> dict:
    """All live rows as one new base; the version before stays readable until vacuum()."""
    store = Store(spark, path)
    before = store.latest()
    live = store.alive(_unpacked(_postings_of(store, before), "bucket", "term", "seq"), before)
    if before["n_dead"] > MOST_DEAD:  # the join has dealt them by id
        live = live.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "seq", "id")
    packed = live.mapInArrow(_packed_rows, "bucket int, term string, seq long, ids array<{0}>, tfs array<int>, sizes array<int>".format(before["id_type"]))
    held = _write_postings(store, packed)
    sizes = store.write(store.alive(store.table(before, "docs"), before), "docs")
    return store.publish({**before, "segments": {"postings": [held], "docs": [sizes]}, "n_dead": 0}, before)


def search_index(spark: SparkSession, path: str, query: str, limit: int) -> DataFrame:
    """(id, score) of the best documents of a saved index; of all segments only the query's terms are read."""
    store = Store(spark, path)
    manifest = store.latest()
    if manifest is None:
        raise LookupError(f"no index in {path}")
    terms = query_terms(query)
    terms = list(dict.fromkeys(stem(t) for t in terms)) if manifest["stemmed"] else list(dict.fromkeys(terms))
    places = [r[0] for r in spark.createDataFrame([(t,) for t in terms] or [("",)], "term string").select(F.pmod(F.xxhash64("term"), F.lit(manifest["buckets"])).cast("int")).distinct().collect()]  # at most eight terms
    held = _postings_of(store, manifest).where(F.col("bucket").isin(places) & F.col("term").isin(terms))
    return _scored(store.alive(_unpacked(held, "term", "seq"), manifest), terms, manifest["n"], manifest["words"] / manifest["n"] if manifest["n"] else None).orderBy("score", "id").limit(limit)


def indexed_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id) of all live documents of an index, those without words too."""
    store = Store(spark, path)
    manifest = store.latest()
    return store.alive(store.table(manifest, "docs"), manifest).select("id")


def drift(expected: DataFrame, path: str, kind: str = "document") -> DataFrame:
    """Ids (kind, id) that should be indexed against the index, whose ids are of one kind."""
    return segments_drift(expected, indexed_ids(expected.sparkSession, path).select(F.lit(kind).alias("kind"), "id"))


def _scored(held: DataFrame, terms: list[str], n: float, average: float | None) -> DataFrame:
    """(id, score) of postings of the terms: negated BM25, by term in the query's order, so that sums agree."""
    if not terms:
        return held.select("id", F.lit(0.0).alias("score")).limit(0)
    by_doc = held.groupBy("id", "size").agg(*[F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"t{i}") for i, t in enumerate(terms)])
    totals = by_doc.agg(*[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(terms))])
    return _bm25(by_doc.join(F.broadcast(totals)).withColumn("n", F.lit(float(n))).withColumn("average", F.lit(average)), len(terms))  # totals: one row


def _bm25(held: DataFrame, n_terms: int) -> DataFrame:
    """(id, score) of rows (id, size, t0.., d0.., n, average)."""
    score = F.lit(0.0)
    for i in range(n_terms):
        weight = F.ln(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        score = score + weight * F.col(f"t{i}") * (K1 + 1) / (F.col(f"t{i}") + K1 * (1 - B + B * F.col("size") / F.col("average")))
    return held.select("id", F.round(-score, 6).alias("score"))


def matches(docs: DataFrame, query: str, id_col: str, text_col: str, stemmed: bool = False) -> DataFrame:
    """(id, score): the negated BM25 of docs that hold any of the query's terms; lower is better.

    For queries without a saved index. Texts are cut into words once; only counts of the query's terms leave a
    document, and they are kept for the totals and the scores.
    """
    terms = query_terms(query)
    terms = list(dict.fromkeys(stem(t) for t in terms)) if stemmed else terms
    if not terms:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    said = docs.select(F.col(id_col).alias("id"), F.explode_outer(words(F.col(text_col))).alias("word"))
    if stemmed:
        tf = _stemmed_counts(said, terms)
    else:
        tf = said.groupBy("id").agg(F.count("word").alias("size"), *[F.count_if(F.col("word") == t).alias(f"t{i}") for i, t in enumerate(terms)])
    tf = keep(tf, "lexical-counts")
    n = range(len(terms))
    totals = tf.agg(F.count("*").cast("double").alias("n"), F.avg("size").alias("average"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in n])
    held = tf.where(F.greatest(*[F.col(f"t{i}") for i in n], F.lit(0)) > 0).join(F.broadcast(totals))  # totals: one row
    return _bm25(held, len(terms))


def _stemmed_counts(said: DataFrame, terms: list[str]) -> DataFrame:
    """(id, size, t0..): of rows (id, word), how many words of an id have each stem.

    A word begins as its stem does up to the last two letters, so only words that begin like a term leave a document by
    themselves, the others as a number. What is left of them is stemmed once a distinct word; few words have one stem.
    """
    near = any_of([F.col("word").startswith(t[:-2]) for t in terms])
    forms = keep(said.groupBy("id", F.when(near, F.col("word")).alias("form")).agg(F.count("word").alias("n")), "lexical-forms")
    stems = keep(forms.where("form is not null").select("form").distinct().withColumn("term", stem_udf("form")), "lexical-stems")  # kept, as a filter would go below distinct() with the stemmer
    met = forms.join(F.broadcast(stems.where(F.col("term").isin(terms))), "form", "left")
    return met.groupBy("id").agg(F.sum("n").alias("size"), *[F.sum(F.when(F.col("term") == t, F.col("n")).otherwise(0)).alias(f"t{i}") for i, t in enumerate(terms)])


def best(docs: DataFrame, query: str, id_col: str, text_col: str, limit: int, stemmed: bool = False) -> DataFrame:
    return matches(docs, query, id_col, text_col, stemmed).orderBy("score", "id").limit(limit)
