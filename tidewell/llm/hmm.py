"""Language-model scoring with a hidden Markov model over words.

Tokens are words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, and one end token a text. Every training
word has its own emission in every state; one more share of each state is for all words never
seen. Counts are smoothed by 0.1 a word, and a word's split over the states is drawn towards the
states' shares of all tokens by SHRINK occurrences.

1. Tasks turn documents into blocks of local word numbers and send each block's distinct words to
   buckets; a bucket adds up the counts of its words over all blocks and answers each block.
   Beyond GROUP_BLOCKS blocks, those are put into groups: a bucket's words are added up by group first, then over the
   groups, and each group is answered by a task of its own, row by row. So no task holds rows of more than
   GROUP_BLOCKS blocks, and a word of every block is no hot key.
2. Blocks become sequences of local numbers, with the parts of the scores that need no states.
3. Baum-Welch: a block runs the scaled forward-backward recursion over its whole training texts,
   CHUNK tokens at a time or a single longer text, and sends its words' expected counts by state to their buckets; a bucket adds
   them up (by group first, as above) and answers each block with its words' new split. So no task holds the whole table, and
   the driver only gets sums by state, added up by Spark in fixed point. Splits travel as half-precision numbers.
4. Scoring runs the scaled forward recursion over whole texts: their exact likelihood.

Training texts are those whose crc32 of the id as text, mod 10, isn't 0. Nulls: a null text is
empty (its end token only); a null id counts as empty text, so it is held out. Repeated rows count
as often as they occur. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import LOWER, discard, keep, sliced

STATES = 8
STEPS = 4
#: Tokens of the texts that go through a recursion side by side.
CHUNK = 1 << 19
#: Text bytes of a block, and of texts that share a bucket of words.
BLOCK_BYTES = 16 << 20
BUCKET_BYTES = 32 << 20
#: Blocks whose rows of a bucket one task holds; more are combined in groups first.
GROUP_BLOCKS = 256
#: Units of 1 in sums of expected counts, so that their order doesn't matter.
FIXED = 1 << 16
#: Occurrences by which a word's split over the states is drawn towards that of all tokens.
SHRINK = 1.0

_BLOCK = "block long, bucket int, ids binary, lengths binary, tokens binary, words binary, counts binary, held binary, train long"
_CODED = "block long, bucket int, ids binary, lengths binary, held binary, tokens binary, base binary, known binary, totals binary, split binary"
_SENT = "block long, bucket int, split binary, counts binary, sums binary"


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _batch(rows, kinds, names):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names=names)


_BLOCK_KINDS = (pa.int64(), pa.int32(), *[pa.binary()] * 6, pa.int64())
_BLOCK_NAMES = [x.split()[0] for x in _BLOCK.split(", ")]
_CODED_NAMES = [x.split()[0] for x in _CODED.split(", ")]
_CODED_KINDS = (pa.int64(), pa.int32(), *[pa.binary()] * 8)
_SENT_KINDS, _SENT_NAMES = (pa.int64(), pa.int32(), *[pa.binary()] * 3), [x.split()[0] for x in _SENT.split(", ")]
_NULL_ID = np.iinfo(np.int64).min


def numbering() -> defaultdict[bytes, int]:
    """A table that gives each new key the next number from 0 on."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    return numbers


def blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Of rows (doc_id, text): a row a block with its sequences of local word numbers, and a row a block and bucket with words and training counts."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0

        def close():
            nonlocal made
            words = list(vocab)
            place = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
            order = np.argsort(place, kind="stable")
            renamed = np.empty(len(words), np.int32)
            renamed[order] = np.arange(len(words), dtype=np.int32)
            lengths = np.array([len(s) for s in seqs], np.int32)
            tokens = np.concatenate(seqs) if seqs else np.empty(0, np.int32)
            held = np.array([is_held_out(i) for i in ids], bool)
            counts = np.bincount(tokens[~np.repeat(held, lengths)], minlength=len(words))[order].astype(np.int32)
            block, made = (part << 32) | made, made + 1
            yield _batch([(block, -1, np.array([_NULL_ID if i is None else i for i in ids], np.int64).tobytes(), lengths.tobytes(), zstandard.compress(renamed[tokens].tobytes() if len(words) else b"", 1), None, None, held.tobytes(), int(counts.sum()) + int((~held).sum()))], _BLOCK_KINDS, _BLOCK_NAMES)
            cuts = np.append(np.flatnonzero(np.diff(place[order], prepend=-1)), len(words))
            rows = []
            for b, i, j in zip(place[order][cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                rows.append((block, b, None, None, None, zlib.compress(b"\n".join([words[k] for k in order[i:j].tolist()]), 1), counts[i:j].tobytes(), None, None))
            yield _batch(rows, _BLOCK_KINDS, _BLOCK_NAMES)

        ids, seqs, vocab, size = [], [], numbering(), 0
        for batch in sliced(batches):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = text.translate(LOWER).split() if text else []
                seqs.append(np.fromiter(map(vocab.__getitem__, words), np.int32, len(words)))
                ids.append(i)
                size += len(text or b"")
                if size >= BLOCK_BYTES:
                    yield from close()
                    ids, seqs, vocab, size = [], [], numbering(), 0
        if ids:
            yield from close()

    return docs.mapInArrow(run, _BLOCK)


def _grouped(groups: int):
    return F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("grp")


def _first_split(bucket: int, words: int, states: int) -> np.ndarray:
    """Where words of a bucket, in their order, begin; half precision."""
    split = np.exp(0.7 * np.random.default_rng((7, bucket)).standard_normal((words, states)))
    return (split / split.sum(1, keepdims=True)).astype(np.float16)


_ANSWER_NAMES = ["block", "bucket", "counts", "places", "split", "distinct"]
_ANSWER_KINDS = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
_ANSWER = "block long, bucket int, counts binary, places binary, split binary, distinct long"


def answers(sent: DataFrame, states: int, groups: int = 1) -> DataFrame:
    """Of the rows (block, bucket, words, counts): for each its words' total counts, places in the bucket and first split, and a row a bucket with its number of training words."""
    if groups > 1:
        return _answers_by_group(sent, states, groups)

    def run(batches):
        bucket, held = None, []

        def close():
            number, places = numbering(), []
            for _, packed, _ in held:
                words = zlib.decompress(packed).split(b"\n")
                places.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            rank = np.empty(len(number), np.int32)
            rank[[number[w] for w in sorted(number)]] = np.arange(len(number), dtype=np.int32)
            places = [rank[x] for x in places]
            totals = np.zeros(len(number), np.int64)
            for place, (_, _, counts) in zip(places, held, strict=True):
                totals[place] += np.frombuffer(counts, np.int32)
            split = _first_split(bucket, len(number), states)
            rows = [(None, bucket, None, None, None, int((totals > 0).sum()))]
            rows += [(block, bucket, zlib.compress(totals[place].tobytes(), 1), zlib.compress(place.tobytes(), 1), split[place].tobytes(), None) for place, (block, _, _) in zip(places, held, strict=True)]
            return _batch(rows, _ANSWER_KINDS, _ANSWER_NAMES)

        for batch in sliced(batches):
            for block, b, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    if held:
                        yield close()
                    bucket, held = b, []
                held.append((block, words, counts))
        if held:
            yield close()

    dealt = sent.select("block", "bucket", "words", "counts").repartition("bucket").sortWithinPartitions("bucket", "block")
    return dealt.mapInArrow(run, _ANSWER)


_WORDS = "bucket int, grp int, words binary, counts binary"


def _word_counts(rows: DataFrame, kind: type, by: list[str]) -> DataFrame:
    """(bucket, grp, words, counts: 64 bit) of rows of these columns added up by key, words sorted; a task holds one key's words."""
    names, kinds = ["bucket", "grp", "words", "counts"], (pa.int32(), pa.int32(), pa.binary(), pa.binary())

    def run(batches):
        key, number, totals = None, numbering(), np.zeros(0, np.int64)

        def close():
            words = sorted(number)
            return _batch([(*key, zlib.compress(b"\n".join(words), 1), totals[[number[w] for w in words]].tobytes())], kinds, names)

        for batch in sliced(batches):
            for bucket, group, packed, counts in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                own = (bucket, group if "grp" in by else 0)
                if own != key:
                    if key is not None:
                        yield close()
                    key, number, totals = own, numbering(), np.zeros(0, np.int64)
                words = zlib.decompress(packed).split(b"\n")
                place = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                if len(number) > len(totals):
                    totals = np.concatenate([totals, np.zeros(2 * len(number) - len(totals), np.int64)])
                totals[place] += np.frombuffer(counts, kind)
        if key is not None:
            yield close()

    return rows.repartition(*by).sortWithinPartitions("bucket", "grp", *(["block"] if "block" in rows.columns else [])).mapInArrow(run, _WORDS)


def _answers_by_group(sent: DataFrame, states: int, groups: int) -> DataFrame:
    own = sent.select("block", "bucket", _grouped(groups), "words", "counts")
    partial = keep(_word_counts(own, np.int32, ["bucket", "grp"]), "hmm-words", 16)
    whole = keep(_word_counts(partial, np.int64, ["bucket"]), "hmm-words", 16).drop("grp")

    def distinct(batches):
        for batch in sliced(batches):
            rows = [(None, b, None, None, None, int((np.frombuffer(c, np.int64) > 0).sum())) for b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
            yield _batch(rows, _ANSWER_KINDS, _ANSWER_NAMES)

    def run(batches):
        place_of, totals, split = {}, None, None
        for batch in sliced(batches, 16):
            rows = []
            for block, bucket, words, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "words", "counts")), strict=True):
                words = zlib.decompress(words).split(b"\n")
                if block is None:
                    place_of, totals, split = {w: i for i, w in enumerate(words)}, np.frombuffer(counts, np.int64), _first_split(bucket, len(words), states)
                    continue
                place = np.fromiter(map(place_of.__getitem__, words), np.int32, len(words))
                rows.append((block, bucket, zlib.compress(totals[place].tobytes(), 1), zlib.compress(place.tobytes(), 1), split[place].tobytes(), None))
            yield _batch(rows, _ANSWER_KINDS, _ANSWER_NAMES)

    heads = whole.join(partial.select("bucket", "grp"), "bucket").select(F.lit(None).cast("long").alias("block"), "bucket", "grp", "words", "counts")
    dealt = heads.unionByName(own).repartition("bucket", "grp").sortWithinPartitions("bucket", "grp", F.col("block").asc_nulls_first())
    return dealt.mapInArrow(run, _ANSWER).unionByName(whole.select("bucket", "counts").mapInArrow(distinct, _ANSWER))


def added(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of the arrays (64-bit floats) in column `sums`: tasks add up their own in fixed point, Spark the tasks', and the driver gets `size` numbers."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in sliced(batches):
            for raw in batch.column(0).to_pylist():
                total += np.rint(np.frombuffer(raw, np.float64) * FIXED).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total, pa.int64())], names=["place", "v"])

    out = np.zeros(size)
    for place, v in rows.select("sums").mapInArrow(run, "place int, v long").groupBy("place").agg(F.sum("v")).collect():
        out[place] = v / FIXED
    return out


def coded(made: DataFrame, answered: DataFrame, end_count: int, n: int, v: int) -> DataFrame:
    """Blocks as sequences of local word numbers, with their words' total counts; the end has the number behind the last word's."""
    denominator = n + 0.1 * (v + 1)

    def run(batches):
        now, body, parts = None, None, []

        def close():
            ids, lengths, tokens, held = body
            lengths = np.frombuffer(lengths, np.int32)
            counts = np.concatenate([np.frombuffer(zlib.decompress(c), np.int64) for c in parts]) if parts else np.empty(0, np.int64)
            tokens = np.frombuffer(zstandard.decompress(tokens), np.int32)
            base = np.log10((counts + 0.1) / denominator)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            by_text = lambda x: np.add.reduceat(np.append(x, 0.0), starts[:-1]) * (lengths > 0)
            full = np.full(len(tokens) + len(lengths), len(counts), np.int32)
            full[np.arange(len(tokens)) + np.repeat(np.arange(len(lengths)), lengths)] = tokens
            known = np.rint(by_text((counts[tokens] > 0).astype(float))).astype(np.int64) + (end_count > 0)
            end = np.log10((end_count + 0.1) / denominator)
            return (now, -1, ids, (lengths + 1).astype(np.int32).tobytes(), held, zstandard.compress(full.tobytes(), 1), (by_text(base[tokens]) + end).tobytes(), known.tobytes(), zstandard.compress(counts.tobytes(), 1), None)

        for batch in sliced(batches, 16):
            rows = []
            for block, bucket, ids, lengths, tokens, held, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    if body is not None:
                        rows.append(close())
                    now, body, parts = block, None, []
                if bucket < 0:
                    body = (ids, lengths, tokens, held)
                else:
                    parts.append(counts)
            yield _batch(rows, _CODED_KINDS, _CODED_NAMES)
        if body is not None:
            yield _batch([close()], _CODED_KINDS, _CODED_NAMES)

    blank = lambda c: F.lit(None).cast("binary").alias(c)
    left = made.where("bucket < 0").select("block", "bucket", "ids", "lengths", "tokens", "held", blank("counts"))
    right = answered.where("block is not null").select("block", "bucket", blank("ids"), blank("lengths"), blank("tokens"), blank("held"), "counts")
    return left.unionByName(right).repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(run, _CODED)


def _with_splits(table: DataFrame, splits: DataFrame) -> DataFrame:
    """Coded blocks, each followed by its words' splits by bucket."""
    more = splits.where("block is not null").select("block", "bucket", *[F.lit(None).cast("binary").alias(c) for c in _CODED_NAMES[2:-1]], "split")
    return table.unionByName(more).repartition("block").sortWithinPartitions("block", "bucket")


def _read_blocks(batches, states: int):
    """Of batches of _with_splits: (coded row, buckets with their numbers of words, splits of all words) a block."""
    body, parts = None, []

    def close():
        found = [np.frombuffer(x, np.float16).reshape(-1, states) for _, x in parts]
        split = np.concatenate(found).astype(np.float32) if found else np.empty((0, states), np.float32)
        return body, [(b, len(x)) for (b, _), x in zip(parts, found, strict=True)], split / split.sum(1, keepdims=True)

    for batch in sliced(batches, 16):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[1] < 0:
                if body is not None:
                    yield close()
                body, parts = row, []
            else:
                parts.append((row[1], row[-1]))
    if body is not None:
        yield close()


def emissions_of(split: np.ndarray, totals: np.ndarray, end: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """A block's emissions by word and state, the end's last. end: its smoothed counts by state; mass: all smoothed counts by state."""
    return np.vstack([split.astype(np.float64) * (totals + 0.1)[:, None], end[None, :]]) / mass


class Layout:
    """Texts of the given lengths, longest first, laid out step by step, so that a recursion takes one step of all of them at once."""

    def __init__(self, lengths: np.ndarray, starts: np.ndarray):
        #: How many texts reach each step, and where its tokens begin.
        self.live = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left")
        self.begin = np.cumsum(self.live) - self.live
        self.step = np.repeat(np.arange(len(self.live)), self.live)
        self.text = np.arange(len(self.step)) - self.begin[self.step]
        #: Each token's place in the sequences.
        self.token = starts[self.text] + self.step
        self.slices = list(zip(self.begin.tolist(), self.live.tolist(), strict=True))


def layouts(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, Layout]]:
    """(texts, their layout), CHUNK tokens at a time; a longer text has one of its own."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    part = np.cumsum(lengths[order]) // CHUNK
    for own in np.split(order, np.flatnonzero(np.diff(part)) + 1) if len(order) else ():
        yield own, Layout(lengths[own], starts[own])


def forward(seen: np.ndarray, at: Layout, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward recursion over emissions by state and token: shares of the states, and the scale, of each token. A state's tokens lie together, so that each step runs along them."""
    alpha, scale, ones, into = np.empty_like(seen), np.empty(seen.shape[1], seen.dtype), np.ones(len(start), seen.dtype), np.ascontiguousarray(move.T)
    ahead = np.repeat(start.astype(seen.dtype)[:, None], int(at.live[0]) if len(at.live) else 0, axis=1)
    for b, k in at.slices:
        now, total = alpha[:, b : b + k], scale[b : b + k]
        np.multiply(ahead[:, :k], seen[:, b : b + k], out=now)
        np.matmul(ones, now, out=total)
        now /= total
        np.matmul(into, now, out=ahead[:, :k])
    return alpha, scale


def expected(classes: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts (starts, moves, emissions by class and state) of texts' sequences, one after another, by the scaled forward-backward recursion over each as a whole."""
    states = len(start)
    starts, moves, emissions = np.zeros(states), np.zeros((states, states)), np.zeros((states, len(emit)))
    by_state = np.ascontiguousarray(emit.T)
    for _, at in layouts(lengths):
        own = classes[at.token]
        seen = by_state.take(own, axis=1)
        alpha, scale = forward(seen, at, start, move)
        seen /= scale
        beta = np.ones_like(alpha)  # a text's last token keeps it
        for (b, k), (before, _) in zip(at.slices[:0:-1], at.slices[-2::-1], strict=True):
            ahead = seen[:, b : b + k]
            ahead *= beta[:, b : b + k]
            np.matmul(move, ahead, out=beta[:, before : before + k])
        first = int(at.live[0]) if len(at.live) else 0
        previous = at.begin[at.step[first:] - 1] + at.text[first:]
        moves += move * (alpha.take(previous, axis=1) @ seen[:, first:].T)
        alpha *= beta
        starts += alpha[:, :first].sum(1, dtype=np.float64)
        for k in range(states):
            emissions[k] += np.bincount(own, weights=alpha[k], minlength=len(emit))
    return starts, moves, np.ascontiguousarray(emissions.T)


def likelihoods(classes: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """log10 likelihood of each sequence by the scaled forward recursion over its whole length."""
    out, by_state = np.zeros(len(lengths)), np.ascontiguousarray(emit.T)
    for texts, at in layouts(lengths):
        _, scale = forward(by_state.take(classes[at.token], axis=1), at, start, move)
        out[texts] = np.bincount(at.text, weights=np.log10(scale), minlength=len(texts))
    return out


def _split_of(sums: np.ndarray, counts: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Words' new split, and the smoothed counts by state of those that were seen."""
    split = ((sums + SHRINK * share) / (counts + SHRINK)[:, None]).astype(np.float16)
    exact = split.astype(np.float32)
    exact /= exact.sum(1, keepdims=True)
    return split, (((counts + 0.1) * (counts > 0)) @ exact.astype(np.float64)).tobytes()


def _new_splits(both: DataFrame, share: np.ndarray, states: int) -> DataFrame:
    """Of a block's places in a bucket, and its words' shares by state and counts: the new split of its words, and a row a bucket with its smoothed counts by state."""

    def run(batches):
        bucket, places, parts = None, {}, []

        def close():
            size = max(int(x.max()) + 1 for x in places.values())
            sums, counts = np.zeros((size, states)), np.zeros(size, np.int64)
            for block, split, own in parts:
                own = np.frombuffer(own, np.int32)
                sums[places[block]] += np.frombuffer(split, np.float16).reshape(-1, states) * own[:, None].astype(np.float64)
                counts[places[block]] += own
            split, mass = _split_of(sums, counts, share)
            return _batch([(None, bucket, None, None, mass), *((block, bucket, split[x].tobytes(), None, None) for block, x in places.items())], _SENT_KINDS, _SENT_NAMES)

        for batch in sliced(batches):
            for block, b, place, split, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    if places:
                        yield close()
                    bucket, places, parts = b, {}, []
                if place is not None:
                    places[block] = np.frombuffer(zlib.decompress(place), np.int32)
                else:
                    parts.append((block, split, counts))
        if places:
            yield close()

    return both.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, _SENT)


_SUMS = "bucket int, grp int, sums binary, counts binary"


def _splits_by_group(both: DataFrame, share: np.ndarray, states: int, groups: int) -> DataFrame:
    """What _new_splits() does, by groups of blocks and then over these; a task holds one bucket's sums and one block's row."""
    own = both.select("block", "bucket", _grouped(groups), "places", "split", "counts")
    names, kinds = ["bucket", "grp", "sums", "counts"], (pa.int32(), pa.int32(), pa.binary(), pa.binary())

    def grown(held, size):
        return held if len(held) >= size else np.concatenate([held, np.zeros((2 * size - len(held), *held.shape[1:]), held.dtype)])

    def by_group(batches):
        key, place, sums, counts, size = None, None, None, None, 0
        close = lambda: _batch([(*key, sums[:size].tobytes(), counts[:size].tobytes())], kinds, names)
        for batch in sliced(batches):
            for bucket, group, packed, split, own_counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "grp", "places", "split", "counts")), strict=True):
                if (bucket, group) != key:
                    if key is not None:
                        yield close()
                    key, sums, counts, size = (bucket, group), np.zeros((0, states)), np.zeros(0, np.int64), 0
                if packed is not None:
                    place = np.frombuffer(zlib.decompress(packed), np.int32)
                    size = max(size, int(place.max()) + 1)
                    sums, counts = grown(sums, size), grown(counts, size)
                else:
                    n = np.frombuffer(own_counts, np.int32)
                    sums[place] += np.frombuffer(split, np.float16).reshape(-1, states) * n[:, None].astype(np.float64)
                    counts[place] += n
        if key is not None:
            yield close()

    def over_groups(batches):
        bucket, sums, counts, size = None, None, None, 0

        def close():
            split, mass = _split_of(sums[:size], counts[:size], share)
            return _batch([(None, bucket, split.tobytes(), None, mass)], _SENT_KINDS, _SENT_NAMES)

        for batch in sliced(batches):
            for b, _, raw, own_counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    if bucket is not None:
                        yield close()
                    bucket, sums, counts, size = b, np.zeros((0, states)), np.zeros(0, np.int64), 0
                n = np.frombuffer(own_counts, np.int64)
                size = max(size, len(n))
                sums, counts = grown(sums, size), grown(counts, size)
                sums[: len(n)] += np.frombuffer(raw, np.float64).reshape(-1, states)
                counts[: len(n)] += n
        if bucket is not None:
            yield close()

    def answer(batches):
        split = None
        for batch in sliced(batches, 16):
            rows = []
            for block, bucket, packed, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "places", "split")), strict=True):
                if block is None:
                    split = np.frombuffer(raw, np.float16).reshape(-1, states)
                else:
                    rows.append((block, bucket, split[np.frombuffer(zlib.decompress(packed), np.int32)].tobytes(), None, None))
            yield _batch(rows, _SENT_KINDS, _SENT_NAMES)

    partial = keep(own.repartition("bucket", "grp").sortWithinPartitions("bucket", "grp", "block", F.col("places").isNull()).mapInArrow(by_group, _SUMS), "hmm-sums", 16)
    whole = keep(partial.repartition("bucket").sortWithinPartitions("bucket", "grp").mapInArrow(over_groups, _SENT), "hmm-sums", 16)
    heads = whole.select("block", "bucket", "split").join(partial.select("bucket", "grp"), "bucket").select("block", "bucket", "grp", F.lit(None).cast("binary").alias("places"), "split")
    dealt = heads.unionByName(own.where("places is not null").select("block", "bucket", "grp", "places", "split")).repartition("bucket", "grp").sortWithinPartitions("bucket", "grp", F.col("block").asc_nulls_first())
    return dealt.mapInArrow(answer, _SENT).unionByName(whole.withColumn("split", F.lit(None).cast("binary")))


def train(table: DataFrame, answered: DataFrame, n: int, v: int, ends: int, states: int = STATES, steps: int = STEPS, groups: int = 1) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """After so many Baum-Welch steps over coded blocks: splits by block and bucket, and (starts, moves, the end's smoothed counts, all smoothed counts) by state."""
    start, move = np.full(states, 1 / states), np.full((states, states), 0.1 / (states - 1)) + np.eye(states) * (0.9 - 0.1 / (states - 1))
    end, mass = np.full(states, (ends + 0.1) / states), np.full(states, (n + 0.1 * (v + 1)) / states)
    splits = answered
    for _ in range(steps):

        def run(batches, model=(start, move, end, mass)):
            start, move = (x.astype(np.float32) for x in model[:2])
            for (block, _, _, lengths, held, tokens, _, _, totals, _), buckets, split in _read_blocks(batches, states):
                emit = emissions_of(split, np.frombuffer(zstandard.decompress(totals), np.int64), *model[2:]).astype(np.float32)
                lengths, own = np.frombuffer(lengths, np.int32).astype(np.int64), ~np.frombuffer(held, bool)
                starts, moves, emissions = expected(np.frombuffer(zstandard.decompress(tokens), np.int32)[np.repeat(own, lengths)], lengths[own], start, move, emit)
                rows = [(block, -1, None, None, np.concatenate([starts, moves.ravel(), emissions[-1], emissions.sum(0)]).tobytes())]
                counts = np.rint(emissions[:-1].sum(1)).astype(np.int32)
                shares = (emissions[:-1] / np.maximum(counts, 1)[:, None]).astype(np.float16)
                at = 0
                for bucket, k in buckets:
                    rows.append((block, bucket, shares[at : at + k].tobytes(), counts[at : at + k].tobytes(), None))
                    at += k
                yield _batch(rows, _SENT_KINDS, _SENT_NAMES)

        sent = keep(_with_splits(table, splits).mapInArrow(run, _SENT), "hmm-expected", 16)
        if splits is not answered:
            discard(splits)
        totals = added(sent.where("bucket < 0"), states * (states + 3))
        starts, moves, end_counts, all_counts = np.split(totals, np.cumsum([states, states * states, states]))
        start = (starts + 0.1) / (starts.sum() + 0.1 * states)
        move = moves.reshape(states, states) + 0.1
        move /= move.sum(1, keepdims=True)
        share = (all_counts + 0.1) / (all_counts.sum() + 0.1 * states)

        blank = lambda c: F.lit(None).cast("binary").alias(c)
        both = answered.where("block is not null").select("block", "bucket", "places", blank("split"), blank("counts")).unionByName(sent.where("bucket >= 0").select("block", "bucket", blank("places"), "split", "counts"))
        splits = keep((_new_splits if groups == 1 else functools.partial(_splits_by_group, groups=groups))(both, share, states), "hmm-splits", 16)
        discard(sent)
        end = (ends + 0.1) * (end_counts + SHRINK * share) / (ends + SHRINK)
        mass = added(splits.where("block is null"), states) + end + 0.1 * share
    return splits, (start, move, end, mass)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, steps: int = STEPS) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    made = keep(blocks(named, max(12, -(-size // BUCKET_BYTES))), "hmm-blocks")
    told = made.where("bucket < 0").agg(F.sum("train").alias("n"), F.sum(F.expr("octet_length(replace(hex(held), '01', ''))") / 2).alias("ends")).first()
    n, ends = int(told["n"] or 0), int(told["ends"] or 0)
    groups = max(1, -(-made.where("bucket < 0").count() // GROUP_BLOCKS))
    answered = keep(answers(made.where("bucket >= 0"), states, groups), "hmm-answers", 16)
    v = int(answered.agg(F.sum("distinct")).first()[0] or 0) + (ends > 0)
    table = keep(coded(made, answered, ends, n, v), "hmm-coded", 16)
    discard(made)
    splits, model = train(table, answered, n, v, ends, states, steps, groups)
    if splits is not answered:
        discard(answered)

    def run(batches):
        start, move, end, mass = model
        for (_, _, ids, lengths, held, tokens, base, known, totals, _), _, split in _read_blocks(batches, states):
            ids, lengths = np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.int32).astype(np.int64)
            emit = emissions_of(split, np.frombuffer(zstandard.decompress(totals), np.int64), end, mass)
            found = likelihoods(np.frombuffer(zstandard.decompress(tokens), np.int32), lengths, start, move, emit)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=ids == _NULL_ID), pa.array(np.frombuffer(held, bool)), pa.array(lengths), pa.array(np.frombuffer(known, np.int64)), pa.array(np.full(len(ids), n, np.int64)), pa.array(np.frombuffer(base, np.float64)), pa.array(found)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return _with_splits(table, splits).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
