"""Byte-level BPE by merge replay over distinct words.

A task gathers the distinct pieces of its documents and replays the merge table over all
of them at once: an inverted index holds, for every token pair, the word positions where
it stands; the lowest-ranked pair that occurs anywhere is merged at all of its positions,
and only the pairs with its neighbours are touched. Words are independent, so this global
rank order is each word's own order, and the ids equal those of piece-by-piece encoding.
Documents are then looked up chunk by chunk (a chunk: spaces and what follows them), so nothing is shuffled. The table of known
chunks is emptied when it holds MOST_CHUNKS, which bounds a task's memory whatever the input.

Nulls: a null text is empty (no ids; it decodes to empty bytes). Repeated rows, ties and
very long texts need no special case. Other columns pass through by position.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import need_free, sliced

MOST_CHUNKS = 200_000
#: A replay takes the new chunks of so many bytes of texts, or so many new chunks, together.
HELD_BYTES = 8 << 20
HELD_CHUNKS = 80_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token bytes, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Replay:
    """Encodes lists of distinct pieces by replaying merges in rank order over all of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}

    def rank(self, pair: int) -> int:
        """Rank of the token that a pair makes, or -1; a pair is its left id, times 2**32, plus its right id."""
        found = self.pairs.get(pair)
        if found is None:
            if len(self.pairs) > 200_000:
                self.pairs.clear()
            found = self.pairs[pair] = self.ranks.get(self.tokens[pair >> 32] + self.tokens[pair & 0xFFFFFFFF], -1)
        return found

    def _grouped(self, pairs: np.ndarray, places: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(rank, pair, places) of each distinct pair that a merge exists for."""
        if not len(pairs):
            return []
        order = np.argsort(pairs, kind="stable")
        pairs, places = pairs[order], places[order]
        cuts = np.flatnonzero(np.diff(pairs)) + 1
        starts = [0, *cuts.tolist(), len(pairs)]
        return [(r, pair, places[i:j]) for i, j, pair in zip(starts[:-1], starts[1:], pairs[starts[:-1]].tolist(), strict=True) if (r := self.rank(pair)) >= 0]

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each piece; a piece that is a token is that token."""
        out = [b""] * len(pieces)
        spelt: list[int] = []
        for w, piece in enumerate(pieces):
            if piece in self.ranks:
                out[w] = self.ranks[piece].to_bytes(4, "little")
            else:
                spelt.append(w)
        if not spelt:
            return out
        sizes = np.array([len(pieces[w]) for w in spelt], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        # Ids by position; -1: merged away, -2: between words.
        token = np.full(int(ends[-1]) + 1, -2, np.int64)
        inside = np.ones(len(token), bool)
        inside[ends] = False
        token[inside] = self.byte[np.frombuffer(b"".join(pieces[w] for w in spelt), np.uint8)]
        word = np.repeat(np.arange(len(spelt)), sizes + 1)
        after = np.arange(1, len(token) + 1)
        before = np.arange(-1, len(token) - 1)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[tuple[int, int]] = []

        def add(found: list[tuple[int, int, np.ndarray]]) -> None:
            for r, pair, places in found:
                if (known := index.get(pair)) is None:
                    index[pair] = [places]
                    heapq.heappush(heap, (r, pair))
                else:
                    known.append(places)

        start = np.flatnonzero((token[:-1] >= 0) & (token[1:] >= 0))
        add(self._grouped((token[start] << 32) | token[start + 1], start))
        while heap:
            r, pair = heapq.heappop(heap)
            a, b = pair >> 32, pair & 0xFFFFFFFF
            places = index.pop(pair)
            places = np.unique(np.concatenate(places)) if len(places) > 1 else np.sort(places[0])
            places = places[token[places] == a]
            places = places[token[after[places]] == b]
            if a == b and len(places) > 1:  # in a run of one token, left to right and without overlap
                taken, last = [], -1
                for p, q in zip(places.tolist(), after[places].tolist(), strict=True):
                    if p != last:
                        taken.append(p)
                        last = q
                places = np.array(taken, np.int64)
            if not len(places):
                continue
            rest = places[:0]
            while True:
                right = after[places]
                nxt, left = after[right], before[places]
                lefts = np.where(left >= 0, token[left], -2)
                found = self._grouped(*self._around(lefts, token[nxt], r, left, places))
                if not len(rest) and len(places) > 1 and any(new < r for new, _, _ in found):
                    # A lower rank comes up: it goes first in its word, so each word takes one merge now.
                    first = np.unique(word[places], return_index=True)[1]
                    rest = np.delete(places, first)
                    places = places[first]
                    if len(rest):
                        continue
                break
            token[places], token[right] = r, -1
            after[places] = nxt
            before[nxt] = places
            if (token[left] == -1).any():  # two places side by side: the pair of new tokens is the first one's
                found = self._grouped(*self._around(np.where(left >= 0, token[left], -2), token[nxt], r, left, places))
            add(found)
            if len(rest):
                add([(r, pair, rest)])
        kept = token >= 0
        ids = token[kept].astype("<u4").tobytes()
        counts = np.cumsum(np.bincount(word[kept], minlength=len(spelt))) * 4
        at = 0
        for w, end in zip(spelt, counts.tolist(), strict=True):
            out[w] = ids[at:end]
            at = end
        return out

    @staticmethod
    def _around(lefts: np.ndarray, rights: np.ndarray, r: int, left: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that token r makes with its neighbours, and where they stand."""
        x, y = lefts >= 0, rights >= 0
        return np.concatenate([(lefts[x] << 32) | r, (r << 32) | rights[y]]), np.concatenate([left[x], places[y]])


#: White space as Unicode's property has it, which leaves out U+001C to U+001F (fixed values).
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: No match of the pattern holds a space after a non-space, so texts can be cut there first.
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def check_pattern(pattern: str) -> None:
    """Refuses patterns with a match that holds white space behind anything else: chunks would cut it. Tried on texts that mix all sorts of characters."""
    import regex

    found = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    kinds = ["a", "Z", "é", "中", "1", "234", ".", "'s", "'", "\u0301", "_", "😀", "\x1c", "!?"]
    spaces = [" ", "  ", "\n", "\r\n", "\t", "\u3000", " \n ", "\u0085"]
    tries = "".join(a + s + b for a in kinds for s in spaces for b in kinds)
    for text in (tries, "".join(s + a for a in kinds for s in spaces)):
        pieces = found.findall(text)
        if "".join(pieces) != text or any(_CHUNK.match(p).end() != len(p) for p in pieces):
            raise ValueError("the pattern matches white space behind other characters, or leaves characters out")


class Encoder:
    """Texts to ids and back, remembering a bounded number of chunks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = MOST_CHUNKS):
        import regex

        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.replay = Replay(ranks)
        self.most = most
        self.known: dict[str, bytes] = {}

    def unknown(self, texts: list[str | None], new: set[str]) -> None:
        """Adds the chunks that are not known yet to new."""
        known = self.known
        for t in texts:
            if t:
                new.update([c for c in _CHUNK.findall(t) if c not in known])

    def learn(self, new: set[str]) -> None:
        """Makes chunks known, encoding their distinct pieces together."""
        cut = {c: self.pattern.findall(c) for c in new}
        order = list({p for pieces in cut.values() for p in pieces})
        ids = dict(zip(order, self.replay.encode([p.encode() for p in order]), strict=True))
        for c, pieces in cut.items():
            self.known[c] = ids[pieces[0]] if len(pieces) == 1 else b"".join([ids[p] for p in pieces])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        new: set[str] = set()
        self.unknown(texts, new)
        self.learn(new)
        return self.look_up(texts)

    def look_up(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts whose chunks are all known."""
        return [b"".join(map(self.known.__getitem__, _CHUNK.findall(t))) if t else b"" for t in texts]

    def encode_batches(self, batches: Iterator[pa.RecordBatch], of: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
        """Batches with the ids of column number of. New chunks are gathered over several batches and replayed together."""
        held: list[pa.RecordBatch] = []
        new: set[str] = set()
        size = 0

        def release():
            self.learn(new)
            new.clear()
            for batch in held:
                yield batch, self.look_up(batch.column(of).to_pylist())
            held.clear()
            if len(self.known) > self.most:
                self.known.clear()

        for batch in sliced(batches):
            held.append(batch)
            size += batch.nbytes
            self.unknown(batch.column(of).to_pylist(), new)
            if size > HELD_BYTES or len(new) > HELD_CHUNKS:
                yield from release()
                size = 0
        yield from release()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.replay.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """docs with the ids of text_col as one more column: binary, little-endian unsigned 32-bit.

    decoded_col: also the bytes that these ids decode to, in the same pass. Names that are taken are an error,
    and so is a pattern that could match across the chunks that texts are cut into.
    """
    need_free(docs, [ids_col, *([decoded_col] if decoded_col else [])])
    check_pattern(pattern)
    names = docs.columns
    of, plain = names.index(text_col), docs.toDF(*[f"c{i}" for i in range(len(names))])
    table = docs.sparkSession.sparkContext.broadcast(load_ranks(path))  # the vocabulary: of fixed size
    more = ["ids", "decoded"] if decoded_col else ["ids"]

    def run(batches):
        encoder = Encoder(table.value, pattern)
        for batch, ids in encoder.encode_batches(batches, of):
            made = [pa.array(ids, pa.binary())]
            if decoded_col:
                made.append(pa.array(map(encoder.decode, ids), pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *more])

    out = plain.mapInArrow(run, T.StructType([*plain.schema.fields, *[T.StructField(c, T.BinaryType()) for c in more]]))
    return out.toDF(*names, ids_col, *([decoded_col] if decoded_col else []))


def decode(coded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """coded with the bytes that its ids stand for as one more column."""
    need_free(coded, [out_col])
    names = coded.columns
    of, plain = names.index(ids_col), coded.toDF(*[f"c{i}" for i in range(len(names))])
    table = coded.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches):
        tokens = {i: t for t, i in table.value.items()}
        for batch in sliced(batches):
            found = [b"".join(map(tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())) for ids in batch.column(of).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "decoded"])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("decoded", T.BinaryType())])).toDF(*names, out_col)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of whole texts, encoded and decoded again."""
    coded = encode(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), path, pattern, decoded_col="decoded")
    return coded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
