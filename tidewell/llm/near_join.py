"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

1. Every text becomes its set of five-word shingles (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased;
   fewer words than five are one shingle), held as 64-bit hashes. Texts of equal sets are one node,
   so copies, however many, cost one row.
2. A node has a label in each of TREES prefix tries: LABEL MinHash values. Sorting a tree's labels lays
   its trie out in order. Nodes that share a prefix are compared by all their MinHash values, from the full
   label on: of those that share it, the first one free leads, nodes near it join its group, and those very
   near need no shorter prefix, as their leader goes on for them. The prefix of whatever still leads is
   shortened by one value, and so on, until the chance that a pair at the threshold has met in some tree
   reaches the target recall. A hot prefix is so thinned out from its leaves. A group is told by one link a
   node. Trees are dealt by ranges of (tree, label, node): a hot prefix is cut over tasks, and what leads at
   their edges meets in a second, small pass, block by block where it is many.
3. Connected candidates make components. Their shingle sets are fetched once and compared exactly, in
   blocks of BLOCK nodes; a component of more nodes is compared block by block. Links are counted,
   never listed, and classes are the connected components of the exact links.

Exact comparison is of shingle hashes (a false equality has a chance of about 2**-64 a pair).
Nulls: a null text, or one without words, has no shingles: no links, a class of its own. A row
with a null id is compared with nothing: null class, no links. Rows of equal text, repeated
rows included, count as linked copies. An empty table gives an empty result. Ties: the smallest
id names a class. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import LOWER, bounded_broadcast, components, discard, keep, sliced, spread_anti, spread_join

SHINGLE = 5
THRESHOLD = 0.8
TREES = 14
LABEL = 6
RECALL = 0.9995
#: Share of equal MinHash values with its leader from which on a node leads no more.
LED = 0.85
#: Nodes of a component that one task compares with as many others at a time, and leaders of one prefix that do so.
BLOCK = 256
EDGE_BLOCK = 512
#: Ids up to which the candidates' ids are broadcast to the documents; beyond, both sides are shuffled.
MOST_IDS = 1_000_000

_K = TREES * LABEL
_RNG = np.random.default_rng(20240117)
_A = _RNG.integers(1, 1 << 63, _K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, _K, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


def matched_prefix(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix by which a pair at the threshold meets in some tree with a chance of at least recall."""
    return next((d for d in range(LABEL, 0, -1) if 1 - (1 - threshold**d) ** TREES >= recall), 1)


def near_shares(threshold: float) -> tuple[float, float]:
    """Least shares of equal MinHash values: of a pair at the threshold, and of one partner of it with the other's leader.

    Both lie some standard deviations of a share below what is expected, so nearly no pair falls short.
    """
    below = lambda p, times: max(0.0, p - times * math.sqrt(p * (1 - p) / _K))
    return below(threshold, 5.7), below(max(0.0, threshold - (1 - LED)), 3.9)


class Shingler:
    """Shingle sets of texts, remembering the hashes of a bounded number of words."""

    def __init__(self, most: int = 200_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def shingles(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles."""
        words = text.translate(LOWER).split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - SHINGLE + 1)
        out = np.full(n, min(len(h), SHINGLE), np.uint64)
        for i in range(min(len(h), SHINGLE)):
            out = (out ^ h[i : i + n]) * _P
            out ^= out >> np.uint64(29)
        return np.unique(out)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """_K values of 32 bits."""
    least = np.full(_K, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[i : i + 2048, None] * _A + _B).min(0))
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, node, sig) of rows (doc_id, text): node names the shingle set (null if empty), sig holds 16 bits of each MinHash value."""

    def run(batches):
        shingler = Shingler()
        for batch in sliced(batches):
            nodes, sigs = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingler.shingles(text)
                nodes.append(int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None)
                sigs.append((minhash(s) & np.uint32(0xFFFF)).astype(">u2").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "node", "sig"])

    return docs.mapInArrow(run, "doc_id long, node long, sig binary")


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of equal lengths as rows of bytes."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), width)


def leaders(values: np.ndarray, link: float, through: float) -> tuple[list[tuple[int, int]], list[int]]:
    """Links (member, first) that hold together the rows of MinHash values that are near through leaders, and the rows that lead.

    Only what is connected matters, so a group is told by one link a row.
    """
    n = len(values)
    if n == 2:
        alike = (values[0] == values[1]).mean()
        return [(1, 0)] if alike >= link else [], [0] if alike >= LED else [0, 1]
    free, group, lead = np.ones(n, bool), np.arange(n), []
    for i in range(n):
        if not free[i]:
            continue
        alike = (values == values[i]).mean(1)
        met = np.unique(group[alike >= through])
        if len(met) > 1:
            group[np.isin(group, met)] = met[0]
        free &= alike < LED
        free[i] = False
        lead.append(i)
    return [(j, g) for j, g in enumerate(group.tolist()) if g != j], lead


def climb(labels: np.ndarray, values: np.ndarray, depth: int, link: float, through: float) -> tuple[list[tuple[int, int]], list[int]]:
    """leaders() of rows in the order of their labels, from the full label up to a prefix of depth values: at each, only what leads still meets."""
    links, lead = [], np.arange(len(labels))
    for d in range(labels.shape[1] // 2, depth - 1, -1):
        own = labels[lead, : 2 * d]
        cuts = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(1)) + 1).tolist(), len(lead)]
        left = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if j - i == 1:
                left.append(lead[i : i + 1])
                continue
            at = lead[i:j]
            found, kept = leaders(values[at], link, through)
            links += [(int(at[a]), int(at[b])) for a, b in found]
            left.append(at[kept])
        lead = np.concatenate(left)
    return links, lead.tolist()


def joined(links: list[tuple[int, int]], nodes: np.ndarray) -> list[tuple[int, int]]:
    """What links of rows connect, told by one link a node, to the smallest node, so that trees that find the same group say the same."""
    up: dict[int, int] = {}

    def top(i: int) -> int:
        while (above := up.setdefault(i, i)) != i:
            up[i] = i = up[above]
        return i

    for a, b in links:
        p, q = top(a), top(b)
        if p != q:
            low, high = (p, q) if nodes[p] < nodes[q] else (q, p)
            up[high] = low
    return [(int(nodes[i]), int(nodes[r])) for i in list(up) if (r := top(i)) != i]


def _runs(edges_only: bool, depth: int, threshold: float):
    """A function over batches (tree, label, node, sig) in order: links of nodes that share a tree and depth values of label.

    edges_only: the label, as a whole, names a group of leaders.
    """
    link, through = near_shares(threshold)

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []  # key, label, node, values: the run that may go on
        first = True

        def close(keys, labels, nodes, values, edge):
            links, lead = leaders(values, link, through) if edges_only else climb(labels, values, depth, link, through)
            rows = [(a, b, None, None, None) for a, b in joined(links, nodes)]
            if edge and not edges_only:
                rows += [(None, int(nodes[i]), int.from_bytes(keys[0, :4].tobytes(), "big"), keys[0, 4:].tobytes(), values[i].tobytes()) for i in lead]
            return rows

        def out(rows):
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], names=["a", "b", "tree", "label", "sig"])

        def whole():
            return tuple(np.concatenate(x) for x in zip(*held, strict=True))

        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column(0).to_numpy().astype(">i4").view(np.uint8).reshape(-1, 4)
            label = _fixed(batch.column(1), len(batch.column(1)[0].as_py()))
            keys = np.concatenate([tree, label if edges_only else label[:, : 2 * depth]], 1)
            nodes, values = batch.column(2).to_numpy(), _fixed(batch.column(3), _K)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            starts = np.concatenate([[0], cuts, [len(keys)]])
            rows, begin = [], 0
            if held:
                if (held[0][0][0] == keys[0]).all():
                    end = int(starts[1])
                    held.append((keys[:end], label[:end].copy(), nodes[:end], values[:end].copy()))
                    begin = 1
                if begin == 0 or len(starts) > 2:
                    rows += close(*whole(), first)
                    held, first = [], False
            if not held:
                last = len(starts) - 2
                sizes = np.diff(starts)
                for k in range(begin, last):
                    if sizes[k] > 1 or first:
                        i, j = int(starts[k]), int(starts[k + 1])
                        rows += close(keys[i:j], label[i:j], nodes[i:j], values[i:j], first)
                    first = False
                i = int(starts[last])
                held = [(keys[i:], label[i:].copy(), nodes[i:], values[i:].copy())]
            yield out(rows)
        if held:
            yield out(close(*whole(), True))

    return run


def candidates(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Candidate links (a, b) of nodes (node, sig)."""
    depth = matched_prefix(threshold)
    schema = "a long, b long, tree int, label binary, sig binary"
    trees = F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("sig", 2 * LABEL * t + 1, 2 * LABEL).alias("label")) for t in range(TREES)])
    # The low byte of each value is enough to compare by.
    low = F.unhex(F.regexp_replace(F.hex("sig"), "..(..)", "$1"))
    rows = nodes.select("node", low.alias("sig"), F.explode(trees).alias("t")).select("t.tree", "t.label", "node", "sig")
    met = keep(rows.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node").mapInArrow(_runs(False, depth, threshold), schema), "near-met", 4096)
    # Leaders of a prefix that lies in several tasks: each two of their blocks meet once.
    edge = met.where("tree is not null").select("tree", "label", F.col("b").alias("node"), "sig")
    # Two prefixes a task at most have leaders at its edges, so their counts are few.
    counts = edge.groupBy("tree", "label").agg(F.ceil(F.count("*") / EDGE_BLOCK).cast("int").alias("blocks"))
    block = edge.join(F.broadcast(counts), ["tree", "label"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = block.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    four = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    dealt = other.select("tree", F.concat("label", four(F.least("block", "other")), four(F.greatest("block", "other"))).alias("label"), "node", "sig")
    more = dealt.repartition("tree", "label").sortWithinPartitions("tree", "label", "node").mapInArrow(_runs(True, depth, threshold), schema)
    links = keep(met.where("tree is null").unionByName(more).select("a", "b").where("a <> b").distinct(), "near-links", 4096)
    discard(met)
    return links


def _verify(threshold: float):
    """A function over batches (component, b1, b2, node, weight, block, shingles) sorted by the first four: (node, links, root) by block pair."""

    def compare(b1, b2, nodes, weights, blocks, sets):
        n = len(nodes)
        sizes = np.array([len(s) for s in sets])
        values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(n), sizes)
        order = np.argsort(inverse, kind="stable")
        inverse, owner = inverse[order], owner[order]
        shared = np.zeros((n, n), np.float32)
        for start in range(0, len(values), 4096):  # counts of common shingles, some thousands at a time
            i, j = np.searchsorted(inverse, [start, start + 4096])
            part = np.zeros((n, 4096), np.float32)
            part[owner[i:j], inverse[i:j] - start] = 1
            shared += part @ part.T
        near = shared >= np.ceil(threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-6)
        np.fill_diagonal(near, False)
        if b1 != b2:
            near &= blocks[:, None] != blocks[None, :]
        counts = near @ weights
        root = np.arange(n)
        while True:  # the smallest index among neighbours, until nothing changes
            least = np.where(near, root[None, :], n).min(1, initial=n)
            new = np.minimum(root, least)
            new = new[new]
            if (new == root).all():
                break
            root = new
        return counts, nodes[root]

    def run(batches):
        key, held = None, []

        def done():
            if len(held) < 2:
                return None
            nodes, weights, blocks = (np.array([x[i] for x in held], np.int64) for i in range(3))
            counts, roots = compare(key[1], key[2], nodes, weights, blocks, [np.frombuffer(x[3], np.uint64) for x in held])
            hit = counts > 0
            return pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(counts[hit], pa.int64()), pa.array(roots[hit])], names=["node", "links", "root"])

        for batch in sliced(batches):
            for c, b1, b2, node, weight, block, shingles in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if key != (c, b1, b2):
                    if (found := done()) is not None:
                        yield found
                    key, held = (c, b1, b2), []
                if not held or held[-1][0] != node:  # a repeated row of one id
                    held.append((node, weight, block, shingles))
        if (found := done()) is not None:
            yield found

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row per row of docs: doc_id, class_id (the class's smallest id) and n_links (other rows at or over the threshold)."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    whole = keep(signatures(named.where("doc_id is not null")), "near-signatures")
    nodes = keep(whole.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc"), F.count("*").alias("weight"), F.max("sig").alias("sig")), "near-nodes")
    links = candidates(nodes.select("node", "sig"), threshold)
    labels = components(links, "near-candidates")
    discard(links)
    sizes = labels.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    active = keep(labels.join(sizes, "component").join(nodes.select("node", "doc", "weight"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "near-active")

    def fetched(batches):
        shingler = Shingler()
        for batch in sliced(batches):
            found, keep_rows = [], []
            for i, (node, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)):
                raw = shingler.shingles(text).tobytes()
                if int.from_bytes(blake2b(raw, digest_size=8).digest(), "little", signed=True) == node:
                    found.append(raw)
                    keep_rows.append(i)
            kept = batch.take(pa.array(keep_rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), *kept.columns[2:], pa.array(found, pa.binary())], names=["node", "component", "weight", "block", "blocks", "shingles"])

    wanted = bounded_broadcast(active.select(F.col("doc").alias("doc_id"), "node", "component", "weight", "block", "blocks"), active.count(), MOST_IDS)
    sets = named.where("doc_id is not null").join(wanted, "doc_id").select("node", "text", "component", "weight", "block", "blocks").mapInArrow(fetched, "node long, component long, weight long, block int, blocks int, shingles binary")
    # Each pair of a component's blocks meets once; a component of one block stays one row a node.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = sets.select("component", other.alias("other"), "node", "weight", "block", "shingles").select("component", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "node", "weight", "block", "shingles")
    verified = keep(pairs.repartition("component", "b1", "b2").sortWithinPartitions("component", "b1", "b2", "node").mapInArrow(_verify(threshold), "node long, links long, root long"), "near-verified")
    counts = verified.groupBy("node").agg(F.sum("links").alias("links"))
    final = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")), "near-classes")
    known = nodes.select("node", "doc", "weight").join(counts, "node", "left").join(final, "node", "left").where("links is not null or weight > 1")
    groups = known.groupBy(F.coalesce("component", "node").alias("g")).agg(F.min("doc").alias("class_id"))
    table = keep(known.join(groups, F.coalesce("component", "node") == F.col("g")).select("node", "class_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "near-table")
    for past in (labels, active, verified, final, nodes):
        discard(past)
    rows = spread_join(whole.select("doc_id", "node"), table, "node", table.count(), MOST_IDS)
    told = rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    blank = named.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return told.unionByName(blank)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with only the smallest id of each class, columns as they were; rows with a null id stay."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = f"c{names.index(id_col)}"
    lost = keep(near_duplicates(plain, own, f"c{names.index(text_col)}", threshold).where("class_id <> doc_id").select("doc_id").distinct(), "near-lost")
    return spread_anti(plain, lost, own, lost.count(), MOST_IDS).toDF(*names)
