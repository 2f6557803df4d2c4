"""Approximate nearest neighbours: inverted lists with residual product codes, kept as segments.

Every vector belongs to the list of its nearest centroid and has a code: the nearest of 256
words for each few dimensions of what the centroid leaves. A search ranks the lists by a query's centroids, compares
codes of the first `probes` lists only (a byte for each few dimensions), and reads whole vectors of the best
`width` codes alone, whose distances are exact. Lists are folders, so other lists aren't read at all.

Centroids and code words are learnt from a bounded sample (TRAIN_ROWS rows); all rows are indexed. How many lists to
probe and how many codes to follow up is measured when the index is built: the cheapest setting at
which CALIBRATE_ROWS sampled rows find at least `target` of their exact neighbours. So vectors without structure cost
more, not recall.

A list is compared in slices of bounded size, and so are the queries that probe it: a list or a group of copies
that holds a third of all rows is spread over tasks.

Changes are segments too: added rows, and ids that are gone or replaced (tombstones). They are left out
before the nearest are cut to k. Distances are cosine distances; a vector without direction has distance 1 to all.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.vectors import cosine
from tidewell.operators import knn
from tidewell.sources.segments import Store
from tidewell.sources.storage import keep

TRAIN_ROWS = 1 << 15
CALIBRATE_ROWS = 128
MOST_LISTS = 4096
#: Dimensions of a code's byte.
CODE_DIMS = 4
#: Codes of a list, and queries, that are compared at a time.
SLICE_ROWS, SLICE_QUERIES = 1 << 15, 256
MOST_WIDTH = 400


def width_for(k: int) -> int:
    """Codes to follow up for k neighbours, if less is not measured to do."""
    return max(16, min(4 * k, 200))


def widened(k: int) -> int:
    """Neighbours to find for k, so that tombstones among them cost no second search."""
    return min(2 * k, k + 32)


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as unit rows."""
    return unit(np.array(column.to_pylist(), np.float32).reshape(len(column), -1))


def means(points: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """k centres by Lloyd's method; one that has no point left takes a far one."""
    r = np.random.default_rng(seed)
    centres = points[r.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        own, gap = nearest_centre(points, centres)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, weights=points[:, j], minlength=k) for j in range(points.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], 0).astype(np.float32)
        lost = np.flatnonzero(n == 0)
        centres[lost] = points[np.argsort(-gap, kind="stable")[: len(lost)]]
    return centres


def nearest_centre(points: np.ndarray, centres: np.ndarray, rows: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point, and its squared distance."""
    half, own, gap = (centres * centres).sum(1) / 2, [], []
    for i in range(0, len(points), rows):
        part = points[i : i + rows]
        near = part @ centres.T - half
        own.append(near.argmax(1))
        gap.append((part * part).sum(1) - 2 * near.max(1))
    return np.concatenate(own) if own else np.empty(0, np.int64), np.concatenate(gap) if gap else np.empty(0)


class Codebook:
    """Centroids (lists x dimensions) and code words (bytes x words x dimensions of a byte); bounded by MOST_LISTS and 256 words."""

    def __init__(self, centroids: np.ndarray, words: np.ndarray):
        self.centroids, self.words = centroids.astype(np.float32), words.astype(np.float32)

    @classmethod
    def learn(cls, sample: np.ndarray, lists: int) -> Codebook:
        centroids = means(sample, min(lists, len(sample)))
        left = cls._split(sample - centroids[nearest_centre(sample, centroids)[0]])
        return cls(centroids, np.stack([means(left[:, j], min(256, len(sample))) for j in range(left.shape[1])]))

    @staticmethod
    def _split(m: np.ndarray) -> np.ndarray:
        """Rows cut into pieces of CODE_DIMS, the last one filled up with zeros."""
        pad = -m.shape[1] % CODE_DIMS
        return np.pad(m, ((0, 0), (0, pad))).reshape(len(m), -1, CODE_DIMS)

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code of unit vectors."""
        own = nearest_centre(vectors, self.centroids)[0]
        left = self._split(vectors - self.centroids[own])
        return own, np.stack([nearest_centre(np.ascontiguousarray(left[:, j]), self.words[j])[0] for j in range(left.shape[1])], 1).astype(np.uint8)

    def probes(self, queries: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each query, the nearest first."""
        return np.argsort((self.centroids * self.centroids).sum(1) / 2 - queries @ self.centroids.T, axis=1, kind="stable")[:, :n]

    def similarity(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Approximate products of queries with the coded vectors of list `at`."""
        tables = np.einsum("qjd,jwd->qjw", self._split(queries), self.words)
        out = np.repeat((queries @ self.centroids[at])[:, None], len(codes), 1)
        for j in range(codes.shape[1]):
            out += tables[:, j, codes[:, j]]
        return out

    def rows(self, spark: SparkSession) -> DataFrame:
        told = [("centroid", i, v.tolist()) for i, v in enumerate(self.centroids)] + [("word", i * 256 + j, w.tolist()) for i, words in enumerate(self.words) for j, w in enumerate(words)]
        return spark.createDataFrame(told, "kind string, place int, v array<float>")

    @classmethod
    def read(cls, rows: DataFrame) -> Codebook:
        held = sorted(map(tuple, rows.collect()))  # bounded as above
        words = [(at // 256, v) for kind, at, v in held if kind == "word"]
        return cls(np.array([v for kind, _, v in held if kind == "centroid"]), np.array([[v for j, v in words if j == i] for i in range(words[-1][0] + 1)]))


def _segment(rows: DataFrame, book: Codebook, seq: int, salts: dict[int, int]) -> DataFrame:
    """(list, id, code, vector, seq) of rows (id, vector), dealt by list; a large list over several tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                own, codes = shared.value.place(matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)], names=["list", "id", "code", "vector"])

    placed = rows.mapInArrow(run, "list int, id long, code binary, vector array<float>").withColumn("seq", F.lit(seq).cast("long"))
    large = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in salts.items() for x in kv]), F.col("list")), F.lit(1)) if salts else F.lit(1)
    return placed.repartition("list", F.pmod(F.xxhash64("id"), large)).sortWithinPartitions("list", "id")


def _named(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vector")).where("id is not null and vector is not null")


def build(rows: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, target: float = 0.95, lists: int | None = None) -> dict:
    """Indexes all rows (distinct ids; none without id or vector) in a folder and publishes it; its manifest has the measured setting."""
    spark, named = rows.sparkSession, _named(rows, id_col, vec_col)
    store = Store(spark, path)
    before = store.latest()
    n = named.count()
    seq = before["seq"] + 1 if before else 0
    if not n:
        return store.publish({"seq": seq, "n_dead": 0, "n": 0, "lists": 0, "probes": 0, "width": width_for(k), "slices": {}, "recall": None, "segments": {}}, before)
    sampled = named.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, TRAIN_ROWS / n) * (1 << 30)) + 1).limit(2 * TRAIN_ROWS)
    sample = unit(np.array([r[0] for r in sampled.select("vector").collect()] or [named.first()["vector"]], np.float32))
    book = Codebook.learn(sample, lists or max(1, min(MOST_LISTS, round(n**0.5))))
    share = np.bincount(nearest_centre(sample, book.centroids)[0], minlength=len(book.centroids)) / len(sample)
    slices = {i: int(-(-n * x // SLICE_ROWS)) for i, x in enumerate(share) if n * x > SLICE_ROWS}
    segments = {"lists": [store.write(_segment(named, book, seq, slices), "lists", "list")], "codebook": [store.write(book.rows(spark).coalesce(1), "codebook")]}
    manifest = {"seq": seq, "n_dead": 0, "n": n, "lists": len(book.centroids), "probes": len(book.centroids), "width": MOST_WIDTH, "slices": slices, "segments": segments}
    return store.publish(manifest | _calibrate(store, manifest, named, book, k, target), before)


def _calibrate(store: Store, manifest: dict, named: DataFrame, book: Codebook, k: int, target: float) -> dict:
    """The least probes and width at which a sample finds its neighbours, with a little more allowed for the lists than for the codes."""
    n = manifest["n"]
    asked = keep(named.where(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(1 << 30)) < int(min(1.0, 2 * CALIBRATE_ROWS / n) * (1 << 30)) + 1).limit(CALIBRATE_ROWS), "calibrate")
    exact = keep(knn.nearest_each(named, asked, k, "id", "vector"), "calibrate-exact")
    true = exact.count()
    if not true:
        return {"probes": 1, "width": width_for(k), "recall": None}
    met = exact.join(F.broadcast(store.table(manifest, "lists").select("list", F.col("id").alias("neighbour_id")).join(F.broadcast(exact.select("neighbour_id").distinct()), "neighbour_id", "left_semi")), "neighbour_id")
    lists = dict(((q, x), at) for q, x, at in met.select("query_id", "neighbour_id", "list").collect())  # at most CALIBRATE_ROWS times k
    order = {r["id"]: book.probes(unit(np.array([r["vector"]], np.float32)), manifest["lists"])[0].tolist() for r in asked.collect()}
    ranks = np.sort([order[q].index(at) + 1 for (q, _), at in lists.items()])
    found = lambda share: int(ranks[min(len(ranks) - 1, int(np.ceil(share * len(ranks))) - 1)])
    probes = found((1 + target) / 2)
    by_code = candidates(store, manifest | {"probes": probes, "width": MOST_WIDTH}, book, asked.select(F.col("id").alias("query_id"), "vector"))
    far = _distances(store, manifest, keep(by_code, "calibrate-candidates"), asked.select(F.col("id").alias("query_id"), "vector"))
    # As near as the k-th counts, whichever of equal ones it is.
    hits = far.join(F.broadcast(exact.groupBy("query_id").agg(F.max("distance").alias("most"), F.count("*").alias("k"))), "query_id").where("distance <= most")
    first = hits.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where("n <= k")
    places = np.sort([r[0] for r in first.select("place").collect()])
    need = int(np.ceil(target * true))
    width = int(places[need - 1]) if len(places) >= need else MOST_WIDTH
    width = max(width_for(k), width)
    return {"probes": probes, "width": width, "recall": float((places <= width).sum() / true)}


def candidates(store: Store, manifest: dict, book: Codebook, queries: DataFrame) -> DataFrame:
    """(query_id, list, id, seq, place): of each query (query_id, vector) the `width` best codes of its lists, itself left out; place: from 1."""
    spark, width, n_lists = store.spark, manifest["width"], manifest["probes"]
    shared = spark.sparkContext.broadcast(book)

    def probe(batches):
        for batch in batches:
            if batch.num_rows:
                at = shared.value.probes(matrix(batch.column(1)), n_lists)
                again = pa.array(np.repeat(np.arange(len(at)), at.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(again), pa.array(at.ravel(), pa.int32()), batch.column(1).take(again)], names=["query_id", "list", "vector"])

    probed = keep(queries.select("query_id", "vector").mapInArrow(probe, "query_id long, list int, vector array<float>"), "probes")
    each = {r["list"]: r["n"] for r in probed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most MOST_LISTS
    if not each:
        return spark.createDataFrame([], "query_id long, list int, id long, seq long, place int")
    slices = {int(i): x for i, x in manifest["slices"].items()}
    of = lambda table, column: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(column)), F.lit(1)) if table else F.lit(1)
    blocks = {i: -(-n // SLICE_QUERIES) for i, n in each.items() if n > SLICE_QUERIES}
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = probed.withColumn("block", F.pmod(F.xxhash64("query_id"), of(blocks, "list")).cast("int")).withColumn("slice", every(of(slices, "list")))
    own = store.alive(store.table(manifest, "lists").where(F.col("list").isin(list(each))).select("id", "seq", "list", "code"), manifest)
    codes = own.withColumn("slice", F.pmod(F.xxhash64("id"), of(slices, "list")).cast("int")).withColumn("block", every(of(blocks, "list")))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, seqs, best = left.column("id").to_numpy(), left.column("seq").to_numpy(), [[], [], [], []]
        queries = right.column("query_id").to_numpy()
        if len(ids) and len(queries):
            at = left.column("list")[0].as_py()
            held = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            vectors = matrix(right.column("vector").combine_chunks())
            for i in range(0, len(queries), 32):
                near = shared.value.similarity(vectors[i : i + 32], at, held)
                near[queries[i : i + 32, None] == ids[None, :]] = -np.inf
                top = np.argpartition(-near, min(width, len(ids)) - 1, axis=1)[:, :width]
                score = np.take_along_axis(near, top, 1)
                ok = np.isfinite(score)
                for column, x in zip(best, (np.broadcast_to(queries[i : i + 32, None], top.shape)[ok], ids[top][ok], seqs[top][ok], score[ok]), strict=True):
                    column.append(x)
        q, i, s, p = (np.concatenate(x) if x else np.empty(0) for x in best)
        at = np.full(len(q), left.column("list")[0].as_py() if len(left) else 0)
        return pa.table({"query_id": pa.array(q, pa.int64()), "list": pa.array(at, pa.int32()), "id": pa.array(i, pa.int64()), "seq": pa.array(s, pa.int64()), "near": pa.array(p, pa.float64())})

    key = ["list", "slice", "block"]
    found = codes.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(compare, "query_id long, list int, id long, seq long, near double")
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "id")))
    return ranked.where(F.col("place") <= width).drop("near")


@functools.lru_cache(maxsize=8)
def _codebook(path: str, name: str, spark: SparkSession) -> Codebook:
    return Codebook.read(spark.read.parquet(f"{path}/{name}"))


def _opened(spark: SparkSession, path: str) -> tuple[Store, dict]:
    store = Store(spark, path)
    manifest = store.latest()
    if manifest is None:
        raise LookupError(f"no index in {path}")
    return store, manifest


def search(path: str, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, neighbour_id, distance, rank): about the k nearest rows of the index of each query row (distinct ids), other than itself; distances are exact."""
    spark = queries.sparkSession
    store, manifest = _opened(spark, path)
    asked = _named(queries, id_col, vec_col).select(F.col("id").alias("query_id"), "vector")
    if not manifest["segments"].get("lists"):
        return spark.createDataFrame([], "query_id long, neighbour_id long, distance double, rank long")
    book = _codebook(store.path, manifest["segments"]["codebook"][0], spark)
    setting = manifest | {"width": max(manifest["width"], widened(k))}
    near = keep(candidates(store, setting, book, asked), "candidates")
    far = _distances(store, manifest, near, asked).withColumnRenamed("id", "neighbour_id")
    ranked = far.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id")).cast("long"))
    return ranked.where(F.col("rank") <= k).select("query_id", "neighbour_id", "distance", "rank")


def _distances(store: Store, manifest: dict, near: DataFrame, asked: DataFrame) -> DataFrame:
    """near (query_id, list, id, seq, place) with the exact distance to asked (query_id, vector); reads whole vectors of those lists only."""
    lists = [r[0] for r in near.select("list").distinct().collect()]  # at most MOST_LISTS
    vectors = store.table(manifest, "lists").where(F.col("list").isin(lists)).select("list", "id", "seq", F.col("vector").alias("own"))
    met = vectors.join(near, ["list", "id", "seq"]).join(asked, "query_id")
    return met.select("query_id", "id", "place", F.round(1 - cosine(F.col("own"), F.col("vector")), 6).alias("distance"))


def update(spark: SparkSession, path: str, changed: DataFrame, gone: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> dict:
    """Adds a delta: `changed` rows (new ones too) replace those of their ids, and ids of `gone` become tombstones. Codes and setting stay; a build learns them anew."""
    store, before = _opened(spark, path)
    new = _named(changed, id_col, vec_col)
    seq = before["seq"] + 1
    if not before["segments"].get("lists"):
        raise ValueError("an empty index has no codes; build it")
    dead = store.write(new.select("id").unionByName(gone.select(F.col(id_col).cast("long").alias("id"))).distinct().withColumn("seq", F.lit(seq).cast("long")), "dead")
    book = _codebook(store.path, before["segments"]["codebook"][0], spark)
    own = store.write(_segment(new, book, seq, {int(i): x for i, x in before["slices"].items()}), "lists", "list") if not new.isEmpty() else None
    segments = {**before["segments"], "dead": [*before["segments"].get("dead", []), dead], "lists": [*before["segments"]["lists"], *([own] if own else [])]}
    return store.publish({**before, "seq": seq, "segments": segments, "n_dead": before["n_dead"] + spark.read.parquet(f"{store.path}/{dead}").count()}, before)


def compact(spark: SparkSession, path: str) -> dict:
    """All live rows in one segment again, without tombstones."""
    store, before = _opened(spark, path)
    live = store.alive(store.table(before, "lists"), before)
    own = store.write(live.repartition("list", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("list", "id"), "lists", "list")
    n = spark.read.parquet(f"{store.path}/{own}").count()
    return store.publish({**before, "n": n, "n_dead": 0, "segments": {"lists": [own], "codebook": before["segments"]["codebook"]}}, before)


def indexed_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id) of the live rows of an index."""
    store, manifest = _opened(spark, path)
    held = store.table(manifest, "lists")
    return spark.createDataFrame([], "id long") if held is None else store.alive(held.select("id", "seq"), manifest).select("id")


def cost(path: str, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row: rows and lists of the index, its setting, and per query the mean number of codes compared and of whole vectors read."""
    spark = queries.sparkSession
    store, manifest = _opened(spark, path)
    book = _codebook(store.path, manifest["segments"]["codebook"][0], spark)
    shared, probes = spark.sparkContext.broadcast(book), manifest["probes"]

    def probe(batches):
        for batch in batches:
            if batch.num_rows:
                at = shared.value.probes(matrix(batch.column(0)), probes)
                yield pa.RecordBatch.from_arrays([pa.array(at.ravel(), pa.int32())], names=["list"])

    asked = _named(queries, id_col, vec_col)
    sizes = store.alive(store.table(manifest, "lists").select("id", "seq", "list"), manifest).groupBy("list").agg(F.count("*").alias("n"))
    codes = asked.select("vector").mapInArrow(probe, "list int").join(F.broadcast(sizes), "list").agg(F.sum("n").alias("codes"))  # a row a list
    width = max(manifest["width"], widened(k))
    told = codes.crossJoin(asked.agg(F.count("*").alias("queries")))  # one row each
    return told.select(F.lit(manifest["n"]).alias("n"), F.lit(manifest["lists"]).alias("lists"), F.lit(probes).alias("probes"), F.lit(width).alias("width"), (F.col("codes") / F.col("queries")).alias("codes"), F.least(F.lit(float(width)), F.col("codes") / F.col("queries")).alias("vectors"))
