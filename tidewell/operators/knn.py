"""Exact nearest neighbours by cosine distance; vector_index has the approximate ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.vectors import cosine

#: Query vectors up to which one pass with a broadcast of them compares them with all rows; more meet the rows block by block.
QUERY_BLOCK = 2048
#: Most numbers in the vectors of a block (65536 vectors of 64), and blocks at which a table is spread enough.
BLOCK_VALUES, LEAST_BLOCKS = 1 << 22, 6
#: Queries and rows whose distances a task holds at a time.
TILE_QUERIES, TILE_ROWS = 512, 512
#: Stand for the distances, at most 2, to a vector without direction (NaN) and to a row without a vector (null).
NO_DIRECTION, NO_VECTOR = 3.0, 4.0
#: Distances that differ by no more may be equal once rounded to six digits; a distance that is less once rounded is less by more than FINER.
STEP, FINER = 1.1e-6, 0.4e-6


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors as rows: zeros for one without direction, NaN for a row without a vector."""
    has = column.is_valid().to_numpy(zero_copy_only=False)
    v = _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(has.sum(), dims))
    v[~np.isfinite(v).all(1)] = 0
    if has.all():
        return v
    whole = np.full((len(has), dims), np.nan)
    whole[has] = v
    return whole


def _lost(v: np.ndarray) -> np.ndarray:
    """What stands for a unit vector's distances; 0 if they are numbers."""
    return np.select([np.isnan(v).any(1), ~v.any(1)], [NO_VECTOR, NO_DIRECTION], 0.0)


class KNearest:
    """The k nearest rows of each query (ids, unit vectors) so far, by distance, then id; memory grows with k and the queries, not with the rows."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.k, self.lost = ids, k, _lost(q)
        self.q = np.where(self.lost[:, None] > 0, 0.0, q) if self.lost.any() else q
        self.fars, self.nearest = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.room, self.over = np.empty(TILE_QUERIES * TILE_ROWS), np.empty(TILE_QUERIES * TILE_ROWS, bool)  # of every tile

    @property
    def at(self) -> np.ndarray:
        return np.nonzero(np.isfinite(self.fars))[0]

    @property
    def far(self) -> np.ndarray:
        return self.fars[np.isfinite(self.fars)]

    @property
    def id(self) -> np.ndarray:
        return self.nearest[np.isfinite(self.fars)]

    def add(self, own: np.ndarray, v: np.ndarray) -> None:
        lost = _lost(v)
        if lost.any():
            v = np.where(lost[:, None] > 0, 0.0, v)
        for r in range(0, len(own), TILE_ROWS):
            rows = slice(r, r + TILE_ROWS)
            for a in range(0, len(self.ids), TILE_QUERIES):
                self._meet(slice(a, a + TILE_QUERIES), own[rows], v[rows], lost[rows])

    def _meet(self, tile: slice, rows: np.ndarray, v: np.ndarray, lost: np.ndarray) -> None:
        ids, gone, k = self.ids[tile], self.lost[tile], self.k
        worst, worst_id = self.fars[tile, -1], self.nearest[tile, -1]
        shape = len(ids), len(rows)
        near, over = (x[: shape[0] * shape[1]].reshape(shape) for x in (self.room, self.over))
        np.matmul(self.q[tile], v.T, out=near)
        if lost.any():
            np.minimum(near, np.where(lost > 0, 1 - lost, np.inf), out=near)
        if gone.any():
            np.minimum(near, np.where(gone > 0, 1 - gone, np.inf)[:, None], out=near)
        least = 1 - worst + np.where(worst_id < rows.min(), FINER, -STEP)  # rows of larger ids must be nearer
        if len(rows) > k and np.isinf(worst).any():
            near[ids[:, None] == rows[None, :]] = -np.inf
            least = np.maximum(least, np.partition(near, -k, axis=1)[:, -k] - STEP)
        hit = np.flatnonzero(np.greater_equal(near, least[:, None], out=over))
        i, j, sim = hit // len(rows), hit % len(rows), near.ravel()[hit]
        far = np.where(sim < -1.5, 1 - sim, np.round(1 - np.clip(sim, -1, 1), 6))
        kept = ((far < worst[i]) | ((far == worst[i]) & (rows[j] < worst_id[i]))) & (ids[i] != rows[j])
        if kept.any():
            self._best(tile.start + i[kept], far[kept], rows[j[kept]])

    def _best(self, at: np.ndarray, far: np.ndarray, ids: np.ndarray) -> None:
        met = np.unique(at)
        at, far, ids = np.concatenate([np.repeat(met, self.k), at]), np.concatenate([self.fars[met].ravel(), far]), np.concatenate([self.nearest[met].ravel(), ids])
        order = np.lexsort((ids, far, at))
        kept = order[np.arange(len(at)) - np.searchsorted(at[order], at[order]) < self.k]
        self.fars[met], self.nearest[met] = far[kept].reshape(-1, self.k), ids[kept].reshape(-1, self.k)


def nearest(rows: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, distance) of the k nearest rows: a scan and a bounded top-k, without a shuffle of the rows."""
    vector: Column = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.select(F.col(id_col), F.round(1 - cosine(F.col(vec_col), vector), 6).alias("distance"))
    return scored.orderBy("distance", id_col).limit(k)


def nearest_each(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, neighbour_id, distance, rank): the k nearest other rows of each query row.

    Up to QUERY_BLOCK queries are broadcast, and rows stay where they are. More are dealt into blocks, as the rows
    are, and each task compares one block of queries with one of rows, by small matrix products. Either way a task
    passes on k rows a query at most, which a second step merges. Rows out grow with the queries.

    As in SQL, what has no vector is at no distance (null) of anything, and comes last; before it comes what has no
    direction (NaN).
    """
    kind = "query_id long, neighbour_id long, distance double"
    named = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vector")).where("id is not null")
    rows, queries = named(rows), named(queries)
    few, dims = queries.limit(QUERY_BLOCK + 1).toArrow(), _dims(rows, queries)
    if not few.num_rows:
        found = rows.sparkSession.createDataFrame([], kind)
    elif few.num_rows <= QUERY_BLOCK:
        found = _met_by_few(rows, few, k, kind, dims)
    else:
        found = _met_by_blocks(rows, queries, k, kind, dims)
    top = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))), 1, k).alias("top"))
    told = F.when(F.col("n.distance") == NO_DIRECTION, F.lit(float("nan"))).when(F.col("n.distance") < NO_DIRECTION, F.col("n.distance")).alias("distance")
    return top.select("query_id", F.posexplode("top").alias("rank", "n")).select("query_id", "n.neighbour_id", told, (F.col("rank") + 1).cast("long").alias("rank"))


def _dims(*tables: DataFrame) -> int:
    first = (t.where("vector is not null").select(F.size("vector")).first() for t in tables)
    return next((r[0] for r in first if r), 1)


def _told(best: KNearest) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(best.ids[best.at]), pa.array(best.id), pa.array(best.far)], names=["query_id", "neighbour_id", "distance"])


def _met_by_few(rows: DataFrame, few: pa.Table, k: int, kind: str, dims: int) -> DataFrame:
    ids, vectors = few.combine_chunks().itercolumns()
    shared = rows.sparkSession.sparkContext.broadcast((ids.to_numpy(), np.concatenate([_vectors(x, dims) for x in vectors.chunks])))

    def run(batches):
        best = KNearest(*shared.value, k)
        for batch in batches:
            if batch.num_rows:
                best.add(batch.column(0).to_numpy(), _vectors(batch.column(1), dims))
        yield _told(best)

    return rows.mapInArrow(run, kind)


def _met_by_blocks(rows: DataFrame, queries: DataFrame, k: int, kind: str, dims: int) -> DataFrame:
    def blocks(n: int) -> int:
        return max(-(-n // max(1, BLOCK_VALUES // max(1, dims))), min(LEAST_BLOCKS, -(-n // QUERY_BLOCK)), 1)

    n_q, n_r = blocks(queries.count()), blocks(rows.count())
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(own(n_q).alias("q"), every(n_r).alias("r"), F.lit(True).alias("asks"), "id", "vector")
    held = rows.select(every(n_q).alias("q"), own(n_r).alias("r"), F.lit(False).alias("asks"), "id", "vector")

    def run(batches):  # queries come first, then rows in order of their ids
        asked, best = [], None
        for batch in batches:
            n = np.count_nonzero(batch.column(0).to_numpy(zero_copy_only=False))
            ids = batch.column(1).to_numpy()
            if n:
                asked.append((ids[:n], _vectors(batch.column(2)[:n], dims)))
            if n < len(ids) and (asked or best):
                if best is None:
                    best, asked = KNearest(*(np.concatenate(x) for x in zip(*asked, strict=True)), k), []
                best.add(ids[n:], _vectors(batch.column(2)[n:], dims))
        if best is not None:
            yield _told(best)

    met = asked.unionByName(held).repartitionById(n_q * n_r, F.col("q") * n_r + F.col("r"))
    return met.sortWithinPartitions(F.desc("asks"), "id").select("asks", "id", "vector").mapInArrow(run, kind)
