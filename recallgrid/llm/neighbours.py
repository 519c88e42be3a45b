"""Problem 6: the most similar vectors for every vector.

Inverted multi-index: the two halves of the unit vectors are quantised separately with ``K`` centroids each, which gives
K x K cells.  For every vector a heap walks over the pairs of centroids by summed distance and takes the nearest
``PROBES`` cells; the vector stands in each of them, and every cell is searched exactly (block products in double
precision), all its vectors against each other in blocks.  The best of a vector's cells are merged and ranked.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.llm.vectors import DIM, bounded_sample, matrix, pack, tasks_for, unit, unpack, vectors
from recallgrid.operators.search import nearest
from recallgrid.sources.tables import table

THRESHOLD, TOP = 0.80, 5
PROBES = 6
#: Rows of a cell that one task searches; larger cells are cut into blocks that meet pairwise.
CELL_ROWS = 24_000
#: A key is a cell (16 bits) and the numbers of the two blocks of it that meet (23 bits each).
BLOCK_BITS, CELL_SHIFT = 23, 46
ROUND = 12


def centroids_per_half(n_rows: int) -> int:
    """Twice the fourth root of the rows, as a power of two from 4 to 256: cells hold about the root of the rows."""
    return int(min(256, max(4, 2 ** round(np.log2(2 * max(n_rows, 1) ** 0.25)))))


def codebook(x: np.ndarray, k: int, rounds: int = 6, seed: int = 11) -> np.ndarray:
    """k-means on a bounded sample; an empty centroid starts again at a random row."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        for j in range(k):
            mine = near == j
            c[j] = x[mine].mean(0) if mine.any() else x[rng.integers(len(x))]
    return c


def multi_sequence(d1: list[float], d2: list[float], count: int) -> list[tuple[int, int]]:
    """The ``count`` index pairs (i, j) with the least d1[i] + d2[j], in order; both lists ascend.  Ties by (i, j)."""
    heap, seen, out = [(d1[0] + d2[0], 0, 0)], {(0, 0)}, []
    while heap and len(out) < count:
        _, i, j = heapq.heappop(heap)
        out.append((i, j))
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(d1) and b < len(d2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (d1[a] + d2[b], a, b))
    return out


def cells_of(u: np.ndarray, books: tuple[np.ndarray, np.ndarray], probes: int = PROBES) -> np.ndarray:
    """(rows, probes): the nearest cells of each unit vector, nearest first."""
    half = u.shape[1] // 2
    near, dist = [], []
    for x, c in zip((u[:, :half], u[:, half:]), books, strict=True):
        d = (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T
        t = min(probes, len(c))
        i = np.argpartition(d, t - 1, axis=1)[:, :t]
        v = np.take_along_axis(d, i, 1)
        o = v.argsort(1, kind="stable")
        near.append(np.take_along_axis(i, o, 1))
        dist.append(np.take_along_axis(v, o, 1))
    k = len(books[1])
    out = np.empty((len(u), probes), np.int64)
    a, b = near
    for r, (x, y) in enumerate(zip(dist[0].tolist(), dist[1].tolist(), strict=True)):
        pairs = multi_sequence(x, y, probes)
        pairs += pairs[:1] * (probes - len(pairs))
        out[r] = [a[r, i] * k + b[r, j] for i, j in pairs]
    return out


def cell_loads(vecs: DataFrame, books, cells: int, probes: int) -> np.ndarray:
    """How many vectors stand in each cell: counted over all rows, one array of ``cells`` numbers per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(cells, np.int64)
        for batch in batches:
            if batch.num_rows:
                of = np.sort(cells_of(unit(matrix(batch.column(1))), books.value, probes), axis=1)
                once = np.c_[np.ones(len(of), bool), of[:, 1:] != of[:, :-1]]
                n += np.bincount(of[once], minlength=cells)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["cell", "n"])

    got = vecs.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def best_in_block(ids: np.ndarray, u: np.ndarray, other_ids: np.ndarray, other: np.ndarray, threshold: float, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, neighbour, cosine) of the ``top`` best of ``other`` for each row, cosine at least ``threshold``, ties to the smaller id.

    ``other`` ascends by id.
    """
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(u), 512):
        s = np.round(u[a : a + 512] @ other.T, ROUND)
        s[ids[a : a + 512, None] == other_ids[None, :]] = -2.0
        rows = np.flatnonzero(s.max(1) >= threshold) if s.shape[1] else np.zeros(0, int)
        s = s[rows]
        if not len(rows):
            continue
        if s.shape[1] > top:
            edge = np.partition(s, s.shape[1] - top, axis=1)[:, s.shape[1] - top]  # the top-th best value
            keep = s >= np.maximum(edge, threshold)[:, None]
        else:
            keep = s >= threshold
        r, c = np.nonzero(keep)  # by row, then by id
        v = s[r, c]
        o = np.lexsort((c, -v, r))
        r, c, v = r[o], c[o], v[o]
        rank = np.arange(len(r)) - np.r_[0, np.flatnonzero(np.diff(r)) + 1][np.cumsum(np.r_[0, np.diff(r) != 0])] if len(r) else r
        fine = rank < top
        got.append((ids[a + rows[r[fine]]], other_ids[c[fine]], v[fine]))
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def _search(threshold: float, top: int):
    """Rows sorted by key (cell and pair of blocks), side; a key is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        current = None

        def found() -> pa.RecordBatch:
            ids, side, raw = (np.concatenate(x) for x in zip(*held, strict=True))
            o = np.argsort(ids, kind="stable")
            ids, side, u = ids[o], side[o], unit(raw[o])
            if (side == 2).all():
                parts = [best_in_block(ids, u, ids, u, threshold, top)]
            else:
                a, b = side == 0, side == 1
                parts = [best_in_block(ids[a], u[a], ids[b], u[b], threshold, top), best_in_block(ids[b], u[b], ids[a], u[a], threshold, top)]
            i, j, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(c, pa.float64())], names=["id", "other", "cosine"])

        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            side, ids, raw = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), unpack(batch.column(3))
            cuts = np.flatnonzero(np.diff(k)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(k)], strict=True):
                if hi == lo:
                    continue
                if current is not None and k[lo] != current:
                    yield found()
                    held = []
                current = k[lo]
                held.append((ids[lo:hi], side[lo:hi], raw[lo:hi]))
        if held:
            yield found()

    return run


def neighbours(memories: DataFrame, top: int = TOP, threshold: float = THRESHOLD, probes: int = PROBES) -> DataFrame:
    """(id, other, cosine, rank): for every comparable vector its ``top`` most similar others of at least ``threshold``.

    Every row is indexed; a pair is found if the two share one of their ``probes`` nearest cells.  Ties go to the smaller
    id; equal embeddings are neighbours of cosine 1.  Embeddings that are null, empty, all-zero, of another dimension or
    with NaN have and are no neighbours; extra columns are ignored; an empty table gives an empty result.
    """
    spark = memories.sparkSession
    vecs = vectors(memories)
    n = vecs.count()
    sample = bounded_sample(vecs, n_rows=n)
    if not len(sample):
        return spark.createDataFrame([], "id long, other long, cosine double, rank int")
    k = centroids_per_half(n)
    books = spark.sparkContext.broadcast(tuple(codebook(h, k, seed=11 + s) for s, h in enumerate((sample[:, : DIM // 2], sample[:, DIM // 2 :]))))

    # cells of more than CELL_ROWS rows are cut into blocks that meet pairwise
    load = cell_loads(vecs, books, k * k, probes)
    shared = spark.sparkContext.broadcast({int(c): int(-(-load[c] // CELL_ROWS)) for c in np.flatnonzero(load > CELL_ROWS)})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, side, id, vec): side 2 where a cell is one block, else 0 and 1 for the two blocks that meet."""
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, raw = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
            cells = cells_of(unit(raw), books.value, probes)
            row, key, side = [], [], []
            first = np.ones(cells.shape, bool)
            for p in range(1, cells.shape[1]):
                first[:, p] = (cells[:, :p] != cells[:, p : p + 1]).all(1)
            r, p = np.nonzero(first)
            c = cells[r, p]
            big = np.isin(c, list(shared.value)) if shared.value else np.zeros(len(c), bool)
            row.append(r[~big])
            key.append(c[~big] << CELL_SHIFT)
            side.append(np.full((~big).sum(), 2, np.int8))
            for x, cell in zip(r[big].tolist(), c[big].tolist(), strict=True):
                m = shared.value[cell]
                b = int(ids[x] * 2654435761 % 4294967296) % m
                for y in range(m):
                    row.append(np.array([x]))
                    key.append(np.array([(cell << CELL_SHIFT) | (min(b, y) << BLOCK_BITS) | max(b, y)]))
                    side.append(np.array([2 if b == y else 0 if b < y else 1], np.int8))
            row, key, side = np.concatenate(row), np.concatenate(key), np.concatenate(side)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side), pa.array(ids[row]), pack(raw[row])], names=["key", "side", "id", "vec"])

    placed = vecs.mapInArrow(place, "key long, side byte, id long, vec binary")
    hits = placed.repartition(tasks_for(n * probes), "key").sortWithinPartitions("key").mapInArrow(_search(threshold, top), "id long, other long, cosine double")
    ranked = hits.groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    return ranked.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("cosine"), "other"))).where(F.col("rank") <= top)


def pairs(found: DataFrame) -> DataFrame:
    """The unordered pairs of ``neighbours``."""
    return found.select(F.least("id", "other").alias("lo_id"), F.greatest("id", "other").alias("hi_id")).distinct()


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return pairs(neighbours(table(spark, root, "memories")))


def p6_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The ``TOP`` most similar others of every comparable vector, however weak, by exact search.

    Weak neighbours seldom share a cell: by 6 cells recall at 5 is 0.829 on 10,000 rows, by 16, which is more work than all pairs, 0.977.
    """
    rows = vectors(table(spark, root, "memories")).select("id", F.col("embedding").alias("vec"))
    return nearest(rows, DIM, TOP).select("id", "rank", "other", F.round("sim", 6).alias("cosine"))


ORACLE: dict = {}
QUERIES = {"p6_found": p6_found, "p6_neighbours": p6_neighbours}
