"""Exact top-k cosine search of a set of queries over a collection, in blocks.

Queries are handed out in blocks of at most ``BLOCK`` vectors, one broadcast and one scan of the collection each, whatever
their number; the collection comes in as many partitions as tasks run at once, each is multiplied with ``PART`` of them at
once and keeps its best k per query, so that k rows per query and partition are shuffled and no pair is.

Self-joins by similarity (``similar_links``, ``similar_groups``, ``similar_counts``, ``nearest``) compare every pair of rows: hashed
blocks of the collection meet pairwise, one task per pair of blocks.  No index and no cap leaves a pair out, so the work
grows with the square of the rows; what is shuffled is each row once per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.operators.skew import by_slots

BLOCK, PART = 1 << 16, 2048
#: Rows of a block of a self-join, and rows of it that are multiplied at once.
JOIN_ROWS, JOIN_CHUNK = 16_384, 512


def usable(rows: DataFrame, id_col: str, vec_col: str, dim: int, *keep: str) -> DataFrame:
    """id, vec (and ``keep``) of the rows whose vector has ``dim`` numbers, is finite and not zero."""
    v = F.col(vec_col)
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.where(F.col(id_col).isNotNull() & (F.size(v) == dim) & (square > 0) & (square < float("inf"))).select(F.col(id_col).alias("id"), v.alias("vec"), *keep)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(1))[:, None]


def top_k(queries: DataFrame, corpus: DataFrame, k: int, dim: int, exclude_self: bool = True, least: float | None = None, decimals: int = 6, block: int = BLOCK) -> DataFrame:
    """(query_id, id, sim, rank): the k most similar rows of ``corpus`` (id, vec) for each row of ``queries`` (id, vec).

    Similarities are rounded to ``decimals`` and ties go to the smaller id; ``least`` leaves weaker ones out.
    """
    spark = corpus.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // block))
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        got = part.toArrow().combine_chunks()
        if not got.num_rows:
            continue
        vecs = got.column("vec")
        vecs = vecs.chunk(0) if isinstance(vecs, pa.ChunkedArray) else vecs
        shared = spark.sparkContext.broadcast((np.array(got.column("id").to_pylist(), dtype=np.int64), _matrix(vecs, dim)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value
            low, weakest = q.astype(np.float32), -1.5 if least is None else least - 1e-12
            room = 10.0**-decimals + 2.5e-7 * dim  # for rounding and the error of single precision
            best_s, best_i = np.full((len(qid), k), -2.0), np.zeros((len(qid), k), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), dim)
                low_x = x.astype(np.float32).T
                for lo in range(0, len(qid), PART):
                    some, part_s, part_i = qid[lo : lo + PART], best_s[lo : lo + PART], best_i[lo : lo + PART]
                    s = low[lo : lo + PART] @ low_x
                    if exclude_self:
                        own = np.flatnonzero(np.isin(ids, some))
                        r, c = np.nonzero(some[:, None] == ids[own][None, :])
                        s[r, own[c]] = -2.0
                    edge = np.maximum(np.maximum(_bound_of_rows(s, k, max(64, k)), part_s[:, -1]), weakest) - room
                    i, j = np.nonzero(s >= np.maximum(edge, -1.5).astype(np.float32)[:, None])
                    _take(part_s, part_i, ids, q[lo : lo + PART], x, i, j, decimals)
            r, c = np.nonzero(best_s > weakest)
            yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(best_i[r, c]), pa.array(best_s[r, c])], names=["query_id", "id", "sim"])

        hits = by_slots(corpus.select("id", "vec")).mapInArrow(run, "query_id long, id long, sim double")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = spark.createDataFrame([], "query_id long, id long, sim double")
    w = W.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the components of ``a`` and ``b``, pair by pair, in place; ``root`` is the smallest index of a component."""
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root[:] = up


def _self_join(rows: DataFrame, dim: int, block: int, meet, schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every pair of ``rows`` (id, vec; ids unique) passes ``meet`` once.

    ``meet(ids, a, b)`` gets the ids and unit vectors of two blocks that meet, ids of ``a`` first, or of one that meets
    itself (``b`` is None), and yields arrays of ``schema``.  The columns ``carry`` (long) follow as further arrays.
    """
    m = max(1, -(-rows.count() // block))
    own, y = F.pmod(F.xxhash64("id"), F.lit(m)), F.col("_y")
    placed = rows.select("id", "vec", *carry, own.alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("_y"))
    placed = placed.select((F.least("_b", y) * m + F.greatest("_b", y)).alias("key"), (F.col("_b") <= y).alias("left"), (F.col("_b") == y).alias("alone"), "id", "vec", *carry)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None

        def met() -> Iterator[pa.RecordBatch]:
            left, alone, x, *of_rows = (np.concatenate(c) for c in zip(*held, strict=True))
            if not alone[0]:
                of_rows = [np.concatenate([c[left], c[~left]]) for c in of_rows]
            for got in meet(of_rows[0], *((x, None) if alone[0] else (x[left], x[~left])), *of_rows[1:]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=names)

        for batch in batches:  # sorted by key: two blocks are held at a time
            if not batch.num_rows:
                continue
            key, left, alone, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            x = _matrix(batch.column(4), dim)
            more = [batch.column(5 + c).to_numpy(zero_copy_only=False) for c in range(len(carry))]
            cuts = np.flatnonzero(np.diff(key)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(key)], strict=True):
                if current is not None and key[lo] != current:
                    yield from met()
                    held = []
                current = key[lo]
                held.append(tuple(c[lo:hi] for c in (left, alone, x, ids, *more)))
        if held:
            yield from met()

    return placed.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def _hits(a: np.ndarray, b: np.ndarray | None, least: float, decimals: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, sim) of the pairs of at least ``least``, in parts; rows of ``b`` are numbered after those of ``a``."""
    for lo in range(0, len(a), JOIN_CHUNK):
        other = a[lo:] if b is None else b
        s = a[lo : lo + JOIN_CHUNK] @ other.T
        i, j = np.nonzero(s >= least - 10.0**-decimals)
        v = np.round(s[i, j], decimals)
        fine = v >= least - 1e-12
        if b is None:
            fine &= i < j
        yield i[fine] + lo, j[fine] + (lo if b is None else len(a)), v[fine]


def similar_links(rows: DataFrame, dim: int, least: float, carry: tuple[str, ...] = (), decimals: int = 6, block: int = JOIN_ROWS) -> DataFrame:
    """(a, b, sim): each unordered pair of ``rows`` with a similarity of at least ``least``, a < b.

    For each column of ``carry`` (long, not null) the pair has its value at both ends, as a_name and b_name, without a join.
    """

    def meet(ids, x, y, *more):
        for i, j, v in _hits(x, y, least, decimals):
            turn = ids[i] > ids[j]
            i, j = np.where(turn, j, i), np.where(turn, i, j)
            yield ids[i], ids[j], v, *(c[e] for c in more for e in (i, j))

    ends = "".join(f", {e}_{c} long" for c in carry for e in "ab")
    return _self_join(rows, dim, block, meet, "a long, b long, sim double" + ends, carry)


def similar_groups(rows: DataFrame, dim: int, least: float, decimals: int = 6, block: int = JOIN_ROWS) -> DataFrame:
    """(a, b): links that join the same rows into groups as all pairs of at least ``least`` do.

    Two blocks that meet give one link per row at most, to the first row of its group there, however many pairs there are.
    """

    def meet(ids, x, y):
        root = np.arange(len(ids))
        for i, j, _ in _hits(x, y, least, decimals):
            _merge(root, i, j)
        far = root != np.arange(len(ids))
        yield ids[far], ids[root[far]]

    return _self_join(rows, dim, block, meet, "a long, b long")


def similar_counts(rows: DataFrame, dim: int, least: float, decimals: int = 6, block: int = JOIN_ROWS) -> DataFrame:
    """(id, n, least): how many others each row has at ``least`` or more, and the weakest of them; rows without are left out."""

    def meet(ids, x, y):
        n, low = np.zeros(len(ids), np.int64), np.full(len(ids), np.inf)
        for i, j, v in _hits(x, y, least, decimals):
            for end in (i, j):
                n += np.bincount(end, minlength=len(ids))
                np.minimum.at(low, end, v)
        some = n > 0
        yield ids[some], n[some], low[some]

    found = _self_join(rows, dim, block, meet, "id long, n long, least double")
    return found.groupBy("id").agg(F.sum("n").alias("n"), F.min("least").alias("least"))


def _bound(s: np.ndarray, k: int, groups: int = 64) -> np.ndarray:
    """A value that at least ``k`` numbers of each column of ``s`` reach, near to the k-th best: from the best of 64 groups."""
    wide = len(s) // groups
    if k > groups or not wide:
        return np.full(s.shape[1], -2.0, s.dtype)
    best = s[: wide * groups].reshape(wide, groups, -1).max(0)
    return np.partition(best, groups - k, axis=0)[groups - k]


def _bound_of_rows(s: np.ndarray, k: int, groups: int = 64) -> np.ndarray:
    wide = s.shape[1] // groups
    if k > groups or not wide:
        return np.full(len(s), -2.0, s.dtype)
    best = s[:, : wide * groups].reshape(len(s), groups, wide).max(2)
    return np.partition(best, groups - k, axis=1)[:, groups - k]


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, decimals: int, part: int = 1 << 16) -> np.ndarray:
    """Rounded products of rows ``i`` of ``x`` and ``j`` of ``y`` in double precision."""
    out = np.empty(len(i))
    for lo in range(0, len(i), part):
        out[lo : lo + part] = np.einsum("ij,ij->i", x[i[lo : lo + part]], y[j[lo : lo + part]])
    return np.round(out, decimals)


def _take(best_s: np.ndarray, best_i: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, decimals: int) -> None:
    """Merge the candidates ``j`` (rows of ``y``) of the rows ``i`` of ``x`` into the rows' best, in place."""
    k = best_s.shape[1]
    touched, row = np.unique(i, return_inverse=True)
    if not len(touched):
        return
    row = np.concatenate([row, np.repeat(np.arange(len(touched)), k)])
    v = np.concatenate([_exact(x, y, i, j, decimals), best_s[touched].ravel()])
    other = np.concatenate([ids[j], best_i[touched].ravel()])
    o = np.lexsort((other, -v, row))
    row, v, other = row[o], v[o], other[o]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    fine = rank < k
    best_s[touched[row[fine]], rank[fine]] = v[fine]
    best_i[touched[row[fine]], rank[fine]] = other[fine]


def offer(best_s: np.ndarray, best_i: np.ndarray, s: np.ndarray, ids: np.ndarray, decimals: int | None = None) -> None:
    """Merge the scores ``s`` (queries, rows; 0 is no hit) of the rows ``ids`` into each query's best, in place; ties to the smaller id.

    ``best_s`` begins with zeros.  With ``decimals`` the scores count as rounded; only those that may enter are.
    """
    k, last, last_i = best_s.shape[1], best_s[:, -1:], best_i[:, -1:]
    if decimals is not None:
        fine = s > np.maximum(last - 10.0**-decimals, 0)
    else:
        fine = s > last
        if ids.min() < last_i.max():
            fine |= (s == last) & (ids[None, :] < last_i)
    i, j = np.nonzero(fine)
    if not len(i):
        return
    touched, row = np.unique(i, return_inverse=True)
    row = np.concatenate([row, np.repeat(np.arange(len(touched)), k)])
    v = np.concatenate([s[i, j] if decimals is None else np.round(s[i, j], decimals), best_s[touched].ravel()])
    other = np.concatenate([ids[j], best_i[touched].ravel()])
    o = np.lexsort((other, -v.astype(np.float64), row))
    row, v, other = row[o], v[o], other[o]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    fine = rank < k
    best_s[touched[row[fine]], rank[fine]] = v[fine]
    best_i[touched[row[fine]], rank[fine]] = other[fine]


def nearest(rows: DataFrame, dim: int, k: int, decimals: int = 12, block: int = JOIN_ROWS) -> DataFrame:
    """(id, other, sim, rank): for every row of ``rows`` (id, vec) the k most similar others, exactly; ties to the smaller id.

    Candidates are screened in single precision with room for its error and computed again in double.
    """

    def meet(ids, a, b):
        x = a if b is None else np.concatenate([a, b])
        n, from_b = len(a), 0 if b is None else len(a)
        low, other = x[:n].astype(np.float32), x[from_b:].astype(np.float32).T
        best_s, best_i = np.full((len(ids), k), -2.0), np.zeros((len(ids), k), np.int64)
        for lo in range(0, n, JOIN_CHUNK):
            s = low[lo : lo + JOIN_CHUNK] @ other
            if b is None:
                s[np.arange(len(s)), lo + np.arange(len(s))] = -2.0
            least = np.maximum(np.maximum(_bound_of_rows(s, k), best_s[lo : lo + len(s), -1]), -1.5).astype(np.float32) - np.float32(1e-5)
            i, j = np.nonzero(s >= least[:, None])
            _take(best_s, best_i, ids, x, x, i + lo, j + from_b, decimals)
            if b is not None:
                least = np.maximum(np.maximum(_bound(s, k), best_s[n:, -1]), -1.5).astype(np.float32) - np.float32(1e-5)
                i, j = np.nonzero(s >= least[None, :])
                _take(best_s, best_i, ids, x, x, j + from_b, i + lo, decimals)
        r, c = np.nonzero(best_s > -1.5)
        yield ids[r], best_i[r, c], best_s[r, c]

    found = _self_join(rows, dim, block, meet, "id long, other long, sim double")
    w = W.partitionBy("id").orderBy(F.desc("sim"), "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
