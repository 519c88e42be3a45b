"""Random-hyperplane LSH: approximate cosine search with exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.operators.search import _matrix


def plane(table_no: int, bit: int, dim: int) -> list[float]:
    """A hyperplane of +1 and -1 by a hash, the same in every engine."""
    return [1.0 if int(hashlib.md5(f"{table_no}:{bit}:{i}".encode()).hexdigest()[:2], 16) % 2 else -1.0 for i in range(1, dim + 1)]


def signature(vec: Column, table_no: int, bits: int, dim: int) -> Column:
    """The bucket of a vector: one bit per hyperplane."""
    out = F.lit(0)
    for b in range(bits):
        side = F.aggregate(F.zip_with(vec, F.array(*[F.lit(x) for x in plane(table_no, b, dim)]), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
        out = out + F.when(side >= 0, 1 << b).otherwise(0)
    return out


def _sides(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """(rows, tables, bits): on which side of each hyperplane, and how far from it, as ``signature`` has it."""
    planes = np.array([[plane(t, b, x.shape[1]) for b in range(bits)] for t in range(tables)])
    return np.einsum("nd,tbd->ntb", x, planes, optimize=True)


def _probed(sides: np.ndarray, probes: int) -> np.ndarray:
    """(rows, tables, probes): the own bucket and those beside it, by one bit or two, whose hyperplanes are nearest."""
    bits = sides.shape[2]
    own = ((sides >= 0) << np.arange(bits)).sum(2)
    flips = np.array([m for m in range(1 << bits) if m.bit_count() <= 2])
    cost = (sides * sides) @ ((flips[:, None] >> np.arange(bits)) & 1).T
    return own[:, :, None] ^ flips[np.argsort(cost, axis=2, kind="stable")[:, :, :probes]]


def approximate_top_k(queries: DataFrame, corpus: DataFrame, k: int, dim: int, tables: int = 6, bits: int = 6, probes: int = 12) -> DataFrame:
    """(query_id, id, sim, rank) among the rows in one of the ``probes`` buckets that the query looks at in each of the
    tables; cosine exact, ties to the smaller id.

    Rows go to one bucket per table and queries to ``probes``; a bucket keeps the best k of each query, so no pair is shuffled.
    """

    def place(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                at = _probed(_sides(_matrix(batch.column(1), dim), tables, bits), probes if query else 1)
                key = (at + (np.arange(tables) << bits)[None, :, None]).reshape(len(at), -1)
                row = pa.array(np.repeat(np.arange(len(at)), key.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.full(key.size, not query)), batch.column(0).take(row), batch.column(1).take(row)], names=["key", "row", "id", "vec"])

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by key, queries first: the queries of one bucket are held, its rows pass by."""
        current, held, best = None, [], None

        def found() -> Iterator[pa.RecordBatch]:
            if best is not None:
                r, c = np.nonzero(best[2] > -1.5)
                yield pa.RecordBatch.from_arrays([pa.array(best[0][r]), pa.array(best[3][r, c]), pa.array(best[2][r, c])], names=["query_id", "id", "sim"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, rows, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            x = _matrix(batch.column(3), dim)
            cuts = np.flatnonzero((np.diff(keys) != 0) | (rows[1:] != rows[:-1])) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(keys)], strict=True):
                if keys[lo] != current:
                    yield from found()
                    current, held, best = keys[lo], [], None
                if not rows[lo]:
                    held.append((ids[lo:hi], x[lo:hi]))
                    continue
                if best is None:
                    if not held:
                        continue
                    q, v = (np.concatenate(c) for c in zip(*held, strict=True))
                    best = (q, v, np.full((len(q), k), -2.0), np.zeros((len(q), k), np.int64))
                q, v, best_s, best_i = best
                for a in range(0, len(q), 512):
                    s = np.round(v[a : a + 512] @ x[lo:hi].T, 6)
                    s[q[a : a + 512, None] == ids[None, lo:hi]] = -2.0
                    s = np.concatenate([best_s[a : a + 512], s], axis=1)
                    i = np.concatenate([best_i[a : a + 512], np.broadcast_to(ids[lo:hi], (len(s), hi - lo))], axis=1)
                    o = np.lexsort((i, -s), axis=1)[:, :k]
                    best_s[a : a + 512], best_i[a : a + 512] = np.take_along_axis(s, o, 1), np.take_along_axis(i, o, 1)
        yield from found()

    schema = "key long, row boolean, id long, vec array<float>"
    typed = lambda df: df.select("id", F.col("vec").cast("array<float>"))
    placed = typed(queries).mapInArrow(place(True), schema).unionByName(typed(corpus).mapInArrow(place(False), schema))
    hits = placed.repartition("key").sortWithinPartitions("key", "row").mapInArrow(search, "query_id long, id long, sim double").distinct()
    w = W.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
