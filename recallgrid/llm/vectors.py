"""What the vector operators share: vectors out of Arrow batches, bounded samples, exact thresholds, salted blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.sources.tables import usable_vectors

DIM = 64
SAMPLE = 8192
#: Rows with a vector that one task of a shuffle gets.
TASK_ROWS = 50_000
#: Cosines this near to a threshold are computed again in double precision.
NEAR = 1e-5


def matrix(column: pa.Array, dim: int = DIM) -> np.ndarray:
    """The vectors of a list column, all of ``dim`` numbers, as float32."""
    flat = column.flatten() if isinstance(column, pa.ListArray | pa.LargeListArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def pack(x: np.ndarray) -> pa.Array:
    """float32 rows as binary."""
    x = np.ascontiguousarray(x, dtype=np.float32)
    width = x.shape[1] * 4
    offsets = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.tobytes())])


def unpack(column: pa.Array, dim: int = DIM) -> np.ndarray:
    if not len(column):
        return np.zeros((0, dim), np.float32)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dim)


def vectors(memories: DataFrame, dim: int = DIM) -> DataFrame:
    """id and embedding of the comparable rows; of a repeated id only the rows themselves tell, so ids must be unique."""
    return usable_vectors(memories, dim)


def tasks_for(rows: int) -> int:
    """Tasks for a shuffle of so many rows with a vector each: ``TASK_ROWS`` a task, at least four."""
    return max(4, -(-rows // TASK_ROWS))


def bounded_sample(vecs: DataFrame, size: int = SAMPLE, n_rows: int | None = None) -> np.ndarray:
    """At most ``size`` of the vectors, those with the least hashes of their ids, as unit rows.

    n_rows: how many vectors there are.  Then each partition hands over its share only: rows beyond twice the hash that
    ``size`` rows are expected to stay below are left out at once.
    """
    rows = vecs.select("id", "embedding", F.xxhash64("id", F.lit("sample")).alias("h"))
    if n_rows and n_rows > 4 * size:
        rows = rows.where(F.col("h") < -(1 << 63) + int((1 << 64) * (2 * size / n_rows)))
    got = rows.orderBy("h", "id").limit(size).select("embedding").toArrow()
    return unit(matrix(got.column(0))) if got.num_rows else np.zeros((0, DIM))


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of unit ``a`` and ``b`` have a cosine of at least ``threshold``: screened in float32, exact at the edge."""
    s = a.astype(np.float32) @ b.astype(np.float32).T
    ok = s >= threshold
    i, j = np.nonzero(np.abs(s - threshold) < NEAR)
    if len(i):
        ok[i, j] = (a[i].astype(np.float64) * b[j]).sum(1) >= threshold
    return ok


def leaders(x: np.ndarray, threshold: float, chunk: int = 1024) -> np.ndarray:
    """For each row the row that leads it: the first leader before it within ``threshold``, or itself.

    Work and memory are rows times leaders, not pairs: a block of mutually similar rows has one leader.
    """
    return leading(x, threshold, chunk)[0]


def leading(x: np.ndarray, threshold: float, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``leaders`` and (row, leader) of every further leader within ``threshold`` of a row.

    Rows that two leaders share are what joins the groups of similar rows that overlap.
    """
    n = len(x)
    lead = np.arange(n)
    heads = np.zeros(0, np.int64)
    rows, others = [], []
    for a in range(0, n, chunk):
        part = x[a : a + chunk]
        rest = np.arange(len(part))
        if len(heads):
            ok = similar(part, x[heads], threshold)
            hit = ok.any(1)
            lead[a + np.flatnonzero(hit)] = heads[ok[hit].argmax(1)]
            r, h = np.nonzero(ok)
            rows.append(a + r)
            others.append(heads[h])
            rest = np.flatnonzero(~hit)
        ok = similar(part, part[rest], threshold) if len(rest) else np.zeros((len(part), 0), bool)
        free = np.ones(len(rest), bool)
        new = []
        for q in range(len(rest)):
            if free[q]:
                mine = ok[rest, q] & free
                lead[a + rest[mine]] = a + rest[q]
                free &= ~mine
                free[q] = False
                lead[a + rest[q]] = a + rest[q]
                new.append(q)
        if new:
            r, q = np.nonzero(ok[:, new])
            rows.append(a + r)
            others.append(a + rest[np.array(new)][q])
            heads = np.concatenate([heads, a + rest[np.array(new)]])
    r, h = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows, others))
    more = (h != lead[r]) & (h != r)
    return lead, r[more], h[more]
