"""Associative retrieval from a store of patterns, for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2048


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _step(patterns: DataFrame, x: np.ndarray, dim: int, beta: float) -> tuple[np.ndarray, ...]:
    """One update of the states ``x``: (new states, best pattern, its weight, entropy).

    Cosines are at most 1, so that every partition can weigh with exp(beta * (cosine - 1)) and partial sums add up.
    """
    shared = patterns.sparkSession.sparkContext.broadcast(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        n = len(q)
        z, t, v, top, best = np.zeros(n), np.zeros(n), np.zeros((n, dim)), np.full(n, -2.0), np.full(n, -1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, p = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), dim)
            order = np.argsort(ids, kind="stable")
            ids, p = ids[order], p[order]
            s = q @ p.T
            w = np.exp(beta * (s - 1))
            z += w.sum(1)
            t += (w * beta * (s - 1)).sum(1)
            v += w @ p
            r = np.round(s, 9)
            at = r.argmax(1)
            here = r[np.arange(n), at]
            better = (here > top) | ((here == top) & (ids[at] < best))
            top, best = np.where(better, here, top), np.where(better, ids[at], best)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(z), pa.array(t), pa.array(list(v), pa.list_(pa.float64())), pa.array(top), pa.array(best)], names=["q", "z", "t", "v", "top", "best"])

    part = patterns.select("id", "vec").mapInArrow(run, "q long, z double, t double, v array<double>, top double, best long")
    some = F.when(F.col("best") >= 0, F.struct("top", (-F.col("best")).alias("b")))
    got = part.groupBy("q").agg(F.sum("z").alias("z"), F.sum("t").alias("t"), F.array(*[F.sum(F.element_at("v", i + 1)) for i in range(dim)]).alias("v"), F.max(some).alias("m"))
    rows = got.select("q", "z", "t", "v", "m.top", (-F.col("m.b")).alias("best")).orderBy("q").toArrow()
    z, t, top = (rows.column(c).to_numpy() for c in ("z", "t", "top"))
    new = np.array(rows.column("v").to_pylist()) / z[:, None]
    return new / np.sqrt((new * new).sum(1))[:, None], rows.column("best").to_numpy(), np.exp(beta * (top - 1)) / z, np.log(z) - t / z


def retrieve(patterns: DataFrame, queries: DataFrame, dim: int = 64, beta: float = 20.0, steps: int = 10, tolerance: float = 1e-4, block: int = BLOCK) -> DataFrame:
    """(query_id, id, confidence, entropy, steps): the pattern that each query settles on.

    patterns and queries: id, vec (comparable vectors).  A state becomes the mean of the patterns, weighed with the softmax
    of ``beta`` times their cosine, until it moves by less than ``tolerance`` or ``steps`` are done.  confidence is the
    weight of the nearest pattern (ties: smaller id), entropy that of all weights.  Queries go through the store in
    blocks, one broadcast and one scan a step; only sums over the store come back.  No pattern, no row.
    """
    spark = patterns.sparkSession
    schema = "query_id long, id long, confidence double, entropy double, steps long"
    if not patterns.limit(1).count():
        return spark.createDataFrame([], schema)
    out, blocks = [], max(1, -(-queries.count() // block))
    for b in range(blocks):
        got = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "vec").toArrow().combine_chunks()
        if not got.num_rows:
            continue
        ids = got.column("id").to_numpy()
        x = _matrix(got.column("vec").chunk(0), dim)
        done = np.zeros(len(ids), np.int64)
        best = conf = ent = None
        for s in range(1, steps + 1):
            new, best, conf, ent = _step(patterns, x, dim, beta)
            moved = np.sqrt(((new - x) ** 2).sum(1))
            done[(done == 0) & (moved < tolerance)] = s
            x = np.where((done > 0)[:, None] & (done != s)[:, None], x, new)
            if (done > 0).all():
                break
        done[done == 0] = steps
        out.append(pa.table({"query_id": ids, "id": best, "confidence": np.round(conf, 6), "entropy": np.round(ent, 6), "steps": done}))
    return spark.createDataFrame(pa.concat_tables(out).to_pandas(), schema) if out else spark.createDataFrame([], schema)
