"""Exact links of every row to its nearest above a threshold, without a shuffle of pairs or a product of all rows.

Rows are placed by cells of landmarks into blocks; a block's rows form groups around a mean, whose radius is known.  Two
groups can hold a pair of the threshold only if their means are as near as the threshold's angle and both radii allow,
so that means are multiplied with means, and rows only where that says so.  No row or pair is left out: landmarks and
groups decide what is multiplied, never what is found.

The blocks are files beside the checkpoints.  One task per block has its rows' best and reads all blocks, one at a time:
neither candidates nor copies of rows are shuffled or broadcast.  Time still grows with the square of the groups.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.operators.search import _bound_of_rows, _exact, _matrix
from recallgrid.operators.skew import checkpoint_folder

#: Rows of a block, as many at least, blocks of fewer rows up to then, and landmarks at most.
ROWS, LEAST_ROWS, TASKS, LANDMARKS = 32_768, 2048, 24, 4096
#: Cosine to a group's first row, and radius (of an angle) beyond which a row leaves a group of several.
JOIN, RADIUS = 0.9, np.deg2rad(15)
#: Means that are multiplied at once; pairs of rows above which two groups are multiplied as matrices; pairs that are picked at once.
TILE, WIDE, DENSE, PAIRS = 512, 2048, 4096, 1 << 18
ROOM = 1e-5  # for the error of single precision


def _groups(x: np.ndarray) -> np.ndarray:
    """A group number for each of the unit vectors ``x``: rows around the first of them, loose ones alone."""
    own, first = np.empty(len(x), np.int64), np.empty((0, x.shape[1]), x.dtype)
    for lo in range(0, len(x), 1024):
        b = x[lo : lo + 1024]
        got = np.full(len(b), -1)
        if len(first):
            s = b @ first.T
            best = s.argmax(1)
            got = np.where(s[np.arange(len(b)), best] >= JOIN, best, -1)
        rest = np.flatnonzero(got < 0)
        s, new = b[rest] @ b[rest].T >= JOIN, []
        for i in range(len(rest)):
            if got[rest[i]] < 0:
                free = rest[s[i]]
                got[free[got[free] < 0]] = len(first) + len(new)
                new.append(rest[i])
        own[lo : lo + 1024] = got
        first = np.concatenate([first, b[new]])
    order = np.argsort(own, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(own[order]) > 0]) if len(x) else np.empty(0, int)
    mean = np.add.reduceat(x[order], starts, 0) if len(x) else first
    mean /= np.maximum(np.linalg.norm(mean, axis=1), 1e-9)[:, None]
    at = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(x)]))
    loose = np.einsum("ij,ij->i", x[order], mean[at]) < np.cos(RADIUS)
    own[order] = np.where(loose, len(starts) + np.arange(len(x)), at)
    return np.unique(own, return_inverse=True)[1]


def _raw(column: pa.ChunkedArray, dim: int, kind: str) -> np.ndarray:
    """The vectors of a binary column without nulls."""
    parts = [np.frombuffer(c.buffers()[2], kind, len(c) * dim, np.frombuffer(c.buffers()[1], np.int32, 1, 4 * c.offset)[0]) for c in column.chunks if len(c)]
    return (np.concatenate(parts) if parts else np.empty(0, kind)).reshape(-1, dim)


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.sqrt((x * x).sum(1))[:, None]
    return x


class Block:
    """Rows (ids, carried, unit vectors) by group, the groups by radius."""

    def __init__(self, table: pa.Table, dim: int, kind: str):
        ids, carried, group = (table.column(c).to_numpy() for c in ("id", "carried", "grp"))
        order = np.lexsort((ids, group))
        ids, carried, group, x = ids[order], carried[order], group[order], _unit(_raw(table.column("vec"), dim, kind)[order])
        starts = np.flatnonzero(np.r_[True, np.diff(group) != 0])
        n = np.diff(np.r_[starts, len(ids)])
        mean = np.add.reduceat(x, starts, 0)
        mean /= np.maximum(np.linalg.norm(mean, axis=1), 1e-9)[:, None]
        cos = np.minimum.reduceat(np.einsum("ij,ij->i", x, np.repeat(mean, n, 0)), starts)
        radius = np.where(n > 1, np.arccos(np.clip(cos, -1, 1)) + 1e-6, 0.0)
        mean[n == 1] = x[starts[n == 1]]
        by = np.argsort(radius, kind="stable")
        self.ids, self.carried, self.x, self.low = ids, carried, x, x.astype(np.float32)
        self.start, self.n, self.radius, self.mean = starts[by], n[by], radius[by], np.ascontiguousarray(mean[by], np.float32)


def _near_groups(a: Block, b: Block, angle: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of ``a`` and ``b`` that may hold a pair within ``angle``."""
    edge = lambda r: np.where(r < np.pi, np.cos(np.minimum(r, np.pi)) - ROOM, -2.0).astype(np.float32)
    out = np.empty((TILE, WIDE), np.float32)
    turned = [np.ascontiguousarray(b.mean[c : c + WIDE].T) for c in range(0, len(b.n), WIDE)]
    for lo in range(0, len(a.n), TILE):
        part, far = a.mean[lo : lo + TILE], a.radius[lo : lo + TILE].max()
        for k, y in enumerate(turned):
            s = out[: len(part), : y.shape[1]] if y.shape[1] == WIDE else np.empty((len(part), y.shape[1]), np.float32)
            np.matmul(part, y, out=s)
            g, h = np.divmod(np.flatnonzero(s >= edge(angle + far + b.radius[k * WIDE : k * WIDE + WIDE])[None, :]), y.shape[1])
            if len(g):
                fine = s[g, h] >= edge(angle + a.radius[lo + g] + b.radius[k * WIDE + h])
                if fine.any():
                    yield g[fine] + lo, h[fine] + k * WIDE


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of ``n`` rows from each ``start`` on."""
    return np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


class Best:
    """The ``k`` best of each row of a block: similarity, id and what that row carries; ties to the smaller id."""

    def __init__(self, rows: int, k: int):
        self.s, self.i, self.c = np.full((rows, k), -2.0), np.zeros((rows, k), np.int64), np.zeros((rows, k), np.int64)

    def take(self, a: Block, b: Block, i: np.ndarray, j: np.ndarray, least: float, decimals: int) -> None:
        """Merge the rows ``j`` of ``b`` that are above ``least`` into the best of the rows ``i`` of ``a``."""
        v = _exact(a.x, b.x, i, j, decimals)
        fine = v > least
        i, j, v = i[fine], j[fine], v[fine]
        touched, row = np.unique(i, return_inverse=True)
        if not len(touched):
            return
        k = self.s.shape[1]
        row = np.concatenate([row, np.repeat(np.arange(len(touched)), k)])
        v, other, c = (np.concatenate([new, old[touched].ravel()]) for new, old in ((v, self.s), (b.ids[j], self.i), (b.carried[j], self.c)))
        o = np.lexsort((other, -v, row))
        row, v, other, c = row[o], v[o], other[o], c[o]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        fine = rank < k
        at = touched[row[fine]], rank[fine]
        self.s[at], self.i[at], self.c[at] = v[fine], other[fine], c[fine]


def _meet(a: Block, b: Block, same: bool, best: Best, least: float, decimals: int) -> int:
    """All rows of ``a`` with those of ``b``; returns how many pairs of rows were multiplied."""
    k, floor, done = best.s.shape[1], least - 10.0**-decimals - ROOM, 0
    edge = lambda i: np.maximum(best.s[i, -1] - 10.0**-decimals - ROOM, floor)
    wide: dict[int, list[np.ndarray]] = {}
    for g, h in _near_groups(a, b, np.arccos(np.clip(floor, -1, 1))):
        size = a.n[g] * b.n[h]
        for one in np.unique(g[size >= DENSE]):
            wide.setdefault(int(one), []).append(h[(g == one) & (size >= DENSE)])
        g, h, size = g[size < DENSE], h[size < DENSE], size[size < DENSE]
        total = np.cumsum(size)
        cuts = np.searchsorted(total, np.arange(PAIRS, total[-1] + PAIRS, PAIRS)) if len(g) else []
        for lo, hi in zip(np.r_[0, cuts[:-1]].astype(int) if len(g) else [], cuts, strict=True):
            hi = len(g) if hi >= len(g) - 1 else hi
            if lo >= hi:
                continue
            # row pairs of each pair of groups, the rows of b within each row of a
            i = _spread(a.start[g[lo:hi]], a.n[g[lo:hi]])
            of = np.repeat(np.arange(lo, hi), a.n[g[lo:hi]])
            i, j = np.repeat(i, b.n[h[of]]), _spread(b.start[h[of]], b.n[h[of]])
            done += len(i)
            fine = np.einsum("ij,ij->i", a.low[i], b.low[j]) >= edge(i)
            if same:
                fine &= i != j
            best.take(a, b, i[fine], j[fine], least, decimals)
    for g, hs in wide.items():
        h = np.concatenate(hs)
        rows, others = np.arange(a.start[g], a.start[g] + a.n[g]), _spread(b.start[h], b.n[h])
        for c in range(0, len(others), 4 * WIDE):
            some = others[c : c + 4 * WIDE]
            y = np.ascontiguousarray(b.low[some].T)
            for lo in range(0, len(rows), TILE):
                mine = rows[lo : lo + TILE]
                s = a.low[mine] @ y
                done += s.size
                if same:
                    i, j = np.nonzero(mine[:, None] == some[None, :])
                    s[i, j] = -2.0
                i, j = np.nonzero(s >= np.maximum(edge(mine), _bound_of_rows(s, k, 4 * k) - 10.0**-decimals - ROOM)[:, None].astype(np.float32))
                best.take(a, b, mine[i], some[j], least, decimals)
    return done


def links_above(rows: DataFrame, dim: int, k: int, least: float, carry: str, decimals: int = 6, block: int = ROWS) -> DataFrame:
    """(a, b, sim, a_carried, b_carried), a < b: the links of every row to those of its ``k`` most similar others above ``least``.

    rows: (id, vec and a long ``carry``), ids unique.  Similarities are rounded to ``decimals`` before they are compared;
    ties go to the smaller id.  A link that both ends have comes once.
    """
    spark = rows.sparkSession
    rows = rows.select("id", "vec", F.coalesce(F.col(carry), F.lit(0)).cast("long").alias("carried"))
    kind = "<f4" if dict(rows.dtypes)["vec"] == "array<float>" else "<f8"
    rows = rows.withColumn("vec", F.col("vec").cast("array<float>" if kind == "<f4" else "array<double>"))
    n = rows.count()
    block = int(np.clip(n // TASKS, min(block, LEAST_ROWS), block))
    cells = int(np.clip(2 * n // block, 1, LANDMARKS))
    # a sample by hash: its first rows are the landmarks, and all of it says how many rows a cell has
    share = max(1, n // (16 * cells))
    sample = _matrix(rows.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("vec").limit(64 * cells).toArrow().column(0).combine_chunks(), dim).astype(np.float32) if n else np.zeros((1, dim), np.float32)
    marks = sample[:cells] if len(sample) else np.zeros((1, dim), np.float32)
    held = np.bincount((sample @ marks.T).argmax(1), minlength=len(marks)) * (n / max(1, len(sample)))
    near = np.argsort(-(marks @ marks[0]), kind="stable")
    parts = np.maximum(1, np.ceil(held / block)).astype(np.int64)  # a cell of several blocks
    base, at, room = np.zeros(len(marks), np.int64), -1, 0.0
    for c in near:  # small cells share a block
        if parts[c] > 1 or held[c] > room:
            at, room = at + 1, float(block)
        base[c] = at
        at, room = (at + parts[c] - 1, 0.0) if parts[c] > 1 else (at, room - held[c])
    m = int(at) + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = np.concatenate([(batch_x @ marks.T).argmax(1) for batch_x in np.array_split(_matrix(batch.column(1), dim).astype(np.float32), -(-batch.num_rows // 4096))])
                pid = base[cell] + batch.column(3).to_numpy() % parts[cell]
                raw = np.ascontiguousarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), kind)
                vec = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((np.arange(batch.num_rows + 1) * (dim * raw.itemsize)).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(pid.astype(np.int32)), batch.column(0), batch.column(2), vec], names=["pid", "id", "carried", "vec"])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x = _unit(_raw(t.column("vec"), dim, kind)).astype(np.float32)
            own = np.concatenate([_groups(x[lo : lo + 2 * ROWS]) + lo for lo in range(0, len(x), 2 * ROWS)])
            return t.append_column("grp", pa.array(own.astype(np.int32))).combine_chunks().to_batches()[0]

        for batch in batches:  # sorted by pid
            pid = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(pid)) + 1
            for lo, hi in zip(np.r_[0, cuts].astype(int), np.r_[cuts, len(pid)].astype(int), strict=True):
                if held and hi > lo and held[0].column(0)[0].as_py() != pid[lo]:
                    yield out()
                    held.clear()
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield out()

    schema = "pid int, id long, carried long, vec binary"
    folder = f"{checkpoint_folder(spark)}/links-{uuid.uuid4().hex}"
    placed = rows.select("id", "vec", "carried", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 31)).alias("_h")).mapInArrow(place, schema)
    placed.repartition("pid").sortWithinPartitions("pid").mapInArrow(grouped, schema + ", grp int").write.partitionBy("pid").parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)

        def load(p: int) -> Block | None:
            where = f"{path}/pid={p}"
            if store.get_file_info(where).type == fs.FileType.NotFound:
                return None
            return Block(ds.dataset(where, filesystem=store, format="parquet").to_table(columns=["id", "carried", "vec", "grp"]), dim, kind)

        for batch in batches:
            for p in batch.column(0).to_pylist():
                a = load(p)
                if a is None:
                    continue
                best = Best(len(a.ids), k)
                for q in [p, *range(p), *range(p + 1, m)]:  # its own first: what it has bounds the rest
                    b = a if q == p else load(q)
                    if b is not None:
                        _meet(a, b, q == p, best, least, decimals)
                r, c = np.nonzero(best.s > least)
                one, other, sim, carried, others = a.ids[r], best.i[r, c], best.s[r, c], a.carried[r], best.c[r, c]
                turn = one > other
                x, y = np.where(turn, other, one), np.where(turn, one, other)
                order = np.lexsort((y, x))  # what both ends of this block have comes once
                order = order[np.r_[True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)]] if len(order) else order
                cols = [x, y, sim, np.where(turn, others, carried), np.where(turn, carried, others)]
                for lo in range(0, len(order), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(v[order[lo : lo + (1 << 16)]]) for v in cols], names=["a", "b", "sim", "a_carried", "b_carried"])

    found = spark.range(0, m, 1, m).mapInArrow(run, "a long, b long, sim double, a_carried long, b_carried long")
    return found.groupBy("a", "b").agg(*[F.max(c).alias(c) for c in ("sim", "a_carried", "b_carried")])
