"""Problem 2: grouping records into similarity clusters.

A vector's token set is the set of its nearest landmarks (a bounded sample of the collection, thinned out so that no two
are similar).  MinHash draws one token of the set for each of ``BANDS`` bands of one row; vectors that share a drawn
token are candidates (in which band it was drawn doesn't matter to a band of one row).  In a token's bucket exact Jaccard
of the token sets verifies candidates, and exact cosine those that pass, since clusters are defined by cosine.  A
bucket links its rows to its leaders, to all of them within reach, and to each other where that joins what the leaders
don't; every row goes to the buckets of its tokens, since one left out for its leader's sake would take its links along.
Connected components of the links form the groups.  A group in which some two members aren't similar is loose and split around
its medoid of highest degree, until none is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm.vectors import bounded_sample, leaders, leading, matrix, pack, similar, tasks_for, unit, unpack, vectors
from recallgrid.operators.components import connected_components
from recallgrid.operators.search import _merge
from recallgrid.operators.skew import lookup_join, shared_checkpoint
from recallgrid.sources.tables import table

THRESHOLD = 0.80
MIN_SIZE = 3
BANDS, NEAREST = 16, 8
#: Token sets of similar vectors have at least two of their tokens in common: 2 of 14.
JACCARD = 0.14
#: Members of a group that are compared at once; larger groups meet block by block.
GROUP_BLOCK = 4096


def landmarks(vecs: DataFrame, n_rows: int) -> np.ndarray:
    """Landmarks for a collection of ``n_rows``: about 4 times its square root, 64 to 8192, no two within ``THRESHOLD``."""
    want = int(min(8192, max(64, 2 ** round(np.log2(4 * max(n_rows, 1) ** 0.5)))))
    sample = bounded_sample(vecs, 8 * want, n_rows)
    heads = np.unique(leaders(sample, THRESHOLD)) if len(sample) else np.zeros(0, int)
    return sample[heads[:want]]


def token_sets(x: np.ndarray, marks: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """(rows, nearest): each row's nearest landmarks, as a sorted set."""
    t = min(nearest, len(marks))
    m32 = marks.astype(np.float32).T
    out = np.empty((len(x), t), np.int32)
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = np.sort(np.argpartition(-(x[a : a + 4096].astype(np.float32) @ m32), t - 1, axis=1)[:, :t], axis=1)
    return out


def minhash_tokens(sets: np.ndarray, n_tokens: int, bands: int = BANDS, seed: int = 7) -> np.ndarray:
    """(rows, bands): for each band the token of the row's set that its permutation puts first."""
    rng = np.random.default_rng(seed)
    out = np.empty((len(sets), bands), np.int32)
    for b in range(bands):
        out[:, b] = sets[np.arange(len(sets)), rng.permutation(n_tokens).astype(np.int32)[sets].argmin(1)]
    return out


def _tokened(marks):
    """Stage 1: rows of an input partition as (id, vec, tokens, sets); every row goes on to the buckets of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = matrix(batch.column(1))
                sets = token_sets(unit(raw), marks.value)
                lists = [np.unique(x).tolist() for x in minhash_tokens(sets, len(marks.value))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pack(raw), pa.array(lists, pa.list_(pa.int32())), pack16(sets)], names=["id", "vec", "tokens", "sets"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), pack(matrix(batch.column(1)))], names=["id", "vec"])


def pack16(sets: np.ndarray) -> pa.Array:
    """Token sets as binary, two bytes a token (there are at most 8,192 landmarks)."""
    x = np.ascontiguousarray(sets, dtype=np.uint16)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1, dtype=np.int32) * x.shape[1] * 2).tobytes()), pa.py_buffer(x.tobytes())])


def _unpack16(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint16).reshape(len(rows), -1)


def _alike(sets: np.ndarray, a: np.ndarray, b: np.ndarray, part: int = 1 << 16) -> np.ndarray:
    """Whether the token sets of the rows ``a`` and ``b`` have a Jaccard of ``JACCARD`` or more."""
    fine = np.zeros(len(a), bool)
    for lo in range(0, len(a), part):
        both = (sets[a[lo : lo + part]][:, :, None] == sets[b[lo : lo + part]][:, None, :]).sum((1, 2))
        fine[lo : lo + part] = both / (2 * sets.shape[1] - both) >= JACCARD
    return fine


def verified_links(u: np.ndarray, sets: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of a bucket: links that join the same rows as all pairs within ``threshold`` with a Jaccard of ``JACCARD`` or more.

    Rows are linked to all leaders within reach.  What that leaves out are followers of two leaders that are similar to
    each other; those are looked for where the angles to a leader allow them and no link joins them yet.
    """
    lead, row, other = leading(u, threshold)
    far = np.flatnonzero(lead != np.arange(len(lead)))
    a, b = np.concatenate([far, row]), np.concatenate([lead[far], other])
    fine = _alike(sets, a, b)
    found, root = [(a[fine], b[fine])], np.arange(len(u))
    _merge(root, a[fine], b[fine])
    heads, place = np.unique(lead[far], return_inverse=True)
    reach = np.arccos(np.clip((u[far] * u[lead[far]]).sum(1), -1, 1))
    widest = np.zeros(len(heads))
    np.maximum.at(widest, place, reach)
    least = np.cos(np.minimum(widest + np.arccos(threshold), np.pi)) - 1e-6
    for lo in range(0, len(heads), 64):
        near = u[far] @ u[heads[lo : lo + 64]].T >= least[lo : lo + 64]
        for h in np.flatnonzero((near & (root[far][:, None] != root[heads[lo : lo + 64]])).any(0)):
            mine, theirs = far[place == lo + h], far[near[:, h] & (place != lo + h)]
            for at in range(0, len(mine), GROUP_BLOCK):
                x = mine[at : at + GROUP_BLOCK]
                y = theirs[~np.isin(root[theirs], root[x])] if (root[x] == root[x[0]]).all() else theirs
                i, j = np.nonzero(similar(u[x], u[y], threshold) & (root[x][:, None] != root[y]))
                i, j = x[i], y[j]
                fine = _alike(sets, i, j)
                found.append((i[fine], j[fine]))
                _merge(root, i[fine], j[fine])
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _bucket_links(threshold: float):
    """Stage 2: links (a, b) of the rows of each token with the leaders of its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs, sets = [], [], []

        def links() -> pa.RecordBatch:
            i = np.concatenate(ids)
            a, b = verified_links(unit(np.concatenate(vecs)), np.concatenate(sets), threshold)
            return pa.RecordBatch.from_arrays([pa.array(i[a]), pa.array(i[b])], names=["a", "b"])

        current = None
        for batch in batches:  # sorted by token: a bucket is held at a time
            k = batch.column(0).to_numpy(zero_copy_only=False)
            i, v, t = batch.column(1).to_numpy(zero_copy_only=False), unpack(batch.column(2)), _unpack16(batch.column(3)) if batch.num_rows else None
            for lo, hi in zip(*(lambda c: (np.r_[0, c], np.r_[c, len(k)]))(np.flatnonzero(np.diff(k)) + 1), strict=True):
                if hi == lo:
                    continue
                if current is not None and k[lo] != current:
                    yield links()
                    ids, vecs, sets = [], [], []
                current = k[lo]
                ids.append(i[lo:hi])
                vecs.append(v[lo:hi])
                sets.append(t[lo:hi])
        if ids:
            yield links()

    return run


def _compared(threshold: float):
    """Rows sorted by (root, block pair): (root, id, degree, dot) of the rows of two blocks that meet, or of one by itself.

    degree counts the similar others, dot is the product with the sum of the others' block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None

        def met() -> pa.RecordBatch:
            root, side, ids = (np.concatenate([h[c] for h in held]) for c in (0, 2, 3))
            u = unit(np.concatenate([h[4] for h in held]))
            degree, dot = np.zeros(len(u), np.int64), np.zeros(len(u))
            for mine, other in (((side == 2), (side == 2)), (side == 0, side == 1), (side == 1, side == 0)):
                if mine.any():
                    degree[mine] = similar(u[mine], u[other], threshold).sum(1) - int(side[0] == 2)  # less itself
                    dot[mine] = u[mine] @ u[other].sum(0)
            return pa.RecordBatch.from_arrays([pa.array(root), pa.array(ids), pa.array(degree), pa.array(dot)], names=["root", "id", "degree", "dot"])

        for batch in batches:
            if not batch.num_rows:
                continue
            root, key, side, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            vec = unpack(batch.column(4))
            cuts = np.flatnonzero((np.diff(root) != 0) | (np.diff(key) != 0)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(root)], strict=True):
                if current is not None and (root[lo], key[lo]) != current:
                    yield met()
                    held = []
                current = (root[lo], key[lo])
                held.append((root[lo:hi], key[lo:hi], side[lo:hi], ids[lo:hi], vec[lo:hi]))
        if held:
            yield met()

    return run


def degrees(members: DataFrame, threshold: float = THRESHOLD, block: int = GROUP_BLOCK) -> DataFrame:
    """members (root, id, vec, size) -> (root, id, size, degree, mean): similar others of the group, mean cosine to the others.

    A group of at most ``block`` members is compared in one task; the blocks of a larger one meet pairwise in many.
    """
    m = F.ceil(F.col("size") / F.lit(block)).cast("long")
    own, y = F.pmod(F.xxhash64("id"), m), F.col("_y")
    placed = members.select("root", "id", "vec", "size", own.alias("_b"), m.alias("_m"), F.explode(F.sequence(F.lit(0).cast("long"), m - 1)).alias("_y"))
    side = F.when(F.col("_b") == y, 2).when(F.col("_b") < y, 0).otherwise(1).cast("byte")
    placed = placed.select("root", (F.least("_b", y) * F.col("_m") + F.greatest("_b", y)).alias("key"), side.alias("side"), "id", "vec")
    met = placed.repartition(tasks_for(members.count()), "root", "key").sortWithinPartitions("root", "key", "id").mapInArrow(_compared(threshold), "root long, id long, degree long, dot double")
    per = met.groupBy("root", "id").agg(F.sum("degree").alias("degree"), F.sum("dot").alias("dot"))
    sizes = members.groupBy("root").agg(F.max("size").alias("size"))
    n = F.greatest(F.col("size") - 1, F.lit(1))
    return lookup_join(per, sizes, "root").select("root", "id", "size", "degree", F.round((F.col("dot") - 1) / n, 12).alias("mean"))


def sized(members: DataFrame, least: int) -> DataFrame:
    """members (root, id, vec) of the groups of at least ``least``, with size and with the smallest id as root."""
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("_to")).where(F.col("size") >= least)
    return lookup_join(members.select("root", "id", "vec"), sizes, "root").where(F.col("size").isNotNull()).select(F.col("_to").alias("root"), "id", "vec", "size")


def split_loose(members: DataFrame, threshold: float = THRESHOLD, least: int = MIN_SIZE) -> DataFrame:
    """(root, id, size, mean) of groups of at least ``least`` in which any two members are similar.

    members: (root, id, vec, size).  A group with two members that aren't gives off those around its medoid, the member
    of highest degree; where all are around it, it loses the member of lowest degree.  Every round makes a loose group
    smaller, so it ends.
    """
    done = None
    while True:
        judged = shared_checkpoint(degrees(members, threshold))
        bad = judged.where(F.col("degree") < F.col("size") - 1).select("root").distinct()
        tight = judged.join(bad, "root", "left_anti").select("root", "id", "size", "mean")
        done = tight if done is None else done.unionByName(tight)
        if bad.limit(1).count() == 0:
            return done
        loose = members.join(bad, "root", "left_semi").join(judged.select("root", "id", "degree"), ["root", "id"])
        pick = loose.groupBy("root").agg(
            F.max_by(F.struct("id", "vec"), F.struct("degree", -F.col("id"))).alias("medoid"), F.min_by("id", F.struct("degree", -F.col("id"))).alias("last"), (F.max("degree") == F.max("size") - 1).alias("all")
        )
        parts = _sides(lookup_join(loose.select("root", "id", "vec"), pick.select("root", F.col("medoid.vec").alias("centre"), "last", "all"), "root"), threshold)
        members = shared_checkpoint(sized(parts, least))


def _sides(rows: DataFrame, threshold: float) -> DataFrame:
    """(root, id, vec) with a root for either part of a loose group: those that stay around the medoid, and the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root, ids, vec, centre, last, whole = batch.columns
            near = (unit(unpack(vec)) * unit(unpack(centre))).sum(1) >= threshold - 1e-12 if batch.num_rows else np.zeros(0, bool)
            i = ids.to_numpy(zero_copy_only=False)
            gone = np.where(whole.to_numpy(zero_copy_only=False).astype(bool), i == last.to_numpy(zero_copy_only=False), ~near)
            yield pa.RecordBatch.from_arrays([root, pa.array(gone.astype(np.int8)), ids, vec], names=["root", "part", "id", "vec"])

    cut = rows.select("root", "id", "vec", "centre", "last", "all").mapInArrow(run, "root long, part byte, id long, vec binary")
    return cut.select(F.xxhash64("root", "part").alias("root"), "id", "vec")


def groups(memories: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(root, id, vec) of every comparable vector: vectors of a group share a root, its smallest id.

    Embeddings that are null, empty, all-zero, not of ``DIM`` numbers or hold NaN belong to none; rows with equal
    embeddings belong together; extra columns are ignored; an empty table gives an empty result.
    """
    spark = memories.sparkSession
    vecs = vectors(memories)
    n = vecs.count()
    marks = landmarks(vecs, n)
    if not len(marks):
        return spark.createDataFrame([], "root long, id long, vec binary")
    shared = spark.sparkContext.broadcast(marks)
    rows = vecs.mapInArrow(_tokened(shared), "id long, vec binary, tokens array<int>, sets binary")
    buckets = rows.select(F.explode("tokens").alias("token"), "id", "vec", "sets")
    links = buckets.repartition(tasks_for(n * NEAREST), "token").sortWithinPartitions("token", "id").mapInArrow(_bucket_links(threshold), "a long, b long")
    roots = connected_components(links)
    packed = vecs.mapInArrow(_packed, "id long, vec binary")
    joined = packed.join(roots, "id", "left").select(F.coalesce("root", "id").alias("root"), "id", "vec")
    return joined


def clusters(memories: DataFrame, threshold: float = THRESHOLD, min_size: int = MIN_SIZE) -> DataFrame:
    """(cluster_id, id, typical_id, size): one row per member of each group of at least ``min_size`` members.

    cluster_id is the smallest id; typical_id the member with the highest mean cosine to the other members (ties: the
    smallest id).
    """
    members = shared_checkpoint(sized(groups(memories, threshold), min_size))
    tight = split_loose(members, threshold, min_size)
    typical = tight.groupBy("root").agg(F.max_by("id", F.struct("mean", -F.col("id"))).alias("typical_id"))
    # a part of a split group keeps the smallest id of its own
    return lookup_join(tight.select("root", "id", "size"), typical, "root").select(F.col("root").alias("cluster_id"), "id", "typical_id", "size")


def describe(found: DataFrame) -> DataFrame:
    """One row per cluster: its size and most typical member."""
    return found.groupBy("cluster_id", "typical_id").agg(F.count(F.lit(1)).alias("size"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return clusters(table(spark, root, "memories")).select("cluster_id", "id", "typical_id")


def p2_clusters(spark: SparkSession, root: str) -> DataFrame:
    return describe(clusters(table(spark, root, "memories")))


ORACLE: dict = {}
QUERIES = {"p2_found": p2_found, "p2_clusters": p2_clusters}
