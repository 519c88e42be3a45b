"""Similarity self-joins against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recallgrid.operators import search
from recallgrid.plans import extended, vectors_text

SCHEMA = "id long, embedding array<float>"


def collection(seed=8):
    """Singles, a group of 130, and a chain whose ends aren't similar; hardly an id is divisible by 100."""
    rng = np.random.default_rng(seed)
    c = rng.normal(size=64)
    c /= np.linalg.norm(c)
    a, b = np.eye(64)[0], np.eye(64)[1]
    rows = [rng.normal(size=64) for _ in range(150)] + [c + 0.02 * rng.normal(size=64) for _ in range(130)]
    rows += [np.cos(t) * a + np.sin(t) * b for t in np.linspace(0, np.pi / 2, 6)]
    x = np.array(rows, dtype=np.float32)[rng.permutation(len(rows))]
    return 101 + 3 * np.arange(len(x)), x


def frame(spark, ids, x):
    bad = [(1, None), (2, []), (3, [0.0] * 64), (4, [1.0] * 48)]
    return spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x, strict=True)] + bad, SCHEMA)


def cosines(x):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    return np.round(u @ u.T, 6)


def roots(ids, ok):
    root = np.arange(len(ids))
    while True:
        new = np.array([root[ok[i] | (np.arange(len(ids)) == i)].min() for i in range(len(ids))])
        if (new == root).all():
            return {(int(ids[i]), int(ids[root[i]])) for i in range(len(ids)) if ok[i].any()}
        root = new


def test_gr15_groups_every_row(spark):
    ids, x = collection()
    ok = (cosines(x) >= 0.85) & ~np.eye(len(x), dtype=bool)
    got = {(r.id, r.root) for r in extended.gr15_similarity_groups(lambda _: frame(spark, ids, x)).collect()}
    assert got == roots(ids, ok) and len(got) >= 136


def test_jn8_counts_for_every_row(spark):
    ids, x = collection()
    s = np.where(np.eye(len(x), dtype=bool), -2, cosines(x))
    want = {(int(i), int((r >= 0.3).sum()), float(r[r >= 0.3].min())) for i, r in zip(ids, s, strict=True) if (r >= 0.3).any()}
    got = {(r.query_id, r.n, round(r.least, 6)) for r in vectors_text.jn8_similar_above_threshold(lambda _: frame(spark, ids, x)).collect()}
    assert got == want


@pytest.mark.parametrize("block", [40, 1000])
def test_links_across_blocks(spark, block):
    from recallgrid.operators.components import connected_components

    ids, x = collection(9)
    s = cosines(x)
    rows = search.usable(frame(spark, ids, x), "id", "embedding", 64)
    want = {(int(ids[i]), int(ids[j]), float(s[i, j])) for i, j in zip(*np.nonzero(s >= 0.85), strict=True) if i < j}
    assert {(r.a, r.b, round(r.sim, 6)) for r in search.similar_links(rows, 64, 0.85, block=block).collect()} == want
    ok = (s >= 0.85) & ~np.eye(len(x), dtype=bool)
    assert {tuple(r) for r in connected_components(search.similar_groups(rows, 64, 0.85, block=block)).select("id", "root").collect()} == roots(ids, ok)


def best(ids, x, k=5):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    return {(int(ids[i]), r + 1, int(ids[j])) for i in range(len(ids)) for r, j in enumerate(np.lexsort((ids, -s[i]))[: min(k, len(ids) - 1)])}


@pytest.mark.parametrize("size, block", [(286, 40), (286, 130), (3, 1000), (1, 1000)])
def test_nearest_across_blocks(spark, size, block):
    ids, x = collection(11)
    ids, x = ids[:size], x[:size]
    x[-1] = x[0]  # copies
    x[size // 2] = x[0]
    rows = search.usable(frame(spark, ids, x), "id", "embedding", 64)
    assert {(r.id, r.rank, r.other) for r in search.nearest(rows, 64, 5, block=block).collect()} == best(ids, x)


def test_dr7_links_pairs_of_the_sample_and_dr23_the_64_nearest(spark):
    import datetime as dt

    from recallgrid.functions import text as X
    from recallgrid.plans import graph_dream

    ids, x = collection(13)
    s = cosines(x)
    said = ["it cost 5", "it cost 7", "because of 5", "replaces 9", "no number", None, "so it is due", "to us"]
    times = [dt.datetime(2025, 1, 1), None, dt.datetime(2024, 6, 1)]
    rows = [(int(i), [float(a) for a in v], said[n % 8], times[n % 3]) for n, (i, v) in enumerate(zip(ids, x, strict=True))]
    t = spark.createDataFrame([(*r, 0.5, None) for r in rows], SCHEMA + ", content string, created_at timestamp_ntz, salience double, last_accessed timestamp_ntz")
    off = np.where(np.eye(len(ids), dtype=bool), -2.0, s)
    near = [set(np.lexsort((ids, -off[i]))[:64].tolist()) for i in range(len(ids))]
    numbers = lambda c: set(w for w in (c or "").split() if w.isdigit())
    newer, linked = set(), set()
    for i in range(len(ids)):
        for j in range(i + 1, len(ids)):
            (a, _, ca, ta), (b, _, cb, tb) = rows[i], rows[j]
            if s[i, j] >= 0.85 and numbers(ca) and numbers(cb) and numbers(ca) != numbers(cb):
                later = (ta is not None and tb is not None and ta < tb) or ((ta is None or tb is None or ta == tb) and a < b)
                newer.add((a, b) if later else (b, a))
            if s[i, j] > 0.7 and (j in near[i] or i in near[j]):
                text = " ".join(c for c in (ca, cb) if c is not None)
                kind = "causal" if any(w in text for w in X.CAUSAL_WORDS) else "supersedes" if any(w in text for w in X.SUPERSEDING_WORDS) else "similar"
                linked.add((a, b, kind, float(s[i, j])))
    got = [tuple(r)[:2] for r in graph_dream.dr7_supersedes(lambda _: t).select("s", "t").collect()]
    assert set(got) == newer and len(got) == len(newer) > 1000
    assert {(r.s, r.t, r.edge_type, round(r.weight, 6)) for r in graph_dream.dr23_auto_connect(lambda _: t).collect()} == linked


@pytest.mark.parametrize("block, k", [(40, 64), (130, 5), (1000, 64)])
def test_links_above_find_all_and_multiply_few(spark, block, k):
    """Every row's k best above the threshold across blocks; singles aren't multiplied with the rows of a far group."""
    from recallgrid.operators import above

    ids, x = collection(17)
    x[-1] = x[0]  # copies
    x[len(x) // 2] = x[0]
    off = np.where(np.eye(len(ids), dtype=bool), -2.0, cosines(x))
    want = {}
    for i in range(len(ids)):
        for j in np.lexsort((ids, -off[i]))[:k]:
            if off[i, j] > 0.7:
                want[tuple(sorted((int(ids[i]), int(ids[j]))))] = float(off[i, j])
    rows = search.usable(frame(spark, ids, x), "id", "embedding", 64).withColumn("tag", F.col("id") * 2)
    got = above.links_above(rows, 64, k, 0.7, "tag", block=block).collect()
    assert {(r.a, r.b): round(r.sim, 6) for r in got} == want and len(got) == len(want)
    assert all((r.a_carried, r.b_carried) == (2 * r.a, 2 * r.b) for r in got)
    unit = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    table = pa.table({"id": ids, "carried": ids, "grp": above._groups(unit), "vec": pa.array([v.tobytes() for v in x], pa.binary())})
    one = above.Block(table, 64, "<f4")
    assert len(one.n) < 170 and above._meet(one, one, True, above.Best(len(ids), k), 0.7, 6) < len(ids) ** 2 / 3
