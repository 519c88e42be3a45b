import numpy as np
import pytest

from recallgrid.llm import clusters as C
from recallgrid.llm import neighbours as N
from recallgrid.llm.vectors import leaders, leading, similar

SCHEMA = "id long, embedding array<float>, root string, vec string, cosine string"


def collection(seed=1, singles=300, groups=(3, 4, 5, 9, 40, 120)):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=64) for _ in range(singles)]
    for g in groups:
        c = rng.normal(size=64)
        rows += [(c / np.linalg.norm(c) + 0.035 * rng.normal(size=64)) * rng.uniform(0.4, 4) for _ in range(g)]
    x = np.array(rows, dtype=np.float32)[rng.permutation(len(rows))]
    x[5] = x[7]  # copies
    return x


def frame(spark, x, first=100):
    rows = [(first + 3 * i, [float(a) for a in v], "c", "c", "c") for i, v in enumerate(x)]
    bad = [(1, None), (2, []), (3, [0.0] * 64), (4, [1.0] * 48), (5, [float("nan")] * 64), (6, [None] + [1.0] * 63), (7, [float("inf")] * 64)]
    return spark.createDataFrame(rows + [(i, e, "c", "c", "c") for i, e in bad], SCHEMA)


def truth(x, first=100):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = np.round(u @ u.T, 12)
    ids = first + 3 * np.arange(len(x))
    near, members = set(), {}
    for i in range(len(x)):
        o = [j for j in np.lexsort((ids, -s[i])) if j != i and s[i, j] >= 0.8][:5]
        near |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in o}
        m = np.flatnonzero(s[i] >= 0.8)
        if len(m) >= 3:
            mean = (s[np.ix_(m, m)].sum(1) - 1) / (len(m) - 1)
            members[ids[i]] = (ids[m[0]], ids[m[np.lexsort((ids[m], -np.round(mean, 9)))[0]]])
    return near, {(int(c), int(i), int(t)) for i, (c, t) in members.items()}


def test_clusters_against_brute_force(spark):
    x = collection()
    got = {(r.cluster_id, r.id, r.typical_id) for r in C.clusters(frame(spark, x)).collect()}
    assert got == truth(x)[1]


def test_loose_groups_are_split(spark):
    rng = np.random.default_rng(4)
    a, b = np.eye(64)[0], np.eye(64)[1]
    line = [np.cos(t) * a + np.sin(t) * b for t in np.linspace(0, np.pi / 2, 25)]  # a chain of neighbours, ends at right angles
    x = np.array(line + [rng.normal(size=64) for _ in range(50)], dtype=np.float32)
    found = C.clusters(frame(spark, x)).collect()
    centre = {r.cluster_id: r.typical_id for r in found}
    at = lambda i: x[(i - 100) // 3]
    assert len(centre) >= 2
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for c in centre:  # any two members are similar
        m = [(r.id - 100) // 3 for r in found if r.cluster_id == c]
        assert len(m) >= 3 and (u[m] @ u[m].T).min() >= 0.8 - 1e-6 and min(r.id for r in found if r.cluster_id == c) == c
    assert all(at(r.id) @ at(centre[r.cluster_id]) / np.linalg.norm(at(r.id)) / np.linalg.norm(at(centre[r.cluster_id])) >= 0.8 - 1e-6 for r in found)
    assert len({r.id for r in found}) == len(found)


def test_big_groups_are_compared_block_by_block(spark, monkeypatch):
    x = collection(8, singles=40, groups=(3, 90, 200))
    monkeypatch.setattr(C, "GROUP_BLOCK", 32)
    rows = spark.createDataFrame([(1 if i % 2 else 2, i, bytearray(v.tobytes())) for i, v in enumerate(x)], "root long, id long, vec binary")
    sizes = rows.groupBy("root").count().withColumnRenamed("count", "size")
    got = {r.id: r for r in C.degrees(rows.join(sizes, "root"), block=32).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    for i in range(len(x)):
        same = [j for j in range(len(x)) if j % 2 == i % 2 and j != i]
        c = u[same] @ u[i]
        assert got[i].degree == (c >= 0.8).sum() and abs(got[i].mean - c.mean()) < 1e-9
    assert {(r.cluster_id, r.id, r.typical_id) for r in C.clusters(frame(spark, x)).collect()} == truth(x)[1]


def test_rows_within_reach_of_two_leaders_join_them():
    a, b = np.eye(64)[0], np.eye(64)[1]
    x = np.array([np.cos(t) * a + np.sin(t) * b for t in (0, 1.0, 0.5, 0.55)])  # the last two lie within reach of both others
    lead, row, other = leading(x, 0.8)
    assert lead.tolist() == [0, 1, 0, 0] and set(zip(row.tolist(), other.tolist())) == {(2, 1), (3, 1)}


def test_a_group_whose_link_is_a_follower_in_another_partition(spark):
    x = np.zeros((4, 64), np.float32)
    for n, degrees in enumerate((0, 30, 60, 62)):  # the second follows the first and is all that joins it to the others
        x[n, :2] = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    rows = [(n, v.tolist()) for n, v in enumerate(x, 1)]
    parts = [spark.createDataFrame(r, "id long, embedding array<float>").coalesce(1) for r in (rows[:2], rows[2:])]
    assert {r.id for r in C.clusters(parts[0].unionByName(parts[1])).collect()} == {2, 3, 4}


def test_followers_of_two_leaders_join_them_in_a_bucket():
    x = np.zeros((4, 64))
    for n, degrees in enumerate((0, 108, 36, 72)):
        x[n, :2] = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    s = x @ x.T
    assert s[0, 2] >= 0.8 and s[1, 3] >= 0.8 and s[2, 3] >= 0.8 and max(s[0, 1], s[0, 3], s[1, 2]) < 0.8
    a, b = C.verified_links(x, np.zeros((4, 8), np.uint16) + np.arange(8, dtype=np.uint16), 0.8)
    assert {frozenset(p) for p in zip(a.tolist(), b.tolist())} == {frozenset(p) for p in ((0, 2), (1, 3), (2, 3))}


def test_neighbours_against_brute_force(spark):
    x = collection(2)
    got = {tuple(r) for r in N.pairs(N.neighbours(frame(spark, x), probes=16)).collect()}
    want = truth(x)[0]
    assert got == want
    few = {tuple(r) for r in N.pairs(N.neighbours(frame(spark, x))).collect()}
    assert len(few & want) >= 0.97 * len(want)


def test_p6_neighbours_has_five_of_every_row(spark, tmp_path):
    x = collection(10)
    frame(spark, x).write.parquet(str(tmp_path / "memories.parquet"))
    ids = 100 + 3 * np.arange(len(x))
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    want = {(int(ids[i]), r + 1, int(ids[j])) for i in range(len(ids)) for r, j in enumerate(np.lexsort((ids, -s[i]))[:5])}
    got = {(r.id, r.rank, r.other) for r in N.p6_neighbours(spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 5 * len(ids)


def test_cell_loads_are_those_of_all_rows(spark):
    x = collection(12)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    books = (N.codebook(u[:, :32], 4), N.codebook(u[:, 32:], 4))
    vecs = frame(spark, x).where("id >= 100").select("id", "embedding")
    got = N.cell_loads(vecs, spark.sparkContext.broadcast(books), 16, 6)
    want = np.zeros(16, int)
    for row in N.cells_of(u, books, 6):
        want[np.unique(row)] += 1
    assert got.tolist() == want.tolist()


def test_hot_cells_meet_in_blocks(spark, monkeypatch):
    x = collection(3, singles=20, groups=(300,))
    monkeypatch.setattr(N, "CELL_ROWS", 60)
    assert {tuple(r) for r in N.pairs(N.neighbours(frame(spark, x), probes=16)).collect()} == truth(x)[0]


def test_copies_and_ties(spark):
    x = np.tile(np.arange(1, 65, dtype=np.float32), (12, 1))
    got = {tuple(r) for r in N.pairs(N.neighbours(frame(spark, x))).collect()}
    assert got == truth(x)[0]
    assert {(r.cluster_id, r.typical_id) for r in C.clusters(frame(spark, x)).collect()} == {(100, 100)}


@pytest.mark.parametrize("count", [1, 2, 7, 40])
def test_multi_sequence(count):
    rng = np.random.default_rng(5)
    d1, d2 = sorted(rng.random(7).tolist()), sorted(rng.random(6).tolist())
    want = sorted((d1[i] + d2[j], i, j) for i in range(7) for j in range(6))[:count]
    assert N.multi_sequence(d1, d2, count) == [(i, j) for _, i, j in want]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.clusters(none).count() == 0 and N.neighbours(none).count() == 0
    assert C.clusters(frame(spark, np.zeros((0, 64)))).count() == 0


def test_leaders_cover_everything():
    x = collection(6).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    lead = leaders(x, 0.8, 50)
    assert ((x * x[lead]).sum(1) >= 0.8 - 1e-9).all() and (lead[lead] == lead).all()
    heads = np.unique(lead)
    s = similar(x[heads], x[heads], 0.8)
    np.fill_diagonal(s, False)
    assert not s.any()
