"""The approximate search against brute force."""

import numpy as np

from recallgrid.plans import extended


def test_tk3_recall(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 64))
    x = np.concatenate([rng.normal(size=(900, 64)), centres[rng.integers(40, size=600)] + 0.9 * rng.normal(size=(600, 64))]).astype(np.float32)
    ids = 7 + np.arange(len(x))[rng.permutation(len(x))]
    frame = spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x, strict=True)] + [(1, None), (2, [0.0] * 64)], "id long, embedding array<float>")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    want = {(int(ids[i]), int(ids[j])) for i in np.flatnonzero(ids % 100 == 0) for j in np.lexsort((ids, -s[i]))[:10]}
    at = {int(i): n for n, i in enumerate(ids)}
    got = extended.tk3_lsh_search(lambda _: frame).collect()
    assert all(abs(s[at[r.query_id], at[r.id]] - r.sim) < 2e-6 for r in got)
    assert len({(r.query_id, r.id) for r in got}) == len(got) == 10 * 15
    assert len(want & {(r.query_id, r.id) for r in got}) >= 0.9 * len(want)
