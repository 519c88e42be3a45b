import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.operators import graph as G
from recallgrid.operators import hopfield, search
from recallgrid.operators.skew import checkpoint_folder

EDGES = [(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.9), (1, 5, 0.2), (5, 4, 1.0), (4, 6, 0.5), (7, 8, 1.0)]


@pytest.fixture(scope="module")
def g(spark):
    return spark.createDataFrame([e for a, b, w in EDGES for e in ((a, b, w), (b, a, w))], "src long, dst long, w double")


def near():
    out: dict = {}
    for a, b, w in EDGES:
        out.setdefault(a, {})[b] = w
        out.setdefault(b, {})[a] = w
    return out


def test_walks_against_plain_ones(spark, g):
    n, want = near(), {}
    for s in (1, 4, 7):
        mass, got = {s: 1.0}, {}
        for _ in range(3):
            new: dict = {}
            for a, m in mass.items():
                for b, w in n[a].items():
                    if (x := m * w / sum(n[a].values()) * 0.85) >= 1e-3:
                        new[b] = new.get(b, 0.0) + x
            mass = new
            for b, m in new.items():
                got[b] = got.get(b, 0.0) + m
        for r, (b, m) in enumerate(sorted(((b, round(m * 0.15, 9)) for b, m in got.items() if b != s), key=lambda x: (-x[1], x[0]))[:3]):
            want[s, r + 1] = (b, m)
    seeds = spark.createDataFrame([(1,), (4,), (7,), (99,)], "id long")
    got = {(r.seed, r.rank): (r.id, round(r.score, 9)) for r in G.walks(g, seeds, top=3).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-8 for k in want)


def test_activation_of_several_queries_is_kept_apart(spark, g):
    seeds = spark.createDataFrame([(10, 1, 1.0), (20, 7, 1.0), (20, 8, 0.5)], "q long, id long, act double")
    got = {(r.q, r.id): round(r.act, 6) for r in G.activation(g, seeds, depth=2, by=("q",)).collect()}
    assert got == {(10, 2): 0.765, (10, 5): 0.17, (10, 3): round(0.9 * 0.8 * 0.85**2, 6), (10, 4): round(0.2 * 0.85**2, 6)}
    alone = {r.id: round(r.act, 6) for r in G.activation(g, seeds.where("q = 10").select("id", "act"), depth=2).collect()}
    assert alone == {i: a for (q, i), a in got.items() if q == 10}


def test_think_spreads_what_a_node_got_first(spark, g):
    got = {r.id: round(r.act, 6) for r in G.think(g, spark.createDataFrame([(1,)], "id long")).collect()}
    d = 0.85
    assert got[4] == round(max(0.2 * d * d, 0.9 * 0.8 * 0.9 * d**3), 6)  # reached by 5 first, raised by 3 later
    assert got[6] == round(0.2 * d * d * 0.5 * d, 6)  # but spread with what came by 5


def test_paths(spark, g):
    got = {r.id: (r.hop, r.path) for r in G.paths(g, spark.createDataFrame([(1,)], "id long"), 4).collect()}
    assert got == {1: (0, [1]), 2: (1, [1, 2]), 5: (1, [1, 5]), 3: (2, [1, 2, 3]), 4: (2, [1, 5, 4]), 6: (3, [1, 5, 4, 6])}
    assert G.paths(g, spark.createDataFrame([(99,)], "id long"), 3).count() == 1


def test_pagerank_sums_up(spark, g):
    seeds = spark.createDataFrame([(1, 1.0)], "id long, share double")
    got = {r.id: r.score for r in G.pagerank(g, seeds, rounds=30).collect()}
    ids = sorted(near())
    p = np.zeros((8, 8))
    for a, bs in near().items():
        for b, w in bs.items():
            p[ids.index(b), ids.index(a)] = w / sum(bs.values())
    x = np.eye(8)[0]
    for _ in range(30):
        x = 0.85 * p @ x + 0.15 * np.eye(8)[0]
    x /= x.max()
    assert all(abs(got.get(i, 0.0) - x[k]) < 1e-9 for k, i in enumerate(ids))


def test_associative_retrieval_against_numpy(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(40, 8))
    p /= np.linalg.norm(p, axis=1)[:, None]
    q = p[:6] + 0.15 * rng.normal(size=(6, 8))
    rows = lambda x: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    got = {r.query_id: r for r in hopfield.retrieve(rows(p).repartition(3), rows(q), 8, block=4).collect()}
    for i in range(6):
        x = q[i] / np.linalg.norm(q[i])
        for s in range(1, 11):
            z = 20 * p @ x
            w = np.exp(z - z.max())
            w /= w.sum()
            new = w @ p
            new /= np.linalg.norm(new)
            moved = np.linalg.norm(new - x)
            if moved < 1e-4:
                break
            x = new
        assert got[i].id == int(np.argmax(z)) and got[i].steps == s
        assert abs(got[i].confidence - w.max()) < 1e-3 and abs(got[i].entropy + (w * np.log(w)).sum()) < 1e-2
    assert hopfield.retrieve(rows(p).limit(0), rows(q), 8).count() == 0 and hopfield.retrieve(rows(p), rows(q).limit(0), 8).count() == 0


@pytest.mark.parametrize("part", [3, 2048])
def test_search_in_parts_of_a_block(spark, monkeypatch, part):
    monkeypatch.setattr(search, "PART", part)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 8))
    x[10] = x[20] = x[30]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>").repartition(3)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    got: dict = {}
    for r in search.top_k(df.where("id % 7 = 0 or id = 10"), df, 4, 8).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    for q, hits in got.items():
        assert [hits[k] for k in range(1, 5)] == np.lexsort((np.arange(80), -s[q]))[:4].tolist()


def test_a_cluster_must_name_its_folder(spark):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isEmpty": staticmethod(lambda: True)}))}))

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(RuntimeError):
        checkpoint_folder(Session)
    assert checkpoint_folder(spark)


def test_time_bounds(spark):
    from recallgrid.functions import text as X

    now = F.lit("2025-12-31 00:00:00").cast("timestamp")
    want = {
        "what changed on 2025-03-04?": ("2025-03-03", "2025-03-05"), "and yesterday": ("2025-12-29", "2025-12-30"), "the last week": ("2025-12-24", "2025-12-31"), "2025-99-99 today": ("2025-12-30", "2025-12-31"), "no time at all": None,
    }
    rows = spark.createDataFrame([(q,) for q in want], "q string")
    got = {r.q: r.b and (str(r.b.lo)[:10], str(r.b.hi)[:10]) for r in rows.select("q", X.time_bounds(F.col("q"), now).alias("b")).collect()}
    assert got == want


def test_entities_and_searched_ones(spark):
    from recallgrid.functions import text as X

    text = "Zofka met zofka at Port9 and camelCase; the ZOFKA node."
    r = spark.createDataFrame([(text,), ("nothing named but something longish",)], "t string").select(X.entities(F.col("t")).alias("e"), X.search_entities(F.col("t")).alias("s")).collect()
    assert r[0].e == ["Zofka", "Port9", "camelCase"] and r[0].s == ["zofka", "port9", "camelcase"] and r[1].e == [] and r[1].s == ["nothing", "something", "longish"]


def test_views_for_ad_hoc_sql(spark, tmp_path):
    from recallgrid.sources.tables import register_views

    spark.createDataFrame([(1, 5, 6, 0.5, "similar"), (2, 6, 5, 0.7, "Similar ")], "id long, source_id long, target_id long, weight double, edge_type string").selectExpr(
        "*", "timestamp_ntz'2024-01-01' created_at", "timestamp_ntz'2024-01-01' event_time", "timestamp_ntz'2024-01-01' ingestion_time", "timestamp_ntz'2024-01-01' valid_from", "cast(null as timestamp_ntz) valid_to"
    ).write.parquet(f"{tmp_path}/connections.parquet")
    assert register_views(spark, str(tmp_path), ("connections",)) == ["connections", "edges", "graph"]
    assert [tuple(r) for r in spark.sql("select src, dst, w from graph order by src").collect()] == [(5, 6, 0.7), (6, 5, 0.7)]
    assert spark.sql("select count(*) from edges join connections on source_id = s").first()[0] == 1


def test_edges_that_carry_too_little_are_left_out_before_seeds_meet_them(spark, monkeypatch):
    """None of the 3,000 edges of a hub carries a thousandth, so no seed beside it may meet them; light ends keep theirs."""
    from recallgrid.operators import graph as G

    kept = []
    monkeypatch.setattr(G, "shared_checkpoint", lambda df, *a: kept.append(df) or df)
    pairs = [(0, n) for n in range(1, 3001)] + [(n, n + 1) for n in range(1, 40, 2)]
    e = spark.createDataFrame([x for a, b in pairs for x in ((a, b, 1.0), (b, a, 1.0))], "src long, dst long, w double")
    got = {(r.seed, r.id): r.score for r in G.walks(e, spark.createDataFrame([(1,), (50,)], "id long")).collect()}
    assert kept[0].where("src = 0").count() == 0 and kept[0].where("src > 0").count() == 3040
    m = 0.85 / 2
    assert got == {(1, 0): round((m + m**2 + m**3) * 0.15, 9), (1, 2): round((m + m**3) * 0.15, 9), (50, 0): round(0.85 * 0.15, 9)}
