"""The channels of recall: what they hand over, against brute force."""

import datetime

from pyspark.sql import functions as F

from recallgrid.functions import text as X
from recallgrid.operators.index import share_top_k
from recallgrid.plans import retrieval as T


def exchanged_rows(df):
    """Written records of all shuffles of ``df`` after it ran, from the metrics of its plan."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "ShuffleExchangeExec":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return sum(found)


def memories(spark, texts):
    at = datetime.datetime(2025, 12, 1)
    rows = [(i, f"l{i % 7}", c, [1.0] * 64, at + datetime.timedelta(minutes=i)) for i, c in texts]
    return spark.createDataFrame(rows, "id long, label string, content string, embedding array<float>, created_at timestamp_ntz")


def test_share_top_k_is_brute_force_with_ties_and_blocks(spark):
    docs = {i: [f"w{(i * j) % 23}" for j in range(1, i % 9)] for i in range(-300, 900)} | {901: None, 902: []}
    asked = {q: [f"w{(q // 7 + j) % 25}" for j in range(q % 4 + 1)] for q in range(0, 900, 30)} | {5: []}
    d = spark.createDataFrame([(k, v) for k, v in docs.items()][::-1], "id long, terms array<string>").repartition(3)
    q = spark.createDataFrame(list(asked.items()), "query_id long, terms array<string>")
    for block in (1 << 16, 7):
        got = {}
        for r in share_top_k(q, d, 5, block).collect():
            assert r.n == len(asked[r.query_id])
            got.setdefault(r.query_id, []).append((-r.held, r.id))
        for a, terms in asked.items():
            best = sorted((-len({*terms} & {*(ws or [])}), i) for i, ws in docs.items() if i != a and {*terms} & {*(ws or [])})[:5]
            assert sorted(got.get(a, []))[:5] == best


def test_entity_channel_shuffles_no_pairs_and_no_words(spark):
    t = {"memories": memories(spark, [(i, f"The Alpha met Beta number{i % 3} here") for i in range(1, 801)])}
    hits = T.entity(lambda n: t[n], 4)
    assert exchanged_rows(hits) <= 8 * 4 * spark.sparkContext.defaultParallelism
    got = [(r.query_id, r.id, r["rank"]) for r in hits.collect()]
    assert len(got) == 32 and (100, 1, 1) in got and (100, 4, 2) in got  # number1, smallest id first


def test_entities_end_at_letters_beyond_ascii(spark):
    df = spark.createDataFrame([("¿Quién usa Wren?",), ("请检查heron-gateway是否",)], "c string")
    assert [r[0] for r in df.select(X.search_entities(F.col("c"))).collect()] == [["qui", "wren"], ["heron-gateway"]]


def test_lexical_channel_shuffles_no_pairs_and_equals_bm25(spark):
    from recallgrid.operators.index import bm25

    words = ["l0", "l1", "l2", "l3", "ash", "birch"]
    rows = [(i, f"l{i % 7} ash", " ".join(words[(i * j) % 6] for j in range(1, i % 11))) for i in range(1, 601)] + [(700, "ash l1", None)]
    m = spark.createDataFrame(rows, "id long, label string, content string").repartition(3)
    hits = T.lexical(lambda _: m, 5)
    assert exchanged_rows(hits) <= 7 * 5 * 4 + 7 + 100
    terms = m.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.explode(F.array_distinct(X.words(F.col("label")))).alias("term"))
    every, want = bm25(terms, m).where("query_id <> id").collect(), {}
    for r in every:
        want.setdefault(r.query_id, []).append((-round(r.score, 6), r.id))
    got = {}
    for r in hits.collect():
        got.setdefault(r.query_id, []).append((-r.score, r.id))
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v)[:5] for q, v in want.items()}


def test_second_steps_through_a_hub_are_not_formed(spark, monkeypatch):
    seeds = [(q, 1000 * q + i, 0.9 - i / 100) for q in range(5) for i in range(10)]
    pairs = [(s, 1, 0.9) for _, s, _ in seeds] + [(s, s + 500 + j, 0.5) for _, s, _ in seeds for j in (0, 100)] + [(1, 100_000 + n, 1.0) for n in range(2000)]
    few = [(9, 50, 0.8)]
    pairs += [(50, 51, 0.5), (51, 52, 0.4), (52, 53, 0.9)]
    e = spark.createDataFrame([(a, b, w) for x, y, w in pairs for a, b in ((x, y), (y, x))], "src long, dst long, w double")
    sizes, real = [], T.shared_checkpoint
    monkeypatch.setattr(T, "shared_checkpoint", lambda df: sizes.append((out := real(df)).count()) or out)
    got = T.with_neighbours(spark.createDataFrame(seeds + few, "query_id long, id long, score double"), e).collect()
    assert sizes[-1] < 200  # five queries times two thousand neighbours of the hub
    best = sorted(((r["rank"], r.id, r.via, r.score) for r in got if r.query_id == 9))
    assert best == [(1, 50, "direct", 0.8), (2, 51, "neighbor:hop1", 0.12), (3, 52, "neighbor:hop2", 0.0144)]
    assert all(sum(r.query_id == q for r in got) == 20 for q in range(5))


def test_rows_that_a_whole_table_replaces_are_put_in_as_far_as_the_best_need(spark):
    """The best eight with ``most`` are the best eight of all, and a row with 400 successors brings few to each query."""
    found = [(q, i, round(((q * 7 + i * 13) % 29) / 20, 6), "semantic") for q in range(100, 1000, 100) for i in range(1, 40 - q // 50)]
    edges = [(2, n) for n in range(-100, 300)] + [(7, n) for n in range(20, 60)] + [(n, 2) for n in range(1, 50) if n != 2] + [(11, 900), (900, 901)]
    f = spark.createDataFrame(found, "query_id long, id long, relevance double, channels string")
    e = spark.createDataFrame(edges, "o long, n long")
    whole, some = ([tuple(r) for r in T.superseded(f, e, m).collect()] for m in (None, 8))
    assert len(some) < len(whole) / 4
    for q in range(100, 1000, 100):
        first = lambda rows: sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))[:8]  # noqa: B023, E731
        assert first(some) == first(whole)


def test_rows_that_a_whole_table_replaces_come_from_lists(spark):
    """The same rows whatever counts as many, and what a hot row brings to each query isn't shuffled."""
    found = [(q, i, round(((q * 7 + i * 13) % 29) / 20, 6), "semantic") for q in range(100, 4000, 100) for i in range(1, 20)]
    edges = [(2, n) for n in range(-400, 300)] + [(7, n) for n in range(250, 600)] + [(n, 2) for n in range(1, 50) if n != 2] + [(11, 900), (900, 901), (3, -5), (4, 599)]
    f = spark.createDataFrame(found, "query_id long, id long, relevance double, channels string")
    e = spark.createDataFrame(edges, "o long, n long")
    whole, lists = (T.superseded(f, e, many=m) for m in (10_000, 30))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, lists.collect()))
    assert exchanged_rows(lists) < exchanged_rows(whole) / 3


def test_the_newest_rows_are_found_without_a_shuffle_of_vectors(spark):
    t = {"memories": memories(spark, [(i, "x") for i in range(1, 801)]).repartition(3)}
    assert exchanged_rows(T.recent(lambda n: t[n], 4)) <= 800 + 8 * 4
    assert {r.id for r in T.recent(lambda n: t[n], 200).where("query_id = 100").collect()} == set(range(601, 801))


def test_links_of_hits_shuffle_the_edges_once(spark):
    from recallgrid.plans.extended import multi_signal

    e = [(i, 1 + i % 40, 50 + i, 0.5, "similar") for i in range(1200)] + [(5000, 60, 3, 0.5, "similar"), (5001, 3, 60, None, "similar")]
    c = spark.createDataFrame(e, "id long, source_id long, target_id long, weight double, edge_type string")
    c = c.withColumns({k: F.lit(None).cast("timestamp_ntz") for k in ("created_at", "event_time", "ingestion_time", "valid_from", "valid_to")})
    m = spark.createDataFrame([(i, None, 0) for i in range(1, 90)], "id long, last_accessed timestamp_ntz, access_count long")
    t = {"connections": c, "memories": m}
    hits = spark.createDataFrame([(3, 60, 0.5), (60, 3, 0.5), (3, 61, 0.5), (3, 3, 0.5)], "query_id long, id long, score double")
    got = multi_signal(lambda n: t[n], hits)
    assert exchanged_rows(got) < 2 * 1200
    assert {(r.query_id, r.id): r.score for r in got.collect()} == {(3, 60): 0.525, (60, 3): 0.525, (3, 61): 0.45, (3, 3): 0.45}


def test_diverse_picks_among_lists_are_those_of_all_rows(spark):
    import numpy as np

    from recallgrid.operators.sequential import mmr, mmr_of_lists

    rng = np.random.default_rng(2)
    found = [(q, i, round(((q * 7 + i * 13) % 29) / 20, 6), "semantic") for q in range(100, 2000, 100) for i in range(1 + q // 1000, 20)]
    edges = [(2, n) for n in range(-400, 300)] + [(7, n) for n in range(250, 600)] + [(1, n) for n in range(500, 560)] + [(n, 2) for n in range(3, 50)]
    f = spark.createDataFrame(found, "query_id long, id long, relevance double, channels string")
    e = spark.createDataFrame(edges, "o long, n long")
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(-390, 590)], "id long, vec array<float>")
    whole = T.superseded(f, e, many=10_000)
    want = mmr(whole.select("query_id", "id", "relevance").join(v, "id"), 6, 0.7).where("rank <= 6").join(whole, ["query_id", "id"]).select("query_id", "id", "relevance", "rank")
    rows, reach, lists = T.superseded(f, e, many=30, apart=True)
    got = mmr_of_lists(rows.select("query_id", "id", "relevance"), reach, lists, v, 6, 0.7, 4)
    assert rows.count() < whole.count() / 4
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_what_is_handed_over_does_not_grow_with_the_splits_of_a_table(spark):
    """rt4_modes: a table in 32 splits gives no more candidates of each query than slots have."""
    most = 8 * 4 * spark.sparkContext.defaultParallelism
    t = {"memories": memories(spark, [(i, f"The Alpha met Beta number{i % 3} here, l{i % 7}") for i in range(1, 801)]).repartition(32)}
    for channel in (T.semantic, T.lexical, T.entity):
        hits = channel(lambda n: t[n], 4)
        assert 32 <= exchanged_rows(hits) - (800 if channel is not T.lexical else 0) <= most, channel  # 800: the split itself
        assert hits.count() == 32


def test_modes_sum_what_each_of_them_weighs(spark, monkeypatch):
    """rt4_modes: a row that no channel of a mode found is not in it, and candidates are shuffled once, not once per mode."""
    from recallgrid.plans import further

    found = [(q, 10 * i + r, c, r) for q in (100, 200) for i, c in enumerate(("semantic", "bm25", "recency", "entity", "temporal", "ppr")) for r in range(1, 4)]
    found += [(100, 1, "bm25", 1), (100, 1, "recency", 3)]
    rows = spark.createDataFrame(found, "query_id long, id long, channel string, rank long")
    monkeypatch.setattr(further, "channels", lambda t: rows)
    want = set()
    for m, ws in further._MODES.items():
        for q in (100, 200):
            f = {}
            for query, i, c, r in found:
                if query == q and c in ws:
                    f[i] = f.get(i, 0) + ws[c] / (60 + r)
            want |= {(m, q, i, n + 1) for n, i in enumerate(sorted(f, key=lambda i: (-round(f[i], 9), i))[:5])}
    df = further.rt4_modes(type("T", (), {"spark": spark})())
    assert exchanged_rows(df) <= len(found)
    assert {(r.mode, r.query_id, r.id, r["rank"]) for r in df.collect()} == want
