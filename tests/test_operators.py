from datetime import datetime as D

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recallgrid.functions import text as X
from recallgrid.operators import dream, search
from recallgrid.operators import edges as E
from recallgrid.operators import graph as G
from recallgrid.operators import sequential as Q
from recallgrid.operators.index import bm25
from recallgrid.operators.orphans import CHUNK, KEYS_PER_WORD, filter_words, orphan_references, orphan_report
from recallgrid.operators.skew import global_order, hot_keys, lookup_join

CONN = "id long, source_id long, target_id long, weight double, edge_type string, created_at timestamp_ntz, event_time timestamp_ntz, ingestion_time timestamp_ntz, valid_from timestamp_ntz, valid_to timestamp_ntz"


def conns(spark, rows):
    return spark.createDataFrame([(i, a, b, w, k, None, None, None, None, None) for i, (a, b, w, k) in enumerate(rows)], CONN)


def both(spark, rows):
    return spark.createDataFrame([x for a, b, w in rows for x in ((a, b, w), (b, a, w))], "src long, dst long, w double")


def test_upsert_is_canonical(spark):
    nan = float("nan")
    got = E.upsert(E.clean_edges(conns(spark, [(2, 1, 0.4, "similar"), (1, 2, 0.9, " Similar"), (1, 1, 0.5, "similar"), (1, 3, nan, "similar"), (1, 4, 1.7, None), (5, 4, 0.3, "SUPERSEDES"), (None, 4, 0.3, "x")]))).collect()
    assert {(r.s, r.t, r.edge_type, r.weight) for r in got} == {(1, 2, "similar", 0.9), (1, 4, "similar", 1.0), (5, 4, "supersedes", 0.3)}


def test_validity_is_closed(spark):
    row = (1, 1, 2, 0.77, "causal", None, D(2024, 1, 1), None, D(2024, 1, 2), D(2024, 1, 22))
    df = spark.createDataFrame([row], CONN)
    at = lambda d: df.where(E.valid_at(F.lit(d).cast("timestamp_ntz"))).count()
    assert [at(x) for x in ("2024-01-01", "2024-01-02", "2024-01-22", "2024-01-22 00:00:01")] == [0, 1, 1, 0]


def test_activation_and_hops(spark):
    g = both(spark, [(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.7)])
    got = {r.id: round(r.act, 6) for r in G.activation(g, spark.createDataFrame([(1, 1.0)], "id long, act double")).collect()}
    assert got == {2: 0.765, 3: 0.5202, 4: 0.309519}
    assert {r.id: r.hop for r in G.hops(g, spark.createDataFrame([(1,)], "id long"), 2).collect()} == {1: 0, 2: 1, 3: 2}


def test_pagerank_against_numpy(spark):
    rows = [(1, 2, 0.9), (2, 3, 0.8), (3, 1, 0.2), (3, 4, 0.5), (5, 6, 0.3)]
    got = {r.id: r.score for r in G.pagerank(both(spark, rows), spark.createDataFrame([(1, 1.0)], "id long, share double"), rounds=7).collect()}
    a = np.zeros((7, 7))
    for i, j, w in rows:
        a[i, j] = a[j, i] = w
    p = np.divide(a, a.sum(1, keepdims=True), out=np.zeros_like(a), where=a.sum(1, keepdims=True) > 0)
    x = np.eye(7)[1]
    for _ in range(7):
        x = 0.85 * x @ p + 0.15 * np.eye(7)[1]
    x /= x.max()
    assert set(got) == {1, 2, 3, 4} and all(abs(got[i] - x[i]) < 1e-9 for i in got)


def test_link_prediction_and_modularity(spark):
    g = both(spark, [(1, 2, 1.0), (2, 3, 1.0)])
    r = G.two_hop(g, spark.createDataFrame([(1,)], "id long")).collect()
    assert [(x.query_id, x.id, x.common, round(x.aa, 6)) for x in r] == [(1, 3, 1, 1.442695)]
    rng = np.random.default_rng(3)
    e = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 25, (120, 2)).tolist() if a != b} | {(0, k) for k in range(1, 25)}
    near = {n: {b for a, b in e if a == n} | {a for a, b in e if b == n} for n in range(25)}
    got = {(x.a, x.b): (x.common, round(x.aa, 6)) for x in G.shared_by_edge(spark.createDataFrame([(a, b, 1.0) for a, b in e], "a long, b long, w double")).collect()}
    assert got == {(a, b): (len(c), round(sum(1 / np.log(len(near[m])) for m in c), 6)) for a, b in e if (c := near[a] & near[b])}
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (1, 3, 0.9), (4, 5, 0.9), (5, 6, 0.9), (4, 6, 0.9), (3, 4, 0.08)], "a long, b long, w double")
    roots = spark.createDataFrame([(i, 1) for i in range(1, 7)], "id long, root long")
    labels = Q.louvain(pairs, roots)
    assert {r.id: r.label for r in labels.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert G.modularity(pairs, labels) > 0.4 > G.modularity(pairs, roots.select("id", F.col("root").alias("label")))


def test_cycle_order(spark):
    e = spark.createDataFrame([(1, 2, "similar", 0.98), (1, 3, "similar", 0.055), (1, 4, "supersedes", 0.04), (1, 5, "similar", 0.04)], "s long, t long, edge_type string, weight double")
    out = dream.nrem(dream.State(spark.range(0), e), spark.createDataFrame([(1, 2)], "s long, t long"))
    assert {(r.t, round(r.weight, 6)) for r in out.edges.collect()} == {(2, 0.99), (4, 0.04)}
    assert [(r.old_weight, r.new_weight) for r in out.history.collect()] == [(0.98, 1.0)]


def test_bridges_only_where_no_edge_is(spark):
    hits = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (3, 1, 0.5), (1, 4, 0.99), (1, 5, 0.2)], "query_id long, id long, sim double")
    e = spark.createDataFrame([(2, 1, "supersedes", 0.5)], "s long, t long, edge_type string, weight double")
    assert [(r.s, r.t, r.edge_type, r.weight) for r in dream.bridges(hits, e).collect()] == [(1, 3, "bridge", 0.15)]


def test_search_against_numpy_in_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    for block in (5, 2048):
        got = {(r.query_id, r["rank"]): r.id for r in search.top_k(df.where("id % 4 = 0"), df, 5, 8, block=block).collect()}
        for q in range(0, 60, 4):
            want = [j for j in np.lexsort((np.arange(60), -s[q])) if j != q][:5]
            assert [got[q, k] for k in range(1, 6)] == want
    assert search.top_k(df.limit(0), df, 5, 8).count() == 0


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([(1, "zephyr launch code"), (2, "pet food code"), (3, "work code work"), (4, None)], "id long, content string")
    terms = spark.createDataFrame([(9, "zephyr"), (9, "code")], "query_id long, term string")
    r = bm25(terms, docs).orderBy(F.desc("score")).collect()
    assert r[0].id == 1 and len(r) == 3


def test_diversity_and_chunks():
    x = np.array([[1, 0], [1, 0.01], [0, 1]])
    assert Q.diversify(np.arange(3), np.array([1.0, 0.9, 0.5]), x, 2, 0.5) == [0, 2, 1]
    assert Q.diversify(np.arange(3), np.array([1.0, 0.9, 0.5]), x, 3, 1.0) == [0, 1, 2]


def chunks_by_hand(text, size, overlap):
    """The same rules one sentence at a time."""
    if len(text) <= size:
        return [text]
    import re

    whole = [[]]
    for s in filter(str.strip, re.split(r"(?<=[.!?])\s+", text.strip())):
        if whole[-1] and len(" ".join([*whole[-1], s])) > size:
            whole.append([])
        whole[-1].append(s)
    whole = [" ".join(w) for w in whole]
    out, reach = whole[:1], min(overlap, max(1, size // 2))
    for before, chunk in zip(whole, whole[1:]):
        tail = before[-reach:]
        if tail.strip() == chunk[:reach].strip():
            tail = before[-max(1, len(before) // 4) :]
            at = tail.strip().find(" ")
            tail = tail[at + 1 :] if at >= 0 else tail
        elif tail.find(" ") > 0:
            tail = tail[tail.find(" ") + 1 :]
        out.append(f"{tail} {chunk}".strip())
    return out


def test_chunks_equal_those_made_by_hand(spark):
    long = " ".join(f"Sentence number {i} says {'very ' * (i % 9)}little!" for i in range(90))
    texts = ["short", long, "word " * 300 + "end.", "One two. " * 200, "same tail here. same tail here. " * 8, "a. " * 400, None, "  ", "Ünïcode ümlaut. 数据库。 " * 60, "x" * 700 + ". " + "y" * 700 + "."]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    for size, overlap in ((512, 64), (60, 40), (40, 0)):
        got: dict = {}
        for r in Q.sentence_chunks(df, "k", "t", size, overlap).orderBy("id", "chunk_no").collect():
            got.setdefault(r.id, []).append(r.chunk)
            assert r.chunk_no == len(got[r.id]) <= r.n_chunks
        for k, t in enumerate(texts):
            want = [] if not t or not t.strip() else chunks_by_hand(t, size, overlap) if overlap or len(t) <= size else None
            if want is not None:
                assert got.get(k, []) == want, (k, size)


def test_markdown_facts():
    text = "## **Bay Medical**\n- **Cost**: $70\n- Phone number: 850 718-2000\n- Note: $5\n* Opening hours: whenever\n**Zed Hall** - built 2019-04-05; later\n**plain** word\n- **cost**: $70\nThe end"
    assert Q.facts_of(text) == [
        ("Bay Medical", "Cost", "$70", "Bay Medical, Cost: $70"), ("Bay Medical", "Phone number", "850 718-2000", "Bay Medical, Phone number: 850 718-2000"),
        ("Bay Medical", "Opening hours", "whenever", "Bay Medical, Opening hours: whenever"), ("Zed Hall", None, "built 2019-04-05", "Zed Hall: built 2019-04-05"), ("cost", None, "$70", "cost: $70"),
    ]
    assert Q.facts_of("- **k**: the user prefers it") == [] and Q.facts_of("- user name: Ann Lee") == [] and Q.facts_of("- User name: Ann Lee") == [(None, "User name", "Ann Lee", "User name: Ann Lee")]
    assert Q.facts_of(None) == [] == Q.facts_of("***") == Q.facts_of("**a** b **c**: plain prose")
    assert Q.facts_of("- Version: 1.2.3\n- version: 1.2.3") == [(None, "Version", "1.2.3", "Version: 1.2.3")]


def test_atomic_facts_of_both_engines(spark):
    texts = ["user likes tea", "The user sleeps", "plain prose here", "It costs $5", "about 5 kg", "in 3 hours", "call (850) 718-2000", "v 1.26.0 now", "on 2024/9/15", "Ann Lee came", "ok", "x" * 281 + " $5", "99 monkeys"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.a for r in df.select("t", X.atomic(F.col("t")).alias("a")).collect()}
    assert got == {t: Q.is_atomic(t) for t in texts}
    assert [t for t in texts if not got[t]] == ["plain prose here", "in 3 hours", "ok", "x" * 281 + " $5"]  # 99 m(onkeys) is a measure to the rule


@pytest.mark.parametrize("n", [0, 1, 100, 10**6, 10**9])
def test_filter_grows_with_the_keys(n):
    words = filter_words(n)
    assert words >= CHUNK and words & (words - 1) == 0 and words * KEYS_PER_WORD >= n and words <= max(CHUNK, n)


@pytest.mark.parametrize("most", [0, 1 << 24])
def test_filter_never_denies_a_key(spark, monkeypatch, most):
    from recallgrid.operators import orphans as O

    monkeypatch.setattr(O, "MAX_WORDS", most)  # 0: joined by shuffle
    keys = spark.range(0, 20000, 2).withColumnRenamed("id", "k")
    words = filter_words(10000)
    got = O.may_hold(spark.range(20000), "id", O.bloom_filter(keys, "k", words), words)
    wrong = got.where("id % 2 = 1 and maybe").count()
    assert got.where("id % 2 = 0 and not maybe").count() == 0 and got.count() == 20000 and wrong < 600


def test_orphans_of_a_hot_key_and_many_keys(spark, monkeypatch):
    from recallgrid.operators import orphans as O

    parents = spark.range(100).select("id", F.lit(D(2024, 6, 1)).alias("created_at"))
    refs = spark.range(6000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, 5000).otherwise(F.col("id") % 120).alias("ref_id"), F.when(F.col("id") % 2 == 0, F.lit(D(2024, 1, 1))).otherwise(F.lit(D(2025, 1, 1))).alias("row_time"))
    removed = spark.createDataFrame([(5000,), (110,)], "memory_id long")
    want: dict = {}
    for i in range(6000):
        r = 5000 if i % 3 == 0 else i % 120
        s = ("late" if i % 2 == 0 else None) if r < 100 else "deleted" if r in (5000, 110) else "missing"
        if s:
            want[i] = s
    for most in (1_000_000, 0):
        monkeypatch.setattr(O, "MOST_KEYS", most)
        assert {r.row_id: r.ref_state for r in orphan_references(refs, parents, removed).collect()} == want


def test_orphans(spark):
    parents = spark.createDataFrame([(1, D(2024, 1, 1)), (2, None), (3, D(2025, 1, 1)), (3, D(2025, 6, 1)), (None, None)], "id long, created_at timestamp")
    removed = spark.createDataFrame([(7,), (7,), (None,)], "memory_id long")
    rows = [("c", 1, "f", 1, D(2024, 5, 1)), ("c", 2, "f", 2, D(2020, 1, 1)), ("c", 3, "f", 3, D(2024, 5, 1)), ("c", 4, "f", 7, D(2024, 5, 1)), ("c", 5, "f", 8, D(2024, 5, 1)), ("c", 6, "f", None, D(2024, 5, 1)), ("c", 7, "f", 3, None), ("c", 5, "f", 8, D(2024, 5, 1))]
    refs = spark.createDataFrame([(*r, "clash") for r in rows], "tab string, row_id long, fld string, ref_id long, row_time timestamp, word string").drop("word")
    found = orphan_references(refs, parents, removed)
    assert sorted((r.row_id, r.ref_state) for r in found.collect()) == [(3, "late"), (4, "deleted"), (5, "missing"), (5, "missing")]
    assert {(r.ref_state, r.refs, r.ids) for r in orphan_report(found).collect()} == {("late", 1, 1), ("deleted", 1, 1), ("missing", 2, 1)}
    none = orphan_references(refs, parents.limit(0), removed.limit(0))
    assert {r.ref_state for r in none.collect()} == {"missing"} and none.count() == 7
    assert orphan_references(refs.limit(0), parents, removed).count() == 0


def test_hot_keys_and_lookup(spark):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)] + [(None, -1)], "k long, v long")
    right = spark.createDataFrame([(1, "one"), (3, "three"), (9999, "x")], "k long, name string")
    assert [r.k for r in hot_keys(left, "k").collect()] == [1]
    got = lookup_join(left, right, "k")
    assert got.count() == 3001 and got.where("name = 'one'").count() == left.where("k = 1").count() and got.where("name = 'three'").count() == 1


def test_global_order(spark):
    df = spark.createDataFrame([(i % 2, -i) for i in range(1000)], "a long, b long")
    got = global_order(df, ["a", "b"]).orderBy("pos").collect()
    assert [(r.a, r.b) for r in got] == sorted((i % 2, -i) for i in range(1000)) and [r.pos for r in got] == list(range(1000))
    assert global_order(df.limit(0), ["a", "b"]).count() == 0


def test_smoothed_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "id long, vec array<double>")
    got = {r.id: [round(x, 6) for x in r.vec] for r in dream.smoothed(rows, both(spark, [(1, 2, 0.5)]), dim=2).collect()}
    n = (0.4**2 + 0.6**2) ** 0.5
    assert got == {1: [round(0.4 / n, 6), round(0.6 / n, 6)], 2: [round(0.6 / n, 6), round(0.4 / n, 6)], 3: [1.0, 0.0]}


def test_mmr_per_query(spark):
    hits = spark.createDataFrame(pd.DataFrame({"query_id": [1, 1, 1, 2], "id": [5, 6, 7, 5], "relevance": [1.0, 0.9, 0.5, 1.0], "vec": [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0], [1.0, 0.0]]}))
    assert {(r.query_id, r["rank"]): r.id for r in Q.mmr(hits, 2, 0.5).collect()} == {(1, 1): 5, (1, 2): 7, (1, 3): 6, (2, 1): 5}


def test_missing_links_through_hubs_are_those_of_all_pairs(spark):
    """Whatever counts as a hub, the ten best are the same; the neighbours of a hub aren't paired as rows."""
    from recallgrid.operators.linking import missing_links

    rng = np.random.default_rng(5)
    e = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 300, (500, 2)).tolist() if a != b} | {(1, k) for k in range(2, 200)} | {(2, k) for k in range(100, 290)}
    x = {i: v / np.linalg.norm(v) for i, v in enumerate(rng.normal(size=(280, 8)))}
    near = {n: {b for a, b in e if a == n} | {a for a, b in e if b == n} for n in range(300)}
    want = {}
    for q in range(0, 300, 7):
        rows = []
        for i in range(300):
            if i != q and i not in near[q] and (both := near[q] & near[i]):
                part, aa = len(both) / min(len(near[q]), len(near[i])), sum(1 / np.log(len(near[m])) for m in both)
                emb = float(x[q] @ x[i]) if q in x and i in x else 0.0
                rows.append((-round(0.3 * part + 0.4 * aa + 0.3 * emb, 6), i, len(both), "adamic_adar" if aa >= part and aa >= emb else "embedding" if emb >= part else "common_neighbors"))
        want[q] = [r for r in sorted(rows) if -r[0] > 0.1][:5]
    g = spark.createDataFrame([p for a, b in e for p in ((a, b), (b, a))], "src long, dst long").repartition(3)
    v = spark.createDataFrame([(i, [float(a) for a in u]) for i, u in x.items()], "id long, vec array<double>")
    asked = g.where("src % 7 = 0").select(F.col("src").alias("id"))
    for degree, block in ((10_000, 1 << 16), (100, 1 << 16), (12, 9)):
        got = {}
        for r in missing_links(g, asked, v, 8, 5, 0.1, 0.0, degree, block).collect():
            got.setdefault(r.query_id, []).append((-r.score, r.id, r.common, r.method))
        assert {q: sorted(rows)[:5] for q, rows in got.items()} == {q: rows for q, rows in want.items() if rows}
