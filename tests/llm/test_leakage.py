import random

import pytest

from recallgrid.llm import leakage as L

ITEM = "Where does the narrow drawer that buries a foreign turnstile also recount garnet-watcher without the sunken aqueduct near shard eight hundred"
W = ITEM.split()


def brute(pattern, text):
    """Semi-global edit distance over words."""
    prev, best = [0] * (len(text) + 1), len(pattern)
    for i, w in enumerate(pattern, 1):
        cur = [i]
        for j, t in enumerate(text, 1):
            cur.append(min(prev[j - 1] + (w != t), prev[j] + 1, cur[j - 1] + 1))
        prev = cur
    return min(best, min(prev))


def test_myers_against_dynamic_programming():
    rnd = random.Random(1)
    for _ in range(400):
        p = [rnd.choice("abcd") for _ in range(rnd.randrange(1, 14))]
        t = [rnd.choice("abcd") for _ in range(rnd.randrange(0, 30))]
        peq = {}
        for i, w in enumerate(p):
            peq[w] = peq.get(w, 0) | 1 << i
        assert L.myers(peq, len(p), t) == brute(p, t)


CASES = [
    (" ".join(W), True), (" ".join(W).upper(), True), ("xx " + " ".join(W[3:15]) + " yy", True), (" ".join(W[3:14]), False), (" ".join(W[3:9]), False),
    ("> " + " ".join(W[:7]) + "\n>  " + " ".join(W[7:]), True), (" ".join(f"*{w}*," for w in W), True), (" ".join(W).replace("e", "е").replace("a", "а"), True),
    (" ".join(w[:2] + "​" + w[2:] for w in W), True), (" ".join(W).replace(" ", " "), True), (" ".join(W).replace("garnet-watcher", "garnet watcher"), True),
    (" ".join("perhaps" if i in (5, 12) else w for i, w in enumerate(W)), True), (" ".join(w for i, w in enumerate(W) if i not in (5, 12)), True),
    (" ".join(w + " quite" if i in (5, 12) else w for i, w in enumerate(W)), True), (" ".join("perhaps" if i % 5 in (3, 4) else w for i, w in enumerate(W)), False),
    (" ".join(sorted(W)), False), (" ".join(reversed(W)), False), (" ".join(W[:6]) + " something else entirely stands here " + " ".join(W[6:12]), False), ("", False),
]


@pytest.mark.parametrize("text,want", CASES)
def test_passages(text, want):
    assert bool(L.Index([(1, ITEM), (2, "too short to leak")]).leaked(text)) is want


def test_blocks_nulls_and_repeats(spark):
    items = spark.createDataFrame([(1, ITEM, None), (2, None, "x"), (3, "", None), (4, ITEM.replace("drawer", "box"), None)], "item_id long, item_text string, doc_id string")
    docs = spark.createDataFrame([(10, ITEM), (10, ITEM), (11, None), (12, ""), (13, "word " * 200000), (14, "tail " * 5000 + ITEM)], "doc_id long, text string")
    want = {(10, 1), (10, 4), (14, 1), (14, 4)}
    for chars in (L.BLOCK_CHARS, 50):
        assert {tuple(r) for r in L.leaks(docs, items, chars).collect()} == want
    assert L.leaks(docs, items.limit(0)).count() == 0 and L.leaks(docs.limit(0), items).count() == 0
    assert {r.item_id: r.docs for r in L.item_report(L.leaks(docs, items), items).collect()} == {1: 2, 2: 0, 3: 0, 4: 2}
