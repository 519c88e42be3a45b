import math
import re

import pytest
from pyspark.sql import functions as F

from recallgrid.functions import scoring as S
from recallgrid.functions import text as X
from recallgrid.functions import vectors as V


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_vectors(spark):
    r = one(spark, a=V.cosine(arr(1, 0), arr(1, 1)), b=V.cosine(arr(1, 0), arr(1, 0, 0)), c=V.cosine(arr(0, 0), arr(1, 0)), d=V.rotate(arr(1, 2, 3), 1), e=V.argmax(arr(1, 5, 5)), f=V.normalize(arr(3, 4)), g=V.normalize(arr(0, 0)),
            h=V.max_sim(F.array(arr(1, 0), arr(0, 1)), F.array(arr(1, 0))), i=V.hadamard(arr(1, 2), arr(3, 4)))
    assert (round(r.a, 6), r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i) == (0.707107, 0.0, 0.0, [3.0, 1.0, 2.0], 1, [0.6, 0.8], [0.0, 0.0], 0.5, [3.0, 8.0])


def test_scores(spark):
    now, week = F.lit("2024-01-08").cast("timestamp"), F.lit("2024-01-01").cast("timestamp")
    r = one(spark, a=S.temporal_score(now, week), b=S.effective_salience(F.lit(1.0), F.lit(0), now, now), c=S.effective_salience(F.lit(1.0), F.lit(0), F.lit("2022-01-08").cast("timestamp"), now), d=S.confidence(F.lit(3), F.lit(0.7), F.lit(0.0)),
            e=S.rrf(F.lit(2)) + S.rrf(F.lit(1), 0.9), f=S.rrf(F.lit(1), first=0), g=S.temporal_score(week, now))
    assert (round(r.a, 6), r.b, r.c, round(r.d, 6), round(r.e, 6), r.f, r.g) == (0.5, 1.0, 0.1, round(1 / (1 + math.exp(-(0.5 * math.log(4) + 0.84))), 6), 0.030883, 1 / 60, 1.0)


def test_labels(spark):
    want = {"session:abc::afe::C0": "abc", "derived:cluster:9f": "9f", "derived:cluster:12": "", None: "", "auto:x:s1:t1:u": "auto"}
    df = spark.createDataFrame([(k,) for k in want], "l string")
    assert {r.l: r.s for r in df.select("l", X.label_session(F.col("l")).alias("s")).collect()} == want
    echo = {"auto:x:s1:t1:u": True, "auto:x:s1:t1:u:p3": True, "auto:x:s1:t1:a": False, None: False, "menu": False}
    df = spark.createDataFrame([(k,) for k in echo], "l string")
    assert {r.l: r.e for r in df.select("l", X.is_echo(F.col("l")).alias("e")).collect()} == echo


def entities(text):
    found = [t for t in re.findall(r"\b[A-Za-z][A-Za-z0-9_\-]{2,}\b", text) if t[0].isupper() or any(c.isdigit() for c in t) or re.search("[a-z][A-Z]", t)]
    return list({t.lower(): t for t in reversed(found)}[k] for k in dict.fromkeys(t.lower() for t in found))


@pytest.mark.parametrize("text", ["ZephyrAlpha met zephyralpha and Zephyralpha at node7", "Après la fête, Sørvik-Amdal parle à O'Brannety", "no names here", "", "camelCase SNAKE_case kebab-Case x1 ab"])
def test_entities_against_python(spark, text):
    assert one(spark, e=X.entities(F.lit(text))).e == entities(text)


def test_tokens_numbers_intent(spark):
    r = one(spark, a=X.query_tokens(F.lit("What is the 12/2 romex a- of lot-27 about?")), b=X.numeric_tokens(F.lit("cost $1,200 vs 15GB, 15 and 1200")), c=X.intent(F.lit("What does the user prefer last week")), d=X.intent(F.lit("When was it")), e=X.intent(F.lit("how much")), f=X.intent(F.lit("hm")),
            g=X.edge_type(F.lit("this leads to"), F.lit(None).cast("string")), h=X.time_window(F.lit("gestern war es")), i=X.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))))
    assert r.a == ["12/2", "romex", "lot-27"] and r.b == ["$1200", "1200", "15"] and (r.c, r.d, r.e, r.f, r.g, r.h, round(r.i, 6)) == ("preference", "temporal", "factual", "general", "causal", 172800, 0.333333)


def test_intents(spark):
    from recallgrid.functions import text as X

    want = {
        "What does the user prefer for lunch?": "preference", "which editor does the user like": "preference", "Her favourite colour": "preference", "could you recommend a book": "preference",
        "any tips for packing?": "preference", "what would you suggest": "preference", "the user's choice": "preference", "advice about my garden": "preference", "When did the job run": "temporal", "who came in may": "temporal",
        "how many days until then": "temporal", "how many rows": "factual", "The price of it": "factual", "hello there": "general",
    }
    rows = spark.createDataFrame([(q,) for q in want], "q string")
    assert {r.q: r.i for r in rows.select("q", X.intent(F.col("q")).alias("i")).collect()} == want


def test_difference(spark):
    from recallgrid.functions import text as X

    rows = spark.createDataFrame([("[CANONICAL] takes 5 ms", "takes 6 ms"), ("it is on", "it is not on"), ("on 2024-01-02", "on 2024-01-03"), ("same", " same "), ("a", "b")], "o string, n string")
    got = [tuple(r.d) for r in rows.select(X.difference(F.col("o"), F.col("n")).alias("d")).collect()]
    assert got == [(True, False, False, True), (False, True, False, True), (True, False, True, True), (False, False, False, False), (False, False, False, True)]
