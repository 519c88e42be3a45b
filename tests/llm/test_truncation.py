import numpy as np

from recallgrid.llm import truncation as T

SENTENCES = ["The night job stored the weekly summary after the restart.", "Nobody had read the routing hint for weeks.", "A worker moved the entity index while the queue was draining.", "The planner kept the session label for the next cycle."]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cut string"


def corpus():
    rows = []
    for i in range(160):
        text = " ".join(SENTENCES[(i + k) % 4] for k in range(4))
        rows.append((i, text, "en", f"s{i % 4}", len(text), "clash"))
    return rows


def test_cut_and_complete(spark):
    cut = {1000: "Nobody had read the routing hint for weeks. The night job sto", 1001: SENTENCES[2] + " A worker moved the", 1002: SENTENCES[2] + " The planner kept the ses…", 1003: SENTENCES[1] + " A worker mov [more]", 1004: SENTENCES[0] + " Nobody had re\n"}
    full = {2000: SENTENCES[0][:-1], 2001: " ".join(SENTENCES[:2]) + "  \n", 2002: SENTENCES[3] + " [end]"}
    rows = corpus() + [(i, t, None, None, None, "") for i, t in {**cut, **full}.items()] + [(3000, None, "en", "s", 1, ""), (3001, "", "en", "s", 1, ""), (3002, " \n", "en", "s", 1, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.cut for r in T.cut_texts(df).collect()}
    assert {i for i, c in got.items() if c} >= set(cut)
    assert not any(got[i] for i in (2000, 2001, *range(160)))
    assert not {3000, 3001, 3002} & set(got)
    rep = {r.source: r.cut_texts for r in T.source_report(T.cut_texts(df)).collect()}
    assert rep["s0"] == 0 and rep[None] >= len(cut)


def test_empty_table_and_long_text(spark):
    assert T.cut_texts(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "word " * 100000, "en", "s", 1, ""), (1, "word " * 100000, "en", "s", 1, "")], SCHEMA)
    assert T.cut_texts(df).count() >= 1


def hits_of(parts, text):
    """Counts of the contexts of ``text``, of which a filter holds all."""
    h = np.array(sorted({h for i in range(len(text)) for h in T.final_hashes([text[: i + 1]])[0] if h is not None}), np.int64).view(np.uint64)
    bits = np.zeros(1 << 20, np.uint64)
    one = np.uint64(1)
    np.bitwise_or.at(bits, ((h >> one) & np.uint64(len(bits) - 1)).astype(np.int64), (one << (h >> np.uint64(58))) | (one << ((h >> np.uint64(52)) & np.uint64(63))))
    v, n = T._runs(np.concatenate(list(T._hits(parts, bits))))
    asked = set(h.view(np.uint64).tolist())
    return {k: c for k, c in zip(v.tolist(), n.tolist(), strict=True) if k & ~1 in asked}


def test_slices_count_every_place_once(monkeypatch):
    text = " ".join(SENTENCES * 30)
    whole = hits_of([(text, 0, False)], text)
    monkeypatch.setattr(T, "SLICE", 700)
    parts = list(T.slices(text))
    assert sum(len(p) - done - (T.AFTER if more else 0) for p, done, more in parts) == len(text) and len(parts) > 5
    assert hits_of(parts, text) == whole
    apart: dict = {}
    for p in parts:
        for k, n in hits_of([p], text).items():
            apart[k] = apart.get(k, 0) + n
    assert apart == whole


def test_counts_equal_a_plain_count(spark):
    rows = corpus()[:40] + [(5000, " ".join(SENTENCES * 30), "en", "s", 1, ""), (5001, "", "en", "s", 1, ""), (5002, None, "en", "s", 1, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    finals = T.final_contexts(df).collect()
    asked = spark.createDataFrame([(h, h) for h in {h for f in finals for h in f.ctx if h is not None}], "h long, k long")
    got = {r.h: (r.ends, r.goes) for r in T.count_contexts(df, asked).collect()}
    want: dict = {}
    for _, text, *_ in rows:
        if text:
            e = T.ends_after(T.codes_of(text))
            for i in range(len(text)):
                for h in T.final_hashes([text[: i + 1]])[0]:
                    if h is not None:
                        a, b = want.get(h, (0, 0))
                        want[h] = (a + int(e[i]), b + int(not e[i]))
    for r in asked.collect():
        assert got[r.h] == want[r.h]


def test_several_passes_count_the_same(spark, monkeypatch):
    df = spark.createDataFrame(corpus()[:30], SCHEMA)
    asked = T.asked_contexts(T.final_contexts(df)).select("h", "k").distinct()
    hs = {r.h for r in asked.collect()}
    one = {tuple(r) for r in T.count_contexts(df, asked).collect() if r.h in hs}
    monkeypatch.setattr(T, "filter_shape", lambda n: (64, 4))
    assert {tuple(r) for r in T.count_contexts(df, asked).collect() if r.h in hs} == one and one


def test_filter_grows_with_the_contexts():
    assert T.filter_shape(0) == (64, 1) and T.filter_shape(1_000_000) == (1 << 18, 1)
    words, passes = T.filter_shape(1_000_000_000)
    assert words == T.MOST_WORDS and words * passes * 64 >= 1_000_000_000 * T.FILTER_BITS


def test_final_hashes_are_those_of_the_last_place():
    texts = ["user: the night job", "a", "Tags: amber, wren", "two\nlines of 25 words here", "数据库的内容", "x" * 50, "bro\ufffd"]
    for text, got in zip(texts, T.final_hashes(texts), strict=True):
        codes = T.codes_of(text)
        c, last = T.Contexts(codes), np.array([len(text) - 1])
        line = max(text.rfind("\n"), text.rfind("\r")) + 1
        one = lambda h: int((h & ~np.uint64(1)).view(np.int64)[0])
        want = [one(c.plain(n, last)) if len(text) >= n else None for n in T.LENGTHS]
        want += [one(c.headed(n, last, np.array([line + T.HEAD - 1]))) if len(text) >= n and len(text) - line >= T.HEAD else None for n in T.HEADED]
        want.append(one(c.plain(1, last)) if text.endswith("\ufffd") else None)
        assert got == want, text


def test_a_broken_character_is_a_cut(spark):
    rows = corpus() + [(7000, SENTENCES[0] + " Nobody had\ufffd", "en", "s", None, ""), (7001, SENTENCES[0] + "\n\ufffd", None, None, None, "")]
    cut = {r.doc_id: r.cut for r in T.cut_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert cut[7000] and cut[7001]


def test_marks():
    assert T.core_of("the plan… \n") == ("the plan", True) and T.core_of("the pl [more] ... ") == ("the pl", True) and T.core_of("done. [end]") == ("done. [end]", False)
    assert T.core_of("x" + " " * 300_000 + "y") == ("x" + " " * 300_000 + "y", False)


def test_hashes_depend_on_the_last_points_only():
    a, b = "some text that ends in the same words", "other beginnings ends in the same words"
    ha, hb, short = T.final_hashes([a, b, "words"])
    for k, n in enumerate(T.LENGTHS):
        assert (ha[k] == hb[k]) == (a[-n:] == b[-n:])
    assert short[1] == ha[1] and short[2] is None


def test_ends():
    text = 'One two. Three "four." 0.25 five!\nsix'
    e = T.ends_after(T.codes_of(text))
    at = lambda part: e[text.index(part) + len(part) - 1]
    assert at("two") and at("two.") and at("four") and at("five") and at("five!") and at("six")
    assert not at("One") and not at("Three") and not at("0") and not at("0.") and not at("si")
