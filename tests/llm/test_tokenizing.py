import random

import pytest

from recallgrid.llm import tokenizing as T

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    raw = open(T.default_vocabulary(), "rb").read()
    own = T.Encoder(raw)
    import tiktoken

    return own, tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def samples():
    rnd = random.Random(5)
    out = ["", " ", "\n\n", "it's  we'll\tgo", "Ünïcödé café", "数据库" * 90, "🧠⚠️👩‍👩‍👧", "x" * 5000, "ab" * 3000, "don't 12345 <|endoftext|>", "\x00​ a", "  trailing   "]
    alphabet = "abcdefgh ABC 0123 .,;'\n\té漢字🙂ض"
    return out + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(400))) for _ in range(300)]


def test_against_public_library(both):
    own, ref = both
    for s in samples():
        assert own.encode(s) == ref.encode_ordinary(s), s[:80]
    assert own.encode(None) == []


def test_both_merges_agree(both):
    own, _ = both
    rnd = random.Random(7)
    for n in (1, 2, 3, 50, 400):
        for _ in range(30):
            w = bytes(rnd.choice(b"abcdetnrs \xc3\xa9") for _ in range(n))
            assert T.merge_short(w, own.ranks) == T.merge_long(w, own.ranks)


def test_documents(spark, both):
    rows = [(i, s, "clash") for i, s in enumerate([None, "", *samples()])] + [(None, "null id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in T.encode_documents(df).collect()}
    assert len(got) == len(rows) and got[0] == [] and got[1] == []
    for i, s, _ in rows:
        if s:
            assert got[i] == both[1].encode_ordinary(s)
    assert T.encode_documents(df.limit(0)).count() == 0
