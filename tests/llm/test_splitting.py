import random

import pytest
from pyspark.sql import functions as F

from recallgrid.llm.splitting import best_cut, cut_at, file_pieces, geometry, giant_pieces, p7_files, pieces


def texts():
    rnd = random.Random(3)
    words = ["alpha", "beta.", "gamma", "δέλτα", "数据。", "café", "\n", "\n\n", "🧠", "epsilon!"]
    return {
        1: None, 2: "", 3: "short", 4: "x" * 1500, 5: "x" * 1501, 6: "x" * 9000, 7: "。".join("数据" * 30 for _ in range(90)),
        8: " ".join(rnd.choice(words) for _ in range(3000)), 9: " ".join(rnd.choice(words) for _ in range(30000)), 10: " " * 4000, 11: "a b" * 700,
    }


def brute(text, size, overlap):
    cell, zone = geometry(size, overlap)
    cuts, k = [0], 1
    while len(text) - cuts[-1] > size - overlap or len(cuts) == 1:
        cuts.append(cut_at(text, 0, k, cell, zone))
        k += 1
    ends = [*cuts[1:], len(text)]
    return [text[max(0, (ends[i - 1] if i else 0) - (overlap if i else 0)) : e] for i, e in enumerate(ends)]


@pytest.mark.parametrize("size,overlap", [(1500, 120), (50, 0), (40, 39)])
def test_pieces_against_brute_force(spark, size, overlap):
    t = texts() if size > 100 else {k: v[:700] if v else v for k, v in texts().items()}
    df = spark.createDataFrame([(k, v, "x") for k, v in t.items()], "id long, content string, piece string")
    got = {}
    for r in pieces(df, size, overlap).orderBy("id", "piece_no").collect():
        got.setdefault(r["id"], []).append(r)
    assert set(got) == {k for k, v in t.items() if v and len(v) > size}
    for k, rows in got.items():
        assert [r["piece"] for r in rows] == brute(t[k], size, overlap)
        assert [r["piece_no"] for r in rows] == list(range(1, len(rows) + 1))
        assert all(0 < r["length"] == len(r["piece"]) <= size and t[k][r["start"] : r["start"] + r["length"]] == r["piece"] for r in rows)
        ends = [0] + [r["start"] + r["length"] for r in rows]
        assert all(r["start"] == max(0, e - overlap) for r, e in zip(rows, ends))
        assert "".join(r["piece"][e - r["start"] :] for r, e in zip(rows, ends)) == t[k]


def test_boundaries_are_natural(spark):
    df = spark.createDataFrame([(1, "A sentence of some words. " * 300)], "id long, content string")
    got = [r["piece"] for r in pieces(df).orderBy("piece_no").collect()]
    assert len(got) > 5 and all(p.endswith(". ") for p in got)
    assert best_cut("ab\n\ncd. ef gh") == 4 and best_cut("ab cd. ef gh") == 7 and best_cut("abcd ef") == 5 and best_cut("abc") == 3


@pytest.mark.parametrize("range_chars", [1500, 2111, 100_000])
def test_ranges_of_giant_items_equal_whole_items(spark, range_chars):
    t = {k: v for k, v in texts().items() if v and len(v) > 1500}
    df = spark.createDataFrame(list(t.items()), "id long, content string")
    got: dict = {}
    for r in giant_pieces(df, 1500, 120, range_chars).orderBy("id", "piece_no").collect():
        got.setdefault(r["id"], []).append(r["piece"])
        assert r["piece_no"] == len(got[r["id"]])
    assert got == {k: brute(v, 1500, 120) for k, v in t.items()}


def test_files_of_a_table(spark, tmp_path):
    t = [(k, v.replace("\n", " ")) for k, v in texts().items() if v is not None] + [(99, None)]
    spark.createDataFrame(t, "id long, content string").write.parquet(f"{tmp_path}/memories.parquet")
    got = p7_files(spark, str(tmp_path), parts=3, range_bytes=30_000).collect()
    assert sum(r["chars"] for r in got) == sum(len(v) + 1 for _, v in t if v is not None) and all(0 < r["longest"] <= 1500 for r in got)


def test_empty_table(spark):
    assert pieces(spark.createDataFrame([], "id long, content string")).count() == 0


@pytest.mark.parametrize("range_bytes", [4096, 20000, 1 << 20])
def test_files_equal_columns(spark, tmp_path, range_bytes):
    t = {f"{tmp_path}/{k}": v for k, v in texts().items() if v is not None}
    for p, v in t.items():
        open(p, "w", encoding="utf-8", newline="").write(v)
    import os

    files = spark.createDataFrame([(p, os.path.getsize(p)) for p in t], "path string, n_bytes long")
    got = {}
    for r in file_pieces(spark, files, range_bytes=range_bytes).orderBy("path", "piece_no").collect():
        got.setdefault(r["path"], []).append(r["piece"])
    assert set(got) == {p for p, v in t.items() if v}
    for p, v in got.items():
        assert v == (brute(t[p], 1500, 120) if len(t[p]) > 1500 else [t[p]])
