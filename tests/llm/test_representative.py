from datetime import datetime as D

from recallgrid.llm.representative import best_edges

SCHEMA = "id long, source_id long, target_id long, weight double, edge_type string, created_at timestamp, row string"


def edges(spark, rows):
    return {(r.lo_id, r.hi_id): r for r in best_edges(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_fields_come_from_their_best_rows(spark):
    nan = float("nan")
    rows = [
        (1, 1, 2, 0.5, "similar", D(2024, 5, 1), ""), (2, 2, 1, nan, "Derived-From ", D(2025, 5, 1), ""), (3, 1, 2, 0.7, None, None, ""),
        (4, 3, 4, None, "?", None, ""), (5, 4, 3, 2.0, "edge", D(1970, 1, 1), ""),
        (6, 5, 6, 0.0, "BEFORE", D(2024, 1, 1), ""), (7, 5, 6, 1.0, "bridge", D(2024, 1, 1), ""), (7, 5, 6, 1.0, "bridge", D(2024, 1, 1), ""),
        (8, 7, 7, 1.0, "bridge", D(2024, 1, 1), ""), (9, None, 7, 1.0, "bridge", D(2024, 1, 1), ""), (10, 8, 9, 1.0, "bridge", D(2024, 1, 1), ""),
    ]
    got = edges(spark, rows)
    assert set(got) == {(1, 2), (3, 4), (5, 6)}
    a, b, c = got[1, 2], got[3, 4], got[5, 6]
    assert (a.weight_row, a.edge_type_row, a.created_at_row, a.weight, a.edge_type) == (1, 2, 2, 0.5, "derived_from")
    assert (b.weight_row, b.edge_type_row, b.created_at_row, b.weight) == (-1, -1, -1, None)
    assert (c.weight_row, c.edge_type_row, c.created_at_row, c.n_rows) == (7, 7, 7, 3)


def test_empty_and_hot_pair(spark):
    assert edges(spark, []) == {}
    got = edges(spark, [(i, 1 + i % 2, 2 - i % 2, 0.5, "similar", D(2024, 1, 1), "") for i in range(5000)])
    assert got[1, 2].weight_row == 4999 and got[1, 2].n_rows == 5000
