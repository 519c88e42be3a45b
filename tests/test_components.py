from recallgrid.operators.components import connected_components


def test_chains_stars_and_noise(spark):
    links = [(i, i + 1) for i in range(10, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (4, None), (61, 200), (200, 61)]
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 61)}, **{i: 100 for i in range(100, 140)}, 61: 61, 200: 61}


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
