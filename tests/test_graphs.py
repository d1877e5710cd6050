from tabulon.operators import tables as op


def test_reachable_has_no_bound_of_its_own(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(66)] + [(66, 0), (100, 101)], "src long, dst long").coalesce(1).cache()
    sources = spark.createDataFrame([(0,)], "node long").coalesce(1)
    assert {r["node"]: r["steps"] for r in op.reachable(edges, sources).collect()} == {i: i for i in range(67)}
    assert {r["node"] for r in op.reachable(edges, sources, 2).collect()} == {0, 1, 2}
