"""Orders, ranks and graphs of the table operators against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tabulon.operators import tables as op


def test_sort_key_folds_case(spark):
    df = spark.createDataFrame([("b",), ("A",), ("B",), ("a",), (None,)], "s string")
    assert [r["s"] for r in df.orderBy(op.sort_key(df, "s"), "s").collect()] == [None, "A", "a", "B", "b"]
    assert [r["s"] for r in df.orderBy(op.sort_key(df, "s", case_sensitive=True)).collect()] == [None, "A", "B", "a", "b"]
    n = spark.createDataFrame([(10,), (9,)], "n int")
    assert [r["n"] for r in n.orderBy(op.sort_key(n, "n")).collect()] == [9, 10]
    assert [r["s"] for r in df.where("s is not null").orderBy(op.sort_key(df, "s", custom=["b", "a"]), "s").collect()] == ["b", "a", "A", "B"]


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("ranges", [1, 7, 256])
def test_ranks(spark, monkeypatch, by, ranges):
    monkeypatch.setattr(op, "RANGES", ranges)
    rng = random.Random(3)
    rows = [(i, rng.choice(["x", "y", None]), rng.choice([None, *map(float, range(40)), 0.5, 1e9])) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, g string, v double")
    got = {r["i"]: r for r in df.join(op.value_ranks(df, "v", by=tuple(by)), [*by, "v"], "left").collect()} if not by else None
    groups = {}
    for i, g, v in rows:
        if v is not None:
            groups.setdefault(g if by else 0, []).append(v)
    ranked = {(r["g"] if by else 0, r["v"]): r for r in op.value_ranks(df, "v", by=tuple(by)).collect()}
    up = {(r["g"] if by else 0, r["v"]): r["rank_eq"] for r in op.value_ranks(df, "v", True, tuple(by)).collect()}
    share = {(r["g"] if by else 0, r["v"]): r for r in op.value_percents(df, "v", by=tuple(by)).collect()}
    assert len(ranked) == sum(len(set(vs)) for vs in groups.values())
    for (g, v), r in ranked.items():
        vs = groups[g]
        assert r["rank_eq"] == 1 + sum(x > v for x in vs) and r["rank_avg"] == r["rank_eq"] + (vs.count(v) - 1) / 2
        assert up[g, v] == 1 + sum(x < v for x in vs)
        assert share[g, v]["rank_inc"] == pytest.approx(int(sum(x < v for x in vs) / (len(vs) - 1) * 1000 + 1e-9) / 1000)
    assert got is None or all(got[i]["rank_eq"] == (ranked[0, v]["rank_eq"] if v is not None else None) for i, _, v in rows)
    assert op.value_ranks(df.limit(0), "v", by=tuple(by)).count() == 0


def test_numbered(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.randint(0, 50), i) for i in range(300)], "a int, b int")
    rows = op.numbered(df, [F.col("a"), F.col("b")], F.floor(F.col("a") / 7), "no").collect()
    assert [(r["a"], r["b"]) for r in sorted(rows, key=lambda r: r["no"])] == sorted((r["a"], r["b"]) for r in rows) and sorted(r["no"] for r in rows) == list(range(1, 301))


def test_reachable_runs_to_the_end_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(70, 0), (200, 201)], "src int, dst int")
    seen = {r["node"]: r["steps"] for r in op.reachable(edges, spark.createDataFrame([(0,)], "node int")).collect()}
    assert seen == {i: i for i in range(71)}


@pytest.mark.parametrize("by", [[], ["g"]])
def test_order_statistics_of_large_groups(spark, by):
    from tabulon.plans import formula as fx

    rng = random.Random(5)
    rows = [(rng.choice(["x", "y", None, "z"]), rng.choice([None, *map(float, range(9)), 0.25]), "t") for _ in range(300)] + [("one", 4.0, "t"), ("none", None, "t")]
    df = spark.createDataFrame(rows, "g string, v double, t string")
    f = {"m": "=MEDIAN(v)", "p": "=PERCENTILE(v,0.3)", "q": "=QUARTILE.INC(v,3)", "e": "=PERCENTILE.EXC(v,0.4)", "qe": "=QUARTILE.EXC(v,1)", "s": "=SMALL(v,2)", "l": "=LARGE(v,3)", "t": "=TRIMMEAN(v,0.3)", "x": "=IFERROR(ROUND(MEDIAN(v+1)*2,3)+SUM(v),-1)", "n": "=COUNT(v)", "bad": "=IFERROR(SMALL(v,999),-7)"}
    key = lambda r: str([r[b] for b in by])
    small = {key(r): r for r in fx.summarize(df, f, by, large_groups=False).collect()}
    large = {key(r): r for r in fx.summarize(df, f, by, large_groups=True).collect()}
    assert set(small) == set(large)
    for k, r in small.items():
        for c in f:
            assert large[k][c] == (pytest.approx(r[c]) if r[c] is not None else None), (k, c)
