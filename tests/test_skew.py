import math

from weftgraph.operators.hotcold import hot_cold_join, salted_join
from weftgraph.operators.skew import balanced_profile, both_ends, heavy_keys


def test_profile_of_heavy_and_light_keys(spark):
    rows = [(1, i, float(i), "x") for i in range(500)] + [(2, 1000, None, "x"), (3, 1001, math.nan, "y"), (3, 1002, 2.0, "y"), (None, 1003, 1.0, "z")]
    df = spark.createDataFrame(rows, "k long, o long, v double, n string")
    got = {r.k: r for r in balanced_profile(df, ["k"], "o", "v", 7).collect()}
    assert (got[1].n, got[1].sum_value, got[1].min_value, got[1].max_value, got[1].first_order, got[1].last_order) == (500, sum(range(500)), 0.0, 499.0, 0, 499)
    assert (got[2].n, got[2].n_value, got[2].sum_value) == (1, 0, None)
    assert (got[3].n, got[3].n_value, got[3].sum_value) == (2, 1, 2.0)
    assert got[None].n == 1 and len(got) == 4


def test_profile_of_string_keys_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 1, i, 1.0) for i in range(50)] + [("b", 1, i, 1.0) for i in range(50, 60)], "f string, k long, o long, v double")
    got = {(r.f, r.k): r.n for r in balanced_profile(df, ["f", "k"], "o", "v", 5).collect()}
    assert got == {("a", 1): 50, ("b", 1): 10}
    assert balanced_profile(df.filter("k > 5"), ["f", "k"], "o", "v", 5).count() == 0


def test_heavy_keys_count_null_rows_in_the_total(spark):
    e = spark.createDataFrame([(1, None, i, 0.5) for i in range(3)] + [(i + 10, None, i + 3, 0.5) for i in range(97)], "source long, target long, edge_id long, strength double")
    p = balanced_profile(both_ends(e, "edge_id", "strength"), ["ref_field", "node_id"], "edge_id", "strength")
    assert {(r.ref_field, r.node_id) for r in heavy_keys(p, e.count()).collect()} == {("source", 1)}
    assert heavy_keys(p, 0).count() == 0


def test_joins_with_hot_keys(spark):
    rows = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 100), (None, 101), (9, 102)], "k long, i long")
    keyed = spark.createDataFrame([(1, 100, "one"), (2, 1, "two"), (3, 0, "three")], "k long, n long, name string")
    for got in (hot_cold_join(rows, keyed, "k", "n", 10), salted_join(rows, keyed, ["k"], "n", 10)):
        out = sorted((r.i, r.name) for r in got.collect())
        assert out == [(i, "one") for i in range(100)] + [(100, "two")]
