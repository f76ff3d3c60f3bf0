import math
import random

import numpy as np
import pytest

from weftgraph.operators import graph as G, vectors as V

E = "src long, dst long, relation string, strength double, confidence double, frequency long, last_used double"


def edges(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.0) for r in rows], E)


def test_cleaning_keeps_the_last_written(spark):
    raw = spark.createDataFrame(
        [(1, 1, 2, "is_a", 0.5, 0.5, 0.0, 1), (2, 1, 2, "is_a", 0.7, 0.5, 0.0, 1), (3, 1, 2, "is_a", float("nan"), 0.5, 0.0, 1), (4, None, 2, "is_a", 0.5, 0.5, 0.0, 1), (5, 1, 2, None, 0.5, 0.5, 0.0, 1), (6, 1, 1, "is_a", 1.0, 1.5, 0.0, 1)],
        "edge_id long, source long, target long, relation string, strength double, confidence double, last_used double, frequency long",
    )
    assert [(r.src, r.dst, r.strength) for r in G.clean_edges(raw).collect()] == [(1, 2, 0.7)]


def test_self_loop_is_seen_once_but_counts_twice(spark):
    e = edges(spark, [(1, 1, "is_a", 1.0, 1.0), (1, 2, "is_a", 1.0, 1.0)])
    assert sorted((r.node, r.other) for r in G.adjacency(e).collect()) == [(1, 1), (1, 2), (2, 1)]
    assert {r.node: r.degree for r in G.degrees(e).collect()} == {1: 3, 2: 1}


def test_prune(spark):
    n = spark.createDataFrame([(1, "a", "Concept", 0.5), (2, "b", "Concept", 0.0099995), (3, "c", "Concept", 0.001)], "node_id long, label string, node_type string, activation double")
    e = edges(spark, [(1, 2, "is_a", 1.0, 1.0), (1, 3, "is_a", 1.0, 1.0), (1, 9, "is_a", 1.0, 1.0)])
    kept, left = G.prune(n, e)
    assert {r.node_id for r in kept.collect()} == {1, 2} and [(r.src, r.dst) for r in left.collect()] == [(1, 2)]


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in G.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert G.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_merge_remap_and_reverse(spark):
    e = edges(spark, [(1, 2, "is_a", 0.3, 0.4), (5, 2, "is_a", 0.9, 0.1), (1, 5, "is_a", 0.5, 0.5), (7, 7, "is_a", 0.5, 0.5)])
    m = spark.createDataFrame([(5, 1)], "node long, component long")
    got = {(r.src, r.dst): (r.strength, r.confidence, r.frequency) for r in G.remap(e, m).collect()}
    assert got == {(1, 2): (0.9, 0.4, 2), (7, 7): (0.5, 0.5, 1)}
    both = edges(spark, [(1, 2, "is_a", 0.3, 0.4), (2, 1, "is_a", 0.9, 0.1)])
    assert {(r.src, r.dst): r.strength for r in G.reverse_union(both).collect()} == {(1, 2): 0.9, (2, 1): 0.3}


def test_new_ids_are_dense_and_ordered(spark):
    labels = spark.createDataFrame([(f"n{i:03d}",) for i in range(50)] + [("n001",), (None,), ("known",)], "label string")
    known = spark.createDataFrame([(7, "known")], "node_id long, label string")
    got = sorted((r.label, r.node_id) for r in G.new_ids(labels, known).collect())
    assert got == [(f"n{i:03d}", 8 + i) for i in range(50)]
    assert G.new_ids(labels.limit(0), known).count() == 0


def test_near_duplicates_are_paired_and_merged(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4))
    v[7] = 0
    v[9] = v[30] * 2
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, [1.0]), (98, None)], "node long, v array<double>")
    n = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if n[a] @ n[b] >= 0.92}
    for block, piece in ((8192, 512), (17, 5)):
        monkeypatch.setattr(V, "BLOCK", block)
        monkeypatch.setattr(V, "SLICE", piece)
        rows = [(r.a, r.b) for r in V.near_pairs(df, 0.92, 4).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    assert (9, 30) in want
    chain = spark.createDataFrame([(i, [math.cos(t), math.sin(t)]) for i, t in ((1, 0.0), (2, 0.3), (3, 0.6), (4, 2.0))], "node long, v array<double>")
    m = G.components(V.near_pairs(chain, 0.92, 2))
    assert {tuple(r) for r in m.collect()} == {(1, 1), (2, 1), (3, 1)}
    got = G.remap(edges(spark, [(3, 4, "is_a", 0.5, 0.5), (1, 4, "is_a", 0.7, 0.4), (2, 3, "is_a", 0.5, 0.5)]), m)
    assert [(r.src, r.dst, r.strength, r.confidence, r.frequency) for r in got.collect()] == [(1, 4, 0.7, 0.5, 2)]


def test_jaccard_of_a_hub_and_its_many_partners(spark):
    """A hub's neighbours aren't listed once a partner: what is shuffled grows with the edges, and every kind of pair comes out right."""
    hub, second, leaves = 0, 1, range(2, 3002)
    rows = [(hub, i, "synonym", 1.0, 0.9) for i in leaves] + [(i, second, "is_a", 1.0, 0.9) for i in leaves if i % 2] + [(i + 1, i, "is_a", 1.0, 0.9) for i in leaves if i % 3 == 0] + [(hub, hub, "is_a", 1.0, 0.9), (second, 5, "is_a", 1.0, 0.1)]
    e = spark.createDataFrame(rows, "src long, dst long, relation string, strength double, confidence double")
    ask = [(hub, i) for i in leaves] + [(i, hub) for i in leaves] + [(hub, second), (second, hub), (hub, hub), (4, 6), (6, 4), (2, 99999), (99998, 99999), (hub, 99999)]
    pairs = spark.createDataFrame(ask, "a long, b long")
    near = {}
    for s, d, _, _, q in rows:
        if q >= 0.5:
            near.setdefault(s, set()).add(d)
            near.setdefault(d, set()).add(s)
    jvm = spark.sparkContext._jsc.sc()

    def written():
        jvm.listenerBus().waitUntilEmpty(30_000)
        return jvm.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before, usual = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        got = {(r.a, r.b): r.jaccard for r in G.jaccard(e, pairs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert written() - before < 5_000_000
    want = {}
    for a, b in ask:
        x, y = near.get(a, set()), near.get(b, set())
        want[a, b] = len(x & y) / len(x | y) if x | y else 0.0
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)
