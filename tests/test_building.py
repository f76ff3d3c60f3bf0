import numpy as np
from pyspark.sql import functions as F

from weftgraph.functions.encoder import encode
from weftgraph.operators import align, evolution, extract, fold, plan, training


def test_patterns_in_order(spark):
    d = spark.createDataFrame([(1, "The lens is part of the eye. Tokyo is in Japan!\nA cat is a pet. X is the best. He has a dog. No match here"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.s, r.rel, r.o) for r in extract.triples(extract.sentences(d)).collect())
    assert got == sorted([(1, "the lens", "is part of", "the eye"), (1, "tokyo", "is in", "japan"), (1, "a cat", "is", "pet"), (1, "he", "has", "a dog")])


def test_alignment(spark):
    reg = spark.createDataFrame([("is a", 1), ("part of", 2), ("is a", 5)], "canonical string, node_id long")
    lab = spark.createDataFrame([("IS A ",), ("is_part of",), ("zzz",), (None,)], "label string")
    exact = {r.label: r.node_id for r in align.align_exact(lab, reg).collect()}
    assert exact["IS A "] == 1 and exact["zzz"] is None
    near = {r.label: r.canonical for r in align.align_similar(lab, reg, 0.4).collect()}
    assert near["is_part of"] == "part of" and "zzz" not in near
    assert {(r.canonical, r.node_id) for r in align.absorb(reg.filter("node_id < 5"), spark.createDataFrame([("new", 0), ("is a", 9)], "canonical string, node_id long")).collect()} == {("is a", 1), ("part of", 2), ("new", 3)}
    assert align.align_similar(lab, reg.limit(0)).count() == 0


def test_encoder():
    v = encode(["river ferry", "River  ferry", "copper lens", None, ""])
    assert np.allclose(v[0], v[1]) and v[0] @ v[2] < 0.5 and not v[3:].any() and abs(np.linalg.norm(v[0]) - 1) < 1e-6


def test_folds_follow_the_order(spark):
    rows = [(k, i, float((i * 7) % 5)) for k in ("a", "b") for i in range(30)]
    d = spark.createDataFrame(rows[::-1], "k string, i long, r double")
    start, step = fold.ema_z()
    got = {(r.k, r.i): r.z for r in fold.ordered_fold(d, "k", ["i"], "r", start, step, "z", "i").collect()}
    for k in ("a", "b"):
        s = {}
        for i in range(30):
            assert abs(got[k, i] - step(s, float((i * 7) % 5))) < 1e-12
    start, step = fold.bias_reward(1.0)
    s = start()
    assert step(s, 1.0) == 1.0 + 0.01 * (1 - 1 / 3) and 0.1 <= min(step(s, -1e9), 0.1)


def test_rules_take_the_first_that_holds(spark):
    f = spark.createDataFrame([("a", 2, 1, 0, 0.9), ("b", 5, 0, 1, 0.9), ("c", 5, 0, 0, 0.1), ("d", 5, 0, 0, 0.9)], "query_id string, n_nodes int, causes int, contradicts int, avg_conf double")
    got = {r.query_id: (r.intents, r.plan_confidence) for r in plan.rule_plan(f).collect()}
    assert got == {"a": ("0", 0.5), "b": ("4,1,7", 0.5), "c": ("10,11", 0.5), "d": (None, None)}


def test_classifier_learns_and_ranks(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(4, 8)) * 3
    y = rng.integers(0, 4, 800)
    x = centre[y] + rng.normal(size=(800, 8))
    m = training.fit_mlp(x, y, 4, (32,), 20)
    d = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "row_id long, features array<double>, actual long")
    acc = training.top_k_accuracy(training.classify(d, m), d.select("row_id", "actual")).first()
    assert acc.n == 800 and acc.top_1 > 0.9 and acc.top_3 >= acc.top_1 and acc.top_5 == 1.0


def test_parameters_move_towards_rewards(spark):
    theta = evolution.parameters(spark)
    tried = evolution.propose(theta, spark.range(40).withColumnRenamed("id", "trial"), 0.05)
    rows = {(r.trial, r.dim): r.value for r in tried.collect()}
    assert len(rows) == 40 * evolution.DIMS and all(0 <= v <= 3 for (_, d), v in rows.items() if 4 <= d < 20) and all(v >= 0.0001 for (_, d), v in rows.items() if d < 2)
    free = np.array([v for (_, d), v in rows.items() if d >= 20])
    assert abs(free.mean()) < 0.01 and abs(free.std() - 0.05) < 0.005
    reward = tried.filter("dim = 30").select("trial", F.col("value").alias("reward"))
    moved = {r.dim: r.mu for r in evolution.move(theta, tried, reward).collect()}
    z = np.array([rows[t, 30] for t in range(40)])
    assert np.isclose(moved[30], evolution.RATE * ((z - z.mean()) / z.std() * z).mean() * (1 - evolution.ANCHOR)) and moved[30] > 0
    nan = spark.createDataFrame([(t, float("nan")) for t in range(40)], "trial long, reward double")
    assert {r.dim: r.mu for r in evolution.move(theta, tried, nan).collect()} == {r.dim: r.mu for r in theta.collect()}
    assert evolution.settings(tried).filter("trial = 3").first().top_k == round(rows[3, 3])


def test_clusters(spark):
    d = spark.createDataFrame([(i, [float(i % 2) * 10, float(i)]) for i in range(20)], "node long, v array<double>")
    assert training.clusters(d, 2).select(F.countDistinct("cluster")).first()[0] == 2
