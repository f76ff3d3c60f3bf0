import math

import numpy as np
from pyspark.sql import functions as F

from weftgraph import functions as X
from weftgraph.operators import decode, kg, learning, plan, resonance as R, vectors, walk as K
from weftgraph.params import INTENT_BIAS, RELATION_BIAS, Resonance

E = "src long, dst long, relation string, strength double, confidence double"


def star(spark):
    return spark.createDataFrame([(0, i, "is_a", 0.9, 0.8) for i in range(1, 6)] + [(1, 2, "causes", 0.5, 0.5), (3, 3, "synonym", 1.0, 1.0), (4, 5, "is_a", 0.1, 0.1)], E)


def brute(edges, seeds, p):
    act = {s: 1.0 for s in seeds}
    for _ in range(p.steps):
        inp = {}
        for a, b, r, s, q in edges:
            if s * q < p.edge_threshold:
                continue
            w = s * q * RELATION_BIAS.get(r, 1.0)
            for x, y in ((a, b), (b, a)) if a != b else ((a, b),):
                if x in act:
                    inp[y] = inp.get(y, 0) + act[x] * w
        new = {}
        for n in set(act) | set(inp):
            x, i = act.get(n, p.floor), inp.get(n, 0.0)
            new[n] = min(1.0, max(p.floor, x + (1 - x) * i - p.decay * x))
        t = sum(new.values())
        if t > p.budget:
            new = {n: min(1.0, max(p.floor, x * p.budget / t)) for n, x in new.items()}
        act = dict(sorted(new.items(), key=lambda kv: (-round(kv[1], 12), kv[0]))[: p.top_k])
    return act


def test_resonance_against_brute_force(spark):
    e = star(spark)
    rows = [tuple(r) for r in e.collect()]
    seeds = spark.createDataFrame([("a", 0), ("b", 2), ("b", 3), ("b", 3)], "query_id string, node long")
    for p in (Resonance(), Resonance(steps=2, top_k=3)):
        got = {}
        for r in R.resonate(e, seeds, p).collect():
            got.setdefault(r.query_id, {})[r.node] = r.activation
        for q, s in (("a", [0]), ("b", [2, 3])):
            want = brute(rows, s, p)
            assert got[q].keys() == want.keys()
            assert all(abs(got[q][n] - want[n]) < 1e-9 for n in want)


def test_energy_falls_back_to_activations(spark):
    act = spark.createDataFrame([("a", 1, 0.5), ("b", 0, 0.5), ("b", 1, 0.4)], "query_id string, node long, activation double")
    got = {r.query_id: r.energy for r in R.energy(R.subgraph_edges(star(spark), act), act).collect()}
    assert abs(got["a"] - 0.5) < 1e-12 and abs(got["b"] - 0.5 * 0.72) < 1e-12


def test_walk_never_returns_and_stops(spark):
    e = spark.createDataFrame([("q", 1, 2, "is_a", 0.9, 0.9, 0.5, 0.5), ("q", 2, 1, "is_a", 0.9, 0.9, 0.5, 0.5), ("q", 2, 3, "is_a", 0.5, 0.9, 0.5, 0.5)], "query_id string, src long, dst long, relation string, strength double, confidence double, act_src double, act_dst double")
    start = spark.createDataFrame([("q", 1, 1.0), ("lonely", 1, 1.0)], "query_id string, node long, activation double")
    got = {r.query_id: r.path for r in K.walk(e, start, [0]).collect()}
    assert got == {"q": [1, 2, 3], "lonely": [1]}


def test_walk_confidence_and_bias(spark):
    d = spark.createDataFrame([([0.5, 0.5],), ([],), ([0.0, 1.0],)], "c array<double>")
    assert [round(r[0], 9) for r in d.select(K.walk_confidence(F.col("c"))).collect()] == [0.5, 1.0, 0.0]
    d = spark.createDataFrame([(0, "is_a"), (0, "nothing"), (99, "is_a")], "i int, r string")
    assert [r[0] for r in d.select(K.intent_bias(F.col("i"), F.col("r"))).collect()] == [INTENT_BIAS[0]["is_a"], 0.5, 1.0]


def test_rank_probabilities_prefer_the_larger_of_equals(spark):
    d = spark.createDataFrame([("q", 1, 0.5), ("q", 2, 0.5), ("q", 3, 0.1)], "q string, i long, s double")
    got = {r.i: r.prob for r in K.rank_probabilities(d, ["q"], "s", "i").collect()}
    total = 1 + 1 / 2 + 1 / 3
    assert all(abs(got[i] - x / total) < 1e-12 for i, x in ((2, 1), (1, 1 / 2), (3, 1 / 3)))


def test_beam_search():
    logits = np.zeros(16)
    logits[3], logits[5] = 2.0, 1.9
    rng = np.random.default_rng(0)
    many = np.concatenate([logits[None], np.zeros((1, 16)), rng.normal(size=(30, 16))])
    seqs, confs = plan.beam_all(many)
    assert set(seqs[0, :2]) == {3, 5} and all(0 < x < 1 for x in confs) and seqs[1, 0] == 15  # of equal scores the larger
    for width in (1, 2, 3):
        seqs, confs = plan.beam_all(many, width)
        for z, got, conf in zip(many, seqs, confs):
            want = one_by_one(z, width)
            assert got.tolist() == want[0] and math.isclose(conf, math.exp(want[1] / 8))


def one_by_one(z, width):
    """The beams of one row as a list of (tokens, score), extended by every token and cut to the best."""
    beams = [((), 0.0)]
    for _ in range(8):
        longer = []
        for tokens, score in beams:
            w = [math.exp(x - (1.2 if i in tokens else 0.0)) for i, x in enumerate(z)]
            longer += [((*tokens, i), score + math.log(x / sum(w)), k, -i) for k, (i, x) in ((len(longer), ix) for ix in enumerate(w))]
        order = sorted(longer, key=lambda b: (-round(b[1], 12), b[2], b[3]))
        beams = [(b[0], b[1]) for b in order[:width]]
    return list(beams[0][0]), beams[0][1]


def test_templates_and_fallback(spark):
    d = spark.createDataFrame([(["cat", "animal"], ["is_a"]), (["cat"], [])], "l array<string>, r array<string>")
    got = d.select(decode.render(F.array(F.lit(1)), F.col("l"), F.col("r")).alias("t"), decode.fallback_text(F.col("l"), F.col("r")).alias("f")).collect()
    assert [tuple(r) for r in got] == [("cat is a animal.", "cat is a animal"), (None, "cat")]


def test_scalar_functions(spark):
    d = spark.createDataFrame([([0.5, -2.0, 0.0039370],)], "v array<float>")
    r = d.select(X.quantize(F.col("v")).alias("q"), X.cosine(F.col("v"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("c")).first()
    assert list(r.q) == [64, -127, 0] or list(r.q) == [64, -127, 1]
    assert r.c == 0.0
    d = spark.createDataFrame([("  The Cat's ",), ("Boss' ",), (None,)], "x string")
    assert [r[0] for r in d.select(kg.normalize_label(F.col("x"))).collect()] == ["the cat", "boss", None]


def test_chains_join_neighbours_both_ways(spark):
    t = spark.createDataFrame([(1, "a", "r", "b", 7), (2, "b", "s", "c", 7), (3, "d", "t", "b", 7), (4, "x", "u", "y", 8)], "triple_id long, s string, rel string, o string, doc_index long")
    got = {(r.s, r.rel, r.o) for r in kg.chains(t).collect()}
    assert got == {("a", "r→s", "c"), ("d", "t→s", "c")}


def test_hebbian_and_decay(spark):
    e = spark.createDataFrame([(1, 2, "is_a", 0.99, 0.5, 50), (2, 3, "is_a", 0.01, 0.5, 1)], E + ", frequency long")
    t = spark.createDataFrame([(1, 2, "is_a", 1.0), (8, 9, "is_a", 1.0)], "src long, dst long, relation string, eligibility double")
    r = learning.hebbian(e, t, F.lit(1.0)).collect()
    assert len(r) == 1 and r[0].strength == 1.0 and math.isclose(r[0].confidence, 0.5 + 0.02 * 0.75)
    assert [(x.src, round(x.new_strength, 9)) for x in learning.decay(e).collect()] == [(1, round(0.99 * (1 - 0.001 / 2), 9))]


def test_vector_ranking_against_numpy(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    d = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(99, [0.0] * 8), (98, [1.0])], "node long, v array<double>")
    q = spark.createDataFrame([(0, [float(x) for x in v[3]]), (1, [0.0] * 8)], "query_id long, v array<double>")
    got = [r.node for r in vectors.rank_by_cosine(d, q, 5, 8).filter("query_id = 0").orderBy("rank_no").collect()]
    s = v @ v[3] / np.linalg.norm(v, axis=1) / np.linalg.norm(v[3])
    assert got == list(np.argsort(-s)[:5])


def test_nodes_of_a_walk_that_its_text_mentions(spark):
    rows = [("A red CAT is a pet", ["Cat", "dog", "PET", None, "red cat"], [1, 2, 3, 4, 5]), ("none", ["Cat"], [1]), (None, ["Cat"], [1])]
    df = spark.createDataFrame(rows, "text string, labels array<string>, path array<long>")
    assert [r.m or [] for r in df.select(decode.mentioned(F.col("text"), F.col("labels"), F.col("path")).alias("m")).collect()] == [[1, 3, 5], [], []]
    import __spark_entry__

    q = __spark_entry__.queries()
    texts = {r.query_id: r for r in q["answer"](spark, "/root/testdata/sf0.001").collect()}
    got = {}
    for r in q["walk_mentions"](spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r.query_id, []).append(r.node)
    assert {k: len(v) for k, v in got.items()} == {k: n for k, r in texts.items() if (n := sum(x.lower() in r.text.lower() for x in r.path_labels.split(" > ")))}


def test_all_labels_go_to_uris_and_back(spark, tmp_path):
    from weftgraph.plans import learning as plans

    labels = ["Red Cat", "a/b_c%2F d", "/x/", " Élan-7 ", "東京", "", "_", "a%5f", None]
    spark.createDataFrame([(i, x, "Entity", 0.5) for i, x in enumerate(labels)], "node_id long, label string, node_type string, activation double").write.parquet(str(tmp_path / "nodes.parquet"))
    rows = plans.label_uris(spark, str(tmp_path)).collect()
    assert {r.node_id: r.label for r in rows} == {i: x.lower() for i, x in enumerate(labels) if x is not None}
    assert all(r.uri.count("/") == 3 and " " not in r.uri and r.lang == "en" for r in rows) and len({r.uri for r in rows}) == len(rows)
