"""Changes, registries, evaluation and checks on small tables, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import decode, evaluate, graph, mutate, registry, resonance as R, rewards, vectors, walk as K
from weftgraph.params import Resonance

E = "src long, dst long, relation string, strength double, confidence double"


def test_nodes_are_added_or_refused(spark):
    n = spark.createDataFrame([(1, "a", "Entity", 0.5)], "node_id long, label string, node_type string, activation double")
    new = spark.createDataFrame([(1, "a", "Entity", 0.5), (2, None, "Entity", 0.5), (3, "x" * 257, "Entity", 0.5), (4, "b", "entity", 0.5), (5, "c", "Concept", 7.0), (6, "d", "Concept", None), (6, "d", "Concept", None), (None, "e", "Concept", 0.5)], n.schema)
    got = {r.node_id: (r.activation, r.error_code) for r in mutate.add_nodes(n, new).collect()}
    assert got == {1: (0.5, "E001"), 2: (0.5, "E003"), 3: (0.5, "E003"), 4: (0.5, "E004"), 5: (1.0, None), 6: (0.5, None)}
    assert mutate.add_nodes(n, new.limit(0)).count() == 0


def test_removals_and_vector_updates(spark):
    n = spark.createDataFrame([(i,) for i in range(4)], "node_id long")
    e = spark.createDataFrame([(0, 1, "r", 0.5, 0.5), (1, 2, "r", 0.5, 0.5), (2, 3, "r", 0.5, 0.5)], E)
    a, b = mutate.remove_nodes(n, e, spark.createDataFrame([(1,), (1,), (9,)], "node_id long"))
    assert {r.node_id for r in a.collect()} == {0, 2, 3} and [(r.src, r.dst) for r in b.collect()] == [(2, 3)]
    v = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "node_id long, v array<double>")
    up, missing = mutate.update_vectors(v, spark.createDataFrame([(1, [5.0]), (7, [1.0])], v.schema))
    assert {r.node_id: (r.v, r.changed) for r in up.collect()} == {0: ([1.0], False), 1: ([5.0], True)}
    assert [(r.node_id, r.error_code) for r in missing.collect()] == [(7, "E001")]


def test_numbers_follow_the_order(spark):
    d = spark.createDataFrame([(x,) for x in np.random.default_rng(0).permutation(500).tolist()], "k long")
    assert {r.k: r.number for r in graph.numbered(d, ["k"]).collect()} == {i: i + 1 for i in range(500)}
    assert graph.numbered(d.limit(0), ["k"]).count() == 0


def test_bounded_search_marks_edges_that_lead_out(spark):
    e = spark.createDataFrame([(0, i, "r", 1.0, 1.0) for i in range(1, 6)] + [(1, 2, "r", 1.0, 1.0), (5, 9, "r", 1.0, 1.0), (0, 0, "r", 1.0, 1.0)], E)
    n = spark.createDataFrame([(i, 0.5) for i in range(10)], "node_id long, activation double")
    nodes, edges = graph.bounded_bfs(e, n, spark.createDataFrame([("q", 0)], "query_id string, node long"), 2, 3)
    assert {(r.node, r.depth) for r in nodes.collect()} == {(0, 0), (1, 1), (2, 1)}
    got = {(r.src, r.dst): r.boundary for r in edges.collect()}
    assert got == {(0, 0): False, (0, 1): False, (0, 2): False, (1, 2): False, (0, 3): True, (0, 4): True, (0, 5): True}


def test_components_of_a_long_path(spark):
    d = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in graph.components(d).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_activation_settles_and_tells_its_history(spark):
    e = spark.createDataFrame([(0, 1, "is_a", 0.9, 0.9), (1, 2, "is_a", 0.9, 0.9)], E)
    s = spark.createDataFrame([("q", 0)], "query_id string, node long")
    steps = []
    R.resonate(e, s, Resonance(steps=60, decay=0.5), epsilon=1e-3, history=steps)
    moved = [x.first().largest for x in steps]
    assert len(steps) < 60 and moved[-1] < 1e-3 <= min(moved[:-1]) and steps[0].first().step == 1
    assert R.with_theta(Resonance(), {"top_k": 5, "other": 1}).top_k == 5
    first, second = (spark.createDataFrame(rows, "query_id string, energy double") for rows in ([("a", 0.1), ("b", 0.1), ("c", 9.0)], [("a", 0.35), ("b", 0.2), ("c", 99.0)]))
    seeds = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "query_id string, node long")
    assert {r.query_id: (r.energy, r.tier) for r in R.accepted_tier(first, second, seeds).collect()} == {"a": (0.35, 2), "b": (0.1, 1), "c": (9.0, 1)}


def test_a_stuck_walk_begins_again_elsewhere(spark):
    e = spark.createDataFrame([("q", 1, 2, "is_a", 0.9, 0.9, 0.9, 0.5), ("q", 5, 6, "is_a", 0.9, 0.9, 0.8, 0.4), ("q", 6, 7, "is_a", 0.9, 0.9, 0.4, 0.4)], "query_id string, src long, dst long, relation string, strength double, confidence double, act_src double, act_dst double")
    start = spark.createDataFrame([("q", 1, 0.9)], "query_id string, node long, activation double")
    others = spark.createDataFrame([("q", i, a) for i, a in ((1, 0.9), (2, 0.5), (5, 0.8), (6, 0.4), (7, 0.4))], start.schema)
    assert [r.path for r in K.walk(e, start, [0]).collect()] == [[1, 2]]
    assert [(r.path, r.relations) for r in K.walk(e, start, [0], others=others).collect()] == [([5, 6, 7], ["is_a", "is_a"])]


def test_starters_copies_and_prompts(spark):
    d = spark.createDataFrame([(i, ["cat", "pet"], ["is_a"]) for i in range(200)], "k long, l array<string>, r array<string>")
    one = d.limit(1).select(decode.render(F.array(F.lit(1), F.lit(2), F.lit(7)), F.col("l"), F.col("r")).alias("t"), decode.render(F.array(F.lit(2)), F.col("l"), F.col("r"), starters=("A:", "B:")).alias("s"),
        decode.render(F.array(F.lit(3)), F.col("l"), F.col("r"), templates=(((3,), "{count} things: {node0}"),)).alias("n"), decode.prompt(F.col("l"), F.col("r"), F.array(F.lit(0))).alias("p")).first()
    assert tuple(one) == (None, "A: The reason is that cat is a pet.", "2 things: cat", "generate: intents=define walk=cat -> pet relations=is a")
    texts = [r[0] for r in d.select(decode.with_copied(F.lit("nothing here"), F.col("l"), F.col("k"), 0.3)).collect()]
    assert set(texts) == {"nothing here", "cat nothing here", "pet nothing here"} and 100 < texts.count("nothing here") < 180
    assert {r[0] for r in d.select(decode.with_copied(F.lit("a Cat"), F.col("l"), F.col("k"), 1.0)).collect()} == {"a Cat"}
    t = spark.createDataFrame([(2, [1], "x {node0}"), (1, [1], "y {node5}")], "ord int, intents array<int>, template string")
    assert decode.templates_of(t) == (((1,), "y {node5}"), ((1,), "x {node0}"))


def test_best_matches_and_centroids(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(70, 8)), rng.normal(size=(9, 8))
    da = spark.createDataFrame([(str(i), [float(x) for x in r]) for i, r in enumerate(a)], "key string, v array<double>")
    db = spark.createDataFrame([(f"c{i}", [float(x) for x in r]) for i, r in enumerate(b)], "canonical string, v array<double>")
    registry.BLOCK, before = 16, registry.BLOCK
    got = {r.key: (r.canonical, r.cosine) for r in registry.best_matches(da, db, 8).collect()}
    registry.BLOCK = before
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit(a) @ unit(b).T, 6)
    assert got == {str(i): (f"c{s[i].argmax()}", s[i].max()) for i in range(70)}
    assert registry.best_matches(da.limit(0), db, 8).count() == 0
    m = da.select(F.lit("c0").alias("canonical"), F.col("key").cast("int").alias("ord"), "v").filter("ord < 5")
    want = b[0]
    for i in range(5):
        want = 0.85 * want + 0.15 * a[i]
    rows = {(r.canonical, r.i): r.value for r in registry.followed(db, m).collect()}
    assert np.allclose([rows["c0", i] for i in range(8)], want / np.linalg.norm(want)) and np.allclose([rows["c3", i] for i in range(8)], b[3] / np.linalg.norm(b[3]))


def test_relations_and_names_spelled_alike(spark):
    counts = spark.createDataFrame([("causes", 10), ("cause", 3), ("is part of", 8), ("is a part of", 2), ("invented", 5)], "label string, n long")
    got = {r.label: r.canonical for r in registry.relation_registry(counts, 0.6).collect()}
    assert got == {"causes": "causes", "cause": "causes", "is part of": "is part of", "is a part of": "is part of", "invented": "invented"}
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(["causes", "invented", "cause", "caused", "invents"])], "ord long, label string")
    k = {r.label: r.cluster for r in registry.online_clusters(texts).collect()}
    assert k["causes"] == k["cause"] != k["invented"]
    names = spark.createDataFrame([("harbour council", 9), ("harbor council", 1), ("old ferry", 2)], "label string, n long")
    r = {x.label: x.canonical for x in registry.resolve_names(names, 0.7).collect()}
    assert r["harbor council"] == "harbour council" and r["old ferry"] == "old ferry"
    assert registry.resolve_names(names.limit(0)).count() == 0


def test_rewards(spark):
    d = spark.createDataFrame([([0.5, 0.5], [1.0], 20.0), ([], [], 1.0)], "a array<double>, c array<double>, e double")
    assert [round(r[0], 9) for r in d.select(rewards.estimated_internal(F.col("a"), F.col("c"), F.col("e"))).collect()] == [0.8, 0.0]
    t = spark.createDataFrame([("x", 90, 210), ("y", 0, 99)], "key string, before long, after long")
    assert {(r.key, r.task, r.times) for r in rewards.due_tasks(t).collect()} == {("x", "replay", 2)}
    v = spark.createDataFrame([(i, [float(i)] * 3, [1.0, 2.0]) for i in range(5)], "row_id long, p array<double>, q array<double>")
    got = rewards.judged(v, {"one": (["p", "q"], 0.7), "two": (["q"], 0.3)}, (8,)).collect()
    assert all(0 < r.one < 1 and np.isclose(r.reward, 0.7 * r.one + 0.3 * r.two) for r in got) and len({r.two for r in got}) == 1


def test_matches_and_rankings(spark):
    p = spark.createDataFrame([("red cat", "is a", "pet"), ("cat", "is a", "wild animal"), ("cat", "has", "tail"), ("category", "is a", "pet")], "s string, rel string, o string")
    t = spark.createDataFrame([("cat", "is a", "pet"), ("the cat", "is a", "animal"), ("dog", "has", "tail")], p.schema)
    r = evaluate.extraction_scores(p, t).first()
    assert (r.n_predicted, r.n_truth, r.n_right, r.n_found) == (4, 3, 2, 2) and r.precision == 0.5
    c = spark.createDataFrame([("a", 1, i, "r", 0.1 * i, 0.5) for i in range(9)] + [("b", 1, i, "r", 0.1, 0.1 * i) for i in range(5)], "query_id string, src long, dst long, relation string, similarity double, confidence double")
    got = [(x.query_id, x.rank_no, x.dst) for x in evaluate.ranked_answers(c).orderBy("query_id", "rank_no").collect()]
    assert got == [("a", k + 1, 8 - k) for k in range(5)] + [("b", k + 1, 4 - k) for k in range(3)]


def test_parameters_are_checked():
    assert evaluate.parameters({"top_k": 5}).top_k == 5 and evaluate.vocabulary_faults() == []
    with pytest.raises(ValueError, match="unknown parameter colour; decay must be within .*; gate must be one of"):
        evaluate.parameters({"decay": 7.0, "gate": "open", "colour": 1})


def test_rules_that_results_break(spark):
    w = spark.createDataFrame([([1, 2], ["r"], [0.5, 0.5], [0.5]), ([1, 1], ["r"], [0.5, 2.0], [0.5]), ([1], [], [0.5], [0.5])], "path array<long>, relations array<string>, activations array<double>, confidences array<double>")
    got = {r.rule: r.n for r in evaluate.walk_violations(w).collect()}
    assert got == {"empty path": 0, "relations and path differ": 0, "activations and path differ": 0, "confidences and path differ": 1, "activation out of range": 1, "confidence out of range": 0, "stays at a node": 1}
    p = spark.createDataFrame([([0], 0.5), ([], 0.5), ([16], 0.5), ([1] * 9, 0.5), ([1], 1.5)], "intents array<int>, plan_confidence double")
    assert sorted(r.rule for r in evaluate.plan_violations(p).collect()) == ["confidence out of range", "empty", "too long", "unknown intent"]


def test_extremes_of_cosines(spark):
    v = np.random.default_rng(1).normal(size=(50, 6))
    d = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "node long, v array<double>")
    s = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    r = vectors.cosine_extremes(d, 6).first()
    off = s[~np.eye(50, dtype=bool)]
    assert np.isclose(r.largest, off.max()) and np.isclose(r.smallest, off.min())
    assert tuple(vectors.cosine_extremes(d.limit(1), 6).first()) == (None, None)


def test_networks_go_on_learning():
    from weftgraph.operators import training as M

    rng = np.random.default_rng(0)
    z, y = rng.normal(size=(5, 3)), np.array([0, 1, 2, 0, 1])

    def loss(z, focal):
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        own = p[np.arange(5), y]
        return float((-((1 - own) ** focal) * np.log(own)).sum())

    for focal in (0.0, 2.0):
        want = np.zeros_like(z)
        for i in range(5):
            for j in range(3):
                d = np.zeros_like(z)
                d[i, j] = 1e-6
                want[i, j] = (loss(z + d, focal) - loss(z - d, focal)) / 2e-6
        assert np.allclose(M.slopes(z, y, focal), want, atol=1e-5)
    centre = rng.normal(size=(5, 6)) * 4
    y = rng.integers(0, 3, 600)
    x = centre[y] + rng.normal(size=(600, 6))
    m = M.fit_mlp(x, y, 3, (16,), 20, focal=1.0, clip=1.0, cosine=True)
    assert (m.logits(x).argmax(axis=1) == y).mean() > 0.9
    y2 = rng.integers(3, 5, 400)
    x2 = centre[y2] + rng.normal(size=(400, 6))
    both, labels = np.concatenate([x[:200], x2]), np.concatenate([y[:200], y2])
    more = M.fit_mlp(both, labels, 5, (16,), 30, start=m, settle=0.01)
    assert m.weights[-1].shape[1] == 3 and (more.logits(both).argmax(axis=1) == labels).mean() > 0.9


def test_sentences_keep_abbreviations_and_decimals(spark):
    from weftgraph.operators import extract

    d = spark.createDataFrame([(1, "Dr. J. Reed paid 3.50 today. He left! Why?  No. 7 stays.\nEnd"), (2, None), (3, "")], "doc_id long, text string")
    assert [r.sentence for r in extract.safe_sentences(d).orderBy("doc_id", "sent_idx").collect()] == ["Dr. J. Reed paid 3.50 today.", "He left!", "Why?", "No. 7 stays.", "End"]


def test_bounded_walks_are_the_same(spark):
    rng = np.random.default_rng(3)
    act = {q: rng.random(12).round(2).clip(0.02) for q in "abc"}
    rows = [(q, int(s), int(t), r, float(rng.choice([0.5, 0.9])), float(rng.choice([0.5, 0.8])), float(act[q][s]), float(act[q][t])) for q in "abc" for s, t, r in {(int(x), int(y), str(z)) for x, y, z in zip(rng.integers(0, 12, 60), rng.integers(0, 12, 60), rng.choice(["is_a", "causes", "part_of"], 60))}]
    e = spark.createDataFrame(rows, "query_id string, src long, dst long, relation string, strength double, confidence double, act_src double, act_dst double")
    start = spark.createDataFrame([(q, 3, float(act[q][3])) for q in "abc"] + [("none", 1, 1.0), ("low", 1, 0.001)], "query_id string, node long, activation double")
    got, want = ({r.query_id: tuple(r[1:]) for r in f(e, start, [1, 2, 7]).select("query_id", "path", "relations", "activations", "confidences").collect()} for f in (K.walk_bounded, K.walk))
    assert got == want and set(got) == {"a", "b", "c", "none"}
