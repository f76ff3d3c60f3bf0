from weftgraph.operators import orphans as O

E = "edge_id long, source long, target long, last_used double, node_id string"
V = "emb_id long, node_id long, saved_at double"
N = "node_id long, create_time double, table_name string"
D = "node_id long, deleted_at timestamp, reason string"


def tables(spark, e, v, n, d):
    return [spark.createDataFrame(rows, schema) for rows, schema in ((e, E), (v, V), (n, N), (d, D))]


def test_every_kind_and_period(spark):
    p = float(O.PERIOD_S)
    t = tables(
        spark,
        [(1, 1, 2, p * 3 + 1, "x"), (2, 8, None, None, "x"), (3, 9, 3, p, "x"), (4, 1, 9, float("nan"), None), (5, 9, 9, p, None)],
        [(7, 9, p * 2), (8, 4, None), (9, None, 1.0)],
        [(1, None, "a"), (2, p * 4, "a"), (3, p, "a"), (3, p, "a")],
        [(9, None, None), (1, None, "back")],
    )
    got = {tuple(r) for r in O.orphan_rows(*t).collect()}
    assert got == {
        ("edges", "target", 1, 3, "late"), ("edges", "source", 2, -1, "missing"), ("edges", "source", 3, 1, "deleted"), ("edges", "target", 4, -1, "deleted"),
        ("edges", "source", 5, 1, "deleted"), ("edges", "target", 5, 1, "deleted"), ("node_embeddings", "node_id", 7, 2, "deleted"), ("node_embeddings", "node_id", 8, -1, "missing"),
    }


def test_empty_tables(spark):
    t = tables(spark, [], [], [], [])
    assert O.orphan_rows(*t).count() == 0
    assert O.orphan_report(O.orphan_rows(*t)).count() == 0


def test_deltas_are_signed_and_add_up(spark):
    refs = spark.createDataFrame([(1, 5.0), (1, None), (2, 1.0), (None, 1.0)], "node_id long, at double")
    nodes = spark.createDataFrame([(2, None, "")], N)
    gone = spark.createDataFrame([(1, None, None)], D)
    state = O.apply_deltas(O.reference_deltas(refs), O.existence_deltas(nodes), O.deletion_deltas(gone))
    assert {(r.node_id, r.refs, r.orphan_kind) for r in O.current_orphans(state).collect()} == {(1, 2, "deleted")}
    later = O.apply_deltas(state, O.existence_deltas(spark.createDataFrame([(1, 9.0, "")], N)), O.existence_deltas(nodes, -1))
    assert {(r.node_id, r.refs, r.orphan_kind) for r in O.current_orphans(later).collect()} == {(2, 1, "missing")}
    early, late = (O.existence_deltas(spark.createDataFrame([(1, t, "")], N)) for t in (2.0, 9.0))
    back = O.summary(O.apply_deltas(state, early, late, O.existence_deltas(spark.createDataFrame([(1, 2.0, "")], N), -1)))
    assert [(r.exist, r.created, r.null_created) for r in back.filter("node_id = 1").collect()] == [(1, 9.0, False)]  # the earlier time goes with its record
    nothing = O.apply_deltas(later, O.reference_deltas(refs, -1), O.existence_deltas(spark.createDataFrame([(1, 9.0, "")], N), -1), O.deletion_deltas(gone, -1))
    assert nothing.count() == 0
