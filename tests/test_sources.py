import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from weftgraph import sources as S, streaming


def kinds(df):
    return sorted((r.kind, r.h, r.r, r.t, r.text) for r in df.collect())


def test_formats():
    assert [S.detect_format(p) for p in ("a.json", "b.jsonl", "c.TSV", "d.parquet", "e.db", "f.txt")] == ["json", "json", "csv", "parquet", "sqlite", "text"]
    with pytest.raises(ValueError):
        S.detect_format("x.bin")


def test_csv_and_tsv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("head,relation,tail\ncat,is_a,animal\ncat,,x\n")
    assert kinds(S.read_any(spark, str(tmp_path / "a.csv"))) == [("triple", "cat", "is_a", "animal", None)]
    (tmp_path / "a.tsv").write_text("subject\tpredicate\tobject\na,b\tc\td\n")
    assert kinds(S.read_any(spark, str(tmp_path / "a.tsv"))) == [("triple", "a,b", "c", "d", None)]


def test_json_lines_and_arrays(spark, tmp_path):
    long = "a text that is long enough to be one"
    (tmp_path / "a.jsonl").write_text('{"head":"a","relation":"b","tail":"c"}\n\nnot json\n{"sentence":"short"}\n{"text":"tiny"}\n' + json.dumps({"article": long}))
    got = kinds(S.read_any(spark, str(tmp_path / "a.jsonl")))
    assert sorted(map(str, got)) == sorted(map(str, [("document", None, None, None, long), ("document", None, None, None, "not json"), ("sentence", None, None, None, "short"), ("triple", "a", "b", "c", None)]))
    (tmp_path / "a.json").write_text(json.dumps([{"subject": "a", "predicate": "b", "object": "c"}, "a bare string"]))
    assert {(r.kind, r.h, r.text) for r in S.read_any(spark, str(tmp_path / "a.json")).collect()} == {("triple", "a", None), ("document", None, "a bare string")}


def test_text_range_counts_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n two \nthree\n")
    assert [r.text for r in S.read_any(spark, str(tmp_path / "a.txt")).orderBy("ord").collect()] == ["one", "two", "three"]
    assert [r.text for r in S.read_any(spark, str(tmp_path / "a.txt"), 1, 2).collect()] == ["two"]


def test_parquet_triples_of_uris(spark, tmp_path):
    p = str(tmp_path / "t.parquet")
    spark.createDataFrame([("http://h/c/en/big_cat", "http://h/r/is_a", "http://h/c/en/animal"), ("http://h/c/fr/chat", "http://h/r/is_a", "http://h/c/en/cat")] * 2, "subject string, predicate string, object string").write.parquet(p)
    assert [tuple(r) for r in S.read_triples(spark, p, "en").collect()] == [("big cat", "is a", "animal")]
    assert S.read_triples(spark, p).count() == 2


def test_sqlite_graph(spark, tmp_path):
    p = str(tmp_path / "g.db")
    with sqlite3.connect(p) as db:
        db.executescript("CREATE TABLE nodes(id INTEGER, label TEXT); CREATE TABLE edges(source_id INTEGER, target_id INTEGER, relation TEXT, strength REAL); INSERT INTO nodes VALUES (1,'a'),(2,'b'); INSERT INTO edges VALUES (1,2,'is_a',0.5),(1,9,'is_a',0.5);")
    assert kinds(S.read_any(spark, p)) == [("triple", "a", "is_a", "b", None)]


def test_ingest_and_versions(spark, tmp_path):
    (tmp_path / "a.csv").write_text("head,relation,tail\nCat,is_a,animal\ncat ,is_a,Animal\ndog,is_a,dog\n")
    out = str(tmp_path / "graph")
    S.ingest(spark, str(tmp_path / "a.csv"), out)
    assert sorted((r.label, r.node_id) for r in S.load_graph(spark, out, "nodes").collect()) == [("animal", 1), ("cat", 2)]
    e = S.load_graph(spark, out, "edges").collect()
    assert [(r.src, r.dst, r.frequency, r.strength) for r in e] == [(2, 1, 2, 0.4)]
    S.save_graph(out, nodes=spark.createDataFrame([(9, "z")], "node_id long, label string"))
    assert [r.label for r in S.load_graph(spark, out, "nodes").collect()] == ["z"]


def test_ingest_of_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("A cat is an animal. The storm caused a flood! Nothing here\n\nA cat is an animal.\n")
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(x) for x in ({"article": "A cat is an animal. The storm caused a flood."}, {"sentence": "a cat is an animal"}, {"head": "storm", "relation": "causes", "tail": "rain"})))
    for name, more in (("a.txt", set()), ("b.jsonl", {("storm", "causes", "rain", 1)})):
        out = str(tmp_path / f"graph_{name}")
        S.ingest(spark, str(tmp_path / name), out)
        n = {r.node_id: r.label for r in S.load_graph(spark, out, "nodes").collect()}
        got = {(n[r.src], r.relation, n[r.dst], r.frequency) for r in S.load_graph(spark, out, "edges").collect()}
        assert got == {("a cat", "is", "animal", 2), ("the storm", "caused", "a flood", 1)} | more
        v = {r.node_id: r.v for r in S.load_graph(spark, out, "embeddings").collect()}
        assert v.keys() == n.keys() and all(abs(sum(y * y for y in x) - 1) < 1e-5 for x in v.values())


def test_feedback_stream_learns_once(spark, tmp_path):
    graph = str(tmp_path / "g")
    edges = spark.createDataFrame([(1, 2, "is_a", 0.5, 0.5), (2, 3, "is_a", 0.5, 0.5)], "src long, dst long, relation string, strength double, confidence double")
    S.save_graph(graph, edges=edges, batches=spark.createDataFrame([], "number long"))
    schema = "src long, dst long, relation string, eligibility double, reward double"
    spark.createDataFrame([(1, 2, "is_a", 1.0, 1.0), (1, 2, "is_a", 0.5, -1.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = streaming.learn_from(stream, graph, str(tmp_path / "ck"))
        q.awaitTermination(60)
    got = {(r.src, r.dst): round(r.strength, 6) for r in S.load_graph(spark, graph, "edges").collect()}
    assert got == {(1, 2): 0.525, (2, 3): 0.5}


def test_windowed_feedback_stream(spark, tmp_path):
    rows = [("2030-01-01 00:10:00", "click", 1.0), ("2030-01-01 00:50:00", "click", 2.0), ("2030-01-01 05:00:00", "view", 1.0)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "ev"))
    q = streaming.windowed_feedback(spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))).writeStream.format("memory").queryName("wf").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.event_type, r.n, r.total) for r in spark.sql("SELECT * FROM wf").collect()} == {("click", 2, 3.0), ("view", 1, 1.0)}


def test_state_metadata_and_metrics(spark, tmp_path):
    from weftgraph.sources import state

    a = spark.createDataFrame([(1, None, [1.5]), (2, "x", [])], "k long, s string, v array<double>")
    state.save_json(str(tmp_path / "j"), one=a, two=a.select("k"))
    state.save_json(str(tmp_path / "j"), one=a.filter("k = 2"), two=a.select("k"))
    back = state.load_json(spark, str(tmp_path / "j"), "one")
    assert back.schema == a.schema and [tuple(r) for r in back.collect()] == [(2, "x", [])]
    assert state.manifest(spark, str(tmp_path / "j")).count() == 2
    state.set_metadata(spark, str(tmp_path / "m"), {"a": "1", "b": "2"})
    state.set_metadata(spark, str(tmp_path / "m"), {"a": "3"})
    assert {r.key: r.value for r in state.get_metadata(spark, str(tmp_path / "m")).collect()} == {"a": "3", "b": "2"}
    state.save_state(str(tmp_path / "s"), theta=a)
    assert state.load_state(spark, str(tmp_path / "s"), "theta").count() == 2
    for bad in (lambda: state.save_state(str(tmp_path / "s"), other=a), lambda: state.load_state(spark, str(tmp_path / "s"), "other")):
        with pytest.raises(ValueError):
            bad()
    state.add_metrics(spark, str(tmp_path / "x"), "r1", {"loss": 0.5, "n": 3})
    state.add_metrics(spark, str(tmp_path / "x"), "r2", {"loss": 0.4})
    assert {(r.run, r.name, r.value) for r in state.metrics(spark, str(tmp_path / "x")).collect()} == {("r1", "loss", 0.5), ("r1", "n", 3.0), ("r2", "loss", 0.4)}


def test_ranges_take_the_first_kind(spark, tmp_path):
    rows = [{"sentence": f"s{i}."} for i in range(5)] + [{"head": "a", "relation": "r", "tail": "b"}] + [{"text": f"a long enough document {i}"} for i in range(4)]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert [r.text for r in S.read_any(spark, str(tmp_path / "m.jsonl"), 1, 3).orderBy("ord").collect()] == ["a long enough document 1", "a long enough document 2"]
    assert [r.text for r in S.read_any(spark, str(tmp_path / "m.jsonl"), max_entries=1).collect()] == ["a long enough document 0"]


def test_orphan_state_is_kept_by_a_stream(spark, tmp_path):
    from weftgraph.operators import orphans as O

    refs = spark.createDataFrame([(1, 5.0), (2, 1.0)], "node_id long, at double")
    nodes = spark.createDataFrame([(1, 2.0)], "node_id long, create_time double")
    empty = O.apply_deltas(O.reference_deltas(refs.limit(0)))
    S.save_graph(str(tmp_path / "st"), state=empty, batches=spark.createDataFrame([], "number long"))
    for i, delta in enumerate((O.reference_deltas(refs), O.existence_deltas(nodes), O.existence_deltas(nodes, -1))):
        delta.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = streaming.maintain_orphans(spark.readStream.schema(delta.schema).parquet(str(tmp_path / "in")), str(tmp_path / "st"), str(tmp_path / "cp"))
        q.awaitTermination()
        state = S.load_graph(spark, str(tmp_path / "st"), "state")
        assert {r.node_id for r in O.current_orphans(state).collect()} == ({1, 2}, {2}, {1, 2})[i]
