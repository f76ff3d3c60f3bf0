"""The graph as tables: cleaning, reading, statistics, changes, merging, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftgraph.session import cut

c = F.col


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def clean_nodes(nodes: DataFrame) -> DataFrame:
    """node_id, label, node_type, activation: one row an id; activation in [0.01, 1], 0.5 where unknown."""
    return nodes.filter(c("node_id").isNotNull()).groupBy("node_id").agg(F.min("label").alias("label"), F.min("node_type").alias("node_type"), clamp(F.coalesce(F.min("activation"), F.lit(0.5)), 0.01, 1.0).alias("activation"))


def clean_edges(edges: DataFrame) -> DataFrame:
    """src, dst, relation, strength, confidence, frequency, last_used: one row a key, the last written (largest edge_id) wins.

    Rows without an end, a relation or weights within [0, 1] are left out.
    """
    ok = c("source").isNotNull() & c("target").isNotNull() & c("relation").isNotNull()
    for w in ("strength", "confidence"):
        ok = ok & ~F.isnan(w) & c(w).between(0, 1)
    last = F.max(F.struct("edge_id", "strength", "confidence", "frequency", "last_used"))
    return (
        edges.filter(ok).groupBy(c("source").alias("src"), c("target").alias("dst"), "relation").agg(last.alias("r"))
        .select("src", "dst", "relation", "r.strength", "r.confidence", "r.frequency", "r.last_used")
    )


def upsert(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges with changes (same columns) put over them by key."""
    key = ["src", "dst", "relation"]
    return edges.join(changes.select(*key), key, "left_anti").unionByName(changes)


def update_weights(edges: DataFrame, changes: DataFrame, as_of: float) -> DataFrame:
    """strength and confidence from ``changes`` (key, strength, confidence); such edges get frequency + 1 and the time of the change."""
    key = ["src", "dst", "relation"]
    u = changes.select(*key, c("strength").alias("s"), c("confidence").alias("q"))
    j = edges.join(u, key, "left")
    hit = c("s").isNotNull()
    return j.select(*key, F.coalesce("s", "strength").alias("strength"), F.coalesce("q", "confidence").alias("confidence"), (c("frequency") + F.when(hit, 1).otherwise(0)).alias("frequency"), F.when(hit, F.lit(as_of)).otherwise(c("last_used")).alias("last_used"))


def missing_updates(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes of edges that aren't there, with the code of that error."""
    key = ["src", "dst", "relation"]
    return changes.join(edges.select(*key), key, "left_anti").withColumn("error_code", F.lit("E002"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Each edge seen from both ends, a self-loop once: node, other, relation, strength, confidence, and the edge's own src and dst."""
    keep = ["relation", "strength", "confidence", "src", "dst"]
    there = edges.select(c("src").alias("node"), c("dst").alias("other"), *keep)
    back = edges.filter("src <> dst").select(c("dst").alias("node"), c("src").alias("other"), *keep)
    return there.unionByName(back)


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree: both ends counted, a self-loop twice. Pre-aggregated, so a hub is a few rows when it travels."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def degree_summary(edges: DataFrame) -> DataFrame:
    """max, mean, upper median and buckets of the degrees; the median through counts a degree, not a list of all."""
    hist = degrees(edges).groupBy("degree").agg(F.count("*").alias("n"))
    w = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("upto", F.sum("n").over(w)).crossJoin(hist.agg(F.sum("n").alias("total")))
    d = c("degree")
    return h.agg(
        F.max("degree").alias("max_degree"), F.round(F.sum(d * c("n")) / F.sum("n"), 6).alias("mean_degree"), F.min(F.when(c("upto") > F.floor(c("total") / 2), d)).alias("median_degree"),
        F.sum(F.when(d == 1, c("n")).otherwise(0)).alias("deg_1"), F.sum(F.when(d == 2, c("n")).otherwise(0)).alias("deg_2"), F.sum(F.when(d > 2, c("n")).otherwise(0)).alias("deg_3plus"),
    )


def top_hubs(edges: DataFrame, k: int = 8) -> DataFrame:
    return degrees(edges).orderBy(c("degree").desc(), "node").limit(k)


def relation_distribution(edges: DataFrame) -> DataFrame:
    n = edges.groupBy("relation").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    bucket = F.when(c("n") >= 10, "10+").when(c("n") >= 2, "2-9").otherwise("1")
    return n.crossJoin(total).select("relation", "n", F.round(100 * c("n") / c("total"), 6).alias("pct"), bucket.alias("bucket"))


def graph_stats(nodes: DataFrame, edges: DataFrame, embedded: DataFrame) -> DataFrame:
    a = nodes.agg(F.count("*").alias("n_nodes"))
    b = edges.agg(F.count("*").alias("n_edges"), F.countDistinct("relation").alias("n_relations"), F.count_if(c("src") == c("dst")).alias("self_loops"))
    e = nodes.join(embedded.select("node_id").distinct(), "node_id", "left_semi").agg(F.count("*").alias("n_embedded"))
    return a.crossJoin(b).crossJoin(e).select(
        "n_nodes", "n_edges", "n_relations", "self_loops", F.round(c("n_edges") / c("n_nodes"), 6).alias("edges_per_node"),
        F.round(c("n_edges") / (c("n_nodes") * (c("n_nodes") - 1) / 2), 12).alias("density"), F.round(100 * c("n_embedded") / c("n_nodes"), 6).alias("embedded_pct"),
    )


def labelled_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src_label, relation, dst_label of every edge whose ends both exist."""
    n = nodes.select("node_id", "label")
    return edges.join(n.select(c("node_id").alias("src"), c("label").alias("src_label")), "src").join(n.select(c("node_id").alias("dst"), c("label").alias("dst_label")), "dst")


def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    ids = nodes.select("node_id")
    return edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that isn't among ``nodes``, and which."""
    have = nodes.select("node_id").withColumn("there", F.lit(True))
    a = have.select(c("node_id").alias("src"), c("there").alias("has_src"))
    b = have.select(c("node_id").alias("dst"), c("there").alias("has_dst"))
    j = edges.join(a, "src", "left").join(b, "dst", "left")
    return j.filter(c("has_src").isNull() | c("has_dst").isNull()).withColumn("missing_end", F.when(c("has_src").isNull() & c("has_dst").isNull(), "both").when(c("has_src").isNull(), "src").otherwise("dst"))


def prune(nodes: DataFrame, edges: DataFrame, threshold: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Nodes of at least the threshold (with a slack of 1e-6), and the edges between them."""
    kept = nodes.filter(c("activation") >= threshold - 1e-6)
    return kept, inside(edges, kept)


def two_hop_counts(edges: DataFrame) -> DataFrame:
    """node, n_in, n_out, walks: directed two-step walks through each node, counted and not listed, so that hubs cost nothing."""
    flows = edges.select(F.explode(F.array(F.struct(c("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(c("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    n = flows.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return n.filter("n_in > 0 and n_out > 0").withColumn("walks", c("n_in") * c("n_out"))


def hub_two_hop(edges: DataFrame, hubs: int = 5, first: int = 3, second: int = 3, cap: int = 12) -> DataFrame:
    """Two-step walks from the best-connected nodes: the first few targets of each, and of those."""
    top = F.broadcast(degrees(edges).orderBy(c("degree").desc(), "node").limit(hubs).select(c("node").alias("hub")))
    e = edges.select("src", "dst").distinct()
    w1 = Window.partitionBy("hub").orderBy("mid")
    a = top.join(e, c("hub") == c("src")).select("hub", c("dst").alias("mid")).withColumn("i", F.row_number().over(w1)).filter(c("i") <= first)
    w2 = Window.partitionBy("hub", "mid").orderBy("end")
    b = F.broadcast(a).join(e, c("mid") == c("src")).select("hub", "mid", c("dst").alias("end")).filter(c("end") != c("hub")).withColumn("j", F.row_number().over(w2)).filter(c("j") <= second)
    return b.orderBy("hub", "mid", "end").limit(cap).select("hub", "mid", "end")


def bfs(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int, floor: float = 0.01) -> DataFrame:
    """query_id, node, depth: what is reached from a query's seeds over nodes of at least ``floor`` activation, undirected.

    Lineage is cut at every level, since a frontier is read several times.
    """
    ok = nodes.filter(c("activation") >= floor).select(c("node_id").alias("node"))
    links = adjacency(edges).select("node", "other").distinct()
    reached = cut(seeds.select("query_id", "node").distinct().join(ok, "node", "left_semi").select("query_id", "node", F.lit(0).alias("depth")))
    frontier = reached
    for d in range(1, depth + 1):
        nxt = links.join(frontier.select("query_id", "node"), "node").select("query_id", c("other").alias("node")).distinct()
        nxt = nxt.join(ok, "node", "left_semi").join(reached, ["query_id", "node"], "left_anti").select("query_id", "node", F.lit(d).alias("depth"))
        frontier = cut(nxt)
        reached = reached.unionByName(frontier)
    return reached


def bounded_bfs(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int, most: int = 1000, floor: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` nodes a query reaches, nearest first, then by id, and every edge at one of them, once.

    The edges have ``boundary`` where one of their ends isn't among the nodes.
    """
    w = Window.partitionBy("query_id").orderBy("depth", "node")
    kept = cut(bfs(edges, nodes, seeds, depth, floor).withColumn("__rn", F.row_number().over(w)).filter(c("__rn") <= most).drop("__rn"))
    ids = kept.select("query_id", "node")
    touch = edges.join(ids.withColumnRenamed("node", "src"), "src").select("query_id", "src", "dst", "relation", F.lit(1).alias("ends"))
    touch = touch.unionByName(edges.join(ids.withColumnRenamed("node", "dst"), "dst").select("query_id", "src", "dst", "relation", F.lit(1).alias("ends")))
    return kept, touch.groupBy("query_id", "src", "dst", "relation").agg((F.count("*") < 2).alias("boundary"))


def components(pairs: DataFrame) -> DataFrame:
    """node, component: smallest id of each node's component, by alternating large and small stars on distinct links (a, b), until nothing changes.

    Every round is a few shuffles of the links left; their number falls with the logarithm of the longest path.
    """
    links = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = links.unionByName(links.select(c("v").alias("u"), c("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.join(m, "u").filter("v > u").select(c("v").alias("u"), c("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        new = small.select(c("v").alias("u"), c("m").alias("v")).unionByName(small.select("u", c("m").alias("v"))).filter("u <> v").distinct()
        new = cut(new)
        same = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        old = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        links = new
        if same == old:
            break
    nodes = links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    tops = links.select(c("v").alias("node")).distinct().join(nodes.select("node"), "node", "left_anti").select("node", c("node").alias("component"))
    return nodes.unionByName(tops)


def remap(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with ends renamed by (node, component); loops that arise go, equal keys keep their largest weights."""
    m = mapping.select("node", "component")
    j = edges.join(m.select(c("node").alias("src"), c("component").alias("s")), "src", "left").join(m.select(c("node").alias("dst"), c("component").alias("d")), "dst", "left")
    j = j.select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"), "relation", "strength", "confidence", (c("s").isNotNull() | c("d").isNotNull()).alias("moved"))
    return merge_weights(j.filter("src <> dst or not moved"))


def merge_weights(edges: DataFrame) -> DataFrame:
    """One edge a key: largest strength (1 at most) and confidence, and how many were merged."""
    return edges.groupBy("src", "dst", "relation").agg(F.least(F.lit(1.0), F.max("strength")).alias("strength"), F.max("confidence").alias("confidence"), F.count("*").alias("frequency"))


def reverse_union(edges: DataFrame) -> DataFrame:
    """Edges in both directions; where a key is there both ways, the turned edge's weights win."""
    turned = edges.select(c("dst").alias("src"), c("src").alias("dst"), "relation", "strength", "confidence")
    key = ["src", "dst", "relation"]
    return edges.select(*key, "strength", "confidence").join(turned.select(*key), key, "left_anti").unionByName(turned)


def jaccard(edges: DataFrame, pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """a, b, jaccard: overlap of the neighbours over edges of at least ``least`` confidence, by counting common ones; 0 for two empty sets.

    Of each pair the node with fewer neighbours has them listed and looked up among the other's, so a hub's are listed only where it meets a larger one.
    """
    ends = F.array(F.struct(c("src").alias("node"), c("dst").alias("other")), F.struct(c("dst").alias("node"), c("src").alias("other")))  # one pass; a loop's two are one after distinct()
    linked = edges.filter((c("confidence") >= least) & c("src").isNotNull() & c("dst").isNotNull())
    n = linked.select(F.explode(ends).alias("x")).select("x.*").filter("node is not null and other is not null").distinct()  # as the joins would ask, so that all share one shuffle
    deg = n.groupBy("node").agg(F.count("*").alias("d"))
    p = pairs.select("a", "b").distinct().join(deg.select(c("node").alias("a"), c("d").alias("da")), "a", "left").join(deg.select(c("node").alias("b"), c("d").alias("db")), "b", "left")
    p = p.withColumns({"da": F.coalesce("da", F.lit(0)), "db": F.coalesce("db", F.lit(0))})
    p = p.withColumns({"few": F.when(c("da") <= c("db"), c("a")).otherwise(c("b")), "many": F.when(c("da") <= c("db"), c("b")).otherwise(c("a"))})
    listed = p.select("few", "many").distinct().join(n.select(c("node").alias("few"), "other"), "few")
    common = listed.join(n.select(c("node").alias("many"), "other"), ["many", "other"]).groupBy("few", "many").agg(F.count("*").alias("k"))
    j, k = p.join(common, ["few", "many"], "left"), F.coalesce("k", F.lit(0))
    union = c("da") + c("db") - k
    return j.select("a", "b", F.when(union > 0, k / union).otherwise(0.0).alias("jaccard"))


def numbered(df: DataFrame, order: list, first: int = 1, name: str = "number") -> DataFrame:
    """Rows numbered from ``first`` in their order, by ranges, so no single task numbers all; the ranges' offsets are joined."""
    o = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__pid", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    offsets = o.groupBy("__pid").agg(F.count("*").alias("__n")).select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return o.join(F.broadcast(offsets), "__pid").withColumn(name, (c("__before") + c("__at") + first).cast("long")).drop("__pid", "__at", "__before")


def new_ids(labels: DataFrame, known: DataFrame) -> DataFrame:
    """label, node_id for labels that are not known: ids after the largest, in label order."""
    top = known.agg(F.coalesce(F.max("node_id"), F.lit(0)).alias("m")).first()["m"]
    fresh = labels.select("label").filter("label is not null").distinct().join(known.select("label"), "label", "left_anti")
    return numbered(fresh, ["label"], top + 1, "node_id")


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """error_code, field, n: rows that break a rule of the schema."""
    from weftgraph.params import NODE_TYPES

    n = nodes.select(
        F.count_if(c("label").isNull() | (F.length("label") > 256)).alias("label"), F.count_if(~c("node_type").isin(*NODE_TYPES) | c("node_type").isNull()).alias("node_type"), F.count_if(~c("activation").between(0, 1) | F.isnan("activation")).alias("activation")
    )
    e = edges.select(*[F.count_if(c(k).isNotNull() & (F.isnan(k) | ~c(k).between(0, 1))).alias(k) for k in ("strength", "confidence")])
    a = n.select(F.explode(F.array(*[F.struct(F.lit(code).alias("error_code"), F.lit(k).alias("field"), c(k).alias("n")) for code, k in (("E003", "label"), ("E004", "node_type"), ("E005", "activation"))])).alias("v")).select("v.*")
    b = e.select(F.explode(F.array(*[F.struct(F.lit("E006").alias("error_code"), F.lit(k).alias("field"), c(k).alias("n")) for k in ("strength", "confidence")])).alias("v")).select("v.*")
    return a.unionByName(b)
