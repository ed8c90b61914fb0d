"""Graph construction and traversal over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import cut
from ..sources.edges import nodes_of, simple_edges


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    return edges.select("u", "v").union(edges.select("v", "u"))


def degrees(adj: DataFrame) -> DataFrame:
    return adj.groupBy(F.col("u").alias("node_id")).agg(F.count(F.lit(1)).alias("k"))


def graph_stats(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """nodes, edges, avg_degree (2 places), max_degree and density; zeros for an empty graph."""
    k = degrees(adjacency(edges))
    if nodes is not None:
        k = nodes.join(k, "node_id", "left").select("node_id", F.coalesce("k", F.lit(0)).alias("k"))
    one = k.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("k"), F.lit(0)).alias("ends"), F.coalesce(F.max("k"), F.lit(0)).alias("max_degree"))
    return one.select(
        "nodes", F.expr("ends div 2").alias("edges"), F.round(F.coalesce(F.try_divide("ends", "nodes"), F.lit(0.0)), 2).alias("avg_degree"),
        "max_degree", F.round(F.coalesce(F.try_divide(F.col("ends"), F.expr("nodes * (nodes - 1)")), F.lit(0.0)), 9).alias("density"),
    )


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node_id, component): the smallest node id reached. Alternating large and small stars."""
    e, before = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()), None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFF))).first()
        if now == before or not now[0]:
            break
        before = now
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    found = e.select(F.col("u").alias("node_id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
    if nodes is None:
        return found
    return nodes.join(found, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def largest_component(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes of the largest component; of equal ones that of the smallest id."""
    parts = connected_components(edges, nodes)
    best = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return parts.join(F.broadcast(best.select("component")), "component", "left_semi").select("node_id")


def clean_graph(pairs: DataFrame) -> DataFrame:
    """Simple undirected edges of the largest component of raw pairs."""
    edges = simple_edges(pairs)
    return induced(edges, largest_component(edges, nodes_of(pairs)))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are among the nodes."""
    return edges.join(nodes.select(F.col("node_id").alias("u")), "u", "left_semi").join(nodes.select(F.col("node_id").alias("v")), "v", "left_semi").select("u", "v")


def without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which no end is among the nodes."""
    return edges.join(nodes.select(F.col("node_id").alias("u")), "u", "left_anti").join(nodes.select(F.col("node_id").alias("v")), "v", "left_anti").select("u", "v")


def hop_layers(adj: DataFrame, sources: DataFrame, depth: int = 2, center: bool = False) -> DataFrame:
    """(src, node, dist) for 1 <= dist <= depth, and dist 0 with ``center``.

    In an undirected graph a new layer can only meet the two layers before it.
    """
    last = sources.select(F.col("node_id").alias("src"), F.col("node_id").alias("node"))
    layers, before = [last.withColumn("dist", F.lit(0))], None
    for d in range(1, depth + 1):
        new = last.join(adj, last["node"] == adj["u"]).select("src", F.col("v").alias("node")).distinct().join(last, ["src", "node"], "left_anti")
        if before is not None:
            new = new.join(before, ["src", "node"], "left_anti")
        if d > 2:
            new = cut(new)
        before, last = last, new
        layers.append(new.withColumn("dist", F.lit(d)))
    out = layers[0] if center else layers[1]
    for one in layers[1 if center else 2 :]:
        out = out.union(one)
    return out


def balls(adj: DataFrame, centers: DataFrame, depth: int = 2, center: bool = True) -> DataFrame:
    """(center, u, v), u < v: the induced subgraph of each center's ball, with or without the center."""
    at = hop_layers(adj, centers, depth, center).select(F.col("src").alias("center"), "node")
    e = at.join(adj.where("u < v"), at["node"] == F.col("u")).select("center", "u", "v")
    return e.join(at.select("center", F.col("node").alias("v")), ["center", "v"], "left_semi").select("center", "u", "v")


def ego_subgraph(adj: DataFrame, seeds: DataFrame, cap: int = 300, radius: int = 2) -> DataFrame:
    """Nodes of the seeds' ego graphs, seed by seed (by rank) while fewer than cap, then cut at cap.

    seeds: (node_id, rank). Order: rank of the first seed that reaches a node, distance, id.
    """
    reach = hop_layers(adj, seeds.select("node_id"), radius, center=True).join(seeds.withColumnRenamed("node_id", "src"), "src")
    first = reach.groupBy("node").agg(F.min(F.struct("rank", "dist")).alias("at")).select(F.col("node").alias("node_id"), "at.rank", "at.dist")
    size = first.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))  # one row a seed
    so_far = size.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    used = first.join(F.broadcast(so_far.where(F.col("before") < cap).select("rank")), "rank")
    return used.orderBy("rank", "dist", "node_id").limit(cap).select("node_id", "rank", "dist")


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node_id, community) by synchronous label propagation; the most frequent label, then the smallest, wins."""
    adj = adjacency(edges)
    label = cut(degrees(adj).select("node_id", F.col("node_id").alias("community")))
    for i in range(rounds):
        votes = adj.join(label, adj["v"] == label["node_id"]).groupBy("u", "community").agg(F.count(F.lit(1)).alias("n"))
        own = label.select(F.col("node_id").alias("u"), "community", F.lit(1).cast("long").alias("n"))  # a vote for itself damps oscillation
        votes = votes.union(own).groupBy("u", "community").agg(F.sum("n").alias("n"))
        best = votes.groupBy("u").agg(F.max(F.struct("n", (-F.col("community")).alias("m"))).alias("b"))
        label = best.select(F.col("u").alias("node_id"), (-F.col("b.m")).alias("community"))
        if i % 3 == 2:
            label = cut(label)
    return label


def modularity(edges: DataFrame, label: DataFrame) -> DataFrame:
    """One row: Newman modularity of a labelling."""
    adj = adjacency(edges)
    a = adj.join(label.select(F.col("node_id").alias("u"), F.col("community").alias("cu")), "u").join(label.select(F.col("node_id").alias("v"), F.col("community").alias("cv")), "v")
    own = a.groupBy("cu").agg(F.sum((F.col("cu") == F.col("cv")).cast("long")).alias("inside"), F.count(F.lit(1)).alias("ends"))
    total = F.sum("ends").over(Window.partitionBy())
    return own.select(F.col("inside") / total - F.pow(F.col("ends") / total, 2)).toDF("q").agg(F.round(F.sum("q"), 9).alias("modularity"))
