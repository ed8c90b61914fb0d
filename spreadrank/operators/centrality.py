"""Baseline centralities; each gives (node_id, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.csr import broadcast_graph
from ..functions.session import cut
from .features import core_numbers, pagerank
from .graph import degrees, hop_layers

METHODS = ("DC", "BC", "CC", "CI", "PR", "KS")


def degree_centrality(adj: DataFrame) -> DataFrame:
    k = degrees(adj)
    n = k.agg(F.count(F.lit(1)).alias("n"))
    return k.crossJoin(F.broadcast(n)).select("node_id", F.coalesce(F.try_divide("k", F.col("n") - 1), F.lit(0.0)).alias("value"))


def closeness(adj: DataFrame, broadcast: bool = True) -> DataFrame:
    """(r - 1) / sum(d) * (r - 1) / (n - 1), r the nodes reached with the node itself."""
    nodes = degrees(adj).select("node_id")
    graph = broadcast_graph(adj) if broadcast else None
    if graph is not None:

        def run(batches):
            g = graph.value
            for pdf in batches:
                reached, total = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
                for at, own, _, part in g.by_component(g.index(pdf["node_id"].to_numpy())):
                    reached[at], total[at] = part.sums(own)
                yield pd.DataFrame({"node_id": pdf["node_id"], "reached": reached, "total": total})

        # whole multiples of 64 sources share a search
        spread = nodes.repartition(adj.sparkSession.sparkContext.defaultParallelism)
        sums = spread.mapInPandas(run, "node_id long, reached long, total long")
    else:
        front, before, d, sums = nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("node")), None, 0, None
        while True:  # all pairs by joins, layer by layer
            d += 1
            new = front.join(adj, front["node"] == adj["u"]).select("src", F.col("v").alias("node")).distinct().join(front, ["src", "node"], "left_anti")
            new = cut(new if before is None else new.join(before, ["src", "node"], "left_anti"))
            if new.isEmpty():
                break
            one = new.groupBy("src").agg(F.count(F.lit(1)).alias("n")).select("src", "n", F.lit(d).alias("d"))
            sums, before, front = one if sums is None else sums.union(one), front, new
        sums = sums.groupBy(F.col("src").alias("node_id")).agg(F.sum("n").alias("reached"), F.sum(F.col("n") * F.col("d")).alias("total"))
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    value = F.col("reached") / F.col("total") * F.col("reached") / (F.col("n") - 1)
    return sums.crossJoin(F.broadcast(n)).select("node_id", F.when(F.col("total") > 0, value).otherwise(0.0).alias("value"))


def betweenness(adj: DataFrame, pivots: int | None = None, broadcast: bool = True) -> DataFrame:
    """Normalised shortest-path betweenness (Brandes 2001); ``pivots``: so many sources by id order, scaled up (Brandes and Pich 2007)."""
    nodes = degrees(adj).select("node_id")
    sources = nodes if pivots is None else nodes.orderBy(F.xxhash64("node_id"), "node_id").limit(pivots)
    n, m = nodes.count(), sources.count()
    scale = 1.0 / ((n - 1) * (n - 2)) * n / max(m, 1) if n > 2 else 0.0
    graph = broadcast_graph(adj) if broadcast else None
    parts = _searched(adj, None if pivots is None else sources, graph) if graph is not None else _dependencies_by_joins(adj, sources)
    got = parts.groupBy("node_id").agg(F.sum("part").alias("part"))
    return nodes.join(got, "node_id", "left").select("node_id", (F.coalesce("part", F.lit(0.0)) * F.lit(scale)).alias("value"))


_SEARCHED = "node_id long, part double, reached long, total long"


def _searched(adj: DataFrame, sources: DataFrame | None, graph, shares: int = 2) -> DataFrame:
    """Rows (node_id, part, reached, total) whose sums are a node's dependencies over all sources and, if it is a source, the nodes it reaches and the sum of their distances.

    sources: None for all nodes, which are dealt out in equal shares of so many a core, component by component: a task holds one at a time and gives rows of its own ones only.
    """
    cores = adj.sparkSession.sparkContext.defaultParallelism

    def rows(g, own, nodes, piece):
        part, *found = piece.all_searches(own)
        reached, total = np.zeros((2, piece.n), np.int64)
        reached[own], total[own] = found
        return pd.DataFrame({"node_id": g.ids[nodes], "part": part, "reached": reached, "total": total})

    def all_nodes(batches):
        for pdf in batches:
            for i in pdf["id"]:
                for own, nodes, piece in graph.value.share(int(i), cores * shares):
                    yield rows(graph.value, own, nodes, piece)

    def some(batches):
        for pdf in batches:
            for _, own, nodes, piece in graph.value.by_component(graph.value.index(pdf["node_id"].to_numpy())):
                yield rows(graph.value, own, nodes, piece)

    if sources is None:
        return adj.sparkSession.range(0, cores * shares, 1, cores * shares).mapInPandas(all_nodes, _SEARCHED)
    return sources.repartition(cores).mapInPandas(some, _SEARCHED)


def betweenness_and_closeness(adj: DataFrame) -> DataFrame:
    """(method, node_id, value) of both: where the adjacency is small enough to broadcast, from one search of each source."""
    graph = broadcast_graph(adj)
    if graph is None:
        both = (("BC", betweenness(adj)), ("CC", closeness(adj)))
        return both[0][1].select(F.lit("BC").alias("method"), "node_id", "value").union(both[1][1].select(F.lit("CC").alias("method"), "node_id", "value"))
    nodes = degrees(adj).select("node_id")
    n = nodes.count()
    got = _searched(adj, None, graph).groupBy("node_id").agg(*[F.sum(c).alias(c) for c in ("part", "reached", "total")])
    between = F.col("part") * F.lit(1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0)
    close = F.when(F.col("total") > 0, F.col("reached") / F.col("total") * F.col("reached") / F.lit(max(n - 1, 1))).otherwise(0.0)
    rows = F.array(*[F.struct(F.lit(m).alias("method"), "node_id", x.alias("value")) for m, x in (("BC", between), ("CC", close))])
    return got.select(F.inline(rows))


def _dependencies_by_joins(adj: DataFrame, sources: DataFrame) -> DataFrame:
    """(node_id, part) of all sources, level by level: path counts forward, dependencies backward."""
    level = cut(sources.select(F.col("node_id").alias("s"), F.col("node_id").alias("x"), F.lit(1.0).alias("sigma")))
    levels = [level]
    while True:
        last = levels[-1]
        new = last.join(adj, last["x"] == adj["u"]).groupBy("s", F.col("v").alias("x")).agg(F.sum("sigma").alias("sigma"))
        for old in levels[-2:]:
            new = new.join(old.select("s", "x"), ["s", "x"], "left_anti")
        new = cut(new)
        if new.isEmpty():
            break
        levels.append(new)
    out, after = None, None
    for d in range(len(levels) - 1, 0, -1):
        here = levels[d]
        if after is None:
            here = here.withColumn("delta", F.lit(0.0))
        else:
            here = here.join(after, ["s", "x"], "left").withColumn("delta", F.coalesce("got", F.lit(0.0)))
        one = here.select(F.col("x").alias("node_id"), F.col("delta").alias("part"))
        out = one if out is None else out.union(one)
        up = levels[d - 1].select("s", F.col("x").alias("w"), F.col("sigma").alias("sw"))
        after = here.join(adj, here["x"] == adj["u"]).select("s", F.col("v").alias("w"), "sigma", "delta").join(up, ["s", "w"])
        after = cut(after.groupBy("s", F.col("w").alias("x")).agg(F.sum(F.col("sw") / F.col("sigma") * (1 + F.col("delta"))).alias("got")))
    return out if out is not None else adj.sparkSession.createDataFrame([], "node_id long, part double")


def collective_influence(adj: DataFrame, radius: int = 2, broadcast: bool = True, of: DataFrame | None = None) -> DataFrame:
    """(k - 1) times the sum of (k - 1) over the nodes at exactly ``radius`` hops. of: the nodes that are asked for, all by default.

    Where the adjacency is small enough to broadcast, from the balls of many nodes at once; else by joins.
    """
    k = degrees(adj)
    asked = k if of is None else k.join(F.broadcast(of.select("node_id")), "node_id", "left_semi")
    graph = broadcast_graph(adj) if broadcast else None
    if graph is not None:

        def run(batches, room=1_000_000):
            g = graph.value
            size = g.walks(radius)
            for pdf in batches:
                at = g.index(pdf["node_id"].to_numpy())
                for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(size[at]) // room)) + 1):
                    far, near = g.balls(at[some], radius), g.balls(at[some], radius - 1)
                    # sums of integers under 2**53
                    sums = [np.bincount(place, g.k[node] - 1.0, len(some)) for place, node in (np.divmod(keys, g.n) for keys in (far, near))]
                    total = (g.k[at[some]] - 1) * (sums[0] - sums[1]).astype(np.int64)
                    yield pd.DataFrame({"node_id": pdf["node_id"].to_numpy()[some], "value": total})

        return asked.select("node_id").repartition(adj.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "node_id long, value long")
    rim = hop_layers(adj, asked.select("node_id"), radius).where(F.col("dist") == radius)
    total = rim.join(k.select(F.col("node_id").alias("node"), "k"), "node").groupBy(F.col("src").alias("node_id")).agg(F.sum(F.col("k") - 1).alias("t"))
    return asked.join(total, "node_id", "left").select("node_id", ((F.col("k") - 1) * F.coalesce("t", F.lit(0))).alias("value"))


def all_baselines(adj: DataFrame, max_iter: int = 100, tol: float | None = 1e-6, methods: tuple[str, ...] = METHODS, of: DataFrame | None = None) -> DataFrame:
    """Long table (method, node_id, score) of the chosen baselines, of all nodes or those of a few rows ``of``. Betweenness takes all sources either way."""
    made = {
        "DC": lambda: degree_centrality(adj), "BC": lambda: betweenness(adj), "CC": lambda: closeness(adj), "CI": lambda: collective_influence(adj, of=of),
        "PR": lambda: pagerank(adj, max_iter=max_iter, tol=tol).withColumnRenamed("pagerank", "value"), "KS": lambda: core_numbers(adj).withColumnRenamed("core", "value"),
    }
    both = {"BC", "CC"} <= set(methods)
    parts = [betweenness_and_closeness(adj)] if both else []
    parts += [made[m]().select(F.lit(m).alias("method"), "node_id", "value") for m in methods if not (both and m in ("BC", "CC"))]
    out = None
    for one in parts:
        one = one.select("method", "node_id", F.col("value").cast("double").alias("score"))
        out = one if out is None else out.union(one)
    return out if of is None else out.join(F.broadcast(of.select("node_id")), "node_id", "left_semi").select("method", "node_id", "score")
