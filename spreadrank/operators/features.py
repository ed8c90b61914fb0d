"""Seven structural features of nodes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.csr import CSR, broadcast_graph
from ..functions.scale import minmax
from ..functions.session import cut
from .graph import adjacency, degrees

NAMES = ("degree", "avg_nbr_degree", "max_nbr_degree", "clustering", "core", "local_eff", "pagerank")


def degree_features(adj: DataFrame) -> DataFrame:
    """node_id, degree, avg_nbr_degree, max_nbr_degree."""
    k = degrees(adj)
    nbr = adj.join(k.select(F.col("node_id").alias("v"), "k"), "v")
    return nbr.groupBy(F.col("u").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"), F.avg("k").alias("avg_nbr_degree"), F.max("k").alias("max_nbr_degree"))


def triangles(adj: DataFrame) -> DataFrame:
    """Each triangle once, as (a, b, c) in order of (degree, id): few wedges start at a hub."""
    k = degrees(adj)
    e = adj.join(k.select(F.col("node_id").alias("u"), F.col("k").alias("ku")), "u").join(k.select(F.col("node_id").alias("v"), F.col("k").alias("kv")), "v")
    e = e.where("ku < kv or (ku = kv and u < v)").select("u", "v")
    ab, bc, ac = e.toDF("a", "b"), e.toDF("b", "c"), e.toDF("a", "c")
    return ab.join(bc, "b").join(ac, ["a", "c"]).select("a", "b", "c")


def _of_neighbours(adj: DataFrame, graph, kernel, column: str, room: int = 1_000_000) -> DataFrame:
    """(node_id, value) of a kernel that takes degrees and the subgraphs of the neighbours, of many nodes side by side, some room edges at once."""

    def run(batches):
        g = graph.value
        size = g.walks(2)
        for pdf in batches:
            at = g.index(pdf["node_id"].to_numpy())
            for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(size[at]) // room)) + 1):
                own = g.side_by_side(g.neighbours(at[some]))
                yield pd.DataFrame({"node_id": pdf["node_id"].to_numpy()[some], column: kernel(g.n, g.k[at[some]], own)})

    return degrees(adj).select("node_id").repartition(adj.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, f"node_id long, {column} double")


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is 0."""
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def clustering(adj: DataFrame, broadcast: bool = True) -> DataFrame:
    """2 T / (k (k - 1)); 0 for degrees under 2."""
    graph = broadcast_graph(adj) if broadcast else None
    if graph is not None:
        return _of_neighbours(adj, graph, lambda n, k, own: _ratio(np.bincount(own.ids // n, own.k, len(k)), k * (k - 1)), "clustering")
    t = triangles(adj).select(F.explode(F.array("a", "b", "c")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("t"))
    k = F.col("k")
    return degrees(adj).join(t, "node_id", "left").select("node_id", F.when(k < 2, 0.0).otherwise(2.0 * F.coalesce("t", F.lit(0)) / (k * (k - 1))).alias("clustering"))


def _of_whole(adj: DataFrame, graph, kernel, schema: str) -> DataFrame:
    """(node_id, value) of a kernel that takes time in proportion to the graph: one task."""

    def run(batches):
        for _ in batches:
            yield pd.DataFrame(dict(zip(names, (graph.value.ids, kernel(graph.value)))))

    names = [c.split()[0] for c in schema.split(", ")]
    return adj.sparkSession.range(0, 1, 1, 1).mapInPandas(run, schema)


def core_numbers(adj: DataFrame, max_rounds: int = 1000, broadcast: bool = True) -> DataFrame:
    """k-core index: by peeling where the adjacency is small enough to broadcast, else as the fixed point of neighbourhood h-indices, from degrees down."""
    graph = broadcast_graph(adj) if broadcast else None
    if graph is not None:
        return _of_whole(adj, graph, lambda g: g.cores(), "node_id long, core long")
    h = cut(degrees(adj).select("node_id", F.col("k").alias("core")))
    total = h.agg(F.sum("core")).first()[0]
    for _ in range(max_rounds):
        seen = adj.join(h.select(F.col("node_id").alias("v"), "core"), "v")
        # how many neighbours have at least each value: counts by (node, value), then a running sum
        at = seen.groupBy("u", "core").agg(F.count(F.lit(1)).alias("n"))
        run = F.sum("n").over(Window.partitionBy("u").orderBy(F.desc("core")))
        new = at.select("u", F.least("core", run).alias("h")).groupBy(F.col("u").alias("node_id")).agg(F.max("h").alias("core"))
        h, before = cut(new), total
        total = h.agg(F.sum("core")).first()[0]
        if total == before:  # values only fall
            break
    return h


def _efficiency(n: int, k: np.ndarray, own: CSR, mode: str) -> np.ndarray:
    total, pairs = np.zeros(len(k)), np.zeros(len(k), np.int64)
    for d, at, found in own.kept(own.k > 0).searched(n, len(k)):
        total[at] += found / d
        pairs[at] += found
    return _ratio(total, pairs if mode == "reachable" else k * (k - 1))


def local_efficiency(adj: DataFrame, mode: str = "reachable", max_sources: int | None = None, broadcast: bool = True) -> DataFrame:
    """Mean of 1 / distance between neighbours, inside the subgraph of the neighbours only.

    mode "reachable" averages over ordered pairs that reach each other, "standard"
    over all k (k - 1) pairs. max_sources: at most so many sources of a node, by id.

    Where the adjacency is small enough to broadcast (and all sources count), the
    neighbours' subgraphs of many nodes are searched side by side; else by joins.
    """
    graph = broadcast_graph(adj) if broadcast and not max_sources else None
    if graph is not None:
        return _of_neighbours(adj, graph, lambda n, k, own: _efficiency(n, k, own, mode), "local_eff")
    t = triangles(adj)
    sides = F.array(*[F.struct(F.col(c).alias("c"), F.col(a).alias("a"), F.col(b).alias("b")) for c, a, b in (("a", "b", "c"), ("a", "c", "b"), ("b", "a", "c"), ("b", "c", "a"), ("c", "a", "b"), ("c", "b", "a"))])
    sub = cut(t.select(F.explode(sides).alias("s")).select("s.c", "s.a", "s.b"))  # edges a-b among the neighbours of c
    front = sub.select("c", F.col("a").alias("s"), F.col("a").alias("x")).distinct()
    if max_sources:
        rank = F.dense_rank().over(Window.partitionBy("c").orderBy("s"))
        front = front.withColumn("r", rank).where(F.col("r") <= max_sources).drop("r")
    before, d, sums = None, 0, None
    while True:
        d += 1
        new = front.join(sub, (front["c"] == sub["c"]) & (front["x"] == sub["a"])).select(front["c"], "s", F.col("b").alias("x")).distinct().join(front, ["c", "s", "x"], "left_anti")
        if before is not None:
            new = new.join(before, ["c", "s", "x"], "left_anti")
        new = cut(new)
        found = new.groupBy("c").agg(F.count(F.lit(1)).alias("n")).withColumn("d", F.lit(d))
        if new.isEmpty():
            break
        sums = found if sums is None else sums.union(found)
        before, front = front, new
    k = degrees(adj)
    if sums is None:
        return k.select("node_id", F.lit(0.0).alias("local_eff"))
    total = sums.groupBy(F.col("c").alias("node_id")).agg(F.sum(F.col("n") / F.col("d")).alias("total"), F.sum("n").alias("pairs"))
    by = F.col("pairs") if mode == "reachable" else F.col("k") * (F.col("k") - 1)
    return k.join(total, "node_id", "left").select("node_id", F.when(F.col("k") < 2, 0.0).otherwise(F.coalesce(F.try_divide(F.col("total"), by), F.lit(0.0))).alias("local_eff"))


def pagerank(adj: DataFrame, damping: float = 0.85, max_iter: int = 100, tol: float | None = 1e-6, broadcast: bool = True) -> DataFrame:
    """Power iteration. Stops at max_iter, or when the L1 change is under n * tol (None: never)."""
    graph = broadcast_graph(adj) if broadcast else None
    if graph is not None:
        return _of_whole(adj, graph, lambda g: g.pagerank(damping, max_iter, tol), "node_id long, pagerank double")
    k = cut(degrees(adj))
    n = k.count()
    out = adj.join(k.select(F.col("node_id").alias("u"), "k"), "u")
    r = k.select("node_id", F.lit(1.0 / max(n, 1)).alias("pagerank"))
    for i in range(max_iter):
        sent = out.join(r.select(F.col("node_id").alias("u"), "pagerank"), "u").groupBy(F.col("v").alias("node_id")).agg(F.sum(F.col("pagerank") / F.col("k")).alias("got"))
        new = sent.select("node_id", (F.lit((1 - damping) / max(n, 1)) + F.lit(damping) * F.col("got")).alias("pagerank"))
        if i % 5 == 4 or tol is not None:
            new = cut(new)
        if tol is not None:
            moved = new.join(r.withColumnRenamed("pagerank", "_b"), "node_id").agg(F.sum(F.abs(F.col("pagerank") - F.col("_b")))).first()[0]
            if moved is None or moved < n * tol:
                return new
        r = new
    return r


def node_features(edges: DataFrame, max_iter: int = 20, tol: float | None = None, adj: DataFrame | None = None) -> DataFrame:
    """node_id and the seven raw features as doubles. adj: adjacency(edges), where it is cut already."""
    adj = cut(adjacency(edges)) if adj is None else adj
    out = degree_features(adj)
    for one in (clustering(adj), core_numbers(adj), local_efficiency(adj), pagerank(adj, max_iter=max_iter, tol=tol)):
        out = out.join(one, "node_id")
    return out.select("node_id", *[F.col(c).cast("double").alias(c) for c in NAMES])


def scaled_features(features: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    return minmax(features, list(names)).select("node_id", *[f"{c}_norm" for c in names])
