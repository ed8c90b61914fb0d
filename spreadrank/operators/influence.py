"""Local, semi-local, path-disruption and semantic influence, and their weighted score."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.csr import CSR, broadcast_graph
from ..functions.scale import minmax
from .graph import balls, degrees, hop_layers

PARTS = ("cli", "csli", "caspi", "csi")
EQUAL = (0.25, 0.25, 0.25, 0.25)


def local_influence(adj: DataFrame) -> DataFrame:
    """k / k_max."""
    k = degrees(adj)
    top = k.agg(F.greatest(F.max("k"), F.lit(1)).alias("top"))
    return k.crossJoin(F.broadcast(top)).select("node_id", (F.col("k") / F.col("top")).alias("cli"))


def _semilocal(g: CSR, centers: np.ndarray, pairs: tuple, depth: int, decay: float) -> np.ndarray:
    """semilocal_influence() of many centers. pairs: places among the centers, node ids and weights of the blended graph."""
    keys = g.balls(centers, depth)
    dist = np.full(len(keys), depth)
    for d in range(depth - 1, -1, -1):
        dist[np.searchsorted(keys, g.balls(centers, d))] = d
    place, node, w = pairs
    at = np.minimum(g.index(node), g.n - 1)
    key = place * g.n + at
    found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    on = (g.ids[at] == node) & (keys[found] == key) & (w != 0) & ~np.isnan(w)
    weight = np.ones(len(keys))
    weight[found[on]] = w[on]
    far = dist > 0
    place, node = np.divmod(keys[far], g.n)
    return np.bincount(place, float(decay) ** dist[far] * weight[far] * g.k[node] / dist[far], len(centers))


def semilocal_influence(adj: DataFrame, ga: DataFrame, hops: DataFrame | None = None, depth: int = 2, decay: float = 0.85, broadcast: bool = True) -> DataFrame:
    """Sum over the hop layers of decay**l / l * w * k; a pair without a weight (or of weight 0) counts as 1.

    Where the adjacency is small enough to broadcast (and no hops are given), from the balls of many nodes at once; else by joins.
    """
    k = degrees(adj)
    graph = broadcast_graph(adj) if broadcast and hops is None else None
    if graph is not None:

        def run(batches, room=1_000_000):
            g = graph.value
            size = g.walks(depth)
            for pdf in batches:
                at = g.index(pdf["node_id"].to_numpy())
                for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(size[at]) // room)) + 1):
                    if not len(some):
                        continue
                    here = pdf.iloc[some]
                    js, ws = ([np.asarray(x, t) if x is not None else np.zeros(0, t) for x in here[c]] for c, t in (("j", np.int64), ("w", float)))
                    pairs = np.repeat(np.arange(len(some)), [len(x) for x in js]), np.concatenate(js), np.concatenate(ws)
                    yield pd.DataFrame({"node_id": here["node_id"], "csli": _semilocal(g, at[some], pairs, depth, decay)})

        row = ga.groupBy(F.col("i").alias("node_id")).agg(F.collect_list(F.struct("j", "w")).alias("row"))
        each = k.select("node_id").join(row, "node_id", "left").select("node_id", F.col("row.j").alias("j"), F.col("row.w").alias("w"))
        return each.repartition(adj.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "node_id long, csli double")
    hops = hop_layers(adj, k.select("node_id"), depth) if hops is None else hops
    each = hops.join(k.withColumnRenamed("node_id", "node"), "node").join(ga.select(F.col("i").alias("src"), F.col("j").alias("node"), "w"), ["src", "node"], "left")
    w = F.coalesce(F.nullif("w", F.lit(0.0)), F.lit(1.0))
    total = each.groupBy(F.col("src").alias("node_id")).agg(F.sum(F.pow(F.lit(decay), "dist") * w * F.col("k") / F.col("dist")).alias("csli"))
    return k.select("node_id").join(total, "node_id", "left").select("node_id", F.coalesce("csli", F.lit(0.0)).alias("csli"))


def mean_path(edges: DataFrame) -> DataFrame:
    """One row: mean distance over ordered pairs of the largest component (whole graph on one task: for small graphs)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = pdf["u"].to_numpy(), pdf["v"].to_numpy()
        return pd.DataFrame({"asp": [CSR(np.append(u, v), np.append(v, u)).path_length()]})

    return edges.groupBy(F.lit(1)).applyInPandas(run, "asp double")


def _disruption(ball: CSR, center: int) -> float:
    whole = ball.path_length()
    if whole < 1e-12:
        return 0.0
    rest = ball.induced(np.delete(np.arange(ball.n), center))
    return abs(whole - rest.path_length()) / whole


def _disruptions(g: CSR, centers: np.ndarray, depth: int, size: np.ndarray, room: int = 1_000_000) -> np.ndarray:
    """_disruption() of many centers' balls. size bounds the edges met in a ball; balls of like sizes are searched side by side, some room edges at once."""
    out, order = np.zeros(len(centers)), np.argsort(size[centers], kind="stable")
    group = np.cumsum(size[centers][order]) // room
    for some in np.split(order, np.flatnonzero(np.diff(group)) + 1):
        keys = g.balls(centers[some], depth)
        both = g.side_by_side(keys)
        whole = both.path_lengths(g.n, len(some))
        rest = both.kept(~np.isin(keys, np.arange(len(some)) * g.n + centers[some])).path_lengths(g.n, len(some))
        out[some] = np.divide(np.abs(whole - rest), whole, out=np.zeros(len(some)), where=whole >= 1e-12)
    return out


def path_disruption(adj: DataFrame, centers: DataFrame | None = None, depth: int = 2, broadcast: bool = True) -> DataFrame:
    """|ASP(ball) - ASP(ball without its center)| / ASP(ball), with exact path lengths.

    Where the adjacency is small enough to broadcast, each task cuts its
    centers' balls out of it, many at once, and searches these only; else every
    ball's edges are gathered by joins.
    """
    if centers is None:
        centers = degrees(adj).select("node_id")
    graph = broadcast_graph(adj) if broadcast else None
    if graph is not None:

        def run(batches):
            g = graph.value
            size = g.walks(depth + 1)
            for pdf in batches:
                yield pd.DataFrame({"node_id": pdf["node_id"], "caspi": _disruptions(g, g.index(pdf["node_id"].to_numpy()), depth, size)})

        return centers.select("node_id").repartition(adj.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "node_id long, caspi double")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v, c = pdf["u"].to_numpy(), pdf["v"].to_numpy(), pdf["center"].iloc[0]
        ball = CSR(np.append(u, v), np.append(v, u))
        return pd.DataFrame({"node_id": [c], "caspi": [_disruption(ball, int(ball.index(np.array([c]))[0]))]})

    return balls(adj, centers, depth).groupBy("center").applyInPandas(one, "node_id long, caspi double")


def semantic_influence(ga: DataFrame) -> DataFrame:
    """Row sums of the blended graph."""
    return ga.groupBy(F.col("i").alias("node_id")).agg(F.sum("w").alias("csi"))


def weighted_score(parts: DataFrame, xi: tuple[float, ...] = EQUAL) -> DataFrame:
    """Adds score from the scaled components."""
    total = F.lit(0.0)
    for c, x in zip(PARTS, xi, strict=True):
        total = total + F.lit(float(x)) * F.col(f"{c}_norm")
    return parts.withColumn("score", total)


def influence_components(adj: DataFrame, ga: DataFrame, depth: int = 2, xi: tuple[float, ...] = EQUAL, path_depth: int | None = None) -> DataFrame:
    """node_id, the four components raw and scaled, and the score."""
    out = local_influence(adj)
    for one in (semilocal_influence(adj, ga, depth=depth), path_disruption(adj, depth=path_depth or depth), semantic_influence(ga)):
        out = out.join(one, "node_id", "left")
    return weighted_score(minmax(out.na.fill(0.0, list(PARTS)), list(PARTS)), xi)

