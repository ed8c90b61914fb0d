"""SIR spreading with portable coins.

With recovery after one step, a node's infection time is its distance from the
seeds over the directed edges whose coin falls under the rate. Each edge's coin
depends on (u, v, run, salt), so runs, rates and seeds of one call share a job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.csr import broadcast_graph, distinct
from ..functions.rand import coin, coin_sql, threshold
from ..functions.session import cut

RATE, STEPS = 0.1, 20
_TIMES = "label string, run long, node_id long, t int"


def runs_of(seeds: DataFrame, runs: int, first: int = 0, salt: str = "0", rate: float = RATE) -> DataFrame:
    """(label, run, salt, rate, node_id): every seed in every run. seeds: (label, node_id)."""
    each = F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + runs - 1).cast("long"))).alias("run")
    return seeds.select(F.col("label").cast("string").alias("label"), F.col("node_id").cast("long").alias("node_id"), each).withColumn("salt", F.expr(f"cast({salt} as bigint)")).withColumn("rate", F.lit(float(rate)))


def infections(adj: DataFrame, started: DataFrame, steps: int = STEPS, broadcast: bool = True, gone: DataFrame | None = None) -> DataFrame:
    """(label, run, node_id, t) of every infection, for recovery after one step.

    started: rows of runs_of(); (label, run) has one salt and one rate. Seeds
    that are not in the graph are ignored. gone: a few (label, node_id) that are
    removed from the label's graph; a node left without an edge is not in it.
    """
    graph = broadcast_graph(adj) if broadcast else None
    if graph is not None:
        given = started.groupBy("label", "run").agg(F.first("salt").alias("salt"), F.first("rate").alias("rate"), F.collect_set("node_id").alias("seeds"))
        if gone is not None:
            given = given.join(F.broadcast(gone.groupBy("label").agg(F.collect_set("node_id").alias("gone"))), "label", "left")

        def places(g, ids):
            want = np.asarray(ids, np.int64)
            at = np.minimum(g.index(want), max(g.n - 1, 0))
            return at[g.ids[at] == want] if g.n else at[:0]

        def run(batches):
            g = graph.value
            for pdf in batches:
                for r in pdf.itertuples():
                    front, t = places(g, r.seeds), np.full(g.n, -1, np.int32)
                    if getattr(r, "gone", None) is not None:
                        t[places(g, r.gone)] = -2
                        front = front[[t[x] == -1 and bool((t[g.tail[g.at[x] : g.at[x + 1]]] == -1).any()) for x in front]]
                    t[front] = 0
                    limit = threshold(r.rate)
                    for step in range(1, steps + 1):
                        e = g.edges_of(front)
                        live = coin(g.ids[g.head[e]], g.ids[g.tail[e]], r.run, r.salt) < limit
                        front = distinct(g.tail[e[live]])
                        front = front[t[front] == -1]
                        if not len(front):
                            break
                        t[front] = step
                    hit = np.flatnonzero(t >= 0)
                    yield pd.DataFrame({"label": r.label, "run": r.run, "node_id": g.ids[hit], "t": t[hit]})

        return given.repartition(adj.sparkSession.sparkContext.defaultParallelism, "label", "run").mapInPandas(run, _TIMES)
    key = ["label", "run", "node_id"]
    left = lambda rows, node: rows if gone is None else rows.join(F.broadcast(gone.select("label", F.col("node_id").alias(node))), ["label", node], "left_anti")
    if gone is not None:
        near = left(started.select("label", "node_id").distinct().join(adj, F.col("node_id") == adj["u"]).select("label", "node_id", "v"), "v")
        started = left(started, "node_id").join(near.select("label", "node_id").distinct(), ["label", "node_id"], "left_semi")
    known = adj.select(F.col("u").alias("node_id")).distinct()
    front = cut(started.join(known, "node_id", "left_semi").select("label", "run", "salt", "rate", "node_id").distinct())
    seen = front.select(*key, F.lit(0).alias("t"))
    limit = F.floor(F.col("rate") * F.lit(2147483647)).cast("long")
    for step in range(1, steps + 1):
        tried = front.join(adj, front["node_id"] == adj["u"])
        new = tried.where(F.expr(coin_sql("u", "v", "run", "salt")) < limit).select("label", "run", "salt", "rate", F.col("v").alias("node_id")).distinct()
        front = cut(left(new, "node_id").join(seen, key, "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.union(front.select(*key, F.lit(step).alias("t"))))
    return seen.select("label", "run", "node_id", F.col("t").cast("int").alias("t"))


def run_curves(times: DataFrame, steps: int = STEPS) -> DataFrame:
    """(label, run, t, f) for t from 0 to steps: nodes infected so far."""
    at = times.groupBy("label", "run", "t").agg(F.count(F.lit(1)).alias("n"))
    grid = at.select("label", "run").distinct().select("label", "run", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("t"))
    so_far = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("label", "run").orderBy("t"))
    return grid.join(at, ["label", "run", "t"], "left").select("label", "run", "t", so_far.alias("f"))


def curves(times: DataFrame, steps: int = STEPS) -> DataFrame:
    """(label, t, f, f_std): mean and population deviation of the runs."""
    return run_curves(times, steps).groupBy("label", "t").agg(F.avg("f").alias("f"), F.stddev_pop("f").alias("f_std"))


def spread_curve(adj: DataFrame, seeds: DataFrame, rate: float = RATE, steps: int = STEPS, runs: int = 25, broadcast: bool = True) -> DataFrame:
    """Mean curve of each label's seeds."""
    return curves(infections(adj, runs_of(seeds, runs, rate=rate), steps, broadcast), steps).select("label", "t", "f")


def node_influence(adj: DataFrame, nodes: DataFrame, rate: float = RATE, steps: int = STEPS, runs: int = 10) -> DataFrame:
    """(node_id, sir): the mean final size from each single seed, with coins of its own."""
    seeds = nodes.select(F.col("node_id").alias("label"), "node_id")
    times = infections(adj, runs_of(seeds, runs, salt="node_id", rate=rate), steps)
    return times.groupBy("label", "run").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("label").cast("long").alias("node_id")).agg((F.sum("n") / F.lit(runs)).alias("sir"))


def curve_metrics(curve: DataFrame, n_nodes: int, share: float = 0.95) -> DataFrame:
    """label, f_final, ratio, t_sat (first t with f >= share * f_final) and t_peak (after the largest growth, the first on ties)."""
    by = Window.partitionBy("label")
    x = curve.withColumn("last", F.max_by("f", "t").over(by)).withColumn("t_last", F.max("t").over(by))
    x = x.withColumn("growth", F.col("f") - F.lag("f").over(by.orderBy("t")))
    out = x.groupBy("label").agg(
        F.first("last").alias("f_final"), F.first("t_last").alias("t_last"), F.min(F.when(F.col("f") >= share * F.col("last"), F.col("t"))).alias("sat"),
        F.max(F.when(F.col("growth").isNotNull(), F.struct(F.round("growth", 9).alias("g"), (-F.col("t")).alias("m")))).alias("peak"),
    )
    return out.select(
        "label", "f_final", (F.lit(0.0) if n_nodes == 0 else F.col("f_final") / F.lit(n_nodes)).alias("ratio"),
        F.when(F.col("f_final") < 1e-12, F.col("t_last")).otherwise(F.col("sat")).cast("int").alias("t_sat"), F.coalesce(-F.col("peak.m"), F.lit(0)).cast("int").alias("t_peak"),
    )


def slow_recovery_curve(adj: DataFrame, seeds: DataFrame, rate: float = RATE, recovery: float = 0.5, steps: int = STEPS, runs: int = 5) -> DataFrame:
    """(label, t, f, s, i, r): mean curves with recovery by chance; coins are keyed by step as well.

    A node infected at t first infects and may first recover at t + 1.
    """
    adj = cut(adj)
    n = degrees_count(adj)
    state = cut(runs_of(seeds, runs).join(adj.select(F.col("u").alias("node_id")).distinct(), "node_id", "left_semi").select("label", "run", "node_id", F.lit(1).alias("s")).distinct())
    rows = None
    for t in range(steps + 1):
        one = state.groupBy("label", "run").agg(F.count(F.lit(1)).alias("f"), F.sum(F.when(F.col("s") == 1, 1).otherwise(0)).alias("i")).withColumn("t", F.lit(t))
        rows = one if rows is None else rows.union(one)
        if t == steps:
            break
        sick = state.where("s = 1")
        hit = sick.join(adj, sick["node_id"] == adj["u"]).where(F.expr(coin_sql("u", "v", "run", str(1000 + t))) < threshold(rate)).select("label", "run", F.col("v").alias("node_id")).distinct()
        hit = hit.join(state, ["label", "run", "node_id"], "left_anti").withColumn("s", F.lit(1))
        well = F.expr(coin_sql("node_id", "5", "run", str(5000 + t))) < threshold(recovery)
        state = cut(state.withColumn("s", F.when((F.col("s") == 1) & well, 2).otherwise(F.col("s"))).union(hit))
    return rows.groupBy("label", "t").agg(F.avg("f").alias("f"), F.avg("i").alias("i")).select("label", "t", "f", (F.lit(n) - F.col("f")).alias("s"), "i", (F.col("f") - F.col("i")).alias("r"))


def degrees_count(adj: DataFrame) -> int:
    return adj.select("u").distinct().count()
