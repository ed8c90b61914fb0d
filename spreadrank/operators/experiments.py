"""Removal, ablation, comparison, cascade and repetition experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import order_sql
from ..functions.session import cut
from .evaluate import kendall_tau, precision_at_k, ranks, tau_against_truth, top_k
from .graph import adjacency, degrees, without
from .influence import PARTS
from .spread import RATE, STEPS, curve_metrics, curves, infections, run_curves, runs_of, spread_curve

#: The weights of the four ablation settings.
ABLATION = (
    ("CLI only", (1.0, 0.0, 0.0, 0.0)),
    ("CLI+CSLI", (0.5, 0.5, 0.0, 0.0)),
    ("CLI+CSLI+CASPI", (1 / 3, 1 / 3, 1 / 3, 0.0)),
    ("Full", (0.25, 0.25, 0.25, 0.25)),
)


def outside_seeds(nodes: DataFrame, top: DataFrame, m: int = 5) -> DataFrame:
    """Up to m nodes outside the top ones, in portable sample order."""
    return nodes.join(top.select("node_id"), "node_id", "left_anti").orderBy(F.expr(order_sql("node_id", 2)), "node_id").limit(m).select("node_id")


def node_removal(edges: DataFrame, scores: DataFrame, k: int = 10, rate: float = RATE, steps: int = STEPS, runs: int = 15) -> DataFrame:
    """(label, t, f): curves from the same outside seeds before and after the top k nodes of one method go."""
    adj = cut(adjacency(edges))
    top = cut(top_k(scores, k).select("node_id"))
    seeds = cut(outside_seeds(degrees(adj).select("node_id"), top))
    rest = cut(adjacency(without(edges, top)))
    before = spread_curve(adj, seeds.select(F.lit("before").alias("label"), "node_id"), rate, steps, runs)
    return before.union(spread_curve(rest, seeds.select(F.lit("after").alias("label"), "node_id"), rate, steps, runs))


def removal_summary(curve: DataFrame, n_before: int, n_after: int) -> DataFrame:
    """One row: f_before, f_after, reduction, ratio_before, ratio_after."""
    last = curve.groupBy("label").agg(F.max_by("f", "t").alias("f"))
    one = last.agg(F.max(F.when(F.col("label") == "before", F.col("f"))).alias("b"), F.max(F.when(F.col("label") == "after", F.col("f"))).alias("a"))
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return one.select(
        b.alias("f_before"), a.alias("f_after"), F.when(b > 1e-12, (b - a) / b).otherwise(0.0).alias("reduction"),
        (b / max(n_before, 1)).alias("ratio_before"), (a / max(n_after, 1)).alias("ratio_after"),
    )


def ablation_scores(parts: DataFrame) -> DataFrame:
    """(method, node_id, score) of the four settings, rounded so that ties are ties."""
    rows = parts.sparkSession.createDataFrame([(n, *x) for n, x in ABLATION], "method string, x1 double, x2 double, x3 double, x4 double")
    score = F.round(sum((F.col(f"x{i + 1}") * F.col(f"{c}_norm") for i, c in enumerate(PARTS)), F.lit(0.0)), 9)
    return parts.crossJoin(F.broadcast(rows)).select("method", "node_id", score.alias("score"))


def ablation(parts: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """(method, tau, p_at_k) of each setting on the sample."""
    rows = ablation_scores(parts).join(F.broadcast(truth), "node_id").select("method", "node_id", "score", "sir")
    return kendall_tau(rows, "score", "sir", ["method"]).join(precision_at_k(rows, k), "method")


def ablation_curves(adj: DataFrame, parts: DataFrame, k: int = 10, rate: float = RATE, steps: int = STEPS, runs: int = 15) -> DataFrame:
    """(label, t, f): the curve of each setting's top k."""
    return spread_curve(adj, top_k(ablation_scores(parts), k).select(F.col("method").alias("label"), "node_id"), rate, steps, runs)


def component_gain(table: DataFrame) -> DataFrame:
    """(method, tau, gain): tau minus that of the setting before; the first is the baseline itself."""
    at = F.create_map(*[F.lit(x) for i, (n, _) in enumerate(ABLATION) for x in (n, i)])
    before = F.lag("tau").over(Window.partitionBy(F.lit(1)).orderBy("ord"))
    return table.withColumn("ord", at[F.col("method")]).select("method", "tau", (F.col("tau") - F.coalesce(before, F.lit(0.0))).alias("gain"))


def metric_table(adj: DataFrame, scores: DataFrame, scored: DataFrame, k: int = 10, rate: float = RATE, steps: int = STEPS, runs: int = 15) -> DataFrame:
    """method, tau, p_at_k, f_final, ratio, t_sat, t_peak, best tau first."""
    seeds = top_k(scores, k).select(F.col("method").alias("label"), "node_id")
    m = curve_metrics(spread_curve(adj, seeds, rate, steps, runs), degrees(adj).count()).withColumnRenamed("label", "method")
    out = tau_against_truth(scored).join(precision_at_k(scored, k), "method").join(m, "method")
    return out.select("method", F.round("tau", 4).alias("tau"), F.round("p_at_k", 4).alias("p_at_k"), F.round("f_final", 2).alias("f_final"), F.round("ratio", 4).alias("ratio"), "t_sat", "t_peak").orderBy(F.desc("tau"), "method")


def cascading_removal(edges: DataFrame, scores: DataFrame, k_max: int = 10, rate: float = RATE, steps: int = STEPS, runs: int = 8) -> DataFrame:
    """(method, k, reduction): the top 3 of a method are seeds while its top k are removed.

    When all seeds are gone the smallest node id left is the seed; 1 if no node is left.
    All k run in one job on one graph, each (method, k) under a label with removed nodes of its own.
    """
    adj = cut(adjacency(edges))
    spark = adj.sparkSession
    top: dict[str, list[int]] = {}
    for r in ranks(scores).where(F.col("rn") <= max(k_max, 3)).select("method", "node_id", "rn").orderBy("method", "rn").collect():  # a few of each method
        top.setdefault(r["method"], []).append(r["node_id"])
    cases = [(f"{i}:{k}", m, k) for i, m in enumerate(top) for k in range(k_max + 1)]
    lost = [(label, x) for label, m, k in cases for x in top[m][:k]]
    seeds = [(label, x) for label, m, k in cases if k < 3 for x in top[m][k:3]]
    late = [(label, top[m][:k]) for label, m, k in cases if k >= 3]
    if late:
        first = adj.agg(*[F.min(F.when(~F.col("u").isin(gone) & ~F.col("v").isin(gone), F.col("u"))) for _, gone in late]).first()
        seeds += [(label, x) for (label, _), x in zip(late, first) if x is not None]
    pairs = "label string, node_id long"
    started = runs_of(spark.createDataFrame(seeds, pairs), runs, rate=rate)
    final = curves(infections(adj, started, steps, gone=spark.createDataFrame(lost, pairs)), steps).groupBy("label").agg(F.max_by("f", "t").alias("f"))
    got = cut(final.join(F.broadcast(spark.createDataFrame(cases, "label string, method string, k long")), "label"))
    base = got.where("k = 0").select("method", F.col("f").alias("f_base"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k_max).cast("long"))).alias("k"))
    joined = base.join(got.select("method", "k", "f"), ["method", "k"], "left")
    return joined.select("method", "k", F.when(F.col("f").isNull(), 1.0).otherwise((F.col("f_base") - F.col("f")) / (F.col("f_base") + 1e-12)).alias("reduction"))


def repeated_spread(adj: DataFrame, scores: DataFrame, k: int = 10, repeats: int = 8, runs: int = 5, rate: float = RATE, steps: int = STEPS) -> DataFrame:
    """(method, mean, std): the final size over repeats of a few runs each, from the nodes truly ranked top k."""
    seeds = top_k(scores, k).select(F.col("method").alias("label"), "node_id")
    final = run_curves(infections(adj, runs_of(seeds, repeats * runs, rate=rate), steps), steps).where(F.col("t") == steps)
    by = final.groupBy("label", F.expr(f"run div {runs}").alias("repeat")).agg(F.avg("f").alias("f"))
    return by.groupBy(F.col("label").alias("method")).agg(F.avg("f").alias("mean"), F.stddev_pop("f").alias("std"))
