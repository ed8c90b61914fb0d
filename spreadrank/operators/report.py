"""Result tables: wide scores, ranked nodes, summaries, and the data behind each plot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scale import padded
from .evaluate import canonical, hash_sample, ranks, tau_against_truth

METHOD_COLUMN = "method"
#: Colour and size rule (base, factor) of each tier of the network view.
TIERS = (
    ("top5", "#FFD700", 10, 40),
    ("top10", "#e74c3c", 8, 32),
    ("top50", "#f39c12", 6, 20),
    ("rest", "#85c1e9", 4, 12),
)


def wide_scores(scores: DataFrame, methods: list[str]) -> DataFrame:
    """node_id and one column for each method."""
    return scores.groupBy("node_id").pivot("method", methods).agg(F.first("score"))


def all_scores(scores: DataFrame, methods: list[str], sample: DataFrame) -> DataFrame:
    """wide_scores and sir_influence, null where a node was not sampled."""
    return wide_scores(scores, methods).join(sample.select("node_id", F.col("sir").alias("sir_influence")), "node_id", "left")


def ranked_nodes(scores: DataFrame, methods: list[str], top: int = 20) -> DataFrame:
    """rank and the node of each method at that rank."""
    return ranks(scores).where(F.col("rn") <= top).groupBy(F.col("rn").alias("rank")).pivot("method", methods).agg(F.first("node_id"))


def with_truth(scores: DataFrame, nodes: DataFrame, sample: DataFrame) -> DataFrame:
    """The scores and a method "SIR" that is 0 for nodes not sampled, for side-by-side ranks."""
    sir = nodes.join(sample, "node_id", "left").select(F.lit("SIR").alias("method"), "node_id", F.coalesce("sir", F.lit(0.0)).alias("score"))
    return scores.select("method", "node_id", "score").union(sir)


def weights_summary(rows: DataFrame) -> DataFrame:
    """dataset, x1..x4, total, dominant, from learned weights with a dataset column."""
    return rows.select("dataset", "x1", "x2", "x3", "x4", "total", "dominant")


def curve_heatmap(curve: DataFrame) -> DataFrame:
    """(label, t, value): each curve over its own largest value; a zero curve stays zero."""
    top = F.max("f").over(Window.partitionBy("label"))
    return curve.select("label", "t", (F.col("f") / F.when(top > 0, top).otherwise(1.0)).alias("value"))


def rate_matrix(taus: DataFrame, rates: list[float]) -> DataFrame:
    """method and one column of tau for each rate, named r_0_01 and so on."""
    named = taus.withColumn("r", F.concat(F.lit("r_"), F.regexp_replace(F.format_number("rate", 2), "[.]", "_")))
    return named.groupBy("method").pivot("r", [f"r_{x:.2f}".replace(".", "_") for x in rates]).agg(F.first("tau"))


def weight_matrix(rows: DataFrame) -> DataFrame:
    """(dataset, component, weight)."""
    return rows.select("dataset", F.expr("stack(4, 'cli', x1, 'csli', x2, 'caspi', x3, 'csi', x4) as (component, weight)"))


def box_stats(scores: DataFrame) -> DataFrame:
    """(method, low, q1, median, q3, high) of the scores scaled per method."""
    w = Window.partitionBy("method")
    x = scores.select("method", padded(F.col("score"), F.min("score").over(w), F.max("score").over(w)).alias("x"))
    q = F.percentile("x", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return x.groupBy("method").agg(q.alias("q")).select("method", *[F.col("q")[i].alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))])


def histogram(values: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, n, density) over equal widths from the least to the largest value; empty bins are kept."""
    ends = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("total"))
    ends = ends.select(F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5).alias("lo"), F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("hi") + 0.5).alias("hi"), "total")
    width = (F.col("hi") - F.col("lo")) / bins
    at = values.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).select(F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1)).cast("long").alias("bin"))
    n = at.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    grid = ends.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return grid.join(n, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), F.coalesce("n", F.lit(0)).alias("n"), F.try_divide(F.coalesce("n", F.lit(0)), F.col("total") * width).alias("density"))


def scatter_fit(scored: DataFrame) -> DataFrame:
    """(method, pearson, slope, intercept, tau) of sir on score."""
    fit = scored.groupBy("method").agg(F.corr("score", "sir").alias("pearson"), F.regr_slope("sir", "score").alias("slope"), F.regr_intercept("sir", "score").alias("intercept"))
    return fit.join(tau_against_truth(scored), "method")


def quintiles(scores: DataFrame) -> DataFrame:
    """(node_id, quintile) by the percentile edges of score; equal edges count once."""
    edges = scores.agg(F.array_distinct(F.percentile("score", F.array(*[F.lit(p) for p in (0.2, 0.4, 0.6, 0.8)]))).alias("edges"))
    return scores.crossJoin(F.broadcast(edges)).select("node_id", (F.size(F.filter("edges", lambda e: e < F.col("score"))) + 1).cast("long").alias("quintile"))


def pair_table(scores: DataFrame, methods: list[str], hue: str, m: int = 500) -> DataFrame:
    """wide_scores of m sampled nodes, and their quintile by the method ``hue`` within the sample."""
    nodes = hash_sample(scores.select("node_id").distinct(), m)
    shown = scores.join(F.broadcast(nodes), "node_id")
    return wide_scores(shown, methods).join(quintiles(shown.where(F.col("method") == hue)), "node_id", "left")


def radar(table: DataFrame) -> DataFrame:
    """Scaled tau, p_at_k, auc and f_final of each method; table: method, tau, p_at_k, auc, f_final."""
    w = Window.partitionBy(F.lit(1))  # one row a method
    over = lambda c, top: F.col(c) / F.when(top > 0, top).otherwise(1.0)
    return table.select(
        "method", over_tau(w).alias("tau"), over("p_at_k", F.max("p_at_k").over(w)).alias("p_at_k"),
        (F.coalesce("auc", F.lit(0.5)) / F.greatest(F.max("auc").over(w), F.lit(1.0))).alias("auc"), over("f_final", F.max("f_final").over(w)).alias("f_final"),
    )


def over_tau(w):
    top = F.max(F.abs("tau")).over(w)
    return F.greatest(F.col("tau"), F.lit(0.0)) / F.when(top > 0, top).otherwise(1.0)


def network_nodes(nodes: DataFrame, scores: DataFrame, ranked: DataFrame, community: DataFrame | None = None) -> DataFrame:
    """node_id, tier, colour, size, label, title (and community) of the displayed nodes.

    scores: (node_id, score) of one method; ranked: (node_id, rn) in the whole graph.
    """
    w = Window.partitionBy(F.lit(1))  # at most a few hundred displayed nodes
    shown = nodes.select("node_id").join(scores, "node_id").join(ranked.select("node_id", "rn"), "node_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    shown = shown.withColumn("x", F.when(hi - lo > 1e-12, (F.col("score") - lo) / (hi - lo)).otherwise(0.0))
    tier = F.when(F.col("rn") <= 5, 0).when(F.col("rn") <= 10, 1).when(F.col("rn") <= 50, 2).otherwise(3)
    pick = lambda i: F.element_at(F.array(*[F.lit(t[i]) for t in TIERS]), tier + 1)
    out = shown.select(
        "node_id", pick(0).alias("tier"), pick(1).alias("colour"), F.round(pick(2) + F.col("x") * pick(3), 6).alias("size"),
        F.when(F.col("rn") <= 5, F.concat(F.lit("★ "), F.col("node_id").cast("string"))).otherwise(F.col("node_id").cast("string")).alias("label"),
        F.concat_ws(" | ", F.concat(F.lit("node "), F.col("node_id").cast("string")), F.concat(F.lit("rank "), F.col("rn").cast("string"))).alias("title"),
    )
    return out if community is None else out.join(community, "node_id", "left")


def top_bars(scores: DataFrame, top: int = 10) -> DataFrame:
    """(method, ord, rn, node_id, score) of each method's first nodes."""
    return canonical(ranks(scores).where(F.col("rn") <= top)).select("method", "ord", "rn", "node_id", "score")


def violin_quantiles(scores: DataFrame, steps: int = 20) -> DataFrame:
    """(method, q, value): quantiles of the scaled scores, from which a violin can be drawn."""
    w = Window.partitionBy("method")
    x = scores.select("method", padded(F.col("score"), F.min("score").over(w), F.max("score").over(w)).alias("x"))
    q = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    return x.groupBy("method").agg(F.percentile("x", q).alias("v")).select("method", F.posexplode("v").alias("i", "value")).select("method", (F.col("i") / steps).alias("q"), "value")
