"""Rank statistics, significance and classification metrics over long score tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import order_sql
from .spread import infections, runs_of

ORDER = ("DC", "BC", "CC", "CI", "PR", "KS", "influence_fixed", "influence_adaptive")


def canonical(scores: DataFrame) -> DataFrame:
    """Adds ord: canonical methods first, any others after them by name."""
    at = F.create_map(*[F.lit(x) for i, m in enumerate(ORDER) for x in (m, i)])
    return scores.withColumn("ord", F.coalesce(at[F.col("method")], F.lit(len(ORDER))))


def ranks(scores: DataFrame) -> DataFrame:
    """Adds rn within each method: descending score, ties by node id."""
    return scores.withColumn("rn", F.row_number().over(Window.partitionBy("method").orderBy(F.desc("score"), "node_id")).cast("long"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    return ranks(scores).where(F.col("rn") <= k)


def hash_sample(nodes: DataFrame, m: int, salt: int = 1) -> DataFrame:
    """m nodes without replacement, the same in any engine."""
    return nodes.select("node_id").orderBy(F.expr(order_sql("node_id", salt)), "node_id").limit(m)


def on_sample(scores: DataFrame, sample: DataFrame) -> DataFrame:
    """(method, node_id, score, sir) of the sampled nodes."""
    return scores.join(F.broadcast(sample), "node_id").select("method", "node_id", "score", "sir")


def tau_terms(x: str, y: str, a: str = "a", b: str = "b") -> tuple[Column, Column, Column]:
    s, t = F.signum(F.col(f"{a}.{x}") - F.col(f"{b}.{x}")), F.signum(F.col(f"{a}.{y}") - F.col(f"{b}.{y}"))
    return F.sum(s * t), F.sum(s * s), F.sum(t * t)


def kendall_tau(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Columns ``by`` and tau: Kendall's tau-b of x and y over the rows of each group; 0 where undefined.

    Pairs are made within groups by a join; for samples of a bounded size.
    """
    a, b = rows.alias("a"), rows.alias("b")
    on = F.expr("a.node_id < b.node_id")
    for c in by:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    p, q, r = tau_terms(x, y)
    got = a.join(b, on).groupBy(*[F.col(f"a.{c}").alias(c) for c in by]).agg(p.alias("p"), q.alias("q"), r.alias("r"))
    return got.select(*by, F.coalesce(F.try_divide(F.col("p"), F.sqrt(F.col("q") * F.col("r"))), F.lit(0.0)).alias("tau"))


def tau_against_truth(scored: DataFrame) -> DataFrame:
    return kendall_tau(scored, "score", "sir", ["method"])


def tau_b(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau-b in O(n log n): inversions of y in the order of x, counted bit by bit of its ranks."""
    n, order = len(x), np.lexsort((y, x))
    x, (levels, rank) = x[order], np.unique(y[order], return_inverse=True)
    tied = lambda *cols: sum(c * (c - 1) // 2 for c in np.unique(np.column_stack(cols), axis=0, return_counts=True)[1].tolist())
    pairs, tx, ty, both = n * (n - 1) // 2, tied(x), tied(rank), tied(x, rank)
    swaps, group = 0, np.zeros(n, np.int64)
    for shift in range(max(len(levels) - 1, 0).bit_length() - 1, -1, -1):
        one = (rank >> shift) & 1
        before = np.cumsum(one) - one
        start = np.searchsorted(group, group)  # groups stand in order
        swaps += int((before - before[start])[one == 0].sum())
        order = np.argsort(2 * group + one, kind="stable")
        rank, group = rank[order], (2 * group + one)[order]
    spread = math.sqrt(float(pairs - tx) * float(pairs - ty))
    return (pairs - tx - ty + both - 2 * swaps) / spread if spread else 0.0


def tau_matrix(scores: DataFrame, whole: int = 20_000_000) -> DataFrame:
    """(method_a, method_b, tau) of all pairs of methods over all common nodes.

    Up to ``whole`` nodes, counted before, each pair of methods is one task of two columns; beyond that, pairs of nodes are joined.
    """
    s = scores.select("method", "node_id", "score")
    pairs = s.toDF("method_a", "node_id", "x").join(s.toDF("method_b", "node_id", "y"), "node_id").where("method_a < method_b")
    by = ["method_a", "method_b"]
    most = s.groupBy("method").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > whole:
        return kendall_tau(pairs, "x", "y", by)

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"method_a": [key[0]], "method_b": [key[1]], "tau": [tau_b(pdf["x"].to_numpy(), pdf["y"].to_numpy())]})

    return pairs.select(*by, "x", "y").groupBy(*by).applyInPandas(one, "method_a string, method_b string, tau double")


def precision_at_k(scored: DataFrame, k: int = 10) -> DataFrame:
    """(method, p_at_k): the share of the top k by score that is also in the top k by sir."""
    w = Window.partitionBy("method")
    r = scored.withColumns({
        "by_score": F.row_number().over(w.orderBy(F.desc("score"), "node_id")), "by_truth": F.row_number().over(w.orderBy(F.desc("sir"), "node_id")),
        "kk": F.least(F.lit(k), F.count(F.lit(1)).over(w)),
    })
    return r.groupBy("method").agg((F.sum(((F.col("by_score") <= F.col("kk")) & (F.col("by_truth") <= F.col("kk"))).cast("long")) / F.first("kk")).alias("p_at_k"))


def wilcoxon(scores: DataFrame) -> DataFrame:
    """Signed-rank test of every pair of methods, normal approximation with tie correction, two-sided.

    (method_a, method_b, n, w, z, p_value, significant); n counts the non-zero differences. All
    differences zero: p 1 and z null.
    """
    s = scores.select("method", "node_id", "score")
    d = s.toDF("method_a", "node_id", "x").join(s.toDF("method_b", "node_id", "y"), "node_id").where("method_a < method_b").withColumn("d", F.round(F.col("x") - F.col("y"), 12))
    pair = ["method_a", "method_b"]
    r = d.where("d <> 0").withColumn("a", F.abs("d"))
    tie = Window.partitionBy(*pair, "a")
    r = r.withColumn("same", F.count(F.lit(1)).over(tie)).withColumn("rank", F.rank().over(Window.partitionBy(*pair).orderBy("a")) + (F.col("same") - 1) / 2)
    got = r.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("plus"),
        F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("minus"), F.sum(F.col("same").cast("double") * F.col("same") - 1).alias("ties"),
    )
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    got = got.withColumn("w", F.least("plus", "minus")).withColumn("z", F.try_divide(F.col("w") - n * (n + 1) / 4, spread))
    every = d.select(*pair).distinct().join(got, pair, "left").select(*pair, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w", F.lit(0.0)).alias("w"), "z")

    @F.pandas_udf("double")
    def two_sided(z: pd.Series) -> pd.Series:
        return z.map(lambda x: 1.0 if x is None or math.isnan(x) else math.erfc(abs(x) / math.sqrt(2)))

    p = F.round(two_sided("z"), 6)
    return every.withColumn("p_value", p).withColumn("significant", F.when(F.col("p_value") < 0.05, "Yes").otherwise("No"))


def tau_vs_rate(adj: DataFrame, scores: DataFrame, sample: DataFrame, rates: list[float], steps: int = 20, runs: int = 10) -> DataFrame:
    """(method, rate, tau): ground truth for each rate on one fixed sample, all rates in one job."""
    each = sample.select("node_id", F.explode(F.array(*[F.lit(float(r)) for r in rates])).alias("rate"))
    seeds = each.select(F.concat_ws("@", "node_id", "rate").alias("label"), "node_id")
    rate = F.split("label", "@")[1].cast("double")
    times = infections(adj, runs_of(seeds, runs, salt="node_id").withColumn("rate", rate), steps)
    size = times.groupBy("label", "run").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg((F.sum("n") / F.lit(runs)).alias("sir"))
    truth = size.select(F.split("label", "@")[0].cast("long").alias("node_id"), rate.alias("rate"), "sir")
    rows = scores.join(F.broadcast(truth), "node_id").select("method", "rate", "node_id", "score", "sir")
    return kendall_tau(rows, "score", "sir", ["method", "rate"])


def comparison_report(scored: DataFrame, scores: DataFrame, final: DataFrame, k: int = 10, shown: int = 5) -> DataFrame:
    """method, tau, p_at_k, f_final and the first ``shown`` nodes, best tau first. final: (method, f_final)."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "node_id"))), lambda x: x["node_id"].cast("string")), ",")
    top = top_k(scores, shown).groupBy("method").agg(names.alias(f"top{shown}"))
    out = tau_against_truth(scored).join(precision_at_k(scored, k), "method").join(final, "method").join(top, "method")
    return out.orderBy(F.desc("tau"), "method")


# -- classification: positives are the top k by sir on the sample -----------------------------


def labelled(scored: DataFrame, k: int = 10) -> DataFrame:
    """Adds truth and predicted (0 or 1): among the top k by sir, by score."""
    w = Window.partitionBy("method")
    return scored.withColumn("truth", (F.row_number().over(w.orderBy(F.desc("sir"), "node_id")) <= k).cast("int")).withColumn(
        "predicted", (F.row_number().over(w.orderBy(F.desc("score"), "node_id")) <= k).cast("int")
    )


def roc_auc(rows: DataFrame) -> DataFrame:
    """(method, auc) by average ranks; null with one class only."""
    r = F.rank().over(Window.partitionBy("method").orderBy("score")) + (F.count(F.lit(1)).over(Window.partitionBy("method", "score")) - 1) / 2
    got = rows.withColumn("r", r).groupBy("method").agg(F.sum(F.col("truth") * F.col("r")).alias("s"), F.sum("truth").cast("double").alias("p"), F.sum(1 - F.col("truth")).cast("double").alias("q"))
    return got.select("method", F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"))


def threshold_curve(rows: DataFrame) -> DataFrame:
    """(method, score, tp, fp, tpr, fpr, precision, recall) at each distinct score, highest first."""
    at = rows.groupBy("method", "score").agg(F.sum("truth").alias("t"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("method").orderBy(F.desc("score"))
    c = at.withColumn("tp", F.sum("t").over(w)).withColumn("m", F.sum("n").over(w)).withColumn("fp", F.col("m") - F.col("tp"))
    all_ = Window.partitionBy("method")
    p, q = F.sum("t").over(all_), F.sum(F.col("n") - F.col("t")).over(all_)
    return c.select("method", "score", "tp", "fp", F.try_divide("tp", p).alias("tpr"), F.try_divide("fp", q).alias("fpr"), (F.col("tp") / F.col("m")).alias("precision"), F.try_divide("tp", p).alias("recall"))


def average_precision(rows: DataFrame) -> DataFrame:
    """(method, ap): the sum of precision times the gain in recall over the thresholds."""
    c = threshold_curve(rows)
    gain = F.col("recall") - F.coalesce(F.lag("recall").over(Window.partitionBy("method").orderBy(F.desc("score"))), F.lit(0.0))
    return c.withColumn("g", gain * F.col("precision")).groupBy("method").agg(F.sum("g").alias("ap"))


def confusion(rows: DataFrame) -> DataFrame:
    """(method, tp, fp, fn, tn), zeros kept."""
    cell = lambda t, p: F.sum(((F.col("truth") == t) & (F.col("predicted") == p)).cast("long"))
    return rows.groupBy("method").agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))


def classification(rows: DataFrame) -> DataFrame:
    """(method, accuracy, precision, recall, f1); 0 where a divisor is 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return confusion(rows).select("method", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def all_metrics(scored: DataFrame, k: int = 10) -> DataFrame:
    rows = labelled(scored, k)
    return roc_auc(rows).join(average_precision(rows), "method").join(classification(rows), "method").join(precision_at_k(scored, k), "method")
