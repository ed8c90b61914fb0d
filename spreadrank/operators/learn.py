"""Component weights learned against a spreading ground truth."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .evaluate import kendall_tau
from .influence import EQUAL, PARTS

RIDGE = 1e-3
DIGITS = 9


def softmax(x) -> np.ndarray:
    e = np.exp(np.asarray(x, float) - np.max(x))
    return e / e.sum()


def grid(step: int = 10) -> list[tuple[float, ...]]:
    """All weights in multiples of 1/step, each positive, of sum 1, and equal weights."""
    out = [(a / step, b / step, c / step, (step - a - b - c) / step) for a in range(1, step) for b in range(1, step - a) for c in range(1, step - a - b)]
    return out if EQUAL in out else [*out, EQUAL]


def candidates(spark: SparkSession, step: int = 10) -> DataFrame:
    rows = [(i, *map(float, x)) for i, x in enumerate(grid(step))]
    return spark.createDataFrame(rows, "candidate long, x1 double, x2 double, x3 double, x4 double")


def losses(parts: DataFrame, truth: DataFrame, weights: DataFrame) -> DataFrame:
    """(candidate, x1..x4, tau, loss): loss = -tau + RIDGE * sum of squares, tau on the sample."""
    cols = [f"{c}_norm" for c in PARTS]
    rows = parts.join(F.broadcast(truth), "node_id").select("node_id", "sir", *cols).crossJoin(F.broadcast(weights))
    score = F.round(sum((F.col(f"x{i + 1}") * F.col(c) for i, c in enumerate(cols)), F.lit(0.0)), DIGITS)
    tau = kendall_tau(rows.select("candidate", "node_id", "sir", score.alias("score")), "score", "sir", ["candidate"])
    square = sum((F.col(f"x{i}") * F.col(f"x{i}") for i in range(1, 5)), F.lit(0.0))
    return weights.join(tau, "candidate", "left").withColumn("tau", F.coalesce("tau", F.lit(0.0))).withColumn("loss", -F.col("tau") + F.lit(RIDGE) * square)


def descend(loss, rounds: int = 12, width: float = 1.0, least: float = 0.05) -> np.ndarray:
    """Softmax parameters of a small loss, by descent from equal weights.

    loss: from a list of points to their losses, all in one job. tau is a step
    function, so slopes are central differences over ``width``; a round without
    a gain halves the width, and descent ends under ``least``.
    """
    at = np.zeros(4)
    best = loss([at])[0]
    for _ in range(rounds):
        if width < least:
            break
        probes = [at + s * width * e for e in np.eye(4) for s in (1, -1)]
        got = loss(probes)
        slope = (got[::2] - got[1::2]) / (2 * width)
        size = np.linalg.norm(slope)
        points = probes + ([at - slope / size * width * f for f in (2.0, 1.0, 0.5, 0.25)] if size > 1e-12 else [])
        every = np.concatenate([got, loss(points[len(probes) :])]) if len(points) > len(probes) else got
        if every.min() < best - 1e-12:
            at, best = points[int(every.argmin())], every.min()
        else:
            width /= 2
    return at


def learn_weights(parts: DataFrame, truth: DataFrame, method: str = "grid", step: int = 10) -> DataFrame:
    """One row: x1..x4, total, dominant, tau_learned, tau_fixed, improvement.

    "grid" takes the candidate of least loss (the first of equal ones); equal
    weights are a candidate, so the loss is never above theirs. "gradient" is
    descent() from equal weights.
    """
    weights = candidates(parts.sparkSession, step)
    if method == "gradient":
        spark = parts.sparkSession
        table = lambda rows: spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(rows)], "candidate long, x1 double, x2 double, x3 double, x4 double")

        def loss(points: list) -> np.ndarray:  # a dozen rows at most
            rows = losses(parts, truth, table([softmax(p) for p in points])).select("candidate", "loss").collect()
            return np.array([r["loss"] for r in sorted(rows)])

        found = tuple(np.round(softmax(descend(loss)), DIGITS).tolist())
        weights = table([EQUAL, found] if found != EQUAL else [EQUAL])
    scored = losses(parts, truth, weights)
    fixed = scored.where("x1 = 0.25 and x2 = 0.25 and x3 = 0.25").select(F.col("tau").alias("tau_fixed"))
    best = scored.orderBy(F.round("loss", DIGITS), "candidate").limit(1)
    dominant = F.expr("case when x1 >= greatest(x2, x3, x4) then 'cli' when x2 >= greatest(x3, x4) then 'csli' when x3 >= x4 then 'caspi' else 'csi' end")
    gain = F.when(F.abs("tau_fixed") > 1e-8, (F.col("tau") - F.col("tau_fixed")) / F.abs("tau_fixed") * 100).otherwise(0.0)
    return best.crossJoin(F.broadcast(fixed)).select(
        *[F.round(f"x{i}", 6).alias(f"x{i}") for i in range(1, 5)], F.round(F.expr("x1 + x2 + x3 + x4"), 6).alias("total"), dominant.alias("dominant"),
        F.round("tau", 6).alias("tau_learned"), F.round("tau_fixed", 6).alias("tau_fixed"), F.round(gain, 6).alias("improvement"),
    )


def mean_improvement(rows: DataFrame) -> DataFrame:
    return rows.agg(F.round(F.avg("improvement"), 6).alias("improvement"))
