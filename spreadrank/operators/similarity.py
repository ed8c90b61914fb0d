"""Cosine top-k similarity and the blended, sparsified graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import cut
from .graph import degrees

#: Vectors of one broadcast block; more vectors go in several blocks.
BLOCK_ROWS = 200_000
#: Vectors that one task compares with a block.
ROWS_A_TASK = 20_000
DIGITS = 9


def _best(sims: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """Per row the k largest positive entries without the row itself; ties by smaller id (ids ascend)."""
    s = np.round(np.clip(sims, 0.0, 1.0), DIGITS)
    s[np.arange(len(own)), own] = np.where(own >= 0, 0.0, s[np.arange(len(own)), own])
    if s.shape[1] > k:
        kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
        over, level = s > kth, s == kth
        room = k - over.sum(axis=1, keepdims=True)
        keep = over | (level & (np.cumsum(level, axis=1) <= room))
    else:
        keep = np.ones(s.shape, bool)
    row, col = np.nonzero(keep & (s > 0))
    return row, ids[col], s[row, col]


def _classes(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(node_id, x, first), first the smallest id of an equal vector, and (first, ids) with the k + 1 smallest ids of each."""
    same = Window.partitionBy("x").orderBy("node_id")
    rows = cut(rows.withColumn("first", F.first("node_id").over(same)).withColumn("r", F.row_number().over(same)))
    members = rows.where(F.col("r") <= k + 1).groupBy("first").agg(F.collect_list("node_id").alias("ids"))
    return rows.drop("r"), members


def cosine_topk(vectors: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(i, j, w): each vector's k most similar others by cosine in [0, 1], divided by the largest similarity of all.

    vectors: (node_id, x array<double>). Similarities are rounded to 9 places so
    that ties are ties; the smaller id wins. Zero vectors have no row. The
    distinct vectors are broadcast in blocks of block_rows rows, each block is met
    by all of them, and the best of all blocks are ranked again.

    Equal vectors are compared once, under their smallest id. The k + 1 best of
    these, itself included, hold the k + 1 best rows, as each better vector has
    a better row; leaving out the row itself leaves k.
    """
    rows = vectors.select(F.col("node_id").cast("long").alias("node_id"), F.col("x").cast("array<double>").alias("x"))
    rows, members = _classes(rows, k)
    vectors = rows.where("node_id = first").select("node_id", "x")
    n = vectors.count()
    pieces = max(1, -(-n // block_rows))
    parts = None
    for p in range(pieces):
        block = vectors if pieces == 1 else vectors.where(F.pmod(F.xxhash64("node_id"), F.lit(pieces)) == p)
        got = block.orderBy("node_id").toArrow()
        ids = got["node_id"].to_numpy()
        x = np.array(got["x"].to_pylist(), float).reshape(len(ids), -1)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)))

        def run(batches, shared=shared):
            ids, x = shared.value
            for pdf in batches:
                for at in range(0, len(pdf), 256):
                    some = pdf.iloc[at : at + 256]
                    mine = np.array(some["x"].tolist(), float).reshape(len(some), -1)
                    size = np.linalg.norm(mine, axis=1, keepdims=True)
                    mine = np.divide(mine, size, out=np.zeros_like(mine), where=size > 0)
                    own_id = some["node_id"].to_numpy()
                    if not len(ids):
                        continue
                    row, j, w = _best(mine @ x.T, ids, np.full(len(some), -1), k + 1)
                    yield pd.DataFrame({"i": own_id[row], "j": j, "w": w})

        one = vectors.repartition(max(vectors.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_A_TASK))).mapInPandas(run, "i long, j long, w double")
        parts = one if parts is None else parts.union(one)
    if pieces > 1:
        rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("w"), "j"))
        parts = parts.withColumn("r", rank).where(F.col("r") <= k + 1).drop("r")
    each = parts.join(members.withColumnRenamed("first", "j"), "j").select(F.col("i").alias("first"), "w", F.explode("ids").alias("j"))
    rank = F.row_number().over(Window.partitionBy("first").orderBy(F.desc("w"), "j"))
    best = each.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("first").agg(F.array_sort(F.collect_list(F.struct("r", "j", "w"))).alias("best"))
    own = rows.select("first", F.col("node_id").alias("i")).join(best, "first")
    own = own.select("i", F.explode(F.slice(F.filter("best", lambda b: b["j"] != F.col("i")), 1, k)).alias("b"))
    out = cut(own.select("i", "b.j", "b.w"))
    top = out.agg(F.max("w").alias("top"))
    return out.crossJoin(F.broadcast(top)).select("i", "j", F.when(F.col("top") > 1e-12, F.col("w") / F.col("top")).otherwise(F.col("w")).alias("w"))


def blend(a: Column, w: Column, alpha: float) -> Column:
    """Closed form of the average of refined, auxiliary and enhanced weights of an entry."""
    return (1 + a - w + F.lit(alpha) * w * w + F.lit(1 - alpha) * a * w) / 3


def augmented_graph(adj: DataFrame, similar: DataFrame, alpha: float = 0.6, top_k: int = 10) -> DataFrame:
    """(i, j, w), directed: the top_k weights of each row over diagonal, adjacency and similar pairs."""
    k = degrees(adj)
    mean = k.agg(F.avg("k").alias("kbar")).select(F.when(F.col("kbar") > 1e-12, F.col("kbar")).otherwise(1.0).alias("kbar"))
    base = adj.select(F.col("u").alias("i"), F.col("v").alias("j")).union(k.select("node_id", "node_id")).crossJoin(F.broadcast(mean)).select("i", "j", (1.0 / F.col("kbar")).alias("a"))
    both = base.join(similar, ["i", "j"], "full_outer")
    w = F.round(blend(F.coalesce("a", F.lit(0.0)), F.coalesce("w", F.lit(0.0)), alpha), DIGITS)
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("w"), "j"))
    return both.select("i", "j", w.alias("w")).where(F.abs("w") > 1e-12).withColumn("r", rank).where(F.col("r") <= top_k).drop("r")
