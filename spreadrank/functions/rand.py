"""Portable coins: the same BIGINT arithmetic in Spark SQL, NumPy and DuckDB.

A coin depends on its keys alone, so results do not depend on partitioning or
on the order of evaluation. The squaring steps decorrelate runs.
"""

from __future__ import annotations

import numpy as np

P = 2147483647
MULTIPLIERS = {"u": 1103515245, "v": 12345, "run": 2654435761, "salt": 40503001}


def threshold(rate: float) -> int:
    return int(np.floor(rate * P))


def coin_sql(u: str, v: str, run: str = "0", salt: str = "0") -> str:
    """SQL (Spark and DuckDB) of the coin in [0, P)."""
    key = dict(zip(MULTIPLIERS, (u, v, run, salt), strict=True))
    h = "(" + " + ".join(f"(CAST({x} AS BIGINT) % {P}) * CAST({MULTIPLIERS[k]} AS BIGINT) % {P}" for k, x in key.items()) + f") % {P}"
    for a, b in ((48271, 11), (16807, 13)):
        h = _square(h, a, b)
    return h


def _square(h: str, a: int, b: int) -> str:
    # h * (h + a) + b, reduced; h + a stays below 2**32
    return f"(({h}) * ((({h}) + {a}) % {P}) + {b}) % {P}"


def coin(u, v, run=0, salt=0) -> np.ndarray:
    """The same coin for NumPy arrays."""
    h = sum((np.asarray(x, np.int64) % P) * m % P for x, m in zip((u, v, run, salt), MULTIPLIERS.values(), strict=True)) % P
    for a, b in ((48271, 11), (16807, 13)):
        h = (h * ((h + a) % P) + b) % P
    return h


def order_sql(node: str, salt: int = 1) -> str:
    """Sort key of a portable sample order."""
    return coin_sql(node, "7", "3", str(salt))
