"""Mixing sources to target weights by a Pfair schedule.

Each source is a line of bytes: its documents in doc_id order, cut into blocks
of ``BLOCK_BYTES``. With integer shares s of a total W, block j of a source has
the release floor(j W / s) and the deadline ceil((j + 1) W / s), in slots of one
block. In each slot the released block of the earliest deadline runs. The total
use is 1, so all deadlines are met and no source is ever a whole block away
from its target share. The schedule repeats after W slots; only one period is
worked out. When a source runs out, a new phase begins in which the others
share its part. The tables of the phases depend on sources and shares alone,
which are bounded; a document finds its slot by arithmetic on its own block.

A document stays whole, in the slot of the block that holds its middle byte, and
the blocks that it covers besides stay its source's: after a long document the
source rests until its share has caught up. So at every slot a source is within
a block and half of its longest document of its target; where no document is
longer than a block is wide, that is the block of the schedule and a part of one.

All documents are placed; none is repeated or left out. Nulls: a null source is
a source of its own; a null text has only its row bytes; a null doc_id comes
first. Sources that have no share given get one of 1. Rows that tie in doc_id
and size come in the order of their texts' hashes; equal rows take places one
after the other. Sources are configuration: more than ``MAX_SOURCES`` of them,
or shares of more than ``MAX_SHARES`` in all, raise an error before any row is
placed. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import CARRIED, is_carried, table
from .ranking import with_prefix

BLOCK_BYTES = 1 << 16
ROW_BYTES = 16
#: Production shares; every other source has a share of 1.
SHARES = {"src0": 4, "src1": 3, "src2": 3, "src3": 2}
MAX_SOURCES, MAX_SHARES = 1024, 4096


def period(shares: dict) -> dict:
    """Slots of one period of W slots for each source, in order."""
    total, slots = sum(shares.values()), {k: [] for k in shares}
    waiting = [(0, k) for k in sorted(shares, key=str)]  # (release, source)
    waiting = [(0, i, k) for i, (_, k) in enumerate(waiting)]
    heapq.heapify(waiting)
    ready: list = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[k]) + 1) * total // shares[k]), i, k))
        _, i, k = heapq.heappop(ready)
        slots[k].append(t)
        if len(slots[k]) < shares[k]:
            heapq.heappush(waiting, (len(slots[k]) * total // shares[k], i, k))
    return slots


def phases(blocks: dict, shares: dict) -> dict:
    """For each source, its phases: (first block, first slot, W, slots of a period)."""
    left, done, base = {k: n for k, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0
    out: dict = {k: [] for k in blocks}
    while left:
        own = {k: shares[k] for k in left}
        total, slots = sum(own.values()), period(own)
        ends = {k: (n - 1) // own[k] * total + slots[k][(n - 1) % own[k]] + 1 for k, n in left.items()}
        end = min(ends.values())
        for k in left:
            out[k].append((done[k], base, total, slots[k]))
            ran = end // total * own[k] + sum(s < end % total for s in slots[k])
            done[k] += ran
            left[k] -= ran
        left, base = {k: n for k, n in left.items() if n}, base + end
    return out


def mix_sources(docs: DataFrame, shares: dict | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, source, size, block, phase, slot, release, deadline and place_in_source of each document.

    Order by slot and place_in_source for the mixed order. Of carried() documents, text and the struct come along.
    """
    spark = docs.sparkSession
    along = ["text", CARRIED] if is_carried(docs) else []
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(f"{CARRIED}.source" if along else "source").cast("string").alias("source"),
        (F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.xxhash64("text").alias("text_hash"), *along,
    )
    lined = with_prefix(rows, ["doc_id", "size", "text_hash"], {"before": F.col("size"), "place_in_source": F.lit(1)}, group="source")
    lined = lined.withColumn("block", F.expr(f"(2 * before + size) div {2 * block_bytes}"))
    totals = lined.groupBy("source").agg(F.max("block").alias("last")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them before mixing")
    given = SHARES if shares is None else shares
    own = {r["source"]: given.get(r["source"], 1) for r in totals}
    if sum(own.values()) > MAX_SHARES or any(s < 1 for s in own.values()):
        raise ValueError(f"shares are positive integers of a total up to {MAX_SHARES}")
    plan = [
        (k, own[k], [p[0] for p in ps], [p[1] for p in ps], [p[2] for p in ps], [p[3] for p in ps])
        for k, ps in phases({r["source"]: r["last"] + 1 for r in totals}, own).items()
    ]
    kind = "_source string, share long, firsts array<long>, bases array<long>, totals array<long>, slots array<array<long>>"
    # of a proven size: at most MAX_SOURCES phases of MAX_SHARES slots
    laid = lined.join(F.broadcast(spark.createDataFrame(plan, kind)), F.col("source").eqNullSafe(F.col("_source")))
    laid = laid.withColumn("phase", F.expr("size(filter(firsts, x -> x <= block)) - 1"))
    laid = laid.withColumn("_j", F.expr("block - firsts[phase]")).withColumn("_w", F.expr("totals[phase]"))
    return laid.select(
        "doc_id", "source", "size", "block", "place_in_source", F.col("phase").cast("int").alias("phase"),
        F.expr("bases[phase] + (_j div share) * _w + slots[phase][cast(_j % share as int)]").alias("slot"),
        F.expr("bases[phase] + (_j * _w) div share").alias("release"),
        F.expr("bases[phase] + ((_j + 1) * _w + share - 1) div share").alias("deadline"),
        *along,
    )


def op7_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
