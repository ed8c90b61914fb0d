"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are counted over the
whole corpus: one of the trusted documents, one of all documents. A document's
score is the mean over its n-grams of log(p_trusted / p_raw). The trusted
multinomial is smoothed towards the raw one with a Dirichlet prior of ``PRIOR``
n-grams for each bucket, so that an n-gram of which little is known counts as
neutral rather than as bad, and small corpora give cautious scores.

Every document gets the same deterministic rule: it is kept if it passes the
base rules and its score is at least ``threshold``. The threshold is a fixed
parameter in nats for each n-gram; it does not depend on the other documents.

Nulls: a null text has no words. Null labels are not trusted. A doc_id with
several label rows is trusted only if all of them say so. Empty texts have
score 0 and fail the base rules. Repeated rows are scored and counted each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .frames import docs_only, table

BUCKETS = 1 << 16
SLICE = 1 << 10
PRIOR = 20.0
THRESHOLD = -0.07
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def ngram_buckets(w: K.Words, n_buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document ordinal of each unigram and bigram."""
    mask = K.U64(n_buckets - 1)
    s, two = w.windows(2)
    return (
        np.concatenate([(w.hash & mask).astype(np.int64), (K.mix(two) & mask).astype(np.int64)]),
        np.concatenate([w.doc, w.doc[s]]),
    )


def base_counts(w: K.Words, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of the documents of a chunk."""
    data, n_docs = w.data, len(offsets) - 1
    points = w.mask & ((data & 0xC0) != 0x80)
    # lines: cut at \n and at document bounds
    nl = np.flatnonzero(data == 10)
    full = offsets[1:] > offsets[:-1]
    starts = np.unique(np.concatenate([offsets[:-1][full], nl + 1]))
    starts = starts[starts < len(data)]
    line_doc = np.searchsorted(offsets, starts, side="right") - 1
    stop_at = np.minimum(np.append(starts[1:], len(data)), offsets[line_doc + 1])
    ends = stop_at - (data[np.maximum(stop_at - 1, 0)] == 10)
    ends = np.maximum(ends, starts)
    worded = np.searchsorted(w.starts, starts) < np.searchsorted(w.starts, ends)
    starts, ends, line_doc = starts[worded], ends[worded], line_doc[worded]
    h = K.span_hashes(data, starts, ends)
    order = np.lexsort((h, line_doc))
    again = np.zeros(len(h), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    dup = np.bincount(line_doc[order][again], minlength=n_docs)
    # words in 3-word windows that occur twice or more in the document
    s, three = w.windows(3)
    d = w.doc[s]
    key = three ^ K.mix(d.astype(K.U64) + K.U64(0x51ED))
    order = np.argsort(key, kind="stable")
    k, dd = key[order], d[order]
    same = (k[1:] == k[:-1]) & (dd[1:] == dd[:-1])
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = K.covered(s[order][twice], 3, w.n) if w.n else np.zeros(0, bool)
    return {
        "n_words": w.counts.astype(np.int64),
        "word_chars": K.per_doc(points, offsets),
        "n_symbols": K.per_doc(_SYMBOLS[data], offsets),
        "n_dup_lines": dup.astype(np.int64),
        "n_repeat_words": K.per_doc(hit, w.bounds),
    }


def _count(batches):
    both = np.zeros((2, BUCKETS), np.int64)
    for b in K.chunks(batches):
        w = K.words_of(K.column(b, "text"))
        bucket, doc = ngram_buckets(w)
        trusted = K.column(b, "trusted").to_numpy(zero_copy_only=False).astype(bool)
        both[0] += np.bincount(bucket[trusted[doc]], minlength=BUCKETS)
        both[1] += np.bincount(bucket, minlength=BUCKETS)
    if both[1].any():
        n = BUCKETS // SLICE
        yield pa.RecordBatch.from_pydict(
            {
                "slice": pa.array(np.arange(n), pa.int32()),
                "counts": K.binary([K.pack(both[:, i * SLICE : (i + 1) * SLICE]) for i in range(n)]),
            }
        )


def _add(pdf):
    import pandas as pd

    total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
    return pd.DataFrame({"slice": pdf["slice"].iloc[:1].astype("int32"), "counts": [total.tobytes()]})


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), F.lit(False))
    return (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(good).alias("trusted"))
    )


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log(p_trusted / p_raw) of each bucket, from the counts over all documents."""
    marked = docs.hint("merge").join(trusted_ids(labels), "doc_id", "left").select(
        F.coalesce("trusted", F.lit(False)).alias("trusted"), "text"
    )
    kind = "slice int, counts binary"
    part = marked.mapInArrow(_count, kind)
    # each task's table is of a fixed size; sums go over 64 salts, then over slices
    part = part.withColumn("salt", F.spark_partition_id() % 64).groupBy("slice", "salt").applyInPandas(_add, kind)
    rows = part.groupBy("slice").applyInPandas(_add, kind).collect()
    both = np.zeros((2, BUCKETS), np.int64)
    for r in rows:
        both[:, r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.int64).reshape(2, SLICE)
    n_trusted, n_raw = both.sum(axis=1)
    if not n_trusted or not n_raw:
        return np.zeros(BUCKETS)
    raw = (both[1] + 0.5) / (n_raw + 0.5 * BUCKETS)
    prior = PRIOR * BUCKETS
    return np.log((both[0] + prior * raw) / (n_trusted + prior)) - np.log(raw)


OUT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, llr double"
)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: base counts, llr (nats for each n-gram), base_failed and kept."""
    docs = docs_only(docs)
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels))

    def score(batches):
        for b in K.chunks(batches):
            _, offsets = K.text_bytes(K.column(b, "text"))
            w = K.words_of(K.column(b, "text"))
            c = base_counts(w, offsets)
            bucket, doc = ngram_buckets(w)
            n = np.bincount(doc, minlength=b.num_rows)
            total = np.bincount(doc, weights=ratio.value[bucket], minlength=b.num_rows)
            llr = np.round(np.divide(total, n, out=np.zeros(b.num_rows), where=n > 0), 9)
            failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
            yield pa.RecordBatch.from_pydict(
                {"doc_id": K.column(b, "doc_id"), **{k: pa.array(v) for k, v in c.items()}, "base_failed": pa.array(failed), "kept": pa.array(~failed & (llr >= threshold)), "llr": pa.array(llr)}
            )

    return docs.mapInArrow(score, OUT)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
