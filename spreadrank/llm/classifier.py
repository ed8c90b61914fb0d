"""Quality classifier: Bradley-Terry scores from preference pairs.

Each labelled document of label 1 is preferred to each of label 0. A document's
strength is linear in its features, and the probability that one is preferred
to the other is the logistic function of the difference of their strengths, so
fitting is logistic loss on feature differences. The cut is the quantile of the
training strengths at the share of label 0; the score is the logistic function
of strength minus cut, so 0.5 stands at the cut.

Fitting uses every labelled document outside the held-out fold, and every pair
of a good and a bad one. The pairs are never made: strengths are laid on a grid
of ``BINS`` points, each between its two neighbours by linear interpolation, and
the loss over all pairs follows from the sums of each grid point. Only these
sums reach the driver. Every document is scored. Only the text is an input of a
score.

Nulls: a null text is an empty one and is scored. Labels that are null or that
contradict each other for one doc_id teach nothing. Without both labels in the
training rows every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .frames import cut, docs_only, is_carried, table
from .quality_rules import _SYMBOLS, base_counts

#: Grid points of the strengths, training rows of one task, and values of which a quantile is read at once.
BINS = 512
ROWS_A_TASK = 200_000
FEW = 100_000
RIDGE = 1e-3
_BYTES = np.arange(256)
_CLASSES = {
    "symbols": _SYMBOLS,
    "pipes": _BYTES == ord("|"),
    "marks": _BYTES == ord("!"),
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "digits": (_BYTES >= 48) & (_BYTES <= 57),
    "stops": np.isin(_BYTES, np.frombuffer(b".,;:?", np.uint8)),
    "lines": _BYTES == 10,
    "braces": np.isin(_BYTES, np.frombuffer(b"{}[]()=_/\\@", np.uint8)),
}
FEATURES = (*_CLASSES, "log_words", "word_length", "repeated", "dup_lines", "stutter", "distinct", "capital", "empty")


def features(batch: pa.RecordBatch) -> np.ndarray:
    """One row of FEATURES for each text of a chunk."""
    data, offsets = K.text_bytes(K.column(batch, "text"))
    w = K.words_of(K.column(batch, "text"))
    c = base_counts(w, offsets)
    n_bytes, n_words = np.maximum(np.diff(offsets), 1), np.maximum(w.counts, 1)
    root = lambda part, whole: np.sqrt(part / whole)  # noqa: E731  shares near 0 matter most
    out = [root(K.per_doc(own[data], offsets), n_bytes) for own in _CLASSES.values()]
    same = np.zeros(w.n, bool)
    if w.n > 1:
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    order = np.lexsort((w.hash, w.doc))
    new = np.ones(w.n, bool)
    if w.n > 1:
        h, d = w.hash[order], w.doc[order]
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(w.doc[order][new], minlength=batch.num_rows)
    first = data[w.starts] if w.n else np.zeros(0, np.uint8)
    out += [
        np.log1p(w.counts) / 10,
        np.log1p(c["word_chars"] / n_words),
        root(c["n_repeat_words"], n_words),
        root(c["n_dup_lines"], K.per_doc(_CLASSES["lines"][data], offsets) + 1),
        root(K.per_doc(same, w.bounds), n_words),
        distinct / np.sqrt(n_words) / 10,
        root(K.per_doc(_CLASSES["upper"][first], w.bounds), n_words),
        (w.counts == 0).astype(float),
    ]
    return np.column_stack(out)


def _feature_rows(batches):
    for b in K.chunks(batches):
        x = features(b)
        yield pa.RecordBatch.from_pydict(
            {"doc_id": K.column(b, "doc_id"), "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))}
        )


class _Local:
    """Training rows on the driver, with the passes of _Spread."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = np.asarray(x, float).reshape(len(y), -1), np.asarray(y)

    def each(self, part) -> list[np.ndarray]:
        return [part(self.x, self.y)]


class _Spread:
    """Training rows in a checkpoint; a pass gives one array for each part of them, in order."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def each(self, part) -> list[np.ndarray]:
        def run(batches):
            if got := list(batches):  # one array a task, so that what the driver gets does not grow with the batches
                all_ = pa.Table.from_batches(got)
                x = np.asarray(all_["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_pydict({"a": pa.array([part(x, all_["quality"].to_numpy()).tobytes()], pa.binary())})

        return [np.frombuffer(a) for a in self.rows.mapInArrow(run, "a binary").toArrow()["a"].to_pylist()]


class BradleyTerry:
    """Strengths of documents; fitted by passes over the training rows, wherever they are."""

    def __init__(self, x, y: np.ndarray | None = None):
        rows, n = (_Local(x, y), len(FEATURES)) if y is not None else (x, len(FEATURES))
        self.mean, self.scale, self.weights, self.cut = np.zeros(n), np.ones(n), np.zeros(n), 0.0
        sums = sum(rows.each(lambda x, y: np.concatenate([[len(y), (y == 1).sum()], x.sum(axis=0)])), np.zeros(n + 2))
        total, good = sums[0], sums[1]
        if not total:
            return
        mean = self.mean = sums[2:] / total
        self.scale = np.maximum(np.sqrt(sum(rows.each(lambda x, y: ((x - mean) ** 2).sum(axis=0))) / total), 1e-6)
        if good in (0, total):
            return
        for _ in range(50):  # Newton steps on the ridge-penalised logistic loss of all pairs
            step = np.linalg.solve(*self._slopes(rows, good * (total - good)))
            self.weights -= step
            if np.abs(step).max() < 1e-5:
                break
        self.cut = self._quantile(rows, (total - good) / total, int(total))

    def _slopes(self, rows, pairs: float) -> tuple[np.ndarray, np.ndarray]:
        """Hessian and gradient of the mean loss over all pairs."""
        n, z, w = len(self.weights), self._z, self.weights
        ends = rows.each(lambda x, y: np.array([(z(x) @ w).min(), (z(x) @ w).max()]) if len(y) else np.array([np.inf, -np.inf]))
        low = min(e[0] for e in ends)
        gap = max((max(e[1] for e in ends) - low) / (BINS - 1), 1e-9)

        def places(x):
            at = (x @ w - low) / gap
            j = np.clip(at.astype(np.int64), 0, BINS - 2)
            return j, at - j

        def sums(x, y):  # of each class and grid point: rows and features
            x = z(x)
            (j, right), out = places(x), np.zeros((1 + n, 2 * BINS))
            for side, share in ((0, 1 - right), (1, right)):
                key = y.astype(np.int64) * BINS + j + side
                for c in range(1 + n):
                    out[c] += np.bincount(key, share if c == 0 else share * x[:, c - 1], 2 * BINS)
            return out.ravel()

        all_ = sum(rows.each(sums)).reshape(1 + n, 2, BINS)
        (nb, ng), (xb, xg) = all_[0], all_[1:].transpose(1, 2, 0)
        grid = np.arange(BINS) * gap
        p = 1 / (1 + np.exp(-np.clip(grid[:, None] - grid[None, :], -30, 30)))
        q = p * (1 - p)
        curve = np.stack([ng @ q, q @ nb])  # for a bad row over all good ones, for a good row over all bad ones

        def squares(x, y):
            x = z(x)
            j, right = places(x)
            return (x.T @ (x * ((1 - right) * curve[y, j] + right * curve[y, j + 1])[:, None])).ravel()

        own, cross = sum(rows.each(squares)).reshape(n, n), xg.T @ q @ xb
        gradient = ((p - 1) @ nb) @ xg - (ng @ (p - 1)) @ xb
        return (own - cross - cross.T) / pairs + RIDGE * np.eye(n), gradient / pairs + RIDGE * w

    def _quantile(self, rows, share: float, total: int) -> float:
        """The quantile (linear, as NumPy's) of all strengths; ranges are narrowed until few values are left in them."""
        z, w = self._z, self.weights
        at = share * (total - 1)

        def kth(k: int) -> float:
            low, high = -np.inf, np.inf
            while True:
                def count(x, y, low=low, high=high):
                    s = z(x) @ w
                    s = s[(s >= low) & (s <= high)]
                    return np.array([(z(x) @ w < low).sum(), len(s), s.min() if len(s) else np.inf, s.max() if len(s) else -np.inf])

                found = rows.each(count)
                before, inside = sum(f[0] for f in found), sum(f[1] for f in found)
                low, high = min(f[2] for f in found), max(f[3] for f in found)
                if low == high:
                    return low
                if inside <= FEW:
                    values = np.concatenate(rows.each(lambda x, y: (s := z(x) @ w)[(s >= low) & (s <= high)]))
                    return float(np.partition(values, k - int(before))[k - int(before)])
                edges = np.linspace(low, high, 1025)
                so_far = before + np.cumsum(sum(rows.each(lambda x, y: np.histogram(z(x) @ w, edges)[0].astype(float))))
                b = int(np.searchsorted(so_far, k, side="right"))
                low, high = edges[b], edges[b + 1]

        first = kth(int(at))
        return first if at == int(at) else first + (at - int(at)) * (kth(int(at) + 1) - first)

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-np.clip(self._z(x) @ self.weights - self.cut, -30, 30))), 12)


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame) -> BradleyTerry:
    """Learns from all labelled documents outside the held-out fold; their texts stay where they are read."""
    known = (
        labels.where(F.col("quality").isin(0, 1) & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most")
        .select("doc_id", "quality")
    )
    made = docs_only(docs).where(~held_out()).mapInArrow(_feature_rows, "doc_id long, x array<double>").join(known, "doc_id")
    rows = cut(made.select("doc_id", "quality", "x"))
    n = rows.count()
    tasks = max(1, -(-n // ROWS_A_TASK), min(-(-n * 10 // ROWS_A_TASK), docs.sparkSession.sparkContext.defaultParallelism))
    return BradleyTerry(_Spread(cut(rows.repartition(tasks, "doc_id").sortWithinPartitions("doc_id", "quality", "x").select("quality", "x"))))


def classify(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """doc_id, score and predicted; of carried() documents, also text and the struct."""
    own = docs if is_carried(docs) else docs_only(docs)
    kept = [f for f in own.schema if f.name != "text" or is_carried(own)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in K.chunks(batches):
            s = shared.value.score(features(b))
            cols = {f.name: K.column(b, f.name) for f in kept}
            yield pa.RecordBatch.from_pydict(cols | {"score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))})

    return own.mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = classify(docs_only(docs), fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
