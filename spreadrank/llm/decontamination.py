"""Benchmark decontamination by an FM-index for each training shard.

The test phrases are all windows of ``WINDOW`` words of the benchmark items (an
item of fewer words is one phrase). A shard is a bounded chunk of documents; its
index is built where its documents are read, over every word of them, so nothing
is shuffled. Phrases are found by backward search through wavelet ranks, all
phrases at once; occurrences are located by sampled suffix positions and merged
into spans.

The benchmark is cut into blocks of at most ``BLOCK_WORDS`` words by the tasks
that read it, written to the shared folder as hashes of words. The driver sees
the names of the blocks only, and the documents pass once: a task builds the
index of a shard and searches one block after the other in it. A long item is
cut into pieces that overlap by a window less one word.

The block files need a file system that pyarrow reaches (local and hdfs).

Nulls: a null text has no words and no hits; null items match nothing; a null
doc_id is judged like any other. Empty tables give no rows or no hits. Rows of
one item_id count as one item. Repeated documents are judged each by itself. A
long text makes a shard of its own. Other columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .fm_index import FMIndex
from .frames import CARRIED, cut, is_carried, open_uri, scratch, table

WINDOW = 13
BLOCK_WORDS = 1 << 18
#: Words of blocks that a worker keeps in memory.
KEPT_WORDS = 4 << 20


class Phrases:
    """The phrases of a block of item pieces: hashes of words, and start, length and item of each phrase."""

    def __init__(self, names: list[str], hashes: np.ndarray, bounds: np.ndarray, window: int = WINDOW):
        self.names, self.hashes = np.array(names, object), hashes
        size = np.diff(bounds)
        n = np.where(size > 0, np.maximum(size - window + 1, 1), 0)
        self.starts = np.arange(n.sum()) + np.repeat(bounds[:-1] - (np.cumsum(n) - n), n)
        self.lengths = np.repeat(np.minimum(size, window), n)
        self.item = np.repeat(np.arange(len(names)), n)

    def occurrences(self, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word position, length and item number of all occurrences of the phrases in a shard."""
        none = np.zeros(0, np.int64)
        starts, lengths, items = [none], [none], [none]
        symbols = shard.symbols(self.hashes)
        unknown = np.concatenate([[0], np.cumsum(symbols == 0)])
        maybe = np.flatnonzero(unknown[self.starts + self.lengths] == unknown[self.starts])
        for n in np.unique(self.lengths[maybe]).tolist():
            own = maybe[self.lengths[maybe] == n]
            lo, hi = shard.index.search(symbols, self.starts[own], n)
            got = np.repeat(np.arange(len(own)), hi - lo)
            row = np.arange(len(got)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[got]
            starts.append(shard.origin[shard.index.locate(row)])
            lengths.append(np.full(len(got), n))
            items.append(self.item[own[got]])
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(items)


class Shard:
    """The FM-index of all words of a chunk of documents."""

    def __init__(self, w: K.Words):
        self.vocabulary, symbols = np.unique(w.hash, return_inverse=True)
        head = np.ones(w.n, bool)
        head[1:] = w.doc[1:] != w.doc[:-1]
        at = np.arange(w.n) + np.cumsum(head)  # a 0 before each document
        text = np.zeros(w.n + int(head.sum()) + 1, np.int64)
        text[at] = symbols + 1
        self.origin = np.zeros(len(text), np.int64)
        self.origin[at] = np.arange(w.n)
        self.index = FMIndex(text, len(self.vocabulary) + 1)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words, 0 for a word that the shard lacks."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Disjoint spans, one a row, in order; spans that touch are one."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    return np.column_stack([s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]])


def _write_blocks(where: str, window: int, most: int):
    """A mapper from items to block files; gives the path of each."""

    def write(held: list[tuple[str, np.ndarray]]):
        path = f"{where}/{uuid.uuid4().hex}.arrows"
        rows = pa.RecordBatch.from_pydict({"name": pa.array([n for n, _ in held], pa.string()), "words": pa.array([h for _, h in held], pa.list_(pa.uint64()))})
        fs, at = open_uri(where)
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/{path.rsplit('/', 1)[1]}") as out, pa.ipc.new_stream(out, rows.schema) as stream:
            stream.write_batch(rows)
        return pa.RecordBatch.from_pydict({"path": pa.array([path])})

    def run(batches):
        held, n = [], 0
        for b in K.chunks(batches):
            w = K.words_of(K.column(b, "text"), K.ALNUM, lower=True)
            for name, begin, end in zip(K.column(b, "item").to_pylist(), w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
                for at in range(begin, max(begin + 1, end - window + 1) if end > begin else begin, most):
                    piece = w.hash[at : min(at + most + window - 1, end)]
                    if n + len(piece) > most and held:
                        yield write(held)
                        held, n = [], 0
                    held.append((name, piece))
                    n += len(piece)
        if held:
            yield write(held)

    return run


def phrase_blocks(benchmark: DataFrame, window: int = WINDOW) -> list[str]:
    """Paths of the block files of a benchmark; a row for each block is all that comes to the driver."""
    where = scratch(benchmark.sparkSession, "phrases")
    own = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null")
    made = cut(own.mapInArrow(_write_blocks(where, window, BLOCK_WORDS), "path string"))
    return sorted(r["path"] for r in made.collect())


_blocks: dict[str, Phrases] = {}
K.KEPT.append(_blocks)


def _load(path: str, window: int) -> Phrases:
    found = _blocks.pop(path, None)
    if found is None:
        fs, at = open_uri(path)
        with fs.open_input_file(at) as f:
            t = pa.ipc.open_stream(f).read_all().combine_chunks()
        words = t["words"].combine_chunks() if isinstance(t["words"], pa.ChunkedArray) else t["words"]
        found = Phrases(t["name"].to_pylist(), words.values.to_numpy(), words.offsets.to_numpy().astype(np.int64), window)
        while _blocks and sum(len(x.hashes) for x in _blocks.values()) + len(found.hashes) > KEPT_WORDS:
            del _blocks[next(iter(_blocks))]
    _blocks[path] = found
    return found


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans (start, end in words, merged), items (sorted) of each document.

    Of carried() documents, text and the struct come along.
    """
    along = [CARRIED] if is_carried(docs) else []
    df = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"), *along,
    )
    df = df.mapInArrow(_search(phrase_blocks(benchmark, window), window), df.schema)
    return df if along else df.drop("text")


def _search(paths: list[str], window: int):
    def run(batches):
        for b in K.chunks(batches, keep=_blocks):
            w = K.words_of(K.column(b, "text"), K.ALNUM, lower=True)
            spans, names = [None] * b.num_rows, [None] * b.num_rows
            if w.n and paths:
                shard, found = Shard(w), []
                for path in paths:
                    p = _load(path, window)
                    start, length, item = p.occurrences(shard)
                    found.append((start, length, p.names[item]))
                start, length, item = (np.concatenate(x) for x in zip(*found, strict=True))
                doc = w.doc[start]
                order = np.argsort(doc, kind="stable")
                cuts = np.searchsorted(doc[order], np.arange(b.num_rows + 1))
                for d in np.unique(doc):
                    own = order[cuts[d] : cuts[d + 1]]
                    s = start[own] - w.bounds[d]
                    spans[d] = [{"start": x, "end": y} for x, y in merged_spans(s, s + length[own]).tolist()]
                    names[d] = sorted(set(item[own].tolist()))
            cols = {
                "doc_id": K.column(b, "doc_id"), "text": K.column(b, "text"), "n_words": pa.array(w.counts.astype(np.int64)),
                "spans": pa.array(spans, b.schema.field("spans").type), "items": pa.array(names, b.schema.field("items").type),
            }
            yield pa.RecordBatch.from_pydict({k: cols[k] if k in cols else K.column(b, k) for k in b.schema.names})

    return run


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated (at least a twentieth of the words hit)."""
    names = F.coalesce("items", F.array().cast("array<string>"))
    return found.withColumns(
        {
            "n_hit": F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]), F.lit(0).cast("long")),
            "n_items": F.size(names).cast("long"),
            "items_sha256": F.sha2(F.array_join(names, ",").cast("binary"), 256),
        }
    ).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
