"""Substring dedup by difference-cover anchors.

A window is ``WINDOW`` consecutive words. Modulo ``PERIOD`` = 7 the positions
{0, 1, 3} are a difference cover: for any two positions i and j some shift of
at most 6 puts both on cover positions. So two equal windows of 13 words share
an aligned anchor, a hashed gram of 13 - 6 = 7 words at a cover position of
both, and only 3 of 7 positions are hashed. Anchors that stand in several
documents are extended: the windows of 13 words around them are hashed whole,
and each window belongs to the smallest doc_id that has it; every word that a
window of a later document covers is removed.

Hashes travel in packed blocks, one for each task and hash range, not as rows.
Each task first settles what it sees itself: of a gram that many of its
documents share it sends one entry, so a very common passage costs one entry a
task. Blocks go to as many hash ranges as there are shuffle partitions. An
anchor only proposes, so it travels as 32 bits within its hash range: two that
are alike by chance cost a look and change nothing. Windows decide, so they are
told apart by 128 bits of two independent hashes of their words.

Nulls: a null text has no words; a null doc_id comes after all others (several
are equal, so they take nothing from each other). Empty tables give no rows.
Rows that repeat a doc_id are one document for ownership and keep their words
against each other; a window that only recurs within its own document stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .frames import parts, table

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
GRAM = WINDOW - PERIOD + 1
FLUSH = 1_000_000
LAST = np.iinfo(np.int64).max
_SHARED = np.iinfo(np.int64).min  # stands for a document in an entry that says "shared already"
#: What a task sends of an anchor: half of its hash, as its range fixes more bits.
_SHORT = np.uint32
_BLOCK = "part int, told boolean, hashes binary, owners binary, counts binary"
_HITS = "owner long, told binary"


def _groups(values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def _blocks(part: np.ndarray, owner: np.ndarray, h: np.ndarray, n_parts: int, told: bool):
    """Packed (owner, hash) pairs, one row for each part that has any; a hash is a row of h."""
    order = np.lexsort((h if h.ndim == 1 else h[:, 0], owner, part))
    part, owner, h = part[order], owner[order], h[order]
    cuts = np.searchsorted(part, np.arange(n_parts + 1))
    rows: dict = {"part": [], "told": [], "hashes": [], "owners": [], "counts": []}
    for k in np.flatnonzero(np.diff(cuts)):
        own = slice(cuts[k], cuts[k + 1])
        at = _groups(owner[own])
        for name, x in (("part", int(k)), ("told", told), ("hashes", K.pack(h[own])), ("owners", K.pack(owner[own][at[:-1]])), ("counts", K.pack(np.diff(at).astype(np.uint32)))):
            rows[name].append(x)
    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
    whole = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows.values(), kinds, strict=True)], names=list(rows))
    for i in range(0, whole.num_rows, 64):
        yield whole.slice(i, 64)


def _tell(owner: np.ndarray, h: np.ndarray, n_parts: int):
    """Blocks that tell owners of hashes of theirs; they go by the owner."""
    yield from _blocks((K.mix(owner.astype(K.U64)) % K.U64(n_parts)).astype(np.int64), owner, h, n_parts, True)


def _unpacked(rows: list[dict], kind: type) -> tuple[np.ndarray, np.ndarray]:
    hs = [np.zeros(0, kind), *[np.frombuffer(r["hashes"], kind) for r in rows]]
    os_ = [np.zeros(0, np.int64), *[np.repeat(np.frombuffer(r["owners"], np.int64), np.frombuffer(r["counts"], np.uint32)) for r in rows]]
    return np.concatenate(hs), np.concatenate(os_)


def _in_order(h: np.ndarray, again: np.ndarray | None, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """All three in the order of hash and owner, and the starts of runs of one hash and the end."""
    order = np.lexsort((owner, h))
    if again is not None:
        same = h[order][1:] == h[order][:-1]
        if (same & (again[order][1:] != again[order][:-1])).any():  # alike in the first 64 bits only
            order = np.lexsort((owner, again, h))
        again = again[order]
    h, owner = h[order], owner[order]
    if not len(h):
        return h, again, owner, np.zeros(1, np.int64)
    new = h[1:] != h[:-1]
    if again is not None:
        new |= again[1:] != again[:-1]
    return h, again, owner, np.concatenate([[0], np.flatnonzero(new) + 1, [len(h)]])


def _sent(h: np.ndarray, again: np.ndarray | None, owner: np.ndarray, n_parts: int):
    """Settles the hashes of one task as far as it can, and gives its blocks and told rows.

    Windows have ``again``, the other half of their hash; a window belongs to
    its smallest owner and only the others are told. Without it, all owners of
    an anchor that several have are told.
    """
    h, again, owner, at = _in_order(h, again, owner)
    if not len(h):
        return
    new = np.ones(len(h), bool)
    new[1:] = owner[1:] != owner[:-1]
    new[at[:-1]] = True
    size = np.add.reduceat(new.astype(np.int64), at[:-1])
    first = at[:-1]
    tell = np.repeat(size > 1, np.diff(at)) & new
    if again is not None:
        tell[first] = False
    short = h if again is not None else (h >> K.U64(32)).astype(_SHORT)
    yield from _tell(owner[tell], short[tell], n_parts)
    part = (K.mix(h[first]) % K.U64(n_parts)).astype(np.int64)
    if again is not None:
        yield from _blocks(part, owner[first], np.column_stack([h[first], again[first]]), n_parts, False)
    else:
        yield from _blocks(part, np.where(size > 1, _SHARED, owner[first]), short[first], n_parts, False)


def _settle(n_parts: int, owned: bool):
    """Of a hash range's blocks: which owners are told of which hashes."""

    def run(batches):
        rows = []
        for b in batches:
            told = b.filter(K.column(b, "told"))
            if told.num_rows:
                yield told
            rows += b.filter(pa.compute.invert(K.column(b, "told"))).to_pylist()
        if owned:
            both, owner = _unpacked(rows, np.dtype((K.U64, 2)))
            h, again = both.reshape(-1, 2).T
        else:
            (h, owner), again = _unpacked(rows, _SHORT), None
        del rows
        h, _, owner, at = _in_order(h, again, owner)
        if not len(h):
            return
        size = np.diff(at)
        low, high = np.repeat(owner[at[:-1]], size), np.repeat(owner[at[1:] - 1], size)
        tell = (owner > low) if owned else (owner != _SHARED) & (low != high)
        yield from _tell(owner[tell], h[tell], n_parts)

    return run


def _gathered(owned: bool):
    """All hashes that each owner of a part was told of, one row an owner."""

    def run(batches):
        h, owner = _unpacked([r for b in batches for r in b.to_pylist()], K.U64 if owned else _SHORT)
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
        at = _groups(owner)
        for i in range(0, len(at) - 1, 5000):
            cuts = at[i : i + 5001]
            yield pa.RecordBatch.from_pydict({"owner": pa.array(owner[cuts[:-1]]), "told": K.binary([K.pack(h[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)])})

    return run


def _anchors(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the grams at cover positions."""
    place = np.arange(w.n) - w.bounds[w.doc] if w.n else np.zeros(0, np.int64)
    s, h = w.windows(GRAM)
    on = np.isin(place[s] % PERIOD, COVER)
    return s[on], h[on]


def _send(found, n_parts: int):
    """A mapper that gathers (hash, its other half or None, owner) of many chunks before it sends."""

    def sent(held):
        hs, others, owners = zip(*held, strict=True)
        return _sent(np.concatenate(hs), None if others[0] is None else np.concatenate(others), np.concatenate(owners), n_parts)

    def run(batches):
        held, n = [], 0
        for b in K.chunks(batches):
            held.append(found(b))
            n += len(held[-1][0])
            if n >= FLUSH:
                yield from sent(held)
                held, n = [], 0
        if n:
            yield from sent(held)

    return run


def _owner(b: pa.RecordBatch) -> np.ndarray:
    return K.column(b, "owner").to_numpy(zero_copy_only=False)


def _anchor_hashes(b):
    w = K.words_of(K.column(b, "text"))
    s, h = _anchors(w)
    return h, None, _owner(b)[w.doc[s]]


def _known(b: pa.RecordBatch, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of which the documents of a chunk were told, with their ordinals."""
    lists = K.column(b, "told").to_pylist()
    n = np.array([len(x) // np.dtype(kind).itemsize if x else 0 for x in lists], np.int64)
    return np.frombuffer(b"".join(x for x in lists if x), kind), np.repeat(np.arange(b.num_rows), n)


def _among(h: np.ndarray, doc: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
    """Which (hash, document) pairs the documents were told of."""
    told, of = _known(b, h.dtype)
    salt = K.U64(0x9E3779B97F4A7C15)
    return np.isin(K.mix(h ^ K.mix(doc.astype(K.U64) * salt)), K.mix(told ^ K.mix(of.astype(K.U64) * salt)))


def _window_hashes(b):
    w = K.words_of(K.column(b, "text"))
    s, h = _anchors(w)
    shared = np.zeros(w.n + PERIOD, np.int64)
    shared[s[_among((h >> K.U64(32)).astype(_SHORT), w.doc[s], b)]] = 1
    total = np.concatenate([[0], np.cumsum(shared)])
    s, h = w.windows(WINDOW)
    near = total[s + PERIOD] > total[s]
    again = K.window_hashes(w.second, WINDOW)[s[near]] if near.any() else h[near]
    return h[near], again, _owner(b)[w.doc[s[near]]]


def _removed(batches):
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in K.chunks(batches):
        w = K.words_of(K.column(b, "text"))
        s, h = w.windows(WINDOW)
        gone = K.covered(s[_among(h, w.doc[s], b)], WINDOW, w.n)
        removed = K.per_doc(gone, w.bounds)
        begin, stop = gone.copy(), gone.copy()
        begin[1:] &= ~gone[:-1] | (w.doc[1:] != w.doc[:-1])
        stop[:-1] &= ~gone[1:] | (w.doc[1:] != w.doc[:-1])
        at, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        first = w.bounds[w.doc[at]] if len(at) else at
        spans = pa.StructArray.from_arrays([pa.array(at - first), pa.array(end - first)], fields=list(kinds.value_type))
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, w.bounds), pa.int32()), spans)
        raw, texts = w.data.tobytes(), []
        for d in range(b.num_rows):
            kept = raw[w.offsets[d] : w.offsets[d + 1]].split()
            if removed[d]:
                out = gone[w.bounds[d] : w.bounds[d + 1]]
                kept = [x for x, g in zip(kept, out.tolist(), strict=True) if not g]
            texts.append(b" ".join(kept))
        yield pa.RecordBatch.from_pydict(
            {"doc_id": K.column(b, "doc_id"), "n_words": pa.array(w.counts.astype(np.int64)), "n_removed": pa.array(removed), "spans": lists, "kept_text": pa.array(texts, pa.binary()).cast(pa.string())}
        )


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, spans (start, end in words) removed, and kept_text."""
    n = parts(docs.sparkSession)
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("owner"), F.col("text").cast("string").alias("text")
    )

    def told(df: DataFrame, found, owned: bool) -> DataFrame:
        sent = df.mapInArrow(_send(found, n), _BLOCK).repartitionById(n, F.col("part"))
        hits = sent.mapInArrow(_settle(n, owned), _BLOCK).repartitionById(n, F.col("part")).mapInArrow(_gathered(owned), _HITS)
        # both joins read one and the same exchange of the documents
        return docs.hint("merge").join(hits, "owner", "left")

    extended = told(told(docs, _anchor_hashes, False).where("told is not null"), _window_hashes, True)
    return extended.select("doc_id", "text", "told").mapInArrow(
        _removed, "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"
    )


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    kept = substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
