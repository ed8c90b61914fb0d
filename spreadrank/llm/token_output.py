"""Token-ID output: Arrow stream files of fixed-size-list batches.

Documents are dealt into key ranges of doc_id; each task encodes its range in
order and writes one file of sequences of ``SEQUENCE`` ids with a mask, and one
of its documents (doc_id, start, n_tokens). Every batch of a file has the same
number of sequences, so a memory-mapped file gives any sequence without a copy.
The last sequence of a file is filled up with the end id, masked out. Files are
written whole under a name of their own for each attempt; the manifest, made
durable by a checkpoint, names the attempt that counts, so a task that is run
again leaves nothing wrong behind.

Encoding gives the ids that the tokenizer, as loaded, gives for the whole text.
Where its file says that it is a byte-level BPE with the usual pattern, without
a normalizer, prefix space or dropout (``_by_pieces``), and every space of a text
is followed by a non-space, its pre-tokenisation cuts before each space. The ids
are then those of the space-separated pieces one after the other, and pieces met
before come from a bounded cache. A new piece of letters, with stops after it or
not, is one or two pre-tokens and goes straight to the tokenizer's model. All
other texts, those that hold an added token, and all texts of any other
tokenizer are encoded whole. A long text is one text.

Nulls: a null text is empty (its end id alone); a null doc_id comes first. An
empty table gives no files. Rows of equal doc_id stand in order of their text.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut, open_uri, parts, scratch, table
from .kernels import KEPT, release

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
SEQUENCE, BATCH = 2048, 128
CACHE = 800_000
_STOPS = ".,;:!?"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pieces(dict):
    """Ids, as bytes, of a piece with a prefix; encoded when first asked for."""

    def __init__(self, encoder, prefix: str):
        super().__init__()
        self.encoder, self.prefix, self.older = encoder, prefix, {}

    def __missing__(self, piece: str) -> bytes | None:
        if len(self) >= CACHE:  # pieces in use come back from the older half
            self.older = dict(self)
            self.clear()
        core = piece.rstrip(_STOPS)
        if piece in self.older:
            found = self.older[piece]
        # letters make one pre-token with the prefix, and the stops after them another
        elif core.isalpha():
            found = self.get(core) or self.older.get(core) or self.encoder.letters(self.prefix + core)
            found += self.encoder.stops[piece[len(core) :]]
        # a space before white space or an end is no cut: such a text is encoded whole
        elif self.prefix and (not piece or piece[0].isspace()):
            found = None
        else:
            found = self.encoder.whole(self.prefix + piece)
        if len(piece) <= 64:
            self[piece] = found
        return found


class _Stops(dict):
    """Ids of runs of stops without a prefix."""

    def __init__(self, encoder):
        super().__init__({"": b""})
        self.encoder = encoder

    def __missing__(self, run: str) -> bytes:
        found = self.encoder.whole(run)
        if len(self) < 10_000 and len(run) < 9:
            self[run] = found
        return found


def _by_pieces(description: str) -> bool:
    """Whether a tokenizer cuts before each space that a non-space follows, whatever the text around it is."""
    t = json.loads(description)
    pre, model = t.get("pre_tokenizer") or {}, t.get("model") or {}
    usual = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    return bool(usual and plain and model.get("type") == "BPE" and not t.get("normalizer") and not t.get("truncation") and not t.get("padding"))


class Encoder:
    _made: dict = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = _by_pieces(self.tokenizer.to_str())
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), END_ID) < 1 << 16 else "<u4")
        self.model = self.tokenizer.model
        # the byte-level alphabet: printable bytes stand for themselves, the others for 256 and on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.first, self.rest, self.stops = _Pieces(self, ""), _Pieces(self, " "), _Stops(self)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def letters(self, text: str) -> bytes:
        """Ids of one pre-token of letters, by the tokenizer's model alone."""
        found = self.model.tokenize(text.encode().decode("latin-1").translate(self.alphabet))
        return np.array([t.id for t in found], self.kind).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.pieces or any(x in text for x in self.added):
            return self.whole(text)
        head, *rest = text.split(" ")
        found, ids = self.rest, []
        try:
            ids = [found[piece] for piece in rest]
            return (self.first[head] if head else b"") + b"".join(ids)
        except TypeError:  # there was None among them
            return self.whole(text)


KEPT.append(Encoder._made)


def _schema(kind: np.dtype) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(kind), SEQUENCE)), ("mask", pa.list_(pa.bool_(), SEQUENCE))])


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_MANIFEST = "shard long, tokens_path string, docs_path string, n_docs long, n_tokens long"


class ShardWriter:
    """One shard: sequences are written as soon as a batch of them is full."""

    def __init__(self, where: str, name: str, kind: np.dtype):
        fs, at = open_uri(where)
        fs.create_dir(at, recursive=True)
        self.paths = f"{where}/{name}.tokens.arrows", f"{where}/{name}.docs.arrows"
        self.files = [fs.open_output_stream(f"{at}/{name}.{x}.arrows") for x in ("tokens", "docs")]
        self.kind, self.schema = kind, _schema(kind)
        self.tokens, self.docs = pa.ipc.new_stream(self.files[0], self.schema), pa.ipc.new_stream(self.files[1], _DOCS)
        self.held: list[bytes] = []
        self.size = self.n_tokens = self.n_docs = 0

    def add(self, doc_ids: pa.Array, ids: list[bytes]) -> None:
        n = np.array([len(x) // self.kind.itemsize for x in ids], np.int64)
        start = self.n_tokens + np.cumsum(n) - n
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), pa.array(start), pa.array(n)], schema=_DOCS))
        self.held += ids
        self.size += int(n.sum())
        self.n_tokens += int(n.sum())
        self.n_docs += len(ids)
        if self.size >= SEQUENCE * BATCH:
            flat = np.frombuffer(b"".join(self.held), self.kind)
            full = len(flat) // (SEQUENCE * BATCH) * SEQUENCE * BATCH
            for i in range(0, full, SEQUENCE * BATCH):
                self._batch(flat[i : i + SEQUENCE * BATCH], SEQUENCE * BATCH)
            self.held, self.size = [flat[full:].tobytes()], len(flat) - full

    def _batch(self, flat: np.ndarray, real: int) -> None:
        ids = pa.FixedSizeListArray.from_arrays(pa.array(flat), SEQUENCE)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(flat)) < real), SEQUENCE)
        self.tokens.write_batch(pa.RecordBatch.from_arrays([ids, mask], schema=self.schema))

    def close(self) -> None:
        if self.size:
            flat = np.full(-(-self.size // SEQUENCE) * SEQUENCE, END_ID, self.kind)
            flat[: self.size] = np.frombuffer(b"".join(self.held), self.kind)
            self._batch(flat, self.size)
        for x in (self.tokens, self.docs, *self.files):
            x.close()


class Shard:
    """A shard read back; on a local disk the file is mapped and nothing is copied."""

    def __init__(self, tokens_path: str, docs_path: str):
        tables = []
        for uri in (tokens_path, docs_path):
            fs, at = open_uri(uri)
            source = pa.memory_map(at) if isinstance(fs, LocalFileSystem) else fs.open_input_file(at)
            tables.append(pa.ipc.open_stream(source).read_all())
        self.tokens, self.docs = tables
        self.chunks = [c.flatten() for c in self.tokens["input_ids"].chunks]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i; the ids are a view of the file."""
        chunk, at = self.chunks[i // BATCH], i % BATCH * SEQUENCE
        mask = self.tokens["mask"].chunk(i // BATCH)[i % BATCH].values.to_numpy(zero_copy_only=False)
        return chunk[at : at + SEQUENCE].to_numpy(), mask


def write_tokens(docs: DataFrame, where: str, order: list[Column | str] | None = None, tokenizer: str | None = None) -> DataFrame:
    """Writes the shards under the folder ``where`` and gives the manifest, in order of ``shard``.

    ``order``: the order of the documents; doc_id and text if left out.
    """
    path = tokenizer or tokenizer_path()
    keys = order or ["doc_id", "text"]
    names = [f"_k{i}" for i in range(len(keys))]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keys, names, strict=True)]
    )
    if not order:  # the text is in the row already
        rows, names = rows.select("doc_id", "text"), ["doc_id", "text"]
    dealt = rows.repartitionByRange(parts(docs.sparkSession), names[0]) if not order else rows.repartitionByRange(parts(docs.sparkSession), *names)
    dealt = dealt.sortWithinPartitions(*names).select("doc_id", "text")

    def run(batches):
        release(keep=Encoder._made)
        encoder, writer, shard = Encoder.of(path), None, TaskContext.get().partitionId()
        end = np.array([END_ID], encoder.kind).tobytes()
        for b in batches:
            if not b.num_rows:
                continue
            writer = writer or ShardWriter(where, f"{shard:06d}-{uuid.uuid4().hex}", encoder.kind)
            for i in range(0, b.num_rows, 256):
                some = b.slice(i, 256)
                writer.add(some.column(0), [encoder.encode(x) + end for x in some.column(1).to_pylist()])
        if writer:
            writer.close()
            made = [shard, *writer.paths, writer.n_docs, writer.n_tokens]
            names = ["shard", "tokens_path", "docs_path", "n_docs", "n_tokens"]
            yield pa.RecordBatch.from_pydict({k: pa.array([v]) for k, v in zip(names, made, strict=True)})

    manifest = cut(dealt.mapInArrow(run, _MANIFEST))
    _remove_others(where, {x for r in manifest.select("tokens_path", "docs_path").collect() for x in r})
    return manifest


def _remove_others(where: str, counted: set[str]) -> None:
    """Removes what attempts that do not count have left."""
    fs, at = open_uri(where)
    names = {x.rsplit("/", 1)[1] for x in counted}
    for x in fs.get_file_info(FileSelector(at, allow_not_found=True)):
        if x.base_name not in names:
            fs.delete_file(x.path)


def _batches(uri: str):
    """The batches of a stream file, one at a time; mapped where the disk is local."""
    fs, at = open_uri(uri)
    with pa.memory_map(at) if isinstance(fs, LocalFileSystem) else fs.open_input_stream(at) as source:
        yield from pa.ipc.open_stream(source)


def _documents(tokens_path: str, docs_path: str):
    """(batch of documents, ids of each) of a shard, with a few batches in memory."""
    ids, held, base = (b.column(0).flatten().to_numpy() for b in _batches(tokens_path)), np.zeros(0, np.uint32), 0
    for batch in _batches(docs_path):
        for d in (batch.slice(i, 10_000) for i in range(0, batch.num_rows, 10_000)):
            own = []
            for start, n in zip(d.column(1).to_numpy().tolist(), d.column(2).to_numpy().tolist(), strict=True):
                if start + n > base + len(held):
                    more, base = [held[start - base :]], start
                    while sum(map(len, more)) < n:
                        more.append(next(ids))
                    held = np.concatenate(more)
                own.append(held[start - base : start - base + n])
            yield d, own


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read from the files."""
    # the manifest has one row a file; the files are read in parallel
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("offset", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    placed = placed.select("offset", "tokens_path", "docs_path").repartition(parts(manifest.sparkSession))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                for d, own in _documents(r["tokens_path"], r["docs_path"]):
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in own]
                    start = d.column(1).to_numpy() + r["offset"]
                    yield pa.RecordBatch.from_pydict({"doc_id": d.column(0), "start": pa.array(start), "n_tokens": d.column(2), "ids_crc32": pa.array(crc, pa.int64())})

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_output(spark, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), scratch(spark, "tokens")))
