"""Fuzzy line dedup: MinHash over character shingles, union-find over exact links.

A line is a part of a text between newlines that holds a word. Its set is its
distinct ``SHINGLE``-character shingles (the whole line if it is shorter). Two
lines link when the Jaccard similarity of their sets is at least 0.8. Linked
lines form components by distributed union-find; of all lines of a component,
exact copies included, only the first (smallest doc_id, then position) stays.

The style is free (NumPy over Arrow, joins): three forms with DataFrame functions
only were measured and took three times the limit, see the README.

Signatures are ``BANDS`` bands of ``ROWS`` minima over all shingles of a line. They
only propose pairs; whether two lines link is decided on whole sets:

1. Tasks send the band keys of their distinct lines in packed blocks by hash
   range; lines that share a key with another line are kept, with their texts.
2. For each of these the shingles that no other one has are counted. They cannot
   be common to any pair, which bounds its similarity from above, exactly: many
   lines can link with nothing, and a pair of the others must pass the bound to be made.
3. Each has a sketch, one bit of each of ``BITS`` more minima; of two lines whose
   sketches differ in over ``FAR`` bits no pair is made.
4. In ``HUB_ROUNDS`` rounds (one) the lines of a key meet ``HUBS`` hubs of that key, those
   with the least share of shingles of their own; what passes the exact test joins.
5. Lines of a key that still are in different components and pass both filters meet;
   the line of the smaller component travels.

No pair that shares a key, passes the sketches and could join two components is left
out. Lines are told apart by 128 bits, shingles by 64 (those of ASCII letters only, exactly).

Nulls: a null text has no lines and stays null; a null doc_id comes last in the
order, and its lines lose to others. Empty tables give no rows. Rows that
repeat a doc_id share one numbering, so repeats of its lines at one position
stay or go together. Texts of any length are taken whole; ties go to the
earlier line. Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .frames import cut, docs_only, parts, table

SHINGLE, BANDS, ROWS = 9, 9, 3
#: Lines link at 4/5 of Jaccard similarity.
NUM, DEN = 4, 5
HUB_ROUNDS, HUBS = 1, 8
#: Bits of a line's sketch, and how many may differ: at similarity 0.8 some 26 do, and more than 46 in one pair of 40,000.
BITS, FAR = 256, 46
#: Distinct lines, and tokens, that a task holds before it sends them.
FLUSH_LINES, FLUSH_TOKENS = 200_000, 4_000_000
#: Bytes of lines whose shingles are hashed at once, so that arrays stay in a processor's cache.
SLICE = 1 << 17
#: Pairs whose sets are made at once.
TESTED = 2000
_WORDED = r"[^\x20\x09-\x0D]"
#: A fixed odd pattern for each minimum.
_MASKS = K.mix(np.arange(1, BANDS * ROWS + 1, dtype=K.U64) * K.U64(K.SEEDS[0]))
_WHOLE = K.SEEDS[1] ^ 0x5555


# -- lines and their shingles ----------------------------------------------------------------


class Lines:
    """The lines with a word of a chunk: document, position, byte span and 128 bits of each."""

    def __init__(self, col: pa.Array):
        self.data, o = K.text_bytes(col)
        breaks = self.data == 10
        begin = np.sort(np.concatenate([o[:-1], np.flatnonzero(breaks) + 1]))
        end = np.sort(np.concatenate([np.flatnonzero(breaks), o[1:]]))
        count = K.per_doc(breaks, o) + 1
        doc = np.repeat(np.arange(len(count)), count)
        pos = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        worded = np.concatenate([[0], np.cumsum(K.SPACED[self.data])])
        live = worded[end] > worded[begin]
        self.doc, self.pos, self.begin, self.end = doc[live], pos[live], begin[live], end[live]
        self.ids = np.stack([K.span_hashes(self.data, self.begin, self.end, s) for s in K.SEEDS], axis=1)

    def distinct(self) -> np.ndarray:
        """One line of each kind."""
        return np.sort(_first(self.ids))

    def texts(self, which: np.ndarray) -> pa.Array:
        raw = self.data.tobytes()
        return pa.array([raw[s:e] for s, e in zip(self.begin[which].tolist(), self.end[which].tolist(), strict=True)], pa.binary()).cast(pa.string(), safe=False)


def _first(ids: np.ndarray) -> np.ndarray:
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    s = ids[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]).any(axis=1)
    return order[new]


def _names(ids: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(ids), [None, pa.py_buffer(K.pack(ids))]).cast(pa.binary())


def _ids(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), K.U64).reshape(-1, 2)


def _characters(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, and the spans among them; malformed bytes count as U+FFFD."""
    if not len(data) or data.max() < 128:
        return data, begin, end
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        return points, at[begin], at[end]
    except UnicodeDecodeError:
        each = [data[s:e].tobytes().decode(errors="replace").encode("utf-32-le") for s, e in zip(begin, end, strict=True)]
        at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in each])]).astype(np.int64)
        return np.frombuffer(b"".join(each), "<u4"), at[:-1], at[1:]


def shingles(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all lines (in order, none empty), with repeats, and where each line's begin."""
    points, s, e = _characters(data, begin, end)
    n = len(points)
    c = np.concatenate([points, np.zeros(SHINGLE, points.dtype)]).astype(K.U64)
    # nine characters of seven bits fill one word, so equal hashes are equal shingles
    two = c[:-1] | c[1:] << K.U64(7)
    four = two[:-2] | two[2:] << K.U64(14)
    h = K.mix((four[: n + 1] | four[4 : n + 5] << K.U64(28) | c[8 : n + 9] << K.U64(56))[:n])
    wide = points >= 128
    if wide.any():
        seen = np.concatenate([[0], np.cumsum(np.concatenate([wide, np.zeros(SHINGLE - 1, bool)]))])
        w = np.flatnonzero(seen[SHINGLE:] > seen[:n])
        three = [c[w + k] | c[w + k + 1] << K.U64(21) | c[w + k + 2] << K.U64(42) for k in (0, 3, 6)]
        h[w] = K._joined(K._joined(K.mix(three[0] ^ K.U64(_WHOLE)), three[1]), three[2])
    count = np.maximum(e - s - SHINGLE + 1, 1)
    at = np.concatenate([[0], np.cumsum(count)])
    step = np.zeros(n + 1, np.int8)
    step[s] += 1
    step[s + count] -= 1
    out = h[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    short = np.flatnonzero(e - s < SHINGLE)
    out[at[short]] = K.span_hashes(data, begin[short], end[short], _WHOLE)
    return out, at


def _slices(begin: np.ndarray, end: np.ndarray, most: int = SLICE):
    """Ranges of lines of at most ``most`` bytes (or shingles), or of one line."""
    at = 0
    while at < len(begin):
        to = max(int(np.searchsorted(end, begin[at] + most, side="right")), at + 1)
        yield at, to
        at = to


def sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each line of a column, in order, and where each line's begin."""
    data, o = K.text_bytes(col)
    out, sizes = [np.zeros(0, K.U64)], [np.zeros(1, np.int64)]
    for i, j in _slices(o[:-1], o[1:]):
        h, at = shingles(data[o[i] : o[j]], o[i:j] - o[i], o[i + 1 : j + 1] - o[i])
        for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            h[x:y].sort()
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new[at[:-1]] = True
        out.append(h[new])
        sizes.append(K.per_doc(new, at))
    return np.concatenate(out), np.cumsum(np.concatenate(sizes))


def signatures(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The band keys of each line, one column for each band."""
    out = [np.zeros((0, BANDS), K.U64)]
    for i, j in _slices(begin, end):
        a, z = begin[i], end[j - 1]
        h, at = shingles(data[a:z], begin[i:j] - a, end[i:j] - a)
        low = [np.minimum.reduceat(h ^ m, at[:-1]) for m in _MASKS]
        keys = [K.mix(low[ROWS * b] + K.U64(b)) for b in range(BANDS)]
        for r in range(1, ROWS):
            keys = [K._joined(x, low[ROWS * b + r]) for b, x in enumerate(keys)]
        out.append(np.stack(keys, axis=1))
    return np.concatenate(out)


def _place_rows(batches):
    for b in K.chunks(batches):
        x = Lines(K.column(b, "text"))
        yield pa.RecordBatch.from_pydict({"doc_id": K.column(b, "doc_id").take(pa.array(x.doc)), "pos": pa.array(x.pos.astype(np.int32)), "id": _names(x.ids)})


def _text_rows(batches):
    for b in K.chunks(batches):
        x = Lines(K.column(b, "text"))
        own = x.distinct()
        yield pa.RecordBatch.from_pydict({"id": _names(x.ids[own]), "line": x.texts(own)})


# -- 1: lines that share a band key ----------------------------------------------------------


def _ranges(values: np.ndarray, n_parts: int):
    """(range, which of the values) for each hash range that has some."""
    part = (K.mix(values) % K.U64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(n_parts + 1))
    for k in range(n_parts):
        if cuts[k] < cuts[k + 1]:
            yield k, order[cuts[k] : cuts[k + 1]]


def _key_blocks(n_parts: int):
    def sent(ids, keys):
        ids, keys = np.concatenate(ids), np.concatenate(keys)
        own = _first(ids)
        flat, of = keys[own].ravel(), np.repeat(own, BANDS)
        for k, some in _ranges(flat, n_parts):
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "keys": K.binary([K.pack(flat[some])]), "ids": K.binary([K.pack(ids[of[some]])])})

    def run(batches):
        ids, keys, held = [], [], 0
        for b in K.chunks(batches):
            x = Lines(K.column(b, "text"))
            own = x.distinct()
            ids.append(x.ids[own])
            keys.append(signatures(x.data, x.begin[own], x.end[own]))
            held += len(own)
            if held >= FLUSH_LINES:
                yield from sent(ids, keys)
                ids, keys, held = [], [], 0
        if held:
            yield from sent(ids, keys)

    return run


def _shared(batches):
    """Of a hash range: the keys that several lines have, and these lines."""
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return
    keys, ids = np.frombuffer(b"".join([r["keys"] for r in rows]), K.U64), _ids([r["ids"] for r in rows])
    del rows
    order = np.lexsort((ids[:, 1], ids[:, 0], keys))
    keys, ids = keys[order], ids[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]).any(axis=1)
    keys, ids = keys[new], ids[new]
    same = keys[1:] == keys[:-1]
    several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    keys, ids = keys[several], ids[several]
    for i in range(0, len(keys), 50_000):
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys[i : i + 50_000].view(np.int64)), "id": _names(ids[i : i + 50_000])})


# -- 2: shingles that only one line has ------------------------------------------------------

_SKETCH = [f"s{k}" for k in range(BITS // 64)]
_NODE = "part int, nth int, id binary, n int, " + ", ".join(f"{s} long" for s in _SKETCH) + ", line string"
#: Odd factors of the sketch's minima.
_FACTORS = (K.mix(np.arange(1, BITS + 1, dtype=K.U64) ^ K.U64(K.SEEDS[1])) >> K.U64(32)).astype(np.uint32) | np.uint32(1)


def sketches(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One bit of each of ``BITS`` minima of every line, from its shingles; a row of 64-bit words a line."""
    out, low = [np.zeros((0, BITS // 64), K.U64)], (h >> K.U64(32)).astype(np.uint32)
    for i, j in _slices(at[:-1], at[1:], 1 << 15):
        x, begin = low[at[i] : at[j]], at[i:j] - at[i]
        minima = np.stack([np.minimum.reduceat(x * m, begin) for m in _FACTORS], axis=1)
        out.append(np.packbits((minima * np.uint32(0x9E3779B1)) >> np.uint32(31) != 0, axis=1).view(K.U64))
    return np.concatenate(out)


def _node_rows(batches):
    """Each line of a part once; the part comes ordered by id."""
    last, nth = None, 0
    for b in K.chunks(batches, "line"):
        ids = _ids(K.column(b, "id").to_pylist())
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]).any(axis=1)
        new[0] = last is None or bool((ids[0] != last).any())
        last = ids[-1]
        b = b.filter(pa.array(new))
        if b.num_rows:
            h, at = sets(K.column(b, "line"))
            bits = {s: pa.array(x.view(np.int64)) for s, x in zip(_SKETCH, np.ascontiguousarray(sketches(h, at).T), strict=True)}
            order = pa.array(np.arange(nth, nth + b.num_rows, dtype=np.int32))
            nth += b.num_rows
            size = pa.array(np.diff(at).astype(np.int32))
            yield pa.RecordBatch.from_pydict({"part": K.column(b, "part"), "nth": order, "id": K.column(b, "id"), "n": size} | bits | {"line": K.column(b, "line")})


_TOKENS = "part int, source int, steps binary, tokens binary"
_ALONE = "part int, nths binary, counts binary"
_ABLE = "id binary, node long, n int, " + ", ".join(f"{s} long" for s in _SKETCH) + ", left int"


def _token_blocks(n_parts: int):
    def sent(source, tokens, nths):
        tokens, nths = np.concatenate(tokens), np.concatenate(nths)
        for k, some in _ranges(tokens, n_parts):
            steps = np.diff(nths[some], prepend=0).astype(np.uint32)
            low = (tokens[some] & K.U64(0xFFFFFFFF)).astype(np.uint32)
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "source": pa.array([source], pa.int32()), "steps": K.binary([K.pack(steps)]), "tokens": K.binary([K.pack(low)])})

    def run(batches):
        source, tokens, nths, held = None, [], [], 0
        for b in K.chunks(batches, "line"):
            source = K.column(b, "part")[0].as_py()
            h, at = sets(K.column(b, "line"))
            tokens.append(h)
            nths.append(np.repeat(K.column(b, "nth").to_numpy().astype(np.int64), np.diff(at)))
            held += len(h)
            if held >= FLUSH_TOKENS:
                yield from sent(source, tokens, nths)
                tokens, nths, held = [], [], 0
        if held:
            yield from sent(source, tokens, nths)

    return run


def _alone(batches):
    """Of a hash range: how many of its shingles only this line has, by line. Shingles that
    32 bits confuse count as those of several lines, so the bound stays one."""
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return
    size = [len(r["tokens"]) // 4 for r in rows]
    tokens = np.frombuffer(b"".join([r.pop("tokens") for r in rows]), np.uint32)
    order = np.argsort(tokens, kind="stable")
    s = tokens[order]
    same = s[1:] == s[:-1]
    own = np.zeros(len(s), bool)
    own[order] = ~(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    at = 0
    for r, k in zip(rows, size, strict=True):
        nths, counts = np.unique(np.cumsum(np.frombuffer(r["steps"], np.uint32).astype(np.int64))[own[at : at + k]], return_counts=True)
        at += k
        if len(nths):
            yield pa.RecordBatch.from_pydict({"part": pa.array([r["source"]], pa.int32()), "nths": K.binary([K.pack(nths.astype(np.uint32))]), "counts": K.binary([K.pack(counts.astype(np.uint32))])})


def _able(batches):
    """The lines of a part that can link with any, with what others can have of their shingles (left)."""
    kept, told = [], []
    for b in batches:
        nodes = b.filter(K.column(b, "id").is_valid())
        if nodes.num_rows:
            kept.append(nodes.select(["part", "nth", "id", "n", *_SKETCH]))
        told += b.filter(K.column(b, "id").is_null()).select(["nths", "counts"]).to_pylist()
    if not kept:
        return
    t = pa.Table.from_batches(kept)
    nth = t["nth"].to_numpy()
    own = np.zeros(int(nth.max()) + 1, np.int64)
    for r in told:
        own[np.frombuffer(r["nths"], np.uint32)] += np.frombuffer(r["counts"], np.uint32)
    n = t["n"].to_numpy().astype(np.int64)
    node = t["part"].to_numpy().astype(np.int64) << 32 | nth
    t = t.append_column("node", pa.array(node)).append_column("left", pa.array((n - own[nth]).astype(np.int32)))
    t = t.select(["id", "node", "n", *_SKETCH, "left"])
    yield from t.filter(pa.array(DEN * (n - own[nth]) >= NUM * n)).to_batches(10_000)


# -- 3 and 4: pairs --------------------------------------------------------------------------

def _node(part: str = "part", nth: str = "nth"):
    """A line's number: its part and its place there, as the checkpoint of the lines has them."""
    return F.shiftleft(F.col(part).cast("long"), 32) + F.col(nth)


def _part(node: str):
    return F.shiftright(node, 32).cast("int")


def _verify(batches):
    """Pairs of a part (a in the part, b sent to it) that are similar enough."""
    texts, pairs = {}, []
    K.release()
    for b in batches:
        for node, other, line in zip(*(K.column(b, c).to_pylist() for c in ("node", "other", "line")), strict=True):
            if other is None:
                texts[node] = line
            else:
                pairs.append((node, other))
    pairs.sort()
    for i in range(0, len(pairs), TESTED):
        some = pairs[i : i + TESTED]
        lines = {x: texts[x] for pair in some for x in pair}
        h, at = sets(pa.array(lines.values(), pa.large_string()))
        of = {node: h[x:y] for node, x, y in zip(lines, at[:-1].tolist(), at[1:].tolist(), strict=True)}
        found = []
        for a, b in some:
            low, high = (of[a], of[b]) if len(of[a]) < len(of[b]) else (of[b], of[a])
            both = np.count_nonzero(high[np.minimum(high.searchsorted(low), len(high) - 1)] == low)
            if (DEN + NUM) * both >= NUM * (len(low) + len(high)):
                found.append((a, b))
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _links(nodes: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """Links among the candidate pairs of nodes; b's text goes to a's part."""
    text = nodes.select(_node().alias("node"), "line")
    none = F.lit(None).cast("long").alias("other")
    needed = pairs.select(F.col("a").alias("node"), _part("a").alias("part")).union(pairs.select(F.col("b").alias("node"), _part("a").alias("part")))
    texts = needed.distinct().join(text, "node").select("part", "node", none, "line")
    pairs = pairs.select(_part("a").alias("part"), F.col("a").alias("node"), F.col("b").alias("other"), F.lit(None).cast("string").alias("line"))
    return texts.union(pairs).repartitionById(n, F.col("part")).mapInArrow(_verify, "a long, b long")


def _may(x: str, y: str):
    """Whether two lines can link, by their sizes, what others can have of them, and their sketches."""
    apart = " + ".join(f"bit_count({x}{s} ^ {y}{s})" for s in _SKETCH)
    return F.expr(f"{DEN + NUM} * least({x}left, {y}left) >= {NUM} * ({x}n + {y}n) and {apart} <= {FAR}")


def _open(posts: DataFrame, joined: DataFrame) -> DataFrame:
    """Posts with roots, of the keys whose lines are in several components."""
    rooted = cut(posts.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")))
    several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return cut(rooted.join(several, "key", "left_semi"))


def _untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    again = tested.select("a", "b").union(tested.select("b", "a"))
    return pairs.distinct().join(again, ["a", "b"], "left_anti")


def line_classes(docs: DataFrame) -> DataFrame:
    """id and root of every line that links with a different line."""
    spark, n = docs.sparkSession, parts(docs.sparkSession)
    blocks = docs.mapInArrow(_key_blocks(n), "part int, keys binary, ids binary")
    posts = cut(blocks.repartitionById(n, F.col("part")).mapInArrow(_shared, "key long, id binary"))
    texts = docs.mapInArrow(_text_rows, "id binary, line string").join(posts.select("id").distinct(), "id", "left_semi")
    texts = texts.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    # partition i of the checkpoint is part i
    nodes = cut(texts.repartitionById(n, F.col("part")).sortWithinPartitions("id").mapInArrow(_node_rows, _NODE))
    told = nodes.mapInArrow(_token_blocks(n), _TOKENS).repartitionById(n, F.col("part")).mapInArrow(_alone, _ALONE)
    both = nodes.drop("line").unionByName(told, allowMissingColumns=True)
    able = both.repartitionById(n, F.col("part")).mapInArrow(_able, _ABLE)
    posts = cut(posts.join(able, "id").drop("id"))

    joined, links = spark.createDataFrame([], "node long, root long"), spark.createDataFrame([], "a long, b long")
    tested = links
    for _ in range(HUB_ROUNDS):
        open_ = _open(posts, joined)
        used = tested.select(F.col("b").alias("node")).distinct()
        rank = Window.partitionBy("key").orderBy(F.expr("round(left / n, 6)").desc(), "node")
        hubs = open_.join(used, "node", "left_anti").withColumn("nth", F.row_number().over(rank)).where(F.col("nth") <= HUBS)
        hubs = hubs.select("key", F.struct("node", "n", "left", "root", *_SKETCH).alias("h"))
        met = open_.join(hubs, "key").where("root <> h.root").where(_may("", "h."))
        pairs = cut(_untested(met.select(F.col("node").alias("a"), F.col("h.node").alias("b")), tested))
        links, tested = cut(links.union(_links(nodes, pairs, n))), tested.union(pairs)
        joined = cut(components(links))
    size = joined.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    open_ = cut(_open(posts, joined).join(size, "root", "left").withColumn("size", F.coalesce("size", F.lit(1))))
    x, y = open_.alias("x"), open_.alias("y")
    bigger = "x.key = y.key and x.root <> y.root and (x.size > y.size or x.size = y.size and x.node < y.node)"
    rest = x.join(y, F.expr(bigger) & _may("x.", "y."))
    rest = cut(_untested(rest.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), tested))
    classes = components(links.union(_links(nodes, rest, n)))
    return nodes.select(_node().alias("node"), "id").join(classes, "node").select("id", "root")


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed and the kept text of each document."""
    docs = docs_only(docs)
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "pos")
    places = docs.mapInArrow(_place_rows, "doc_id long, pos int, id binary").select("id", place.alias("place"))
    classes = cut(line_classes(docs))
    # each exact line's first place and number of places, then each class's first place
    first = places.groupBy("id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).join(classes, "id", "left")
    best = first.where("root is not null").groupBy("root").agg(F.min("first").alias("best"))
    first = first.where("n > 1 or root is not null").join(best, "root", "left").select("id", F.coalesce("best", "first").alias("stays"))
    gone = places.join(first, "id").where("place <> stays").groupBy("place.doc_id").agg(F.collect_set("place.pos").alias("gone"))
    out = docs.join(gone.select(F.col("doc_id").alias("_d"), "gone"), F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    split = F.split("text", "\n", -1)
    worded = F.coalesce(F.size(F.filter(split, lambda x: x.rlike(_WORDED))), F.lit(0))
    kept = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(gone, i)), "\n")
    return out.select(
        "doc_id", F.greatest(worded, F.lit(0)).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"),
        F.when(F.size(gone) > 0, kept).otherwise(F.col("text")).alias("text"),
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
