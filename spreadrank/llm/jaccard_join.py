"""N-gram Jaccard join under several global token orders.

A document's set is its distinct ``SHINGLE``-word shingles; documents of the
same set are one node. Two nodes link when 100 * |x & y| >= 85 * |x | y|.

Prefix filtering: under any one order of all tokens, linked nodes share a token
among the first n - ceil(0.85 n) + 1 of each. The first order goes by the number
of nodes that have a token, the second by that number's power of two and the
third by its power of four; within these, each goes by a hash of its own, so a
token's place differs widely between them. A pair is verified only if it shares
prefix tokens under all three.

1. Tokens of one node come first in each order. A node with more of them than
   its prefix has places shares no prefix token with anyone, under any order.
   A third of the tokens (by hash) is enough to show that for most nodes; the
   rest stay in. This is a necessary condition, so nothing is lost.
2. Of the nodes left, every token's exact number of nodes is counted. The hub
   of a prefix token is its node with the least share of tokens of its own. Node
   against hub are the first candidates: one for each node and hub, however many
   share a token; ``HUB_ROUNDS`` rounds of hubs join most of a large group.
3. Nodes already joined need no further test. Pairs of different components
   that still share a prefix token are generated by a join on the token. At the
   first common token the places before it in either prefix are not common, so
   sizes and places bound the similarity; the bound is a condition of the join,
   and postings that it rules out for every partner's size leave before it.
4. Candidates pass the other two orders, then exact verification; components
   come from distributed union-find.

Token counts travel in packed blocks, one for each task and hash range, each
token once a task, so that very common passages do not gather anywhere. Node
sets are sent once to each part of the nodes that asks for them.

Nulls: a null text has an empty set; empty sets link with nothing. A null
doc_id has no links and a null component. Tasks name their batches by partition
and order, so docs must come out alike when a task runs again: read them from
files, as the queries do, or checkpoint them first. Repeated rows are one node; rows of
one doc_id with different texts are different nodes. Sets are told apart by 128
bits of hash, tokens by 64, nodes on their way by their part and 63 bits. Long
texts are taken whole; ties between hubs go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .frames import cut, docs_only, parts, table

SHINGLE, NUM, DEN = 4, 85, 100
SAMPLE = 3
FLUSH = 600_000
HUB_ROUNDS = 1
_SALTS = [K.U64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)]


def shingle_sets(w: K.Words, m: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all documents of a chunk, sorted in each, and the bounds of each."""
    s, h = w.windows(m)
    doc = w.doc[s]
    short = np.flatnonzero((w.counts > 0) & (w.counts < m))
    if len(short):
        h = np.concatenate([h, K.mix(K.sequence_hash(w.hash, w.bounds[short], w.bounds[short + 1]))])
        doc = np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    if len(h):
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(w.counts) + 1))


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, K.U64)
    np.cumsum(x, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def node_names(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128-bit names of sets: two sums of differently mixed tokens."""
    n = np.diff(at).astype(K.U64)
    return np.column_stack([K.mix(_sums(K.mix(h ^ s), at) + n) for s in _SALTS[:2]])


def _names(a: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(a), [None, pa.py_buffer(K.pack(a))]).cast(pa.binary())


def _sets(b: pa.RecordBatch):
    h, at = shingle_sets(K.words_of(K.column(b, "text"), lower=True))
    return h, at, node_names(h, at)


def _blobs(values: np.ndarray, at: np.ndarray) -> pa.Array:
    raw = K.pack(values)
    size = values.dtype.itemsize
    offsets = pa.py_buffer(K.pack((at * size).astype(np.int64)))
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, offsets, pa.py_buffer(raw)]).cast(pa.binary())


def _ranges(at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Indices of the ranges at[i]:at[i+1] of the chosen i, one after the other."""
    n = at[own + 1] - at[own]
    return np.repeat(at[own] - np.cumsum(n) + n, n) + np.arange(n.sum())


def most_own(n):
    """How many tokens of its own a node of n tokens may have and still link."""
    return n - -(-n * NUM // DEN)


def _named(batches):
    for b in K.chunks(batches):
        h, at, names = _sets(b)
        yield pa.RecordBatch.from_pydict({"doc_id": K.column(b, "doc_id"), "text_hash": K.column(b, "text_hash"), "node": _names(names), "n": pa.array(np.diff(at).astype(np.int64))})


# -- 1: tokens of one node, on a sample of the tokens ----------------------------------------

_BLOCK = "part int, batch long, tokens binary, counts binary, common binary, names binary"


def _block(part: int, batch: int, **own) -> dict:
    return {"part": part, "batch": batch} | {k: own.get(k) for k in ("tokens", "counts", "common", "names")}


def _blocks(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"part": pa.int32(), "batch": pa.int64()} | dict.fromkeys(("tokens", "counts", "common", "names"), pa.binary())
    return pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in kinds.items()})


def _sample_blocks(n_parts: int):
    def flush(held, batch):
        h = np.concatenate([x[0] for x in held])
        n = np.concatenate([np.diff(x[1]) for x in held])
        names = np.concatenate([x[2] for x in held])
        _, first = np.unique(names.view([("a", K.U64), ("b", K.U64)]).ravel(), return_index=True)
        first = first[n[first] > 0]
        at = np.concatenate([[0], np.cumsum(n)])
        h, doc = h[_ranges(at, first)], np.repeat(np.arange(len(first)), n[first])
        names, n = names[first], n[first]
        on = K.mix(h ^ _SALTS[2]) % K.U64(SAMPLE) == 0
        h, doc = h[on], doc[on]
        order = np.argsort(h, kind="stable")
        hs = h[order]
        head = np.ones(len(hs), bool)
        head[1:] = hs[1:] != hs[:-1]
        size = np.diff(np.append(np.flatnonzero(head), len(hs)))
        common = hs[head][size > 1]
        alone = np.sort(order[np.repeat(size == 1, size)])  # in document order
        h, doc = h[alone], doc[alone]
        part, part_c = (K.mix(h) % K.U64(n_parts)).astype(np.int64), (K.mix(common) % K.U64(n_parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(n_parts + 1))
        rows = []
        for k in range(n_parts):
            own, c = order[cuts[k] : cuts[k + 1]], common[part_c == k]
            if len(own) or len(c):
                rows.append(_block(k, batch, tokens=K.pack(h[own]), counts=K.pack(np.bincount(doc[own], minlength=len(n)).astype(np.uint32)), common=K.pack(c)))
        rows.append(_block(batch % n_parts, batch, names=K.pack(names), counts=K.pack(n.astype(np.uint32))))
        for i in range(0, len(rows), 64):
            yield _blocks(rows[i : i + 64])

    def run(batches):
        held, total, batch = [], 0, TaskContext.get().partitionId() << 20
        for b in K.chunks(batches):
            held.append(_sets(b))
            total += len(held[-1][0])
            if total >= FLUSH * SAMPLE:
                yield from flush(held, batch)
                held, total, batch = [], 0, batch + 1
        if held:
            yield from flush(held, batch)

    return run


def _alone(n_parts: int):
    """Of a hash range: for each batch, how many tokens of each of its nodes no other node has."""

    def run(batches):
        rows = []
        for b in batches:
            named = b.filter(K.column(b, "names").is_valid())
            if named.num_rows:
                yield named
            rows += b.filter(K.column(b, "names").is_null()).to_pylist()
        tokens = [np.frombuffer(r["tokens"], K.U64) for r in rows]
        common = np.unique(np.concatenate([np.zeros(0, K.U64), *[np.frombuffer(r["common"], K.U64) for r in rows]]))
        every = np.sort(np.concatenate([np.zeros(0, K.U64), *tokens]))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        shared = np.union1d(twice, common)
        del every
        for r, t in zip(rows, tokens, strict=True):
            counts = np.frombuffer(r["counts"], np.uint32)
            own = ~np.isin(t, shared)
            left = np.bincount(np.repeat(np.arange(len(counts)), counts)[own], minlength=len(counts))
            yield _blocks([_block(r["batch"] % n_parts, r["batch"], counts=K.pack(left.astype(np.uint32)))])

    return run


def _may_link(batches):
    """Nodes of a batch whose sampled tokens do not rule out a link."""
    names, sizes, alone = {}, {}, {}
    for b in batches:
        for r in b.to_pylist():
            c = np.frombuffer(r["counts"], np.uint32).astype(np.int64)
            if r["names"] is not None:
                names[r["batch"]], sizes[r["batch"]] = np.frombuffer(r["names"], K.U64).reshape(-1, 2), c
            else:
                alone[r["batch"]] = alone.get(r["batch"], 0) + c
    for k, n in sizes.items():
        own = alone.get(k, np.zeros(len(n), np.int64))
        ok = own <= most_own(n)
        yield pa.RecordBatch.from_pydict({"node": _names(names[k][ok])})


# -- 2: token counts and hubs of the nodes left ----------------------------------------------

_NODE = "part int, id long, node binary, n long, tokens binary"


def _node_rows(n_parts: int):
    def run(batches):
        for b in K.chunks(batches):
            h, at, names = _sets(b)
            want = np.frombuffer(b"".join(K.column(b, "node").to_pylist()), K.U64).reshape(-1, 2)
            own = np.flatnonzero((names == want).all(axis=1))
            if not len(own):
                continue
            at2 = np.concatenate([[0], np.cumsum(at[own + 1] - at[own])])
            part = (names[own, 0] % K.U64(n_parts)).astype(np.int32)
            id_ = (names[own, 1] >> K.U64(1)).astype(np.int64)
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array(part), "id": pa.array(id_), "node": _names(names[own]), "n": pa.array(np.diff(at2)), "tokens": _blobs(h[_ranges(at, own)], at2)}
            )

    return run


class _Part:
    """All nodes of a part."""

    def __init__(self, rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows).combine_chunks()
        id_, n = t["id"].to_numpy(), t["n"].to_numpy()
        names = np.frombuffer(b"".join(t["node"].to_pylist()), K.U64).reshape(-1, 2)
        tokens = np.frombuffer(b"".join(t["tokens"].to_pylist()), K.U64)
        _, first = np.unique(names.view([("a", K.U64), ("b", K.U64)]).ravel(), return_index=True)
        at = np.concatenate([[0], np.cumsum(n)])
        self.tokens, self.id, self.names, self.n = tokens[_ranges(at, first)], id_[first], names[first], n[first]
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.doc = np.repeat(np.arange(len(self.n)), self.n)

    def distinct(self):
        """Distinct tokens in order, the number of nodes of each, and the place of every token among them."""
        t, place, count = np.unique(self.tokens, return_inverse=True, return_counts=True)
        return t, count, place


_COUNT = "part int, source int, tokens binary, counts binary"


def _count_rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"part": pa.int32(), "source": pa.int32(), "tokens": pa.binary(), "counts": pa.binary()}
    return pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in kinds.items()})


def _split(tokens: np.ndarray, n_parts: int) -> list[np.ndarray]:
    part = (K.mix(tokens) % K.U64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(n_parts + 1))
    return [order[cuts[k] : cuts[k + 1]] for k in range(n_parts)]


def _ask(n_parts: int):
    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        source = K.column(rows[0], "part")[0].as_py()
        t, count, _ = _Part(rows).distinct()
        for k, own in enumerate(_split(t, n_parts)):
            if len(own):
                yield _count_rows([{"part": k, "source": source, "tokens": K.pack(t[own]), "counts": K.pack(count[own].astype(np.uint32))}])

    return run


def _answer(batches):
    """Of a hash range: the number of nodes of each token, in the order asked."""
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return
    tokens = np.concatenate([np.frombuffer(r["tokens"], K.U64) for r in rows])
    counts = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows])
    _, place = np.unique(tokens, return_inverse=True)
    df = np.bincount(place, weights=counts).astype(np.uint32)[place]
    own_part, at = rows[0]["part"], 0
    for r in rows:
        n = len(r["tokens"]) // 8
        yield _count_rows([{"part": r["source"], "source": own_part, "tokens": None, "counts": K.pack(df[at : at + n])}])
        at += n


_WORK = "part int, id long, node binary, n long, own long, tokens binary, first array<long>, second binary, third binary"


def _prefixes(n_parts: int):
    """Nodes that may still link and their prefixes under each order."""

    def run(batches):
        nodes, told = [], {}
        for b in batches:
            sets = b.filter(K.column(b, "node").is_valid())
            if sets.num_rows:
                nodes.append(sets)
            for r in b.filter(K.column(b, "node").is_null()).select(["source", "counts"]).to_pylist():
                told[r["source"]] = np.frombuffer(r["counts"], np.uint32)
        if not nodes:
            return
        part = K.column(nodes[0], "part")[0].as_py()
        p = _Part(nodes)
        t, _, place = p.distinct()
        df = np.empty(len(t), np.int64)
        for k, own in enumerate(_split(t, n_parts)):
            if len(own):
                df[own] = told[k]
        df = df[place]
        own = np.bincount(p.doc[df == 1], minlength=len(p.n))
        left = most_own(p.n) + 1 - own  # places of the prefix for shared tokens
        keep = np.flatnonzero(left > 0)
        fronts = []
        power = np.frexp(df)[1]  # 1 for a token of one node, 2 for two or three, and so on
        for salt, rank in zip(_SALTS, (df, power, np.where(df > 1, power // 2, 0)), strict=True):
            order = np.lexsort((K.mix(p.tokens ^ salt), rank, p.doc))
            order = order[df[order] > 1]
            doc = p.doc[order]
            at = np.searchsorted(doc, np.arange(len(p.n) + 1))
            nth = np.arange(len(order)) - at[doc]
            front = order[nth < left[doc]]
            fronts.append((front, np.searchsorted(p.doc[front], np.arange(len(p.n) + 1))))
        f1, at1 = fronts[0]
        for i in range(0, len(keep), 2000):
            some = keep[i : i + 2000]
            cols = {"part": pa.array(np.full(len(some), part, np.int32)), "id": pa.array(p.id[some]), "node": _names(p.names[some]), "n": pa.array(p.n[some]), "own": pa.array(own[some])}
            cols["tokens"] = _blobs(p.tokens[_ranges(p.at, some)], np.concatenate([[0], np.cumsum(p.n[some])]))
            cols["first"] = pa.array([p.tokens[f1[at1[d] : at1[d + 1]]].view(np.int64) for d in some], pa.list_(pa.int64()))
            for name, (f, at) in zip(("second", "third"), fronts[1:], strict=True):
                cols[name] = _blobs(p.tokens[f[_ranges(at, some)]], np.concatenate([[0], np.cumsum(at[some + 1] - at[some])]))
            yield pa.RecordBatch.from_pydict(cols)

    return run


# -- 4: verification -------------------------------------------------------------------------


def _verify(batches):
    """Pairs of a part (a in the part, b sent to it) that pass the filters and the exact test."""
    here, sent, pairs = {}, {}, []
    for b in batches:
        for r in b.to_pylist():
            if r["kind"] == 2:
                pairs.append((r["id"], (r["b_part"], r["b"])))
            else:
                (here if r["kind"] == 0 else sent)[r["id"] if r["kind"] == 0 else (r["b_part"], r["id"])] = [r["node"], *(np.frombuffer(r[k], K.U64) for k in ("tokens", "second", "third"))]
    found = []
    for a, b in pairs:
        x, y = here[a], sent[b]
        if not (np.isin(x[2], y[2], assume_unique=True).any() and np.isin(x[3], y[3], assume_unique=True).any()):
            continue
        low, high = (x[1], y[1]) if len(x[1]) < len(y[1]) else (y[1], x[1])
        at = np.minimum(np.searchsorted(high, low), len(high) - 1)
        both = int((high[at] == low).sum())
        if DEN * both >= NUM * (len(low) + len(high) - both):
            found.append((x[0], y[0]))
    yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})


_PAIR = ["part", "a", "b_part", "b"]


def _links(work: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """Links among the candidate pairs (part and id of a, part and id of b)."""
    none = F.lit(None)
    sets = ("node", "tokens", "second", "third")
    own = work.join(pairs.select("part", F.col("a").alias("id")).distinct(), ["part", "id"], "left_semi")
    own = own.select("part", F.lit(0).alias("kind"), "id", none.cast("int").alias("b_part"), none.cast("long").alias("b"), *sets)
    asked = pairs.select("part", "b_part", F.col("b").alias("id")).distinct().join(work.withColumnRenamed("part", "b_part"), ["b_part", "id"])
    asked = asked.select("part", F.lit(1).alias("kind"), "id", "b_part", none.cast("long").alias("b"), *sets)
    pairs = pairs.select("part", F.lit(2).alias("kind"), F.col("a").alias("id"), "b_part", "b", *[none.cast("binary").alias(k) for k in sets])
    return own.union(asked).union(pairs).repartitionById(n, F.col("part")).mapInArrow(_verify, "a binary, b binary")


def _rooted(posts: DataFrame, joined: DataFrame) -> DataFrame:
    return posts.join(joined, "node", "left").select("part", "id", "n", "own", "left", "token", F.coalesce("root", "node").alias("root"))


def _may(n: str, left: str, m: str, other: str):
    """Whether a pair can link whose first common token has so many tokens from there on, itself included."""
    most = f"least({left}, {other})"
    return F.expr(f"{DEN} * {most} >= {NUM} * ({n} + {m} - {most})")


def _untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    """Pairs that were not tested, either way round."""
    again = tested.select(*_PAIR).union(tested.select("b_part", "b", "part", "a"))
    return pairs.join(again, _PAIR, "left_anti").select(*_PAIR)


def _reachable(posts: DataFrame) -> DataFrame:
    """Postings that some partner's size allows to link.

    At the first common token of a pair at most ``left`` tokens of x, from that
    place on, are common. With the least size of a partner in the posting (sizes
    in classes of a twentieth, so a posting has few of them) that bounds the
    similarity from above.
    """
    step = 1.05
    low = posts.groupBy("token", F.floor(F.log("n") / math.log(step)).alias("c")).agg(F.min("n").alias("m"))
    low = low.groupBy("token").agg(F.collect_list("m").alias("mins"))
    least = F.expr(f"array_min(transform(filter(mins, m -> m * {step} + 1 >= {NUM / DEN} * n), m -> greatest(m, floor({NUM / DEN} * n))))")
    return posts.join(low, "token").where((DEN + NUM) * F.col("left") >= NUM * (F.col("n") + least)).drop("mins")


def _open(posts: DataFrame) -> DataFrame:
    """Postings of tokens that nodes of several components have."""
    posts = cut(posts)
    open_ = posts.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    return cut(posts.join(open_, "token", "left_semi"))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and n_verified (links of the document's set that were tested) of each document."""
    spark, n = docs.sparkSession, parts(docs.sparkSession)
    docs = docs_only(docs)
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    named = cut(hashed.mapInArrow(_named, "doc_id long, text_hash long, node binary, n long"))
    known = docs.where("doc_id is not null")
    blocks = known.mapInArrow(_sample_blocks(n), _BLOCK).repartitionById(n, F.col("part"))
    left = blocks.mapInArrow(_alone(n), _BLOCK).repartitionById(n, F.col("part")).mapInArrow(_may_link, "node binary")
    reps = named.where("doc_id is not null and n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(left.distinct(), "node")
    nodes = known.hint("merge").join(reps, "doc_id").select("text", "node").mapInArrow(_node_rows(n), _NODE)
    nodes = cut(nodes.repartitionById(n, F.col("part")))  # partition i of the checkpoint is part i
    told = nodes.mapInArrow(_ask(n), _COUNT).repartitionById(n, F.col("part")).mapInArrow(_answer, _COUNT)
    both = nodes.withColumns({k: F.lit(None).cast(t) for k, t in (("source", "int"), ("counts", "binary"))}).unionByName(told.drop("tokens"), allowMissingColumns=True)
    work = cut(both.repartitionById(n, F.col("part")).mapInArrow(_prefixes(n), _WORK))

    light = work.select("part", "id", "n", "own", "node", F.posexplode("first").alias("nth", "token")).withColumn("left", F.expr("n - own - nth"))
    tested = spark.createDataFrame([], "part int, a long, b_part int, b long")
    links, joined, used = None, spark.createDataFrame([], "node binary, root binary"), tested.select(F.col("b_part").alias("part"), F.col("b").alias("id"))
    for k in range(HUB_ROUNDS):
        posts = _rooted(light, joined)
        posts = _open(_reachable(posts)) if k else posts
        best = F.min(F.struct(F.round(F.col("own") / F.col("n"), 6).alias("share"), "id", "part", "n", "left", "root")).alias("h")
        hubs = posts.join(used, ["part", "id"], "left_anti").groupBy("token").agg(best)
        met = posts.join(hubs, "token").where("root <> h.root").where(_may("n", "left", "h.n", "h.left"))
        pairs = cut(_untested(met.select("part", F.col("id").alias("a"), F.col("h.part").alias("b_part"), F.col("h.id").alias("b")).distinct(), tested))
        found = cut(_links(work, pairs, n))
        links = found if links is None else links.union(found)
        tested, used = tested.union(pairs), used.union(pairs.select("b_part", "b")).distinct()
        joined = components(links)
    # what still shares a first-order prefix token across components and passes the positional filter
    posts = _open(_reachable(_rooted(light, joined)))
    x, y = posts.alias("x"), posts.alias("y")
    rest = x.join(y, F.expr("x.token = y.token and (x.id < y.id or x.id = y.id and x.part < y.part) and x.root <> y.root") & _may("x.n", "x.left", "y.n", "y.left"))
    rest = _untested(rest.select(F.col("x.part").alias("part"), F.col("x.id").alias("a"), F.col("y.part").alias("b_part"), F.col("y.id").alias("b")).distinct(), tested)
    more = cut(_links(work, rest, n))
    every = links.union(more)
    roots = components(every)
    degree = every.union(every.select("b", "a")).distinct().groupBy("a").agg(F.count(F.lit(1)).alias("n_verified"))
    classes = roots.join(degree, roots["node"] == degree["a"], "left").select("node", "root", "n_verified")
    rows = named.join(classes, "node", "left").withColumn("root", F.when(F.col("doc_id").isNull() | (F.col("n") == 0), None).otherwise(F.coalesce("root", "node")))
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root", "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_verified", F.lit(0)).alias("n_verified")
    )


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Carried() documents without those that link with an earlier one: of each component, the row of its
    smallest doc_id (of its smallest text hash, once, if several rows have that). Rows of null doc_id stay."""
    found = jaccard_join(docs).where("doc_id = component_id").groupBy("doc_id").agg(F.min("text_hash").alias("_h"))
    rows = docs.withColumn("_h", F.xxhash64("text"))
    kept = rows.where("doc_id is not null").hint("merge").join(found, ["doc_id", "_h"])
    nth = F.row_number().over(Window.partitionBy("doc_id", "_h").orderBy("doc_id"))
    kept = kept.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    return kept.unionByName(rows.where("doc_id is null")).drop("_h")
