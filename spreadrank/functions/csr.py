"""Adjacency in compressed rows, and vectorised traversal kernels on it.

Used where a graph's adjacency has a checked size: it is broadcast once and
sources are spread over tasks. Larger graphs take the join path of each operator.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Directed edges up to which adjacency is broadcast (16 bytes each in the driver and executors).
BROADCAST_EDGES = 20_000_000


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct integers; np.unique goes through a hash table, which takes far longer."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class CSR:
    def __init__(self, u: np.ndarray, v: np.ndarray, nodes: np.ndarray | None = None):
        self.ids = np.unique(u) if nodes is None else np.unique(nodes)
        self.n = len(self.ids)
        a, b = np.searchsorted(self.ids, u), np.searchsorted(self.ids, v)
        order = np.lexsort((b, a))
        self.tail = b[order].astype(np.int32)
        self.k = np.bincount(a, minlength=self.n)
        self.at = np.concatenate([[0], np.cumsum(self.k)])

    @classmethod
    def of_rows(cls, ids: np.ndarray, k: np.ndarray, tail: np.ndarray) -> CSR:
        """From sorted rows: k positions in tail for each of the ids."""
        made = cls.__new__(cls)
        made.__setstate__((ids, k, tail))
        return made

    def __getstate__(self):
        return self.ids, self.k.astype(np.int32), self.tail

    def __setstate__(self, state):
        self.ids, k, self.tail = state
        self.n, self.k = len(self.ids), k.astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.k)])

    @property
    def head(self) -> np.ndarray:
        if not hasattr(self, "_head"):
            self._head = np.repeat(np.arange(self.n, dtype=np.int32), self.k)
        return self._head

    @property
    def wide(self) -> np.ndarray:
        """tail as it is taken fastest."""
        if not hasattr(self, "_wide"):
            self._wide = self.tail.astype(np.int64)
        return self._wide

    def index(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)

    def edges_of(self, front: np.ndarray) -> np.ndarray:
        """Positions in head and tail of all edges out of the front."""
        n = self.k[front]
        return np.repeat(self.at[front] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def spread(self, bits: np.ndarray) -> np.ndarray:
        """For each node, the OR of the bits of its neighbours."""
        out = np.zeros(self.n, np.uint64)
        has = self.k > 0
        if has.any():
            out[has] = np.bitwise_or.reduceat(bits.take(self.wide), self.at[:-1][has])
        return out

    def distances(self, sources: np.ndarray, depth: int = 1 << 30):
        """Breadth-first search from up to 64 sources at once, one bit each: yields (distance, bits reached there)."""
        seen = np.zeros(self.n, np.uint64)
        np.bitwise_or.at(seen, sources, np.uint64(1) << np.arange(len(sources), dtype=np.uint64))
        front, d = seen.copy(), 0
        while d < depth:
            front = self.spread(front) & ~seen
            if not front.any():
                return
            seen |= front
            d += 1
            yield d, front

    def sums(self, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes reached (without the source) and the sum of distances, for each source."""
        count, total = np.zeros(len(sources), np.int64), np.zeros(len(sources), np.int64)
        for i in range(0, len(sources), 64):
            some = sources[i : i + 64]
            for d, front in self.distances(some):
                bits = np.unpackbits(front.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : len(some)].sum(axis=0, dtype=np.int64)
                count[i : i + len(some)] += bits
                total[i : i + len(some)] += d * bits
        return count, total

    def induced(self, nodes: np.ndarray) -> CSR:
        """The subgraph of some (sorted) nodes, with their positions here as ids."""
        e = self.edges_of(nodes)
        inside = np.isin(self.tail[e], nodes)
        return CSR(self.head[e][inside], self.tail[e][inside], nodes)

    def labels(self) -> np.ndarray:
        """For each node the first position of its component."""
        label, has = np.arange(self.n), self.k > 0
        while has.any():
            low = label.copy()
            low[has] = np.minimum(low[has], np.minimum.reduceat(label[self.tail], self.at[:-1][has]))
            low = low[low]
            if (low == label).all():
                break
            label = low
        return label

    def component_of_most(self) -> np.ndarray:
        """Positions of the largest component; of equal ones that with the smallest node."""
        label = self.labels()
        size = np.bincount(label, minlength=self.n)
        return np.flatnonzero(label == size.argmax()) if self.n else np.zeros(0, np.int64)

    def path_length(self) -> float:
        """Mean distance over ordered pairs of the largest component; 0 if that has less than 2 nodes."""
        own = self.component_of_most()
        if len(own) < 2:
            return 0.0
        return float(self.sums(own)[1].sum() / (len(own) * (len(own) - 1)))

    def balls(self, centers: np.ndarray, depth: int) -> np.ndarray:
        """Sorted keys place * n + node of all nodes within depth of the center at each place."""
        keys = np.arange(len(centers)) * self.n + centers
        for _ in range(depth):
            place, node = np.divmod(keys, self.n)
            keys = distinct(np.concatenate([keys, np.repeat(place * self.n, self.k[node]) + self.tail[self.edges_of(node)]]))
        return keys

    def side_by_side(self, keys: np.ndarray) -> CSR:
        """The subgraphs of the nodes at each place as one graph, whose ids are the (sorted) keys."""
        place, node = np.divmod(keys, self.n)
        head = np.repeat(np.arange(len(keys)), self.k[node])
        key = (place * self.n)[head] + self.tail[self.edges_of(node)]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        inside = keys[at] == key
        return CSR.of_rows(keys, np.bincount(head[inside], minlength=len(keys)), at[inside].astype(np.int32))

    def kept(self, keep: np.ndarray) -> CSR:
        """The subgraph of the nodes of a mask, under the same ids."""
        on = keep[self.head] & keep[self.tail]
        place = np.cumsum(keep) - 1
        return CSR.of_rows(self.ids[keep], np.bincount(self.head[on], minlength=self.n)[keep], place[self.tail[on]].astype(np.int32))

    def folded(self) -> tuple[CSR, np.ndarray, np.ndarray]:
        """The subgraph of one node of each class of twins (nodes with the same neighbours, but for each other), the sizes of the classes and the sums of distances inside them.

        Distances between classes are those of their nodes. Hashes propose twins, their rows are compared.
        """
        h = np.random.default_rng(0).integers(0, 1 << 63, self.n, np.uint64)
        first, apart, has = np.arange(self.n), np.zeros(self.n, np.int64), self.k > 0
        met = np.zeros(self.n, np.uint64)
        if has.any():
            met[has] = np.add.reduceat(h.take(self.wide), self.at[:-1][has])
        for d, key in ((1, met + h), (2, met)):  # joined with each other, or not
            _, one, at = np.unique(key, return_index=True, return_inverse=True)
            like = one[at]
            x = np.flatnonzero((like != np.arange(self.n)) & has & (self.k[like] == self.k))
            r, row = like[x], np.repeat(np.arange(len(x)), self.k[x])
            mine, other = self.tail[self.edges_of(x)], self.tail[self.edges_of(r)]
            joined = mine == r[row]
            equal = np.bincount(row[joined], minlength=len(x)) == (d == 1)
            mine, other, row = mine[~joined], other[other != x[row]], row[~joined]
            equal &= np.bincount(row[mine != other], minlength=len(x)) == 0
            first[x[equal]] = r[equal]
            apart[r[equal]] = d
        lead = first == np.arange(self.n)
        size = np.bincount(first, minlength=self.n)[lead]
        return self.kept(lead), size, size * (size - 1) * apart[lead]

    def path_lengths(self, n: int, places: int) -> np.ndarray:
        """path_length() of each of the graphs of side_by_side() on a graph of n nodes; twins are searched once."""
        g, weight, inside = self.folded()
        label, place = g.labels(), g.ids // n
        size = np.bincount(label, weight, g.n).astype(np.int64)
        root = np.flatnonzero(size)
        root = root[np.lexsort((root, -size[root], place[root]))]
        most = np.full(places, -1)
        own, first = np.unique(place[root], return_index=True)
        most[own] = root[first]
        on = label == most[place]
        g, weight, place = g.kept(on), weight[on], place[on]
        # sums of integers under 2**53
        m, total = (np.bincount(place, x, places).astype(np.int64) for x in (weight, inside[on]))
        for d, at, found in g.searched(n, places, weight):
            total[at] += d * found
        m = np.where(m < 2, 0, m)
        return total / np.maximum(m * (m - 1), 1)

    def searched(self, n: int, places: int, weight: np.ndarray | None = None):
        """Searches from all nodes of the graphs of side_by_side() on a graph of n nodes: yields (distance, places, ordered pairs found there). weight: how many nodes each stands for."""
        g, place = self, self.ids // n
        m = np.bincount(place, minlength=places)
        nth = np.arange(g.n) - (np.cumsum(m) - m)[place]
        m = np.where(m < 2, 0, m)
        w = np.ones(g.n, np.int64) if weight is None else weight
        for first in range(0, int(m.max(initial=0)), 64):  # 64 sources of every graph at once
            going = m[place] > first
            if 2 * going.sum() < g.n or not first:
                g, place, nth, w = g.kept(going), place[going], nth[going], w[going]
            start = np.flatnonzero(np.diff(place, prepend=-1))
            mine = (nth >= first) & (nth < first + 64)
            seen = np.where(mine, np.uint64(1) << (np.clip(nth - first, 0, 63)).astype(np.uint64), np.uint64(0))
            if weight is not None:  # the sources with a one in each binary digit of their weight
                long = np.diff(start, append=g.n)
                digits = [np.repeat(np.bitwise_or.reduceat(np.where(w >> j & 1, seen, np.uint64(0)), start), long) for j in range(int(w.max(initial=1)).bit_length())]
            front, d = seen, 0
            while True:
                front = g.spread(front) & ~seen
                if not front.any():
                    break
                seen, d = seen | front, d + 1
                if weight is None:
                    found = np.bitwise_count(front).astype(np.int64)
                else:
                    found = w * sum(np.bitwise_count(front & x).astype(np.int64) << j for j, x in enumerate(digits))
                yield d, place[start], np.add.reduceat(found, start)

    def neighbours(self, centers: np.ndarray) -> np.ndarray:
        """Sorted keys place * n + node of the neighbours of the center at each place."""
        return np.repeat(np.arange(len(centers)) * self.n, self.k[centers]) + self.tail[self.edges_of(centers)]

    def walks(self, length: int) -> np.ndarray:
        """How many walks of 1 to length steps start at each node."""
        one, has, out = np.ones(self.n, np.int64), self.k > 0, np.zeros(self.n, np.int64)
        for _ in range(length):
            new = np.zeros(self.n, np.int64)
            new[has] = np.add.reduceat(one[self.tail], self.at[:-1][has]) if has.any() else 0
            one, out = new, out + new
        return out

    def pieces(self):
        """For each node its component's number and its place there; the component's own graph is cut out when asked for."""
        label = self.labels()
        number = np.unique(label, return_inverse=True)[1]
        order = np.argsort(number, kind="stable")
        start = np.searchsorted(number[order], np.arange(number.max() + 2 if self.n else 1))
        place = np.empty(self.n, np.int32)
        place[order] = np.arange(self.n) - start[number[order]]

        def cut_out(c: int) -> tuple[np.ndarray, CSR]:
            nodes = order[start[c] : start[c + 1]]  # ascending, so places keep the order of each row
            return nodes, CSR.of_rows(np.arange(len(nodes)), self.k[nodes], place[self.tail[self.edges_of(nodes)]])

        return number, place, cut_out

    def by_component(self, sources: np.ndarray):
        """(positions among the sources, places of those in their component, its nodes here, its graph) of each component with sources."""
        if not hasattr(self, "_pieces"):
            self._pieces, self._cut_out = self.pieces(), {}
        number, place, cut_out = self._pieces
        for c in np.unique(number[sources]):
            at = np.flatnonzero(number[sources] == c)
            if c not in self._cut_out:
                self._cut_out[c] = cut_out(c)
            yield at, place[sources[at]], *self._cut_out[c]

    def share(self, i: int, of: int):
        """(places of the nodes of the i-th of so many equal shares, the component's nodes here, its graph) of each component in the share; shares go from component to component, which are not kept."""
        if not hasattr(self, "_pieces"):
            self._pieces, self._cut_out = self.pieces(), {}
        number, place, cut_out = self._pieces
        mine = np.argsort(number, kind="stable")[self.n * i // of : self.n * (i + 1) // of]
        for c in np.unique(number[mine]):
            yield place[mine[number[mine] == c]], *cut_out(c)

    def cores(self) -> np.ndarray:
        """k-core index of each node, by peeling."""
        core, left, k = np.zeros(self.n, np.int64), self.k.copy(), 0
        alive = np.ones(self.n, bool)
        while alive.any():
            k = max(k, int(left[alive].min()))
            front = np.flatnonzero(alive & (left <= k))
            while len(front):
                core[front], alive[front] = k, False
                met = self.tail[self.edges_of(front)]
                np.subtract.at(left, met, 1)
                met = np.unique(met)
                front = met[alive[met] & (left[met] <= k)]
        return core

    def pagerank(self, damping: float, max_iter: int, tol: float | None) -> np.ndarray:
        rank = np.full(self.n, 1.0 / max(self.n, 1))
        for _ in range(max_iter):
            new = (1 - damping) / max(self.n, 1) + damping * np.bincount(self.tail, np.repeat(rank / np.maximum(self.k, 1), self.k), self.n)
            moved, rank = np.abs(new - rank).sum(), new
            if tol is not None and moved < self.n * tol:
                break
        return rank

    def levels(self, sources: np.ndarray) -> np.ndarray:
        """Distances of all nodes from each of up to 64 sources, one row a source; -1 where not reached."""
        out = np.full((self.n, len(sources)), -1, np.int8)
        out[sources, np.arange(len(sources))] = 0
        for d, front in self.distances(sources):
            if d == 127:  # d + 1 no longer fits
                out = out.astype(np.int32)
            bits = np.unpackbits(front.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : len(sources)]
            out += bits.view(np.int8) * out.dtype.type(d + 1)
        return np.ascontiguousarray(out.T)

    def dependencies(self, s: int, dist: np.ndarray | None = None) -> np.ndarray:
        """Brandes: the dependency of source s on every node. dist: the row of levels() for s."""
        if not hasattr(self, "_half"):
            on = self.head < self.tail
            self._half = self.head[on].astype(np.int64), self.tail[on].astype(np.int64)
        dist = self.levels(np.array([s]))[0] if dist is None else dist
        a, b = self._half
        depth = int(dist.max())
        kind = np.int8 if depth <= 30 else np.int16 if depth <= 8000 else np.int64  # the numbers below fit; small ones are sorted by radix
        of_a, of_b = (dist.take(x).astype(kind, copy=False) for x in (a, b))
        total = of_a + of_b  # odd if one end is a step nearer than the other
        e = np.flatnonzero((total & 1) != 0)
        step = (2 * total + (of_a > of_b)).take(e)  # 4 d + 2 from a at d to b, 4 d + 3 from b at d to a
        order = np.argsort(step, kind="stable")
        e = e.take(order)
        ends = np.searchsorted(step, np.arange(2, 4 * depth + 4).astype(kind), sorter=order).tolist()
        a, b = a.take(e), b.take(e)
        parts = []
        for d in range(depth):
            i, j, k = ends[4 * d : 4 * d + 3]
            parts += [(a[i:j], b[i:j]), (b[j:k], a[j:k])]
        sigma = np.zeros(self.n)
        sigma[s] = 1.0
        for h, t in parts:
            np.add.at(sigma, t, sigma.take(h))
        own = 1 / np.where(sigma > 0, sigma, 1.0)
        got = own.copy()  # (1 + delta) / sigma
        for h, t in reversed(parts):
            np.add.at(got, h, got.take(t))
        delta = sigma * (got - own)
        delta[s] = 0.0
        return delta

    def all_dependencies(self, sources: np.ndarray) -> np.ndarray:
        """The sum of dependencies() over the sources."""
        return self.all_searches(sources)[0]

    def all_searches(self, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sum of dependencies() over the sources, and what sums() gives for each; 64 sources share a search."""
        total, count, far = np.zeros(self.n), np.zeros(len(sources), np.int64), np.zeros(len(sources), np.int64)
        for i in range(0, len(sources), 64):
            some = sources[i : i + 64]
            for j, (s, dist) in enumerate(zip(some, self.levels(some)), i):
                count[j], far[j] = np.count_nonzero(dist > 0), dist.sum(dtype=np.int64) + np.count_nonzero(dist < 0)
                total += self.dependencies(int(s), dist)
        return total, count, far


def _packed(batches):
    """The sorted edges of a partition as one row: distinct u, their degrees, all v."""
    import pyarrow as pa

    edges = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if edges:
        u, v = (np.concatenate(x) for x in zip(*edges))
        ids, k = np.unique(u, return_counts=True)
        cells = [pa.array([x.tobytes()], pa.binary()) for x in (ids, k.astype(np.int32), v)]
        yield pa.RecordBatch.from_arrays(cells, ["ids", "k", "v"])


def broadcast_graph(adj: DataFrame, limit: int = BROADCAST_EDGES):
    """The adjacency as a broadcast CSR, or None if it has more than limit edges; made once for an adjacency, however often it is asked for."""
    if "_csr" in adj.__dict__:
        return adj._csr
    m = adj.count()
    if m > limit:
        return None
    # the driver takes the rows piece by piece
    rows = adj.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).repartitionByRange(max(1, -(-m // 1_000_000)), "u").sortWithinPartitions("u", "v")
    parts = list(rows.mapInArrow(_packed, "ids binary, k binary, v binary").toLocalIterator(prefetchPartitions=True))
    ids, k = (np.concatenate([np.frombuffer(p[i], t) for p in parts] or [np.zeros(0, t)]) for i, t in enumerate((np.int64, np.int32)))
    tail, at = np.empty(m, np.int32), 0
    for i, p in enumerate(parts):
        v, parts[i] = np.frombuffer(p[2], np.int64), None
        tail[at : at + len(v)] = np.searchsorted(ids, v)
        at += len(v)
    adj._csr = adj.sparkSession.sparkContext.broadcast(CSR.of_rows(ids, k, tail))
    adj._csr.__dict__.pop("_value", None)  # only the tasks read it
    return adj._csr
