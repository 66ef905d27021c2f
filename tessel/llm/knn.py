"""The k most similar vectors of every vector: forests of random-projection trees, one priority queue, exact reranking.

A trunk divides all vectors into cells of about ``cell`` rows; it and bits that number rows are all that is broadcast. It is one
random-projection tree over a bounded sample or, where vectors then visit fewer cells, the pivots of a cover of the sample. A vector
belongs to one cell and visits those whose hyperplanes it lies beyond, or whose pivots are less similar than its own, by no more than
``slack``, which is the least that keeps the recall aimed at, measured on the sample against brute force. In each cell its task grows a forest over all its
members, down to leaves of ``leaf`` rows whatever the size of the data (a cell of eight leaves or less is one). A visitor's leaves, of all trees, come through one priority
queue: best first by the smallest signed distance to the hyperplanes on the way, until they hold as many candidates as the recall
takes, which is measured in that cell against brute force. Where it takes half of the cell, all its members are candidates. Best-first
order is the order of the leaves' own priorities, so the queues of a batch of visitors are worked off as one ranking of leaves.

Candidates are compared leaf by leaf as matrix products; a visitor's best ones are reranked by cosines in double precision. A cell
sends back one list a visitor. Members of a cell that the trunk could not divide are cut into parts by a hash of the key, and each
part is searched like a cell; visitors are cut likewise, so no task grows with the data and no candidate is dropped. Equal vectors are
indexed once and take part through their first copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessel.llm.density import cover
from tessel.llm.vectors import copies_of, decode, raw
from tessel.plans.staging import numbered, stage


class Forest:
    """Hyperplane trees over unit vectors; a child >= 0 is a node, a child < 0 the leaf ~child.

    A split is the best of ``lines`` random lines between two points: on each the place where the fewest points of ``part`` lie close
    by for the size of the smaller side, so that a group which stands apart is cut off whole rather than cut in two.
    """

    def __init__(self, x: np.ndarray, trees: int, leaf: int, lines: int = 4, part: int = 512, width: float = 0.04, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.normals, self.offsets, self.children, self.roots, self.leaves, starts = [], [], [], [], [], []
        for _ in range(trees):
            starts.append(len(self.leaves))
            # (rows, the node they hang on, its side); the depth is that of the groups cut off, so no recursion
            waiting: list[tuple[np.ndarray, int, int]] = [(np.arange(len(x)), -1, 0)]
            while waiting:
                rows, above, side = waiting.pop()
                split = self._split(x, rows, rng, lines, part, width) if len(rows) > leaf else None
                if split:
                    high = ((x @ split[0])[rows] if 4 * len(rows) > len(x) else x[rows] @ split[0]) > split[1]
                else:
                    high = np.zeros(len(rows), bool)
                if 0 < high.sum() < len(rows):
                    me = len(self.offsets)
                    self.normals.append(split[0])
                    self.offsets.append(split[1])
                    self.children.append([0, 0])
                    waiting += [(rows[high], me, 1), (rows[~high], me, 0)]
                else:  # few enough, or all the same
                    me = ~len(self.leaves)
                    self.leaves.append(rows)
                if above < 0:
                    self.roots.append(me)
                else:
                    self.children[above][side] = me
        self.normals = np.array(self.normals, np.float32).reshape(len(self.offsets), x.shape[1])
        self.offsets = np.array(self.offsets, np.float32)
        #: Rows of each leaf.
        self.sizes = np.array([len(r) for r in self.leaves])
        #: The first leaf of each tree, and the end.
        self.starts = np.array([*starts, len(self.sizes)])

    @classmethod
    def of(cls, state: dict) -> Forest:
        """A forest from its plain values, which is how it is broadcast."""
        f = cls.__new__(cls)
        f.__dict__.update(state)
        return f

    @staticmethod
    def _split(x: np.ndarray, rows: np.ndarray, rng, lines: int, part: int, width: float) -> tuple[np.ndarray, float] | None:
        seen = x[rows if len(rows) <= part else rng.choice(rows, part, replace=False)]
        ends = rng.choice(len(rows), (2, lines))
        w = x[rows[ends[0]]] - x[rows[ends[1]]]
        length = np.linalg.norm(w, axis=1)
        w = w[length > 1e-6] / length[length > 1e-6, None]
        n = len(seen)
        if not len(w) or n < 2:
            return None
        least = min(4, n // 2)
        place = np.arange(least, n - least + 1)
        place = place[place < n]
        smaller = np.minimum(place, n - place)
        best = None
        for line, along in zip(w, np.sort(w @ seen.T, axis=1)):
            middle = (along[place - 1] + along[place]) / 2
            close = np.searchsorted(along, middle + width) - np.searchsorted(along, middle - width)
            score = (close + 0.5) / smaller
            i = int(score.argmin())
            if best is None or score[i] < best[0]:
                best = score[i], line, float(middle[i])
        return best[1:]

    def priorities(self, u: np.ndarray) -> np.ndarray:
        """For each vector and leaf, the smallest signed distance to the hyperplanes on the leaf's way (vectors x leaves)."""
        margins = (self.normals @ u.T - self.offsets[:, None]) if len(self.offsets) else np.zeros((0, len(u)), np.float32)
        at = np.empty_like(margins)
        out = np.full((len(self.sizes), len(u)), np.inf, np.float32)
        for root in self.roots:
            if root >= 0:
                at[root] = np.inf
        for node, (low, high) in enumerate(self.children):  # parents come before their children
            for child, m in ((low, -margins[node]), (high, margins[node])):
                np.minimum(at[node], m, out=at[child] if child >= 0 else out[~child])
        return out.T

    def own(self, priority: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree (vectors x trees)."""
        return np.stack([a + priority[:, a:b].argmax(axis=1) for a, b in zip(self.starts[:-1], self.starts[1:])], axis=1)

    def visited(self, priority: np.ndarray, candidates: float) -> np.ndarray:
        """Which leaves each vector visits until they hold ``candidates`` rows, in the order of the queue (vectors x leaves)."""
        order = np.argsort(-priority, axis=1, kind="stable")
        size = self.sizes[order]
        out = np.empty(order.shape, bool)
        np.put_along_axis(out, order, np.cumsum(size, axis=1) - size < candidates, axis=1)
        return out

    def needed(self, u: np.ndarray, k: int, recall: float, queries: int) -> tuple[float, float]:
        """The slack, and the candidates, that find this share of the ``k`` best of ``queries`` of the forest's own vectors ``u``."""
        if len(u) <= 1:
            return 0.0, 1.0
        k = min(k, len(u) - 1)
        at = np.unique(np.linspace(0, len(u) - 1, min(queries, len(u))).astype(int))
        best = np.empty((len(at), k), np.int64)
        for i in range(0, len(at), 64):
            s = u[at[i : i + 64]] @ u.T
            s[np.arange(len(s)), at[i : i + 64]] = -9
            best[i : i + 64] = np.argpartition(-s, k - 1, axis=1)[:, :k]
        wanted = np.unique(best)
        own = self.own(self.priorities(u[wanted]))[np.searchsorted(wanted, best)]  # queries x k x trees
        priority = self.priorities(u[at])
        order = np.argsort(-priority, axis=1, kind="stable")
        upto = np.empty(order.shape)
        np.put_along_axis(upto, order, np.cumsum(self.sizes[order], axis=1).astype(float), axis=1)
        q = np.arange(len(at))[:, None, None]
        slack = np.maximum(0, -priority[q, own]).min(axis=2).ravel()
        seen = upto[q, own].min(axis=2).ravel()
        i = min(len(seen) - 1, int(np.ceil(recall * len(seen))))
        return float(np.sort(slack)[i]), float(np.sort(seen)[i])


class Pivots(Forest):
    """Cells of a cover's pivots: a vector is in the cell of its most similar pivot, and a cell's priority is how much less similar
    the best of its own pivots is. Groups that stand apart have pivots of their own, so that no cell cuts one in two, where hyperplanes
    through a great many groups must. Pivots that lie together, by a tree over them, share a cell.
    """

    def __init__(self, x: np.ndarray, cut: float, cells: int, most: int = 8192):
        pivots = x[cover(x, cut, most)]
        groups = Forest(pivots, 1, max(1, len(pivots) // cells), lines=8, part=1024).leaves
        self.pivots = pivots[np.concatenate(groups)]
        self.first = np.cumsum([0, *map(len, groups[:-1])])
        self.starts = np.array([0, len(groups)])
        home = [self.own(self.priorities(x[i : i + 1024]))[:, 0] for i in range(0, len(x), 1024)]
        self.sizes = np.bincount(np.concatenate(home), minlength=len(groups))

    def priorities(self, u: np.ndarray) -> np.ndarray:
        parts = range(0, max(1, len(u)), 1024)
        best = np.concatenate([np.maximum.reduceat(u[i : i + 1024] @ self.pivots.T, self.first, axis=1) for i in parts])
        return best - best.max(axis=1, keepdims=True)


def fit_trunk(x: np.ndarray, cells: int, k: int, recall: float) -> tuple[Forest, float, np.ndarray]:
    """The trunk under which the sample's rows visit the fewest cells for the recall, the slack, and the sample's visits by cell.

    Compared are the tree and covers of three cut-offs, which follow the similarity of the sample's nearest neighbours.
    """
    trunks = [Forest(x, 1, max(16, len(x) // cells), lines=8, part=1024)]
    if cells > 1 and len(x) > 1:
        s = x[:1024] @ x.T
        np.fill_diagonal(s, -9)
        typical = max(0.0, float(np.quantile(s.max(axis=1), 0.05)))
        trunks += [Pivots(x, cut, cells) for cut in sorted({round(typical**e, 6) for e in (2, 4, 8)}) if cut > 0]
    best = None
    for trunk in trunks:
        slack = trunk.needed(x, k, recall, 1024)[0]
        visits = sum(((trunk.priorities(x[i : i + 1024]) >= -slack).sum(axis=0) for i in range(0, len(x), 1024)), np.zeros(len(trunk.sizes), np.int64))
        if best is None or visits.sum() < best[2].sum():
            best = trunk, slack, visits
    return best


def _routed(kind: type[Forest], trunk, size: int, slack: float, member_parts, visitor_parts):
    """Rows (cell, mpart, vpart, member, visitor, key, v) for the index and the queries, one for both where they coincide."""

    def run(batches):
        f = kind.of(trunk.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                priority = f.priorities(decode(part.column("v").to_pylist(), size))
                keys = part.column("key").to_numpy()
                h = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64)
                home = f.own(priority)[:, 0]
                row, cell = np.nonzero(priority >= -slack)
                i, j = member_parts[cell], visitor_parts[cell]
                member = home[row] == cell
                # a member goes to its part for all parts of the visitors, a visitor to all parts of the members
                often = i + np.where(member, j - 1, 0)
                first = np.repeat(np.cumsum(often) - often, often)
                n = np.arange(len(first)) - first
                row, cell, member, i, j = (np.repeat(x, often) for x in (row, cell, member, i, j))
                mine, hers = h[row] % i, h[row] % j
                across = n < i  # as a visitor; its own part of the members is where it may be both
                x = np.where(across, n, mine)
                rest = n - i
                y = np.where(across, hers, rest + (rest >= hers))
                cols = (cell.astype(np.int32), x.astype(np.int32), y.astype(np.int32), member & (x == mine), across)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), taken.column("key"), taken.column("v")], names=["cell", "mpart", "vpart", "member", "visitor", "key", "v"])

    return run


def _best(visitor: np.ndarray, member: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """The rows that are among the k greatest of their visitor, in order; a (visitor, member) pair counts once."""
    by = np.lexsort((member, visitor))
    by = by[np.append(True, (visitor[by][1:] != visitor[by][:-1]) | (member[by][1:] != member[by][:-1]))] if len(by) else by
    by = by[np.lexsort((member[by], -sim[by], visitor[by]))]
    v = visitor[by]
    start = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, int)
    nth = np.arange(len(v)) - np.repeat(start, np.diff(np.append(start, len(v))))
    return by[nth < k]


def search(u: np.ndarray, m: np.ndarray, q: np.ndarray, forest: Forest, candidates: float, k: int, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """(visitor, member, single-precision cosine) of the k candidates most similar to each visitor; m and q are rows of ``u``."""
    out: list[list[np.ndarray]] = [[], [], []]
    for at in range(0, len(q), 2048):
        rows = q[at : at + 2048]
        visits = forest.visited(forest.priorities(u[rows]), candidates)
        met: list[list[np.ndarray]] = [[], [], []]
        for leaf in np.flatnonzero(visits.any(axis=0)):
            mine = m[forest.leaves[leaf]]
            for who in np.array_split(rows[visits[:, leaf]], max(1, len(rows) * len(mine) >> 23)):
                s = u[who] @ u[mine].T
                s[keys[who][:, None] == keys[mine][None, :]] = -9
                n = min(k, len(mine))
                top = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < len(mine) else np.broadcast_to(np.arange(n), s.shape)
                sim = np.take_along_axis(s, top, 1)
                ok = sim > -8
                for c, x in zip(met, (np.repeat(who, ok.sum(axis=1)), mine[top][ok], sim[ok])):
                    c.append(x)
        if met[0]:
            v, t, s = map(np.concatenate, met)
            keep = _best(v, t, s, k)
            for c, x in zip(out, (v, t, s)):
                c.append(x[keep])
    return tuple(np.concatenate(c) if c else np.zeros(0, kind) for c, kind in zip(out, (np.int64, np.int64, np.float32)))


def _nearest(size: int, k: int, trees: int, leaf: int, recall: float, candidates: float | None):
    def run(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_numpy()
        encoded = group.column("v").to_pylist()
        u = decode(encoded, size)
        m = np.flatnonzero(group.column("member").to_numpy())
        m = m[np.argsort(keys[m])]
        q = np.flatnonzero(group.column("visitor").to_numpy())
        if not len(m) or not len(q):
            return _lists(keys[:0], keys[:0], np.zeros(0))
        forest = Forest(u[m], trees, leaf) if len(m) > 8 * leaf else Forest(u[m], 1, len(m))
        seen = candidates
        if seen is None and len(forest.sizes) > 1:
            seen = forest.needed(u[m], k, recall, 256)[1]
        if seen is None or seen > len(m) / 2:
            forest = Forest(u[m], 1, len(m))
        # two more than k, lest rounding to single precision decides which are the k
        who, to, _ = search(u, m, q, forest, seen or len(m), k + 2, keys)
        sim = np.empty(len(who))
        for at in range(0, len(who), 8192):
            a, b = who[at : at + 8192], to[at : at + 8192]
            both, back = np.unique(np.concatenate([a, b]), return_inverse=True)
            x = raw([encoded[i] for i in both], size)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            sim[at : at + 8192] = np.einsum("ij,ij->i", x[back[: len(a)]], x[back[len(a) :]])
        keep = _best(keys[who], keys[to], sim, k)
        return _lists(keys[who][keep], keys[to][keep], sim[keep])

    return run


def _lists(key: np.ndarray, to: np.ndarray, sim: np.ndarray) -> pa.Table:
    """One row a key, with the list of its (sim, to) in order; equal keys stand together."""
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    near = pa.ListArray.from_arrays(pa.array(np.append(start, len(key)), pa.int32()), pa.StructArray.from_arrays([pa.array(sim, pa.float64()), pa.array(to, pa.int64())], names=["sim", "to"]))
    return pa.table({"key": pa.array(key[start], pa.int64()), "near": near})


def _top(k: int):
    """Column expression: the first k of an array of (sim, to) structs, by similarity and then the smaller key."""
    worse = lambda a, b: F.when(a["sim"] > b["sim"], -1).when(a["sim"] < b["sim"], 1).when(a["to"] < b["to"], -1).when(a["to"] > b["to"], 1).otherwise(0)
    return lambda c: F.slice(F.array_sort(c, worse), 1, k)


def nearest_neighbours(
    points: DataFrame, size: int, k: int = 8, cell: int = 8192, trees: int = 4, leaf: int = 256, recall: float = 0.95, candidates: float | None = None, sample: int = 32768, cap: int = 32768
) -> DataFrame:
    """Rows (key, to, sim, rank): the ``k`` most similar other points of each point of ``usable_vectors`` form.

    The trunk is fitted on at most ``sample`` rows, the first by a hash of the key, and every row is indexed. ``recall`` is the share
    of true neighbours aimed at; what may be missed is left to the trunk and to the cells by halves. ``candidates`` gives the
    cells' number of candidates instead. A cell of over ``cap`` members, by the sample, is cut into parts. Equal similarities go to
    the smaller key. A point has fewer than ``k`` rows only where there are not so many others; with no or one point the result is empty.
    """
    spark = points.sparkSession
    copied = copies_of(points)
    first = points.groupBy("digest").agg(F.min(F.struct("key", "row")).alias("x")).select("x.row")
    reps = numbered(points, stage(first, "reps")).select("key", "v")
    n = points.count()
    cells = max(1, round(n / cell))
    got = reps.orderBy(F.xxhash64("key"), "key").limit(sample).select("v").collect() if cells > 1 else []
    fitted = decode([r.v for r in got], size)
    got = len(got)
    # among the sample's rows as many stand for the k nearest as their share of all rows
    trunk, slack, visits = fit_trunk(fitted, cells, max(1, round(k * got / max(1, n))), 1 - (1 - recall) / 2)
    share = got or 1
    member_parts = np.maximum(1, np.ceil(trunk.sizes / share * n / cap)).astype(np.int64)
    visitor_parts = np.maximum(1, np.ceil(visits / share * n / (2 * cap))).astype(np.int64)
    trunk.leaves = []
    routed = reps.mapInArrow(
        _routed(type(trunk), spark.sparkContext.broadcast(vars(trunk)), size, slack, member_parts, visitor_parts), "cell int, mpart int, vpart int, member boolean, visitor boolean, key long, v binary"
    )
    lists = routed.groupBy("cell", "mpart", "vpart").applyInArrow(
        _nearest(size, k, trees, leaf, 1 - (1 - recall) / 2, candidates), "key long, near array<struct<sim:double,to:long>>"
    )
    top = _top(k)
    # k rows of each visited cell come together here
    per_key = lists.groupBy("key").agg(top(F.flatten(F.collect_list("near"))).alias("near"))
    if not copied.isEmpty():
        per_key = _with_copies(points, copied, per_key, k)
    return per_key.select("key", F.posexplode("near").alias("rank", "x")).select("key", "x.to", "x.sim", (F.col("rank") + 1).alias("rank"))


def _with_copies(points: DataFrame, copied: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """Per key the k nearest, where the members of a group of equal vectors stand beside its first one.

    At equal similarity the smaller key comes first, so of any group the first k + 1 members are all that can be needed.
    """
    top = _top(k)
    nth = F.row_number().over(W.partitionBy("rep").orderBy("key"))
    firsts = copied.select("key", "rep", nth.alias("n")).where(f"n <= {k + 1}").groupBy("rep").agg(F.sort_array(F.collect_list("key")).alias("first"))
    firsts = stage(firsts, "firsts")
    near = lists.select(F.col("key").alias("from"), F.explode("near").alias("x")).select("from", F.col("x.to").alias("rep"), "x.sim")
    wide = near.join(firsts, "rep", "left").select("from", "sim", F.explode(F.coalesce("first", F.array("rep"))).alias("to"))
    wide = stage(wide.groupBy("from").agg(top(F.collect_list(F.struct("sim", "to"))).alias("near")), "wide").withColumnRenamed("from", "rep")
    rows = points.select("key").join(copied.select("key", F.col("rep").alias("_rep")), "key", "left").select("key", F.coalesce("_rep", "key").alias("rep"))
    rows = rows.join(firsts, "rep", "left").join(wide, "rep", "left")
    own = F.transform(F.filter("first", lambda x: x != F.col("key")), lambda x: F.struct(F.lit(1.0).alias("sim"), x.alias("to")))
    both = F.when(F.col("first").isNull(), F.col("near")).when(F.col("near").isNull(), top(own)).otherwise(top(F.concat(own, "near")))
    return rows.select("key", both.alias("near")).where("near is not null")
