"""Clusters and neighbours against brute force: copies, ties, unusable vectors, hot groups, small and empty inputs."""

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessel.llm import density, knn, vectors

SIZE = 16
SCHEMA = "rid long, v array<float>, key string, digest string"


def frame(spark, rows):
    return vectors.usable_vectors(spark.createDataFrame([(k, v, "a", "b") for k, v in rows], SCHEMA), "rid", "v", SIZE)


def planted(seed=1, clusters=12, each=30, noise=0.06):
    rng = np.random.default_rng(seed)
    centres = np.linalg.qr(rng.normal(size=(SIZE, SIZE)))[0][:clusters]
    rows = []
    for c in range(clusters):
        for _ in range(each if c else each * 6):
            rows.append([float(x) for x in (centres[c] + noise * rng.normal(size=SIZE)) * rng.uniform(0.2, 9)])
    order = rng.permutation(len(rows))
    return [(int(i), rows[j]) for i, j in enumerate(order)]


def unit(rows):
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_usable(spark):
    one = [1.0] + [0.0] * (SIZE - 1)
    rows = [(1, one), (1, one), (2, [0.0] * SIZE), (3, one[:-1]), (4, [float("nan")] + one[1:]), (5, [None] + one[1:]), (6, None), (None, one), (7, [1e-30] * SIZE), (8, [1e30] * SIZE), (9, [])]
    assert sorted(r.key for r in frame(spark, rows).collect()) == [1, 7, 8]
    assert np.isfinite(vectors.decode([vectors.encode(np.full(SIZE, 1e30, np.float32)), vectors.encode(np.full(SIZE, 1e-30, np.float32))], SIZE)).all()


@pytest.mark.parametrize("block, sample", [(2048, 4096), (64, 4096), (64, 40)])
def test_clusters(spark, block, sample):
    rows = planted()
    s = unit(rows) @ unit(rows).T
    want, label = defaultdict(set), {}
    for i in range(len(rows)):
        label.setdefault(i, i)
        for j in np.flatnonzero(s[i] >= 0.5):
            label.setdefault(int(j), label[i])
    for i, k in label.items():
        want[k].add(i)
    got = defaultdict(set)
    for r in density.density_clusters(frame(spark, rows), SIZE, block=block, sample=sample).collect():
        got[r.peak].add(r.key)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(k in v for k, v in got.items())


@pytest.mark.parametrize("block, sample", [(5000, 5000), (100, 5000), (100, 300)])
def test_touching_clusters_are_those_of_all_pairs(spark, block, sample):
    """Clusters that overlap: densities, pointers and labels are those of the whole data, whatever the blocks."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(9, SIZE))
    rows = [(i, [float(x) for x in centres[i % 9] + 0.8 * rng.normal(size=SIZE)]) for i in range(1200)]
    u = vectors.decode([vectors.encode(np.array(v, np.float32)) for _, v in rows], SIZE)
    peak, _ = density.peaks_of(u, np.arange(1200), np.ones(1200), 0.5)
    got = {r.key: r.peak for r in density.density_clusters(frame(spark, rows), SIZE, block=block, sample=sample).collect()}
    same = np.mean([got[i] == peak[i] for i in range(1200)])
    assert len(set(peak.tolist())) > 1 and (same == 1 if sample >= 1200 else same > 0.98)


def test_pointers_do_not_depend_on_the_order_of_rows():
    rng = np.random.default_rng(4)
    v = (np.ones(SIZE) + 0.5 * rng.normal(size=(50, SIZE))).astype(np.float32)
    group = pa.table({"key": pa.array(range(50)), "v": pa.array([vectors.encode(x) for x in v], pa.binary()), "density": rng.uniform(1, 9, 50), "member": [True] * 50, "visitor": [True] * 50})
    want, got = (density._pointers(SIZE, 0.5)(g).to_pylist() for g in (group, group.take(rng.permutation(50))))
    assert sorted((r["key"], r["to"]) for r in got) == sorted((r["key"], r["to"]) for r in want)


def test_follow(spark):
    rows = [(i, i - 1) for i in range(1, 40)] + [(100, 5)]
    got = {r.key: r.peak for r in density.follow(spark.createDataFrame(rows, "key long, to long")).collect()}
    assert set(got.values()) == {0} and len(got) == 40


def test_cluster_edges(spark):
    assert density.density_clusters(frame(spark, []), SIZE).count() == 0
    same = [(i, [1.0] * SIZE) for i in range(500)] + [(900, [-1.0] + [0.0] * (SIZE - 1))]
    got = {r.key: r.peak for r in density.density_clusters(frame(spark, same), SIZE, block=64).collect()}
    assert len(got) == 501 and {got[i] for i in range(500)} == {0} and got[900] == 900


def test_next_in_group(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 70000), ("a", 3), ("b", 9)], "g string, k long")
    assert sorted(tuple(r) for r in density.next_in_group(rows, "g", "k").collect()) == [("a", 1, 3), ("a", 3, 70000)]


def neighbours(rows, k):
    rows = sorted(rows)
    s = np.round(unit(rows) @ unit(rows).T, 9)
    np.fill_diagonal(s, -9)
    keys = np.array([r for r, _ in rows])
    top = np.argsort(-s, axis=1, kind="stable")[:, : min(k, len(rows) - 1)]
    return {int(keys[i]): keys[top[i]].tolist() for i in range(len(rows))}


def found(spark, rows, **kw):
    out = defaultdict(list)
    for r in knn.nearest_neighbours(frame(spark, rows), SIZE, **kw).orderBy("key", "rank").collect():
        out[r.key].append(r.to)
    return out


@pytest.mark.parametrize("clusters, each", [(6, 40), (12, 60), (15, 150)])
def test_tuned_recall(spark, clusters, each):
    """The recall of the parameters that the operator finds itself, over one cell and several, at three sizes."""
    rows = planted(seed=3, clusters=clusters, each=each, noise=0.15)
    got, want = found(spark, rows, cell=500, leaf=16), neighbours(rows, 8)
    recall = np.mean([len(set(got[k]) & set(want[k])) / 8 for k in want])
    assert recall >= 0.9 and all(len(v) == 8 for v in got.values()) and all(k not in v for k, v in got.items())


def test_recall_without_clusters(spark):
    """Vectors without any groups: the slack and the candidates that they take are not bounded."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(y) for y in rng.normal(size=SIZE)]) for i in range(3000)]
    got, want = found(spark, rows, cell=400, leaf=16), neighbours(rows, 8)
    assert np.mean([len(set(got[k]) & set(want[k])) / 8 for k in want]) >= 0.9


def test_exact_when_all_is_visited(spark):
    rows = planted(seed=4, each=8)
    assert dict(found(spark, rows, candidates=10**6)) == neighbours(rows, 8)


def test_parts_lose_nothing(spark):
    rows = planted(seed=5, each=8)
    assert dict(found(spark, rows, candidates=10**6, cell=40, cap=8, recall=1.0)) == neighbours(rows, 8)


def test_queue_order():
    """Leaves come in the order of a best-first walk over the trees with one heap."""
    x = np.random.default_rng(6).normal(size=(600, SIZE)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = knn.Forest(x, 3, 20)
    assert sorted(np.concatenate(forest.leaves).tolist()) == sorted(list(range(600)) * 3)
    own = forest.own(forest.priorities(x))
    assert all(i in forest.leaves[leaf] for i in range(600) for leaf in own[i])
    margins = x[:20] @ forest.normals.T - forest.offsets
    priority = forest.priorities(x[:20])
    for m, mask, p in zip(margins, forest.visited(priority, 150), priority):
        heap, seen, n = [(-np.inf, r) for r in forest.roots], set(), 0
        while heap and n < 150:
            d, node = heapq.heappop(heap)
            if node < 0:
                seen.add(~node)
                n += forest.sizes[~node]
                continue
            low, high = forest.children[node]
            heapq.heappush(heap, (max(d, -m[node]), high))
            heapq.heappush(heap, (max(d, m[node]), low))
        # leaves below one hyperplane may be equally near, and any of them may come first
        last = min(p[list(seen)])
        assert last == pytest.approx(min(p[mask])) and {i for i in seen if p[i] > last} == {i for i in np.flatnonzero(mask).tolist() if p[i] > last}


def test_copies_and_ties(spark):
    rows = [(i, [1.0] + [0.0] * (SIZE - 1)) for i in range(30)] + [(100 + i, [1.0, 0.3] + [0.0] * (SIZE - 2)) for i in range(20)] + [(200, [0.0, 1.0] + [0.0] * (SIZE - 2))]
    got = found(spark, rows)
    assert got[0] == list(range(1, 9)) and got[29] == list(range(8)) and got[119] == [100 + i for i in range(8)]
    assert got[200] == [100 + i for i in range(8)]


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few(spark, n):
    rows = [(i, [1.0, float(i)] + [0.5] * (SIZE - 2)) for i in range(n)]
    got = found(spark, rows)
    assert {k: len(v) for k, v in got.items()} == ({} if n < 2 else {i: n - 1 for i in range(n)})
    assert frame(spark, rows).where(F.col("key") < 0).count() == 0


def test_many_groups_are_not_cut(spark):
    """300 groups in 64 dimensions: cells hold whole groups, so that vectors visit few of them, and recall stays."""
    rng = np.random.default_rng(12)
    x = np.repeat(rng.normal(size=(300, 64)), 20, axis=0) + 0.6 * rng.normal(size=(6000, 64))
    x = rng.permutation(x).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    trunk, slack, visits = knn.fit_trunk(x, 24, 8, 0.975)
    assert visits.sum() <= 2 * len(x) and trunk.sizes.sum() == len(x)
    s = x[:200] @ x.T
    s[np.arange(200), np.arange(200)] = -9
    best = np.argsort(-s, axis=1)[:, :8]
    home = trunk.own(trunk.priorities(x))[:, 0]
    assert np.mean(np.take_along_axis(trunk.priorities(x[:200]) >= -slack, home[best], axis=1)) >= 0.95


def test_vectors_are_not_shuffled(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = frame(spark, planted(each=2) * 2).select("key", "v")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and frame(spark, planted(each=2) * 2).count() == 34
