"""Means of groups of vectors, assignment to centres, and spherical k-means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.plans.staging import stage

#: Most centres that are broadcast; more are assigned in several scans.
BLOCK = 4096


def _sums(batches):
    """Sums of unit vectors per group within a partition, so a group's vectors are never brought together."""
    total: dict = {}
    for batch in batches:
        groups = batch.column("grp").to_pylist()
        for g, v in zip(groups, batch.column("v").to_pylist()):
            x = np.asarray(v, np.float64)
            n = np.linalg.norm(x)
            if n > 0 and np.isfinite(n):
                total[g, len(x)] = total.get((g, len(x)), 0) + x / n
        if len(total) > BLOCK:
            yield _packed(total)
            total = {}
    if total:
        yield _packed(total)


def _packed(total: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([g for g, _ in total], pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["grp", "total"])


def group_means(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centre): the normalised mean of the unit vectors of each group. Null, zero and non-finite vectors don't count."""
    rows = df.where(F.col(group).isNotNull() & F.col(vector).isNotNull()).select(F.col(group).cast("long").alias("grp"), F.col(vector).alias("v"))
    sums = rows.mapInArrow(_sums, "grp long, total array<double>").select("grp", F.posexplode("total").alias("pos", "x"))
    each = sums.groupBy("grp", "pos").agg(F.sum("x").alias("x"))
    # a vector's numbers, as many as it has dimensions
    out = each.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("c"))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x))
    return out.select(F.col("grp").alias(group), F.transform("c", lambda x: x / norm).alias("centre"))


def assign_to_centres(df: DataFrame, key: str, vector: str, centres: DataFrame, group: str, own: str | None = None) -> DataFrame:
    """(key, centre, sim): each vector's most similar centre, ties to the smaller group; with ``own``, the centre of its own group."""
    spark = df.sparkSession
    names = [F.col(key).alias(key), F.col(vector).alias("v"), *([F.col(own).cast("long").alias("own")] if own else [])]
    rows = df.where(F.col(vector).isNotNull()).select(*names)
    if own:
        near = rows.join(centres.select(F.col(group).alias("own"), "centre"), "own")
        dot = F.aggregate(F.zip_with("v", "centre", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        return near.select(key, F.col("own").alias("centre"), (dot / norm).alias("sim"))
    out, held = None, []

    def scanned(held):
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in held]), np.array([r[1] for r in held])))

        def run(batches):
            ids, c = shared.value
            for batch in batches:
                if batch.num_rows:
                    x = np.array(batch.column("v").to_pylist(), np.float64)
                    s = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ c.T
                    at = s.argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(ids[at]), pa.array(s[np.arange(len(at)), at])], names=[key, "centre", "sim"])

        return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, centre long, sim double")

    for r in centres.select(group, "centre").orderBy(group).toLocalIterator():
        held.append(r)
        if len(held) == BLOCK:
            out = scanned(held) if out is None else out.unionByName(scanned(held))
            held = []
    if held:
        out = scanned(held) if out is None else out.unionByName(scanned(held))
    if out is None:
        return rows.select(key, F.lit(None).cast("long").alias("centre"), F.lit(None).cast("double").alias("sim")).limit(0)
    return out.groupBy(key).agg(F.max(F.struct("sim", (-F.col("centre")).alias("neg"))).alias("x")).select(key, (-F.col("x.neg")).alias("centre"), "x.sim")


def _seeds(x: np.ndarray, k: int, rng) -> np.ndarray:
    """k-means++: each next centre is drawn with a chance in proportion to the distance from those there are."""
    out = [x[rng.integers(len(x))]]
    far = np.maximum(0, 1 - x @ out[0])
    while len(out) < min(k, len(x)):
        total = far.sum()
        out.append(x[rng.choice(len(x), p=far / total) if total > 1e-12 else rng.integers(len(x))])
        far = np.minimum(far, np.maximum(0, 1 - x @ out[-1]))
    return np.array(out)


def spherical_kmeans(df: DataFrame, key: str, vector: str, k: int, rounds: int = 25, tolerance: float = 1e-4, sample: int = 8192, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(key, centre, sim) of each usable vector, and the centres (centre_id, centre), by cosine; ``k`` is at most BLOCK.

    Seeds come from a bounded sample, the first rows by a hash of the key; every round assigns all vectors and takes the normalised
    sums, of which only ``k`` reach the driver. A centre that lost its vectors is set on the vector least like its own centre. Ends
    when no centre moves by more than ``tolerance``. Null, zero and non-finite vectors are left out; there are no more centres than
    sampled vectors, and an empty input gives two empty tables.
    """
    if not 0 < k <= BLOCK:
        raise ValueError(f"k is 1 to {BLOCK}")
    spark = df.sparkSession
    usable = F.aggregate(vector, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(float("nan"))) * x.cast("double"))
    rows = stage(df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).withColumn("_n", usable).where("_n > 0 and not isnan(_n) and _n < double('inf')").select(key, F.col(vector).alias("v")), "kmeans")
    got = rows.orderBy(F.xxhash64(key), key).limit(sample).select("v").collect()
    table = lambda c: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "grp long, centre array<double>")
    if not got:
        return rows.select(key, F.lit(0).cast("long").alias("centre"), F.lit(0.0).alias("sim")), table([])
    x = np.array([r.v for r in got], np.float64)
    centres = _seeds(x / np.linalg.norm(x, axis=1, keepdims=True), k, np.random.default_rng(seed))
    for _ in range(rounds):
        near = assign_to_centres(rows, key, "v", table(centres), "grp")
        near = stage(near, "assigned")
        means = group_means(rows.join(near.withColumnRenamed("centre", "grp"), key), "grp", "v").collect()  # k rows
        new = np.zeros_like(centres)
        for r in means:
            new[r.grp] = r.centre
        lost = np.flatnonzero(~new.any(axis=1))
        if len(lost):
            far = near.orderBy("sim", key).limit(len(lost)).join(rows, key).select("sim", key, "v").orderBy("sim", key).collect()  # as many as centres were lost
            for i, r in zip(lost, far):
                v = np.array(r.v, np.float64)
                new[i] = v / np.linalg.norm(v)
        shift = float(np.abs(new - centres).max())
        centres = new
        if shift <= tolerance and not len(lost):
            break
    return assign_to_centres(rows, key, "v", table(centres), "grp"), table(centres).withColumnRenamed("grp", "centre_id")
