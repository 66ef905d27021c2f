"""References to records that do not exist.

A Bloom filter over the parents' keys, built by the executors and broadcast, proves most orphans at once. Only references that the
filter may contain are joined with the parents. The filter's size is computed from the number of keys; keys too many for ``max_bits``
are divided into parts by a hash, each with a filter of its own, and each part of the references is probed with its part's filter.
References are probed once, and the outcome is written before it is joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.plans.staging import stage

WORDS = 1 << 12


def _places(h: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """The bits of keys given their 64-bit hashes: double hashing with the halves of one more mixing (keys x hashes)."""
    h = h.view(np.uint64)
    m = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    m ^= m >> np.uint64(33)
    step = (m >> np.uint64(17)) | np.uint64(1)
    return (((h >> np.uint64(1))[:, None] + step[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def _marked(bits: int, hashes: int):
    """Sets the bits of a partition, and passes on the blocks of the filter that have any."""
    block = WORDS * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = _places(batch.column(0).to_numpy(), bits, hashes).ravel()
            for k in np.unique(at // block):
                held.setdefault(int(k), np.zeros(block, bool))[at[at // block == k] % block] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], names=["block", "bits"]
        )

    return run


def _either(part: pa.Table) -> pa.Table:
    total = np.zeros(WORDS, np.uint8)
    for b in part.column("bits").to_pylist():
        total |= np.frombuffer(b, np.uint8)
    return pa.table({"block": pa.array([part.column("block")[0].as_py()], pa.int64()), "bits": pa.array([total.tobytes()], pa.binary())})


class BloomFilter:
    """A filter over the distinct non-null 64-bit hashes of a column, held once by each executor; ``count`` is their number if known."""

    def __init__(self, hashed: DataFrame, column: str, count: int | None = None, bits_per_key: int = 12, max_bits: int = 1 << 28):
        hashed = hashed.select(F.col(column).alias("h")).where("h is not null").distinct()
        n = hashed.count() if count is None else count
        self.bits = min(max_bits, 1 << max(15, math.ceil(math.log2(max(1, n * bits_per_key)))))
        self.hashes = max(1, min(8, round(self.bits / max(1, n) * math.log(2))))
        parts = hashed.mapInArrow(_marked(self.bits, self.hashes), "block long, bits binary")
        packed = np.zeros(self.bits // 8, np.uint8)
        for row in parts.groupBy("block").applyInArrow(_either, "block long, bits binary").toLocalIterator():
            packed[row.block * WORDS : (row.block + 1) * WORDS] = np.frombuffer(row.bits, np.uint8)
        self.packed = hashed.sparkSession.sparkContext.broadcast(packed)

    def may_contain(self, hashed: Column) -> Column:
        """False where the hash is certainly absent; null for a null one."""
        packed, bits, hashes = self.packed, self.bits, self.hashes

        @F.pandas_udf("boolean")
        def held(h):
            return pd.Series(held_bits(h.to_numpy()), index=h.index)

        def held_bits(h):
            out = np.ones(len(h), bool)
            for m in _places(h, bits, hashes).T:
                out &= (packed.value[m >> 3] >> (7 - (m & 7)).astype(np.uint8) & 1).astype(bool)
            return out

        # a null would come as a float, which cannot hold a hash
        return F.when(hashed.isNotNull(), held(F.coalesce(hashed, F.lit(0))))


def spread_join(left: DataFrame, right: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Left join on ``key`` with a right side unique by it, where a few keys may hold most of the left rows.

    Keys with more than 1/``share`` of the left rows are at most ``share``; their right rows are broadcast, so the rows of a hot key
    stay where they are. All others meet in a shuffle.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    hot = [r[0] for r in counts.crossJoin(F.broadcast(total)).where(f"n * {share} > total and {key} is not null").select(key).collect()]
    if not hot:
        return left.join(right, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    rest = left.where(~is_hot).join(right.where(~is_hot), key, "left")
    return rest.unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, "left"))


def orphan_references(refs: DataFrame, ref_key: str, at: str, parents: DataFrame, parent_key: str, usable: Column, since: str, until: str, max_bits: int = 1 << 28) -> DataFrame:
    """Reference rows whose key names no parent alive at the time of the reference, with the reason.

    A parent row is alive from ``since`` until before ``until`` (null: for ever) where ``usable`` is true; a key may have several rows.
    Reasons: ``absent`` (no parent row has the key), ``unusable`` (only rows that are not usable), ``later`` (usable rows begin only
    after the reference), ``deleted`` (the others: all that began had ended).

    Defined cases: a row with a null key is no reference and is left out. With a null time in the reference only a parent's absence
    can be told from its life: nothing is alive at an unknown time. A parent with a null ``since`` never begins; parents with a null
    key are ignored. Repeated references stay repeated; columns of ``parents`` never reach the result, so names may clash.
    """
    p = parents.select(F.col(parent_key).alias("_k"), F.coalesce(usable, F.lit(False)).alias("_u"), F.col(since).alias("_s"), F.col(until).alias("_e")).where("_k is not null")
    refs = refs.where(F.col(ref_key).isNotNull()).withColumn("_k", F.col(ref_key))
    p = stage(p, "parents")
    keys = p.select("_k").distinct().count()
    parts = max(1, -(-keys * 12 // max_bits))
    hashed = lambda d: d.withColumn("_h", F.xxhash64("_k")).withColumn("_part", F.pmod(F.xxhash64("_h"), F.lit(parts)))
    known = hashed(p.select("_k"))
    if parts == 1:
        seen = stage(hashed(refs).withColumn("_maybe", BloomFilter(known, "_h", keys, max_bits=max_bits).may_contain(F.col("_h"))).drop("_h", "_part"), "probed")
    else:
        split, seen = stage(hashed(refs), "refs", "_part"), None
        for i in range(parts):  # each filter is used for its own part of the references, which is a folder of its own
            bloom = BloomFilter(known.where(F.col("_part") == i), "_h", keys // parts, max_bits=max_bits)
            part = split.where(F.col("_part") == i).withColumn("_maybe", bloom.may_contain(F.col("_h"))).drop("_h", "_part")
            seen = part if seen is None else seen.unionByName(part)
        seen = stage(seen, "probed")
    proven = seen.where("not _maybe").withColumn("reason", F.lit("absent")).drop("_maybe", "_k")
    spans = p.groupBy("_k").agg(F.collect_set(F.struct("_u", "_s", "_e")).alias("_spans"))
    checked = spread_join(seen.where("_maybe").drop("_maybe"), spans, "_k")
    t = F.col(at)
    begun = lambda x: x["_u"] & (x["_s"] <= t)
    alive = F.exists("_spans", lambda x: begun(x) & (x["_e"].isNull() | (x["_e"] > t)))
    reason = (
        F.when(F.col("_spans").isNull(), "absent")
        .when(~F.exists("_spans", lambda x: x["_u"]), "unusable")
        .when(~F.coalesce(F.exists("_spans", begun), F.lit(False)), "later")
        .otherwise("deleted")
    )
    dead = checked.where(F.col("_spans").isNull() | ~F.coalesce(alive, F.lit(False))).withColumn("reason", reason).drop("_spans", "_k")
    return proven.unionByName(dead)
