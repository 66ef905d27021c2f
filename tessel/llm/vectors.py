"""Vectors in Spark rows: which are usable, how they travel, and exact copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.plans.staging import numbered, stage


def encode(v: np.ndarray) -> bytes:
    """float32 bytes, or half as many where float16 loses nothing."""
    with np.errstate(over="ignore"):
        short = v.astype(np.float16)
    return short.tobytes() if np.array_equal(short.astype(np.float32), v) else v.astype(np.float32).tobytes()


def raw(rows: list[bytes], size: int, kind=np.float64) -> np.ndarray:
    """Encoded rows as numbers, one row a line, scaled so that neither tiny nor huge ones leave the range of float32."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.empty((len(rows), size), kind)
    for short, held in ((True, np.float16), (False, np.float32)):
        at = np.flatnonzero((lengths == 2 * size) == short)
        if len(at):
            out[at] = np.frombuffer(b"".join(rows if len(at) == len(rows) else [rows[i] for i in at]), held).reshape(-1, size)
    out /= np.maximum(np.abs(out).max(axis=1, keepdims=True), np.finfo(np.float32).tiny)
    return out


def decode(rows: list[bytes], size: int) -> np.ndarray:
    """Unit vectors of encoded rows, one a line."""
    out = raw(rows, size, np.float32)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _encoded(key: str, vector: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(vector)
            lengths = v.value_lengths().to_numpy(zero_copy_only=False)
            starts = v.offsets.to_numpy()[:-1]
            flat = v.values.to_numpy(zero_copy_only=False).astype(np.float32)
            keys, out, digests = [], [], []
            for k, at, n in zip(batch.column(key).to_pylist(), starts, lengths):
                if n != size:  # a null vector's length is null, which equals no size
                    continue
                x = flat[at : at + size]
                if not np.isfinite(x).all() or not x.any():
                    continue
                b = encode(x)
                keys.append(k)
                out.append(b)
                digests.append(xxhash.xxh3_128_digest(b))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(key).type), pa.array(out, pa.binary()), pa.array(digests, pa.binary())], names=["key", "v", "digest"])

    return run


def usable_vectors(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Rows (key, v, digest, row): one per key that has a vector of ``size`` numbers, none null, NaN or infinite and not all zero.

    Null keys are ignored. Among several usable vectors of a key the one with the least encoding counts, so repeats have no effect.
    Vectors are written once, with the numbers of their rows, and are not shuffled.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(key).isNotNull() & (F.size(vector) == size)).select(key, vector)
    out = rows.mapInArrow(_encoded(key, vector, size), f"key {kind}, v binary, digest binary").withColumn("row", F.monotonically_increasing_id())
    out = stage(out, "vectors")
    return numbered(out, stage(out.groupBy("key").agg(F.min(F.struct("digest", "row")).alias("x")).select("x.row"), "usable"))


def copies_of(points: DataFrame) -> DataFrame:
    """Rows (key, rep, copies) of the points whose vector others have too; ``rep`` is the least of their keys. Only narrow rows move."""
    named = points.select("key", "digest")
    shared = named.groupBy("digest").agg(F.min("key").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    return stage(named.join(shared, "digest").select("key", "rep", "copies"), "copies")


def first_copies(points: DataFrame, copied: DataFrame) -> DataFrame:
    """Rows (key, v, mass): each distinct vector once, under its least key, and how many points have it."""
    rows = points.select("key", "v").join(copied, "key", "left").where("rep is null or rep = key")
    return rows.select("key", "v", F.coalesce("copies", F.lit(1)).cast("double").alias("mass"))
