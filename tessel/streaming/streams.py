"""Streaming variants: tumbling counts, sessions, idle timeouts and idempotent upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessel.operators.store import current
from tessel.sources.feeds import absent, publish, published


def tumbling_counts(stream: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, kind, n): rows of a window and kind; rows later than ``late`` are dropped."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), kind, "n")


def session_counts(stream: DataFrame, time: str, key: str, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(key, start, finish, n): sessions of rows less than ``gap`` apart."""
    s = stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("n"))
    return s.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("finish"), "n")


def first_deliveries(stream: DataFrame, time: str, *keys: str, late: str = "1 day") -> DataFrame:
    """Rows without repeats of their keys within the watermark, as a forward cursor needs that reads its last rows again."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def idle_keys(stream: DataFrame, time: str, key: str, ttl_ms: int, late: str = "1 hour") -> DataFrame:
    """(key, last, n): a row for each key once it has been idle for ``ttl_ms`` of event time; its state ends with it."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "last": [pd.Timestamp(last, unit="us")], "n": [n]})
            return
        last, n = state.get if state.exists else (0, 0)
        for b in batches:
            last = max(last, int(b[time].max().value // 1000))
            n += len(b)
        state.update((last, n))
        state.setTimeoutTimestamp(max(last // 1000 + ttl_ms, state.getCurrentWatermarkMs() + 1))

    rows = stream.select(key, time).withWatermark(time, late)
    kind = stream.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, last timestamp, n long", "last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def upserting(path: str, key: str, order: str, compact_every: int = 20):
    """A ``foreachBatch`` function that keeps the newest row of each key; ``upserted`` reads the table.

    A batch only writes its own newest rows, as the change of its epoch, so its cost is that of the batch; a batch run twice writes
    the same change again. Every ``compact_every`` epochs the changes are merged into a new version of the whole table.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        current(batch, key, order).write.mode("overwrite").parquet(f"{path}/changes/epoch={epoch}")
        if (epoch + 1) % compact_every == 0:
            publish(upserted(spark, path, key, order), path, {"upto": epoch})

    return write


def upserted(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """The newest row of each key: the last version of the table and the changes of later epochs."""
    base = published(spark, path)
    upto = base[1]["upto"] if base else -1
    try:
        changes = spark.read.parquet(f"{path}/changes").where(F.col("epoch") > upto).drop("epoch")
    except AnalysisException as e:
        if not absent(e):
            raise
        if base is None:
            raise ValueError(f"nothing was written to {path}") from e
        return base[0]
    return current(base[0].unionByName(changes) if base else changes, key, order)
