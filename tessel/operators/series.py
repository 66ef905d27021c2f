"""Time series and ordered sums that no single task has to order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def filled_series(df: DataFrame, time: str, kind: str, unit: str) -> DataFrame:
    """(bucket, kind, n): rows per day or Monday week and kind, with zeros where there are none between the first and the last bucket.

    Rows with a null time or kind don't count. Counting comes first; the calendar is made from the counts, of which there are few.
    """
    n = df.where(F.col(time).isNotNull() & F.col(kind).isNotNull()).groupBy(F.to_date(F.date_trunc(unit, F.col(time))).alias("bucket"), kind).agg(F.count("*").alias("n"))
    step = F.expr("interval 1 day" if unit == "day" else "interval 7 days")
    days = n.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", step)).alias("bucket"))
    grid = days.crossJoin(n.select(kind).distinct())
    return grid.join(n, ["bucket", kind], "left").select(F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), kind, F.coalesce("n", F.lit(0)).alias("n"))


def running_total(df: DataFrame, by: list[str], part: Column, order: list[str], value: str, to: str) -> DataFrame:
    """``df`` with ``to``: the sum of ``value`` of the rows of its group up to and with it, by ``part`` and then ``order``.

    ``part`` rises with the order and cuts a group into pieces, a day for example: pieces are summed first, so that a group with most of
    the rows is ordered piece by piece. ``order`` must be total within a group.
    """
    rows = df.withColumn("_part", part)
    inner = F.sum(value).over(W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    sums = rows.groupBy(*by, "_part").agg(F.sum(value).alias("_s"))
    before = F.coalesce(F.sum("_s").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_in", inner).join(sums.select(*by, "_part", before.alias("_before")), [*by, "_part"]).withColumn(to, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")
