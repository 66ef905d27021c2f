"""Chunk tables: current rows, differences, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def current(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that is greatest by ``order`` (nulls last), one of them where several are equal. Null keys are dropped."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order]))
    return df.where(F.col(key).isNotNull()).withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows (key, action): added, changed, deleted or unchanged, by key and content digest; both sides unique by key."""
    o, n = (d.select(key, F.col(digest).alias(x), F.lit(True).alias(f"in_{x}")) for d, x in ((old, "o"), (new, "n")))
    action = F.when(F.col("in_o").isNull(), "added").when(F.col("in_n").isNull(), "deleted").when(F.col("o").eqNullSafe(F.col("n")), "unchanged").otherwise("changed")
    return o.join(n, key, "full").select(key, action.alias("action"))


def upsert(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``changes`` in place of, or added to, those of the same key."""
    return old.join(changes.select(key), key, "left_anti").unionByName(changes)


def middle_cut(text: Column, head: int, tail: int, marker: str = "\n[...]\n") -> Column:
    """A text of more than head + tail characters without its middle."""
    return F.when(F.length(text) > head + tail, F.concat(F.substring(text, 1, head), F.lit(marker), F.substring(text, -tail, tail))).otherwise(text)
