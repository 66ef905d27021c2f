"""Measures of scores against truths. Scores are counted by value first, so only distinct values are ever ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def confusion(df: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, tn, precision, recall); a score at the threshold counts as yes, null scores and truths don't count."""
    rows = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
    yes = lambda c: F.col(score) >= c
    t = F.col(truth)
    sums = [n.alias(f"{k}{i}") for i, c in enumerate(thresholds) for k, n in (("tp", F.count_if(yes(c) & t)), ("fp", F.count_if(yes(c) & ~t)), ("fn", F.count_if(~yes(c) & t)), ("tn", F.count_if(~yes(c) & ~t)))]
    each = F.array(*[F.struct(F.lit(c).alias("threshold"), *[F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "fn", "tn")]) for i, c in enumerate(thresholds)])
    out = rows.agg(*sums).select(F.explode(each).alias("x")).select("x.*")
    share = lambda a, b: F.when(F.col(b) + F.col(a) > 0, F.col(a) / (F.col(a) + F.col(b)))
    return out.select("threshold", "tp", "fp", "fn", "tn", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"))


def roc(df: DataFrame, score: str, truth: str, buckets: int = 64) -> DataFrame:
    """(score, yes, no, tp, fp): at each distinct score the rows with it, and those with it or a greater one.

    The distinct scores are cut into ranges of equal width, whose sums come first, so no task orders all of them.
    """
    t = F.col(truth)
    g = df.where(F.col(score).isNotNull() & t.isNotNull()).groupBy(score).agg(F.count_if(t).alias("yes"), F.count_if(~t).alias("no"))
    ends = g.agg(F.min(score).alias("_low"), F.max(score).alias("_high"))  # one row
    g = g.crossJoin(F.broadcast(ends)).withColumn("_b", F.when(F.col("_high") > F.col("_low"), F.floor((F.col(score) - F.col("_low")) / (F.col("_high") - F.col("_low")) * buckets)).otherwise(0))
    sums = g.groupBy("_b").agg(F.sum("yes").alias("_y"), F.sum("no").alias("_n"))
    over = W.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)  # of the ranges' sums
    sums = sums.select("_b", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}_before") for c in ("_y", "_n")])
    inner = W.partitionBy("_b").orderBy(F.desc(score))
    g = g.select(score, "yes", "no", "_b", F.sum("yes").over(inner).alias("_iy"), F.sum("no").over(inner).alias("_in")).join(F.broadcast(sums), "_b")
    return g.select(score, "yes", "no", (F.col("_iy") + F.col("_y_before")).alias("tp"), (F.col("_in") + F.col("_n_before")).alias("fp"))


def auroc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """One row (auroc): the share of (yes, no) pairs in the right order, ties half; null where a class is empty."""
    r = roc(df, score, truth)
    # a no with this score comes after all greater yes rows, and ties with half of its own
    won = F.sum(F.col("no") * (F.col("tp") - F.col("yes")) + F.col("no") * F.col("yes") / 2.0)
    pairs = F.sum("yes").cast("double") * F.sum("no")
    return r.agg(F.when(pairs > 0, won / pairs).alias("auroc"))


def picked(df: DataFrame, value: str, places: dict[str, str]) -> DataFrame:
    """One row: the values at zero-based places of the order, each an expression of n, the number of rows."""
    g = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    total = g.agg(F.sum("_c").alias("n"))  # one row
    upto = F.sum("_c").over(W.orderBy(value))
    g = g.withColumn("_upto", upto).crossJoin(F.broadcast(total))
    return g.agg(*[F.min(F.when((F.col("_upto") > F.expr(e)) & (F.col("_upto") - F.col("_c") <= F.expr(e)), F.col(value))).alias(k) for k, e in places.items()])


def canary_passed(hits: Column, expected: Column) -> Column:
    """Whether any of the expected strings stands in the titles and addresses of the hits (both arrays), in any letter case."""
    hay = F.lower(F.array_join(hits, " "))
    return F.exists(expected, lambda x: F.contains(hay, F.lower(x)))
