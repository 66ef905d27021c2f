"""Queries on the quality of scores and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessel.operators import metrics
from tessel.plans.graph import QUERIES as _GRAPH
from tessel.plans.registry import Registry
from tessel.plans.similar import _ITEMS, _PAIRS, items, pairs
from tessel.sources.tables import table

QUERIES = Registry()

#: A score and a truth that both engines compute alike: a document's size, and whether it is from the largest project.
_L = "l AS (SELECT doc_id, (n_chars % 1000) / 1000.0::DOUBLE AS p, starts_with(lower(trim(source)), 'forge/') AS t FROM documents WHERE n_chars IS NOT NULL AND source IS NOT NULL)"


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents", "doc_id", "n_chars", "source").where("n_chars is not null and source is not null")
    return d.select("doc_id", ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("p"), F.lower(F.trim("source")).startswith("forge/").alias("t"))


@QUERIES.add(
    "triage_precision_recall",
    f"""WITH {_L} SELECT c AS threshold, count(*) FILTER (p >= c AND t) AS tp, count(*) FILTER (p >= c AND NOT t) AS fp, count(*) FILTER (p < c AND t) AS fn, count(*) FILTER (p < c AND NOT t) AS tn,
count(*) FILTER (p >= c AND t)::DOUBLE / nullif(count(*) FILTER (p >= c), 0) AS precision, count(*) FILTER (p >= c AND t)::DOUBLE / nullif(count(*) FILTER (t), 0) AS recall FROM l, (VALUES (0.2::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) x(c) GROUP BY c""",
)
def triage_precision_recall(spark: SparkSession, folder: str) -> DataFrame:
    """The confusion counts at three thresholds, in one scan."""
    return metrics.confusion(_labelled(spark, folder), "p", "t", [0.2, 0.5, 0.9])


@QUERIES.add(
    "triage_auroc",
    f"WITH {_L}, r AS (SELECT t, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM l) SELECT (sum(r) FILTER (t) - count(*) FILTER (t) * (count(*) FILTER (t) + 1) / 2.0::DOUBLE) / (count(*) FILTER (t)::DOUBLE * count(*) FILTER (NOT t)) AS auroc FROM r",
)
def triage_auroc(spark: SparkSession, folder: str) -> DataFrame:
    """Area under the curve by rank sums, ties at their average rank."""
    return metrics.auroc(_labelled(spark, folder), "p", "t")


@QUERIES.add("roc_curve", f"WITH {_L}, g AS (SELECT p, count(*) FILTER (t) AS a, count(*) FILTER (NOT t) AS b FROM l GROUP BY p) SELECT p, (sum(a) OVER (ORDER BY p DESC))::BIGINT AS tp, (sum(b) OVER (ORDER BY p DESC))::BIGINT AS fp FROM g")
def roc_curve(spark: SparkSession, folder: str) -> DataFrame:
    """True and false positives at every distinct score."""
    return metrics.roc(_labelled(spark, folder), "p", "t").select("p", "tp", "fp")


@QUERIES.add("triage_mistakes", f"WITH {_L} SELECT doc_id, p, t FROM l WHERE (p >= 0.5) <> t ORDER BY doc_id DESC LIMIT 40")
def triage_mistakes(spark: SparkSession, folder: str) -> DataFrame:
    """the last forty that the threshold gets wrong."""
    return _labelled(spark, folder).where((F.col("p") >= 0.5) != F.col("t")).orderBy(F.desc("doc_id")).limit(40)


@QUERIES.add("tier_band", f"WITH {_L} SELECT doc_id, CASE WHEN p < 0.2 THEN 'no' WHEN p > 0.9 THEN 'yes' ELSE 'ask' END AS tier FROM l")
def tier_band(spark: SparkSession, folder: str) -> DataFrame:
    """sure, unsure or neither."""
    return _labelled(spark, folder).select("doc_id", F.when(F.col("p") < 0.2, "no").when(F.col("p") > 0.9, "yes").otherwise("ask").alias("tier"))


@QUERIES.add("expected_score", f"WITH {_L} SELECT doc_id, 0 * (1 - p) * (1 - p) + 2 * p * (1 - p) + 4 * p * p - 2 AS expected FROM l")
def expected_score(spark: SparkSession, folder: str) -> DataFrame:
    """The expected grade of three options' probabilities, less two."""
    q = F.array((1 - F.col("p")) * (1 - F.col("p")), 2 * F.col("p") * (1 - F.col("p")), F.col("p") * F.col("p"))
    grade = F.array(F.lit(0.0), F.lit(1.0), F.lit(4.0))
    return _labelled(spark, folder).select("doc_id", (F.aggregate(F.zip_with(q, grade, lambda x, k: x * k), F.lit(0.0), lambda a, x: a + x) - 2).alias("expected"))


@QUERIES.add("weighted_mean", "SELECT lower(trim(source)) AS source, sum(n_chars * (doc_id % 100))::DOUBLE / sum(n_chars) AS mean FROM documents WHERE n_chars > 0 AND source IS NOT NULL GROUP BY 1")
def weighted_mean(spark: SparkSession, folder: str) -> DataFrame:
    """A mean weighted by characters."""
    d = table(spark, folder, "documents", "doc_id", "n_chars", "source").where("n_chars > 0 and source is not null")
    return d.groupBy(F.lower(F.trim("source")).alias("source")).agg((F.sum(F.col("n_chars") * (F.col("doc_id") % 100)).cast("double") / F.sum("n_chars")).alias("mean"))


@QUERIES.add("source_median", "SELECT lower(trim(source)) AS source, median(n_chars)::DOUBLE AS median FROM documents WHERE n_chars IS NOT NULL AND source IS NOT NULL GROUP BY 1")
def source_median(spark: SparkSession, folder: str) -> DataFrame:
    """Exact medians; counts of equal sizes are merged before the shuffle."""
    d = table(spark, folder, "documents", "n_chars", "source").where("n_chars is not null and source is not null")
    return d.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.percentile("n_chars", 0.5).alias("median"))


@QUERIES.add(
    "verdict_classes",
    f"WITH {_L} SELECT CASE WHEN p < 0.2 THEN 'no' WHEN p > 0.9 THEN 'yes' ELSE 'ask' END AS tier, count(*) FILTER (t) AS is_true, count(*) FILTER (NOT t) AS is_false FROM l GROUP BY 1",
)
def verdict_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts against classes, as a pivot."""
    rows = _labelled(spark, folder).select("t", F.when(F.col("p") < 0.2, "no").when(F.col("p") > 0.9, "yes").otherwise("ask").alias("tier"))
    out = rows.groupBy("tier").pivot("t", [True, False]).count()
    return out.select("tier", F.coalesce("true", F.lit(0)).alias("is_true"), F.coalesce("false", F.lit(0)).alias("is_false"))


# ---- rankings: the known partners of an item, the most similar first; a partner of the item's own cluster is the right answer ------

_RANKED = f"""WITH {_ITEMS}, {_PAIRS}, o AS (SELECT a AS q, b AS d, sim FROM pr UNION ALL SELECT b, a, sim FROM pr),
rk AS (SELECT q, d, x.kind AS kind, row_number() OVER (PARTITION BY q ORDER BY sim DESC NULLS LAST, d) AS rank, row_number() OVER (PARTITION BY q ORDER BY d) AS base, coalesce(x.kind = y.kind, FALSE) AS good FROM o JOIN it x ON x.idx = q JOIN it y ON y.idx = d),
fr AS (SELECT q, kind, min(rank) FILTER (good) AS rank, min(base) FILTER (good) AS base FROM rk GROUP BY ALL)"""


def _first(spark: SparkSession, folder: str) -> DataFrame:
    """Per item the rank of the first partner of its kind: by similarity, and by number alone."""
    p = pairs(spark, folder)
    end = lambda x, y: F.struct(F.col(x).alias("q"), F.col(y).alias("d"))
    o = p.select(F.explode(F.array(end("a", "b"), end("b", "a"))).alias("x"), "sim").select("x.*", "sim")
    i = items(spark, folder).select("idx", "kind")
    o = o.join(i.toDF("q", "kind"), "q").join(i.toDF("d", "other"), "d")
    w = W.partitionBy("q")
    o = o.withColumn("rank", F.row_number().over(w.orderBy(F.col("sim").desc_nulls_last(), "d"))).withColumn("base", F.row_number().over(w.orderBy("d")))
    good = F.coalesce(F.col("kind") == F.col("other"), F.lit(False))
    return o.groupBy("q", "kind").agg(F.min(F.when(good, F.col("rank"))).alias("rank"), F.min(F.when(good, F.col("base"))).alias("base"))


@QUERIES.add("recall_at_k", _RANKED + " SELECT kind, count(*) AS questions, avg((coalesce(rank, 99) <= 1)::INT) AS at_1, avg((coalesce(rank, 99) <= 5)::INT) AS at_5 FROM fr GROUP BY kind")
def recall_at_k(spark: SparkSession, folder: str) -> DataFrame:
    """Questions answered within the first and the first five."""
    at = lambda k: F.avg((F.coalesce("rank", F.lit(99)) <= k).cast("int")).alias(f"at_{k}")
    return _first(spark, folder).groupBy("kind").agg(F.count("*").alias("questions"), at(1), at(5))


@QUERIES.add("mrr", _RANKED + " SELECT kind, floor(avg(coalesce(1.0::DOUBLE / rank, 0.0)) * 1000000 + 0.5)::BIGINT AS millionths FROM fr GROUP BY kind")
def mrr(spark: SparkSession, folder: str) -> DataFrame:
    """Mean reciprocal rank, a miss counting nothing."""
    return _first(spark, folder).groupBy("kind").agg(F.floor(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))) * 1e6 + 0.5).alias("millionths"))


@QUERIES.add("rank_better_worse", _RANKED + " SELECT count(*) FILTER (coalesce(rank, 99) < coalesce(base, 99)) AS better, count(*) FILTER (coalesce(rank, 99) > coalesce(base, 99)) AS worse, count(*) FILTER (coalesce(rank, 99) = coalesce(base, 99)) AS same FROM fr")
def rank_better_worse(spark: SparkSession, folder: str) -> DataFrame:
    """Questions for which the one ranking is better than the other, misses last."""
    r, b = F.coalesce("rank", F.lit(99)), F.coalesce("base", F.lit(99))
    return _first(spark, folder).agg(F.count_if(r < b).alias("better"), F.count_if(r > b).alias("worse"), F.count_if(r == b).alias("same"))


@QUERIES.add("overlap_terciles", "WITH e AS (" + _GRAPH["eval_pairs"].sql + ") SELECT min(shared) FILTER (k = n // 3) AS low, min(shared) FILTER (k = 2 * n // 3) AS high FROM (SELECT shared, row_number() OVER (ORDER BY shared) - 1 AS k, count(*) OVER () AS n FROM e)")
def overlap_terciles(spark: SparkSession, folder: str) -> DataFrame:
    """The values at a third and two thirds of the order. Equal values are counted first, so only distinct ones are ordered."""
    e = _GRAPH["eval_pairs"].run(spark, folder)
    return metrics.picked(e, "shared", {"low": "floor(n / 3)", "high": "floor(2 * n / 3)"})


@QUERIES.add("win_rate", _RANKED + ", w AS (SELECT x.rank < y.rank AS win FROM rk x JOIN rk y ON x.q = y.q AND x.good AND NOT y.good) SELECT count(*) AS pairs, avg(win::INT) AS rate FROM w")
def win_rate(spark: SparkSession, folder: str) -> DataFrame:
    """How often a right partner stands before a wrong one of the same item. Counted from ranks, so no pairs are made."""
    p = pairs(spark, folder)
    end = lambda x, y: F.struct(F.col(x).alias("q"), F.col(y).alias("d"))
    o = p.select(F.explode(F.array(end("a", "b"), end("b", "a"))).alias("x"), "sim").select("x.*", "sim")
    i = items(spark, folder).select("idx", "kind")
    o = o.join(i.toDF("q", "kind"), "q").join(i.toDF("d", "other"), "d").withColumn("bad", 1 - F.coalesce(F.col("kind") == F.col("other"), F.lit(False)).cast("int"))
    w = W.partitionBy("q")
    after = F.sum("bad").over(w) - F.sum("bad").over(w.orderBy(F.col("sim").desc_nulls_last(), "d").rowsBetween(W.unboundedPreceding, 0))
    rows = o.select("bad", after.alias("won"), F.sum("bad").over(w).alias("all_bad")).where("bad = 0")
    return rows.agg(F.coalesce(F.sum("all_bad"), F.lit(0)).alias("pairs"), (F.sum("won") / F.sum("all_bad")).alias("rate"))
