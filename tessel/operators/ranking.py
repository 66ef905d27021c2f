"""Keyword and vector retrieval, fusion of rankings, reranking, pools and quotas."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K, BONUS = 60, (0.05, 0.02, 0.02)


def index_words(text: Column) -> Column:
    """ASCII words in lower case; other letters divide words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def bm25(df: DataFrame, key: str, project: str, title: Column, body: Column, terms: list[str], weights: tuple[float, float] = (3.0, 1.0)) -> DataFrame:
    """Rows (key, project, score) of the rows with any of the terms, the greatest score best.

    A term's frequency weighs its occurrences in title and body; length is that of both; the number of rows, of rows with a term, and the
    mean length are those of the project, so scores of several projects may be merged. One scan counts, one small aggregate joins back.
    """
    n = {t: i for i, t in enumerate(dict.fromkeys(terms))}
    words = df.select(key, project, index_words(title).alias("_t"), index_words(body).alias("_b"))
    count = lambda c, t: F.size(F.filter(c, lambda w: w == t)).cast("double")
    tf = [(count("_t", t) * weights[0] + count("_b", t) * weights[1]).alias(f"_f{i}") for t, i in n.items()]
    held = [(F.array_contains("_t", t) | F.array_contains("_b", t)).alias(f"_h{i}") for t, i in n.items()]
    rows = words.select(key, project, (F.size("_t") + F.size("_b")).alias("_n"), *tf, *held)
    stats = rows.groupBy(project).agg(F.count("*").alias("_docs"), F.avg("_n").alias("_avg"), *[F.count_if(f"_h{i}").alias(f"_d{i}") for i in n.values()])
    rows = rows.where(" or ".join(f"_f{i} > 0" for i in n.values())).join(stats, project)
    idf = lambda i: F.greatest(F.log((F.col("_docs") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5)), F.lit(IDF_FLOOR))
    part = lambda i: idf(i) * F.col(f"_f{i}") * (K1 + 1) / (F.col(f"_f{i}") + K1 * (1 - B + B * F.col("_n") / F.col("_avg")))
    return rows.select(key, project, sum((part(i) for i in n.values()), F.lit(0.0)).alias("score"))


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows with their ``rank``; only k rows meet in one task."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def fuse(lists: DataFrame, key: str, k: int = RRF_K, bonus: tuple[float, ...] = BONUS) -> DataFrame:
    """Reciprocal rank fusion of rows (list, key, rank): (key, score, bonus, best list and rank). The greatest bonus of any list counts."""
    extra = F.lit(0.0)
    for i, b in reversed(list(enumerate(bonus, 1))):
        extra = F.when(F.col("rank") == i, b).otherwise(extra)
    rows = lists.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.max(extra).alias("bonus"), F.min(F.struct("list", "rank")).alias("first"))
    return rows.select(key, (F.col("rrf") + F.col("bonus")).alias("score"), "rrf", "bonus", F.col("first.list").alias("first_list"), F.col("first.rank").alias("first_rank"))


def best_per(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def pool(ranked: DataFrame, group: str, size: int = 30) -> DataFrame:
    """Rows of rank ``size`` or better, and the best one of each group that has none among them."""
    first = F.row_number().over(W.partitionBy(group).orderBy("rank"))
    return ranked.withColumn("_n", first).where((F.col("rank") <= size) | (F.col("_n") == 1)).drop("_n")


def blend(rank: Column, fused: Column, top_score: Column, rerank: Column) -> Column:
    """Fused over its maximum and rerank, weighted by the fused rank: .75 to 3, .6 to 10, .4 beyond."""
    w = F.when(rank <= 3, 0.75).when(rank <= 10, 0.6).otherwise(0.4)
    return w * fused / top_score + (1 - w) * rerank


def zscore(value: Column, window, floor: float | None = None) -> Column:
    """Standard score by the population deviation, of values no lower than max + floor where a floor is given."""
    if floor is not None:
        value = F.greatest(value, F.max(value).over(window) + floor)
    return (value - F.avg(value).over(window)) / (F.stddev_pop(value).over(window) + 1e-9)


def quota(ranked: DataFrame, group: str, per_group: int, k: int, *order: Column) -> DataFrame:
    """The first k rows of which at most ``per_group`` are of one group."""
    w = W.partitionBy(group).orderBy(*order)
    return ranked.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_group).drop("_n").orderBy(*order).limit(k)


def _scan(held, k: int):
    def run(batches):
        keys, q, groups = held.value
        for batch in batches:
            v = batch.column("v")
            ok = np.flatnonzero(v.value_lengths().to_numpy(zero_copy_only=False) == q.shape[1])
            if not len(ok):
                continue
            x = np.stack([np.asarray(r, np.float64) for r in v.take(pa.array(ok)).to_pylist()])
            norm = np.linalg.norm(x, axis=1)
            s = q @ np.where(norm[:, None] > 0, x / np.where(norm > 0, norm, 1)[:, None], 0).T
            mine = batch.column("key").to_numpy()[ok]
            s[keys[:, None] == mine[None, :]] = -9
            if groups is not None:
                s[groups[:, None] != batch.column("grp").to_numpy()[ok][None, :]] = -9
            for i in range(len(keys)):
                n = min(k, len(mine))
                floor = -np.partition(-s[i], n - 1)[n - 1]
                at = np.flatnonzero((s[i] >= floor) & (s[i] > -8))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), keys[i])), pa.array(mine[at]), pa.array(s[i][at])], names=["query", "key", "sim"])

    return run


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, group: str | None = None, block: int = 1024) -> DataFrame:
    """Exact search of a stated set of query vectors: the k most similar other rows of each, (query, key, sim, rank); ties by key.

    Queries go in blocks of ``block``, one scan of the rows for each; a task passes on k rows (and their ties) a query and batch. With
    ``group``, only rows of the query's group count. Vectors of another length than the query's are left out, zero vectors have sim 0.
    """
    spark = rows.sparkSession
    names = [F.col(key).alias("key"), F.col(vector).alias("v"), *([F.col(group).cast("long").alias("grp")] if group else [])]
    got = queries.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(*names).orderBy("key").toLocalIterator()
    out, held = None, []

    def scanned(held):
        x = np.array([r.v for r in held], np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        g = np.array([r.grp for r in held]) if group else None
        shared = spark.sparkContext.broadcast((np.array([r.key for r in held]), x, g))
        return rows.where(F.col(key).isNotNull()).select(*names).mapInArrow(_scan(shared, k), "query long, key long, sim double")

    for r in got:
        held.append(r)
        if len(held) == block:
            out = scanned(held) if out is None else out.unionByName(scanned(held))
            held = []
    if held:
        out = scanned(held) if out is None else out.unionByName(scanned(held))
    if out is None:
        return spark.createDataFrame([], "query long, key long, sim double, rank int")
    first = W.partitionBy("query").orderBy(F.desc("sim"), "key")
    return out.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
