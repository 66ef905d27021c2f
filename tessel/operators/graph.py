"""The link graph: typed, weighted edges seen from both ends, degrees, neighbourhoods, expansion, stories, as-of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Edge types and their names from the other end. Fixed values.
INVERSE = {"closes": "closed_by", "merged_as": "merge_of", "mentions": "mentioned_by", "shipped_in": "ships", "touches": "touched_by", "defines": "defined_by"}
#: What a relation is worth in an expansion. Fixed values.
WEIGHT = {"closes": 1.0, "closed_by": 1.0, "merged_as": 0.9, "merge_of": 0.9, "defines": 0.6, "defined_by": 0.6, "mentions": 0.5, "mentioned_by": 0.5, "shipped_in": 0.3, "ships": 0.2, "touches": 0.15, "touched_by": 0.15}
#: Relations that a second step may take. Fixed values.
SECOND = ("closes", "closed_by", "merged_as", "merge_of")


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def best_edges(edges: DataFrame) -> DataFrame:
    """One row per (src, dst, type): the evidence with the greatest conf, of equal ones the first seen. Null ends are dropped."""
    w = W.partitionBy("src", "dst", "type").orderBy(F.col("conf").desc_nulls_last(), F.col("seen").asc_nulls_last(), F.col("how").asc_nulls_last(), F.col("snip").asc_nulls_last())
    return edges.where("src is not null and dst is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def without_subsumed(edges: DataFrame, weak: str = "mentions", strong: str = "closes") -> DataFrame:
    """Edges without the weak type between two nodes that the strong type joins as well."""
    held = edges.where(F.col("type") == strong).select("src", "dst").distinct()
    return edges.where(F.col("type") != weak).unionByName(edges.where(F.col("type") == weak).join(held, ["src", "dst"], "left_anti"))


def relations(edges: DataFrame) -> DataFrame:
    """Each edge from both ends, in one pass: (node, rel, other, conf). An unknown type keeps its name on both sides."""
    there = F.struct(F.col("src").alias("node"), F.col("type").alias("rel"), F.col("dst").alias("other"))
    back = F.struct(F.col("dst").alias("node"), F.coalesce(_lookup(INVERSE, F.col("type")), F.col("type")).alias("rel"), F.col("src").alias("other"))
    return edges.select(F.explode(F.array(there, back)).alias("x"), "conf").select("x.*", "conf")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): ends at each node, counted before anything is shuffled."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def top_neighbours(rel: DataFrame, per_relation: int = 2, total: int = 6) -> DataFrame:
    """Of each node the best neighbours: by conf and then id, a few of a relation and a few in all."""
    first = W.partitionBy("node", "rel").orderBy(F.col("conf").desc_nulls_last(), "other")
    some = rel.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_relation)
    worth = F.coalesce(_lookup(WEIGHT, F.col("rel")), F.lit(0.0))
    over = W.partitionBy("node").orderBy(worth.desc(), F.col("conf").desc_nulls_last(), "rel", "other")
    return some.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= total).drop("_n")


def expand(seeds: DataFrame, rel: DataFrame, degree: DataFrame, hub: int = 150) -> DataFrame:
    """Scores of nodes one or two steps from the seeds (seed, score): rows (node, score).

    A path is worth the seed's score times each step's weight and conf, halved for the second step, which only strong relations take
    and which never leaves a hub. The best path counts per seed, and paths from several seeds add up.
    """
    w = F.coalesce(_lookup(WEIGHT, F.col("rel")), F.lit(0.0)) * F.coalesce("conf", F.lit(0.0))
    steps = rel.select("node", "other", "rel", w.alias("w"))
    one = seeds.join(steps, F.col("seed") == F.col("node")).select("seed", F.col("other").alias("at"), (F.col("score") * F.col("w")).alias("score"))
    calm = degree.where(F.col("degree") <= hub).select(F.col("node").alias("at"))
    strong = steps.where(F.col("rel").isin(*SECOND)).select(F.col("node").alias("at"), "other", F.col("w").alias("w2"))
    two = one.groupBy("seed", "at").agg(F.max("score").alias("score")).join(calm, "at").join(strong, "at").where("other <> seed")
    two = two.select("seed", F.col("other").alias("at"), (F.col("score") * F.col("w2") * 0.5).alias("score"))
    best = one.unionByName(two).where("at <> seed").groupBy("seed", "at").agg(F.max("score").alias("score"))
    return best.groupBy(F.col("at").alias("node")).agg(F.sum("score").alias("score"))


def neighbourhood(seeds: DataFrame, rel: DataFrame, degree: DataFrame, floor: float = 0.5, hub: int = 200) -> DataFrame:
    """(seed, node): nodes within two steps, weak mentions left out, hubs not left at the second step."""
    steps = rel.where(~F.col("rel").isin("mentions", "mentioned_by") | (F.col("conf") >= floor)).select("node", "other").distinct()
    one = seeds.select("seed").distinct().join(steps, F.col("seed") == F.col("node")).select("seed", F.col("other").alias("at")).where("at <> seed").distinct()
    calm = degree.where(F.col("degree") <= hub).select(F.col("node").alias("at"))
    two = one.join(calm, "at").join(steps.withColumnRenamed("node", "at"), "at").select("seed", F.col("other").alias("at")).where("at <> seed")
    return one.unionByName(two).distinct().withColumnRenamed("at", "node")


def next_event(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str, month: int = 7) -> DataFrame:
    """``left`` with ``value`` and ``value_time`` of the first row of ``right`` at or after its ``time``, per ``by``; ties by value.

    Times are ISO strings. Months are ordered first, so a group that holds a large part of the rows is not sorted by one task: within a
    month the next event is found among the month's rows, and after its last event the first one of a later month follows.
    """
    part = F.substring(time, 1, month)
    r = right.where(F.col(time).isNotNull()).groupBy(*by, time).agg(F.min(value).alias(value))
    rows = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast("struct<t:string,v:string>")).unionByName(
        r.select(*by, time, F.lit(0).alias("_side"), F.struct(F.col(time).alias("t"), F.col(value).cast("string").alias("v")).alias("_v")), allowMissingColumns=True
    )
    ahead = W.partitionBy(*by, "_m").orderBy(F.col(time).asc(), F.col("_side").desc()).rowsBetween(0, W.unboundedFollowing)
    rows = rows.withColumn("_m", part).withColumn("_next", F.first("_v", ignorenulls=True).over(ahead)).where("_side = 1")
    firsts = r.withColumn("_m", part).groupBy(*by, "_m").agg(F.min(F.struct(F.col(time).alias("t"), F.col(value).cast("string").alias("v"))).alias("_f"))
    months = rows.select(*by, "_m").distinct().unionByName(firsts.select(*by, "_m")).distinct().join(firsts, [*by, "_m"], "left")
    later = W.partitionBy(*by).orderBy("_m").rowsBetween(1, W.unboundedFollowing)
    months = months.withColumn("_after", F.first("_f", ignorenulls=True).over(later)).drop("_f")
    got = F.coalesce("_next", "_after")
    return rows.join(months, [*by, "_m"], "left").withColumn(value, got["v"]).withColumn(f"{value}_time", got["t"]).drop("_m", "_side", "_v", "_next", "_after")


#: The confidence of a reference by where it was found.
BASE = {"github": 1.0, "git": 0.95, "title": 0.8, "body": 0.7, "commit msg": 0.7, "comment": 0.5, "review": 0.5, "closing": 0.85, "code comment": 0.9, "release note": 0.9, "tag message": 0.9, "topic": 0.7, "post": 0.5}


def edge_confidence(how: Column, certainty: Column) -> Column:
    """The base of ``how`` times the certainty of the reference, to three places; null for another ``how``."""
    return F.round(_lookup(BASE, how) * certainty, 3)


def sample_edges(edges: DataFrame, type_: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` edges of a type, the first by a hash of their ends and the seed."""
    return edges.where(F.col("type") == type_).orderBy(F.xxhash64("src", "dst", F.lit(seed)), "src", "dst").limit(n)


def strongest(edges: DataFrame) -> DataFrame:
    """Of rows (src, dst, type, conf, how, snip, known) the surest of each src, dst and type; mentions go where the two are joined by closes."""
    best = edges.groupBy("src", "dst", "type").agg(F.max(F.struct("conf", "how", "snip", "known")).alias("x")).select("src", "dst", "type", "x.*")
    closed = best.where("type = 'closes'").select("src", "dst", F.lit("mentions").alias("type"))
    return best.join(closed, ["src", "dst", "type"], "left_anti")
