"""Queries on similarity: known pairs, clusters, outliers and means of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessel.functions import text as T
from tessel.operators import ranking
from tessel.operators.vectors import assign_to_centres, group_means
from tessel.plans.base import stopped
from tessel.plans.registry import Registry
from tessel.sources.tables import table

QUERIES = Registry()

_ITEMS = """it AS (SELECT * FROM items WHERE idx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY idx ORDER BY project DESC NULLS LAST, kind DESC NULLS LAST, state DESC NULLS LAST, created DESC NULLS LAST, number DESC NULLS LAST, title DESC NULLS LAST, cluster DESC NULLS LAST) = 1)"""
_PAIRS = "pr AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(sim) AS sim FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b GROUP BY 1, 2)"


def items(spark: SparkSession, folder: str) -> DataFrame:
    """One row an item."""
    order = ("project", "kind", "state", "created", "number", "title", "cluster")
    t = table(spark, folder, "items", "idx", *order).where("idx is not null")
    w = W.partitionBy("idx").orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return t.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Known pairs a < b with the greatest similarity recorded."""
    p = table(spark, folder, "pairs", "a", "b", "sim").where("a is not null and b is not null and a <> b")
    return p.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sim").alias("sim"))


def _sides(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs with the items of both sides, their columns prefixed a_ and b_."""
    i = items(spark, folder)
    side = lambda x: i.select(F.col("idx").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("project", "kind", "state", "number", "title", "cluster")])
    return pairs(spark, folder).join(side("a"), "a").join(side("b"), "b")


_OPEN = "coalesce(lower(trim({s}.state)), 'open') NOT IN ('closed', 'merged')"
_VIEW = f"""WITH {_ITEMS}, {_PAIRS}, v AS (SELECT pr.a, pr.b, pr.sim FROM pr JOIN it x ON x.idx = pr.a JOIN it y ON y.idx = pr.b
WHERE sim >= 0.9 AND x.kind = y.kind AND ({_OPEN.format(s='x')} OR {_OPEN.format(s='y')}) AND NOT coalesce(x.project = y.project AND abs(x.number - y.number) <= 3, FALSE))"""


def _view(spark: SparkSession, folder: str) -> DataFrame:
    is_open = lambda s: ~F.coalesce(F.lower(F.trim(f"{s}_state")), F.lit("open")).isin("closed", "merged")
    adjacent = F.coalesce((F.col("a_project") == F.col("b_project")) & (F.abs(F.col("a_number") - F.col("b_number")) <= 3), F.lit(False))
    return _sides(spark, folder).where((F.col("sim") >= 0.9) & (F.col("a_kind") == F.col("b_kind")) & (is_open("a") | is_open("b")) & ~adjacent).select("a", "b", "sim")


@QUERIES.add("duplicates_view", _VIEW + " SELECT a, b, sim FROM v")
def duplicates_view(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of one kind with a side still open, neighbours by number left out."""
    return _view(spark, folder)


@QUERIES.add("paged_duplicates", _VIEW + " SELECT a, b, (SELECT count(*) FROM v) AS total FROM v ORDER BY sim DESC, a, b LIMIT 20 OFFSET 20")
def paged_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """L2: the second page of 20, with the number of all."""
    v = _view(spark, folder)
    return v.orderBy(F.desc("sim"), "a", "b").offset(20).limit(20).select("a", "b").crossJoin(v.agg(F.count("*").alias("total")))


@QUERIES.add("twins_top2", f"WITH {_PAIRS}, o AS (SELECT a AS idx, b AS twin, sim FROM pr UNION ALL SELECT b, a, sim FROM pr) SELECT idx, twin, row_number() OVER (PARTITION BY idx ORDER BY sim DESC NULLS LAST, twin) AS rank FROM o QUALIFY rank <= 2")
def twins_top2(spark: SparkSession, folder: str) -> DataFrame:
    """The two most similar items of each."""
    p = pairs(spark, folder)
    end = lambda x, y: F.struct(F.col(x).alias("idx"), F.col(y).alias("twin"))
    o = p.select(F.explode(F.array(end("a", "b"), end("b", "a"))).alias("x"), "sim").select("x.*", "sim")
    rank = F.row_number().over(W.partitionBy("idx").orderBy(F.col("sim").desc_nulls_last(), "twin"))
    return o.select("idx", "twin", rank.cast("long").alias("rank")).where("rank <= 2")


@QUERIES.add(
    "cluster_view",
    f"""WITH {_ITEMS} SELECT cluster, count(*) AS size, count(*) FILTER (coalesce(lower(trim(state)), 'open') NOT IN ('closed', 'merged')) AS open_items, count(*) FILTER (created >= '2024') AS recent,
count(DISTINCT project) AS projects, count(*) FILTER (created >= '2024') * (SELECT count(*) FROM it)::DOUBLE / (count(*) * greatest((SELECT count(*) FROM it WHERE created >= '2024'), 1)) AS trend FROM it WHERE cluster IS NOT NULL GROUP BY cluster""",
)
def cluster_view(spark: SparkSession, folder: str) -> DataFrame:
    """Size, open and recent items of each cluster, and its share of the recent ones against its share of all."""
    i = items(spark, folder).withColumn("is_open", ~F.coalesce(F.lower(F.trim("state")), F.lit("open")).isin("closed", "merged")).withColumn("is_new", F.coalesce(F.col("created") >= "2024", F.lit(False)))
    total = i.agg(F.count("*").alias("all_items"), F.count_if("is_new").alias("all_new"))  # one row
    c = i.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("size"), F.count_if("is_open").alias("open_items"), F.count_if("is_new").alias("recent"), F.count_distinct("project").alias("projects"))
    trend = F.col("recent") * F.col("all_items").cast("double") / (F.col("size") * F.greatest("all_new", F.lit(1)))
    return c.crossJoin(F.broadcast(total)).select("cluster", "size", "open_items", "recent", "projects", trend.alias("trend"))


_STOP = stopped(T.STOP)


@QUERIES.add(
    "cluster_labels",
    rf"""WITH {_ITEMS}, w AS (SELECT cluster, unnest(list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(title, '^[^/# ]+/[^/# ]+(#[0-9]+| commit [0-9a-f]+)? ', '')), '[a-z][a-z0-9_.]{{2,}}'), lambda w: w NOT IN ({_STOP})))) AS word FROM it WHERE cluster IS NOT NULL AND title IS NOT NULL),
tf AS (SELECT cluster, word, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word), k AS (SELECT count(DISTINCT cluster) AS k FROM it WHERE cluster IS NOT NULL)
SELECT cluster, word, row_number() OVER (PARTITION BY cluster ORDER BY floor(tf * ln(1 + k::DOUBLE / df) * 1000000000) DESC, word) AS rank FROM tf JOIN df USING (word), k WHERE tf >= 3 QUALIFY rank <= 4""",
)
def cluster_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The four most distinctive title words of each cluster."""
    i = items(spark, folder).where("cluster is not null")
    tf = i.where("title is not null").select("cluster", F.explode(T.title_words(F.col("title"))).alias("word")).groupBy("cluster", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    k = i.agg(F.count_distinct("cluster").alias("k"))  # one row
    score = F.floor(F.col("tf") * F.log(1 + F.col("k").cast("double") / F.col("df")) * 1e9)
    rank = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("score"), "word"))
    return tf.join(df, "word").crossJoin(F.broadcast(k)).where("tf >= 3").withColumn("score", score).select("cluster", "word", rank.cast("long").alias("rank")).where("rank <= 4")


# ---- vectors ---------------------------------------------------------------------------------------------------------------------

_V = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
m0 AS (SELECT label, pos, sum(e[pos] / n) AS x FROM v, range(1, 65) t(pos) GROUP BY ALL), mn AS (SELECT label, sqrt(sum(x * x)) AS n FROM m0 GROUP BY label),
m AS (SELECT label, list(x / n ORDER BY pos) AS c FROM m0 JOIN mn USING (label) GROUP BY label)"""


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings", "vec_id", "embedding", "label")


@QUERIES.add("mean_vector", f"WITH {_V} SELECT label::BIGINT AS label, pos::BIGINT AS pos, floor(x / n * 1000000 + 0.5)::BIGINT AS millionths FROM m0 JOIN mn USING (label)")
def mean_vector(spark: SparkSession, folder: str) -> DataFrame:
    """A16, M1, MD16: the normalised mean of each group's unit vectors."""
    m = group_means(_vectors(spark, folder), "label", "embedding")
    return m.select(F.col("label").cast("long").alias("label"), F.posexplode("centre").alias("pos", "x")).select("label", (F.col("pos") + 1).cast("long").alias("pos"), F.floor(F.col("x") * 1e6 + 0.5).alias("millionths"))


@QUERIES.add("cluster_assign", f"WITH {_V} SELECT vec_id, arg_max(m.label, (list_dot_product(e, c) / n, -m.label))::BIGINT AS centre FROM v, m GROUP BY vec_id")
def cluster_assign(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's nearest centre."""
    v = _vectors(spark, folder)
    return assign_to_centres(v, "vec_id", "embedding", group_means(v, "label", "embedding"), "label").select("vec_id", F.col("centre").cast("long").alias("centre"))


@QUERIES.add("cluster_samples", f"WITH {_V} SELECT v.label::BIGINT AS label, vec_id, row_number() OVER (PARTITION BY v.label ORDER BY list_dot_product(e, c) / n DESC, vec_id) AS rank FROM v JOIN m USING (label) QUALIFY rank <= 8")
def cluster_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The eight vectors of each group nearest its centre."""
    v = _vectors(spark, folder)
    near = assign_to_centres(v, "vec_id", "embedding", group_means(v, "label", "embedding"), "label", own="label")
    rank = F.row_number().over(W.partitionBy("centre").orderBy(F.desc("sim"), "vec_id"))
    return near.select(F.col("centre").cast("long").alias("label"), "vec_id", rank.cast("long").alias("rank")).where("rank <= 8")


@QUERIES.add("outlier_iso", f"WITH {_V} SELECT q.vec_id AS vec_id, floor(max(list_cosine_similarity(q.e, r.e)) * 1000000 + 0.5)::BIGINT AS millionths FROM v q JOIN v r ON q.label = r.label AND q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id")
def outlier_iso(spark: SparkSession, folder: str) -> DataFrame:
    """How near the nearest other vector of the same group is, for every vector whose id is divisible by 100."""
    v = _vectors(spark, folder)
    near = ranking.nearest(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", 1, group="label")
    return near.select(F.col("query").alias("vec_id"), F.floor(F.col("sim") * 1e6 + 0.5).alias("millionths"))


@QUERIES.add(
    "similar_pairs",
    f"""WITH {_V}, t AS (SELECT q.vec_id AS q, r.vec_id AS r, list_cosine_similarity(q.e, r.e) AS sim FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY sim DESC, r.vec_id) <= 5)
SELECT DISTINCT least(q, r) AS a, greatest(q, r) AS b FROM t WHERE sim >= 0.3""",
)
def similar_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of which one is among the other's five most similar and similar enough."""
    v = _vectors(spark, folder)
    near = ranking.nearest(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", 5).where("sim >= 0.3")
    return near.select(F.least("query", "key").alias("a"), F.greatest("query", "key").alias("b")).distinct()
