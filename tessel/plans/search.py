"""Search: requests, and queries on keyword and vector rankings, their fusion and reranking."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessel.operators import filters, ranking
from tessel.operators import graph as G
from tessel.plans.base import CUR, current_chunks
from tessel.plans.registry import Registry
from tessel.sources.tables import table

QUERIES = Registry()
#: The question of the registered queries.
TERMS = ["server", "empty", "timeout", "snapshot"]


@dataclass(frozen=True)
class SearchRequest:
    """A search over chunks; ``where`` limits both rankings before they are cut."""

    terms: tuple[str, ...]
    k: int = 20
    where: filters.Where = field(default_factory=filters.Where)
    mode: str = "hybrid"
    sort: str = "relevance"

    def __post_init__(self):
        if self.mode not in ("hybrid", "bm25", "vec"):
            raise ValueError("mode is hybrid, bm25 or vec")
        if not 1 <= self.k <= 50:
            raise ValueError("k is from 1 to 50")
        if self.sort not in ("relevance", "recent"):
            raise ValueError("sort is relevance or recent")


def search(chunks: DataFrame, request: SearchRequest, vectors: DataFrame | None = None, query: list[float] | None = None) -> DataFrame:
    """The best chunk of each of the k best documents: (project, source, doc, rid, score, rank).

    ``vectors`` (rid, v) and a query vector add the vector ranking; without them, or in mode bm25, words alone rank.
    """
    base = filters.apply(chunks, request.where)
    size = max(50, 5 * request.k)
    lists = []
    if request.mode != "vec":
        hits = ranking.bm25(base, "rid", "project", F.col("title"), F.col("text"), list(request.terms))
        lists.append(ranking.top(hits, size, F.desc("score"), F.col("rid")).select(F.lit(0).alias("list"), "rid", "rank"))
    if request.mode != "bm25" and vectors is not None and query is not None:
        spark = chunks.sparkSession
        q = spark.createDataFrame([(-1, query)], "rid long, v array<float>")
        near = ranking.nearest(q, vectors.join(base.select("rid"), "rid", "left_semi"), "rid", "v", size)
        lists.append(near.select(F.lit(1).alias("list"), F.col("key").alias("rid"), "rank"))
    if not lists:
        raise ValueError("this mode needs vectors")
    rows = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
    fused = ranking.fuse(rows, "rid").join(base.select("rid", "project", "source", "doc", filters.date_of("updated").alias("date")), "rid")
    order = (F.desc("score"), F.col("first_list"), F.col("first_rank"), F.col("rid"))
    best = ranking.best_per(fused, ["project", "source", "doc"], *order)
    hits = ranking.top(best, request.k, *order)
    if request.sort == "recent":
        hits = ranking.top(hits.drop("rank"), request.k, F.col("date").desc_nulls_last(), F.col("rid"))
    return hits.select("project", "source", "doc", "rid", "score", "rank")


# ---- the registered queries -------------------------------------------------------------------------------------------------------


def _bm25_sql(name: str, wt: float, wb: float) -> str:
    f = lambda t: f"({wt}::DOUBLE * len(list_filter(t, lambda w: w = '{t}')) + {wb}::DOUBLE * len(list_filter(b, lambda w: w = '{t}')))"
    d = lambda t: f"count(*) FILTER (list_contains(t, '{t}') OR list_contains(b, '{t}'))"
    fs = ", ".join(f"{f(t)} AS f{i}" for i, t in enumerate(TERMS))
    ds = ", ".join(f"{d(t)} AS d{i}" for i, t in enumerate(TERMS))
    part = lambda i: f"greatest(ln((docs - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)), 0.000001::DOUBLE) * f{i} * (1.2::DOUBLE + 1) / (f{i} + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * n / avgn))"
    return f"""{name}_w AS (SELECT rid, project, source, doc, regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+') AS t, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS b FROM cur WHERE project IS NOT NULL),
{name}_r AS (SELECT rid, project, source, doc, len(t) + len(b) AS n, {fs} FROM {name}_w),
{name}_s AS (SELECT project, count(*) AS docs, avg(len(t) + len(b)) AS avgn, {ds} FROM {name}_w GROUP BY project),
{name} AS (SELECT rid, r.project, source, doc, {" + ".join(part(i) for i in range(len(TERMS)))} AS score FROM {name}_r r JOIN {name}_s s ON r.project = s.project WHERE {" OR ".join(f"f{i} > 0" for i in range(len(TERMS)))})"""


def _top_sql(name: str, k: int) -> str:
    return f"{name}_top AS (SELECT rid, row_number() OVER (ORDER BY score DESC, rid) AS rank, score FROM {name} QUALIFY rank <= {k})"


#: Words ranked in the whole chunk (a) and in its body alone (b): the two rankings of the queries below.
_A = CUR + ", " + _bm25_sql("a", 3.0, 1.0) + ", " + _top_sql("a", 50)
_AB = _A + ", " + _bm25_sql("b", 0.0, 1.0) + ", " + _top_sql("b", 50) + ", lists AS (SELECT 0 AS list, rid, rank, score FROM a_top UNION ALL SELECT 1, rid, rank, score FROM b_top)"
_FUSED = (
    _AB
    + """, fused0 AS (SELECT rid, sum(1.0::DOUBLE / (60 + rank)) + max(CASE rank WHEN 1 THEN 0.05::DOUBLE WHEN 2 THEN 0.02::DOUBLE WHEN 3 THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM lists GROUP BY rid),
fused AS (SELECT f.rid, c.project, c.source, c.doc, c.text, c.meta, f.score, row_number() OVER (ORDER BY floor(f.score * 1000000000) DESC, f.rid) AS rank FROM fused0 f JOIN cur c ON c.rid = f.rid)"""
)


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return current_chunks(spark, folder, "project", "source", "doc", "title", "text").where("project is not null")


def _list(spark: SparkSession, folder: str, weights: tuple[float, float], k: int = 50) -> DataFrame:
    hits = ranking.bm25(_chunks(spark, folder), "rid", "project", F.col("title"), F.col("text"), TERMS, weights)
    return ranking.top(hits, k, F.desc("score"), F.col("rid"))


def _lists(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _list(spark, folder, (3.0, 1.0)), _list(spark, folder, (0.0, 1.0))
    return a.select(F.lit(0).alias("list"), "rid", "rank", "score").unionByName(b.select(F.lit(1).alias("list"), "rid", "rank", "score"))


def _fused(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The fused ranking with the chunks' columns; scores that differ by less than 1e-9 are equal and the smaller rid comes first."""
    f = ranking.fuse(_lists(spark, folder), "rid").select("rid", "score")
    c = current_chunks(spark, folder, "project", "source", "doc", *columns)
    rows = f.join(c, "rid")
    return rows.withColumn("rank", F.row_number().over(W.orderBy(F.floor(F.col("score") * 1e9).desc(), "rid")))


_LONG = lambda c: F.col(c).cast("long").alias(c)


@QUERIES.add("bm25_topk", _A + " SELECT rid, rank FROM a_top WHERE rank <= 20")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 chunks that match the words best."""
    return _list(spark, folder, (3.0, 1.0), 20).select("rid", _LONG("rank"))


@QUERIES.add(
    "vector_topk",
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
SELECT q.vec_id AS query, r.vec_id AS vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, r.e) DESC, r.vec_id) AS rank FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10""",
)
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten vectors most similar to each whose id is divisible by 100."""
    v = table(spark, folder, "embeddings", "vec_id", "embedding")
    got = ranking.nearest(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", 10)
    return got.select("query", F.col("key").alias("vec_id"), _LONG("rank"))


@QUERIES.add("rrf_fusion", _FUSED + " SELECT rid, rank FROM fused")
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Reciprocal rank fusion of two rankings, with a bonus for first places."""
    return _fused(spark, folder).select("rid", _LONG("rank"))


@QUERIES.add("rrf_k10", _AB + ", f AS (SELECT rid, sum(1.0::DOUBLE / (10 + rank)) AS s FROM lists GROUP BY rid) SELECT rid, row_number() OVER (ORDER BY floor(s * 1000000000) DESC, rid) AS rank FROM f")
def rrf_k10(spark: SparkSession, folder: str) -> DataFrame:
    """Fusion with k 10 and no bonus."""
    f = ranking.fuse(_lists(spark, folder), "rid", 10, ())
    return f.select("rid", F.row_number().over(W.orderBy(F.floor(F.col("score") * 1e9).desc(), "rid")).cast("long").alias("rank"))


@QUERIES.add("dedup_best_chunk", _FUSED + " SELECT project, source, doc, rid FROM fused QUALIFY row_number() OVER (PARTITION BY project, source, doc ORDER BY rank) = 1")
def dedup_best_chunk(spark: SparkSession, folder: str) -> DataFrame:
    """One hit per document."""
    return ranking.best_per(_fused(spark, folder), ["project", "source", "doc"], F.col("rank")).select("project", "source", "doc", "rid")


_BOOST = """, n AS (SELECT DISTINCT id AS node, project, chunk FROM nodes WHERE chunk IS NOT NULL AND id IS NOT NULL), e AS (SELECT DISTINCT src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL),
d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node),
x AS (SELECT f.rid, max(degree) AS degree FROM fused f JOIN cur c ON c.rid = f.rid JOIN n ON n.project = c.project AND n.chunk = c.id JOIN d ON d.node = n.node GROUP BY f.rid),
boosted AS (SELECT f.rid, f.score + 0.5::DOUBLE * (SELECT max(score) FROM fused) * coalesce(degree, 0) / greatest((SELECT max(degree) FROM x), 1) AS score FROM fused f LEFT JOIN x ON x.rid = f.rid)"""


@QUERIES.add("link_boost", _FUSED + _BOOST + " SELECT rid, row_number() OVER (ORDER BY floor(score * 1000000000) DESC, rid) AS rank FROM boosted")
def link_boost(spark: SparkSession, folder: str) -> DataFrame:
    """Hits that are well linked rise by up to half the best score."""
    f = _fused(spark, folder, "id")
    e = table(spark, folder, "edges", "src", "dst").where("src is not null and dst is not null").distinct()
    n = table(spark, folder, "nodes", "id", "project", "chunk").where("chunk is not null and id is not null").select(F.col("id").alias("node"), "project", F.col("chunk").alias("id")).distinct()
    x = f.select("rid", "project", "id").join(n, ["project", "id"]).join(G.degrees(e), "node").groupBy("rid").agg(F.max("degree").alias("degree"))
    whole = W.partitionBy()  # of the fused hits, 100 at most
    rows = f.join(x, "rid", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    score = F.col("score") + 0.5 * F.max("score").over(whole) * F.col("degree") / F.greatest(F.max("degree").over(whole), F.lit(1))
    return rows.select("rid", score.alias("score")).select("rid", F.row_number().over(W.orderBy(F.floor(F.col("score") * 1e9).desc(), "rid")).cast("long").alias("rank"))


@QUERIES.add("rerank_pool", _FUSED + " SELECT rid FROM fused QUALIFY rank <= 30 OR row_number() OVER (PARTITION BY project ORDER BY rank) = 1")
def rerank_pool(spark: SparkSession, folder: str) -> DataFrame:
    """The 30 best and the best of each project."""
    return ranking.pool(_fused(spark, folder), "project", 30).select("rid")


#: A stand-in for a reranker, the same number in both engines.
_FAKE_SQL = "(length(text) % 97) / 97.0::DOUBLE"


def _fake_rerank() -> Column:
    return (F.length("text") % 97) / F.lit(97.0)


@QUERIES.add("rerank_blend", _FUSED + f", bl AS (SELECT rid, (CASE WHEN rank <= 3 THEN 0.75::DOUBLE WHEN rank <= 10 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END) AS w, score / (SELECT max(score) FROM fused) AS s, {_FAKE_SQL} AS r FROM fused WHERE rank <= 30) SELECT rid, row_number() OVER (ORDER BY floor((w * s + (1 - w) * r) * 1000000000) DESC, rid) AS rank FROM bl")
def rerank_blend(spark: SparkSession, folder: str) -> DataFrame:
    """Fused and reranked scores weighted by the fused rank; what is not in the pool is dropped."""
    f = _fused(spark, folder, "text")
    best = F.max("score").over(W.partitionBy())  # of the fused hits, 100 at most
    rows = f.withColumn("best", best).where("rank <= 30")
    final = ranking.blend(F.col("rank"), F.col("score"), F.col("best"), _fake_rerank())
    return rows.select("rid", final.alias("s")).select("rid", F.row_number().over(W.orderBy(F.floor(F.col("s") * 1e9).desc(), "rid")).cast("long").alias("rank"))


@QUERIES.add("sort_recent", _FUSED + ", r AS (SELECT rid, CASE WHEN json_valid(meta) THEN json_extract_string(meta, '$.updated') END AS u FROM fused WHERE rank <= 10) SELECT rid, row_number() OVER (ORDER BY u DESC NULLS LAST, rid) AS rank FROM r")
def sort_recent(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best hits, newest first."""
    f = _fused(spark, folder, "meta").where("rank <= 10").select("rid", filters.meta("updated").alias("u"))
    return f.select("rid", F.row_number().over(W.orderBy(F.col("u").desc_nulls_last(), "rid")).cast("long").alias("rank"))


@QUERIES.add("related_quota", _FUSED + ", q AS (SELECT rid, source, rank FROM fused QUALIFY row_number() OVER (PARTITION BY source ORDER BY rank) <= 4) SELECT rid, source FROM q ORDER BY rank LIMIT 8")
def related_quota(spark: SparkSession, folder: str) -> DataFrame:
    """Eight hits, of a source four at most."""
    return ranking.quota(_fused(spark, folder), "source", 4, 8, F.col("rank")).select("rid", "source")


@QUERIES.add("cascade_rerank", _FUSED + f" SELECT rid, row_number() OVER (ORDER BY {_FAKE_SQL} DESC, rid) AS rank FROM fused WHERE rank <= 12")
def cascade_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve best, ranked again by another score."""
    f = _fused(spark, folder, "text").where("rank <= 12").select("rid", _fake_rerank().alias("r"))
    return f.select("rid", F.row_number().over(W.orderBy(F.desc("r"), "rid")).cast("long").alias("rank"))


_Z = (
    _AB
    + """, j AS (SELECT coalesce(x.rid, y.rid) AS rid, coalesce(x.score, 0.0) AS s, coalesce(y.score, 0.0) AS t FROM a_top x FULL JOIN b_top y ON x.rid = y.rid),
z0 AS (SELECT rid, greatest(s, (SELECT max(s) FROM j) - 12) AS s, t FROM j),
z AS (SELECT rid, 0.6::DOUBLE * (s - avg(s) OVER ()) / (stddev_pop(s) OVER () + 1e-9) + 0.4::DOUBLE * (t - avg(t) OVER ()) / (stddev_pop(t) OVER () + 1e-9) AS z FROM z0)"""
)


def _z(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _list(spark, folder, (3.0, 1.0)), _list(spark, folder, (0.0, 1.0))
    j = a.select("rid", F.col("score").alias("s")).join(b.select("rid", F.col("score").alias("t")), "rid", "full").select("rid", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("t", F.lit(0.0)).alias("t"))
    w = W.partitionBy()  # of two lists of 50
    return j.withColumn("s", F.greatest("s", F.max("s").over(w) - 12)).select("rid", (0.6 * ranking.zscore(F.col("s"), w) + 0.4 * ranking.zscore(F.col("t"), w)).alias("z"))


@QUERIES.add("zscore_fusion", _Z + " SELECT rid, floor(z * 1000000 + 0.5)::BIGINT AS millionths FROM z")
def zscore_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted standard scores of two lists."""
    return _z(spark, folder).select("rid", F.floor(F.col("z") * 1e6 + 0.5).alias("millionths"))


@QUERIES.add("topk_zthreshold", _Z + " SELECT rid FROM z WHERE z >= 1.5 ORDER BY floor(z * 1000000000) DESC, rid LIMIT 3")
def topk_zthreshold(spark: SparkSession, folder: str) -> DataFrame:
    """At most three hits with a standard score of 1.5 or more."""
    return _z(spark, folder).where("z >= 1.5").orderBy(F.floor(F.col("z") * 1e9).desc(), "rid").limit(3).select("rid")


@QUERIES.add("topk_overlap", _AB + " SELECT count(*) FILTER (rank <= 3) AS shared, count(*) FILTER (rank <= 3) / 3.0::DOUBLE AS share FROM a_top WHERE rid IN (SELECT rid FROM b_top WHERE rank <= 3)")
def topk_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the first three of two lists are the same."""
    firsts = _lists(spark, folder).where("rank <= 3")
    both = firsts.where("list = 0").select("rid").join(firsts.where("list = 1").select("rid"), "rid", "left_semi")
    return both.agg(F.count("*").alias("shared"), (F.count("*") / F.lit(3.0)).alias("share"))


@QUERIES.add("ask_candidate_score", _AB + ", f AS (SELECT rid, sum(1.0::DOUBLE / (60 + rank)) AS s FROM lists GROUP BY rid) SELECT f.rid, floor(((length(text) % 97) / 97.0::DOUBLE + 50 * s) * 1000000 + 0.5)::BIGINT AS millionths FROM f JOIN cur c ON c.rid = f.rid")
def ask_candidate_score(spark: SparkSession, folder: str) -> DataFrame:
    """M6: a prior plus fifty times the reciprocal ranks."""
    f = ranking.fuse(_lists(spark, folder), "rid", bonus=()).select("rid", "rrf").join(current_chunks(spark, folder, "text"), "rid")
    return f.select("rid", F.floor((_fake_rerank() + 50 * F.col("rrf")) * 1e6 + 0.5).alias("millionths"))


@QUERIES.add("hybrid_search")
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """Words and the vector of their best hit that has one, fused; one hit per document, open ones only."""
    chunks = current_chunks(spark, folder, "project", "source", "doc", "id", "title", "text", "meta").where("project is not null")
    v = table(spark, folder, "vec", "rid", "model", "v").where("model = 'brook-embed-2' and size(v) = 256 and not exists(v, x -> x is null or isnan(x))").dropDuplicates(["rid"]).select("rid", "v")
    first = _list(spark, folder, (3.0, 1.0)).join(v, "rid").orderBy("rank").select("v").limit(1).collect()  # one row
    request = SearchRequest(tuple(TERMS), 20, filters.Where.of(open_only=True))
    return search(chunks, request, v, list(first[0].v) if first else None)
