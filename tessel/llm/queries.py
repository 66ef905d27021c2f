"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessel.llm import bpe, density, knn, langid, mixing, split, vectors
from tessel.llm.neardup import NearDuplicates
from tessel.plans.registry import Registry
from tessel.plans.staging import stage
from tessel.sources.tables import table

QUERIES = Registry()
SIZE = 256
MODEL = "brook-embed-2"


#: All pairs of texts that share a word.
_SIMILAR = r"""WITH cur AS (SELECT rid, text FROM chunks WHERE rid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rid ORDER BY updated DESC NULLS LAST, ingested DESC NULLS LAST) = 1),
w AS (SELECT rid, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM cur), c AS (SELECT rid, word, count(*) AS n FROM w GROUP BY ALL),
t AS (SELECT rid, sum(n) AS n FROM c GROUP BY rid HAVING sum(n) >= 40), k AS (SELECT c.*, t.n AS words FROM c JOIN t USING (rid))
SELECT a.rid AS rid_a, b.rid AS rid_b FROM k a JOIN k b ON a.word = b.word AND a.rid < b.rid AND 5 * least(a.words, b.words) >= 4 * greatest(a.words, b.words)
GROUP BY ALL HAVING 5 * sum(least(a.n, b.n)) >= 4 * (max(a.words) + max(b.words) - sum(least(a.n, b.n)))"""

_USABLE = f"""u AS (SELECT rid, v::DOUBLE[] AS v FROM vec WHERE model = '{MODEL}' AND rid IS NOT NULL AND len(v) = {SIZE} AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
 AND len(list_filter(v, lambda x: x <> 0)) > 0 QUALIFY row_number() OVER (PARTITION BY rid ORDER BY v) = 1)"""


def _near_duplicates(spark: SparkSession, folder: str) -> NearDuplicates:
    return NearDuplicates(table(spark, folder, "chunks", "rid", "text", "updated", "ingested"), "rid", "text", ["updated", "ingested"])


@QUERIES.add("p1_found", _SIMILAR)
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks whose current texts share at least 0.8 of their words."""
    return _near_duplicates(spark, folder).pairs().select(F.col("a").alias("rid_a"), F.col("b").alias("rid_b"))


@QUERIES.add("p1_groups")
def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk of 40 words or more with its group of near-duplicates."""
    return _near_duplicates(spark, folder).groups().withColumnRenamed("key", "rid")


def _usable(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.usable_vectors(table(spark, folder, "vec", "rid", "model", "v").where(F.col("model") == MODEL), "rid", "v", SIZE)


def _item_points(spark: SparkSession, folder: str) -> DataFrame:
    """One row (key, v, digest) per item whose head chunk has a usable vector; key is the item's idx."""
    items = table(spark, folder, "items", "idx", "project", "id").where("idx is not null").groupBy("idx").agg(F.min(F.struct("project", "id")).alias("c")).select("idx", "c.*")
    rids = table(spark, folder, "chunks", "rid", "project", "id").groupBy("project", "id").agg(F.min("rid").alias("rid"))
    return items.join(rids, ["project", "id"]).join(_usable(spark, folder).withColumnRenamed("key", "rid"), "rid").select(F.col("idx").alias("key"), "v", "digest")


@QUERIES.add(
    "p2_found",
    f"""WITH {_USABLE}, i AS (SELECT idx, min({{'p': project, 'i': id}}) AS c FROM items WHERE idx IS NOT NULL GROUP BY idx), r AS (SELECT project, id, min(rid) AS rid FROM chunks GROUP BY ALL),
p AS (SELECT idx, v FROM i JOIN r ON i.c.p = r.project AND i.c.i = r.id JOIN u USING (rid))
SELECT a.idx AS idx_a, min(b.idx) AS idx_b FROM p a JOIN p b ON b.idx > a.idx AND list_cosine_similarity(a.v, b.v) >= 0.5 GROUP BY a.idx""",
)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each item and the next one of its cluster."""
    labels = density.density_clusters(stage(_item_points(spark, folder), "points"), SIZE)
    return density.next_in_group(labels, "peak", "key").select(F.col("key").alias("idx_a"), F.col("next").alias("idx_b"))


#: Words that say nothing about a title. Fixed values.
STOP = "the and for with from not when after before into this that are was its can our".split()


@QUERIES.add("p2_clusters")
def p2_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters with size, label (the four most distinctive title words) and samples (the eight items nearest the centre).

    Label words stand in three titles, or in as many as the cluster's most frequent word does; a cluster without any is labelled by
    the title, else the id, of its most typical item.
    """
    points = stage(_item_points(spark, folder), "points")
    labels = stage(density.density_clusters(points, SIZE), "labels")
    near = density.centre_similarity(points, labels, SIZE)
    first = W.partitionBy("peak").orderBy(F.desc("ctr"), "key")
    samples = near.withColumn("n", F.row_number().over(first)).where("n <= 8").groupBy("peak").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("s"))
    samples = samples.select("peak", F.to_json(F.col("s.key")).alias("samples"))
    titles = table(spark, folder, "items", "idx", "title", "id").groupBy("idx").agg(F.max("title").alias("title"), F.min("id").alias("id"))
    bare = F.regexp_replace(F.lower("title"), r"^[^ ]+/[^ ]+( commit [0-9a-f]+)? ", "")
    words = labels.join(titles, F.col("key") == F.col("idx")).select("peak", "key", F.explode(F.array_distinct(F.regexp_extract_all(bare, F.lit("[a-z][a-z0-9_.-]{2,}"), F.lit(0)))).alias("word"))
    tf = words.where(~F.col("word").isin(STOP)).groupBy("peak", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    sizes = labels.groupBy("peak").agg(F.count("*").alias("size"), F.min("key").alias("k"))
    total = F.broadcast(sizes.agg(F.count("*").alias("clusters")))  # one row
    score = F.col("tf") * F.log1p(F.col("clusters") / F.col("df"))
    best = W.partitionBy("peak").orderBy(F.desc("score"), "word")
    enough = F.col("tf") >= F.least(F.lit(3), F.max("tf").over(W.partitionBy("peak")))
    terms = tf.withColumn("enough", enough).where("enough").join(df, "word").crossJoin(total).withColumn("score", score).withColumn("n", F.row_number().over(best)).where("n <= 4")
    terms = terms.groupBy("peak").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]), ", ").alias("label"))
    title = F.when(F.trim("title") != "", F.trim("title"))
    typical = near.join(titles, F.col("key") == F.col("idx")).groupBy("peak").agg(F.min_by(F.coalesce(title, "id"), F.struct(title.isNull(), -F.col("ctr"), "key")).alias("typical"))
    rows = sizes.join(terms, "peak", "left").join(samples, "peak", "left").join(typical, "peak", "left")
    return rows.select("k", "size", F.coalesce("label", "typical").alias("label"), "samples")


def _pieces(spark: SparkSession, folder: str, *carried: str) -> DataFrame:
    chunks = table(spark, folder, "chunks", "rid", "text", "updated", "ingested", *carried)
    return split.split_oversized(chunks, "rid", "text", list(carried), ["updated", "ingested"])


#: A run is what lies between two boundary characters.
_RUNS = r"list_max(list_transform(regexp_split_to_array(text, '[ \t\r\n。]'), lambda x: length(x)))"


@QUERIES.add(
    "p4_found",
    rf"""SELECT rid, CASE WHEN {_RUNS} > 2400 THEN 'forced' ELSE 'natural' END AS cut FROM
(SELECT rid, text FROM chunks WHERE rid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rid ORDER BY updated DESC NULLS LAST, ingested DESC NULLS LAST, length(text) DESC NULLS LAST) = 1)
WHERE length(text) > 2400""",
)
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks over the limit, and whether any cut had to be made within a run without boundaries."""
    cut = F.when(F.bool_or("forced"), "forced").otherwise("natural").alias("cut")
    return _pieces(spark, folder).groupBy("rid").agg(cut)


@QUERIES.add("p4_pieces")
def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces themselves, with ids that no other chunk has."""
    pieces = _pieces(spark, folder, "project", "source", "doc", "id")
    rows = split.fresh_ids(pieces, table(spark, folder, "chunks", "project", "id"), "project", "id")
    return rows.select("rid", "project", "source", "doc", F.col("piece_id").alias("id"), "piece", "pieces", "start", "end", "lap", "forced", F.col("part").alias("text"))


def _neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return knn.nearest_neighbours(_usable(spark, folder), SIZE)


@QUERIES.add(
    "p5_found",
    f"""WITH {_USABLE}, s AS (SELECT a.rid AS a, b.rid AS b, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM u a JOIN u b ON a.rid <> b.rid),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 8) SELECT DISTINCT least(a, b) AS rid_a, greatest(a, b) AS rid_b FROM t WHERE s >= 0.9""",
)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of vectors with a cosine of at least 0.9, one being among the other's 8 most similar."""
    near = _neighbours(spark, folder).where("sim >= 0.9")
    return near.select(F.least("key", "to").alias("rid_a"), F.greatest("key", "to").alias("rid_b")).distinct()


@QUERIES.add("p5_neighbours")
def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 8 most similar vectors of every usable vector."""
    return _neighbours(spark, folder).select(F.col("key").alias("rid"), F.col("to").alias("neighbour"), "sim", "rank")


@QUERIES.add("p6_ids")
def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return bpe.encode_corpus(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


def _plan(spark: SparkSession, folder: str) -> tuple[DataFrame, list[mixing.Budget], int]:
    docs = stage(bpe.with_token_count(table(spark, folder, "documents", "doc_id", "source", "text"), "text", ["doc_id", "source"]), "sizes")
    plan, size = mixing.planned(docs, "source", "tokens", table(spark, folder, "mix_plan"))
    return docs, plan, size


def _mixed(docs: DataFrame, plan: list[mixing.Budget]) -> DataFrame:
    return mixing.realise(docs.withColumn("source", F.lower(F.trim("source"))), "doc_id", "source", "tokens", plan)


@QUERIES.add("p7_found")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of the plan that cannot reach their share: the mix uses all they may give, and that is less."""
    docs, plan, size = _plan(spark, folder)
    used = _mixed(docs, plan).groupBy("source").agg(F.sum("tokens").alias("used"))
    terms = spark.createDataFrame([(b.source, b.tokens * b.max_repeat, b.weight * size) for b in plan], "source string, most long, goal double")
    rows = terms.join(used, "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return rows.where("used = most and used < goal").select("source")


@QUERIES.add("p7_mix")
def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix: one row for each use of a document."""
    docs, plan, _ = _plan(spark, folder)
    return _mixed(docs, plan).select("source", F.col("key").alias("doc_id"), "turn", "tokens")


@QUERIES.add("p7_shares")
def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares really reached, of the mix and of the size that was planned, and by source the exponent and its repetitions."""
    docs, plan, size = _plan(spark, folder)
    used = _mixed(docs, plan).groupBy("source").agg(F.sum("tokens").alias("used"), F.max("turn").alias("turns"))
    terms = spark.createDataFrame([(b.source, b.weight, b.max_repeat, b.tokens, b.exponent, b.reached, b.budget) for b in plan], "source string, weight double, max_repeat int, tokens long, exponent double, reached boolean, budget double")
    rows = terms.join(used, "source", "left").select(*terms.columns, F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("turns", F.lit(0)).alias("turns"))
    whole = F.sum("used").over(W.partitionBy())  # one row a source of the plan
    return rows.withColumn("share", F.when(whole > 0, F.col("used") / whole)).withColumn("share_of_plan", F.col("used") / F.lit(float(size or 1)))


@QUERIES.add("p7_temperature")
def p7_temperature(spark: SparkSession, folder: str) -> DataFrame:
    """All named sources by one exponent, bisected so that the shares have the plan's entropy."""
    docs, plan, _ = _plan(spark, folder)
    rows = mixing.source_tokens(docs, "source", "tokens").where("source is not null and tokens > 0").orderBy("source").collect()  # one row a source
    a = mixing.entropy_exponent([r.tokens for r in rows], mixing.entropy([b.weight for b in plan]))
    total = sum(r.tokens**a for r in rows)
    return spark.createDataFrame([(r.source, r.tokens, a, r.tokens**a / total) for r in rows], "source string, tokens long, exponent double, share double")


def _languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    model = langid.fit(docs, "doc_id", "text", "lang", table(spark, folder, "lang_review", "doc_id", "lang"))
    return langid.document_languages(docs, "doc_id", "text", model)


@QUERIES.add("p8_found")
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of mixed documents, and documents of one language whose label is wrong or missing."""
    labels = table(spark, folder, "documents", "doc_id", "lang").select("doc_id", langid.bare_label(F.col("lang")).alias("label"))
    rows = _languages(spark, folder).where("lang != 'und'").withColumnRenamed("key", "doc_id").join(labels, "doc_id")
    return rows.where(~((F.col("segs") == 1) & F.col("lang").eqNullSafe(F.col("label")))).select("doc_id", F.col("seg").cast("long").alias("seg"), "lang")


@QUERIES.add("p8_languages")
def p8_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with prose and each stretch of a mixed one, with language and confidence."""
    return _languages(spark, folder).withColumnRenamed("key", "doc_id")
