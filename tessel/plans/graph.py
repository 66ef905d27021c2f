"""Queries on the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessel.functions import text as T
from tessel.operators import graph as G
from tessel.plans.base import CUR, NODE, current_chunks, current_nodes
from tessel.plans.registry import Registry
from tessel.sources.tables import table

QUERIES = Registry()

_E = """edges1 AS (SELECT src, dst, type, conf, how, snip, seen FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY src, dst, type ORDER BY conf DESC NULLS LAST, seen ASC NULLS LAST, how ASC NULLS LAST, snip ASC NULLS LAST) = 1)"""


def _case(table: dict, key: str, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + f" ELSE {other} END"


_R = f"""rel AS (SELECT src AS node, type AS rel, dst AS other, conf FROM edges1 UNION ALL SELECT dst, {_case(G.INVERSE, 'type', 'type')}, src, conf FROM edges1)"""
_WORTH = _case({k: v for k, v in G.WEIGHT.items()}, "rel", "0.0")
_D = "deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges1 UNION ALL SELECT dst FROM edges1) GROUP BY node)"


def best(spark: SparkSession, folder: str) -> DataFrame:
    return G.best_edges(table(spark, folder, "edges", "src", "dst", "type", "conf", "how", "snip", "seen"))


@QUERIES.add("edge_dedup_max_conf", f"WITH {_E} SELECT src, dst, type, conf, how, snip FROM edges1")
def edge_dedup_max_conf(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest evidence of every edge."""
    return best(spark, folder).drop("seen")


@QUERIES.add("mentions_minus_closes", f"WITH {_E} SELECT src, dst, type FROM edges1 e WHERE type <> 'mentions' OR NOT EXISTS (SELECT 1 FROM edges1 c WHERE c.src = e.src AND c.dst = e.dst AND c.type = 'closes')")
def mentions_minus_closes(spark: SparkSession, folder: str) -> DataFrame:
    """No mention where the pair is closed as well."""
    return G.without_subsumed(best(spark, folder)).select("src", "dst", "type")


@QUERIES.add("edge_stats", f"WITH {_E}, {NODE} SELECT type, count(*) AS edges, avg(conf) AS conf, avg((coalesce(n.indexed, 0) = 0)::INT) AS dangling FROM edges1 LEFT JOIN nodes1 n ON dst = n.id GROUP BY type")
def edge_stats(spark: SparkSession, folder: str) -> DataFrame:
    """A3: edges, mean conf and share of dangling targets per type."""
    n = current_nodes(spark, folder, "indexed").withColumnRenamed("id", "dst")
    rows = best(spark, folder).select("dst", "type", "conf").join(n, "dst", "left")
    return rows.groupBy("type").agg(F.count("*").alias("edges"), F.avg("conf").alias("conf"), F.avg((F.coalesce("indexed", F.lit(0)) == 0).cast("int")).alias("dangling"))


@QUERIES.add(
    "graph_hubs",
    f"WITH {_E}, i AS (SELECT 'in' AS side, dst AS node, count(*) AS n FROM edges1 GROUP BY dst ORDER BY n DESC, node LIMIT 8), o AS (SELECT 'out' AS side, src AS node, count(*) AS n FROM edges1 GROUP BY src ORDER BY n DESC, node LIMIT 8) SELECT * FROM i UNION ALL SELECT * FROM o",
)
def graph_hubs(spark: SparkSession, folder: str) -> DataFrame:
    """A4: the eight nodes with most edges in, and out."""
    e = best(spark, folder).select("src", "dst")
    side = lambda c, name: e.groupBy(F.col(c).alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(8).select(F.lit(name).alias("side"), "node", "n")
    return side("dst", "in").unionByName(side("src", "out"))


@QUERIES.add("graph_degree", f"WITH {_E}, {_D} SELECT node, degree FROM deg")
def graph_degree(spark: SparkSession, folder: str) -> DataFrame:
    """A5: ends at every node."""
    return G.degrees(best(spark, folder))


@QUERIES.add("relation_counts", f"WITH {_E}, {_R} SELECT node, rel, count(*) AS n FROM rel GROUP BY ALL")
def relation_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of every node per relation."""
    return G.relations(best(spark, folder)).groupBy("node", "rel").agg(F.count("*").alias("n"))


@QUERIES.add("graph_neighbours", f"WITH {_E}, {_R}, {NODE} SELECT node, rel, other, rel.conf AS conf, n.kind AS kind, n.title AS title, coalesce(n.indexed, 0) AS indexed FROM rel LEFT JOIN nodes1 n ON other = n.id")
def graph_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Every node's neighbours from both directions, with what is known of them."""
    n = current_nodes(spark, folder, "kind", "title", "indexed").withColumnRenamed("id", "other")
    return G.relations(best(spark, folder)).join(n, "other", "left").select("node", "rel", "other", "conf", "kind", "title", F.coalesce("indexed", F.lit(0)).cast("long").alias("indexed"))


@QUERIES.add(
    "neighbour_top",
    f"""WITH {_E}, {_R}, s AS (SELECT * FROM rel QUALIFY row_number() OVER (PARTITION BY node, rel ORDER BY conf DESC NULLS LAST, other) <= 2)
SELECT node, rel, other, row_number() OVER (PARTITION BY node ORDER BY {_WORTH} DESC, conf DESC NULLS LAST, rel, other) AS rank FROM s QUALIFY rank <= 6""",
)
def neighbour_top(spark: SparkSession, folder: str) -> DataFrame:
    """At most two neighbours of a relation and six in all."""
    return G.top_neighbours(G.relations(best(spark, folder))).select("node", "rel", "other", F.col("rank").cast("long").alias("rank"))


_STEPS = f"steps AS (SELECT node, other, rel, {_WORTH} * coalesce(conf, 0.0) AS w FROM rel)"
_SEEDS = "seeds AS (SELECT DISTINCT id AS seed, 1.0::DOUBLE AS score FROM nodes WHERE kind = 'topic' AND id IS NOT NULL)"


@QUERIES.add(
    "graph_expand",
    f"""WITH {_E}, {_R}, {_D}, {_STEPS}, {_SEEDS},
one AS (SELECT seed, other AS tgt, score * w AS score FROM seeds JOIN steps ON seed = node),
two AS (SELECT o.seed, s.other AS tgt, o.score * s.w * 0.5 AS score FROM (SELECT seed, tgt, max(score) AS score FROM one GROUP BY ALL) o JOIN deg ON deg.node = o.tgt AND degree <= 150
 JOIN steps s ON s.node = o.tgt AND s.rel IN ('closes', 'closed_by', 'merged_as', 'merge_of') AND s.other <> o.seed),
b AS (SELECT seed, tgt, max(score) AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE tgt <> seed GROUP BY ALL)
SELECT tgt AS node, floor(sum(score) * 1000000000 + 0.5)::BIGINT AS billionths FROM b GROUP BY tgt""",
)
def graph_expand(spark: SparkSession, folder: str) -> DataFrame:
    """What every forum topic leads to in one or two steps, by score."""
    e = best(spark, folder)
    seeds = table(spark, folder, "nodes", "id", "kind").where("kind = 'topic' and id is not null").select(F.col("id").alias("seed"), F.lit(1.0).alias("score")).distinct()
    got = G.expand(seeds, G.relations(e), G.degrees(e))
    return got.select("node", F.floor(F.col("score") * 1e9 + 0.5).alias("billionths"))


@QUERIES.add(
    "graph_story",
    f"""WITH {_E}, {_R}, {_D}, {_SEEDS}, {NODE}, st AS (SELECT DISTINCT node, other FROM rel WHERE rel NOT IN ('mentions', 'mentioned_by') OR conf >= 0.5),
one AS (SELECT DISTINCT seed, other AS tgt FROM seeds JOIN st ON seed = node WHERE other <> seed),
two AS (SELECT seed, other AS tgt FROM one JOIN deg ON deg.node = tgt AND degree <= 200 JOIN st ON st.node = tgt WHERE other <> seed),
h AS (SELECT * FROM one UNION SELECT * FROM two)
SELECT seed, tgt AS node, row_number() OVER (PARTITION BY seed ORDER BY coalesce(n.created, '9999'), tgt) AS place FROM h LEFT JOIN nodes1 n ON tgt = n.id QUALIFY place <= 60""",
)
def graph_story(spark: SparkSession, folder: str) -> DataFrame:
    """The story of every forum topic: what lies within two steps, by date, 60 at most."""
    e = best(spark, folder)
    seeds = table(spark, folder, "nodes", "id", "kind").where("kind = 'topic' and id is not null").select(F.col("id").alias("seed")).distinct()
    near = G.neighbourhood(seeds, G.relations(e), G.degrees(e))
    rows = near.join(current_nodes(spark, folder, "created").withColumnRenamed("id", "node"), "node", "left")
    place = F.row_number().over(W.partitionBy("seed").orderBy(F.coalesce("created", F.lit("9999")), "node"))
    return rows.select("seed", "node", place.cast("long").alias("place")).where("place <= 60")


@QUERIES.add("linked_to", f"WITH {_E}, {_R} SELECT DISTINCT other AS node, node AS named FROM rel WHERE rel IN ('closed_by', 'merge_of') AND node LIKE '%#%'")
def linked_to(spark: SparkSession, folder: str) -> DataFrame:
    """what closes or merges each issue and pull request."""
    r = G.relations(best(spark, folder)).where(F.col("rel").isin("closed_by", "merge_of") & F.col("node").contains("#"))
    return r.select(F.col("other").alias("node"), F.col("node").alias("named")).distinct()


@QUERIES.add(
    "has_link_filter",
    f"WITH {_E}, {_R}, {NODE} SELECT id FROM nodes1 WHERE id IN (SELECT node FROM rel WHERE rel = 'closed_by') AND id IN (SELECT node FROM rel WHERE rel = 'mentioned_by') AND id NOT IN (SELECT node FROM rel WHERE rel = 'shipped_in')",
)
def has_link_filter(spark: SparkSession, folder: str) -> DataFrame:
    """nodes that are closed and mentioned by something and not shipped."""
    r = G.relations(best(spark, folder)).select(F.col("node").alias("id"), "rel")
    of = lambda name: r.where(F.col("rel") == name).select("id")
    return current_nodes(spark, folder).select("id").join(of("closed_by"), "id", "left_semi").join(of("mentioned_by"), "id", "left_semi").join(of("shipped_in"), "id", "left_anti")


@QUERIES.add("set_intersect", f"WITH {_E}, {_R} SELECT node FROM rel WHERE rel = 'mentioned_by' INTERSECT SELECT node FROM rel WHERE rel = 'touches'")
def set_intersect(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes with both relations."""
    r = G.relations(best(spark, folder))
    return r.where("rel = 'mentioned_by'").select("node").intersect(r.where("rel = 'touches'").select("node"))


@QUERIES.add("set_difference", f"WITH {_E}, {_R} SELECT node FROM rel WHERE rel = 'mentioned_by' EXCEPT SELECT node FROM rel WHERE rel = 'touches'")
def set_difference(spark: SparkSession, folder: str) -> DataFrame:
    """S3: nodes with the one relation and not the other."""
    r = G.relations(best(spark, folder))
    return r.where("rel = 'mentioned_by'").select("node").subtract(r.where("rel = 'touches'").select("node"))


_LINKED = "linked AS (SELECT DISTINCT n.project, n.chunk AS id FROM nodes n WHERE n.chunk IS NOT NULL AND n.id IN (SELECT dst FROM edges))"


def _linked(spark: SparkSession, folder: str) -> DataFrame:
    ends = table(spark, folder, "edges", "dst").where("dst is not null").select(F.col("dst").alias("node"))
    n = table(spark, folder, "nodes", "id", "project", "chunk").where("chunk is not null").withColumnRenamed("id", "node")
    return n.join(ends, "node", "left_semi").select("project", F.col("chunk").alias("id")).distinct()


@QUERIES.add("filter_linked_semi", CUR + f", {_LINKED} SELECT rid FROM cur c WHERE EXISTS (SELECT 1 FROM linked l WHERE l.project = c.project AND l.id = c.id)")
def filter_linked_semi(spark: SparkSession, folder: str) -> DataFrame:
    """F8: head chunks of nodes that something refers to."""
    return current_chunks(spark, folder, "project", "id").join(_linked(spark, folder), ["project", "id"], "left_semi").select("rid")


@QUERIES.add("filter_linked_anti", CUR + f", {_LINKED} SELECT rid FROM cur c WHERE NOT EXISTS (SELECT 1 FROM linked l WHERE l.project = c.project AND l.id = c.id)")
def filter_linked_anti(spark: SparkSession, folder: str) -> DataFrame:
    """F8: all other chunks."""
    return current_chunks(spark, folder, "project", "id").join(_linked(spark, folder), ["project", "id"], "left_anti").select("rid")


_SHA = r"\b[0-9a-f]{7,40}\b"


@QUERIES.add(
    "prefix_join",
    CUR
    + rf""", c AS (SELECT DISTINCT lower(ref) AS sha, id FROM nodes WHERE kind = 'commit' AND ref IS NOT NULL AND length(ref) >= 7),
r AS (SELECT DISTINCT rid, unnest(regexp_extract_all(text, '{_SHA}')) AS ref FROM cur WHERE text IS NOT NULL)
SELECT rid, ref, min(id) AS node FROM r JOIN c ON sha[1:7] = ref[1:7] AND starts_with(sha, ref) GROUP BY rid, ref HAVING count(*) = 1""",
)
def prefix_join(spark: SparkSession, folder: str) -> DataFrame:
    """Abbreviated hashes in texts that begin exactly one commit's. The first seven characters are the join's key."""
    commits = table(spark, folder, "nodes", "id", "kind", "ref").where("kind = 'commit' and length(ref) >= 7").select(F.lower("ref").alias("sha"), "id").distinct()
    refs = current_chunks(spark, folder, "text").select("rid", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_SHA), F.lit(0)))).alias("ref"))
    key = lambda c: F.substring(c, 1, 7)
    met = refs.join(commits, key("ref") == key("sha")).where(F.col("sha").startswith(F.col("ref")))
    return met.groupBy("rid", "ref").agg(F.min("id").alias("node"), F.count("*").alias("n")).where("n = 1").drop("n")


_NUMBER = r"(?:^|[^A-Za-z0-9_&/])#([0-9]{1,7})"


@QUERIES.add(
    "fallback_resolve",
    CUR
    + rf""", k AS (SELECT DISTINCT repo, ref AS number, project FROM nodes WHERE kind IN ('issue', 'pr') AND repo IS NOT NULL AND ref IS NOT NULL AND project IS NOT NULL),
r AS (SELECT DISTINCT rid, project, unnest(regexp_extract_all(text, '{_NUMBER}', 1))::BIGINT::VARCHAR AS number FROM cur WHERE text IS NOT NULL AND project IS NOT NULL),
j AS (SELECT rid, r.project, r.number, max(CASE WHEN k.project = r.project THEN k.repo END) AS own, count(DISTINCT k.repo) FILTER (k.project <> r.project) AS others, min(k.repo) FILTER (k.project <> r.project) AS other FROM r LEFT JOIN k ON k.number = r.number GROUP BY ALL)
SELECT rid, number, CASE WHEN own IS NOT NULL THEN own WHEN others >= 1 THEN other ELSE project END AS repo,
 CASE WHEN own IS NOT NULL OR others = 0 THEN 1.0::DOUBLE WHEN others = 1 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS certainty FROM j""",
)
def fallback_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Where ``#n`` in a chunk leads: its own project's item, else another project's (less certain if several have it)."""
    k = table(spark, folder, "nodes", "repo", "kind", "ref", "project").where("kind in ('issue', 'pr') and repo is not null and ref is not null and project is not null")
    k = k.select(F.col("ref").alias("number"), "project", "repo").distinct()
    # a number stands in as many repos as there are, so nothing is gathered by number: counts and least repos say all that is asked
    own = k.groupBy("number", "project").agg(F.max("repo").alias("own"), F.min("repo").alias("low"))
    by_repo = k.groupBy("number", "repo").agg(F.count("*").alias("projects"), F.min("project").alias("project"))
    only = by_repo.where("projects = 1").groupBy("number", "project").agg(F.count("*").alias("only_here"))
    first = own.groupBy("number").agg(F.min(F.struct("low", "project")).alias("first"))
    second = own.join(first, "number").where("project != first.project").groupBy("number").agg(F.min("low").alias("second"))
    all_ = by_repo.groupBy("number").agg(F.count("*").alias("repos")).join(first, "number").join(second, "number", "left")
    refs = current_chunks(spark, folder, "project", "text").where("project is not null").select("rid", "project", F.explode(T.issue_numbers(F.col("text"), 1 << 20)).alias("number")).withColumn("number", F.col("number").cast("string"))
    j = refs.join(all_, "number", "left").join(own.drop("low"), ["number", "project"], "left").join(only, ["number", "project"], "left")
    others = F.coalesce(F.col("repos") - F.coalesce("only_here", F.lit(0)), F.lit(0))
    other = F.when(F.col("first.project") != F.col("project"), F.col("first.low")).otherwise(F.col("second"))
    repo = F.when(F.col("own").isNotNull(), F.col("own")).when(others >= 1, other).otherwise(F.col("project"))
    sure = F.when(F.col("own").isNotNull() | (others <= 0), 1.0).when(others == 1, 0.5).otherwise(0.3)
    return j.select("rid", "number", repo.alias("repo"), sure.alias("certainty"))


@QUERIES.add(
    "first_release_asof",
    f"""WITH {NODE}, c AS (SELECT id, repo, created FROM nodes1 WHERE kind = 'commit' AND created IS NOT NULL AND repo IS NOT NULL), r AS (SELECT repo, id, created FROM nodes1 WHERE kind = 'release' AND created IS NOT NULL AND repo IS NOT NULL)
SELECT c.id AS id, arg_min(r.id, (r.created, r.id)) AS release, min(r.created) AS release_time FROM c LEFT JOIN r ON r.repo = c.repo AND r.created >= c.created GROUP BY c.id""",
)
def first_release_asof(spark: SparkSession, folder: str) -> DataFrame:
    """The first release of a commit's repo at or after it."""
    n = current_nodes(spark, folder, "repo", "kind", "created").where("created is not null and repo is not null")
    commits = n.where("kind = 'commit'").select("id", "repo", "created")
    releases = n.where("kind = 'release'").select("repo", F.col("id").alias("release"), "created")
    return G.next_event(commits, releases, ["repo"], "created", "release").select("id", "release", "release_time")


@QUERIES.add(
    "calibration_before_after",
    f"""WITH {_E}, {NODE} SELECT c.dst AS issue, c.src AS pr, arg_min(s.dst, (r.created, s.dst)) AS release FROM edges1 c JOIN edges1 s ON s.src = c.src AND s.type = 'shipped_in' JOIN nodes1 p ON p.id = c.src JOIN nodes1 r ON r.id = s.dst
WHERE c.type = 'closes' AND c.conf >= 0.5 AND r.created IS NOT NULL GROUP BY ALL""",
)
def calibration_before_after(spark: SparkSession, folder: str) -> DataFrame:
    """Issues, what closes them, and the first release that ships it."""
    e = best(spark, folder)
    n = current_nodes(spark, folder, "created")
    closes = e.where("type = 'closes' and conf >= 0.5").select(F.col("src").alias("pr"), F.col("dst").alias("issue"))
    ships = e.where("type = 'shipped_in'").select(F.col("src").alias("pr"), F.col("dst").alias("release"))
    rows = closes.join(ships, "pr").join(n.select(F.col("id").alias("pr")), "pr").join(n.where("created is not null").withColumnRenamed("id", "release"), "release")
    return rows.groupBy("issue", "pr").agg(F.min(F.struct("created", "release")).alias("x")).select("issue", "pr", F.col("x.release").alias("release"))


@QUERIES.add(
    "edge_precision",
    """WITH e AS (SELECT DISTINCT src, dst, type, how IN ('github', 'git') AS native FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL AND how IS NOT NULL),
p AS (SELECT src, dst, type, bool_or(native) AS n, bool_or(NOT native) AS t FROM e GROUP BY ALL)
SELECT type, sum((n AND t)::INT)::BIGINT AS both_sides, sum((t AND NOT n)::INT)::BIGINT AS text_only, sum((n AND NOT t)::INT)::BIGINT AS native_only FROM p GROUP BY type""",
)
def edge_precision(spark: SparkSession, folder: str) -> DataFrame:
    """Edges known from texts against those that the hosts know themselves."""
    e = table(spark, folder, "edges", "src", "dst", "type", "how").where("src is not null and dst is not null and how is not null")
    native = F.col("how").isin("github", "git")
    p = e.groupBy("src", "dst", "type").agg(F.bool_or(native).alias("n"), F.bool_or(~native).alias("t"))
    return p.groupBy("type").agg(F.count_if(F.expr("n and t")).alias("both_sides"), F.count_if(F.expr("t and not n")).alias("text_only"), F.count_if(F.expr("n and not t")).alias("native_only"))


_TITLE = r"list_distinct(list_filter(regexp_extract_all(lower(regexp_replace({t}, '^[^/# ]+/[^/# ]+(#[0-9]+| commit [0-9a-f]+)? ', '')), '[a-z][a-z0-9_.]{2,}'), lambda w: w NOT IN ('the','and','for','with','from','not','when','after','before','into','this','that','are','was','its','can','our')))"


@QUERIES.add(
    "eval_pairs",
    f"""WITH {_E}, {NODE}, j AS (SELECT src, dst, {_TITLE.replace('{t}', 'a.title')} AS x, {_TITLE.replace('{t}', 'b.title')} AS y FROM edges1 JOIN nodes1 a ON a.id = src JOIN nodes1 b ON b.id = dst WHERE type = 'closes' AND a.title IS NOT NULL AND b.title IS NOT NULL)
SELECT src, dst, CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 0.0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END AS shared FROM j WHERE len(x) >= 3 AND len(y) >= 3""",
)
def eval_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of an item and what closes it, both with titles of three words or more, with their titles' overlap."""
    n = current_nodes(spark, folder, "title").where("title is not null").select("id", T.title_words(F.col("title")).alias("words"))
    e = best(spark, folder).where("type = 'closes'").select("src", "dst")
    rows = e.join(n.toDF("src", "x"), "src").join(n.toDF("dst", "y"), "dst").where("size(x) >= 3 and size(y) >= 3")
    return rows.select("src", "dst", T.jaccard(F.col("x"), F.col("y")).alias("shared"))


@QUERIES.add("touch_confidence", f"WITH {_E} SELECT src, count(*) AS files, CASE WHEN count(*) <= 5 THEN 1.0::DOUBLE ELSE greatest(0.1::DOUBLE, 5.0::DOUBLE / count(*)) END AS conf FROM edges1 WHERE type = 'touches' GROUP BY src")
def touch_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """M3: how much a commit's touching a file says, by the number of files."""
    n = best(spark, folder).where("type = 'touches'").groupBy("src").agg(F.count("*").alias("files"))
    return n.select("src", "files", F.when(F.col("files") <= 5, 1.0).otherwise(F.greatest(F.lit(0.1), F.lit(5.0) / F.col("files"))).alias("conf"))


_V = "v1 AS (SELECT DISTINCT rid, hash FROM vec WHERE model = 'brook-embed-2' AND v IS NOT NULL AND rid IS NOT NULL)"


def _embedded(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "vec", "rid", "model", "hash", "v").where("model = 'brook-embed-2' and v is not null").select("rid", "hash").distinct()
    c = current_chunks(spark, folder, "project", "source", "hash", "updated")
    return c.join(v.withColumn("has", F.lit(1)), ["rid", "hash"], "left")


@QUERIES.add("index_stats", CUR + f", {_V} SELECT project, source, count(*) AS chunks, count(v.rid) AS vectors, max(epoch_us(updated)) AS newest FROM cur c LEFT JOIN v1 v ON v.rid = c.rid AND v.hash = c.hash GROUP BY ALL")
def index_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks, those with a current vector, and the newest change, per source."""
    return _embedded(spark, folder).groupBy("project", "source").agg(F.count("*").alias("chunks"), F.count("has").alias("vectors"), F.max(F.unix_micros("updated")).alias("newest"))


@QUERIES.add("pending_vectors", CUR + f", {_V} SELECT rid FROM cur c WHERE NOT EXISTS (SELECT 1 FROM v1 v WHERE v.rid = c.rid AND v.hash = c.hash)")
def pending_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """F16, MD2: chunks whose vector is missing, of another model, or stale."""
    return _embedded(spark, folder).where("has is null").select("rid")


@QUERIES.add(
    "integrity_counts",
    CUR + f", {_V} SELECT (SELECT count(*) FROM cur) AS chunks, (SELECT count(*) FROM cur WHERE text IS NOT NULL) AS texts, (SELECT count(*) FROM cur c WHERE NOT EXISTS (SELECT 1 FROM v1 v WHERE v.rid = c.rid AND v.hash = c.hash)) AS pending",
)
def integrity_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks, chunks with text, pending vectors."""
    v = table(spark, folder, "vec", "rid", "model", "hash", "v").where("model = 'brook-embed-2' and v is not null").select("rid", "hash").distinct()
    c = current_chunks(spark, folder, "hash", "text").select("rid", "hash", F.col("text").isNotNull().alias("t"))
    rows = c.join(v.withColumn("has", F.lit(1)), ["rid", "hash"], "left")
    return rows.agg(F.count("*").alias("chunks"), F.count_if("t").alias("texts"), F.count_if(F.col("has").isNull()).alias("pending"))


@QUERIES.add("fingerprint", CUR + " SELECT project, count(*) AS chunks, max(epoch_us(updated)) AS newest, count(*) FILTER (coalesce(CASE WHEN json_valid(meta) THEN json_extract_string(meta, '$.state') END, '') = 'open') AS open_items FROM cur GROUP BY project")
def fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """What tells that a derived table must be rebuilt."""
    c = current_chunks(spark, folder, "project", "updated", "meta")
    return c.groupBy("project").agg(F.count("*").alias("chunks"), F.max(F.unix_micros("updated")).alias("newest"), F.count_if(F.get_json_object("meta", "$.state") == "open").alias("open_items"))
