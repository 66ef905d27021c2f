"""Queries on activity: filters by date, author and state, threads, totals, series, authors, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessel.operators import filters
from tessel.operators.filters import meta
from tessel.operators.series import filled_series
from tessel.operators.store import diff
from tessel.plans.base import CUR, current_chunks
from tessel.plans.registry import Registry
from tessel.plans.similar import _ITEMS, items
from tessel.sources.tables import table

QUERIES = Registry()

_M = CUR + ", c0 AS (SELECT *, CASE WHEN json_valid(meta) THEN meta END AS jm FROM cur), c AS (SELECT *, " + ", ".join(f"json_extract_string(jm, '$.{k}') AS j_{k}" for k in ("kind", "state", "author", "author_name", "created", "updated", "published", "number")) + " FROM c0)"
_HEAD = "(NOT contains(id, '~') AND NOT regexp_matches(id, ':(comment|review):') AND (NOT contains(id, ':release:') OR ends_with(id, ':header')))"
_STATE = f", h AS (SELECT project, source, doc, max(j_state) AS hs FROM c WHERE {_HEAD} GROUP BY ALL), s AS (SELECT c.*, coalesce(j_state, hs) AS state FROM c LEFT JOIN h ON h.project = c.project AND h.source = c.source AND h.doc = c.doc)"


def _chunks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return current_chunks(spark, folder, "project", "source", "doc", "id", "meta", *columns)


@QUERIES.add("filter_date_prefix", _M + " SELECT rid FROM c WHERE coalesce(j_created, j_published) >= '2023' AND coalesce(j_created, j_published) <= '2024-03' || '~'")
def filter_date_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks created from 2023 to March 2024, both included at their own precision."""
    return filters.apply(_chunks(spark, folder), filters.Where.of(since="2023", until="2024-03")).select("rid")


@QUERIES.add("filter_updated", _M + " SELECT rid FROM c WHERE coalesce(j_updated, j_published, j_created) >= '2024-06-15'")
def filter_updated(spark: SparkSession, folder: str) -> DataFrame:
    """chunks by their last change."""
    return filters.apply(_chunks(spark, folder), filters.Where.of(since="2024-06-15", date="updated")).select("rid")


@QUERIES.add("filter_authors", _M + " SELECT rid FROM c WHERE lower(j_author) IN ('zelzel', 'nelor42') OR lower(j_author_name) IN ('zelzel', 'nelor42')")
def filter_authors(spark: SparkSession, folder: str) -> DataFrame:
    """chunks of two authors, given in odd case."""
    return filters.apply(_chunks(spark, folder), filters.Where.of(authors=("@ZelZel", "nelor42"))).select("rid")


@QUERIES.add("filter_kinds", _M + " SELECT rid FROM c WHERE coalesce(j_kind, 'file') IN ('comment', 'file') AND source IN ('issues', 'code')")
def filter_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """comments and files of two sources."""
    return filters.apply(_chunks(spark, folder), filters.Where.of(kinds=("comment", "file"), sources=("issues", "code"))).select("rid")


@QUERIES.add("inherited_state", _M + _STATE + " SELECT rid, state FROM s")
def inherited_state(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk's state, or its document's."""
    return filters.with_inherited_state(_chunks(spark, folder)).select("rid", "state")


@QUERIES.add("filter_open_only", _M + _STATE + " SELECT rid FROM s WHERE coalesce(state, 'open') NOT IN ('closed', 'merged')")
def filter_open_only(spark: SparkSession, folder: str) -> DataFrame:
    """chunks of documents that are not closed."""
    return filters.apply(_chunks(spark, folder), filters.Where.of(open_only=True)).select("rid")


@QUERIES.add("thread_head", _M + f", h AS (SELECT project, source, doc, min(rid) AS head FROM c WHERE {_HEAD} GROUP BY ALL) SELECT c.rid AS rid, head FROM c LEFT JOIN h ON h.project = c.project AND h.source = c.source AND h.doc = c.doc WHERE NOT {_HEAD}")
def thread_head(spark: SparkSession, folder: str) -> DataFrame:
    """The head chunk of every comment, review and continuation."""
    c = current_chunks(spark, folder, "project", "source", "doc", "id")
    doc = ["project", "source", "doc"]
    heads = c.where(filters.is_head()).groupBy(*doc).agg(F.min("rid").alias("head"))
    return c.where(~filters.is_head()).join(heads, doc, "left").select("rid", "head")


@QUERIES.add("browse_newest", _M + " SELECT project, source, doc, rid FROM c WHERE coalesce(j_updated, j_published, j_created) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project, source, doc ORDER BY coalesce(j_updated, j_published, j_created) DESC, rid) = 1")
def browse_newest(spark: SparkSession, folder: str) -> DataFrame:
    """A2: each document's newest chunk."""
    c = _chunks(spark, folder).withColumn("d", filters.date_of("updated")).where("d is not null")
    return c.groupBy("project", "source", "doc").agg(F.max_by("rid", F.struct("d", -F.col("rid"))).alias("rid"))


@QUERIES.add("threads_to_summarise", _M + " SELECT project, source, doc, count(*) FILTER (j_kind IN ('comment', 'review', 'post')) AS comments FROM c GROUP BY ALL HAVING comments >= 5")
def threads_to_summarise(spark: SparkSession, folder: str) -> DataFrame:
    """Threads with five comments or more."""
    n = F.count_if(meta("kind").isin("comment", "review", "post")).alias("comments")
    return _chunks(spark, folder).groupBy("project", "source", "doc").agg(n).where("comments >= 5")


@QUERIES.add(
    "activity_totals",
    f"""WITH {_ITEMS} SELECT project, count(*) FILTER (kind = 'pr' AND created >= '2024' AND created < '2025') AS prs_opened, count(*) FILTER (kind = 'pr' AND lower(trim(state)) = 'merged' AND created >= '2024' AND created < '2025') AS prs_merged,
count(*) FILTER (kind = 'issue' AND created >= '2024' AND created < '2025') AS issues_opened, count(*) FILTER (kind = 'issue' AND lower(trim(state)) = 'closed' AND created >= '2024' AND created < '2025') AS issues_closed, count(*) FILTER (kind = 'commit' AND created >= '2024' AND created < '2025') AS commits FROM it WHERE project IS NOT NULL GROUP BY project""",
)
def activity_totals(spark: SparkSession, folder: str) -> DataFrame:
    """A10: what a year brought to each project."""
    i = items(spark, folder).where("project is not null").withColumn("state", F.lower(F.trim("state")))
    n = lambda cond, name: F.count_if(F.coalesce(F.expr(f"{cond} and created >= '2024' and created < '2025'"), F.lit(False))).alias(name)
    return i.groupBy("project").agg(
        n("kind = 'pr'", "prs_opened"), n("kind = 'pr' and state = 'merged'", "prs_merged"), n("kind = 'issue'", "issues_opened"), n("kind = 'issue' and state = 'closed'", "issues_closed"), n("kind = 'commit'", "commits")
    )


@QUERIES.add(
    "activity_series_daily",
    """WITH d AS (SELECT unnest(generate_series((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::DATE AS day), t AS (SELECT DISTINCT event_type FROM events),
n AS (SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT strftime(d.day, '%Y-%m-%d') AS day, t.event_type AS event_type, coalesce(n, 0) AS n FROM d CROSS JOIN t LEFT JOIN n ON n.day = d.day AND n.event_type = t.event_type""",
)
def activity_series_daily(spark: SparkSession, folder: str) -> DataFrame:
    """A11, ST4: events by day and type, empty days filled."""
    return filled_series(table(spark, folder, "events", "ts", "event_type"), "ts", "event_type", "day").withColumnRenamed("bucket", "day")


@QUERIES.add(
    "activity_series_weekly",
    """WITH d AS (SELECT unnest(generate_series((SELECT date_trunc('week', min(ts))::DATE FROM events), (SELECT max(ts)::DATE FROM events), INTERVAL 7 DAY))::DATE AS week), t AS (SELECT DISTINCT event_type FROM events),
n AS (SELECT date_trunc('week', ts)::DATE AS week, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT strftime(d.week, '%Y-%m-%d') AS week, t.event_type AS event_type, coalesce(n, 0) AS n FROM d CROSS JOIN t LEFT JOIN n ON n.week = d.week AND n.event_type = t.event_type""",
)
def activity_series_weekly(spark: SparkSession, folder: str) -> DataFrame:
    """Events by week from Monday and type, empty weeks filled."""
    return filled_series(table(spark, folder, "events", "ts", "event_type"), "ts", "event_type", "week").withColumnRenamed("bucket", "week")


@QUERIES.add("tumbling_day", "SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, count(*) AS n, sum(value) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def tumbling_day(spark: SparkSession, folder: str) -> DataFrame:
    """ST4: events, their value and users by day."""
    e = table(spark, folder, "events", "ts", "user_id", "value")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.count_distinct("user_id").alias("users"))


@QUERIES.add("top_authors", _M + ", n AS (SELECT coalesce(j_author, '?') AS author, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, author LIMIT 15) SELECT author, n FROM n WHERE author <> '?'")
def top_authors(spark: SparkSession, folder: str) -> DataFrame:
    """The fifteen most active authors, of whom the unknown one is dropped only then."""
    n = _chunks(spark, folder).groupBy(F.coalesce(meta("author"), F.lit("?")).alias("author")).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "author").limit(15).where("author <> '?'")


@QUERIES.add(
    "digest_facts",
    _M
    + f""", k AS (SELECT project, doc, count(*) FILTER (j_kind IN ('comment', 'review', 'post') AND j_created >= '2024') AS fresh FROM c WHERE project IS NOT NULL AND doc IS NOT NULL GROUP BY ALL)
SELECT project, doc, fresh, row_number() OVER (PARTITION BY project ORDER BY fresh DESC, doc) AS rank FROM k WHERE fresh > 0 QUALIFY rank <= 7""",
)
def digest_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Each project's seven documents with most fresh comments."""
    fresh = F.count_if(F.coalesce(meta("kind").isin("comment", "review", "post") & (meta("created") >= "2024"), F.lit(False)))
    k = _chunks(spark, folder).where("project is not null and doc is not null").groupBy("project", "doc").agg(fresh.alias("fresh")).where("fresh > 0")
    rank = F.row_number().over(W.partitionBy("project").orderBy(F.desc("fresh"), "doc"))
    return k.withColumn("rank", rank.cast("long")).where("rank <= 7")


@QUERIES.add("truth_labels", _M + r""" SELECT rid, contains(l, '"bug"') OR contains(l, '"regression"') AS bug, contains(l, '"docs"') AS docs FROM (SELECT rid, json_extract_string(jm, '$.labels') AS l FROM c) WHERE l IS NOT NULL""")
def truth_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a chunk's labels meet those of a question."""
    labels = F.from_json(meta("labels"), "array<string>")
    c = _chunks(spark, folder).select("rid", labels.alias("l")).where("l is not null")
    has = lambda *names: F.arrays_overlap("l", F.array(*[F.lit(n) for n in names]))
    return c.select("rid", has("bug", "regression").alias("bug"), has("docs").alias("docs"))


@QUERIES.add(
    "sync_diff",
    """WITH o AS (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents), n AS (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END) AS h FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT -1 - doc_id, 'new' FROM documents WHERE doc_id % 13 = 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS action FROM o FULL JOIN n ON o.doc_id = n.doc_id""",
)
def sync_diff(spark: SparkSession, folder: str) -> DataFrame:
    """SRC3, SRC11, SRC22: what a new delivery of all documents adds, changes, deletes and leaves alone."""
    d = table(spark, folder, "documents", "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    old = d.select("doc_id", F.md5("text").alias("h"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = d.where("doc_id % 11 <> 0").select("doc_id", F.md5(changed).alias("h")).unionByName(d.where("doc_id % 13 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), F.lit("new").alias("h")))
    return diff(old, new, "doc_id", "h")


@QUERIES.add("context_window", r"SELECT doc_id, array_to_string(w[greatest(1, k - 15):k - 1], ' ') AS before_words, w[k] AS word, array_to_string(w[k + 1:k + 5], ' ') AS after_words FROM (SELECT doc_id, w, (len(w) + 1) // 2 AS k FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents WHERE text IS NOT NULL)) WHERE k >= 1")
def context_window(spark: SparkSession, folder: str) -> DataFrame:
    """CH11: fifteen words before the middle word of each document and five after it."""
    d = table(spark, folder, "documents", "doc_id", "text").select("doc_id", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w"))
    d = d.withColumn("k", F.floor((F.size("w") + 1) / 2).cast("int")).where("k >= 1")
    first = F.greatest(F.lit(1), F.col("k") - 15)
    part = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    return d.select("doc_id", part(first, F.col("k") - first).alias("before_words"), F.element_at("w", F.col("k")).alias("word"), part(F.col("k") + 1, F.lit(5)).alias("after_words"))


@QUERIES.add("round_robin_sample", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS turn FROM documents WHERE source IS NOT NULL) SELECT doc_id, source, turn FROM r ORDER BY turn, source LIMIT 100")
def round_robin_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A hundred documents, drawn from the sources in turn. No source can give more than a hundred, so each keeps its first."""
    d = table(spark, folder, "documents", "doc_id", "source").where("source is not null")
    turn = F.row_number().over(W.partitionBy("source").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id"))
    return d.withColumn("turn", turn.cast("long")).where("turn <= 100").orderBy("turn", "source").limit(100)
