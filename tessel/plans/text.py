"""Queries on texts: hashes, titles, words, pages, documents, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessel.functions import text as T
from tessel.operators.filters import meta
from tessel.operators.store import middle_cut
from tessel.plans.base import CUR, current_chunks, stopped
from tessel.plans.registry import Registry
from tessel.sources.tables import table

QUERIES = Registry()
_STOP = stopped(T.STOP)
_REST = r"regexp_replace(title, '^[^/# ]+/[^/# ]+(#[0-9]+| commit [0-9a-f]+)? ', '')"
_WORDS = rf"list_sort(list_distinct(list_filter(regexp_extract_all(lower({_REST}), '[a-z][a-z0-9_.]{{2,}}'), lambda w: w NOT IN ({_STOP}))))"
_ITEMS = "items1 AS (SELECT idx, max(title) AS title FROM items WHERE idx IS NOT NULL GROUP BY idx)"


def _titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "items", "idx", "title").where("idx is not null").groupBy("idx").agg(F.max("title").alias("title"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct pairs a < b."""
    p = table(spark, folder, "pairs", "a", "b").where("a is not null and b is not null and a <> b")
    return p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


_PAIRS = "pairs1 AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b)"


def _both(spark: SparkSession, folder: str, column) -> DataFrame:
    t = _titles(spark, folder).select("idx", column.alias("x"))
    return _pairs(spark, folder).join(t.toDF("a", "xa"), "a").join(t.toDF("b", "xb"), "b")


@QUERIES.add("content_hash", CUR + " SELECT rid, sha1(coalesce(title, '') || chr(0) || coalesce(text, '')) AS digest, hash IS DISTINCT FROM sha1(coalesce(title, '') || chr(0) || coalesce(text, '')) AS stale FROM cur")
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    """STR4: the content hash of every current chunk, and whether the stored one is stale."""
    c = current_chunks(spark, folder, "title", "text", "hash").withColumn("digest", T.content_hash(F.col("title"), F.col("text")))
    return c.select("rid", "digest", (~F.col("hash").eqNullSafe(F.col("digest"))).alias("stale"))


@QUERIES.add("split_title", rf"WITH {_ITEMS} SELECT idx, regexp_extract(title, '^([^/# ]+/[^/# ]+)#([0-9]+) (.*)$', 1) AS repo, try_cast(regexp_extract(title, '^([^/# ]+/[^/# ]+)#([0-9]+) (.*)$', 2) AS BIGINT) AS number, {_REST} AS rest FROM items1")
def split_title(spark: SparkSession, folder: str) -> DataFrame:
    """STR5: owner/repo, number and rest of a title."""
    t = F.col("title")
    return _titles(spark, folder).select("idx", T.title_repo(t).alias("repo"), T.title_number(t).alias("number"), T.title_rest(t).alias("rest"))


@QUERIES.add("title_tokens", f"WITH {_ITEMS} SELECT idx, array_to_string({_WORDS}, ' ') AS words FROM items1")
def title_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """STR6: the words of a title."""
    return _titles(spark, folder).select("idx", F.array_join(T.title_words(F.col("title")), " ").alias("words"))


@QUERIES.add(
    "jaccard",
    f"""WITH {_ITEMS}, {_PAIRS}, w AS (SELECT idx, {_WORDS} AS x FROM items1)
SELECT a, b, CASE WHEN len(list_distinct(list_concat(p.x, q.x))) = 0 THEN 0.0 ELSE len(list_intersect(p.x, q.x))::DOUBLE / len(list_distinct(list_concat(p.x, q.x))) END AS sim
FROM pairs1 JOIN w p ON p.idx = a JOIN w q ON q.idx = b WHERE p.x IS NOT NULL AND q.x IS NOT NULL""",
)
def jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """STR7: Jaccard similarity of the titles of each known pair."""
    return _both(spark, folder, T.title_words(F.col("title"))).where("xa is not null and xb is not null").select("a", "b", T.jaccard(F.col("xa"), F.col("xb")).alias("sim"))


@QUERIES.add(
    "ngram_overlap",
    rf"""WITH {_ITEMS}, {_PAIRS}, w AS (SELECT idx, string_split(trim(regexp_replace(lower({_REST}), '[^a-z0-9]+', ' ', 'g')), ' ') AS x FROM items1),
g AS (SELECT idx, CASE WHEN len(x) < 3 THEN [] ELSE list_transform(range(1, len(x) - 1), lambda i: array_to_string(x[i:i+2], ' ')) END AS g FROM w WHERE x IS NOT NULL)
SELECT a, b, list_has_any(p.g, q.g) AS shared FROM pairs1 JOIN g p ON p.idx = a JOIN g q ON q.idx = b""",
)
def ngram_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """STR18: whether two titles of a pair share three words in a row."""
    g = T.grams(F.split(T.normal_words(T.title_rest(F.col("title"))), " "), 3)
    return _both(spark, folder, g).where("xa is not null and xb is not null").select("a", "b", F.arrays_overlap("xa", "xb").alias("shared"))


@QUERIES.add(
    "fts_text",
    CUR + r""" SELECT rid, array_to_string(list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{3,}'),
 lambda n: regexp_extract_all(n, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'))), lambda p: lower(p)), lambda p: length(p) > 1))), ' ') AS parts FROM cur WHERE text IS NOT NULL""",
)
def fts_text(spark: SparkSession, folder: str) -> DataFrame:
    """STR1, STR2: the identifiers' parts that the keyword index adds to a text."""
    return current_chunks(spark, folder, "text").where("text is not null").select("rid", F.array_join(T.identifier_parts(F.col("text")), " ").alias("parts"))


@QUERIES.add("page_links", r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, 'https?://[^\s"''<>)\]`]+'), lambda u: regexp_replace(replace(u, '&amp;', '&'), '[.,;:]+$', '')))), ' ') AS links
FROM documents WHERE regexp_matches(text, 'https?://')""")
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """STR10: the addresses in each document that has any."""
    d = table(spark, folder, "documents", "doc_id", "text").where(F.col("text").rlike("https?://"))
    return d.select("doc_id", F.array_join(F.array_sort(T.links(F.col("text"), None)), " ").alias("links"))


@QUERIES.add(
    "quote_supported",
    CUR + r""", n AS (SELECT DISTINCT id, project, chunk FROM nodes WHERE chunk IS NOT NULL), e AS (SELECT DISTINCT src, dst, type, snip FROM edges WHERE snip IS NOT NULL AND src IS NOT NULL),
c AS (SELECT project, id, max(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS t FROM cur WHERE text IS NOT NULL GROUP BY ALL)
SELECT src, dst, type, snip, bool_or(length(trim(regexp_replace(lower(snip), '[^a-z0-9]+', ' ', 'g'))) >= 12 AND contains(t, trim(regexp_replace(lower(snip), '[^a-z0-9]+', ' ', 'g')))) AS supported
FROM e JOIN n ON e.src = n.id JOIN c ON c.project = n.project AND c.id = n.chunk GROUP BY ALL""",
)
def quote_supported(spark: SparkSession, folder: str) -> DataFrame:
    """STR19: whether an edge's snippet stands in the head chunk of its source."""
    nodes = table(spark, folder, "nodes", "id", "project", "chunk").where("chunk is not null").distinct()
    edges = table(spark, folder, "edges", "src", "dst", "type", "snip").where("snip is not null and src is not null").distinct()
    c = current_chunks(spark, folder, "project", "id", "text").where("text is not null").groupBy("project", F.col("id").alias("chunk")).agg(F.max(T.normal_words(F.col("text"))).alias("t"))
    q = T.normal_words(F.col("snip"))
    ok = (F.length(q) >= 12) & F.contains(F.col("t"), q)
    rows = edges.join(nodes, edges.src == nodes.id).join(c, ["project", "chunk"])
    return rows.groupBy("src", "dst", "type", "snip").agg(F.bool_or(ok).alias("supported"))


_MAILS = ["12+nelor@users.noreply.forge.example", "zelzel@users.noreply.forge.example", "kes@forge.example", "7+A-b@USERS.noreply.x", ""]


@QUERIES.add("email_handle", "SELECT email, nullif(regexp_extract(lower(email), '^(?:[0-9]+[+])?([a-z0-9][a-z0-9-]*)@users[.]noreply[.]', 1), '') AS handle FROM (VALUES " + ", ".join(f"('{m}')" for m in _MAILS) + ") t(email)")
def email_handle(spark: SparkSession, folder: str) -> DataFrame:
    """STR15: accounts of no-reply addresses."""
    return spark.createDataFrame([(m,) for m in _MAILS], "email string").select("email", T.email_handle(F.col("email")).alias("handle"))


@QUERIES.add("srt_time", """WITH t AS (SELECT event_id, round(value * 1000)::BIGINT AS ms FROM events)
SELECT event_id, lpad((ms // 3600000)::VARCHAR, 2, '0') || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((ms % 1000)::VARCHAR, 3, '0') AS at FROM t""")
def srt_time(spark: SparkSession, folder: str) -> DataFrame:
    """STR28: caption times of the events' values taken as seconds."""
    return table(spark, folder, "events", "event_id", "value").select("event_id", T.srt_time(F.col("value")).alias("at"))


@QUERIES.add("line_range", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS lines FROM documents WHERE text IS NOT NULL")
def line_range(spark: SparkSession, folder: str) -> DataFrame:
    """L4: lines 2 to 4 of every document."""
    return table(spark, folder, "documents", "doc_id", "text").where("text is not null").select("doc_id", T.line_range(F.col("text"), 2, 4).alias("lines"))


@QUERIES.add("text_paging", """SELECT doc_id, p AS page, length(text[p * 1000 + 1 : p * 1000 + 1000])::BIGINT AS chars, md5(text[p * 1000 + 1 : p * 1000 + 1000]) AS digest, p * 1000 + 1000 < length(text) AS truncated
FROM (SELECT doc_id, text, unnest(range(0, greatest(1, (length(text) + 999) // 1000))) AS p FROM documents WHERE text IS NOT NULL)""")
def text_paging(spark: SparkSession, folder: str) -> DataFrame:
    """L3: the pages of 1,000 characters that tile every document."""
    pages = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.ceil(F.length("text") / 1000)) - 1)
    d = table(spark, folder, "documents", "doc_id", "text").where("text is not null").select("doc_id", "text", F.explode(pages).alias("page"))
    part = F.expr("substring(text, cast(page * 1000 + 1 as int), 1000)")
    return d.select("doc_id", "page", F.length(part).cast("long").alias("chars"), F.md5(part).alias("digest"), (F.col("page") * 1000 + 1000 < F.length("text")).alias("truncated"))


def _positions(chunks: DataFrame) -> DataFrame:
    """Place and first character of each chunk in its document, head chunks first, then by date and rid.

    Months are summed up first, so a document that holds a large part of all rows is not ordered by one task.
    """
    c = chunks.withColumn("late", (~F.col("id").rlike(":(issue|topic|header)") | F.col("id").contains("~")).cast("int")).withColumn("created", F.coalesce(meta("created"), F.lit("")))
    c = c.withColumn("month", F.substring("created", 1, 7)).withColumn("n", F.coalesce(F.length("text"), F.lit(0)) + 2)
    doc = ["project", "source", "doc"]
    inside = W.partitionBy(*doc, "late", "month").orderBy("created", "rid")
    per = c.groupBy(*doc, "late", "month").agg(F.count("*").alias("rows"), F.sum("n").alias("chars"))
    over = W.partitionBy(*doc).orderBy("late", "month").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*doc, "late", "month", F.coalesce(F.sum("rows").over(over), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("chars").over(over), F.lit(0)).alias("chars_before"))
    c = c.withColumn("place", F.row_number().over(inside)).withColumn("upto", F.sum("n").over(inside) - F.col("n"))
    return c.join(per, [*doc, "late", "month"]).withColumn("place", F.col("place") + F.col("rows_before")).withColumn("start", F.col("upto") + F.col("chars_before"))


_PLACES = CUR + r""", p AS (SELECT *, (NOT regexp_matches(id, ':(issue|topic|header)') OR contains(id, '~'))::INT AS late,
 coalesce(CASE WHEN json_valid(meta) THEN json_extract_string(meta, '$.created') END, '') AS made, coalesce(length(text), 0) + 2 AS n FROM cur WHERE project IS NOT NULL AND source IS NOT NULL AND doc IS NOT NULL AND id IS NOT NULL),
q AS (SELECT *, row_number() OVER d AS place, (sum(n) OVER d - n)::BIGINT AS start FROM p WINDOW d AS (PARTITION BY project, source, doc ORDER BY late, made, rid))
"""


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    c = current_chunks(spark, folder, "project", "source", "doc", "id", "text", "meta")
    return _positions(c.where("project is not null and source is not null and doc is not null and id is not null"))


@QUERIES.add("assemble_document", _PLACES + "SELECT rid, project, source, doc, place, start FROM q")
def assemble_document(spark: SparkSession, folder: str) -> DataFrame:
    """Where each chunk stands in its assembled document."""
    return _documents(spark, folder).select("rid", "project", "source", "doc", F.col("place").cast("long").alias("place"), F.col("start").cast("long").alias("start"))


@QUERIES.add(
    "thread_text",
    _PLACES
    + """, t AS (SELECT project, source, doc, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY place) AS x FROM q GROUP BY ALL)
SELECT project, source, doc, length(x)::BIGINT AS chars, md5(CASE WHEN length(x) > 12000 THEN x[1:3500] || chr(10) || '[...]' || chr(10) || x[-8500:] ELSE x END) AS digest FROM t""",
)
def thread_text(spark: SparkSession, folder: str) -> DataFrame:
    """Each thread's text without its middle. Only chunks that reach its first 3,500 or last 8,500 characters are brought together."""
    doc = ["project", "source", "doc"]
    c = _documents(spark, folder).select(*doc, "place", "start", "n", F.coalesce("text", F.lit("")).alias("text"))
    total = c.groupBy(*doc).agg((F.sum("n") - 2).alias("chars"))
    c = c.join(total, doc).where("chars <= 12000 or start < 3500 or start + n > chars - 8500")
    x = F.array_sort(F.collect_list(F.struct("place", "start", "text")))
    rows = c.groupBy(*doc, "chars").agg(x.alias("x"))
    joined = lambda s: F.array_join(F.transform(F.filter("x", s), lambda y: y["text"]), "\n\n")
    first, last = joined(lambda y: y["start"] < 3500), joined(lambda y: y["start"] + F.length(y["text"]) + 2 > F.col("chars") - 8500)
    text = F.when(F.col("chars") > 12000, F.concat(F.substring(first, 1, 3500), F.lit("\n[...]\n"), F.substring(last, -8500, 8500))).otherwise(joined(lambda y: F.lit(True)))
    return rows.select(*doc, F.col("chars").cast("long").alias("chars"), F.md5(text).alias("digest"))


@QUERIES.add("middle_cut", "SELECT doc_id, CASE WHEN length(text) > 500 THEN text[1:200] || chr(10) || '[...]' || chr(10) || text[-300:] ELSE text END AS shown FROM documents WHERE text IS NOT NULL")
def cut_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of more than 500 characters without their middle."""
    return table(spark, folder, "documents", "doc_id", "text").where("text is not null").select("doc_id", middle_cut(F.col("text"), 200, 300).alias("shown"))


@QUERIES.add("gate_contains", "SELECT doc_id, contains(lower(text), 'server') AS ok, CASE WHEN contains(lower(text), 'server') THEN '' ELSE 'lacks server' END AS message FROM documents WHERE text IS NOT NULL")
def gate_contains(spark: SparkSession, folder: str) -> DataFrame:
    """gate on a required word."""
    ok = F.contains(F.lower("text"), F.lit("server"))
    return table(spark, folder, "documents", "doc_id", "text").where("text is not null").select("doc_id", ok.alias("ok"), F.when(ok, "").otherwise("lacks server").alias("message"))


@QUERIES.add("gate_length", "SELECT doc_id, length(text) BETWEEN 50 AND 1000 AS ok, CASE WHEN length(text) < 50 THEN 'too short' WHEN length(text) > 1000 THEN 'too long' ELSE '' END AS message FROM documents WHERE text IS NOT NULL")
def gate_length(spark: SparkSession, folder: str) -> DataFrame:
    """gate on the number of characters."""
    n = F.length("text")
    message = F.when(n < 50, "too short").when(n > 1000, "too long").otherwise("")
    return table(spark, folder, "documents", "doc_id", "text").where("text is not null").select("doc_id", n.between(50, 1000).alias("ok"), message.alias("message"))


@QUERIES.add("gate_regex", r"SELECT doc_id, regexp_matches(text, '^[A-Z][^\n]*[.!?]') AS ok FROM documents WHERE text IS NOT NULL")
def gate_regex(spark: SparkSession, folder: str) -> DataFrame:
    """gate on a pattern."""
    return table(spark, folder, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.col("text").rlike(r"^[A-Z][^\n]*[.!?]").alias("ok"))


@QUERIES.add(
    "split_claims",
    r"""WITH b AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?s)```.*?(```|\z)', ' ', 'g'), '(^|\n)[ \t]*([-*+]|[0-9]+[.])[ \t]+', '\1', 'g') AS x FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(x, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '[ \t\r\n]+', ' ', 'g'))), lambda s: len(string_split(s, ' ')) >= 5) AS c FROM b)
SELECT doc_id, len(c)::BIGINT AS claims, md5(array_to_string(c, chr(10))) AS digest FROM s""",
)
def split_claims(spark: SparkSession, folder: str) -> DataFrame:
    """CH12: the sentences of five words or more."""
    d = table(spark, folder, "documents", "doc_id", "text").where("text is not null").select("doc_id", T.claims(F.col("text")).alias("c"))
    return d.select("doc_id", F.size("c").cast("long").alias("claims"), F.md5(F.array_join("c", "\n")).alias("digest"))


@QUERIES.add("chunk_size_report", CUR + " SELECT project, source, count(*) AS chunks, sum(coalesce(length(text), 0))::BIGINT AS chars, avg((coalesce(length(text), 0) < 100)::INT) AS short_share, sum(coalesce(length(text), 0)) / 64000.0 AS seconds FROM cur GROUP BY ALL")
def chunk_size_report(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks, characters, share of short ones, and the estimated time to embed them at 80 chunks of 800 characters a second."""
    n = F.coalesce(F.length("text"), F.lit(0))
    c = current_chunks(spark, folder, "project", "source", "text").select("project", "source", n.alias("n"))
    return c.groupBy("project", "source").agg(F.count("*").alias("chunks"), F.sum("n").alias("chars"), F.avg((F.col("n") < 100).cast("int")).alias("short_share"), (F.sum("n") / 64000.0).alias("seconds"))


@QUERIES.add(
    "nearest_rank_percentiles",
    CUR + """, r AS (SELECT source, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text)) AS k, count(*) OVER (PARTITION BY source) AS m FROM cur WHERE text IS NOT NULL AND source IS NOT NULL)
SELECT source, q, n::BIGINT AS chars FROM r, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) t(q) WHERE k = least(m - 1, floor(m * q)) + 1""",
)
def nearest_rank_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest-rank percentiles of the chunks' sizes. Sizes are counted first, so only distinct sizes are ordered."""
    n = current_chunks(spark, folder, "source", "text").where("text is not null and source is not null").groupBy("source", F.length("text").alias("n")).agg(F.count("*").alias("c"))
    upto = W.partitionBy("source").orderBy("n")
    n = n.withColumn("upto", F.sum("c").over(upto)).withColumn("m", F.sum("c").over(W.partitionBy("source")))
    n = n.select("*", F.explode(F.array(*[F.lit(q) for q in (0.5, 0.9, 0.99)])).alias("q")).withColumn("k", F.least(F.col("m") - 1, F.floor(F.col("m") * F.col("q"))) + 1)
    return n.where("upto - c < k and k <= upto").select("source", "q", F.col("n").cast("long").alias("chars"))


@QUERIES.add("json_extract", CUR + ", j AS (SELECT rid, CASE WHEN json_valid(meta) THEN meta END AS m FROM cur) SELECT rid, json_extract_string(m, '$.kind') AS kind, json_extract_string(m, '$.author') AS author, try_cast(json_extract_string(m, '$.number') AS BIGINT) AS number FROM j")
def json_extract(spark: SparkSession, folder: str) -> DataFrame:
    """JS1: values of the JSON object of every chunk; null where it is cut short."""
    return current_chunks(spark, folder, "meta").select("rid", meta("kind").alias("kind"), meta("author").alias("author"), meta("number").try_cast("long").alias("number"))


@QUERIES.add("templated_filter", "WITH items1 AS (SELECT idx, max(title) AS title FROM items WHERE idx IS NOT NULL GROUP BY idx) SELECT idx, title FROM items1 WHERE regexp_matches(title, '(?i)(guard|merge|rename) [a-z]+ (for|in) ')")
def templated_filter(spark: SparkSession, folder: str) -> DataFrame:
    """F14, MD15: titles made from a template."""
    return _titles(spark, folder).where(F.col("title").rlike("(?i)(guard|merge|rename) [a-z]+ (for|in) "))
