"""Queries on ordered events, sessions and state, and the text functions that SQL cannot say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY
from pyspark.sql import Window as W

from tessel.functions import chunkers, ocr
from tessel.functions.references import Parser
from tessel.operators import chunking
from tessel.operators.series import running_total
from tessel.plans.base import current_chunks
from tessel.plans.registry import Registry
from tessel.sources.tables import table

QUERIES = Registry()
_US = "epoch_us(ts)"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").where("user_id is not null and ts is not null")
    return e.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("day", F.to_date("ts"))


def _by():
    return W.partitionBy("user_id").orderBy("ts", "event_id")


@QUERIES.add("sliding_growth", "SELECT event_id, value - min(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS growth FROM events QUALIFY growth >= 20")
def sliding_growth(spark: SparkSession, folder: str) -> DataFrame:
    """ST5: events whose value rose by 20 or more above the least of the day before."""
    w = W.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0)
    return _events(spark, folder).select("event_id", (F.col("value") - F.min("value").over(w)).alias("growth")).where("growth >= 20")


@QUERIES.add("trailing_window", "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 900 MINUTE GROUP BY event_type")
def trailing_window(spark: SparkSession, folder: str) -> DataFrame:
    """ST6: what happened in the last 900 minutes."""
    e = _events(spark, folder)
    last = e.agg(F.max("us").alias("last"))  # one row
    return e.crossJoin(F.broadcast(last)).where("us >= last - 900L * 60 * 1000000").groupBy("event_type").agg(F.count("*").alias("n"))


@QUERIES.add("session_gap", f"WITH g AS (SELECT *, CASE WHEN {_US} - lag({_US}) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 21600000000 THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min({_US}) AS began, count(*) AS n FROM k GROUP BY user_id, k")
def session_gap(spark: SparkSession, folder: str) -> DataFrame:
    """ST7: sessions of a user: events less than six hours apart."""
    s = _events(spark, folder).groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_micros("w.start").alias("began"), "n")


@QUERIES.add("idle_ttl", f"WITH l AS (SELECT user_id, max({_US}) AS last FROM events GROUP BY user_id) SELECT user_id, ((SELECT max(last) FROM l) - last) // 1000000 AS idle FROM l WHERE (SELECT max(last) FROM l) - last > 43200000000")
def idle_ttl(spark: SparkSession, folder: str) -> DataFrame:
    """ST8: users idle for more than half a day, in seconds."""
    last = _events(spark, folder).groupBy("user_id").agg(F.max("us").alias("last"))
    now = last.agg(F.max("last").alias("now"))  # one row
    return last.crossJoin(F.broadcast(now)).where("now - last > 43200000000").select("user_id", F.floor((F.col("now") - F.col("last")) / 1_000_000).alias("idle"))


@QUERIES.add("lease_durations", f"SELECT user_id, arg_max(event_type, ({_US}, event_id)) AS status, max({_US}) - min({_US}) AS micros, count(*) AS n FROM events GROUP BY user_id")
def lease_durations(spark: SparkSession, folder: str) -> DataFrame:
    """ST9: the last status of each, and from first to last."""
    e = _events(spark, folder)
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("us", "event_id")).alias("status"), (F.max("us") - F.min("us")).alias("micros"), F.count("*").alias("n"))


@QUERIES.add("keep_last_n", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def keep_last_n(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's last twenty events."""
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _events(spark, folder).select("user_id", "event_id", "ts", F.row_number().over(w).alias("n")).where("n <= 20").select("user_id", "event_id")


@QUERIES.add("lru_evictable", "WITH l AS (SELECT user_id, max(ts) AS last, arg_max(event_type, (epoch_us(ts), event_id)) AS status FROM events GROUP BY user_id) SELECT user_id FROM l WHERE status <> 'purchase' ORDER BY last, user_id LIMIT 25")
def lru_evictable(spark: SparkSession, folder: str) -> DataFrame:
    """The 25 least recently used that aren't pinned."""
    last = _events(spark, folder).groupBy("user_id").agg(F.max("us").alias("last"), F.max_by("event_type", F.struct("us", "event_id")).alias("status"))
    return last.where("status <> 'purchase'").orderBy("last", "user_id").limit(25).select("user_id")


@QUERIES.add("lru_prune", "WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id) SELECT user_id FROM l QUALIFY row_number() OVER (ORDER BY last, user_id) <= greatest(0, (SELECT count(*) FROM l) - 100 + 10)")
def lru_prune(spark: SparkSession, folder: str) -> DataFrame:
    """What goes when a cache of a hundred is pruned to nine tenths."""
    last = _events(spark, folder).groupBy("user_id").agg(F.max("us").alias("last"))
    kept = last.orderBy(F.desc("last"), F.desc("user_id")).limit(90).select("user_id")
    return last.select("user_id").join(F.broadcast(kept), "user_id", "left_anti")  # ninety rows


@QUERIES.add("running_zscore", "SELECT event_id, floor((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 0.000000001) * 1000 + 0.5)::BIGINT AS thousandths FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_zscore(spark: SparkSession, folder: str) -> DataFrame:
    """Each value's standard score among a user's so far."""
    w = _by().rowsBetween(W.unboundedPreceding, 0)
    z = (F.col("value") - F.avg("value").over(w)) / (F.stddev_pop("value").over(w) + 1e-9)
    return _events(spark, folder).select("event_id", F.floor(z * 1000 + 0.5).alias("thousandths"))


@QUERIES.add("cumulative_start", "SELECT event_id, (sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - round(value * 100)::BIGINT)::BIGINT AS start FROM events")
def cumulative_start(spark: SparkSession, folder: str) -> DataFrame:
    """Where each event begins if a user's values are durations one after another; days are summed up first."""
    e = _events(spark, folder).withColumn("n", F.round(F.col("value") * 100).cast("long"))
    return running_total(e, ["user_id"], F.col("day"), ["ts", "event_id"], "n", "upto").select("event_id", (F.col("upto") - F.col("n")).alias("start"))


@QUERIES.add(
    "interpolate_gaps",
    """WITH e AS (SELECT *, CASE WHEN event_id % 5 <> 0 THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
g AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS v0, last_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER a AS k0, first_value(v IGNORE NULLS) OVER b AS v1, first_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER b AS k1 FROM e
 WINDOW a AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, floor(coalesce(CASE WHEN k1 > k0 THEN v0 + (v1 - v0) * (k - k0) / (k1 - k0) END, v0, v1) * 1000 + 0.5)::BIGINT AS thousandths FROM g""",
)
def interpolate_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Unknown values, here of every fifth event, on the line between the known ones around them."""
    e = _events(spark, folder).withColumn("v", F.when(F.col("event_id") % 5 != 0, F.col("value"))).withColumn("k", F.row_number().over(_by()))
    w = W.partitionBy("user_id").orderBy("k")
    known = F.when(F.col("v").isNotNull(), F.struct("k", "v"))
    e = e.withColumn("a", F.last(known, True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("b", F.first(known, True).over(w.rowsBetween(0, W.unboundedFollowing)))
    line = F.when(F.col("b.k") > F.col("a.k"), F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("k") - F.col("a.k")) / (F.col("b.k") - F.col("a.k")))
    return e.select("event_id", F.floor(F.coalesce(line, "a.v", "b.v") * 1000 + 0.5).alias("thousandths"))


@QUERIES.add(
    "caption_sessions",
    f"""WITH g AS (SELECT *, CASE WHEN {_US} - lag({_US}) OVER w <= 7200000000 AND lag(event_type) OVER w <> 'purchase' THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g), r AS (SELECT *, (row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) - 1) // 9 AS part FROM k)
SELECT user_id, min(event_id) AS first_event, count(*) AS n FROM r GROUP BY user_id, k, part""",
)
def caption_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """CH16: lines that end at a gap, after an ending event, or when nine are full."""
    same = (F.col("us") - F.lag("us").over(_by()) <= 7_200_000_000) & (F.lag("event_type").over(_by()) != "purchase")
    e = _events(spark, folder).withColumn("s", F.when(same, 0).otherwise(1)).withColumn("k", F.sum("s").over(_by().rowsBetween(W.unboundedPreceding, 0)))
    part = F.floor((F.row_number().over(W.partitionBy("user_id", "k").orderBy("ts", "event_id")) - 1) / 9)
    return e.withColumn("part", part).groupBy("user_id", "k", "part").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n")).select("user_id", "first_event", "n")


@QUERIES.add("fold_runs", "WITH g AS (SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id FROM g QUALIFY row_number() OVER (PARTITION BY user_id, event_type, k ORDER BY ts, event_id) <= 2")
def fold_runs(spark: SparkSession, folder: str) -> DataFrame:
    """CH15: of every run of one type, the first two."""
    k = F.row_number().over(_by()) - F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    e = _events(spark, folder).withColumn("k", k)
    return e.withColumn("n", F.row_number().over(W.partitionBy("user_id", "event_type", "k").orderBy("ts", "event_id"))).where("n <= 2").select("event_id")


@QUERIES.add("progress_fraction", "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, min((n - 2) / 20.0::DOUBLE))) AS fraction FROM n GROUP BY user_id")
def progress_fraction(spark: SparkSession, folder: str) -> DataFrame:
    """How far the slowest stream of each is, between 0 and 1."""
    n = _events(spark, folder).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.min((F.col("n") - 2) / F.lit(20.0)))).alias("fraction"))


@QUERIES.add("resident_budget", "WITH l AS (SELECT user_id, arg_max(round(value * 100)::BIGINT, (epoch_us(ts), event_id)) AS held FROM events GROUP BY user_id) SELECT sum(held)::BIGINT AS held, greatest(0, 1000000 - sum(held))::BIGINT AS free FROM l")
def resident_budget(spark: SparkSession, folder: str) -> DataFrame:
    """What is held in all, and what a budget leaves."""
    held = F.max_by(F.round(F.col("value") * 100).cast("long"), F.struct("us", "event_id")).alias("held")
    last = _events(spark, folder).groupBy("user_id").agg(held)
    return last.agg(F.sum("held").alias("held"), F.greatest(F.lit(0), F.lit(1_000_000) - F.sum("held")).alias("free"))


# ---- text functions that SQL cannot say: rows only, tested on fixtures -----------------------------------------------------------


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return current_chunks(spark, folder, "source", "text")


def _size(pieces: DataFrame, key: str = "rid") -> DataFrame:
    return pieces.select(key, "n", "name", "line", F.length("text").alias("chars"))


@QUERIES.add("chunk_split_big")
def chunk_split_big(spark: SparkSession, folder: str) -> DataFrame:
    """CH1: every text at blank lines."""
    return _size(chunking.chunked(_texts(spark, folder), "rid", "text", chunkers.plain))


@QUERIES.add("chunk_markdown")
def chunk_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """CH4, CH7, SRC15: every document by its headings, with unique names."""
    d = table(spark, folder, "documents", "doc_id", "text")
    pieces = chunking.chunked(d, "doc_id", "text", chunkers.markdown)
    return chunking.unique_names(pieces, "doc_id", "name", "id").select("doc_id", "n", "id", "line", F.length("text").alias("chars"))


def _code(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).where("source = 'code'")


@QUERIES.add("chunk_scala")
def chunk_scala(spark: SparkSession, folder: str) -> DataFrame:
    """CH2: code by definitions."""
    return _size(chunking.chunked(_code(spark, folder), "rid", "text", chunkers.scala))


@QUERIES.add("chunk_java")
def chunk_java(spark: SparkSession, folder: str) -> DataFrame:
    """CH3: code by members of types."""
    return _size(chunking.chunked(_code(spark, folder), "rid", "text", chunkers.java))


def _packed(text: str) -> list[chunkers.Piece]:
    return chunkers.pack(chunkers.scala(text))


@QUERIES.add("pack_small_units")
def pack_small_units(spark: SparkSession, folder: str) -> DataFrame:
    """CH6: small neighbouring definitions in one piece."""
    return _size(chunking.chunked(_code(spark, folder), "rid", "text", _packed))


@QUERIES.add("code_comments")
def code_comments(spark: SparkSession, folder: str) -> DataFrame:
    """CH8: the comments of all texts that hold code, in whatever kind of chunk."""
    return _size(chunking.chunked(_texts(spark, folder), "rid", "text", chunkers.one(chunkers.code_comments)))


@QUERIES.add("sentence_groups")
def sentence_groups(spark: SparkSession, folder: str) -> DataFrame:
    """CH9: sentences packed for speech."""
    return _size(chunking.chunked(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", chunkers.sentence_groups), "doc_id")


@QUERIES.add("phrases")
def phrases(spark: SparkSession, folder: str) -> DataFrame:
    """CH10: phrases of 4 to 12 words."""
    return _size(chunking.chunked(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", chunkers.phrases), "doc_id")


@QUERIES.add("gist")
def gist(spark: SparkSession, folder: str) -> DataFrame:
    """CH13: every document's first paragraph of prose."""
    return chunking.chunked(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", chunkers.one(chunkers.gist)).select("doc_id", "text")


@QUERIES.add("fold_trace")
def fold_trace(spark: SparkSession, folder: str) -> DataFrame:
    """CH15: texts with folded stack traces."""
    return _size(chunking.chunked(_texts(spark, folder), "rid", "text", chunkers.one(chunkers.fold_trace)))


@QUERIES.add("parse_refs")
def parse_refs(spark: SparkSession, folder: str) -> DataFrame:
    """STR12 to STR14, J12: references in every current chunk."""
    hosts = ("forge.example", "quill.example", "anvil.example", "lathe.example")
    return chunking.references(_texts(spark, folder), "rid", "text", Parser(hosts, ("talk.forge.example",)))


_LINES = [("a", 0, "The index ends up empty after the", [0.0, 0.0, 100.0, 10.0]), ("a", 1, "update of the server.", [0.0, 11.0, 62.0, 10.0]), ("b", 0, "Name", [0.0, 0.0, 20.0, 10.0]), ("b", 1, "Price", [0.0, 12.0, 22.0, 10.0])]


@QUERIES.add("ocr_paragraphs")
def ocr_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """STR24: recognised lines joined into paragraphs, page by page."""
    lines = spark.createDataFrame(_LINES, "page string, n int, text string, box array<double>")

    @F.pandas_udf(TY.ArrayType(TY.StringType()))
    def joined(pages):
        import pandas as pd

        return pd.Series([ocr.paragraphs([{"text": x["text"], "box": None if x["box"] is None else list(x["box"])} for x in p]) for p in pages])

    # a page's lines are a bounded unit
    pages = lines.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("n", "text", "box"))).alias("lines"))
    return pages.select("page", F.posexplode(joined("lines")).alias("n", "text"))
