"""Feeds as DataFrames: commit logs, item payloads, releases, JSON lines, versioned outputs, cursors."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a commit record. Fixed values.
COMMIT = ("sha", "parents", "author_name", "author_email", "date", "subject", "body", "files")


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits of a log whose records end with \\x1e and whose fields with \\x1f; the last field has one path a line."""
    lines = spark.read.option("lineSep", "\x1e").text(path).where(F.length(F.trim(F.regexp_replace("value", r"[\r\n]", ""))) > 0)
    f = F.split(F.regexp_replace("value", r"^[\r\n]+", ""), "\x1f")
    rows = lines.select(*[F.try_element_at(f, F.lit(i + 1)).alias(c) for i, c in enumerate(COMMIT)])
    return rows.withColumn("files", F.filter(F.transform(F.split("files", "\n"), F.trim), lambda x: x != ""))


def commit_chunks(commits: DataFrame, source: str, most: int = 20) -> DataFrame:
    """Chunks (id, doc, title, text, meta) of commits: no bots, no empty ones; a merge is titled by what it merges; long file lists end in a count."""
    bot = F.lower("author_name").rlike(r"\[bot\]|(^|-)bot$")
    merged = F.regexp_extract("subject", r"^Merge pull request #(\d+)", 1)
    first = F.element_at(F.split(F.trim("body"), "\n"), 1)
    title = F.when((merged != "") & (F.length(F.trim("body")) > 0), F.concat(first, F.lit(" (#"), merged, F.lit(")"))).otherwise(F.col("subject"))
    n = F.size("files")
    listed = F.when(n > most, F.concat(F.array_join(F.slice("files", 1, most), "\n"), F.lit("\nand "), (n - most).cast("string"), F.lit(" more"))).otherwise(F.array_join("files", "\n"))
    rows = commits.where(~F.coalesce(bot, F.lit(False)) & (F.length(F.trim(F.coalesce("subject", F.lit("")))) > 0))
    meta = F.to_json(F.struct(F.lit("commit").alias("kind"), "sha", "author_name", F.col("date").alias("created")))
    return rows.select(
        F.concat(F.lit(f"{source}:commit:"), "sha").alias("id"), F.concat(F.lit("commit:"), "sha").alias("doc"), title.alias("title"),
        F.concat_ws("\n\n", "subject", F.when(F.length(F.trim("body")) > 0, F.col("body")), F.when(n > 0, listed)).alias("text"), meta.alias("meta"),
    )


def is_noise(author: Column, body: Column) -> Column:
    """Bots, empty bodies, and bodies that are one slash command."""
    flat = F.trim(F.coalesce(body, F.lit("")))
    return F.lower(F.coalesce(author, F.lit(""))).rlike(r"\[bot\]$|-bot$") | (flat == "") | flat.rlike(r"^/\w+[^\n]*$")


def routed(items: DataFrame, includes: dict[str, list[str]]) -> DataFrame:
    """Items (kind, merged, state) with ``source``, the one whose list has their kind, and state merged before any other."""
    names = F.lit(None).cast("string")
    for source, kinds in reversed(includes.items()):
        names = F.when(F.col("kind").isin(*kinds), source).otherwise(names)
    return items.withColumn("source", names).where("source is not null").withColumn("state", F.when(F.col("merged"), "merged").otherwise(F.col("state")))


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Appends JSON lines whose key the output does not have yet, so an interrupted run may be repeated."""
    spark = rows.sparkSession
    try:
        done = spark.read.schema(rows.schema).json(path).select(key)
        rows = rows.join(done, key, "left_anti")
    except AnalysisException as e:
        if not absent(e):
            raise
    rows.dropDuplicates([key]).write.mode("append").json(path)


def absent(error: Exception) -> bool:
    """Whether a read failed because its path does not exist, and for no other reason."""
    return isinstance(error, AnalysisException) and error.getCondition() == "PATH_NOT_FOUND"


def publish(df: DataFrame, path: str, params: dict) -> str:
    """Writes a new version beside the others, then the pointer to it; readers see the old or the new version whole.

    Versions are numbered; a pointer names its number, its folder and its parameters. Writers of one path must take turns.
    """
    spark = df.sparkSession
    last = _newest(spark, path)
    number = last["number"] + 1 if last else 1
    version = f"{path}/v{number}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(version)
    pointer = spark.createDataFrame([(json.dumps({"number": number, "version": version, "params": params}, sort_keys=True),)], "value string")
    pointer.coalesce(1).write.mode("append").text(f"{path}/_pointers")
    return version


def _newest(spark: SparkSession, path: str) -> dict | None:
    """The pointer with the greatest number, None where nothing was published yet; other failures are raised."""
    try:
        lines = spark.read.text(f"{path}/_pointers")
    except AnalysisException as e:
        if absent(e):
            return None
        raise
    number = F.get_json_object("value", "$.number").cast("long")
    last = lines.select(F.max_by("value", number).alias("v")).first()
    return json.loads(last.v) if last.v else None


def published(spark: SparkSession, path: str) -> tuple[DataFrame, dict] | None:
    """The newest version and its parameters, None where nothing was published yet."""
    at = _newest(spark, path)
    return (spark.read.parquet(at["version"]), at["params"]) if at else None


def unchanged(spark: SparkSession, path: str, params: dict) -> bool:
    """Whether the newest version was made with these parameters."""
    at = _newest(spark, path)
    return at is not None and at["params"] == params


def after_cursor(feed: DataFrame, cursor: str | None, time_column: str) -> DataFrame:
    """What a forward cursor has yet to read; rows at the cursor are read again, which upserts make harmless."""
    return feed if cursor is None else feed.where(F.col(time_column) >= cursor)


def windows(frontier: int, floor: int, first: int = 30, most: int = 730) -> object:
    """Backfill windows (start, end) in days before ``frontier``; ``send`` the number of items met, which sizes the next window."""
    size, end = first, frontier
    while end > floor:
        start = max(floor, end - size)
        met = yield start, end
        end = start
        if met is not None:
            size = min(most, size * 2) if met < 300 else max(1, size // 2) if met > 1500 else size


def due(sources: DataFrame, now: float, last: str = "last_sync", interval: str = "min_interval") -> DataFrame:
    """Sources whose last run is long enough ago, or that never ran."""
    return sources.where(F.col(last).isNull() | (F.lit(now) - F.col(last) >= F.col(interval)))
