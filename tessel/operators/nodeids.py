"""Canonical node ids of the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind prefix, owner/repo, and the rest of an id, all in lower case.
ID = r"^((?:commit|release|file):)?([^/#@:\s]+/[^/#@:\s]+)([#@:].*)$"


def folded(value: Column) -> Column:
    """Lower case, without white space around it."""
    return F.lower(F.regexp_replace(value, r"^\s+|\s+$", ""))


def with_canonical_id(df: DataFrame, column: str, aliases: DataFrame, to: str) -> DataFrame:
    """``df`` with ``to``: the id in ``column`` folded, and a repo's former name in it replaced.

    ``aliases`` has rows (alias, repo); a repeated alias counts once (its least repo), null aliases never match. An id that names no
    repo is only folded; a null id stays null. The join is on the repo, so it stays a broadcast while aliases are few.
    """
    now = aliases.select(folded(F.col("alias")).alias("_repo"), folded(F.col("repo")).alias("_new")).where("_repo is not null").groupBy("_repo").agg(F.min("_new").alias("_new"))
    df = df.withColumn("_id", folded(F.col(column))).withColumn("_repo", F.regexp_extract("_id", ID, 2))
    # only ids of a renamed repo are taken apart again
    new = F.when(F.col("_new").isNotNull(), F.concat(F.regexp_extract("_id", ID, 1), "_new", F.regexp_extract("_id", ID, 3))).otherwise(F.col("_id"))
    return df.join(now, "_repo", "left").withColumn(to, new).drop("_id", "_repo", "_new")


def id_kind(value: Column) -> Column:
    """commit, release, file, topic, item (issue or pull request) or other, by the form of an id."""
    prefix = F.regexp_extract(value, r"^(commit|release|file|topic):", 1)
    return F.when(prefix != "", prefix).when(value.rlike(r"^[^/#@:\s]+/[^/#@:\s]+#[0-9]+$"), "item").otherwise("other")
