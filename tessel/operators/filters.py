"""Validated search filters and the conditions they stand for."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE = re.compile(r"^\d{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01])(T\d\d(:\d\d(:\d\d)?)?Z?)?)?)?$")


@dataclass(frozen=True)
class Where:
    """Conditions of a search. Dates have any precision from the year on; ``until`` includes all that begins with it."""

    since: str | None = None
    until: str | None = None
    date: str = "created"
    authors: tuple[str, ...] = field(default=())
    kinds: tuple[str, ...] | None = None
    sources: tuple[str, ...] | None = None
    open_only: bool = False

    @staticmethod
    def of(me: str | None = None, **given) -> Where:
        """Checks and normalises conditions; raises ValueError for unknown names, malformed dates and empty authors."""
        unknown = set(given) - set(Where.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown filter: {', '.join(sorted(unknown))}")
        for k in ("since", "until"):
            if given.get(k) is not None and not DATE.match(str(given[k])):
                raise ValueError(f"{k} is no date: {given[k]}")
        if given.get("date", "created") not in ("created", "updated"):
            raise ValueError("date is either created or updated")
        names = []
        for a in given.get("authors") or ():
            a = (me if a == "me" and me else a).strip().lstrip("@").lower()
            if not a:
                raise ValueError("an author is empty")
            names.append(a)
        return Where(**{**given, "authors": tuple(dict.fromkeys(names))})


def meta(key: str, column: str = "meta") -> Column:
    """A key of the JSON object in ``column``; null where the object is cut short or lacks it."""
    return F.get_json_object(column, f"$.{key}")


def date_of(kind: str = "created") -> Column:
    """The date that a filter compares: created or else published; or updated, else published, else created."""
    names = ("created", "published") if kind == "created" else ("updated", "published", "created")
    return F.coalesce(*[meta(n) for n in names])


def in_range(date: Column, since: str | None, until: str | None) -> Column:
    """String comparison at the bounds' own precision, both included; a null date is in no range."""
    out = F.lit(True)
    if since:
        out &= date >= since
    if until:
        out &= date <= until + "~"
    return out


def by_authors(authors: tuple[str, ...]) -> Column:
    return F.lower(meta("author")).isin(*authors) | F.coalesce(F.lower(meta("author_name")).isin(*authors), F.lit(False))


def with_inherited_state(chunks: DataFrame) -> DataFrame:
    """``state``: a chunk's own one, or that of the head chunk of its document.

    Heads are one row a document, so the join multiplies nothing; many chunks of one document meet one row.
    """
    heads = chunks.where(is_head()).select("project", "source", "doc", meta("state").alias("_state")).groupBy("project", "source", "doc").agg(F.max("_state").alias("_state"))
    return chunks.join(heads, ["project", "source", "doc"], "left").withColumn("state", F.coalesce(meta("state"), "_state")).drop("_state")


def is_head() -> Column:
    """Head chunks of documents: no continuation, no comment, review or later post; of a release, its header."""
    return ~F.col("id").contains("~") & ~F.col("id").rlike(":(comment|review):") & (~F.col("id").contains(":release:") | F.col("id").endswith(":header"))


def is_open(state: Column) -> Column:
    """No state counts as open."""
    return ~F.coalesce(state, F.lit("open")).isin("closed", "merged")


def apply(chunks: DataFrame, where: Where) -> DataFrame:
    """``chunks`` that meet all conditions, before any ranking."""
    df = chunks
    if where.sources is not None:
        df = df.where(F.col("source").isin(*where.sources) | F.concat_ws("/", "project", "source").isin(*where.sources))
    if where.kinds is not None:
        df = df.where(F.coalesce(meta("kind"), F.lit("file")).isin(*where.kinds))
    if where.since or where.until:
        df = df.where(in_range(date_of(where.date), where.since, where.until))
    if where.authors:
        df = df.where(by_authors(where.authors))
    if where.open_only:
        df = with_inherited_state(df).where(is_open(F.col("state"))).drop("state")
    return df
