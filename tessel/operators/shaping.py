"""Shaping of delivered rows: selection of work, sections of releases, cascades, JSON updates, names and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.functions.chunkers import Piece, markdown


def stale(rows: DataFrame, fetched: str, cutoff: str, most: int) -> DataFrame:
    """Rows never fetched or last fetched at or before a cutoff, the stalest first, ``most`` a run."""
    at = F.coalesce(F.col(fetched), F.lit(""))
    return rows.where(at <= cutoff).orderBy(at, *rows.columns[:1]).limit(most)


def lacking(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no finished row."""
    return rows.join(done.select(key), key, "left_anti")


def release_pieces(text: str, head: int = 800) -> list[Piece]:
    """A release's first ``head`` characters, and its sections where it is longer: a chunker."""
    return [Piece("header", text[:head], 1), *(markdown(text) if len(text) > head else [])]


def cascade(gone: DataFrame, key: str, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """The tables without the rows of vanished keys."""
    return tuple(t.join(gone.select(key), key, "left_anti") for t in tables)


def re_prefixed(chunks: DataFrame, id_: str, prefixes: dict[str, str]) -> DataFrame:
    """Ids under new prefixes, the longest old prefix first; others stay."""
    out = F.col(id_)
    for old in sorted(prefixes, key=len):
        out = F.when(F.col(id_).startswith(old), F.concat(F.lit(prefixes[old]), F.substring(id_, len(old) + 1, 1 << 30))).otherwise(out)
    return chunks.withColumn(id_, out)


def json_set(document: Column, **values: Column) -> Column:
    """A JSON object of strings with keys set or replaced; null or broken objects count as empty."""
    held = F.coalesce(F.from_json(document, T.MapType(T.StringType(), T.StringType())), F.create_map().cast("map<string,string>"))
    new = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    return F.to_json(F.map_concat(F.map_filter(held, lambda k, _: ~k.isin(*values)), new))


def filled(given: Column, defaults: dict[str, str]) -> Column:
    """A map with defaults for keys that are absent or null; what is given wins."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    own = F.map_filter(F.coalesce(given, F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)


def diff_tail(hunk: Column, lines: int = 6) -> Column:
    """The last lines of a diff hunk."""
    parts = F.split(hunk, "\n")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - lines + 1), lines), "\n")


def node_id(kind: Column, repo: Column, ref: Column) -> Column:
    """The id of a node: owner/repo#n for items, else kind:owner/repo and its mark and reference."""
    mark = F.when(kind == "file", ":").otherwise("@")
    return F.when(kind.isin("issue", "pr"), F.concat(repo, F.lit("#"), ref)).when(kind == "topic", F.concat(F.lit("topic:"), repo, F.lit("/"), ref)).otherwise(F.concat(kind, F.lit(":"), repo, mark, ref))


def summary_line(title: Column, state: Column, author: Column, created: Column) -> Column:
    """One line on a hit: title, and in brackets what is known of state, author and day."""
    known = F.concat_ws(", ", state, author, F.substring(created, 1, 10))
    return F.concat(title, F.when(known != "", F.concat(F.lit(" ("), known, F.lit(")"))).otherwise(""))


def too_short(text: Column, words: int = 3, characters: int = 6) -> Column:
    """Whether a text has too few words, or characters where its script has no blanks."""
    flat = F.trim(F.coalesce(text, F.lit("")))
    cjk = flat.rlike("[\\u3040-\\u30ff\\u3400-\\u9fff\\uac00-\\ud7af]")
    return F.when(cjk, F.length(flat) < characters).otherwise(F.size(F.filter(F.split(flat, r"\s+"), lambda w: w != "")) < words)


def merged_counts(*parts: DataFrame, by: list[str], value: str) -> DataFrame:
    """Counters of several projects added up."""
    whole = parts[0].select(*by, value)
    for p in parts[1:]:
        whole = whole.unionByName(p.select(*by, value))
    return whole.groupBy(*by).agg(F.sum(value).alias(value))


def duplicated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, as a check before they are relied on."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def cache_bytes(layers: Column, tokens: Column, scale: float = 1.0) -> Column:
    """Memory of an attention cache over (heads, width, window) layers: two tensors of two bytes, no longer than a layer's window."""
    return F.aggregate(layers, F.lit(0.0), lambda a, x: a + 4.0 * scale * x["heads"] * x["width"] * F.least(tokens, F.coalesce(x["window"], tokens)))
