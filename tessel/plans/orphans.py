"""Orphan references of the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators.nodeids import id_kind, with_canonical_id
from tessel.operators.orphans import orphan_references
from tessel.plans.registry import Registry
from tessel.sources.tables import table

QUERIES = Registry()


def orphan_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Ends of distinct edges that name no live node: (src, dst, type, seen, side, node, reason)."""
    aliases = table(spark, folder, "repo_aliases")
    nodes = with_canonical_id(table(spark, folder, "nodes", "id", "indexed", "loaded", "deleted_at"), "id", aliases, "node")
    edges = table(spark, folder, "edges", "src", "dst", "type", "seen").groupBy("src", "dst", "type").agg(F.min("seen").alias("seen"))
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(s).alias("end"))
    ends = edges.select("*", F.explode(F.array(side("src"), side("dst"))).alias("_e")).select("src", "dst", "type", "seen", "_e.*").where("end is not null")
    ends = with_canonical_id(ends, "end", aliases, "node")
    return orphan_references(ends, "node", "seen", nodes, "node", F.col("indexed") == 1, "loaded", "deleted_at")


_SQL = r"""
WITH al AS (SELECT lower(regexp_replace(alias, '^\s+|\s+$', '', 'g')) a, min(lower(regexp_replace(repo, '^\s+|\s+$', '', 'g'))) r FROM repo_aliases GROUP BY 1),
n0 AS (SELECT lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) k, indexed, loaded, deleted_at FROM nodes),
n AS (SELECT coalesce(regexp_extract(k, '{id}', 1) || al.r || regexp_extract(k, '{id}', 3), k) k, indexed, loaded, deleted_at
      FROM n0 LEFT JOIN al ON regexp_extract(k, '{id}', 2) = al.a),
e AS (SELECT src, dst, type, min(seen) seen FROM edges GROUP BY ALL),
s0 AS (SELECT *, 'src' side, lower(regexp_replace(src, '^\s+|\s+$', '', 'g')) k FROM e WHERE src IS NOT NULL
       UNION ALL SELECT *, 'dst', lower(regexp_replace(dst, '^\s+|\s+$', '', 'g')) FROM e WHERE dst IS NOT NULL),
s AS (SELECT src, dst, type, seen, side, coalesce(regexp_extract(k, '{id}', 1) || al.r || regexp_extract(k, '{id}', 3), k) k
      FROM s0 LEFT JOIN al ON regexp_extract(k, '{id}', 2) = al.a),
o AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.k = s.k AND n.indexed = 1 AND n.loaded <= s.seen AND (n.deleted_at IS NULL OR n.deleted_at > s.seen)))
""".replace("{id}", r"^((?:commit|release|file):)?([^/#@:\s]+/[^/#@:\s]+)([#@:].*)$")


@QUERIES.add("p3_found", _SQL + "SELECT src, dst, type, side FROM o")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Ends of edges that name no live node."""
    return orphan_ends(spark, folder).select("src", "dst", "type", "side")


@QUERIES.add(
    "p3_report",
    _SQL
    + r"""
SELECT CASE WHEN regexp_extract(k, '^(commit|release|file|topic):', 1) <> '' THEN regexp_extract(k, '^(commit|release|file|topic):', 1)
            WHEN regexp_matches(k, '^[^/#@:\s]+/[^/#@:\s]+#[0-9]+$') THEN 'item' ELSE 'other' END AS kind,
       strftime(seen AT TIME ZONE 'UTC', '%Y-%m') AS month, side,
       CASE WHEN NOT EXISTS (SELECT 1 FROM n WHERE n.k = o.k) THEN 'absent'
            WHEN NOT EXISTS (SELECT 1 FROM n WHERE n.k = o.k AND indexed = 1) THEN 'unusable'
            WHEN NOT EXISTS (SELECT 1 FROM n WHERE n.k = o.k AND indexed = 1 AND loaded <= o.seen) THEN 'later' ELSE 'deleted' END AS reason,
       count(*) AS refs, count(DISTINCT k) AS targets
FROM o GROUP BY ALL""",
)
def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per kind of node, month of the reference, side and reason."""
    o = orphan_ends(spark, folder)
    month = F.date_format("seen", "yyyy-MM").alias("month")
    per_target = o.groupBy(id_kind(F.col("node")).alias("kind"), month, "side", "reason", "node").agg(F.count("*").alias("n"))
    return per_target.groupBy("kind", "month", "side", "reason").agg(F.sum("n").alias("refs"), F.count("*").alias("targets"))
