"""What the query modules share: current chunks, and the same relation in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessel.operators.store import current
from tessel.sources.tables import table

_ORDER = ("updated", "ingested", "hash")


def current_chunks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Current rows of chunks; only the named columns and those that tell which row is current are read and shuffled."""
    need = dict.fromkeys(["rid", *columns, *_ORDER])
    return current(table(spark, folder, "chunks", *need), "rid", *_ORDER).select(*dict.fromkeys(["rid", *columns]))


CUR = """WITH cur AS (SELECT * FROM chunks WHERE rid IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY rid ORDER BY updated DESC NULLS LAST, ingested DESC NULLS LAST, hash DESC NULLS LAST) = 1)"""

#: Node ids folded to lower case without blanks around, live rows only, one a node (the last loaded).
NODE = """nodes1 AS (SELECT * FROM nodes WHERE id IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded DESC NULLS LAST, deleted_at DESC NULLS LAST, kind DESC NULLS LAST, title DESC NULLS LAST, chunk DESC NULLS LAST, created DESC NULLS LAST, indexed DESC NULLS LAST, state DESC NULLS LAST, project DESC NULLS LAST) = 1)"""
_NODE_ORDER = ("loaded", "deleted_at", "kind", "title", "chunk", "created", "indexed", "state", "project")


def current_nodes(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The last loaded row of each node id."""
    need = dict.fromkeys(["id", *columns, *_NODE_ORDER])
    return current(table(spark, folder, "nodes", *need), "id", *_NODE_ORDER).select(*dict.fromkeys(["id", *columns]))


def stopped(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)
