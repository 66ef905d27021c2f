"""Building the link graph: nodes of items and commits, and typed edges from the references in their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions.references import Parser
from tessel.operators.chunking import references
from tessel.operators.graph import edge_confidence, strongest
from tessel.operators.nodeids import folded

def link_targets(refs: DataFrame, repo: str) -> DataFrame:
    """References (kind, repo, ref) with ``target``, the id of the node they name; those without a repo are in the text's own, ``repo``."""
    where = F.coalesce(F.col("repo"), F.col(repo))
    target = F.when(F.col("kind") == "commit", F.concat(F.lit("commit:"), where, F.lit("@"), "ref")).when(F.col("kind") == "topic", F.concat(F.lit("topic:"), where, F.lit("/"), "ref"))
    return refs.withColumn("target", F.lower(target.otherwise(F.concat(where, F.lit("#"), "ref"))))


def resolved_commits(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` whose short commit ids are the full ones of ``nodes`` (id) where exactly one begins so; others stay as they are.

    The join is on the first seven letters, so it is an equi-join; no prefix is compared with all commits.
    """
    form = r"^commit:(.+)@([0-9a-f]{7,40})$"
    short = edges.select("dst").distinct().where(F.col("dst").rlike(form)).select("dst", F.regexp_extract("dst", form, 1).alias("_r"), F.regexp_extract("dst", form, 2).alias("_s"))
    full = nodes.select(F.lower("id").alias("_id")).distinct().where(F.col("_id").rlike(r"^commit:.+@[0-9a-f]{40}$"))
    full = full.select("_id", F.regexp_extract("_id", form, 1).alias("_r"), F.regexp_extract("_id", form, 2).alias("_f"))
    key = lambda c: F.substring(c, 1, 7)
    met = short.withColumn("_k", key("_s")).join(full.withColumn("_k", key("_f")), ["_r", "_k"]).where("startswith(_f, _s)")
    one = met.groupBy("dst").agg(F.min("_id").alias("_id"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return edges.join(one, "dst", "left").withColumn("dst", F.coalesce("_id", "dst")).drop("_id")


def build_edges(texts: DataFrame, parser: Parser, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst, type, conf, how, snip, known) of the references in ``texts`` (key, node, repo, how, text), ``nodes`` having ids; ``how`` says what the text is.

    A closing reference makes an edge of type closes, any other one of type mentions; of several of one kind between two nodes the
    surest stays, and a mention goes where the same two nodes are joined by a closing. ``known`` is false for a dangling end, whose
    target no node has; its certainty is a half. Confidence is the base of ``how``, or of closing, times that. A node's references to itself are none. Rows without a node or text give no edge.
    """
    own = texts.where("node is not null and text is not null").select("key", folded(F.col("node")).alias("src"), F.lower("repo").alias("own_repo"), "how", "text")
    refs = references(own.select("key", "text"), "key", "text", parser).join(own.select("key", "src", "own_repo", "how"), "key")
    edges = link_targets(refs, "own_repo").where("target is not null and target != src")
    edges = edges.select("src", F.col("target").alias("dst"), F.when(F.col("closing") & (F.col("kind") == "issue"), "closes").otherwise("mentions").alias("type"), F.when(F.col("closing"), "closing").otherwise(F.col("how")).alias("how"), "snip")
    edges = resolved_commits(edges, nodes)
    known = nodes.select(folded(F.col("id")).alias("dst")).where("dst is not null").distinct().withColumn("known", F.lit(True))
    edges = edges.join(known, "dst", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    edges = edges.withColumn("conf", edge_confidence(F.col("how"), F.when(F.col("known"), 1.0).otherwise(0.5)))
    return strongest(edges)


def dangling(edges: DataFrame) -> DataFrame:
    """(id, refs): the ends that no node has, as nodes seen but not indexed, and how often they are referred to."""
    return edges.where("not known").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("refs"))
