"""Orphan references: every reason, nulls, repeats, empty sides, clashing columns, hot keys."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessel.operators.nodeids import id_kind, with_canonical_id
from tessel.operators.orphans import BloomFilter, orphan_references, spread_join

D = lambda n: datetime(2024, 1, n)
PARENTS = "id string, indexed long, loaded timestamp, deleted_at timestamp, reason string"
REFS = "ref string, seen timestamp, id long"


def run(spark, refs, parents):
    p = spark.createDataFrame(parents, PARENTS)
    r = spark.createDataFrame(refs, REFS)
    out = orphan_references(r, "ref", "seen", p, "id", F.col("indexed") == 1, "loaded", "deleted_at")
    return sorted((x.ref, x.id, x.reason) for x in out.collect())


def test_reasons(spark):
    parents = [("a", 1, D(1), None, "x"), ("a", 1, D(1), None, "x"), ("b", 1, D(1), D(5), "x"), ("c", 0, D(1), None, "x"), ("d", 1, D(9), None, "x"), ("e", None, D(1), None, "x"), (None, 1, D(1), None, "x"), ("f", 1, None, None, "x")]
    refs = [("a", D(2), 1), ("b", D(4), 2), ("b", D(5), 3), ("c", D(2), 4), ("d", D(2), 5), ("e", D(2), 6), ("z", D(2), 7), ("z", D(2), 7), (None, D(2), 8), ("a", None, 9), ("z", None, 10), ("f", D(2), 11)]
    assert run(spark, refs, parents) == [("a", 9, "later"), ("b", 3, "deleted"), ("c", 4, "unusable"), ("d", 5, "later"), ("e", 6, "unusable"), ("f", 11, "later"), ("z", 7, "absent"), ("z", 7, "absent"), ("z", 10, "absent")]


def test_deleted_and_loaded_again(spark):
    parents = [("a", 1, D(1), D(3), ""), ("a", 1, D(6), None, "")]
    assert run(spark, [("a", D(2), 1), ("a", D(4), 2), ("a", D(7), 3)], parents) == [("a", 2, "deleted")]


@pytest.mark.parametrize("refs", [[], [("a", D(1), 1)]])
def test_empty(spark, refs):
    assert run(spark, refs, []) == [(r, i, "absent") for r, _, i in refs]
    assert run(spark, [], [("a", 1, D(1), None, "")]) == []


def test_hot_key(spark):
    refs = [("hot", D(2), i) for i in range(3000)] + [(f"k{i}", D(2), i) for i in range(50)]
    parents = [("hot", 1, D(1), None, ""), *[(f"k{i}", 1, D(1), None, "") for i in range(0, 50, 2)]]
    assert run(spark, refs, parents) == sorted((f"k{i}", i, "absent") for i in range(1, 50, 2))
    left = spark.createDataFrame([(k, i) for k, _, i in refs], "k string, i long")
    right = spark.createDataFrame([("hot", 1), ("k2", 2)], "k string, v long")
    assert spread_join(left, right, "k").where("v is not null").count() == 3001


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.xxhash64(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("h"))
    b = BloomFilter(keys, "h", max_bits=1 << 15)
    assert keys.where(~b.may_contain(F.col("h"))).count() == 0
    other = spark.range(5000, 10000).select(F.xxhash64(F.concat(F.lit("x"), F.col("id").cast("string"))).alias("h"))
    assert other.where(BloomFilter(keys, "h").may_contain(F.col("h"))).count() < 200
    assert spark.createDataFrame([(None,)], "h long").select(b.may_contain(F.col("h")).alias("m")).first().m is None


def test_parts_of_the_filter(spark):
    """Keys too many for one filter: the same references, and most orphans still proven by the filters."""
    refs = spark.range(4000).select(F.col("id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("ref"), F.lit(D(2)).alias("seen"))
    parents = spark.range(0, 16000, 2).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.lit(1).alias("indexed"), F.lit(D(1)).alias("loaded"), F.lit(None).cast("timestamp").alias("deleted_at"))
    got = orphan_references(refs, "ref", "seen", parents, "id", F.col("indexed") == 1, "loaded", "deleted_at", max_bits=1 << 15)
    assert sorted(r.id for r in got.collect()) == list(range(1, 4000, 2))


def test_ids(spark):
    aliases = spark.createDataFrame([("Old/Name", "new/repo"), (None, "x/y")], "alias string, repo string")
    rows = ["  OLD/name#7\n", "commit:old/name@ABC", "file:new/repo:a/B.scala", "topic:host.example/7", "", None, "old/name"]
    df = with_canonical_id(spark.createDataFrame([(r,) for r in rows], "id string"), "id", aliases, "to")
    got = {r.id: (r.to, r.kind) for r in df.withColumn("kind", id_kind(F.col("to"))).collect()}
    assert got["  OLD/name#7\n"] == ("new/repo#7", "item")
    assert got["commit:old/name@ABC"] == ("commit:new/repo@abc", "commit")
    assert got["file:new/repo:a/B.scala"] == ("file:new/repo:a/b.scala", "file")
    assert got["topic:host.example/7"] == ("topic:host.example/7", "topic")
    assert got[""][0] == "" and got[None][0] is None and got["old/name"][0] == "old/name"
