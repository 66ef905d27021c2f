"""The link graph's builder, k-means and option scores on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.functions import models
from tessel.functions.references import Parser
from tessel.operators import linkgraph as L
from tessel.operators.vectors import spherical_kmeans

SHA = "0123456789abcdef0123456789abcdef01234567"


def test_edges(spark):
    nodes = spark.createDataFrame([("Lumen/forge#1",), ("lumen/forge#2",), (f"commit:lumen/forge@{SHA}",), (None,), ("lumen/forge#1",)], "id string")
    texts = [
        (1, "lumen/forge#2", "lumen/forge", "Fixes #1. See #1, reverts 0123456 and quill/reed#77."),
        (2, "lumen/forge#1", "lumen/forge", "This is #1 itself; see https://forge.example/lumen/forge/issues/2"),
        (3, None, "x/y", "#9"), (4, "lumen/forge#3", None, None), (5, "lumen/forge#2", "lumen/forge", "again: see lumen/forge#1"),
    ]
    df = spark.createDataFrame([(k, n, r, "body", t) for k, n, r, t in texts], "key long, node string, repo string, how string, text string")
    edges = L.build_edges(df, Parser(hosts=("forge.example",)), nodes)
    got = {(r.src, r.dst, r.type): (r.conf, r.known) for r in edges.collect()}
    assert got == {
        ("lumen/forge#2", "lumen/forge#1", "closes"): (0.85, True), ("lumen/forge#2", f"commit:lumen/forge@{SHA}", "mentions"): (0.7, True),
        ("lumen/forge#2", "quill/reed#77", "mentions"): (0.35, False), ("lumen/forge#1", "lumen/forge#2", "mentions"): (0.7, True),
    }
    assert [tuple(r) for r in L.dangling(edges).collect()] == [("quill/reed#77", 1)]
    assert L.build_edges(df.limit(0), Parser(), nodes).count() == 0


def test_kmeans(spark):
    rng = np.random.default_rng(3)
    axes = np.eye(6)
    rows = [(i, [float(x) for x in axes[i % 3] * 5 + 0.3 * rng.normal(size=6)]) for i in range(90)] + [(100, None), (101, [0.0] * 6), (102, [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    near, centres = spherical_kmeans(df, "id", "v", 3)
    got = {r.id: r.centre for r in near.collect()}
    assert len(got) == 90 and all(len({got[i] for i in range(90) if i % 3 == c}) == 1 for c in range(3)) and len(set(got.values())) == 3
    assert all(abs(np.linalg.norm(r.centre) - 1) < 1e-9 for r in centres.collect())
    assert spherical_kmeans(df.limit(0), "id", "v", 2)[0].count() == 0
    with pytest.raises(ValueError):
        spherical_kmeans(df, "id", "v", 0)


def test_scores(spark):
    r = spark.range(1).select(models.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("s"), models.yes_probability(F.lit(2.0), F.lit(2.0)).alias("y")).first()
    assert r.s == [0.5, 0.5] and r.y == 0.5
    t = spark.createDataFrame([("a", -1.0), ("a", -3.0), ("b", -1.5)], "o string, p double")
    assert {x.o: (x.total, x.mean) for x in models.option_scores(t, "o", "p").collect()} == {"a": (-4.0, -2.0), "b": (-1.5, -1.5)}
