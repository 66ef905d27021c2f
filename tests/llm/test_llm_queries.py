"""The queries of the subpackage: columns, and SQL where there is any."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import assert_same, connect  # noqa: E402

from tessel.llm.queries import QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["rid_a", "rid_b"],
    "p2_found": ["idx_a", "idx_b"],
    "p4_found": ["rid", "cut"],
    "p5_found": ["rid_a", "rid_b"],
    "p6_ids": ["doc_id", "ids"],
    "p7_found": ["source"],
    "p8_found": ["doc_id", "seg", "lang"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    df = QUERIES[name].run(spark, FOLDER)
    assert df.columns == COLUMNS.get(name, df.columns) and df.count() > 0
    if QUERIES[name].sql:
        assert_same(df, connect(FOLDER), QUERIES[name].sql)


def test_every_cluster_has_a_label(spark, tmp_path):
    titles = ["Slow index rebuild", "Fast parser cache", "Fast parser tests", None, None, "the and for", *["Broken login page"] * 4]
    cluster = [0, 1, 1, 2, 2, 3, 4, 4, 4, 4]
    n = range(len(titles))
    spark.createDataFrame([(i, "p", f"i:{i}", titles[i]) for i in n], "idx long, project string, id string, title string").write.parquet(f"{tmp_path}/items.parquet")
    spark.createDataFrame([(100 + i, "p", f"i:{i}") for i in n], "rid long, project string, id string").write.parquet(f"{tmp_path}/chunks.parquet")
    v = [[float(j == cluster[i]) for j in range(256)] for i in n]
    spark.createDataFrame([(100 + i, "brook-embed-2", v[i]) for i in n], "rid long, model string, v array<float>").write.parquet(f"{tmp_path}/vec.parquet")
    got = {r.k: (r.size, r.label) for r in QUERIES["p2_clusters"].run(spark, str(tmp_path)).collect()}
    assert got == {0: (1, "index, rebuild, slow"), 1: (2, "fast, parser"), 3: (2, "i:3"), 5: (1, "the and for"), 6: (4, "broken, login, page")}
