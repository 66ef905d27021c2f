"""Every core query against its SQL on the driver's smallest tables; queries without SQL give rows of a stable schema."""

import pytest
from oracle import assert_same, connect

from tessel.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(n for n, q in catalog.QUERIES.items() if q.sql))
def test_matches_sql(spark, db, name):
    q = catalog.QUERIES[name]
    assert_same(q.run(spark, FOLDER), db, q.sql)


@pytest.mark.parametrize("name", sorted(n for n, q in catalog.QUERIES.items() if not q.sql))
def test_runs(spark, name):
    df = catalog.QUERIES[name].run(spark, FOLDER)
    # the smallest tables hold no comments of code
    assert df.columns and (df.count() > 0 or name == "code_comments")
