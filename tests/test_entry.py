import __spark_entry__ as entry


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and all(callable(f) for f in q.values())
    assert "p3_found" in q


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["src", "dst", "type", "side"] and df.count() >= 0
