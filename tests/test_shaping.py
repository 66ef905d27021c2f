from pyspark.sql import functions as F

from tessel.operators import shaping as S


def test_work_selection(spark):
    df = spark.createDataFrame([(1, None), (2, "2024-01-01"), (3, "2024-03-01")], "id long, fetched string")
    assert [r.id for r in S.stale(df, "fetched", "2024-02-01", 5).collect()] == [1, 2] and S.stale(df, "fetched", "2024-02-01", 1).first().id == 1
    assert [r.id for r in S.lacking(df, df.where("id < 3"), "id").collect()] == [3]
    kept = S.cascade(df.where("id = 2"), "id", df, df.drop("fetched"))
    assert [k.count() for k in kept] == [2, 2]
    assert S.duplicated(df.union(df.where("id = 1")), "id").collect()[0].n == 2
    assert {r.g: r.n for r in S.merged_counts(*[spark.createDataFrame([("a", 1), ("b", k)], "g string, n long") for k in (1, 2)], by=["g"], value="n").collect()} == {"a": 2, "b": 3}


def test_columns(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    assert one(S.json_set(F.lit('{"a": "1", "b": "x"}'), b=F.lit("y")).alias("j")).j == '{"a":"1","b":"y"}'
    assert one(S.json_set(F.lit("{broken"), k=F.lit(2)).alias("j")).j == '{"k":"2"}'
    assert one(S.diff_tail(F.lit("1\n2\n3"), 2).alias("t"), S.diff_tail(F.lit("1"), 6).alias("u")) == ("2\n3", "1")
    assert one(S.node_id(F.lit("pr"), F.lit("o/r"), F.lit("7")).alias("a"), S.node_id(F.lit("file"), F.lit("o/r"), F.lit("a.b")).alias("b"), S.node_id(F.lit("commit"), F.lit("o/r"), F.lit("ab")).alias("c")) == ("o/r#7", "file:o/r:a.b", "commit:o/r@ab")
    assert one(S.summary_line(F.lit("T"), F.lit(None).cast("string"), F.lit("ann"), F.lit("2024-01-02T03")).alias("s")).s == "T (ann, 2024-01-02)"
    assert one(S.too_short(F.lit("one two")).alias("a"), S.too_short(F.lit("東京都庁前駅")).alias("b"), S.too_short(F.lit(None).cast("string")).alias("c")) == (True, False, True)
    m = one(S.filled(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(None).cast("string")), {"a": "0", "b": "2"}).alias("m")).m
    assert m == {"a": "1", "b": "2"}
    layers = F.array(F.struct(F.lit(2).alias("heads"), F.lit(8).alias("width"), F.lit(None).cast("int").alias("window")), F.struct(F.lit(2).alias("heads"), F.lit(8).alias("width"), F.lit(10).alias("window")))
    assert one(S.cache_bytes(layers, F.lit(100)).alias("n")).n == 4.0 * 16 * 110


def test_prefixes_and_releases(spark):
    df = spark.createDataFrame([("old:issue:1",), ("old:x",), ("z",)], "id string")
    assert sorted(r.id for r in S.re_prefixed(df, "id", {"old:": "new:", "old:issue:": "iss:"}).collect()) == ["iss:1", "new:x", "z"]
    assert [p.name for p in S.release_pieces("short")] == ["header"] and len(S.release_pieces("# A\n" + "x" * 900)) == 2
