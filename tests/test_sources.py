"""Feeds, models, streams and plain functions."""

import json
import shutil
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tessel.functions import matching, models, periods
from tessel.sources import feeds
from tessel.streaming import streams


def test_commit_log(spark, tmp_path):
    log = "\x1e".join("\x1f".join(c) for c in [("a1", "", "Ann", "a@x", "2024-01-01", "Fix it", "Body", "a.py\nb.py"), ("b2", "", "dep[bot]", "b@x", "2024-01-02", "Bump", "", ""), ("c3", "", "Bo", "c@x", "2024-01-03", "Merge pull request #7 from x", "Real title\n\nmore", "\n".join(f"f{i}" for i in range(25)))]) + "\x1e\n"
    (tmp_path / "log").write_text(log)
    chunks = {r.id: r for r in feeds.commit_chunks(feeds.commit_log(spark, str(tmp_path / "log")), "commits").collect()}
    assert set(chunks) == {"commits:commit:a1", "commits:commit:c3"}
    assert chunks["commits:commit:c3"].title == "Real title (#7)" and chunks["commits:commit:c3"].text.endswith("and 5 more")
    assert chunks["commits:commit:a1"].text == "Fix it\n\nBody\n\na.py\nb.py"


def test_router_and_noise(spark):
    df = spark.createDataFrame([("issue", False, "open"), ("pr", True, "closed"), ("wiki", False, None)], "kind string, merged boolean, state string")
    assert sorted((r.kind, r.source, r.state) for r in feeds.routed(df, {"i": ["issue"], "p": ["pr"]}).collect()) == [("issue", "i", "open"), ("pr", "p", "merged")]
    n = spark.createDataFrame([("ann", "real text"), ("x[bot]", "hi"), ("ann", " "), ("ann", "/retest"), (None, None)], "a string, b string").select(feeds.is_noise(F.col("a"), F.col("b")).alias("n"))
    assert [r.n for r in n.collect()] == [False, True, True, True, True]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    for _ in range(2):
        feeds.append_new(df, str(tmp_path / "log"), "id")
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert not feeds.unchanged(spark, str(tmp_path / "t"), {"k": 1})
    feeds.publish(df, str(tmp_path / "t"), {"k": 1})
    feeds.publish(df.limit(1), str(tmp_path / "t"), {"k": 2})
    assert feeds.published(spark, str(tmp_path / "t"))[0].count() == 1 and feeds.unchanged(spark, str(tmp_path / "t"), {"k": 2})


def test_windows():
    w = feeds.windows(1000, 0, 30)
    assert next(w) == (970, 1000) and w.send(10) == (910, 970) and w.send(2000) == (880, 910)
    seen = list(feeds.windows(100, 0, 60))
    assert seen == [(40, 100), (0, 40)]


def test_models(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "alpha beta")], "id long, t string")
    v = {r.id: np.array(r.v) for r in models.embedded(df, "id", "t").collect()}
    assert np.allclose(v[1], v[3]) and not v[2].any() and abs(np.linalg.norm(v[1]) - 1) < 1e-6
    assert {r.id: r.p for r in models.reranked(df, "Alpha", "t", "p").collect()} == {1: 1.0, 2: 0.1, 3: 1.0}
    wanted = spark.createDataFrame([("q", "a"), ("q", "b")], "query string, doc string")
    cache = spark.createDataFrame([(__import__("hashlib").sha1("s\0q\0a".encode()).hexdigest(), 0.5)], "k string, score double")
    got = models.cached_scores(wanted, cache, "s", lambda d: d.withColumn("score", F.lit(0.25)))
    assert {r.doc: r.score for r in got.collect()} == {"a": 0.5, "b": 0.25}
    c = spark.createDataFrame([(1, 0.9, 0.1), (1, 0.4, 0.1), (2, 0.5, 0.4)], "d long, e double, c double")
    assert {r.d: r.ok for r in models.faithful(c, "d", "e", "c").collect()} == {1: False, 2: True}


def _stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _drained(df, spark, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    at = lambda d, h: datetime(2024, 1, d, h)
    schema = "user_id long, ts timestamp, kind string"
    _stream(spark, tmp_path, [(1, at(1, 1), "a"), (1, at(1, 3), "a"), (1, at(1, 20), "b"), (2, at(1, 2), "a")], schema)
    s = _stream(spark, tmp_path, [(2, at(20, 1), "a"), (3, at(20, 2), "a")], schema)
    days = _drained(streams.tumbling_counts(s, "ts", "kind"), spark, tmp_path, "days")
    assert {(r.start, r.kind, r.n) for r in days} == {(at(1, 0), "a", 3), (at(1, 0), "b", 1)}
    sessions = _drained(streams.session_counts(s, "ts", "user_id"), spark, tmp_path, "sessions")
    assert {(r.user_id, r.start, r.n) for r in sessions} == {(1, at(1, 1), 2), (1, at(1, 20), 1), (2, at(1, 2), 1)}
    idle = _drained(streams.idle_keys(s, "ts", "user_id", 86_400_000), spark, tmp_path, "idle")
    assert {(r.user_id, r.last, r.n) for r in idle} >= {(1, at(1, 20), 3)}


def test_upserting(spark, tmp_path):
    """No batch is lost over more than ten epochs and two versions, and a batch run twice changes nothing."""
    path, want = str(tmp_path / "t"), {}
    write = streams.upserting(path, "id", "v", compact_every=4)
    with pytest.raises(ValueError):
        streams.upserted(spark, path, "id", "v")
    for epoch in range(13):
        rows = [(epoch, epoch), (100, 50 - epoch), (200, epoch)]
        for _ in range(1 + epoch % 2):
            write(spark.createDataFrame(rows, "id long, v long"), epoch)
        for k, v in rows:
            want[k] = max(v, want.get(k, v))
        if epoch in (2, 3, 12):
            assert dict(map(tuple, streams.upserted(spark, path, "id", "v").collect())) == want


def test_versions_are_ordered_by_number(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(12):
        feeds.publish(spark.createDataFrame([(n,)], "id long"), path, {"epoch": n} if n % 2 else {"z": str(n)})
        assert feeds.published(spark, path)[0].first().id == n and not feeds.unchanged(spark, path, {"epoch": n - 1})
    shutil.rmtree(json.loads(max((f.read_text() for f in (tmp_path / "t" / "_pointers").glob("*.txt")), key=lambda x: json.loads(x)["number"]))["version"])
    with pytest.raises(AnalysisException):  # a version that cannot be read is no empty table
        streams.upserted(spark, path, "id", "id")


def test_matching():
    assert matching.lines_match("error: value foo is not a member", "x\nerror: value fooo is not a member\n") and not matching.lines_match("short", "shorter")
    assert matching.aligned("The cat, sat.".split(), "the dog cat sat".split()) == [(0, 0), (1, 2), (2, 3)]
    assert matching.cues("one [[a]] two three [[b]]") == (["one", "two", "three"], {"a": 1, "b": 3})
    with pytest.raises(ValueError):
        matching.cues("[[a]] x [[a]]")
    assert matching.extract_json('{"a": 1}') == {"a": 1} and matching.extract_json("x ```json\n[1]\n``` y") == [1] and matching.extract_json('so {"b": 2} it') == {"b": 2} and matching.extract_json("none") is None
    schema = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 1}, "t": {"type": "array", "items": {"type": "string"}}}}
    assert matching.matches_schema({"n": 1, "t": ["x"]}, schema) and not matching.matches_schema({"n": True}, schema) and not matching.matches_schema({"t": []}, schema)
    assert matching.shortened_quotes("[quote=a]x [quote]inner[/quote] y[/quote] z").count(">") >= 1
    assert matching.cleaned_post("![alt|10x10](u)\n\n\n\n[details=x]in[/details]") == "alt\n\nin"


def test_periods():
    today = date(2026, 10, 7)
    assert periods.period("last year", today) == ("2025", "2025") and periods.period("this month", today) == ("2026-10", "2026-10")
    assert periods.period("this week", today) == ("2026-10-05", "2026-10-11") and periods.period("more than 6 years ago", today) == (None, "2020-10-07")
    assert periods.period("in the last 2 years", today) == ("2024-10-07", None) and periods.period("3 years ago", today) == ("2022", "2024") and periods.period("soon", today) == (None, None)
    assert periods.back(date(2024, 3, 31), 1, "month") == date(2024, 2, 29)
    assert periods.checked_range(None, None, today) == ("2026-09-08", "2026-10-08")
    with pytest.raises(ValueError):
        periods.checked_range("2024-01-01", "2026-01-01", today)
