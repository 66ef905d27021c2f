"""Operators on small fixtures with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tessel.functions import chunkers, ocr
from tessel.functions import text as T
from tessel.functions.references import Parser
from tessel.operators import filters, graph, metrics, ranking, series, store
from tessel.operators.components import connected_components


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (5, 4), (None, 1), (7, 8), (8, 9), (9, 10), (10, 11), (1, 2)], "a long, b long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 7, 9: 7, 10: 7, 11: 7}
    assert connected_components(e.limit(0)).count() == 0


def test_filters_reject():
    for bad in ({"since": "2024/01"}, {"date": "closed"}, {"until": "24"}, {"author": "x"}, {"authors": [" @ "]}):
        with pytest.raises(ValueError):
            filters.Where.of(**bad)
    assert filters.Where.of(authors=["@Alice", "alice", "me"], me="Bob").authors == ("alice", "bob")


def test_open_only_inherits(spark):
    rows = [(1, "p", "s", "issue:1", "s:issue:1", '{"state": "closed"}'), (2, "p", "s", "issue:1", "s:comment:5", "{}"), (3, "p", "s", "issue:2", "s:issue:2", '{"state": "open"}'), (4, "p", "s", None, "s:issue:3", None)]
    df = spark.createDataFrame(rows, "rid long, project string, source string, doc string, id string, meta string")
    got = [r.rid for r in filters.apply(df, filters.Where.of(open_only=True)).collect()]
    assert sorted(got) == [3, 4]


def test_fusion(spark):
    rows = [(0, "a", 1), (0, "b", 2), (1, "c", 1), (1, "b", 2)]
    df = spark.createDataFrame(rows, "list int, k string, rank int")
    plain = [r.k for r in ranking.fuse(df, "k", bonus=()).orderBy(F.desc("score"), "first_list", "first_rank").collect()]
    assert plain == ["b", "a", "c"]
    bonus = {r.k: r.bonus for r in ranking.fuse(df, "k", bonus=(0.05, 0.02)).collect()}
    assert bonus == {"a": 0.05, "b": 0.02, "c": 0.05}


def test_blend(spark):
    df = spark.createDataFrame([(r,) for r in (1, 3, 4, 10, 11, 5000)], "rank int")
    w = [round(r.w, 2) for r in df.select(ranking.blend(F.col("rank"), F.lit(1.0), F.lit(1.0), F.lit(0.0)).alias("w")).collect()]
    assert w == [0.75, 0.75, 0.6, 0.6, 0.4, 0.4]


def test_expand(spark):
    e = spark.createDataFrame([("r#2", "r#1", "closes", 0.85, "t", "s", 1), ("r#3", "r#1", "mentions", 0.5, "t", "s", 1), ("c", "r#2", "merged_as", 1.0, "t", "s", 1)], "src string, dst string, type string, conf double, how string, snip string, seen long")
    got = {r.node: round(r.score, 4) for r in graph.expand(spark.createDataFrame([("r#1", 1.0)], "seed string, score double"), graph.relations(e), graph.degrees(e)).collect()}
    assert got == {"r#2": 0.85, "r#3": 0.25, "c": round(0.85 * 0.9 * 0.5, 4)}


def test_auroc_ties(spark):
    df = spark.createDataFrame([(0.9, True), (0.5, True), (0.5, False), (0.1, False), (None, True)], "p double, t boolean")
    assert metrics.auroc(df, "p", "t").first().auroc == pytest.approx(0.875)
    assert metrics.auroc(df.where("t"), "p", "t").first().auroc is None


def test_running_total(spark):
    df = spark.createDataFrame([("a", 1, 1, 5), ("a", 1, 2, 7), ("a", 2, 3, 1), ("b", 1, 1, 2)], "g string, day int, k int, v long")
    got = {(r.g, r.k): r.s for r in series.running_total(df, ["g"], F.col("day"), ["k"], "v", "s").collect()}
    assert got == {("a", 1): 5, ("a", 2): 12, ("a", 3): 13, ("b", 1): 2}


def test_diff_and_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, h string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "n"), (3, None)], "id long, h string")
    assert {r.id: r.action for r in store.diff(old, new, "id", "h").collect()} == {1: "unchanged", 2: "changed", 3: "unchanged", 4: "added"}
    assert store.diff(old, new.limit(0), "id", "h").where("action = 'deleted'").count() == 3
    assert store.upsert(old, new.where("id = 2"), "id").where("h = 'x'").count() == 1


def test_references():
    keys = lambda text, **kw: [(r.kind, r.repo, r.key, r.via, r.closing) for r in Parser(**kw)(text)]
    assert [k[:4] for k in keys("as in #81, also [#82] or lumen/forge#83")] == [("issue", None, "81", "bare"), ("issue", None, "82", "bare"), ("issue", "lumen/forge", "83", "qual")]
    assert [k[4] for k in keys("This resolves #5, #6 & lumen/forge#7. Compare #8.")] == [True, True, True, False]
    assert [k[4] for k in keys("Closed: #5 and #6", lists=False)] == [True, False] and [k[4] for k in keys("fix the parser for #5")] == [False]
    assert keys("  12: invokestatic #44\n  #7 = Utf8 x\n&#55; F#4\n```\n#66\n```") == [] and [k[2] for k in keys("```\n#66\n```\n#67")] == ["67"]
    sha = "0123456789abcdef0123456789abcdef01234567"
    assert [(k[0], k[2]) for k in keys(f"reverts abcdef1 by {sha}")] == [("commit", "abcdef1"), ("commit", sha)]
    assert [k[:3] for k in keys("https://forge.example/lumen/forge/pull/9 https://forge.example/lumen/forge/commit/abcdef12", hosts=("forge.example",))] == [("issue", "lumen/forge", "9"), ("commit", "lumen/forge", "abcdef12")]
    assert [k[2] for k in keys("https://talk.example/t/some-title/31/4 https://talk.example/t/8/2", forums=("talk.example",))] == ["31", "8"]
    assert keys("old-12", legacy={"old": "lumen/forge"}) == [] and [k[:4] for k in keys("OLD-12", legacy={"OLD": "lumen/forge"})] == [("issue", "lumen/forge", "12", "legacy")]
    assert [k[4] for k in keys("#5 is open, but fixes #5")] == [True] and keys(None) == [] and keys("") == []


def test_chunkers():
    md = "# A\n" + "x" * 50 + "\n## B\n```\n# no heading\n```\n" + "y" * 50
    assert [p.name for p in chunkers.markdown(md)] == ["A#0", "A > B#0"]
    assert "".join(p.text for p in chunkers.plain("a\nb")) == "a\nb"
    code = "package p\n\n/** Doc. */\nclass Foo {\n  def bar(x: Int): Int = {\n    x + 1\n  }\n\n  def baz: String = \"a longer body here\"\n}\n"
    assert [p.name for p in chunkers.scala(code, least=5)] == ["(header)#1", "Foo#1", "Foo.bar#1", "Foo.baz#1"]
    java = "class A {\n  int x = 1; // {\n  void f() { if (x > 0) { g(\"}\"); } }\n  int g(String s) { return s.length(); }\n}\n"
    assert [p.name for p in chunkers.java(java, least=5)][:3] == ["A#1", "A.f#1", "A.g#1"]
    assert [p.text for p in chunkers.pack([chunkers.Piece("a", "x" * 10, 1), chunkers.Piece("b", "y" * 10, 2), chunkers.Piece("c", "z" * 30, 3)], 25)] == ["x" * 10 + "\n\n" + "y" * 10, "z" * 30]
    assert [p.trail for p in chunkers.sentence_groups("One. Two.\n\nThree.", 20)] == ["", "new"]
    assert chunkers.fold_trace("\n".join(["E"] + ["  at x"] * 9)).count("at x") == 6
    assert chunkers.doc_sentence("/** Gets the {@code x}. More.\n * @return y */") == "Gets the x."
    assert chunkers.gist("# H\n\n> q\n\nThis is the first paragraph of prose here.") == "This is the first paragraph of prose here."
    assert chunkers.code_comments('x = "// no" // one\n/** two\n * three */\ny https://a.example') == "one\ntwo\nthree"
    assert chunkers.code_comments("rest of it */\ncode // more") == "rest of it\nmore" and chunkers.code_comments("") == ""


def test_ocr():
    line = lambda text, y, width, x=0, h=10: {"text": text, "box": [x, y, width, h]}
    assert ocr.paragraphs([line("The harbour lights went out one by one un-", 0, 210), line("til dawn.", 11, 45)]) == ["The harbour lights went out one by one until dawn."]
    assert ocr.paragraphs([line("A line that has an end of its own.", 0, 170), line("and another", 11, 55)]) == ["A line that has an end of its own.", "and another"]
    assert len(ocr.paragraphs([line("Short first line here", 0, 105), line("a", 11, 5), line("much longer line that sets the edge", 40, 175)])) == 3
    assert len(ocr.paragraphs([line("Words that fill the whole line", 0, 150), line("far below", 60, 45)])) == 2
    assert ocr.paragraphs([line("\u6771\u4eac\u306e\u5929\u6c17\u306f\u4eca\u65e5", 0, 80), line("\u6674\u308c", 11, 20)]) == ["\u6771\u4eac\u306e\u5929\u6c17\u306f\u4eca\u65e5\u6674\u308c"]
    assert ocr.paragraphs([{"text": "x"}, {"text": "y", "box": None}]) == ["x", "y"] and ocr.paragraphs([]) == []


def test_text_functions(spark):
    df = spark.createDataFrame([("lumen/forge#12 Guard timer for selba", "parseHttpURL and x_y42 val")], "title string, text string")
    r = df.select(T.title_repo(F.col("title")).alias("repo"), T.title_number(F.col("title")).alias("n"), T.title_words(F.col("title")).alias("w"), T.identifier_parts(F.col("text")).alias("p")).first()
    assert (r.repo, r.n, r.w) == ("lumen/forge", 12, ["guard", "selba", "timer"]) and {"parse", "http", "url", "42"} <= set(r.p)
    assert spark.range(1).select(T.srt_time(F.lit(3661.5)).alias("t")).first().t == "01:01:01,500"
    with pytest.raises(ValueError):
        T.line_range(F.lit("x"), 3, 2)
    import re

    assert re.match(T.glob("src/**/*.py"), "src/a/b.py") and re.match(T.glob("src/**/*.py"), "src/b.py") and not re.match(T.glob("src/*.py"), "src/a/b.py")


def test_all_links_of_a_page(spark, tmp_path):
    from tessel.plans.catalog import QUERIES

    text = " ".join(f"https://a.example/{i}" for i in range(120))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(QUERIES["page_links"].run(spark, str(tmp_path)).first().links.split()) == sorted(text.split())
    assert spark.range(1).select(F.size(T.links(F.lit(text))).alias("n")).first().n == 100


def test_survey_columns(spark):
    from tessel.functions import models

    one = lambda *c: tuple(spark.range(1).select(*c).first())
    hits = F.array(F.lit("Index Rebuild"), F.lit("https://a.example/7"))
    assert one(*[metrics.canary_passed(hits, F.array(*map(F.lit, x))) for x in (["zz", "REBUILD"], ["zz"])]) == (True, False)
    assert one(models.yes_probability(F.lit(2.0), F.lit(2.0)), models.log_prob(F.array(F.lit(-1.0), F.lit(-0.5)))) == (0.5, -1.5)
    assert one(graph.edge_confidence(F.lit("closing"), F.lit(0.9)), graph.edge_confidence(F.lit("?"), F.lit(0.9))) == (0.765, None)
    edges = spark.createDataFrame([(f"a{i}", f"b{i}", "closes" if i % 2 else "mentions") for i in range(40)], "src string, dst string, type string")
    some = lambda seed: [r.src for r in graph.sample_edges(edges, "closes", 5, seed).collect()]
    assert some(1) == some(1) != some(2) and len(set(some(1))) == 5 and {r.type for r in graph.sample_edges(edges, "closes", 99).collect()} == {"closes"}
