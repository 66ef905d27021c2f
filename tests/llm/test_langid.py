"""Languages: prose, stretches, rejection, and accuracy on held-out documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import langid as L

FOLDER = "/root/testdata/sf0.01"


def texts(text):
    return [" ".join(s) for s in L.sentences(text)]


def test_prose():
    assert texts(None) == texts("") == texts("  \n ") == texts("Hallo zusammen,\n\nDanke!") == []
    code = "```\nThe code is not prose at all.\n```\nclass Foo(Bar):\n    def f(self, x):\n        return g(x)\n16:41:18.542 DEBUG [x-1] a=1 b=2\n@@ -1,2 +3,4 @@ foo\n+  object X extends Y {\nsrc/a/B.scala | 12 +--"
    assert texts(code) == []
    assert len(texts("The server restarts every time. See https://a.example/The/server/is/down now\nand then again it stops.")) == 2
    assert len(texts("- The first item is here.\n- The second item is there.\n\n# Lone Heading\n\n> A quoted line of four words.")) == 3
    assert len(texts("昨夜の実行で、検索が終わりません。前にも書きましたが止まります。priselbel。")) == 2
    assert texts("Tras la actualizaciÃ³n el servidor se para.")[0].split()[2] == "actualización"


def p(k, sure=0.98, n=3):
    x = np.full(n, (1 - sure) / (n - 1))
    x[k] = sure
    return x


@pytest.mark.parametrize(
    "scores, want",
    [
        ([], []),
        ([p(0)], [0]),
        ([p(0)] * 3, [0]),
        ([p(0)] * 3 + [p(1)] * 2 + [p(0)] * 2, [0, 1, 0]),
        ([p(0)] * 3 + [p(1)] + [p(0)] * 2, [0]),
        ([p(0)] * 3 + [p(1, 0.9999)] + [p(0)] * 2, [0]),
        ([p(0)] * 2 + [p(2, 0.4)] + [p(1)] * 2, [0, 1]),
        ([p(0), p(1)], None),
    ],
)
def test_stretches(scores, want):
    got = L.stretches(scores, 0.5)
    assert all(0 <= s[3] <= 1 for s in got)
    assert len(got) == 1 if want is None else [s[0] for s in got] == want


def test_all_rejected_has_no_language(spark):
    assert [s[:3] for s in L.stretches([p(0, 0.4), p(1, 0.45)], 0.5)] == [(-1, 0, 1)]
    model = L.Model(["de", "en", "fr"], np.zeros((8, 2), np.float32), np.zeros((2, 3), np.float32), np.zeros(3, np.float32))
    docs = spark.createDataFrame([(1, "The server restarts every time again.")], "doc_id long, text string")
    assert [r.lang for r in L.document_languages(docs, "doc_id", "text", model).collect()] == ["und"]


def test_languages_among():
    counts = {"en": 900_000, "de": 97_000, "da": 2400, "xx": 5000, "sv": 30, "fi": 5, "pl": 5, "no": 2}
    assert L.languages_among(counts, {("en", "en"), ("xx", "en"), (None, "fi"), ("no", "no")}) == ["da", "de", "en", "fi", "sv"]
    assert L.languages_among({"en": 60, "de": 3, "fr": 2}, set()) == ["de", "en"]


def test_rare_language(spark):
    """A language of 30 among 12,800 documents is one, although that is less than one in 400."""
    en, de, da = (
        "the server restarts every time without any message after update from this branch today".split(),
        "leider startet der dienst immer wieder ohne jede meldung nach einer neuen aktualisierung heute".split(),
        "desværre genstarter tjenesten hver gang uden nogen besked efter den nye opdatering fra grenen".split(),
    )
    rng = np.random.default_rng(2)
    rows = [(lang, words) for lang, words, n in (("en", en, 10_770), ("de", de, 2000), ("da", da, 30)) for _ in range(n)]
    rows = [(i, " ".join(rng.permutation(words)[:9]) + ".", lang) for i, (lang, words) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs, "doc_id", "text", "lang", spark.createDataFrame([], "doc_id long, lang string"))
    got = L.document_languages(docs.where("lang = 'da'"), "doc_id", "text", model).collect()
    assert len(got) == 30 and {r.lang for r in got} == {"da"}


def test_labels(spark):
    rows = ["EN ", "pt_BR", " de-AT", "unknown", "und", "", None, "  ", "e"]
    got = [r.x for r in spark.createDataFrame([(r,) for r in rows], "l string").select(L.bare_label(F.col("l")).alias("x")).collect()]
    assert got == ["en", "pt", "de", None, None, None, None, None, None]


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    return docs, L.fit(docs, "doc_id", "text", "lang", spark.read.parquet(f"{FOLDER}/lang_review.parquet"))


def test_held_out_accuracy(spark, fitted):
    """Half of the reviewed documents takes no part in the calibration; of none is the true language trained on."""
    docs, model = fitted
    assert {"en", "de", "fr", "es"} <= set(model.langs)
    read = spark.read.parquet(f"{FOLDER}/lang_review.parquet")
    read = read.where(L.held_out(read)).select(F.col("doc_id").alias("key"), F.col("lang").alias("truth"))
    got = L.document_languages(docs.join(read, F.col("doc_id") == F.col("key"), "left_semi"), "doc_id", "text", model).join(read, "key").where("segs = 1")
    n = read.count()
    assert 10 < n < spark.read.parquet(f"{FOLDER}/lang_review.parquet").count() and got.where("lang = truth").count() >= 0.95 * n


def test_rejection_keeps_the_error():
    """Where confident sentences are wrong, acceptance rises over them, to rejecting all if none is better."""
    rng = np.random.default_rng(3)
    rows = [(["abcdabcd" if k else "wxyzwxyz"], "ab"[k]) for k in rng.integers(0, 2, 60)]
    model = L.train(rows, ["a", "b"], steps=60)
    good = L.calibrate(model, rows)
    assert 0.5 <= good.accept <= 1
    assert L.calibrate(model, [(s, "ab"[lang == "a"]) for s, lang in rows]).accept > 1
    score = model.scorer()([rows[0][0]])
    assert L.stretches(score, 1.01)[0][0] == -1


def test_cases(spark, fitted):
    _, model = fitted
    en, de = "The server restarts every time without any message. ", "Leider startet der Server immer wieder ohne jede Meldung. "
    rows = [(1, en * 3), (2, en * 3 + de * 3), (3, None), (4, ""), (5, "```\nx\n```"), (None, de), (1, en * 3), (6, en * 2000)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, lang string, seg int")
    got = sorted((r.key or 0, r.seg, r.lang) for r in L.document_languages(df, "doc_id", "text", model).collect())
    assert got == [(0, 1, "de"), (1, 1, "en"), (1, 1, "en"), (2, 1, "en"), (2, 2, "de"), (6, 1, "en")]
    assert L.document_languages(df.limit(0), "doc_id", "text", model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "The server restarts every time again.", None)], "doc_id long, text string, lang string")
    read = spark.createDataFrame([], "doc_id long, lang string")
    model = L.fit(docs, "doc_id", "text", "lang", read)
    assert [r.lang for r in L.document_languages(docs, "doc_id", "text", model).collect()] == ["und"]
    assert L.fit(docs.limit(0), "doc_id", "text", "lang", read).langs == ["und"]
