"""Mixing: budgets, limits, exponents, and what is really drawn."""

import random
from collections import Counter

import pytest

from tessel.llm import mixing as M

SCHEMA = "doc_id long, source string, tokens long, turn string, block string"


def test_exponents():
    assert M.tempered([0.1, 0.9], [0.5, 0.5], 0) == pytest.approx([0.1, 0.9]) and M.tempered([0.1, 0.9], [0.3, 0.7], 1) == pytest.approx([0.3, 0.7])
    t = M.exponent([0.1, 0.9], [0.5, 0.5], [0.2, 2.0])
    assert M.tempered([0.1, 0.9], [0.5, 0.5], t) == pytest.approx([0.2, 0.8]) and 0 < t < 1
    assert M.exponent([0.1, 0.9], [0.5, 0.5], [0.5, 0.5]) == 1.0
    b = M.budgets([("a", 0.5, 4), ("b", 0.4, 1), ("c", 0.1, 1), ("d", None, None)], {"a": 100, "b": 900}, 1000)
    assert [round(x.budget) for x in b] == [400, 400, 0, 0] and [x.reached for x in b] == [False, True, False, True] and b[0].passes == 4
    assert 0 < b[0].exponent < 1 and b[1].exponent == 1.0
    assert [x.reached for x in M.budgets([("a", 0.1, 1)], {"a": 0}, 0)] == [True] and M.budgets([("a", 0.5, 0)], {"a": 9}, 9)[0].reached is False


def test_reached_is_that_of_the_limits():
    """Random plans: a source is reached exactly if all its repetitions hold its weight, and the budgets say so."""
    rnd = random.Random(4)
    for _ in range(300):
        n = {f"s{i}": rnd.choice([0, 1, 10, 1000]) * rnd.randrange(1, 90) for i in range(6)}
        weights = [rnd.random() ** 3 for _ in n]
        plan = [(s, w / sum(weights), rnd.randrange(5)) for s, w in zip(n, weights)]
        size = sum(n.values())
        for b in M.budgets(plan, n, size):
            assert b.reached == (b.tokens * b.max_repeat >= b.weight * size)
            assert b.budget == pytest.approx(min(b.weight * size, b.tokens * b.max_repeat)) and b.passes * b.tokens + b.rest == pytest.approx(b.budget)


def test_entropy():
    n = [1000, 100, 10]
    for target in (0.2, 0.6, 1.0):
        a = M.entropy_exponent(n, target)
        x = [v**a for v in n]
        assert M.entropy([v / sum(x) for v in x]) == pytest.approx(target, abs=1e-6)
    assert M.entropy_exponent([], 1.0) == 0.0 and M.entropy_exponent(n, 9.0) == 0.0


def test_realise(spark):
    rows = [(i, " Big " if i % 2 else "big", 10 + i % 7, "x", "y") for i in range(3000)] + [(5000 + i, "small", 5, "x", "y") for i in range(20)] + [(9000, None, 50, "", ""), (9001, "other", 50, "", ""), (9002, "big", 0, "", ""), (9003, "big", None, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = spark.createDataFrame([("big", 0.5, 1), ("small", 0.05, 3), ("small", 0.05, 3), ("none", 0.1, 5), (None, 0.3, 1)], "source string, weight double, max_repeat long")
    budgets, size = M.planned(docs, "source", "tokens", plan)
    assert size == sum(r[2] or 0 for r in rows) and [(b.source, b.reached) for b in budgets] == [("big", True), ("none", False), ("small", False)]
    named = docs.selectExpr("doc_id", "lower(trim(source)) as source", "tokens")
    got = M.realise(named, "doc_id", "source", "tokens", budgets).collect()
    used = Counter()
    for r in got:
        used[r.source] += r.tokens
    assert len({(r.key, r.turn) for r in got}) == len(got)
    assert used["small"] == 300 and max(r.turn for r in got if r.source == "small") == 3 and set(used) == {"big", "small"}
    assert size * 0.5 - 17 < used["big"] <= size * 0.5
    again = M.realise(named.repartition(3), "doc_id", "source", "tokens", budgets).collect()
    assert sorted(got) == sorted(again)


def test_parts_of_passes(spark):
    docs = spark.createDataFrame([(i, "s", 10) for i in range(100)], "doc_id long, source string, tokens long")
    plan = M.budgets([("s", 2.5, 4)], {"s": 1000}, 1000)
    uses = Counter(r.key for r in M.realise(docs, "doc_id", "source", "tokens", plan).collect())
    assert Counter(uses.values()) == {2: 50, 3: 50}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, tokens long")
    budgets, size = M.planned(docs, "source", "tokens", spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeat long"))
    assert size == 0 and M.realise(docs, "doc_id", "source", "tokens", budgets).count() == 0
