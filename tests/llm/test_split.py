"""Splitting: pieces tile, stay under the limit, overlap, and are forced only where there is no boundary."""

import random
import re
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm import split

PARTS = st.lists(st.sampled_from(["word ", "a\n\n", "Zeit. ", "。", "東京", "x" * 300, "y" * 2199, "z" * 2399, "q" * 2500, "\t", "Next one! ", "\r\n"]), max_size=60)


@settings(max_examples=150, deadline=None)
@given(PARTS)
def test_properties(parts):
    text = "".join(parts)
    pieces = split.cuts(text)
    end = 0
    for k, (a, b, _) in enumerate(pieces):
        assert 0 < b - a <= 2400 or not text
        assert (a == 0) if k == 0 else end - 200 <= a <= end
        assert b > end or not text
        end = b
    assert end == len(text)
    longest = max(map(len, re.split("[ \t\r\n。]", text)))
    assert any(f for _, _, f in pieces) == (longest > 2400 and len(text) > 2400)


@pytest.mark.parametrize("tail", [2200, 2201, 2300, 2399, 2400])
@pytest.mark.parametrize("head", ["word " * 700, "One sentence. " * 20, "a "])
def test_tail_that_fits_is_whole(head, tail):
    pieces = split.cuts(head + "x" * tail)
    n, lap = len(head) + tail, min(len(head), 200, 2400 - tail)
    assert pieces[-1] == (len(head) - lap, n, False) and not any(f for _, _, f in pieces)


def test_tail_over_the_limit_is_forced():
    assert [f for _, _, f in split.cuts("word " * 700 + "x" * 2401)].count(True) == 1


def test_overlap_is_full_where_possible():
    text = "This is one sentence of some words. " * 400
    pieces = split.cuts(text)
    assert all(p[1] - q[0] == 200 for p, q in zip(pieces, pieces[1:])) and all(text[b - 2] == "." for _, b, _ in pieces[:-1])


def test_topic_boundary_is_preferred():
    one, two = ("The cat sat on the warm mat near the cat. " * 40), ("Quarterly revenue growth exceeded all forecasts again. " * 40)
    assert split.cuts(one + two)[0][1] == len(one)


def test_operator(spark):
    d = datetime
    rows = [(1, "p", "i:1", "w " * 1300, d(2024, 1, 1)), (1, "p", "i:1", "w " * 1300, d(2024, 1, 1)), (2, "p", "i:2", "x" * 3000, d(2024, 1, 1)), (3, "p", "i:3", "x" * 3000, d(2024, 1, 1)), (3, "p", "i:3", "short", d(2024, 1, 2)),
            (4, "p", "i:4", None, d(2024, 1, 1)), (5, "p", "i:5", "", None), (None, "p", "i:6", "x " * 3000, d(2024, 1, 1)), (7, "p", "i:1~1", "s", None), (8, "p", "i:1~~2", "s", None), (9, "q", "i:2~1", "s", None), (10, "p", "x", "x" * 2400, None)]
    df = spark.createDataFrame(rows, "rid long, project string, id string, text string, updated timestamp").withColumnRenamed("updated", "end")
    pieces = split.split_oversized(df, "rid", "text", ["project", "id"], ["end"])
    got = split.fresh_ids(pieces, df, "project", "id").collect()
    assert {r.rid for r in got} == {1, 2} and {r.forced for r in got if r.rid == 2} == {True, False} and not any(r.forced for r in got if r.rid == 1)
    ids = [r.piece_id for r in got]
    assert len(ids) == len(set(ids)) and not set(ids) & {"i:1~1", "i:1~~2"} and all(len(r.part) <= 2400 for r in got)
    assert split.split_oversized(df.limit(0), "rid", "text", [], ["end"]).count() == 0


@pytest.mark.parametrize("text", ["", "a", "a" * 2400])
def test_small(text):
    assert split.cuts(text) == [(0, len(text), False)]


def test_pieces_end_where_topics_change():
    """Of texts of six topics without a word in common, most cuts at the ends of lines fall where the topic changes."""
    rnd = random.Random(8)
    hits = total = 0
    for _ in range(20):
        lines, ends = [], set()
        for topic in range(6):
            words = [f"t{topic}w{i}" for i in range(12)]
            lines += [" ".join(rnd.choice(words) for _ in range(10)) + "." for _ in range(rnd.randrange(22, 32))]
            ends.add(sum(len(x) + 1 for x in lines))
        text = "\n".join(lines)
        for _, end, forced in split.cuts(text)[:-1]:
            assert not forced
            hits += any(abs(end - e) <= 1 for e in ends)
            total += 1
    assert hits >= 0.7 * total
