"""Mixing sources to target weights by tempered shares and budgeted block permutations.

One exponent t tempers all sources at once: with natural token shares p and planned weights w they get weights in proportion to
p ** (1 - t) * w ** t, normalised, so that t = 0 leaves the corpus as it is and t = 1 gives the plan. The exponent is bisected to the
largest t <= 1 at which no source needs more repetitions than it may have. Where it stays below 1, the sources that hold it there are
those whose limit the plan exceeds: they get all they can give, and the others are tempered again towards their weights, until the
exponent is 1. The family p ** a, with a bisected to a target entropy, is there as well, for a mix without planned weights.

A budget is realised in passes over the source: whole ones, then part of one. Documents fall into blocks by a hash; a pass takes
blocks in a permuted order while they fit the budget, and of the block where it ends the documents that fit. Only the sums of blocks are
ordered by one task, never the documents of a source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessel.plans.staging import stage

BLOCKS = 1024


@dataclass(frozen=True)
class Budget:
    """What a source gets: its tempered weight of the size in tokens, in whole passes and a rest; the exponent is the one it was settled at."""

    source: str
    weight: float
    max_repeat: int
    tokens: int
    exponent: float
    reached: bool
    budget: float

    @property
    def passes(self) -> int:
        return min(self.max_repeat, int(self.budget // self.tokens)) if self.tokens else 0

    @property
    def rest(self) -> float:
        return self.budget - self.passes * self.tokens if self.passes < self.max_repeat else 0.0


def bisect(fits, low: float, high: float, rounds: int = 80) -> float:
    """The largest t in [low, high] that fits, where all smaller ones do; ``low`` if none is known to."""
    if fits(high):
        return high
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return low


def tempered(shares: list[float], weights: list[float], t: float) -> list[float]:
    """Normalised weights between the natural shares (t = 0) and the planned ones (t = 1), all of them positive."""
    x = [(1 - t) * math.log(p) + t * math.log(w) for p, w in zip(shares, weights)]
    top = max(x)
    total = sum(math.exp(v - top) for v in x)
    return [math.exp(v - top) / total for v in x]


def exponent(shares: list[float], weights: list[float], limits: list[float]) -> float:
    """The largest t in [0, 1] whose tempered weights stay within the limits, bisected; 0 if there is none."""

    def fits(t: float) -> bool:
        return all(x <= limit * (1 + 1e-12) for x, limit in zip(tempered(shares, weights, t), limits))

    return bisect(fits, 0.0, 1.0)


def budgets(plan: list[tuple[str, float, int]], tokens: dict[str, int], size: int) -> list[Budget]:
    """The budgets of a plan of (source, weight, max_repeat), given each source's tokens and the size of the mix.

    A source without tokens or repetitions reaches only a weight of zero; one whose plan is null or negative counts as weight zero.
    """
    rows = {s: (tokens.get(s, 0), max(w or 0.0, 0.0), max(r or 0, 0)) for s, w, r in plan}
    settled = {s: (0.0, 1.0 if not w * size else 0.0) for s, (n, w, r) in rows.items() if not (n * r and w * size)}
    while left := [s for s in rows if s not in settled]:
        n, w, goal, most = zip(*((n, w, w * size, n * r) for n, w, r in (rows[s] for s in left)))
        whole = sum(goal)
        t = exponent([x / sum(n) for x in n], [x / sum(w) for x in w], [x / whole for x in most])
        over = [(s, m) for s, g, m in zip(left, goal, most) if g > m] if t < 1 else []
        if not over:  # the plan itself
            settled |= {s: (float(min(g, m)), 1.0) for s, g, m in zip(left, goal, most)}
        settled |= {s: (float(m), t) for s, m in over}
    return [Budget(s, w, r, n, settled[s][1], settled[s][0] >= w * size, settled[s][0]) for s, (n, w, r) in rows.items()]


def entropy(shares: list[float]) -> float:
    return -sum(s * math.log(s) for s in shares if s > 0)


def entropy_exponent(tokens: list[int], target: float) -> float:
    """The exponent a for which shares proportional to tokens ** a have the target entropy, between 0 (equal shares) and 16."""
    kept = [n for n in tokens if n > 0]
    top = max(kept, default=1)

    def enough(a: float) -> bool:
        x = [(n / top) ** a for n in kept]
        return entropy([v / sum(x) for v in x]) >= target

    return bisect(enough, 0.0, 16.0) if kept else 0.0


def _hash(*parts):
    return F.xxhash64(*parts)


def realise(docs: DataFrame, key: str, source: str, tokens: str, plan: list[Budget]) -> DataFrame:
    """The mix: rows (source, key, turn, tokens), one for each use of a document, ``turn`` from 1 to its source's max_repeat at most.

    Documents without tokens, and those of a null source or one that the plan doesn't have, are in no mix. A source's tokens used
    never exceed its budget, and fall short of it by less than its largest document unless all its repetitions are used.
    ``plan`` has one entry a source, so it is bounded by the plan's size.
    """
    spark = docs.sparkSession
    rows = [(b.source, b.passes, b.rest) for b in plan if b.budget > 0]
    terms = F.broadcast(spark.createDataFrame(rows, "source string, passes int, rest double"))
    d = docs.where(F.col(tokens) > 0).select(F.col(source).alias("source"), F.col(key).alias("key"), F.col(tokens).cast("long").alias("tokens"))
    d = d.join(terms, "source").withColumn("block", F.pmod(_hash("key"), F.lit(BLOCKS)))
    turned = lambda c: _hash(c, F.col("passes"), F.lit("turn"))
    sums = d.where("rest > 0").groupBy("source", "passes", "rest", "block").agg(F.sum("tokens").alias("n"))
    order = W.partitionBy("source").orderBy(turned(F.col("block")), "block")
    # BLOCKS rows a source at most
    laid = sums.withColumn("before", F.sum("n").over(order) - F.col("n")).withColumn("whole", F.col("before") + F.col("n") <= F.col("rest"))
    laid = F.broadcast(laid.where("before < rest").select("source", "block", "before", "whole"))
    last = d.where("rest > 0").join(laid, ["source", "block"])
    fits = F.sum("tokens").over(W.partitionBy("source", "block").orderBy(turned(F.col("key")), "key"))
    edge = last.where("not whole").withColumn("upto", F.col("before") + fits).where("upto <= rest")
    partly = last.where("whole").select("source", "key", "passes", "tokens").unionByName(edge.select("source", "key", "passes", "tokens"))
    whole = d.where("passes > 0").select("source", "key", F.explode(F.sequence(F.lit(1), "passes")).alias("turn"), "tokens")
    return whole.unionByName(partly.select("source", "key", (F.col("passes") + 1).alias("turn"), "tokens"))


def source_tokens(docs: DataFrame, source: str, tokens: str) -> DataFrame:
    """Rows (source, tokens, docs): sums over all documents, per source in lower case without blanks around it (null kept)."""
    name = F.lower(F.trim(F.col(source)))
    return docs.groupBy(name.alias("source")).agg(F.sum(tokens).cast("long").alias("tokens"), F.count("*").alias("docs"))


def planned(docs: DataFrame, source: str, tokens: str, plan: DataFrame) -> tuple[list[Budget], int]:
    """The budgets of the rows (source, weight, max_repeat) of ``plan`` for a mix as large as all documents, and that size.

    Tokens are summed by the executors, per source of the plan; other sources only add to the size. Repeated plan rows of a source
    count once (the greatest), rows without a source not at all.
    """
    named = plan.select(F.lower(F.trim("source")).alias("source"), "weight", "max_repeat").where("source is not null")
    named = named.groupBy("source").agg(F.max(F.struct("weight", "max_repeat")).alias("x")).select("source", "x.*")
    sums = stage(source_tokens(docs, source, tokens), "sums")
    size = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    rows = named.join(sums, "source", "left").orderBy("source").collect()  # one row a source of the plan
    have = {r.source: r.tokens or 0 for r in rows}
    return budgets([(r.source, r.weight, r.max_repeat) for r in rows], have, size), size
