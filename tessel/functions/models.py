"""Model calls as column functions: any batch function may be plugged in; deterministic stand-ins serve tests."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], np.ndarray]


def fake_embed(texts: list[str], size: int = 64) -> np.ndarray:
    """Unit vectors of bags of words, a word's place being its crc32 modulo the size."""
    out = np.zeros((len(texts), size), np.float32)
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", (t or "").lower()):
            out[i, zlib.crc32(w.encode()) % size] += 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fake_rerank(query: str, texts: list[str]) -> np.ndarray:
    """1 for a text that has the query's first word, else 0.1."""
    w = query.split()[0].lower() if query.split() else ""
    return np.array([1.0 if w and w in (t or "").lower() else 0.1 for t in texts])


def embedded(df: DataFrame, key: str, text: str, model: Embed = fake_embed, batch: int = 512) -> DataFrame:
    """(key, v): the vector of every text; batches are of similar length, null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                v = model([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(list(v), pa.list_(pa.float32()))], names=["key", "v"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).sortWithinPartitions(F.length("text"))
    return rows.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, v array<float>").withColumnRenamed("key", key)


def reranked(df: DataFrame, query: str, text: str, to: str, model: Callable[[str, list[str]], np.ndarray] = fake_rerank) -> DataFrame:
    """``df`` with the model's probability that a text answers the query."""

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(model(query, list(texts)))

    return df.withColumn(to, score(F.col(text)))


def cached_scores(wanted: DataFrame, cache: DataFrame, salt: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scores of (query, doc) rows: known ones from ``cache`` (k, score), the others from ``compute``; ``k`` is sha1 over salt, query and doc."""
    keyed = wanted.withColumn("k", F.sha1(F.concat_ws("\x00", F.lit(salt), "query", "doc")))
    hit = keyed.join(cache.select("k", "score"), "k")
    return hit.unionByName(compute(keyed.join(cache.select("k"), "k", "left_anti")))


def faithful(claims: DataFrame, by: str, entail: str, contradict: str) -> DataFrame:
    """(by, ok): whether every claim is entailed with at least .5 and contradicted with less; without claims there is no row."""
    return claims.groupBy(by).agg(F.bool_and((F.col(entail) >= 0.5) & (F.col(contradict) < 0.5)).alias("ok"))


def yes_probability(yes: Column, no: Column) -> Column:
    """The softmax of a model's logits for yes and no, for yes."""
    return 1 / (1 + F.exp(no - yes))


def log_prob(tokens: Column) -> Column:
    """The log-probability of a sequence: the sum over its tokens' ones."""
    return F.aggregate(tokens, F.lit(0.0), lambda a, x: a + x)


def softmax(scores: Column, temperature: float = 1.0) -> Column:
    """Probabilities of an array of scores or log-probabilities; a null array stays null."""
    top = F.array_max(scores)
    x = F.transform(scores, lambda v: F.exp((v - top) / temperature))
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    return F.transform(x, lambda v: v / total)


def option_scores(tokens: DataFrame, option: str, logprob: str) -> DataFrame:
    """(option, total, mean): the summed and the mean log-probability of each option's tokens."""
    return tokens.groupBy(option).agg(F.sum(logprob).alias("total"), F.avg(logprob).alias("mean"))
