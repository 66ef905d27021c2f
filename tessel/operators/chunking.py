"""Chunkers, parsers and other text functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.functions.chunkers import Piece
from tessel.functions.references import Parser

REFS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "repo", "key", "via")] + [T.StructField("closing", T.BooleanType()), T.StructField("snip", T.StringType())]))


def chunked(df: DataFrame, key: str, text: str, chunker: Callable[[str], list[Piece]]) -> DataFrame:
    """(key, n, name, text, line, trail) for each piece of each text; null and empty texts have none. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols = [], [[] for _ in range(5)]
            for i, x in enumerate(batch.column("text").to_pylist()):
                for n, p in enumerate(chunker(x) if x else (), 1):
                    rows.append(i)
                    for c, v in zip(cols, (n, p.name, p.text, p.line, p.trail)):
                        c.append(v)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int32())), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["key", "n", "name", "text", "line", "trail"])

    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, n long, name string, text string, line long, trail string")
    return out.withColumnRenamed("key", key)


def unique_names(pieces: DataFrame, key: str, name: str, to: str) -> DataFrame:
    """``to``: the name, with ``~k`` from its second occurrence within a key on."""
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy(key, name).orderBy("n"))
    return pieces.withColumn("_k", k).withColumn(to, F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat(name, F.lit("~"), (F.col("_k") - 1).cast("string")))).drop("_k")


def references(df: DataFrame, key: str, text: str, parser: Parser) -> DataFrame:
    """(key, kind, repo, ref, via, closing, snip): the references of each text, each target once."""

    @F.pandas_udf(REFS)
    def parsed(texts):
        import pandas as pd

        return pd.Series([[vars(r) for r in parser(t)] for t in texts])

    x = df.where(F.col(text).isNotNull()).select(key, F.explode(parsed(F.col(text))).alias("r"))
    return x.select(key, "r.kind", "r.repo", F.col("r.key").alias("ref"), "r.via", "r.closing", "r.snip")
