"""Intermediate tables in the shared folder.

``stage`` writes a DataFrame once and reads it back, which cuts lineage and lets several consumers read only the columns they need.
The folder is the one the session names in ``spark.checkpoint.dir``, which must be set on a cluster; in local mode a private one is made where it is not.
Staged tables survive the loss of executors, since all of them reach that folder; they are removed when the driver ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only where all tasks run on this machine may it be unset; then this process makes one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tessel-"))
    return _own[0]


def stage(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in folders by the value of a column if one is given, and return it as read from there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clear)
    _made.append((spark, path))
    schema = df.schema
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return spark.read.schema(schema).parquet(path)


def numbered(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of a staged table whose ``row`` is among those of ``wanted``, nulls and repeats aside.

    Numbers are those of ``monotonically_increasing_id``, which run on within a partition. Only they are shuffled: they come back as
    a broadcast of bits, 1,024 numbers a line and about 0.2 bytes a row of the table, so wide rows stay where they are however many there are.
    """
    words = wanted.where("row is not null").groupBy(F.shiftright("row", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(row & 63 as int))")).alias("bits"))
    bit = [F.coalesce(F.max(F.when(F.col("_word").bitwiseAND(15) == i, F.col("bits"))), F.lit(0)) for i in range(16)]
    lines = words.groupBy(F.shiftright("_word", 4).alias("_line")).agg(F.array(*bit).alias("_bits"))
    met = rows.join(F.broadcast(lines), F.shiftright("row", 10) == F.col("_line"))
    return met.where("shiftrightunsigned(_bits[cast(shiftright(row, 6) & 15 as int)], cast(row & 63 as int)) & 1 = 1").select(*rows.columns)


def unstage(spark: SparkSession) -> None:
    """Remove what this process has staged so far; results that still read it must have been written before."""
    for owner, path in _made:
        try:
            jvm = owner.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(owner.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone already
            pass
    _made.clear()


def _clear() -> None:
    if _made:
        unstage(_made[-1][0])
