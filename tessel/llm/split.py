"""Splitting oversized texts at natural boundaries, by lexical cohesion.

A text is cut into bodies that tile it; each piece is a body with up to ``overlap`` characters before it. A boundary character is a
space, tab, CR, LF or ideographic full stop; a position beside one is a natural place to cut. Within the window in which a body may
end, the best of the highest rank of places present is taken: ends of paragraphs, lines or sentences first, other boundaries then.
Among the former, the one in the deepest valley of lexical cohesion wins: the word counts of the blocks before and after each
position are compared by cosine, and a valley's depth is how far the similarity rises to either side.

A body is kept short enough for the full overlap. Where that leaves no natural place, the body may take up to the whole limit and the
overlap shrinks to what is left. Only a run of more than ``limit`` characters without a boundary is cut at a forced place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOUNDARY = re.compile("[ \t\r\n。]")
UNIT = re.compile(r"\n\s*\n|[\r\n]+|(?<=[.!?:;])[ \t]+|。")
WORD = re.compile(r"[^\W_]+")


def places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Natural places to cut, and the ends of paragraphs, lines and sentences among them."""
    at = np.fromiter((m.start() for m in BOUNDARY.finditer(text)), np.int64)
    natural = np.unique(np.concatenate([at, at + 1]))
    ends = np.fromiter((m.end() for m in UNIT.finditer(text)), np.int64)
    # an end lies beside a boundary unless other white space follows it
    return natural, ends[np.isin(ends, natural)]


def valleys(text: str, ends: np.ndarray, block: int = 6, dims: int = 256) -> np.ndarray:
    """The depth of the cohesion valley at each end: block similarity there against the peaks on either side."""
    if not len(ends):
        return np.zeros(0)
    counts = np.zeros((len(ends) + 1, dims), np.float32)
    words = [(m.start(), m.group().lower()) for m in WORD.finditer(text)]
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for _, w in words), np.int64, len(words))
    unit = np.searchsorted(ends, np.fromiter((p for p, _ in words), np.int64, len(words)), side="right")
    # words are numbered within the text, so small texts have no collisions
    np.add.at(counts, (unit, ids % dims), 1)
    total = np.concatenate([np.zeros((1, dims), np.float32), np.cumsum(counts, axis=0)])
    i = np.arange(1, len(ends) + 1)
    left = total[i] - total[np.maximum(i - block, 0)]
    right = total[np.minimum(i + block, len(counts))] - total[i]
    norm = np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)
    s = np.where(norm > 0, (left * right).sum(axis=1) / np.maximum(norm, 1e-9), 0)

    def climb(x: np.ndarray) -> np.ndarray:
        """The height reached by walking up from each position to its left."""
        top = x.copy()
        for k in range(1, len(x)):
            if x[k - 1] >= x[k]:
                top[k] = top[k - 1]
        return top

    return climb(s) + climb(s[::-1])[::-1] - 2 * s


def cuts(text: str, limit: int = 2400, overlap: int = 200) -> list[tuple[int, int, bool]]:
    """Pieces of a text as (start, end, forced): the piece is text[start:end], forced if its end is not a natural place."""
    n = len(text)
    if n <= limit:
        return [(0, n, False)]
    natural, ends = places(text)
    depth = valleys(text, ends)
    natural = np.union1d(natural, [n])  # the text's end is one more
    out: list[tuple[int, int, bool]] = []
    at = 0
    while True:
        lap = min(overlap, at)
        if n - at <= limit - lap:
            out.append((at - lap, n, False))
            return out
        # no body ends in the first half of its window, lest pieces become many and small
        low, high = at + (limit - lap) // 2, at + limit - lap
        i, j = np.searchsorted(ends, [low, high], side="right")
        end, forced = 0, False
        if j > i:
            end = int(ends[i + int(np.argmax(depth[i:j]))])
        else:
            for top in (high, at + limit):
                j = int(np.searchsorted(natural, top, side="right"))
                if j and natural[j - 1] > at:
                    end = int(natural[j - 1])
                    break
            else:
                end, forced = high, True
        out.append((max(at - lap, end - limit), end, forced))
        if end == n:
            return out
        at = end


def _pieces(key: str, carried: list[str], text: str, limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a few texts at a time, lest the pieces of very long ones outgrow a batch
        for batch in (b.slice(at, 32) for b in batches for at in range(0, b.num_rows, 32)):
            rows, columns = [], [[] for _ in range(7)]
            for i, x in enumerate(batch.column(text).to_pylist()):
                whole = cuts(x, limit, overlap)
                for k, (a, b, forced) in enumerate(whole):
                    rows.append(i)
                    for c, v in zip(columns, (k + 1, len(whole), a, b, out_lap(whole, k), forced, x[a:b])):
                        c.append(v)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
            kept = [batch.column(c).take(pa.array(rows, pa.int32())) for c in (key, *carried)]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=["key", *[f"c{i}" for i in range(len(carried))], *PIECE])

    def out_lap(whole: list[tuple[int, int, bool]], k: int) -> int:
        return whole[k - 1][1] - whole[k][0] if k else 0

    return run


PIECE = ("piece", "pieces", "start", "end", "lap", "forced", "part")


def split_oversized(df: DataFrame, key: str, text: str, carried: list[str], order: list[str], limit: int = 2400, overlap: int = 200) -> DataFrame:
    """The pieces of every current text longer than ``limit`` code points: (key, piece, pieces, start, end, lap, forced, part, *carried).

    The row with the greatest ``order`` columns (null as the least) is a key's current one; of equal ones the longest text counts,
    then the greatest. Rows with a null key, and null, empty and short texts, give no piece; repeated rows give the pieces once.
    Pieces count from 1, ``start`` and ``end`` are code point offsets, ``lap`` is the overlap with the piece before. Texts are
    shuffled only where they are too long.
    """
    rows = df.where(F.col(key).isNotNull()).select(key, text, *[c for c in dict.fromkeys([*carried, *order]) if c not in (key, text)])
    rows = rows.withColumn("_v", F.struct(*order, F.length(text).alias("_n"), F.xxhash64(text).alias("_h")))
    last = rows.groupBy(key).agg(F.max("_v").alias("_last")).where(F.col("_last._n") > limit)
    long = rows.where(F.length(text) > limit).join(last, key).where(F.col("_v").eqNullSafe(F.col("_last")))
    # a key's copies are equal in all that counts, so one of them is taken
    long = long.dropDuplicates([key]).select(key, *carried, text)
    kind = lambda c: df.schema[c].dataType.simpleString()
    schema = f"key {kind(key)}, " + "".join(f"c{i} {kind(c)}, " for i, c in enumerate(carried)) + "piece int, pieces int, start int, `end` int, lap int, forced boolean, part string"
    out = long.mapInArrow(_pieces(key, carried, text, limit, overlap), schema)
    return out.select(F.col("key").alias(key), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)], *PIECE)


def fresh_ids(pieces: DataFrame, taken: DataFrame, scope: str, id_: str) -> DataFrame:
    """``pieces`` with ``piece_id``: the chunk's id, ``~`` and the piece's number, which no row of ``taken`` has in that scope.

    Ids that end in ``~`` and digits may be taken already. Where any id of the form id~k exists, a further ``~`` is set before the
    number, one more than the longest row of them that exists, so the new ids are free whatever the old ones are.
    """
    split = F.regexp_extract_all(F.col(id_), F.lit(r"^(.*?)(~+)[0-9]+$"), F.lit(0))
    old = (
        taken.where(F.size(split) > 0)
        .select(scope, F.regexp_extract(id_, r"^(.*?)(~+)[0-9]+$", 1).alias("_base"), F.length(F.regexp_extract(id_, r"^(.*?)(~+)[0-9]+$", 2)).alias("_n"))
        .groupBy(scope, "_base")
        .agg(F.max("_n").alias("_n"))
    )
    base = F.regexp_replace(F.col(id_), r"~+$", "")
    rows = pieces.withColumn("_base", base).join(old, [scope, "_base"], "left")
    marks = F.expr("repeat('~', coalesce(_n, 0) + 1)")
    return rows.withColumn("piece_id", F.concat(F.col(id_), marks, F.col("piece").cast("string"))).drop("_base", "_n")
