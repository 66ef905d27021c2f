"""Byte-pair encoding with a public vocabulary, by a segment tree over the ranks of adjacent pairs.

A text is divided by the vocabulary's pattern. The bytes of a division are the leaves' parts; leaf i of the tree has the rank of the
pair that part i makes with the next one. The root holds the least rank and, of equal ranks, the leftmost place, which is the next
merge; a merge changes three leaves and their ancestors. It ends when no adjacent pair is in the vocabulary, so a division of n bytes
takes O(n log n) steps even if it is one run of many thousand characters.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The division pattern of the byte-level vocabularies. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FOLDER = "/opt/tokenizers"
NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one division."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    parts = [piece[i : i + 1] for i in range(n)]
    size = 1
    while size < n:
        size *= 2
    # a node is rank * n + place, so the minimum of two nodes is the lower rank and then the one further left
    tree = [NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while tree[1] < NONE:
        i = tree[1] % n
        j = after[i]
        parts[i] += parts[j]
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
        changed = [(j, NONE)]
        r = get(parts[i] + parts[k]) if k < n else None
        changed.append((i, NONE if r is None else r * n + i))
        h = before[i]
        if h >= 0:
            r = get(parts[h] + parts[i])
            changed.append((h, NONE if r is None else r * n + h))
        for place, value in changed:
            k = size + place
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                value = value if value < other else other
                k >>= 1
                if tree[k] == value:
                    break
                tree[k] = value
    out, i = [], 0
    while i < n:
        out.append(ranks[parts[i]])
        i = after[i]
    return out


class Encoder:
    """Encodes texts, and remembers the divisions met most recently, up to ``memory`` of them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, memory: int = 200_000, longest: int = 64):
        self.ranks, self.split, self.memory, self.longest = ranks, regex.compile(pattern).findall, memory, longest
        self.known: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known, old = self.known, self.old
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = old.get(piece)
                if ids is None:
                    ids = merge(piece.encode("utf-8", "replace"), self.ranks)
                if len(piece) <= self.longest:
                    known[piece] = ids
                    if len(known) >= self.memory // 2:  # the older half is forgotten
                        self.old, self.known = old, known = known, {}
            out += ids
        return out


def _encoded(ranks, key: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = pa.array([encoder.encode(x) for x in part.column(text).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(key), ids], names=["key", "ids"])

    return run


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = f"{FOLDER}/byte_bpe_50k.tiktoken") -> DataFrame:
    """Rows (key, ids), one for each row of ``df``: the token ids of its text, without special tokens.

    A null and an empty text have the empty list; text that looks like a special token is ordinary text. Keys may be null or repeated
    and stay as they are; other columns are never read. The driver reads ``vocabulary`` and broadcasts it (about 50,000 entries,
    whatever the data's size), so executors need no copy of the file. There is no shuffle.
    """
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key), F.col(text)).mapInArrow(_encoded(ranks, key, text), f"key {kind}, ids array<int>")
    return out.select(F.col("key").alias(key), "ids")


def _sized(ranks, text: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            sizes = pa.array([len(encoder.encode(x)) for x in batch.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], sizes], names=[*keep, "tokens"])

    return run


def with_token_count(df: DataFrame, text: str, keep: list[str], vocabulary: str = f"{FOLDER}/byte_bpe_50k.tiktoken") -> DataFrame:
    """The columns ``keep`` of ``df`` and ``tokens``, the number of tokens of ``text`` (0 for null and empty)."""
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text).mapInArrow(_sized(ranks, text, keep), f"{kinds}, tokens long")
