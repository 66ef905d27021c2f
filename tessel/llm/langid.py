"""Languages of documents, and of the stretches of mixed ones.

A text's prose is cut into sentences. A sentence's feature is the average of hashed subword embeddings of its words, classified by a
linear softmax. Embeddings and classifier are trained together by stochastic gradient descent in numpy, on sentences of a bounded
sample of labelled documents; labels are partly wrong, so training is repeated without the sentences that the model contradicts.
Documents that a person has read calibrate it: a temperature for the probabilities, and the least confidence at which a sentence's
language is accepted rather than rejected. Which languages there are follows from the labels and from what was read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FENCE = re.compile(r"(```|~~~).*?(?:\1|\Z)", re.S)
INLINE = re.compile(r"`[^`\n]*`")
LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\s]*\)|<?\b(?:https?|ftp)://\S+|\bwww\.\S+|\S+@\S+\.\w+|<\|[^|<>]*\|>|</?\w[^<>\n]*>", re.I)
#: One of these is in every match of LINK, but for www in any case.
LINKED = ("](", "://", "@", "<")
LOG = re.compile(r"^\W*(?:\d{4}-\d\d-\d\d[T ])?\d\d:\d\d:\d\d\b|^\s*(?:TRACE|DEBUG|INFO|WARN|ERROR)\b|^\s*at [\w.$]+\(")
HUNK = re.compile(r"^\s*(?:@@|diff --git|index [0-9a-f]+\.\.|\+\+\+ |--- |\S+/\S+\s+\|\s+\d+)")
CODE = re.compile(
    r"[{};]\s*$|^\s*[+-]?\s*[})\]]+|^[+-]?\s*(?:def|class|object|trait|val|var|private|public|protected|final|static|import|package|return|if|for|while|else|case|function|const|let|long|int)\b.*[({=:]"
    r"|\s(?:=|==|=>|->|:=|\+=|<-)\s|^[+-]\s{2,}\S"
)
MARK = re.compile(r"^\s*(?:>\s*)*(?:[-*+•]\s+|\d+[.)]\s+|#{1,6}\s+)?")
HEAD = re.compile(r"^\s*(?:>\s*)*#{1,6}\s")
ITEM = re.compile(r"^\s*(?:>|[-*+•]\s|\d+[.)]\s|#{1,6}\s)")
SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”)\]]*\s+|(?<=[。！？])\s*|\s/\s(?:>\s)?")
TOKEN = re.compile(r"\w+(?:['’]\w+)*(?:\(\))?")
HIGH = re.compile(r"[\u0080-\u00ff\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u2022\u2026\u2030\u2039\u203a\u20ac\u2122]{2,}")
CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


def _repaired(m: re.Match) -> str:
    """UTF-8 that was read as a one-byte encoding."""
    try:
        return b"".join(bytes([ord(c)]) if ord(c) < 256 else c.encode("cp1252") for c in m.group()).decode("utf-8")
    except (UnicodeDecodeError, UnicodeEncodeError):
        return m.group()


CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
UNSEEN = re.compile(r"[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
#: Stands for inline code and links, which count as words of a sentence but say nothing about its language.
GAP = "0"


def words_of(token: str) -> list[str]:
    """A token's words in lower case, none for an identifier; of text without blanks its characters and their pairs."""
    if len(token) == 1 and not token.isalpha() or token.endswith("()") or "_" in token or any(c.isdigit() for c in token):
        return []
    if CJK.search(token):
        return [*token, *(token[i : i + 2] for i in range(len(token) - 1))]
    if token.isupper() or token[1:].islower() or len(token) == 1 or "'" in token or "’" in token:
        return [w for w in re.split("['’]", token.lower()) if w]
    return [] if any(c.isupper() for c in token[1:]) else [token.lower()]


def sentences(text: str | None, least: int = 4, least_cjk: int = 8) -> list[list[str]]:
    """The sentences of a text's prose, in order, as tokens: no code, logs, links, headings, lone identifiers, nor greetings.

    A sentence has ``least`` tokens or more, inline code counted, of which three are words; or ``least_cjk`` characters of a script
    without blanks.
    """
    if not text:
        return []
    if not text.isascii():
        if HIGH.search(text):
            text = HIGH.sub(_repaired, text)
        text = UNSEEN.sub("", unicodedata.normalize("NFKC", text))
    text = CONTROL.sub(" ", text.replace("\r\n", "\n").replace("\r", "\n"))
    if "```" in text or "~~~" in text:
        text = FENCE.sub("\n\n", text)
    if "`" in text:
        text = INLINE.sub(f" {GAP} ", text)
    if any(mark in text for mark in LINKED) or "WWW." in text.upper():
        text = LINK.sub(lambda m: f" {m.group(1) or ''} ", text)
    blocks, block = [], []
    for line in text.split("\n"):
        bare = line.strip()
        drop = bare and (LOG.search(line) or HUNK.search(line) or CODE.search(line) or HEAD.match(line) and len(bare.split()) < 6)
        if not bare or drop or ITEM.match(line):
            if block:
                blocks.append(" ".join(block))
                block = []
        if bare and not drop:
            block.append(MARK.sub("", line, count=1).strip())
    blocks.append(" ".join(block))
    out = []
    for b in blocks:
        for s in SENTENCE.split(b) if b else ():
            t = TOKEN.findall(s)
            if not s.isascii() and CJK.search(s):
                if sum(len(x) for x in t if CJK.search(x)) >= least_cjk:
                    out.append(t)
            elif len(t) >= least and sum([len(x) > 1 and x.isalpha() for x in t]) >= 3:
                out.append(t)
    return out


HASH = xxhash.xxh32_intdigest


def grams(word: str, buckets: int) -> list[int]:
    """Hashed subwords of a word: itself, and its runs of 2 to 4 characters between marks of its ends."""
    w = f"<{word}>"
    got = {w, *[w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]}
    return [HASH(g) % buckets for g in sorted(got)]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    #: Words met at least twice in training; others, which are often invented names, have the weight RARE.
    common: frozenset[str] = frozenset()
    temperature: float = 1.0
    accept: float = 0.5

    def scorer(self, memory: int = 300_000):
        """A function from sentences to probabilities, one row a sentence; tokens' contributions are kept, about ``memory`` of them."""
        n = len(self.langs)
        known: dict[str, int] = {}
        held = np.zeros((1024, n + 1))

        projected = (self.table.astype(np.float64) @ self.weights) if len(self.table) > 1 else np.zeros((1, n))

        def contributions(tokens: list[str]) -> np.ndarray:
            flat, share, owner = [], [], []
            for i, token in enumerate(tokens):
                for w in words_of(token):
                    g = grams(w, len(self.table))
                    flat += g
                    share += [1.0 if w in self.common else RARE] * len(g)
                    owner += [i] * len(g)
            out = np.zeros((len(tokens), n + 1))
            if flat:
                owner, share = np.array(owner), np.array(share)
                first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                out[owner[first], :n] = np.add.reduceat(projected[flat] * share[:, None], first)
                out[owner[first], n] = np.add.reduceat(share, first)
            return out

        def score(sentences: list[list[str]]) -> np.ndarray:
            nonlocal held
            if len(known) > memory:
                known.clear()
            new = list({t for s in sentences for t in s}.difference(known))
            if len(known) + len(new) > len(held):
                held = np.concatenate([held, np.zeros((max(len(held), len(new)), n + 1))])
            held[len(known) : len(known) + len(new)] = contributions(new)
            known.update(zip(new, range(len(known), len(known) + len(new))))
            lengths = np.fromiter(map(len, sentences), np.int64, len(sentences))
            flat = np.fromiter((known[t] for s in sentences for t in s), np.int64, int(lengths.sum()))
            total = np.zeros((len(sentences), n + 1))
            some = np.flatnonzero(lengths)
            if len(some):
                total[some] = np.add.reduceat(held[flat], (np.cumsum(lengths) - lengths)[some])
            z = (total[:, :n] / np.maximum(total[:, n:], 1e-9) + self.bias) / self.temperature
            p = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
            return p / p.sum(axis=1, keepdims=True)

        return score


RARE = 0.2


def train(rows: list[tuple[list[str], str]], langs: list[str], dims: int = 16, buckets: int = 1 << 16, steps: int = 1000, rate: float = 1.5, batch: int = 64, seed: int = 3, known: dict[str, list[str]] | None = None) -> Model:
    """Fits a model on (tokens, language) rows, each language with the same weight, in as many epochs as ``steps`` batches need.

    ``known`` keeps the words of tokens from one call to the next.
    """
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dims, 1 / dims, (buckets, dims)).astype(np.float32)
    weights, bias = np.zeros((dims, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    known = {} if known is None else known
    for s, _ in rows:
        for t in s:
            if t not in known:
                known[t] = words_of(t)
    words = [[w for t in s for w in known[t]] for s, _ in rows]
    counts = Counter(w for x in words for w in x)
    common = frozenset(w for w, k in counts.items() if k > 1)
    cache = {w: (np.array(grams(w, buckets)), 1.0 if w in common else RARE) for w in counts}
    feats, shares = [], []
    for x in words:
        got = [cache[w] for w in x] or [(np.zeros(1, np.int64), RARE)]
        feats.append(np.concatenate([g for g, _ in got]))
        share = np.concatenate([np.full(len(g), k, np.float32) for g, k in got])
        shares.append(share / share.sum())
    y = np.array([langs.index(lang) for _, lang in rows], np.int64)
    often = np.bincount(y, minlength=len(langs))
    cost = np.minimum(len(y) / np.maximum(often, 1) / max(1, (often > 0).sum()), 10)[y].astype(np.float32)
    epoch = -(-len(rows) // batch)
    epochs, done = max(2, -(-steps // max(1, epoch))), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            b = order[at : at + batch]
            lengths = np.array([len(feats[i]) for i in b])
            flat, share = np.concatenate([feats[i] for i in b]), np.concatenate([shares[i] for i in b])
            h = np.add.reduceat(table[flat] * share[:, None], np.concatenate([[0], np.cumsum(lengths)[:-1]]))
            z = h @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(b)), y[b]] -= 1
            p *= cost[b][:, None]
            step = rate * (1 - done / (epochs * epoch))
            back = -step * (p @ weights.T)
            weights -= step / len(b) * (h.T @ p)
            bias -= step / len(b) * p.sum(axis=0)
            # a bucket's gradients are summed in order of the buckets, which is many times faster than adding them one by one
            by = np.argsort(flat, kind="stable")
            flat = flat[by]
            first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            table[flat[first]] += np.add.reduceat((np.repeat(back, lengths, axis=0) * share[:, None])[by], first)
            done += 1
    return Model(langs, table, weights, bias, common)


def robust_train(rows: list[tuple[list[str], str]], langs: list[str], rounds: int = 2, first_steps: int = 400) -> Model:
    """``train``, repeated without the sentences that the model finds twice as likely in another language as in their label's.

    Models that only sort out sentences take fewer steps than the last one.
    """
    known: dict[str, list[str]] = {}
    model = train(rows, langs, steps=first_steps, known=known)
    for n in range(rounds):
        p = model.scorer()([s for s, _ in rows])
        own = p[np.arange(len(rows)), [langs.index(lang) for _, lang in rows]]
        kept = [row for row, good in zip(rows, p.max(axis=1) <= 2 * own) if good]
        if len({lang for _, lang in kept}) < len(langs):
            kept = rows
        model = train(kept, langs, steps=first_steps if n < rounds - 1 else 1000, known=known)
    return model


def calibrate(model: Model, rows: list[tuple[list[str], str]], error: float = 0.005) -> Model:
    """Sets the temperature with the least cross entropy on reviewed sentences, and the least confidence accepted.

    Reviewed sentences above that confidence, which is one half at least, are wrong in at most ``error`` of the cases; where none is
    confident enough for that, all are rejected. With no reviewed sentences the defaults stay.
    """
    other = [s for s, lang in rows if lang and lang not in model.langs]
    rows = [(s, model.langs.index(lang)) for s, lang in rows if lang in model.langs]
    if not rows:
        return model
    score = model.scorer()
    logits = np.log(np.maximum(score([s for s, _ in rows]), 1e-30))
    y = np.array([k for _, k in rows])

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    others = np.log(np.maximum(score(other), 1e-30))
    model.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
    # a sentence of a language that the model lacks is wrong whatever the model says
    z = np.concatenate([logits, others]) / model.temperature
    y = np.concatenate([y, np.full(len(other), -1)])
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    order = np.argsort(-p.max(axis=1))
    wrong = np.cumsum(p.argmax(axis=1)[order] != y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(wrong <= error)
    model.accept = max(0.5, float(p.max(axis=1)[order][good[-1]])) if len(good) else 1.01
    return model


def smoothed(scores: list[np.ndarray], accept: float, switch: float = 3.0) -> list[int]:
    """The likeliest language of each sentence where a change of language costs ``switch``; rejected sentences have no say."""
    p = np.log(np.maximum(np.stack(scores), 1e-4))
    p[np.stack(scores).max(axis=1) < accept] = 0
    best, back = p[0], []
    for row in p[1:]:
        top = int(best.argmax())
        stay = best >= best[top] - switch
        back.append(np.where(stay, np.arange(len(best)), top))
        best = np.where(stay, best, best[top] - switch) + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def stretches(scores: list[np.ndarray], accept: float) -> list[tuple[int, int, int, float]]:
    """(language, first, last, confidence) of each stretch, from the probabilities of a text's sentences in order.

    A stretch needs two accepted sentences; a single one between others is no stretch. With no stretch at all, the language of the greatest
    total is the whole text's; where every sentence is rejected it has none, which is the language -1.
    """
    if not len(scores):
        return []
    likeliest = np.argmax(scores, axis=1)
    if (likeliest == likeliest[0]).all() and np.max(scores) >= accept:  # no change of language to look for
        return [(int(likeliest[0]), 0, len(scores) - 1, float(np.mean(np.asarray(scores)[:, likeliest[0]])))]
    runs: list[list[int]] = []
    path = smoothed(scores, accept)
    for i, k in enumerate(path):
        if runs and path[runs[-1][-1]] == k:
            runs[-1].append(i)
        else:
            runs.append([i])
    merged: list[list[int]] = []
    agrees = [int(p.argmax()) == k and p.max() >= accept for p, k in zip(scores, path)]
    for r in (r for r in runs if sum(agrees[i] for i in r) >= 2):
        if merged and path[merged[-1][0]] == path[r[0]]:
            merged[-1] += r
        else:
            merged.append(list(r))
    if max(p.max() for p in scores) < accept:
        return [(-1, 0, len(scores) - 1, float(1 - np.mean([p.max() for p in scores])))]
    if not merged:
        total = np.mean([np.log(np.maximum(p, 1e-4)) for p in scores], axis=0)
        k = int(total.argmax())
        return [(k, 0, len(scores) - 1, float(np.mean([p[k] for p in scores])))]
    return [(path[r[0]], r[0], r[-1], float(np.mean([scores[i][path[r[0]]] for i in r]))) for r in merged]


def bare_label(label: Column) -> Column:
    """A label in lower case, without blanks around, cut at the first - or _; null unless two letters are left."""
    code = F.regexp_extract(F.lower(F.regexp_replace(label, r"^\s+|\s+$", "")), "^([^-_]*)", 1)
    return F.when(code.rlike("^[a-z]{2}$"), code)


def languages_among(counts: dict[str, int], read: set[tuple[str | None, str]], least: int = 20) -> list[str]:
    """The languages among labels, from the number of documents that have each and what was ``read``: pairs of a label and the true language.

    ``least`` documents make a language, three where a reviewed document is in it or where the corpus has fewer than 20 times
    ``least`` labels; shares play no part, so a language stays one however large the corpus grows. A label is none if documents with
    it were reviewed and no reviewed document is in it.
    """
    true, seen = {t for _, t in read}, {k for k, _ in read}
    enough = min(least, max(3, sum(counts.values()) // 20))
    return sorted(k for k, n in counts.items() if n >= 3 and (k in true or n >= enough and k not in seen))


def _sampled(key: str, text: str, per_document: int):
    """Up to ``per_document`` sentences of each text, spread evenly over it, as JSON lists of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, x in enumerate(batch.column(text).to_pylist()):
                s = sentences(x)
                for j in sorted({int(k) for k in np.linspace(0, len(s) - 1, min(per_document, len(s)))}) if s else ():
                    rows.append(i)
                    out.append(json.dumps(s[j]))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(rows, pa.int32())) for c in (key, "lang")] + [pa.array(out, pa.string())], names=["key", "lang", "tokens"])

    return run


def _first(rows: DataFrame, text: DataFrame, per_label: int, per_document: int) -> list[tuple[list[str], str]]:
    """(tokens, language) of the sentences of ``per_label`` documents of each language of rows (key, lang), the first by a hash.

    Keys are chosen on narrow rows; the texts of those alone are read, and only sampled sentences come to the driver.
    """
    nth = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("key"), "key"))
    chosen = F.broadcast(rows.withColumn("n", nth).where(f"n <= {per_label}").drop("n"))  # per_label rows of each of at most 26 * 26 languages
    kind = text.schema["key"].dataType.simpleString()
    got = text.join(chosen, "key").mapInArrow(_sampled("key", "text", per_document), f"key {kind}, lang string, tokens string")
    return [(json.loads(r.tokens), r.lang) for r in got.orderBy("lang", F.xxhash64("key"), "key", "tokens").collect()]


def held_out(reviewed: DataFrame) -> Column:
    """Whether a reviewed row takes no part in the calibration: half of them, by a hash of the key."""
    return F.pmod(F.xxhash64(reviewed.columns[0], F.lit("held out")), F.lit(2)) == 1


def fit(docs: DataFrame, key: str, text: str, label: str, reviewed: DataFrame, per_label: int = 600, per_document: int = 5, reviews: int = 1500) -> Model:
    """Trains on bounded samples: ``per_label`` documents of each label and ``per_document`` sentences of each, spread over the text.

    ``reviewed`` has rows (key, lang), what a person read. ``reviews`` of each language calibrate the model, by sentences as above,
    but never those that are ``held_out``, on which its accuracy may be measured. What is a language, ``languages_among`` says.
    """
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    labelled = docs.select(F.col(key).alias("key"), bare_label(F.col(label)).alias("lang")).where(F.col(text).isNotNull() & F.col(key).isNotNull())
    known = labelled.where("lang is not null")
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # at most 26 * 26 labels
    half = reviewed.where(~held_out(reviewed))
    half = half.select(F.col(reviewed.columns[0]).alias("key"), bare_label(F.col("lang")).alias("truth")).where("key is not null and truth is not null").distinct()
    # pairs of two labels: at most 26 ** 4, in fact a few
    read = {(r.lang, r.truth) for r in labelled.join(half, "key").groupBy("lang", "truth").count().collect()}
    langs = languages_among(counts, read)
    if len(langs) < 2:
        return Model(langs or ["und"], np.zeros((1, 1), np.float32), np.zeros((1, max(1, len(langs))), np.float32), np.zeros(max(1, len(langs)), np.float32))
    rows = _first(known.where(F.col("lang").isin(langs)), texts, per_label, per_document)
    langs = sorted({lang for _, lang in rows})
    model = robust_train(rows, langs)
    return calibrate(model, _first(half.withColumnRenamed("truth", "lang"), texts, reviews, per_document))


def _labelled(model, key: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**model.value)
        score = m.scorer()
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            rows, cols = [], [[] for _ in range(5)]
            parts = [sentences(x) for x in batch.column(text).to_pylist()]
            scores = score([s for x in parts for s in x])
            ends = np.cumsum([len(x) for x in parts])
            for i, (x, end) in enumerate(zip(parts, ends)):
                found = stretches(scores[end - len(x) : end], m.accept) if x else []
                for n, (k, first, last, sure) in enumerate(found):
                    rows.append(i)
                    for c, v in zip(cols, (n + 1, len(found), last - first + 1, m.langs[k] if k >= 0 else "und", sure)):
                        c.append(v)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int32())), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=["key", "seg", "segs", "sentences", "lang", "confidence"])

    return run


def document_languages(docs: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """Rows (key, seg, segs, sentences, lang, confidence): the stretches of each text's prose, one for a text of one language.

    A text whose sentences are all rejected has one row with the language und.

    Null, empty and blank texts and those without prose (only code, logs, links, identifiers, greetings) have no row. Rows with the
    same key are treated one by one. The model is broadcast: its size is that of its hash table, whatever the data. There is no
    shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    return docs.where(F.length(F.trim(text)) > 0).select(key, text).mapInArrow(_labelled(shared, key, text), f"key {kind}, seg int, segs int, sentences int, lang string, confidence double")
