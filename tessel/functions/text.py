"""Column functions on text: hashes, titles, words, identifiers, snippets and gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that no title or query term should be. Fixed values.
STOP = "the and for with from not when after before into this that are was its can our".split()


def content_hash(title: Column, text: Column) -> Column:
    """sha1 over title, NUL and text, null as empty; metadata stays out of it."""
    return F.sha1(F.concat(F.coalesce(title, F.lit("")), F.lit("\x00"), F.coalesce(text, F.lit(""))))


def collapsed(text: Column) -> Column:
    """White space runs as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def cut(text: Column, n: int) -> Column:
    """The first n characters, and whether more were there."""
    return F.struct(F.substring(text, 1, n).alias("text"), (F.length(text) > n).alias("truncated"))


def title_repo(title: Column) -> Column:
    return F.regexp_extract(title, r"^([^/# ]+/[^/# ]+)#([0-9]+) (.*)$", 1)


def title_number(title: Column) -> Column:
    return F.regexp_extract(title, r"^([^/# ]+/[^/# ]+)#([0-9]+) (.*)$", 2).try_cast("long")


def title_rest(title: Column) -> Column:
    """The title without its ``owner/repo#n`` or ``owner/repo commit sha`` head."""
    return F.regexp_replace(title, r"^[^/# ]+/[^/# ]+(#[0-9]+| commit [0-9a-f]+)? ", "")


def title_words(title: Column) -> Column:
    """Distinct words of a title in lower case and sorted order: a letter and at least two more characters, no stop words."""
    words = F.regexp_extract_all(F.lower(title_rest(title)), F.lit(r"[a-z][a-z0-9_.]{2,}"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(STOP))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two arrays; 0 where both are empty, null where one is null."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def identifier_parts(text: Column) -> Column:
    """Sorted distinct parts of the identifiers in a text: of names of 4 letters or more that mix cases, digits or underscores."""
    names = F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]{3,}"), F.lit(0))
    parts = F.flatten(F.transform(names, lambda n: F.regexp_extract_all(n, F.lit(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), F.lit(0))))
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, F.lower), lambda p: F.length(p) > 1)))


def indexed_text(text: Column) -> Column:
    """What the keyword index sees: the text, a line feed, and its identifiers' parts."""
    return F.concat(text, F.lit("\n"), F.array_join(identifier_parts(text), " "))


def query_terms(text: Column) -> Column:
    """Distinct ASCII words of a query in lower case, first seen first, stop words left out."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOP)))


def grams(words: Column, n: int) -> Column:
    """Runs of n words, as strings."""
    starts = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when(F.size(words) < n, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " ")))


def normal_words(text: Column) -> Column:
    """ASCII letters and digits in lower case, other characters as single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def quote_supported(quote: Column, text: Column, least: int = 12) -> Column:
    """Whether a quote of ``least`` characters or more stands in a text, both normalised."""
    q = normal_words(quote)
    return (F.length(q) >= least) & F.contains(normal_words(text), q)


def claims(text: Column, least: int = 5) -> Column:
    """The sentences of a text with at least ``least`` words; fences and list marks are dropped."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?(```|$)", " "), r"(^|\n)[ \t]*([-*+]|[0-9]+[.])[ \t]+", "$1")
    parts = F.split(F.regexp_replace(bare, r"([.!?])[ \t\r\n]+", "$1\x01"), "\x01")
    return F.filter(F.transform(parts, collapsed), lambda s: F.size(F.split(s, " ")) >= least)


def email_handle(email: Column) -> Column:
    """The account of a no-reply address (``12+name@users.noreply...`` or ``name@users.noreply...``), else null."""
    got = F.regexp_extract(F.lower(email), r"^(?:[0-9]+[+])?([a-z0-9][a-z0-9-]*)@users[.]noreply[.]", 1)
    return F.when(got != "", got)


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm of a number of seconds, to the nearest millisecond."""
    ms = F.round(seconds * 1000).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    whole = lambda c, n: F.floor(c / n)
    return F.concat(two(whole(ms, 3600000)), F.lit(":"), two(F.pmod(whole(ms, 60000), F.lit(60))), F.lit(":"), two(F.pmod(whole(ms, 1000), F.lit(60))), F.lit(","), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"))


def page(text: Column, offset: int, size: int) -> Column:
    """A page of a text: the part, whether more follows, and where."""
    more = F.length(text) > offset + size
    return F.struct(F.substring(text, offset + 1, size).alias("text"), more.alias("truncated"), F.when(more, F.lit(offset + size)).alias("next_offset"))


def line_range(text: Column, first: int, last: int) -> Column:
    """Lines first to last (from 1, clamped to the text) with their line feeds."""
    if last < first:
        raise ValueError("the range is reversed")
    return F.array_join(F.slice(F.split(text, "\n"), max(1, first), last - max(1, first) + 1), "\n")


def links(html: Column, most: int | None = 100) -> Column:
    """Distinct http(s) addresses of a text or of href attributes, ``&amp;`` resolved, first seen first, ``most`` at most (None: all)."""
    got = F.regexp_extract_all(html, F.lit(r"https?://[^\s\"'<>)\]`]+"), F.lit(0))
    got = F.array_distinct(F.transform(got, lambda u: F.regexp_replace(F.replace(u, F.lit("&amp;"), F.lit("&")), "[.,;:]+$", "")))
    return got if most is None else F.slice(got, 1, most)


def issue_numbers(text: Column, most: int = 50) -> Column:
    """Sorted distinct n of ``#n`` in a text."""
    got = F.transform(F.regexp_extract_all(text, F.lit("(?:^|[^A-Za-z0-9_&/])#([0-9]{1,7})"), F.lit(1)), lambda x: x.cast("long"))
    return F.slice(F.array_sort(F.array_distinct(got)), 1, most)


def glob(pattern: str) -> str:
    """A path pattern as an anchored regular expression: ``**`` crosses folders, ``*`` does not, ``?`` is one character."""
    import re

    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"
