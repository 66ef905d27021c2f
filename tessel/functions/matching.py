"""Fuzzy and structural matching of short texts, as plain functions for Arrow UDFs and drivers."""

from __future__ import annotations

import difflib
import json
import re


def lines_match(expected: str, actual: str, ratio: float = 0.85, exact_below: int = 12) -> bool:
    """Whether a line occurs in an output: alike by difflib's ratio, short lines only if equal."""
    want = expected.strip()
    have = [x.strip() for x in actual.splitlines()]
    if len(want) < exact_below:
        return want in have
    return any(difflib.SequenceMatcher(None, want, x).ratio() >= ratio for x in have)


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of words that two texts share in order, compared in lower case without punctuation."""
    plain = lambda words: [re.sub(r"[^\w]", "", w).lower() for w in words]
    blocks = difflib.SequenceMatcher(None, plain(a), plain(b), autojunk=False).get_matching_blocks()
    return [(m.a + i, m.b + i) for m in blocks for i in range(m.size)]


def cues(script: str) -> tuple[list[str], dict[str, int]]:
    """The words of a script, and for each ``[[cue]]`` the word it stands before; a cue may occur once."""
    words, at = [], {}
    for part in re.split(r"(\[\[[^\]]+\]\])", script):
        if part.startswith("[["):
            name = part[2:-2].strip()
            if name in at:
                raise ValueError(f"cue twice: {name}")
            at[name] = len(words)
        else:
            words += part.split()
    return words, at


def extract_json(text: str) -> object | None:
    """The JSON value of a text: all of it, in a fence, or the first object or array within it; None where there is none."""
    decoder = json.JSONDecoder()
    for candidate in (text, *re.findall(r"```(?:json)?\s*(.*?)```", text, re.S)):
        try:
            return json.loads(candidate)
        except ValueError:
            pass
    for m in re.finditer(r"[{\[]", text):
        try:
            return decoder.raw_decode(text, m.start())[0]
        except ValueError:
            pass
    return None


def matches_schema(value: object, schema: dict) -> bool:
    """A small part of JSON Schema: type, enum, required, properties, items, minimum, maximum, minLength, maxLength."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    kind = schema.get("type")
    if kind in ("number", "integer"):
        if isinstance(value, bool) or not isinstance(value, int if kind == "integer" else (int, float)):
            return False
    elif kind and not isinstance(value, kinds[kind]):
        return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, dict):
        named = schema.get("properties", {})
        return all(k in value for k in schema.get("required", ())) and all(matches_schema(v, named[k]) for k, v in value.items() if k in named)
    if isinstance(value, list):
        return all(matches_schema(v, schema.get("items", {})) for v in value)
    if isinstance(value, str):
        return schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value))
    if isinstance(value, int | float) and not isinstance(value, bool):
        return schema.get("minimum", value) <= value <= schema.get("maximum", value)
    return True


QUOTE = re.compile(r"\[quote(?:=[^\]]*)?\]((?:(?!\[quote).)*?)\[/quote\]", re.S)


def shortened_quotes(text: str, most: int = 160, depth: int = 5) -> str:
    """Quotations in square brackets cut at a word to ``most`` characters and marked by >, the innermost first."""

    def cut(m: re.Match) -> str:
        flat = " ".join(m[1].split())
        return "> " + (flat if len(flat) <= most else flat[: max(flat.rfind(" ", 0, most), 1)] + "…") + "\n"

    for _ in range(depth):
        text, n = QUOTE.subn(cut, text)
        if not n:
            break
    return text


def cleaned_post(text: str) -> str:
    """A forum post: images as their alternative text, details unwrapped, quotes shortened, no runs of blank lines."""
    text = re.sub(r"!\[([^\]|]*)[^\]]*\]\([^)]*\)", r"\1", text)
    text = re.sub(r"\[/?details(?:=[^\]]*)?\]", "", text)
    return re.sub(r"\n{3,}", "\n\n", shortened_quotes(text)).strip()
