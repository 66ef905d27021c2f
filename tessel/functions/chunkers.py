"""Chunkers: pure functions from a text to pieces, run over Arrow batches by ``operators.chunking``."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class Piece:
    name: str
    text: str
    line: int
    trail: str = ""


def split_big(lines: list[str], limit: int) -> Iterable[tuple[int, list[str]]]:
    """Runs of lines with their first line's place: a run over ``limit`` characters ends at a blank line, over 1.5 limits anywhere."""
    start = size = 0
    for i, line in enumerate(lines):
        if size > limit * 1.5 or (size > limit and not line.strip()):
            yield start, lines[start:i]
            start, size = i, 0
        size += len(line) + 1
    if start < len(lines):
        yield start, lines[start:]


def plain(text: str, limit: int = 2400) -> list[Piece]:
    """A text cut at blank lines only."""
    return [Piece(f"#{n}", "\n".join(part), at + 1) for n, (at, part) in enumerate(split_big(text.splitlines(), limit), 1)]


def markdown(text: str, limit: int = 2400, least: int = 40) -> list[Piece]:
    """One piece per heading section of ``least`` characters or more, named by the trail of headings; fences hide headings."""
    sections: list[tuple[tuple[str, ...], int, list[str]]] = [((), 1, [])]
    fenced = False
    for i, line in enumerate(text.splitlines(), 1):
        fenced ^= line.startswith("```")
        head = None if fenced else re.match(r"(#{1,4})\s+(.*)", line)
        if head:
            sections.append(((*sections[-1][0][: len(head[1]) - 1], head[2].strip()), i, []))
        sections[-1][2].append(line)
    out = []
    for trail, line, body in sections:
        whole = "\n".join(body).strip()
        if len(whole) >= least:
            name = " > ".join(trail)
            out += [Piece(f"{name or '(top)'}#{n}", "\n".join(part), line + at, name) for n, (at, part) in enumerate(split_big(whole.splitlines(), limit))]
    return out


#: Modifiers and kinds of a definition. Fixed values.
MODIFIERS = "private protected public final sealed abstract implicit override lazy inline case static open"
SCOPES = "class object trait enum interface record".split()
MEMBERS = "def val var type given".split()
DEFINITION = re.compile(rf"(?P<indent> {{0,4}})(?:(?:{'|'.join(MODIFIERS.split())})(?:\[\w+\])?\s+)*(?P<kind>{'|'.join(SCOPES + MEMBERS)})\s+(?P<name>\w+|`[^`]+`)")
ABOVE = re.compile(r"\s*(?:/\*|\*|//|@)|.*\*/\s*$")


def scala(text: str, limit: int = 2400, least: int = 20) -> list[Piece]:
    """One piece per definition indented by four blanks or less, with the comments above it, named by its enclosing definitions.

    Lines are read from the end: each definition takes the lines below it and those of its comments, so what is left at the top, if
    anything, is the header. Names follow from the indents on the way back down.
    """
    lines = text.splitlines()
    units: list[tuple[int, int, re.Match | None]] = []
    end, i = len(lines), len(lines) - 1
    while i >= 0:
        found = DEFINITION.match(lines[i])
        if found:
            while i > 0 and ABOVE.match(lines[i - 1]) and not DEFINITION.match(lines[i - 1]):
                i -= 1
            units.append((i, end, found))
            end = i
        i -= 1
    if end > 0 or not units:
        units.append((0, end, None))
    enclosing: dict[int, str] = {}
    pieces: list[tuple[str, str, int, str]] = []
    for start, stop, found in reversed(units):
        depth = len(found["indent"]) if found else 0
        enclosing = {k: v for k, v in enclosing.items() if k < depth}
        trail = ".".join(enclosing.values())
        name = found["name"].strip("`") if found else "(header)" if len(units) > 1 else "(file)"
        if found and found["kind"] in SCOPES:
            enclosing[depth] = name
        pieces += [(f"{trail}.{name}".lstrip("."), "\n".join(part).strip("\n"), start + off + 1, trail) for off, part in split_big(lines[start:stop], limit)]
    return _numbered([p for p in pieces if len(p[1].strip()) >= least])


def _numbered(pieces: list[tuple[str, str, int, str]]) -> list[Piece]:
    """Pieces of (name, text, line, trail), each name with its number of occurrence."""
    seen: Counter[str] = Counter()
    return [Piece(f"{name}#{seen.update([name]) or seen[name]}", body, line, trail) for name, body, line, trail in pieces]


def _braces(text: str) -> list[tuple[int, int]]:
    """(position, depth after) of every brace outside strings, characters and comments."""
    out, depth = [], 0
    for m in re.finditer(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:.|\n)*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])\'|[{}]', text, re.S):
        if m[0] in "{}":
            depth = depth + 1 if m[0] == "{" else max(0, depth - 1)
            out.append((m.start(), depth))
    return out


def java(text: str, limit: int = 2400, least: int = 20) -> list[Piece]:
    """One piece per member of a type: a part at depth one that ends with its closing brace, or with a semicolon outside one."""
    braces = _braces(text)
    cuts, depth, last = [0], 0, 0
    for at, after in braces:
        if depth >= 1 and after == 1 and text[at] == "}":
            cuts.append(at + 1)
        elif after == 0 or (depth == 0 and after == 1):
            cuts.append(at + 1)
        depth, last = after, at
    cuts.append(len(text))
    out, seen, owner = [], Counter(), ""
    for a, b in zip(cuts, cuts[1:]):
        part = text[a:b]
        own = re.search(r"\b(?:class|interface|enum|record)\s+(\w+)[^;{]*\{$", part.rstrip())
        if own:
            owner = own[1]
        name = owner if own else (m[1] if (m := re.search(r"(\w+)\s*\([^;{]*\)[^;{]*\{", part)) else "(fields)")
        line = text.count("\n", 0, a + len(part) - len(part.lstrip())) + 1
        for off, lines in split_big(part.strip("\n").splitlines(), limit):
            body = "\n".join(lines).strip("\n")
            if len(body.strip()) >= least:
                full = f"{owner}.{name}" if owner and not own else name
                seen[full] += 1
                out.append(Piece(f"{full}#{seen[full]}", body, line + off, owner))
    return out


def pack(pieces: list[Piece], limit: int = 1000) -> list[Piece]:
    """Neighbouring pieces of one trail joined up to ``limit`` characters; a larger one stays alone."""
    out: list[Piece] = []
    size = 0
    for p in pieces:
        if out and out[-1].trail == p.trail and size + 2 + len(p.text) <= limit:
            out[-1] = Piece(out[-1].name, f"{out[-1].text}\n\n{p.text}", out[-1].line, p.trail)
            size += 2 + len(p.text)
        else:
            out.append(p)
            size = len(p.text)
    return out


SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])\s*")


def sentence_groups(text: str, limit: int = 400) -> list[Piece]:
    """Sentences of a paragraph packed up to ``limit`` characters, a longer one alone; the trail tells where a paragraph begins."""
    out: list[Piece] = []
    for k, paragraph in enumerate(re.split(r"\n\s*\n", text.strip())):
        group = ""
        done = 0
        for s in [*filter(None, map(str.strip, SENTENCE.split(paragraph))), None]:
            if s is not None and (not group or len(group) + 1 + len(s) <= limit):
                group = f"{group} {s}".strip()
                continue
            if group:
                out.append(Piece(f"#{len(out) + 1}", group, k + 1, "new" if k and not done else ""))
                done += 1
            group = s or ""
    return out


#: Words after which a phrase does not end. Fixed values.
LEADING = frozenset("a an the of to in on at by for with from and or but if that which who as into over under is are was were be has have had not no its his her their our your my".split())


def phrases(text: str, least: int = 4, most: int = 12) -> list[Piece]:
    """Phrases of 4 to 12 words: they end at punctuation, or before a conjunction, and never across a sentence's end."""
    out: list[Piece] = []
    for sentence in SENTENCE.split(text):
        words, cur = sentence.split(), []
        for i, w in enumerate(words):
            cur.append(w)
            rest = len(words) - i - 1
            bare = w.strip(",;:").lower()
            stop = w[-1] in ",;:" or (i + 1 < len(words) and words[i + 1].lower() in ("and", "or", "but", "because", "while", "when"))
            if not rest or len(cur) >= most or (stop and len(cur) >= least and rest >= least and bare not in LEADING):
                out.append(Piece(f"#{len(out) + 1}", " ".join(cur), 1))
                cur = []
    return out


#: What a scanner of comments meets: a comment, or a literal in which none begins.
COMMENT = re.compile(r'/\*(?P<block>.*?)(?:\*/|\Z)|(?<!:)//(?P<line>[^\n]*)|"""(?:.|\n)*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?', re.S)


def code_comments(text: str) -> str:
    """What the comments of Scala or Java source say, one line each, without their marks.

    A piece may begin within a block comment: what stands before an end that has no beginning is one.
    """
    begin, end = text.find("/*"), text.find("*/")
    inside = end >= 0 and not 0 <= begin < end
    parts = [text[:end]] if inside else []
    parts += [m["block"] or m["line"] or "" for m in COMMENT.finditer(text, end + 2 if inside else 0)]
    said = (re.sub(r"^\s*\*+ ?|^\s+|\s+$", "", x) for p in parts for x in p.split("\n"))
    return "\n".join(x for x in said if x)


def gist(text: str, least: int = 6, most: int = 280) -> str:
    """The first paragraph of prose: no comments, code, headings, quotes, lists or short answers."""
    text = re.sub(r"<!--.*?-->|```.*?(?:```|\Z)", "\n\n", text, flags=re.S)
    for block in re.split(r"\n\s*\n", text):
        lines = [x for x in block.splitlines() if not re.match(r"\s*(?:#|>|[-*+] |\d+[.)] |\||    )", x)]
        flat = " ".join(" ".join(lines).split())
        if len(flat.split()) >= least:
            return flat if len(flat) <= most else flat[: flat.rfind(" ", 0, most)] + "…"
    return ""


def doc_sentence(text: str) -> str:
    """The first sentence of a documentation comment, without marks, tags and inline links."""
    m = re.search(r"/\*\*(.*?)\*/", text, re.S)
    body = re.sub(r"^\s*\*+ ?", "", m[1], flags=re.M) if m else ""
    body = re.split(r"^\s*@\w+", body, maxsplit=1, flags=re.M)[0]
    flat = " ".join(re.sub(r"\{@\w+\s+([^}]*)\}|<[^>]+>", r"\1", body).split())
    return re.split(r"(?<=[.!?])\s", flat, maxsplit=1)[0]


FRAME = re.compile(r"^\s*(?:at |\.\.\. \d+ more)")


def fold_trace(text: str, keep: int = 6) -> str:
    """Every run of stack frames shortened to its first ``keep``."""
    out, run = [], 0
    for line in text.splitlines():
        run = run + 1 if FRAME.match(line) else 0
        if run <= keep:
            out.append(line)
        elif run == keep + 1:
            out.append("    ...")
    return "\n".join(out)


def one(fn: Callable[[str], str]) -> Callable[[str], list[Piece]]:
    """A text function as a chunker with at most one piece."""
    return lambda text: [Piece("#1", s, 1)] if (s := fn(text)) else []
