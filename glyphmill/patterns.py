"""One regex notation, three engines.

Rules are written once with ASCII word boundaries (``\\b``), ASCII classes and
``$1`` references. ``java`` adapts a pattern for Spark, ``re2`` for the SQL
checks and ``py`` for the Arrow rule runner.
"""

from __future__ import annotations

import re
from functools import lru_cache

WORD = "[A-Za-z0-9_]"
# Java 17 counts accented and Thai letters as word characters at \b; the rules
# mean ASCII, so the boundary is spelled out.
BOUNDARY = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
# Whitespace trimmed from line and text edges (U+00A0 is folded at ingest).
WS = " \t\n\r\f\v"


def _map_atoms(pattern: str, boundary: str, end: str) -> str:
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            pair = pattern[i : i + 2]
            out.append(boundary if pair == "\\b" and not in_class else pair)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        elif ch == "$" and not in_class:
            ch = end
        out.append(ch)
        i += 1
    return "".join(out)


_CLASS_PART = re.compile(r"(\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\.|[^\\])(?:-(\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\[^A-Za-z0-9]|[^\\\]]))?", re.S)


def _narrow_class(inside: str) -> str:
    """The inside of a class whose characters beyond ASCII are told by the fewest ranges: each single one would be a test of its own."""
    kept, wide = [], set()
    for part in _CLASS_PART.finditer(inside):
        low, high = part.group(1), part.group(2) or part.group(1)
        if len(low) == 1 and len(high) == 1 and low > "\x7f":
            wide.update(range(ord(low), ord(high) + 1))
        else:
            kept.append("\\" + part.group() if part.group() in "-^" else part.group())
    out, rest = "".join(kept), sorted(wide)
    while rest:
        n = next((k for k, c in enumerate(rest) if c != rest[0] + k), len(rest))
        out += chr(rest[0]) + ("" if n == 1 else ("-" if n > 2 else "") + chr(rest[n - 1]))
        rest = rest[n:]
    return out


@lru_cache(maxsize=None)
def narrow(pattern: str) -> str:
    """The same pattern, its plain classes written with the fewest ranges of characters beyond ASCII."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            out.append(pattern[i:i + 2])
            i += 2
            continue
        if ch == "[":
            found = re.compile(r"\[(\^?)((?:[^\[\]\\&]|\\.)+)\]", re.S).match(pattern, i)
            if not found:
                # A class within a class: left as it is.
                return pattern
            body = found.group(2)
            out.append("[" + found.group(1) + (_narrow_class(body) if sum(c > "\x7f" for c in body) > 3 else body) + "]")
            i = found.end()
            continue
        out.append(ch)
        i += 1
    return "".join(out)


def java(pattern: str, flags: str = "", boundary: str = BOUNDARY) -> str:
    """Spark form: explicit ASCII boundaries, true end anchor, ``\\n``-only lines.

    With an empty ``boundary`` it is a cheap test that every match passes.
    """
    body = _map_atoms(narrow(pattern), boundary, "$" if "m" in flags else r"\z")
    on = "".join(f for f in "im" if f in flags)
    if any(c in pattern for c in ".^$"):
        on += "d"
    return (f"(?{on})" if on else "") + body


# One atom of a pattern: a boundary, a look-around of plain characters, an escape, a plain class or a character; then its quantifier.
_ATOM = re.compile(r"\\.|\[[^\[\]\\^][^\[\]\\]*\]|[^\\()\[\]{}|^$.*+?]", re.S)
_TIMES = re.compile(r"[*+?]|\{(\d+)(?:,\d*)?\}")
_THAI = "\u0e00-\u0e7f"


def branches(pattern: str) -> list[str]:
    """The alternatives at the top of a pattern."""
    out, depth, begin, i, in_class = [], 0, 0, 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "|" and not depth:
            out.append(pattern[begin:i])
            begin = i + 1
        i += 1
    return [*out, pattern[begin:]]


def _group(pattern: str) -> str | None:
    """The inside of the group that ``pattern`` begins with."""
    head = "(?:" if pattern.startswith("(?:") else "(" if pattern.startswith("(") and not pattern.startswith("(?") else None
    if head is None:
        return None
    depth, i, in_class = 0, 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch in "()":
            depth += 1 if ch == "(" else -1
            if not depth:
                return pattern[len(head):i]
        i += 1
    return None


def first_characters(pattern: str) -> str | None:
    """The inside of a class that holds whatever a match can begin with; None where that isn't seen at once."""
    found = []
    for branch in branches(pattern):
        while True:
            if branch.startswith(BOUNDARY):
                branch = branch[len(BOUNDARY):]
                continue
            inner = _group(branch)
            if inner is not None:
                chars, size = first_characters(inner), branch.index(inner) + len(inner) + 1
            else:
                atom = _ATOM.match(branch)
                if not atom:
                    return None
                text, size = atom.group(), atom.end()
                if text[0] == "\\":
                    chars = text if text[1] in "ds" or not text[1].isalnum() else None
                else:
                    chars = text[1:-1] if text[0] == "[" and len(text) > 1 else None if text in "-&" else text
            if not chars or "&&" in chars or chars[0] == "-":
                return None
            found.append(chars[:-1] + r"\-" if chars[-1] == "-" and chars[-2:] != r"\-" else chars)
            times = _TIMES.match(branch, size)
            if not times or times.group() == "+" or times.group(1) not in (None, "0"):
                break
            branch = branch[times.end():]
            if branch[:1] in ("?", "+"):
                branch = branch[1:]
    # One range stands for all Thai characters.
    thai = lambda chars: all("\u0e00" <= ch <= "\u0e7f" or ch == "-" for ch in chars) and chars != "-"
    return "".join(dict.fromkeys(_THAI if thai(chars) else chars for chars in found))


def _word_only(chars: str | None) -> bool:
    return bool(chars) and re.fullmatch(r"(?:\\d|[A-Z]-[A-Z]|[a-z]-[a-z]|[0-9]-[0-9]|[A-Za-z0-9_])+", chars) is not None


_WORD_END = re.compile(r"(?:(?<!\\)(?:\\\\)*\\d|\[(?:[A-Z]-[A-Z]|[a-z]-[a-z]|[0-9]-[0-9]|[A-Za-z0-9_])+\]|(?<!\\)[A-Za-z0-9_])(?:\+|\{[1-9]\d*(?:,\d*)?\})?\Z")


def _rest(pattern: str) -> str:
    """``pattern`` up to the end of the group that it lies in, its first alternative only."""
    depth, i, in_class = 0, 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            depth += 1
        elif ch == ")" or ch == "|":
            if not depth:
                return pattern[:i]
            depth -= ch == ")"
        i += 1
    return pattern


@lru_cache(maxsize=None)
def lean(pattern: str) -> str:
    """The same matches with fewer tests a character.

    A boundary beside an atom that is a word character needs one look instead of four, and of many alternatives none is tried where
    the next character begins none of them.
    """
    flags = re.match(r"\(\?[dim]+\)", pattern)
    head, body = (flags.group(), pattern[flags.end():]) if flags else ("", pattern)
    pieces = body.split(BOUNDARY)
    chars = first_characters(body) if len(branches(body)) > 2 else None
    out = pieces[0]
    for k, piece in enumerate(pieces[1:], 1):
        if _word_only(first_characters(_rest(BOUNDARY.join(pieces[k:])))):
            out += f"(?<!{WORD})"
        elif _WORD_END.search(pieces[k - 1]):
            out += f"(?!{WORD})"
        else:
            out += BOUNDARY
        out += piece
    return head + (f"(?=[{chars}])(?:{out})" if chars else out)


def py(pattern: str, flags: str = "") -> re.Pattern:
    """Python form, compiled with ASCII classes."""
    opts = re.ASCII
    if "i" in flags:
        opts |= re.IGNORECASE
    if "m" in flags:
        opts |= re.MULTILINE
    return re.compile(_map_atoms(pattern, r"\b", "$" if "m" in flags else r"\Z"), opts)


def re2(pattern: str, flags: str = "") -> str:
    on = "".join(f for f in "im" if f in flags)
    return (f"(?{on})" if on else "") + pattern


def quote(text: str) -> str:
    """Escape a literal for any of the three engines."""
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", text)


def spaced(word: str) -> str:
    """Pattern matching ``word`` with whitespace allowed between its letters."""
    return r"\s*".join(quote(ch) for ch in word)
