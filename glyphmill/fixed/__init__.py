"""Loaders for the fixed rule tables and word lists kept next to this file."""

from __future__ import annotations

from functools import lru_cache
from importlib.resources import files
from typing import NamedTuple


class Rule(NamedTuple):
    """One ordered text rule; ``flags`` holds i, m, g, or the word ``literal``."""

    pattern: str
    flags: str
    replacement: str

    @property
    def is_literal(self) -> bool:
        return self.flags == "literal"

    @property
    def first_only(self) -> bool:
        return not self.is_literal and "g" not in self.flags


def _rows(kind: str, name: str) -> list[list[str]]:
    text = files(__name__).joinpath(kind).joinpath(name).read_text(encoding="utf-8")
    lines = [ln for ln in text.split("\n") if ln and not ln.startswith("# Fixed values")]
    return [ln.split("\t") for ln in lines]


@lru_cache(maxsize=None)
def rules(name: str) -> tuple[Rule, ...]:
    """Rules of one set in their fixed order."""
    return tuple(
        Rule(p, "" if f == "-" else f, r.replace("\\n", "\n"))
        for p, f, r in _rows("rules", name + ".tsv")
    )


@lru_cache(maxsize=None)
def words(name: str) -> tuple[str, ...]:
    return tuple(row[0] for row in _rows("words", name + ".txt"))


@lru_cache(maxsize=None)
def pairs(name: str) -> tuple[tuple[str, str], ...]:
    """Two-column tables: ``profiles`` and ``dictionary``."""
    return tuple((a, b) for a, b in _rows("words", name + ".tsv"))


def correct_words() -> tuple[str, ...]:
    """All known-good words, first occurrence kept."""
    return tuple(dict.fromkeys(words("review") + words("correct")))


def longest_first(items) -> list[str]:
    return sorted(items, key=lambda w: -len(w))
