"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..patterns import WS, re2
from ..sources.fixtures import dialect

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


# Small builders of check-engine SQL.
def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS_SQL = "(' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"
assert set(WS) == set(" \t\n\r\f\v")


def rep(expr: str, pattern: str, replacement: str, flags: str = "") -> str:
    return f"regexp_replace({expr}, {lit(re2(pattern, flags))}, {lit(replacement)}, 'g')"


def num(expr: str, pattern: str, flags: str = "") -> str:
    return f"len(regexp_extract_all({expr}, {lit(re2(pattern, flags))}))"


def hit(expr: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({expr}, {lit(re2(pattern, flags))})"


def get(expr: str, pattern: str, flags: str = "", group: int = 1) -> str:
    return f"regexp_extract({expr}, {lit(re2(pattern, flags))}, {group})"


def every(expr: str, pattern: str, flags: str = "", group: int = 0) -> str:
    return f"regexp_extract_all({expr}, {lit(re2(pattern, flags))}, {group})"


def trim(expr: str) -> str:
    return f"trim({expr}, {WS_SQL})"


def squeeze(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '[\\s\\x0B]+', ' ', 'g'))"


def bare(expr: str) -> str:
    """Without whitespace."""
    return f"regexp_replace({expr}, '[\\s\\x0B]+', '', 'g')"


def lines(expr: str) -> str:
    return f"list_filter(list_transform(string_split({expr}, chr(10)), lambda x: {trim('x')}), lambda x: x <> '')"


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '[\\s\\x0B]+'), lambda x: x <> '')"


def tally(expr: str, literal: str) -> str:
    return f"cast((length({expr}) - length(replace({expr}, {lit(literal)}, ''))) / {len(literal)} as bigint)"


def with_(*names: str, more: str = "") -> str:
    """Common table expressions of the named renderings (``docs`` comes first)."""
    parts = [f"docs as ({dialect('docs', 'duckdb')})"]
    parts += [f"{n} as ({dialect(n, 'duckdb')})" for n in names if n != "docs"]
    return "with " + ", ".join(parts) + (", " + more if more else "") + " "


def line_rows(source: str = "docs", text: str = "raw_text", name: str = "ls", extra: str = "") -> str:
    cols = "doc_id" + (", " + extra if extra else "")
    return (f"{name}_a as (select {cols}, {lines(text)} as l from {source}), "
            f"{name} as (select {cols}, unnest(l) as line, generate_subscripts(l, 1) as line_no from {name}_a)")
