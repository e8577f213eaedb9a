"""Pieces of DuckDB SQL for the oracles."""

from __future__ import annotations


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strs(xs: list[str]) -> str:
    return "(" + ", ".join(map(q, xs)) + ")"


def arr(xs: list[str]) -> str:
    return "[" + ", ".join(map(q, xs)) + "]"


def hit(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def any_of(x: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(hit(x, p) for p in patterns) + ")"


def weigh(hits: list[tuple[str, float]]) -> str:
    return "(" + " + ".join(f"CASE WHEN {h} THEN CAST({w} AS DOUBLE) ELSE 0.0::DOUBLE END" for h, w in hits) + ")"


def ladder(cases: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {q(v)}" for c, v in cases) + f" ELSE {q(default)} END"


def lookup(x: str, table: dict, default: float) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN CAST({v} AS DOUBLE)" for k, v in table.items()) + f" ELSE CAST({default} AS DOUBLE) END"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
