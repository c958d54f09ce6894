"""DuckDB twins of the text helpers, for the oracle queries."""

from __future__ import annotations

from functools import reduce


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def squeeze(text: str) -> str:
    return strip(f"regexp_replace({text}, '\\s+', ' ', 'g')")


def chain(text: str, rules) -> str:
    return reduce(lambda c, r: f"regexp_replace({c}, {q(r[0])}, {q(r[1].replace('$', chr(92)))}, 'g')", rules, text)


def count_hits(text: str, patterns) -> str:
    return "(" + " + ".join(f"CAST({has(text, p)} AS INT)" for p in patterns) + ")"


def first_label(text: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN {has(text, p)} THEN {q(label)}" for p, label in rules) + " END"


def all_labels(text: str, rules) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {has(text, p)} THEN {q(label)} END" for p, label in rules) + "], lambda x: x IS NOT NULL), ',')"


def contains_any(text: str, parts) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(p)})" for p in parts) + ")"


def count_contained(text: str, parts) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {q(p)}) AS INT)" for p in parts) + ")"
