"""Boolean text rules as one column predicate.

A rule is words and "phrases" joined by blanks (and), OR, a leading minus (not)
and field:(...); it is turned into whole-word tests on folded text.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_term

TOKEN = re.compile(r'\s*(?:"([^"]*)"|(\()|(\))|(-)|([A-Za-z_]+):|([^\s()":-]+))')


class RuleError(ValueError):
    """The rule cannot be read."""


def match_query(query: str, fields: Mapping[str, Column], default: Sequence[str]) -> Column:
    """Predicate for ``query``; text without a field is looked for in the ``default`` fields joined by blanks."""
    tokens, at = [], 0
    query = query.strip()
    while at < len(query):
        m = TOKEN.match(query, at)
        if not m:
            raise RuleError(f"cannot read {query[at:]!r}")
        phrase, opens, closes, minus, field, word = m.groups()
        tokens.append(("phrase", phrase) if phrase is not None else ("(", "") if opens else (")", "") if closes else ("-", "") if minus else ("field", field) if field else ("or" if word == "OR" else "and" if word == "AND" else "phrase", word))
        at = m.end()
    if not tokens:
        raise RuleError("empty rule")
    everything = F.concat_ws(" ", *[fields[f] for f in default])
    place = 0

    def peek() -> str:
        return tokens[place][0] if place < len(tokens) else ""

    def take(kind: str | None = None) -> tuple[str, str]:
        nonlocal place
        if place >= len(tokens) or kind and tokens[place][0] != kind:
            raise RuleError("unbalanced rule")
        place += 1
        return tokens[place - 1]

    def either(column: Column, inside: bool) -> Column:
        out = both(column, inside)
        while peek() == "or":
            take()
            out = out | both(column, inside)
        return out

    def both(column: Column, inside: bool) -> Column:
        out = one(column, inside)
        while peek() and peek() not in ("or", ")"):
            if peek() == "and":
                take()
            out = out & one(column, inside)
        return out

    def one(column: Column, inside: bool) -> Column:
        kind, value = take()
        if kind == "-":
            return ~one(column, inside)
        if kind == "(":
            out = either(column, inside)
            take(")")
            return out
        if kind == "field":
            if inside:
                raise RuleError("a field inside a field")
            if value not in fields:
                raise RuleError(f"unknown field {value}")
            return one(fields[value], True)
        if kind == "phrase":
            return contains_term(column, value)
        raise RuleError("a word is missing")

    found = either(everything, False)
    if place != len(tokens):
        raise RuleError("unbalanced rule")
    return F.coalesce(found, F.lit(False))


def first_matching_rule(rules: Sequence[tuple[str, str]], fields: Mapping[str, Column], default: Sequence[str]) -> Column:
    """Id of the first rule in order that matches, or null: one pass, no join."""
    return F.coalesce(*[F.when(match_query(q, fields, default), F.lit(i)) for i, q in rules]) if rules else F.lit(None).cast("string")
