"""Formulas as text, read into columns: numbers, names, + - * / and brackets; nothing else is taken."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:(?P<number>[0-9]+(?:\.[0-9]*)?|\.[0-9]+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<mark>[-+*/()]))")
#: Longest formula, and deepest brackets: what a rule needs, many times over.
LONGEST, DEEPEST = 1000, 50


class FormulaError(ValueError):
    """Why a text is no formula."""


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) of each token; an error names the first character that none begins with."""
    if len(text) > LONGEST:
        raise FormulaError(f"over {LONGEST} characters")
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        hit = TOKEN.match(text, at)
        if not hit:
            raise FormulaError(f"unexpected character at {at + 1}: {text[at:].lstrip()[:1]}")
        out.append((hit.lastgroup, hit[hit.lastgroup]))
        at = hit.end()
    return out


def formula(text: str, names: dict[str, Column]) -> Column:
    """The formula's value as a double, over these names. A division by 0 and an unknown value give null."""
    rest = [*tokens(text), ("end", "")]

    def value(depth: int) -> Column:
        if depth > DEEPEST:
            raise FormulaError(f"brackets deeper than {DEEPEST}")
        kind, token = rest.pop(0)
        if kind == "number":
            return F.lit(float(token))
        if kind == "name":
            if token not in names:
                raise FormulaError(f"unknown name: {token}")
            return names[token].cast("double")
        if token == "-":
            return -value(depth + 1)
        if token == "(":
            inner = total(depth + 1)
            if rest.pop(0)[1] != ")":
                raise FormulaError("bracket isn't closed")
            return inner
        raise FormulaError("ends too early" if kind == "end" else f"unexpected {token}")

    def product(depth: int) -> Column:
        out = value(depth)
        while rest[0][1] in ("*", "/"):
            out = out * value(depth) if rest.pop(0)[1] == "*" else F.try_divide(out, value(depth))
        return out

    def total(depth: int) -> Column:
        out = product(depth)
        while rest[0][1] in ("+", "-"):
            out = out + product(depth) if rest.pop(0)[1] == "+" else out - product(depth)
        return out

    out = total(0)
    if rest[0][0] != "end":
        raise FormulaError(f"unexpected {rest[0][1]}")
    return out
