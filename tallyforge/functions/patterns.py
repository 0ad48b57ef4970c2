"""Regular expressions that fail early: most lines match none of the many that they are asked for."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column

#: What may stand for a first character as it is.
_PLAIN = re.compile(r"[A-Za-z0-9@/, :]")


def _branches(p: str) -> list[str]:
    """The alternatives of ``p`` outside its groups and classes."""
    out, depth, k, start = [], 0, 0, 0
    while k < len(p):
        if p[k] == "\\":
            k += 1
        elif p[k] == "[":
            k = p.index("]", k + 2)
        elif p[k] in "()":
            depth += 1 if p[k] == "(" else -1
        elif p[k] == "|" and not depth:
            out.append(p[start:k])
            start = k + 1
        k += 1
    return [*out, p[start:]]


def _unit(p: str) -> int:
    """The length of the group, class, escape or character that ``p`` begins with."""
    if p[0] == "\\":
        return 2
    if p[0] == "[":
        return p.index("]", 2) + 1
    if p[0] != "(":
        return 1
    depth, k = 0, 0
    while True:
        if p[k] == "\\":
            k += 1
        elif p[k] == "[":
            k = p.index("]", k + 2)
        elif p[k] in "()":
            depth += 1 if p[k] == "(" else -1
        k += 1
        if not depth:
            return k


def _first(p: str) -> set[str] | None:
    """Parts of a class that hold every first character of a match; None if that can't be told."""
    found: set[str] = set()
    for b in _branches(p):
        while b.startswith(r"\b"):
            b = b[2:]
        if not b:
            return None
        unit, rest = b[: _unit(b)], b[_unit(b) :]
        if unit.startswith("("):
            own = _first(unit[3:-1]) if unit.startswith("(?:") else None if unit.startswith("(?") else _first(unit[1:-1])
        elif unit.startswith("["):
            own = None if unit.startswith("[^") or "&&" in unit or "[" in unit[1:] else {unit[1:-1]}
        else:
            own = {r"\d": {r"\d"}, r"\s": {r"\s"}, r"\.": {r"\."}, r"\|": {r"\|"}, r"\ ": {" "}, r"\$": {r"\$"}}.get(unit) or ({unit} if _PLAIN.fullmatch(unit) else None)
        if own is None:
            return None
        if rest[:1] in ("?", "*") or rest.startswith("{0"):
            more = _first(rest[1:].removeprefix("?")) if rest[0] != "{" else None
            if more is None:
                return None
            own = own | more
        found |= own
    return found


@cache
def led(pattern: str) -> str:
    """``pattern`` behind a look ahead at its possible first characters: without one, each alternative is tried at each place of a text. It matches the same."""
    flag, body = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    first = _first(body)
    return f"{flag}(?=[{''.join(sorted(first))}])(?:{body})" if first else pattern


def has(text: Column, pattern: str) -> Column:
    return text.rlike(led(pattern))


@cache
def either(words: tuple[str, ...]) -> str:
    """A pattern of any of ``words``, as they are written."""
    return "|".join(map(re.escape, words))


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text contains one of ``words``."""
    return has(text, either(words))

