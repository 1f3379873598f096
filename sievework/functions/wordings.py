"""Patterns on long texts: a pattern runs only where the text holds a literal that each of its matches must hold.

Looking for a literal costs a fraction of a pattern's pass, and most texts hold few of the literals. `low` is the
lower-case text; a letter of a-z stays that letter in it, so no match is lost, and what is found is what the pattern finds.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import C, col

_parser = re._parser  # what compiles Python's patterns; the wordings are spelt alike in Java
_GROUP = re.compile(r"\(\?([a-z]+)\)")


def _split(pattern: str) -> list[str]:
    """The alternatives of a pattern, as they are written."""
    out, at, depth, in_set, i = [], 0, 0, False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_set:
            in_set = c != "]"
        elif c == "[":
            in_set = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[at:i])
            at = i + 1
        i += 1
    return [*out, pattern[at:]]


def _needed(parsed) -> frozenset[str] | None:
    """Literals of which every match holds at least one; of several such sets the one whose shortest literal is longest."""
    sets, run = [], ""
    for op, arg in [*parsed, (None, None)]:
        name = str(op)
        if name == "LITERAL" and arg < 128:
            run += chr(arg).lower()
            continue
        if run:
            sets.append(frozenset([run]))
            run = ""
        if name == "SUBPATTERN":
            found = _needed(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            found = _needed(arg[2]) if arg[0] else None
        elif name == "BRANCH":
            each = [_needed(x) for x in arg[1]]
            found = None if None in each else frozenset().union(*each)
        else:
            found = None
        if found:
            sets.append(found)
    return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=None)


@cache
def alternatives(pattern: str) -> tuple[tuple[str, tuple[str, ...] | None], ...]:
    """Each alternative of a pattern, its flags before it, with the literals of which a match holds one; None where none is known."""
    found = _GROUP.match(pattern)
    flags, rest = (found.group(), pattern[found.end() :]) if found else ("", pattern)
    # letters without case in ASCII can stand for letters of it
    needs = (lambda p: None) if "u" in flags else lambda p: _needed(_parser.parse(p))
    out = []
    for alternative in _split(rest):
        literals = needs(alternative)
        # a literal that holds another says nothing more
        out.append((flags + alternative, literals and tuple(sorted(x for x in literals if not any(y in x and y != x for y in literals)))))
    return tuple(out)


def has(value: C, low: C | None, pattern: str) -> Column:
    """Whether a text matches; without its lower-case text, as for short texts, the pattern just runs."""
    v = col(value)
    if low is None:
        return v.rlike(pattern)
    lower, out = col(low), F
    holds = lambda literals: reduce(lambda a, b: a | b, (F.contains(lower, F.lit(x)) for x in literals))
    for p, literals in alternatives(pattern):
        # cases, not ands and ors, whose parts Spark may compute beforehand
        out = out.when(v.rlike(p) if literals is None else F.when(holds(literals), v.rlike(p)).otherwise(False), True)
    return out.otherwise(False)


def labels_of(value: C, patterns: Sequence[tuple[str, str]], low: C | None = None) -> Column:
    """The labels of the patterns (label, regular expression) that a text matches, in their order."""
    return F.array_compact(F.array(*(F.when(has(value, low, p), label) for label, p in patterns))) if patterns else F.array().cast("array<string>")


def first(value: C, low: C | None, pattern: str, group: int = 0) -> Column:
    """What a text matches first, or a group of that; blank if nothing."""
    found = F.regexp_extract(col(value), pattern, group)
    return found if low is None else F.when(has(value, low, pattern), found).otherwise("")
