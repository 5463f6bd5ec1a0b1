"""Which of many patterns can match a text: one pass of an Aho-Corasick automaton over literals that a match must contain.

A literal pattern must occur itself. From a regular expression follows a set of literals of which one occurs in every match, if it has
such a set: the expression is parsed, optional parts and classes are left out, and each alternative must have a literal of its own. Texts
and literals are compared without case, so what is found is more than what matches, never less; callers test the few pairs that remain.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable
from re import _constants as ops
from re import _parser as parser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Syntax that Java reads in another way: sets inside sets, quoted or spaced-out parts.
_OTHER_DIALECT = re.compile(r"\[[^\]]*\[|&&|\\Q|\(\?[a-zA-Z]*x")


class _Folded(dict):
    """Characters as a comparison without case sees them, one for one."""

    def __missing__(self, code: int) -> int:
        upper = chr(code).upper()
        lower = (upper if len(upper) == 1 else chr(code)).lower()
        self[code] = ord(lower[0])
        return self[code]


_FOLDED = _Folded()


def folded(text: str) -> str:
    return text.translate(_FOLDED)


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The set whose shortest literal is longer; fewer literals on a tie."""
    if a is None or b is None:
        return a or b
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))


def _of_sequence(items: Iterable) -> set[str] | None:
    best: set[str] | None = None
    run = ""
    for op, value in items:
        if op is ops.LITERAL:
            run += folded(chr(value))
            continue
        best, run = _better(best, {run} if run else None), ""
        found = None
        if op is ops.SUBPATTERN:
            found = _of_sequence(value[3])
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and value[0] > 0:
            found = _of_sequence(value[2])
        elif op is ops.ATOMIC_GROUP:
            found = _of_sequence(value)
        elif op is ops.BRANCH:
            sets = [_of_sequence(branch) for branch in value[1]]
            found = None if any(s is None for s in sets) else set().union(*sets)
        best = _better(best, found)
    return _better(best, {run} if run else None)


def required_literals(pattern: str) -> set[str] | None:
    """Literals, folded, of which every match of ``pattern`` has at least one; None if none are known."""
    if _OTHER_DIALECT.search(pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            return _of_sequence(parser.parse(pattern, re.IGNORECASE))
    except (re.error, Warning, OverflowError, RecursionError):
        return None


def candidates(text: Column, patterns: Iterable[tuple[int, str, bool]]) -> Column:
    """Array of the ids of all patterns that may match ``text``, from (id, pattern, is a regular expression).

    The patterns travel with the function, so pass a block of bounded size. Expressions without a required literal are always candidates.
    """
    always, words = [], {}
    for number, pattern, is_regex in patterns:
        literals = required_literals(pattern) if is_regex else {folded(pattern)}
        if not literals or "" in literals:
            always.append(number)
            continue
        for literal in literals:
            words.setdefault(literal, []).append(number)

    def find(texts: pd.Series) -> pd.Series:
        automaton = _automaton(words)
        return texts.map(lambda t: sorted({*always, *(n for _, numbers in automaton.iter(folded(t)) for n in numbers)}))

    def find_always(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: always)

    return F.pandas_udf(find if words else find_always, "array<bigint>")(text)


def _automaton(words: dict[str, list[int]]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, numbers in words.items():
        out.add_word(word, numbers)
    out.make_automaton()
    return out
