"""Regular-expression helpers that keep Unicode semantics and match positions inside whole-stage SQL functions.

A repeated group is matched by recursion unless it is possessive, so that a long enough text would end the executor: groups here and in
the other functions are possessive (``(...)*+``) wherever they may repeat without a bound.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Any white space, as Unicode has it, and the four ASCII separators.
WS = r"[\s\x1c-\x1f]"
OPEN, CLOSE = "\u0001", "\u0002"


def strip(c: Column) -> Column:
    """Without white space at both ends (``trim`` removes U+0020 only)."""
    return F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+\z", "")


def fold_spaces(c: Column) -> Column:
    """Runs of white space become one space; ends are stripped."""
    return F.trim(F.regexp_replace(c, rf"(?U){WS}+", " "))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """First match's group, or null where nothing matches."""
    return F.when(F.regexp_instr(c, F.lit(pattern)) > 0, F.regexp_extract(c, pattern, group))


def bind(c: Column, f) -> Column:
    """``f(c)`` with ``c`` computed once, however often ``f`` uses it (conditions keep the optimizer from sharing it)."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def segments(text: Column, pattern: str) -> Column:
    """The text cut before every match: element 0 precedes the first match; each other element is a match, ``CLOSE`` and what
    follows it. The two sentinel characters count as spaces where a text holds them."""
    odd = text.contains(OPEN) | text.contains(CLOSE)
    clean = F.when(odd, F.translate(text, OPEN + CLOSE, "  ")).otherwise(text)
    return F.split(F.regexp_replace(clean, f"({pattern})", OPEN + "$1" + CLOSE), OPEN)


def replace_each(text: Column, pattern: str, change) -> Column:
    """Replace every match (without its own lookups outside) by ``change(match)``, a Column function."""

    def join(parts: Column) -> Column:
        tail = F.transform(
            F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda s: F.concat(change(F.substring_index(s, CLOSE, 1)), F.substring_index(s, CLOSE, -1)),
        )
        return F.concat(F.element_at(parts, 1), F.array_join(tail, ""))

    return bind(segments(text, pattern), join)
