"""Display strings of the browsing side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories in display order with their labels.
CATEGORIES = (("light_cone", "light cone", "light cones"), ("relic_set", "relic set", "relic sets"), ("character_story", "character story", "character stories"))


def escape_html(c: Column) -> Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    for char, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or one + "s"))


def describe_spread(counts: dict[str, Column], categories=CATEGORIES) -> Column:
    """``4 light cones, 2 relic sets and 9 character stories``: non-zero categories in fixed order.

    Without any known category the text is `` and undefined``.
    """
    parts = F.array_compact(F.array(*[F.when(F.coalesce(counts[k], F.lit(0)) > 0, plural(counts[k], one, many)) for k, one, many in categories if k in counts]))
    n = F.size(parts)
    start = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 1, F.element_at(parts, 1)).when(n == 0, " and undefined").otherwise(F.concat(start, F.lit(" and "), F.element_at(parts, -1)))


def name_matches(name: Column, query: Column) -> Column:
    """Substring search without case; an empty query matches all."""
    q = F.lower(F.trim(query))
    return (q == "") | F.contains(F.lower(name), q)
