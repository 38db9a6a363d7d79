"""Wiki markup: templates, parameters, infobox fields, sections, clean-up."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import WS, bind, extract, fold_spaces, replace_each, strip

_BRACES = r"(?s)(\{\{|\}\}|[^{}]+|[{}])"
_BRACKETS = r"(?s)(\{\{|\}\}|\[\[|\]\]|\||[^{}\[\]|]+|[{}\[\]])"


def _body(rest: Column) -> Column:
    """Text up to the closing braces that balance one open pair; an unterminated text loses its last two characters."""
    tokens = F.regexp_extract_all(rest, F.lit(_BRACES), 1)
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("length"))

    def step(acc: Column, t: Column) -> Column:
        depth = acc["depth"] + F.when(t == "{{", 1).when(t == "}}", -1).otherwise(0)
        return F.when(acc["depth"] <= 0, acc).otherwise(F.struct(depth.alias("depth"), (acc["length"] + F.length(t)).alias("length")))

    read = F.aggregate(tokens, start, step)["length"]
    return F.substring(rest, F.lit(1), F.greatest(read - 2, F.lit(0)))


def _after(text: Column, marker: str) -> Column:
    """What follows the first occurrence of ``marker``; null without one."""
    at = F.instr(text, marker)
    return F.when(at > 0, F.substring(text, at + len(marker), F.length(text)))


def template_arg(text: Column, name: str) -> Column:
    """The argument of the first ``{{name|...}}``, nested templates included; null if absent."""
    return bind(_after(text, "{{" + name + "|"), _body)


def split_params(content: Column) -> Column:
    """Chunks between pipes at depth 0; an unmatched closer makes the depth negative, after which nothing splits."""
    tokens = F.regexp_extract_all(content, F.lit(_BRACKETS), 1)
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, t: Column) -> Column:
        split = (t == "|") & (acc["depth"] == 0)
        depth = acc["depth"] + F.when(t.isin("{{", "[["), 1).when(t.isin("}}", "]]"), -1).otherwise(0)
        done = F.when(split, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        return F.struct(depth.alias("depth"), done.alias("done"), F.when(split, F.lit("")).otherwise(F.concat(acc["now"], t)).alias("now"))

    return F.aggregate(tokens, start, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))


def template_params(text: Column, name: str) -> Column:
    """Named parameters of the first ``{{name``; the last of a repeated name counts; null if absent, empty if it has none."""
    inner = bind(_after(text, "{{" + name), lambda rest: F.regexp_replace(_body(rest), r"^\|", ""))
    pair = rf"(?sU)\A{WS}*([A-Za-z0-9_]+){WS}*={WS}*(.*)"
    pairs = F.transform(
        F.filter(split_params(inner), lambda c: c.rlike(pair)),
        lambda c: F.struct(F.regexp_extract(c, pair, 1).alias("key"), strip(F.regexp_extract(c, pair, 2)).alias("value")),
    )

    def last(found: Column) -> Column:
        keys = F.array_distinct(F.transform(found, lambda p: p["key"]))
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(found, lambda p: p["key"] == k), -1)["value"].alias("value"))))

    return bind(pairs, last)


def infobox_field(text: Column, field: str) -> Column:
    """Value after ``|field =`` to the line's end; an empty field takes the next line, as white space may span lines."""
    return strip(extract(text, rf"(?dU)\|{WS}*{re.escape(field)}{WS}*={WS}*(.+)"))


def section(text: Column, heading: str) -> Column:
    """Body of a level-2 section up to the next level-2 heading; null if absent, empty if it is."""
    return strip(extract(text, rf"(?dmU)(?i:^=={WS}*{re.escape(heading)}{WS}*=={WS}*$)((?s:.*?))(?:^==[^=].*=={WS}*$|\z)"))


def _colour(match: Column) -> Column:
    parts = F.transform(split_params(F.regexp_extract(match, r"(?s)\{\{Color\|(.*)\}\}", 1)), strip)
    kept = F.filter(parts, lambda p: (p != "keyword") & ~p.rlike(rf"(?U)\A\w+{WS}*="))
    return F.coalesce(F.get(kept, F.lit(0)), F.lit(""))


def _sic(match: Column) -> Column:
    parts = split_params(F.regexp_extract(match, r"(?s)\{\{[Ss]ic\|(.*)\}\}", 1))
    hidden = F.exists(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.rlike(rf"(?U)\A{WS}*hide{WS}*={WS}*1{WS}*\z"))
    return F.when(hidden, "").otherwise(strip(F.element_at(parts, 1)))


def _blocks(match: Column) -> Column:
    n = F.regexp_extract(match, r"\|(.*)\}\}", 1)
    return F.repeat(F.lit("▇"), F.when(n.rlike(r"\A[0-9]+\z"), n.cast("int")).otherwise(1))


def clean_text(raw: Column) -> Column:
    """Markup to plain text. The order of the rewrites is part of the result."""
    # The patterns of the rewrites, in their order.
    c = F.regexp_replace(raw, rf"(?iU)<br{WS}*/?>", " ")
    c = F.regexp_replace(c, r"(?d)'''?(.*?)'''?", "$1")
    c = F.regexp_replace(c, r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1")
    c = F.regexp_replace(c, r"\{\{w\|(?:[^|}]*\|)?([^}]+)\}\}", "$1")
    c = F.regexp_replace(c, r"(?i)\{\{Rubi\|([^|}]*)\|[^}]*\}\}", "$1")
    c = F.regexp_replace(c, r"\{\{MC\|m=([^|}]*)\|f=[^}]*\}\}", "$1")
    c = F.regexp_replace(c, r"\{\{MC\|([^|}]*)\|[^}]*\}\}", "$1")
    c = bind(c, lambda x: F.when(x.contains("{{Obfuscate|"), replace_each(x, r"\{\{Obfuscate\|[^}]*\}\}", _blocks)).otherwise(x))
    c = bind(c, lambda x: F.when(x.rlike(r"\{\{[Ss]ic\|"), replace_each(x, r"(?s)\{\{[Ss]ic\|.*?\}\}", _sic)).otherwise(x))
    c = F.regexp_replace(c, r"\{\{[Ss]ic\}\}", "")
    c = bind(c, lambda x: F.when(x.contains("{{Color|"), replace_each(x, r"(?s)\{\{Color\|.*?\}\}", _colour)).otherwise(x))
    c = F.regexp_replace(c, r"(?U)\{\{Character Page Link\|([^|}]*)(?:\|ref=\d+)?\}\}", "$1")
    c = F.regexp_replace(c, r"\{\{(?:ja|zh)\|[^}]*\}\}", "")
    return fold_spaces(c)


# Openers and closing marks of what is no visible text, and the sentinel put behind openers that nothing closes.
_BLOCKS = ((r"script\b", "</script>"), (r"style\b", "</style>"), ("!--", "-->"))
_UNCLOSED = "\u0001"


def _from(c: Column, place: Column) -> Column:
    return F.substring(c, place + 1, F.length(c))


def _mark_unclosed(opener: str, close: str) -> Callable[[Column], Column]:
    """A text with the sentinel in every opener behind the last closing mark, letter case aside."""

    def mark(c: Column) -> Column:
        rest = F.when(F.lower(c).contains(close), F.regexp_extract(c, rf"(?is)\A(?:.*{re.escape(close)})(.*+)\z", 1)).otherwise(c)
        return bind(F.length(c) - F.length(rest), lambda head: F.concat(F.left(c, head), F.regexp_replace(_from(c, head), rf"(?i)<(?={opener})", "<" + _UNCLOSED)))

    return mark


def _without_tags(c: Column) -> Column:
    """A space for every tag. A tag ends with ``>``, so none starts behind the last of those."""
    head = F.length(c) - F.length(F.substring_index(c, ">", -1))
    return F.when(c.contains(">"), F.concat(F.regexp_replace(F.left(c, head), "(?s)<[^>]*+>", " "), _from(c, head))).otherwise(c)


def html_text(html: Column) -> Column:
    """Visible text of an HTML page: scripts, styles, comments and tags out, the usual entities resolved, spaces folded.

    An opener costs its own length only, closed or not: behind the last closing mark of its kind it opens nothing, and gets a
    sentinel (a space where a page holds one) before blocks are taken out.
    """
    c = F.translate(html, _UNCLOSED, " ")
    for opener, close in _BLOCKS:
        c = bind(c, _mark_unclosed(opener, close))
    c = F.regexp_replace(c, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    c = F.replace(bind(c, _without_tags), F.lit(_UNCLOSED), F.lit(""))
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(code), F.lit(char))
    return fold_spaces(c)
