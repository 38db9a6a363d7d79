"""Names, slugs, keys and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import fold_spaces

# Words that are no names, honorifics, curated aliases, title abbreviations.
STOPWORDS = (
    "i i'll i've i'm i'd it it's he she they you we us me my your our his her their the a an and but or if so then than "
    "this that these those there here when where what which who whom whose why how all any some one two three no not now yes oh ah "
    "as in on at by to of up out off down welcome indeed meanwhile instead besides otherwise finally later soon today tomorrow yesterday "
    "ever never always often again away back very however after before even just only though although perhaps maybe like once every each "
    "still yet also because since while until for from with without into onto upon over under through during against between among about above "
    "below behind beyond within across toward towards let let's don't doesn't didn't can't won't "
    "people someone everyone anyone nobody something everything anything nothing day time year years "
    "world life death man woman child god gods well good great long many much more most thank thanks please sorry hello goodbye okay"
).split()
HONORIFICS = (
    "madam miss mister mr mrs ms dr doctor lord lady master sir dame captain general commander elder saint father mother aunt uncle "
    "king queen emperor empress prince princess duke duchess baron admiral marshal sergeant"
).split()
ALIASES = {
    "luofu": "Xianzhou Luofu",
    "the luofu": "Xianzhou Luofu",
    "yaoqing": "Xianzhou Yaoqing",
    "zhuming": "Xianzhou Zhuming",
    "express": "Astral Express",
    "trailblaze": "Trailblazer",
    "ipc": "Interastral Peace Corporation",
}
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "st", "jr", "sr", "prof")

_TITLES = "|".join(HONORIFICS)


def dashed(name: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def slug(name: Column, prefix: str = "", index: Column | None = None) -> Column:
    """Record id: ``prefix-name`` or ``prefix-name-index``."""
    parts = [F.lit(prefix), dashed(name)] + ([index.cast("string")] if index is not None else [])
    return F.concat_ws("-", *parts)


def entity_slug(name: Column) -> Column:
    """Entity id; a name without usable characters is ``unnamed``."""
    return F.when(dashed(name) == "", "unnamed").otherwise(dashed(name))


def merge_name(name: Column) -> Column:
    """Name as a merge key: lower-case letters and digits only, so names in other scripts share the empty key."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def page_url(title: Column, base: str = "") -> Column:
    """Spaces as underscores, UTF-8 percent encoding, ``/:()',!&`` kept."""
    out = F.url_encode(F.translate(title, " ", "_"))
    for code, char in (("%2F", "/"), ("%3A", ":"), ("%28", "("), ("%29", ")"), ("%27", "'"), ("%2C", ","), ("%21", "!"), ("%26", "&"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.concat(F.lit(base), F.replace(out, F.lit("*"), F.lit("%2A")))


def request_hash(params: Column) -> Column:
    """sha256 of a string map as JSON with sorted keys and ``", "``, ``": "`` between parts (ASCII values)."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    items = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"])))
    return F.sha2(F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}")), 256)


def canonical_key(surface: Column) -> Column:
    """One key for a name's variants: white space folded, lower case, one possessive and then a plural s dropped."""
    key = F.regexp_replace(F.lower(fold_spaces(surface)), "['’]s$", "")
    return F.when(key.endswith("s") & (F.length(key) > 4), F.substring(key, F.lit(1), F.length(key) - 1)).otherwise(key)


def strip_honorific(surface: Column) -> Column:
    """Leading honorifics go while a capitalised word follows."""
    return F.regexp_replace(fold_spaces(surface), rf"^(?:(?i:{_TITLES})\.* (?=\p{{Lu}}))++", "")


def strip_article(surface: Column) -> Column:
    return F.trim(F.regexp_replace(surface, r"(?i)^(?:the|a|an)\s+", ""))


def is_stopword(word: Column) -> Column:
    return F.lower(word).isin(*STOPWORDS)


def is_no_name(word: Column) -> Column:
    """A lone word that never is a name: a stop word or a bare honorific."""
    return F.regexp_replace(F.lower(word), r"\.+$", "").isin(*STOPWORDS, *HONORIFICS)


def noun_form(word: Column) -> Column:
    """Token without trailing possessives, then without one plural s if longer than three."""
    bare = F.regexp_replace(word, r"(?:'s|')++\z", "")
    return F.when(bare.endswith("s") & (F.length(bare) > 3), F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)
