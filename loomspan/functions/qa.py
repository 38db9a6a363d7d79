"""Deterministic checks of short texts and scraped texts: ordered arrays of flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .context import opens_sentence
from .names import noun_form
from .regex import CLOSE, bind, segments, strip

# Length limits, refusal phrases, scripts, words that are no nouns, and the flags a revalidation owns.
MIN_LENGTH, MAX_LENGTH = 40, 280
REFUSALS = ("as an ai", "i cannot", "i can't", "i'm not able to", "i am not able to", "sorry, but")
FOREIGN = "[\\u4e00-\\u9fff\\u3040-\\u30ff\\uac00-\\ud7af]"
COMMON = ("i", "the", "a", "an", "he", "she", "they", "it", "you", "we")
OWNED_FLAGS = (
    "empty_short_text", "short_text_too_short", "short_text_too_long", "short_text_identical_to_raw",
    "possible_refusal_artifact", "possible_hallucinated_name", "possible_untranslated_text",
)


def flags(*conditions: tuple[str, Column]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions]))


#: A token starts with a letter and runs on over letters and apostrophes. ``CAPITAL_TOKEN`` finds those that start with a capital
#: without stopping at all others, in texts without longer runs of apostrophes than it looks back over.
ANY_TOKEN = "[a-zA-Z][a-zA-Z']*"
LONG_RUN = 21
CAPITAL_TOKEN = f"(?=[A-Z])(?<![A-Za-z]'{{0,{LONG_RUN - 1}}})[A-Z][a-zA-Z']*"


def _nouns(text: Column, pattern: str, skip_openers: bool) -> Column:
    parts = segments(text, pattern)
    before = F.transform(parts, lambda p: F.replace(p, F.lit(CLOSE), F.lit("")))
    n = F.greatest(F.size(parts) - 1, F.lit(0))
    two_back = F.concat(F.array(F.lit("")), before)
    rows = F.arrays_zip(F.slice(parts, F.lit(2), n).alias("token"), F.slice(before, F.lit(1), n).alias("one"), F.slice(two_back, F.lit(1), n).alias("two"))
    token = lambda r: F.substring_index(r["token"], CLOSE, 1)
    kept = F.filter(rows, lambda r: ~F.lower(token(r)).isin(*COMMON))
    if pattern == ANY_TOKEN:
        kept = F.filter(kept, lambda r: token(r).rlike("^[A-Z]"))
    if skip_openers:
        kept = F.filter(kept, lambda r: ~opens_sentence(F.concat(r["two"], r["one"])))
    return F.array_distinct(F.transform(kept, lambda r: noun_form(token(r))))


def proper_nouns(text: Column, skip_openers: bool) -> Column:
    """Distinct capitalised tokens in their noun form; optionally without those that open a sentence."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(whole.contains("'" * LONG_RUN), _nouns(whole, ANY_TOKEN, skip_openers)).otherwise(_nouns(whole, CAPITAL_TOKEN, skip_openers))


def short_text_flags(short: Column, raw: Column, name: Column, raw_nouns: Column | None = None) -> Column:
    """Flags of a short text against its source; an empty one has that flag alone. ``raw_nouns`` may hold the source's proper nouns;
    where it is null the source is searched for them."""
    low = F.lower(short)
    refusal = F.lit(False)
    for marker in REFUSALS:
        refusal = refusal | low.contains(marker)
    # the source, by far the longest text, is searched only where the short text has nouns that are not in the name
    open_ = F.array_except(proper_nouns(short, True), proper_nouns(name, False))
    there = proper_nouns(raw, True) if raw_nouns is None else F.coalesce(raw_nouns, proper_nouns(raw, True))
    invented = bind(open_, lambda nouns: F.when(F.size(nouns) > 0, F.size(F.array_except(nouns, there)) > 0).otherwise(False))
    found = flags(
        ("short_text_too_short", F.length(short) < MIN_LENGTH), ("short_text_too_long", F.length(short) > MAX_LENGTH),
        ("short_text_identical_to_raw", strip(short) == strip(raw)), ("possible_refusal_artifact", refusal),
        ("possible_untranslated_text", short.rlike(FOREIGN)), ("possible_hallucinated_name", invented),
    )
    return F.when(strip(F.coalesce(short, F.lit(""))) == "", F.array(F.lit("empty_short_text"))).otherwise(found)


def length_flags(text: Column, longest: int, shortest: int = 10) -> Column:
    return flags(("flavor_text_unexpectedly_long", F.length(text) > longest), ("flavor_text_too_short", F.length(text) < shortest))


def other_flags(held: Column, *more: str) -> Column:
    """Flags that a revalidation does not own (nor ``more``), in order and with repeats; null counts as none."""
    return F.filter(F.coalesce(held, F.array().cast("array<string>")), lambda f: ~f.isin(*OWNED_FLAGS, *more))


def has_flags(held: Column) -> Column:
    return F.coalesce(F.size(held), F.lit(0)) > 0


def is_eligible(reviewed: Column, held: Column) -> Column:
    return F.coalesce(reviewed, F.lit(False)) & ~has_flags(held)
