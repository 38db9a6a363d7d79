"""Capitalised-run mentions with the context that stands before them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.context import follows_prose, opens_sentence
from ..functions.names import canonical_key, is_no_name, is_stopword, strip_honorific
from ..functions.regex import CLOSE, WS, fold_spaces, segments

# Fixed value: words of a capital and lower-case letters (or apostrophes), joined by blanks or a lower-case connector. The repeated group
# is possessive: nothing follows it and no word can give anything back, and only so is a run of any length matched without recursion.
_WORD = "[A-Z][a-z’']+"
RUN = rf"(?U){_WORD}(?:{WS}+(?:of|the|de|and|in|on){WS}+{_WORD}|{WS}+{_WORD})*+"
MIN_EVIDENCE = 2


def mentions(entries: DataFrame, text: str = "raw_text") -> DataFrame:
    """One row per run: the entry's other columns, match_pos (from 0), surface, opens, prose.

    A run's context is the two segments before it; it is reduced to two flags before anything is shuffled. Null and empty
    texts have no mentions. Columns of these names in ``entries`` are replaced.
    """
    keep = [c for c in entries.columns if c not in (text, "match_pos", "surface", "opens", "prose")]
    cut = entries.filter(F.col(text).rlike("[A-Z][a-z’']")).select(*keep, segments(F.col(text), RUN).alias("_parts"))
    n = F.size("_parts") - 1
    plain = lambda c: F.replace(c, F.lit(CLOSE), F.lit(""))
    rows = F.arrays_zip(
        F.slice("_parts", F.lit(2), n).alias("now"), F.slice("_parts", F.lit(1), n).alias("one"),
        F.slice(F.concat(F.array(F.lit("")), F.col("_parts")), F.lit(1), n).alias("two"),
    )
    found = cut.filter(n > 0).select(*keep, F.posexplode(rows).alias("match_pos", "_r"))
    before = F.concat(plain(F.col("_r.two")), plain(F.col("_r.one")))
    return found.select(
        *keep, "match_pos", fold_spaces(F.substring_index("_r.now", CLOSE, 1)).alias("surface"), opens_sentence(before).alias("opens"), follows_prose(before).alias("prose"),
    )


def _named(found: DataFrame) -> DataFrame:
    """Without honorifics; adds the number of words and the key."""
    return found.withColumn("surface", strip_honorific(F.col("surface"))).withColumn("words", F.size(F.split("surface", " "))).withColumn("key", canonical_key(F.col("surface")))


def confirmed_words(found: DataFrame, entry: str = "entry_id", least: int = MIN_EVIDENCE) -> DataFrame:
    """Keys of one-word names that stand in running prose in at least ``least`` entries.

    (key, entry) pairs are made distinct before they are counted, so a hub word is pre-aggregated on the map side.
    """
    single = _named(found).filter((F.col("words") == 1) & ~is_no_name(F.col("surface")) & F.col("prose"))
    return single.select("key", entry).distinct().groupBy("key").agg(F.count("*").alias("entries")).filter(F.col("entries") >= least)


def surface_forms(found: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """Mentions that may name something: multi-word runs with a word that is no stop word, single words that do not open a
    sentence, and confirmed single words anywhere."""
    named = _named(found)
    if confirmed is not None:
        named = named.join(confirmed.select(F.col("key").alias("_ckey")), F.col("key") == F.col("_ckey"), "left")
        vouched = F.col("_ckey").isNotNull()
    else:
        vouched = F.lit(False)
    single = ~is_no_name(F.col("surface")) & (~F.col("opens") | vouched)
    multi = F.exists(F.split("surface", " "), lambda w: ~is_stopword(w))
    return named.filter(F.when(F.col("words") == 1, single).otherwise(multi)).drop("_ckey", "opens", "prose", "words")
