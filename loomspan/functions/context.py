"""What stands before a match: sentence starts and running prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import ABBREVIATIONS

_SKIPPED = " \t\n\"'“”‘’()"


def opens_sentence(before: Column) -> Column:
    """True if only blanks, quotes and brackets stand between the match and the text's start or a sentence end.

    A period does not end a sentence after a title abbreviation; those have at most four letters, so six characters tell.
    """
    rest = F.rtrim(before, F.lit(_SKIPPED))
    last = F.right(rest, F.lit(1))
    short = F.lower(F.regexp_extract(F.right(rest, F.lit(6)), r"(\p{L}*)[.]\z", 1)).isin(*ABBREVIATIONS)
    return F.when(rest == "", True).when(last.isin("!", "?"), True).when(last == ".", ~short).otherwise(False)


def follows_prose(before: Column) -> Column:
    """True if the nearest character that is no blank is a lower-case letter."""
    return F.right(F.rtrim(before, F.lit(" \t\n")), F.lit(1)).rlike(r"(?U)\A\p{Lower}\z")
