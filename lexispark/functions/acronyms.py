"""Tokens that look like acronyms."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.functions.columns import ColumnOrName, col

_ALNUM = r"[\p{L}\p{N}]"
#: Capitals, each perhaps with a point and one small sign behind it, up to a capital or a digit; or a digit and capitals.
SHAPE = r"^(?:\d(?:-?[A-Z])+|(?:[A-Z][.]?[-/&\da-z]?)+(?:\ds?|[A-Z][.s]?))(?:[^\p{L}\p{N}_]|$)"


def is_acronym(c: ColumnOrName, exclude: Collection[str] | None = None) -> Column:
    """Whether a token is like an acronym: two capitals, or two to ten letters and digits in the shape of one.

    One with a blank, of digits alone, without a capital (but for a digit at an edge), or in ``exclude`` isn't.
    """
    text = col(c)
    n = F.regexp_count(text, F.lit(_ALNUM))
    two = (F.length(text) != 2) | text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}")
    edge = text.rlike(r"\p{Lu}") | text.rlike(r"^\p{Nd}|\p{Nd}$")
    # the matcher's depth grows with the token; beyond ten letters and digits none is an acronym anyway
    shape = F.when(F.length(text) <= 40, text.rlike(SHAPE)).otherwise(F.lit(False))
    out = ~text.contains(" ") & two & n.between(2, 10) & ~text.rlike(r"^\p{Nd}+$") & edge & shape
    if exclude:
        out = out & ~text.isin(*exclude)
    return out
