"""Text made uniform where it may vary. A null stays null."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.functions.columns import WORD_SIGNS, ColumnOrName, by_text, col, quoted_replacement

BULLETS = "•‣⁃⁌⁍∙▪●◦⦾⦿・"
FANCY_QUOTES, PLAIN_QUOTES = "ʼ‘’´`“”", "'''''\"\""
ZERO_WIDTH = r"[\x{200B}\x{2060}\x{FEFF}]+"
#: White space other than line breaks; what Python's re takes for it.
BLANKS = r"[\t\f\r \x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
EDGE = r"[\s\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def bullet_points(c: ColumnOrName) -> Column:
    """Fancy bullets that begin a line become ``-``."""
    return F.regexp_replace(col(c), rf"((?:^|\n)\s*?)[{BULLETS}]", "$1-")


def hyphenated_words(c: ColumnOrName) -> Column:
    """Words parted by a hyphen and a break are joined, unless digits meet there."""
    return F.regexp_replace(col(c), rf"([{WORD_SIGNS}]+[\p{{L}}_])-\s+([\p{{L}}_][{WORD_SIGNS}]+)", "$1$2")


def quotation_marks(c: ColumnOrName) -> Column:
    """Fancy quotation marks become the ASCII ones."""
    return F.translate(col(c), FANCY_QUOTES, PLAIN_QUOTES)


def repeating_chars(c: ColumnOrName, *, chars: str, maxn: int = 1) -> Column:
    """Longer runs of the string ``chars`` are cut to ``maxn`` of it."""
    literal = "".join(x if x.isalnum() else "\\" + x for x in chars)
    return F.regexp_replace(col(c), rf"(?:{literal}){{{maxn + 1},}}", quoted_replacement(chars * maxn))


def unicode(c: ColumnOrName, *, form: str = "NFC") -> Column:
    """A Unicode normal form: NFC, NFD, NFKC or NFKD."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"form = {form!r} is none of NFC, NFD, NFKC, NFKD")

    normal = by_text(lambda x: unicodedata.normalize(form, x))
    # what is ASCII is in every normal form and stays in the JVM
    return F.when(col(c).rlike(r"^\p{ASCII}*$"), col(c)).otherwise(normal(col(c)))


def whitespace(c: ColumnOrName) -> Column:
    """Zero-width blanks go, line breaks become one newline, other runs of white space one blank; the ends are stripped."""
    out = F.regexp_replace(col(c), ZERO_WIDTH, "")
    out = F.regexp_replace(out, r"(?:\r\n|[\n\x0B])+", "\n")
    out = F.regexp_replace(out, BLANKS, " ")
    return F.regexp_replace(out, rf"^{EDGE}|{EDGE}$", "")


def strip_python(text: str) -> str:
    """What :func:`whitespace` does, for tests."""
    text = re.sub("[​⁠﻿]+", "", text)
    return re.sub(r"[^\S\n\v]+", " ", re.sub(r"(?:\r\n|[\n\v])+", "\n", text)).strip()
