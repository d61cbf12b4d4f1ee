"""Kinds of expressions replaced by a mark.

Java's matcher recurses once for each turn of a group of varying length and ends the JVM's stack on long runs; loops
over groups are possessive here, so that runs of any length pass.
"""

from __future__ import annotations

from pyspark.sql import Column

from lexispark.functions.columns import WORD_SIGNS, ColumnOrName, substitute

_W = f"[{WORD_SIGNS}]"
_DOT = "[.]"
_BEFORE_URL, _AFTER_URL = rf"(?<![./{WORD_SIGNS}])", rf"(?![&/+!?{WORD_SIGNS}])"
_HOST = r"[a-z0-9\x{A1}-\x{FFFF}]"
_LABEL = f"{_HOST}(?:-?{_HOST})*+"
_OCTET = "(?:25[0-5]|2[0-4]\\d|1?\\d{1,2})"
_PRIVATE = rf"(?!(?:127|10)(?:{_DOT}\d{{1,3}}){{3}})(?!(?:192{_DOT}168|169{_DOT}254)(?:{_DOT}\d{{1,3}}){{2}})(?!172{_DOT}(?:3[01]|2\d|1[6-9])(?:{_DOT}\d{{1,3}}){{2}})"
_ADDRESS = rf"{_PRIVATE}(?:22[0-3]|2[01]\d|1\d\d|[1-9]\d?)(?:{_DOT}{_OCTET}){{2}}{_DOT}(?:25[0-4]|2[0-4]\d|1\d\d|[1-9]\d?)"
#: The last label has letters only; labels before it are taken greedily, with the last given back.
_LAST = rf"{_DOT}[a-z\x{{A1}}-\x{{FFFF}}]{{2,}}"
_NAME = rf"{_LABEL}(?:{_DOT}{_LABEL}(?={_LAST}))*+{_LAST}"
URL = rf"(?i){_BEFORE_URL}(?:(?:ftp|https?)://|www\d{{0,3}}{_DOT})(?:[^\s@/]+@)?(?:{_ADDRESS}|{_NAME})(?::\d{{2,5}})?(?:/\S*)?{_AFTER_URL}"
SHORT_URL = rf"(?i){_BEFORE_URL}(?:https?://)?(?:{_W}+-)*+{_W}+(?:{_DOT}[a-z]{{2,12}}){{1,3}}/[^\s|+'\"?!,.]{{2,12}}{_AFTER_URL}"
EMAIL = rf"(?i)(?:mailto:)?(?<![.@){WORD_SIGNS}])[+\-{WORD_SIGNS}]++(?:{_DOT}[+\-{WORD_SIGNS}]++)*+@{_W}++(?:-{_W}++)*+(?:{_DOT}[a-z]{{2,}}){{1,3}}(?!{_W})"
USER_HANDLE = rf"(?<![.@{WORD_SIGNS}])@{_W}+"
HASHTAG = rf"(?<![.#\x{{FF03}}{WORD_SIGNS}])[#\x{{FF03}}](?!\p{{Nd}}){_W}+"
_EXTENSION = r"(?:\s?(?:[x#-]|ext[.]?)\s?\d{2,6})?"
PHONE = rf"(?i)(?<![){WORD_SIGNS}])(?:[+]?1[-. ]?)?(?:[(]?\d{{3}}[)]?[-. ]?)?\d{{3}}[-. ]?\d{{4}}{_EXTENSION}(?!{_W})"
_COMMA_GROUPS, _BLANK_GROUPS = r"[1-9]\d{0,2}(?:,\d{3})+(?:[.]\d*)?", r"[1-9]\d{0,2}(?:[. ]\d{3})+(?:,\d*)?"
NUMBER = rf"(?<![.,{WORD_SIGNS}])[-–+]?(?:{_COMMA_GROUPS}|{_BLANK_GROUPS}|\d*?[,.]\d+|\d+)(?:$|(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
CURRENCY = r"[$¢£¤¥ƒ֏؋৲৳૱௹฿៛ℳ元円圆圓﷼\x{20A0}-\x{20C0}]"
EMOJI = r"[\x{2600}-\x{27BF}\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1FA70}-\x{1FAFF}]"


def currency_symbols(c: ColumnOrName, repl: str = "_CUR_") -> Column:
    return substitute(c, CURRENCY, repl)


def emails(c: ColumnOrName, repl: str = "_EMAIL_") -> Column:
    """Addresses, with ``mailto:`` if it stands before."""
    return substitute(c, EMAIL, repl)


def emojis(c: ColumnOrName, repl: str = "_EMOJI_") -> Column:
    """Each emoji by itself."""
    return substitute(c, EMOJI, repl)


def hashtags(c: ColumnOrName, repl: str = "_TAG_") -> Column:
    return substitute(c, HASHTAG, repl)


def numbers(c: ColumnOrName, repl: str = "_NUMBER_") -> Column:
    """Whole and decimal numbers, signed or not, with or without thousands apart."""
    return substitute(c, NUMBER, repl)


def phone_numbers(c: ColumnOrName, repl: str = "_PHONE_") -> Column:
    return substitute(c, PHONE, repl)


def urls(c: ColumnOrName, repl: str = "_URL_") -> Column:
    """Full URLs, then shortened ones without a scheme in what that leaves."""
    return substitute(substitute(c, URL, repl), SHORT_URL, repl)


def user_handles(c: ColumnOrName, repl: str = "_USER_") -> Column:
    return substitute(c, USER_HANDLE, repl)
