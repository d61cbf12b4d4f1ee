"""Similarity of two strings or two arrays of strings, from 0 to 1. Two empty ones have 0; a null gives null."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Callable
from math import log, sqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.functions.columns import ColumnOrName, col

Pair = tuple[ColumnOrName, ColumnOrName]


def _chars(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))


def hamming(str1: ColumnOrName, str2: ColumnOrName) -> Column:
    """Share of places with equal characters; places beyond the shorter string are unlike."""
    a, b = col(str1), col(str2)
    unlike = F.size(F.filter(F.zip_with(_chars(a), _chars(b), lambda x, y: ~x.eqNullSafe(y)), lambda x: x))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).when(longest.isNotNull() & a.isNotNull() & b.isNotNull(), 1 - unlike / longest)


def levenshtein(str1: ColumnOrName, str2: ColumnOrName) -> Column:
    """One less the edit distance in relation to the longer string."""
    a, b = col(str1), col(str2)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).when(a.isNotNull() & b.isNotNull(), 1 - F.levenshtein(a, b) / longest)


def _jaro(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(len(a), len(b), 2) // 2 - 1
    taken = [False] * len(b)
    matched_a = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                matched_a.append(x)
                break
    m = len(matched_a)
    if not m:
        return 0.0
    matched_b = [y for y, t in zip(b, taken) if t]
    moved = sum(x != y for x, y in zip(matched_a, matched_b)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def _pairwise(f: Callable, c1: ColumnOrName, c2: ColumnOrName) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

    return run(col(c1), col(c2))


def jaro(str1: ColumnOrName, str2: ColumnOrName) -> Column:
    """Jaro's measure, without the bonus for a common beginning."""
    return _pairwise(_jaro, str1, str2)


def _trigram_cosine(a: str, b: str) -> float:
    import re

    texts = [" ".join(re.findall(r"[^\W_]+", t.lower())) for t in (a, b)]
    counts = [Counter(t[i : i + 3] for i in range(len(t) - 2)) for t in texts]
    both = set(counts[0]) & set(counts[1])
    # inverse document frequency over the two strings
    weight = lambda g: log(3 / (2 + (g in both))) + 1
    norms = [sqrt(sum((n * weight(g)) ** 2 for g, n in c.items())) for c in counts]
    return sum(counts[0][g] * counts[1][g] * weight(g) ** 2 for g in both) / (norms[0] * norms[1]) if all(norms) else 0.0


def character_ngrams(str1: ColumnOrName, str2: ColumnOrName) -> Column:
    """Cosine of the tf-idf weighted character trigrams of letters and digits, in lower case."""
    return _pairwise(_trigram_cosine, str1, str2)


def _sets(seq1: ColumnOrName, seq2: ColumnOrName) -> tuple[Column, Column, Column]:
    a, b = col(seq1), col(seq2)
    return F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b))


def _known(seq1: ColumnOrName, seq2: ColumnOrName, value: Column) -> Column:
    return F.when(col(seq1).isNotNull() & col(seq2).isNotNull(), F.coalesce(value, F.lit(0.0)))


def jaccard(seq1: ColumnOrName, seq2: ColumnOrName) -> Column:
    """Common elements in relation to all."""
    both, a, b = _sets(seq1, seq2)
    return _known(seq1, seq2, F.try_divide(both, a + b - both))


def sorensen_dice(seq1: ColumnOrName, seq2: ColumnOrName) -> Column:
    both, a, b = _sets(seq1, seq2)
    return _known(seq1, seq2, F.try_divide(2 * both, a + b))


def tversky(seq1: ColumnOrName, seq2: ColumnOrName, *, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """The symmetric form: common elements against a mix of the lesser and the greater rest."""
    both, a, b = _sets(seq1, seq2)
    low, high = F.least(a, b) - both, F.greatest(a, b) - both
    return _known(seq1, seq2, F.try_divide(both, both + F.lit(float(beta)) * (F.lit(float(alpha)) * low + F.lit(1.0 - alpha) * high)))


def cosine(seq1: ColumnOrName, seq2: ColumnOrName) -> Column:
    """Common elements against the geometric mean of both sizes."""
    both, a, b = _sets(seq1, seq2)
    return _known(seq1, seq2, F.try_divide(both, F.sqrt(a * b)))


def bag(seq1: ColumnOrName, seq2: ColumnOrName) -> Column:
    """One less the greater rest of the two multisets in relation to the longer sequence."""
    a, b = col(seq1), col(seq2)

    def rest(x: Column, y: Column) -> Column:
        count = lambda s, v: F.size(F.filter(s, lambda z: z == v))
        return F.aggregate(F.array_distinct(x), F.lit(0), lambda n, v: n + F.greatest(F.lit(0), count(x, v) - count(y, v)))

    longest = F.greatest(F.size(a), F.size(b))
    return _known(seq1, seq2, F.when(longest > 0, 1 - F.greatest(rest(a, b), rest(b, a)) / longest))


def matching_subsequences_ratio(seq1: ColumnOrName, seq2: ColumnOrName, *, autojunk: bool = True) -> Column:
    """Share of what the longest matching blocks cover, of strings or arrays."""
    return _pairwise(lambda x, y: difflib.SequenceMatcher(None, list(x), list(y), autojunk=autojunk).ratio() if len(x) + len(y) else 0.0, seq1, seq2)


def _sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), " ")


def token_sort_ratio(s1: ColumnOrName, s2: ColumnOrName) -> Column:
    """Edit similarity of the alphabetically ordered tokens."""
    return levenshtein(_sorted_tokens(col(s1)), _sorted_tokens(col(s2)))


def monge_elkan(seq1: ColumnOrName, seq2: ColumnOrName, sim_func: Callable[[Column, Column], Column] = levenshtein) -> Column:
    """Mean of each element's best similarity in the other sequence, both ways."""
    a, b = col(seq1), col(seq2)

    def one_way(x: Column, y: Column) -> Column:
        best = F.transform(x, lambda u: F.array_max(F.transform(y, lambda v: sim_func(u, v))))
        return F.aggregate(best, F.lit(0.0), lambda n, v: n + v) / F.size(x)

    return _known(seq1, seq2, F.when((F.size(a) > 0) & (F.size(b) > 0), (one_way(a, b) + one_way(b, a)) / 2))


METRICS: dict[str, Callable[..., Column]] = {f.__name__: f for f in (hamming, levenshtein, jaro, character_ngrams, jaccard, sorensen_dice, tversky, cosine, bag, matching_subsequences_ratio, token_sort_ratio, monge_elkan)}
