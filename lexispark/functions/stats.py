"""Statistics of texts as column expressions: counts, diversity and readability.

Most take an array of words; readability takes the struct of counts that :func:`counts` gives, so that a text is cut
into words and sentences once. What would divide by nothing is null.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.columns import ColumnOrName, col, let
from lexispark.functions.tokens import WORD, sentences, words

#: A run of vowels counts as a syllable.
VOWELS = "[aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿ]+"


def n_sents(text: ColumnOrName) -> Column:
    return F.size(sentences(text))


def n_words(w: ColumnOrName) -> Column:
    return F.size(col(w))


def n_unique_words(w: ColumnOrName) -> Column:
    return F.size(F.array_distinct(F.transform(col(w), F.lower)))


def n_words_and_types(w: ColumnOrName) -> Column:
    return F.struct(n_words(w).alias("n_words"), n_unique_words(w).alias("n_types"))


def n_chars_per_word(w: ColumnOrName) -> Column:
    return F.transform(col(w), F.length)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda n, x: n + x)


def n_chars(w: ColumnOrName) -> Column:
    """Characters of all words."""
    return _total(n_chars_per_word(w))


def n_long_words(w: ColumnOrName, *, min_n_chars: int = 7) -> Column:
    return F.size(F.filter(col(w), lambda x: F.length(x) >= min_n_chars))


def syllables(word: Column) -> Column:
    """Runs of vowels, one at least; a word's hyphenation can be counted instead, see :func:`hyphenator`."""
    return F.greatest(F.lit(1), F.regexp_count(F.lower(word), F.lit(VOWELS)))


def hyphenator(patterns: dict[str, str] | list[str]) -> Callable[[ColumnOrName], Column]:
    """A function from words to their syllables by Liang's hyphenation patterns, such as ``hy3ph`` or ``.ach4``."""
    points: dict[str, list[int]] = {}
    for p in patterns:
        letters, values = "", [0]
        for ch in p:
            if ch.isdigit():
                values[-1] = int(ch)
            else:
                letters += ch
                values.append(0)
        points[letters] = values

    def count(word: str) -> int:
        w = f".{word.lower()}."
        value = [0] * (len(w) + 1)
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                for k, v in enumerate(points.get(w[i:j], ())):
                    value[i + k] = max(value[i + k], v)
        return 1 + sum(v % 2 for v in value[3 : len(w) - 2])

    @F.pandas_udf("array<int>")
    def run(w: pd.Series) -> pd.Series:
        return w.map(lambda x: [count(y) for y in x], na_action="ignore")

    return lambda c: run(col(c))


def n_syllables_per_word(w: ColumnOrName) -> Column:
    return F.transform(col(w), syllables)


def n_syllables(w: ColumnOrName) -> Column:
    return _total(n_syllables_per_word(w))


def n_monosyllable_words(w: ColumnOrName) -> Column:
    return F.size(F.filter(col(w), lambda x: syllables(x) == 1))


def n_polysyllable_words(w: ColumnOrName, *, min_n_syllables: int = 3) -> Column:
    return F.size(F.filter(col(w), lambda x: syllables(x) >= min_n_syllables))


def type_counts(w: Column) -> Column:
    """How often each different word occurs: in sorted order a word's count is the distance to the next one's first place."""

    def runs(s: Column) -> Column:
        firsts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return let(firsts, lambda f: F.transform(f, lambda at, k: F.coalesce(F.get(f, k + 1), F.size(s)) - at))

    return let(F.sort_array(w), runs)


def _summed(counts: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda total, k: total + f(k))


def sum_over_types(w: Column, f: Callable[[Column], Column]) -> Column:
    """The sum of ``f`` (of a count, a double) over the different words."""
    return let(type_counts(w), lambda counts: _summed(counts, f))


def repeats(w: Column) -> Column:
    """(i, before) of each place, in no order: the place at which the same word stood last, -1 if it hasn't."""
    placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))

    def one(s: Column) -> Column:
        return F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), F.when(F.get(s, k - 1)["w"] == x["w"], F.get(s, k - 1)["i"]).otherwise(F.lit(-1)).alias("before")))

    return let(placed, one)


def entropy(w: ColumnOrName) -> Column:
    """Bits of a word as written."""
    n = F.size(col(w))
    return F.when(n > 0, F.log2(n) - sum_over_types(col(w), lambda k: k * F.log2(k.cast("double"))) / n).when(n == 0, F.lit(0.0))


def ttr(w: ColumnOrName, variant: str = "standard") -> Column:
    """Types to words: standard, root (Guiraud) or corrected (Carroll); 0 without words."""
    return _ttr(n_words(w), n_unique_words(w), variant)


def _ttr(n: Column, types: Column, variant: str) -> Column:
    below = {"standard": n, "root": F.sqrt(n), "corrected": F.sqrt(2 * n)}
    if variant not in below:
        raise ValueError(f"variant = {variant!r}; known are {sorted(below)}")
    return F.coalesce(F.try_divide(types, below[variant]), F.when(n == 0, F.lit(0.0)))


def log_ttr(w: ColumnOrName, variant: str = "herdan") -> Column:
    """Logarithmic ratios: herdan, summer or dugast; 0 where the denominator is 0, null without words."""
    return _log_ttr(n_words(w), n_unique_words(w), variant)


def _log_ttr(n: Column, types: Column, variant: str) -> Column:
    log_n, log_t = F.log10(n), F.log10(types)
    found = {
        "herdan": lambda: F.try_divide(log_t, log_n),
        "summer": lambda: F.try_divide(F.log10(F.when(log_t > 0, log_t)), F.log10(F.when(log_n > 0, log_n))),
        "dugast": lambda: F.try_divide(log_n * log_n, log_n - log_t),
    }
    if variant not in found:
        raise ValueError(f"variant = {variant!r}; known are {sorted(found)}")
    return F.when(n > 0, F.coalesce(found[variant](), F.lit(0.0)))


def segmented_ttr(w: ColumnOrName, segment_size: int = 50, variant: str = "mean") -> Column:
    """Mean ratio of types over segments (the last partial one left out) or over all sliding windows (``moving-avg``)."""
    if variant not in ("mean", "moving-avg"):
        raise ValueError(f"variant = {variant!r}; known are 'mean' and 'moving-avg'")
    return let(repeats(F.transform(col(w), F.lower)), lambda places: _segmented(places, segment_size, variant))


def _segmented(places: Column, segment_size: int, variant: str) -> Column:
    """From :func:`repeats`: a word is new in a segment or window if it stood last before the beginning.

    A place j is in the windows that begin at max(0, j - size + 1) to min(j, n - size), and new in those that begin
    behind its word's last place, so that all windows together cost one pass.
    """
    n = F.size(places)
    size = F.least(F.lit(segment_size), n)

    def new(p: Column) -> Column:
        i, before = p["i"], p["before"]
        if variant == "mean":
            begin = F.floor(i / size) * size
            return F.when((before < begin) & (begin + size <= n), 1).otherwise(0)
        return F.greatest(F.lit(0), F.least(i, n - size) - F.greatest(F.lit(0), i - size + 1, before + 1) + 1)

    parts = F.floor(n / size) if variant == "mean" else n - size + 1
    total = F.aggregate(places, F.lit(0).cast("long"), lambda t, p: t + new(p))
    return F.when(n > 0, total / (parts * size)).when(n == 0, F.lit(0.0))


def _mtld(lower: list[str], min_ttr: float) -> float:
    def factors(seq: list[str]) -> float:
        n, seen, size = 0.0, set(), 0
        for x in seq:
            size += 1
            seen.add(x)
            if len(seen) / size <= min_ttr:
                n += 1
                seen, size = set(), 0
        if size:
            n += (1 - len(seen) / size) / (1 - min_ttr)
        return len(seq) / (n + 1e-6)

    return (factors(lower) + factors(lower[::-1])) / 2


def mtld(w: ColumnOrName, min_ttr: float = 0.72) -> Column:
    """Mean length of stretches that keep a ratio of types, read forwards and backwards."""

    @F.pandas_udf("double")
    def run(docs: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else _mtld([x.lower() for x in d], min_ttr) for d in docs], dtype="float64")

    return run(col(w))


def hdd(w: ColumnOrName, sample_size: int = 42) -> Column:
    """Expected ratio of types in a sample drawn without replacement."""
    lower = F.transform(col(w), F.lower)
    return let(type_counts(lower), lambda counts: _hdd(counts, F.size(col(w)), sample_size))


def _hdd(counts: Column, n: Column, sample_size: int) -> Column:
    s = F.least(F.lit(sample_size), n)

    def absent(k: Column) -> Column:
        """That a word of count k isn't in the sample: C(n - k, s) / C(n, s), which is C(n - s, k) / C(n, k); the shorter product."""
        few, many = F.least(k, s), F.greatest(k, s)
        return F.aggregate(F.sequence(F.lit(0), few - 1), F.lit(1.0), lambda p, i: p * F.greatest(F.lit(0), n - many - i) / (n - i))

    return F.when(n > 0, _summed(counts, lambda k: (1 - absent(k)) / s)).when(n == 0, F.lit(0.0))


def diversity_profile(w: ColumnOrName) -> Column:
    """A struct of all measures of diversity but MTLD, the words sorted once for the moving and the segmented ratio and once for HDD."""

    def made(lower: Column) -> Column:
        return let(repeats(lower), lambda places: let(type_counts(lower), lambda counts: F.struct(*fields(places, counts))))

    def fields(places: Column, counts: Column) -> list[Column]:
        n, types = F.size(places), F.size(counts)
        plain = {f"{v}_ttr" if v != "standard" else "ttr": _ttr(n, types, v) for v in ("standard", "root", "corrected")} | {v: _log_ttr(n, types, v) for v in ("herdan", "summer", "dugast")}
        rest = {"segmented": _segmented(places, 50, "mean"), "moving": _segmented(places, 50, "moving-avg"), "hdd": _hdd(counts, n, 42)}
        return [c.alias(k) for k, c in (plain | rest).items()]

    return let(F.transform(col(w), F.lower), made)


def counts(text: ColumnOrName, *, min_long: int = 7, min_poly: int = 3) -> Column:
    """The struct of counts of a text that readability is computed from."""
    return let(words(text), lambda w: _counts(text, w, min_long, min_poly))


def syllables_by_word(text: ColumnOrName) -> Column:
    """The runs of vowels of each word of a text: every run becomes one letter, and those are counted without a pattern for each word."""
    short = F.regexp_extract_all(F.regexp_replace(F.lower(col(text)), VOWELS, "a"), F.lit(WORD), F.lit(0))
    return F.transform(short, lambda x: F.length(x) - F.length(F.replace(x, F.lit("a"), F.lit(""))))


def _sentence_count(text: ColumnOrName) -> Column:
    """As many as :func:`sentences` gives."""
    inner = r"[^.!?…\n]"
    return F.regexp_count(col(text), F.lit(rf"(?:(?!{WORD}){inner})*+{WORD}{inner}*+[.!?…]*+"))


def _counts(text: ColumnOrName, w: Column, min_long: int, min_poly: int) -> Column:
    def made(lengths: Column, vowels: Column) -> Column:
        n = F.size(lengths)
        fields = {
            "n_sents": _sentence_count(text), "n_words": n, "n_unique_words": n_unique_words(w), "n_chars": _total(lengths), "n_long_words": F.size(F.filter(lengths, lambda x: x >= min_long)), "n_syllables": F.aggregate(vowels, F.lit(0), lambda total, k: total + F.greatest(F.lit(1), k)),
            "n_monosyllable_words": F.size(F.filter(vowels, lambda k: k <= 1)), "n_polysyllable_words": F.size(F.filter(vowels, lambda k: F.greatest(F.lit(1), k) >= min_poly)), "sum_sq_chars": F.aggregate(lengths, F.lit(0), lambda total, x: total + x * x),
        }
        return F.struct(*[c.alias(k) for k, c in fields.items()])

    return let(n_chars_per_word(w), lambda lengths: let(syllables_by_word(text), lambda vowels: made(lengths, vowels)))


def _ratio(s: Column, a: str, b: str) -> Column:
    return F.try_divide(s[a].cast("double"), s[b])


def automated_readability_index(s: ColumnOrName) -> Column:
    s = col(s)
    return 4.71 * _ratio(s, "n_chars", "n_words") + 0.5 * _ratio(s, "n_words", "n_sents") - 21.43


def automatic_arabic_readability_index(s: ColumnOrName) -> Column:
    s = col(s)
    return 3.28 * s["n_chars"] + 1.43 * _ratio(s, "n_chars", "n_words") + 1.24 * _ratio(s, "n_words", "n_sents")


def coleman_liau_index(s: ColumnOrName) -> Column:
    s = col(s)
    return 5.879851 * _ratio(s, "n_chars", "n_words") - 29.587280 * _ratio(s, "n_sents", "n_words") - 15.800804


def flesch_kincaid_grade_level(s: ColumnOrName) -> Column:
    s = col(s)
    return 11.8 * _ratio(s, "n_syllables", "n_words") + 0.39 * _ratio(s, "n_words", "n_sents") - 15.59


#: base, weight of words a sentence, weight of syllables a word
FLESCH = {
    "de": (180.0, 1.0, 58.5), "en": (206.835, 1.015, 84.6), "es": (206.835, 1.02, 60.0), "fr": (207.0, 1.015, 73.6), "it": (217.0, 1.3, 60.0), "nl": (206.835, 0.93, 77.0), "pt": (248.835, 1.015, 84.6),
    "ru": (206.835, 1.3, 60.1), "tr": (198.825, 2.61, 40.175),
}


def flesch_reading_ease(s: ColumnOrName, *, lang: str = "en") -> Column:
    if lang not in FLESCH:
        raise ValueError(f"lang = {lang!r}; known are {sorted(FLESCH)}")
    s, (base, sentence, word) = col(s), FLESCH[lang]
    return base - sentence * _ratio(s, "n_words", "n_sents") - word * _ratio(s, "n_syllables", "n_words")


def flesch_reading_ease_by_lang(s: ColumnOrName, lang: ColumnOrName) -> Column:
    """The formula of each row's language; null for one that isn't known."""
    cases = [F.when(col(lang) == k, flesch_reading_ease(s, lang=k)) for k in FLESCH]
    return F.coalesce(*cases)


def gulpease_index(s: ColumnOrName) -> Column:
    s = col(s)
    return 300 * _ratio(s, "n_sents", "n_words") - 10 * _ratio(s, "n_chars", "n_words") + 89


def gunning_fog_index(s: ColumnOrName) -> Column:
    s = col(s)
    return 0.4 * (_ratio(s, "n_words", "n_sents") + 100 * _ratio(s, "n_polysyllable_words", "n_words"))


def lix(s: ColumnOrName) -> Column:
    s = col(s)
    return _ratio(s, "n_words", "n_sents") + 100 * _ratio(s, "n_long_words", "n_words")


def mu_legibility_index(s: ColumnOrName) -> Column:
    """From mean and sample variance of word lengths; 0 with fewer than two words."""
    s = col(s)
    n, mean = s["n_words"], _ratio(s, "n_chars", "n_words")
    variance = F.try_divide(s["sum_sq_chars"] - n * mean * mean, n - 1)
    return F.when(n < 2, F.lit(0.0)).otherwise(100 * F.try_divide(n, n - 1) * F.try_divide(mean, variance))


def perspicuity_index(s: ColumnOrName) -> Column:
    s = col(s)
    return 206.835 - _ratio(s, "n_words", "n_sents") - 62.3 * _ratio(s, "n_syllables", "n_words")


def smog_index(s: ColumnOrName) -> Column:
    return 1.0430 * F.sqrt(30 * _ratio(col(s), "n_polysyllable_words", "n_sents")) + 3.1291


#: weights of polysyllables, words a sentence, long words, monosyllables (percentages), and a constant
WIENER = {1: (0.1935, 0.1672, 0.1297, -0.0327, -0.875), 2: (0.2007, 0.1682, 0.1373, 0.0, -2.779), 3: (0.2963, 0.1905, 0.0, 0.0, -1.1144), 4: (0.2744, 0.2656, 0.0, 0.0, -1.693)}


def wiener_sachtextformel(s: ColumnOrName, *, variant: int = 1) -> Column:
    if variant not in WIENER:
        raise ValueError(f"variant = {variant!r}; known are {sorted(WIENER)}")
    s, (many, sentence, long_, one, constant) = col(s), WIENER[variant]
    share = lambda name: 100 * _ratio(s, name, "n_words")
    return many * share("n_polysyllable_words") + sentence * _ratio(s, "n_words", "n_sents") + long_ * share("n_long_words") + one * share("n_monosyllable_words") + F.lit(constant)


READABILITY: dict[str, Callable[..., Column]] = {f.__name__: f for f in (
    automated_readability_index, automatic_arabic_readability_index, coleman_liau_index, flesch_kincaid_grade_level, flesch_reading_ease, gulpease_index, gunning_fog_index, lix, mu_legibility_index,
    perspicuity_index, smog_index, wiener_sachtextformel,
)}
DIVERSITY: dict[str, Callable[..., Column]] = {f.__name__: f for f in (ttr, log_ttr, segmented_ttr, mtld, hdd)}


def readability(name: str, s: ColumnOrName, **options) -> Column:
    """A formula by its name, whose parts may be joined by dashes, blanks or underscores."""
    found = READABILITY.get(name.replace("-", "_").replace(" ", "_"))
    if found is None:
        raise ValueError(f"name = {name!r}; known are {sorted(READABILITY)}")
    return found(s, **options)


def diversity(name: str, w: ColumnOrName, **options) -> Column:
    found = DIVERSITY.get(name.replace("-", "_").replace(" ", "_"))
    if found is None:
        raise ValueError(f"name = {name!r}; known are {sorted(DIVERSITY)}")
    return found(w, **options)


def value_counts(tokens: ColumnOrName, attribute: str) -> Column:
    """How often each value of a token attribute (tag, pos or dep) occurs, as a map; those that are null don't count."""
    values = F.filter(F.transform(col(tokens), lambda t: t[attribute]), lambda v: v.isNotNull())
    return let(values, lambda vs: F.map_from_entries(F.transform(F.array_distinct(vs), lambda v: F.struct(v, F.size(F.filter(vs, lambda x: x == v))))))


def morph_counts(tokens: ColumnOrName) -> Column:
    """Feature to value to count."""
    pairs = F.flatten(F.transform(F.filter(col(tokens), lambda t: t["morph"].isNotNull()), lambda t: F.map_entries(t["morph"])))
    features = F.array_distinct(F.transform(pairs, lambda p: p["key"]))

    def of(feature: Column) -> Column:
        values = F.transform(F.filter(pairs, lambda p: p["key"] == feature), lambda p: p["value"])
        return F.map_from_entries(F.transform(F.array_distinct(values), lambda v: F.struct(v, F.size(F.filter(values, lambda x: x == v)))))

    return F.map_from_entries(F.transform(features, lambda f: F.struct(f, of(f))))


def text_stats(df: DataFrame, *, text_col: str = "text", out_col: str = "stats") -> DataFrame:
    """``df`` with the struct of counts."""
    return df.withColumn(out_col, counts(text_col))
