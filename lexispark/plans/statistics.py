"""Counts, diversity and readability of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions import stats, tokens
from lexispark.plans.registry import query, table
from lexispark.plans.texts import W

_SYLLABLES = f"greatest(1, len(regexp_extract_all(lower(x), '{stats.VOWELS}')))"
#: One row for each document with the counts that everything is computed from.
COUNTS = f"""docs AS (SELECT doc_id, lang, regexp_extract_all(text, '{W}') AS w, len(list_filter(regexp_extract_all(text, '{tokens.SENTENCE}'), lambda s: regexp_matches(s, '{W}'))) AS n_sents FROM documents),
syl AS (SELECT *, list_transform(w, lambda x: {_SYLLABLES}) AS s FROM docs),
c AS (SELECT doc_id, lang, w, n_sents, len(w) AS n_words, len(list_distinct(list_transform(w, lambda x: lower(x)))) AS n_unique_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS n_chars,
  len(list_filter(w, lambda x: length(x) >= 7)) AS n_long_words, coalesce(list_sum(s), 0)::BIGINT AS n_syllables, len(list_filter(s, lambda x: x = 1)) AS n_monosyllable_words, len(list_filter(s, lambda x: x >= 3)) AS n_polysyllable_words,
  coalesce(list_sum(list_transform(w, lambda x: length(x) * length(x))), 0)::BIGINT AS sum_sq_chars FROM syl)"""
_NAMES = ("n_sents", "n_words", "n_unique_words", "n_chars", "n_long_words", "n_syllables", "n_monosyllable_words", "n_polysyllable_words")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(f"WITH {COUNTS} SELECT doc_id, {', '.join(f'{n}::BIGINT AS {n}' for n in _NAMES)} FROM c")
def text_counts(spark, sf_dir):
    df = stats.text_stats(_docs(spark, sf_dir))
    return df.select("doc_id", *[F.col(f"stats.{n}").cast("long").alias(n) for n in _NAMES])


@query(f"SELECT doc_id, round(sum(-p * log2(p)), 6) AS entropy FROM (SELECT doc_id, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS p FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{W}')) AS w FROM documents) GROUP BY doc_id, w) GROUP BY doc_id")
def text_entropy(spark, sf_dir):
    df = _docs(spark, sf_dir).select("doc_id", tokens.words("text").alias("w")).where(F.size("w") > 0)
    return df.select("doc_id", F.round(stats.entropy("w"), 6).alias("entropy"))


_FLESCH = "CASE lang " + " ".join(f"WHEN '{k}' THEN {b} - {s} * n_words / n_sents - {w} * n_syllables / n_words" for k, (b, s, w) in stats.FLESCH.items()) + " END"
_FORMULAS = {
    "automated_readability_index": "4.71 * n_chars / n_words + 0.5 * n_words / n_sents - 21.43",
    "automatic_arabic_readability_index": "3.28 * n_chars + 1.43 * n_chars / n_words + 1.24 * n_words / n_sents",
    "coleman_liau_index": "5.879851 * n_chars / n_words - 29.587280 * n_sents / n_words - 15.800804",
    "flesch_kincaid_grade_level": "11.8 * n_syllables / n_words + 0.39 * n_words / n_sents - 15.59",
    "flesch_reading_ease": _FLESCH,
    "gulpease_index": "300.0 * n_sents / n_words - 10.0 * n_chars / n_words + 89",
    "gunning_fog_index": "0.4 * (n_words / n_sents + 100.0 * n_polysyllable_words / n_words)",
    "lix": "n_words / n_sents + 100.0 * n_long_words / n_words",
    "mu_legibility_index": "CASE WHEN n_words < 2 THEN 0.0 ELSE 100.0 * n_words / (n_words - 1) * (n_chars / n_words) / nullif((sum_sq_chars - n_words * (n_chars / n_words) * (n_chars / n_words)) / (n_words - 1), 0) END",
    "perspicuity_index": "206.835 - n_words / n_sents - 62.3 * n_syllables / n_words",
    "smog_index": "1.0430 * sqrt(30.0 * n_polysyllable_words / n_sents) + 3.1291",
    "wiener_sachtextformel": "19.35 * n_polysyllable_words / n_words + 0.1672 * n_words / n_sents + 12.97 * n_long_words / n_words - 3.27 * n_monosyllable_words / n_words - 0.875",
}


def _cast(formula: str) -> str:
    """The counts as doubles, so that every division is one of doubles."""
    import re

    return re.sub(r"\b(n_\w+|sum_sq_chars)\b", r"\1::DOUBLE", re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1::DOUBLE", formula))


#: Ratios of small numbers often lie halfway between two decimals, where the last bit would decide; the halves are moved a little.
_HALF = 0.500001


@query(f"WITH {COUNTS} SELECT doc_id, {', '.join(f'floor(({_cast(f)}) * 1e5 + {_HALF}) / 1e5 AS {n}' for n, f in _FORMULAS.items())} FROM c WHERE n_words > 0 AND n_sents > 0")
def readability(spark, sf_dir):
    # a text with a word has a sentence; a condition on the counts would be moved below them and count everything twice
    df = stats.text_stats(_docs(spark, sf_dir).where(F.col("text").rlike(W)))
    value = {n: f("stats") for n, f in stats.READABILITY.items()} | {"flesch_reading_ease": stats.flesch_reading_ease_by_lang("stats", "lang")}
    return df.select("doc_id", *[(F.floor(c * 1e5 + _HALF) / 1e5).alias(n) for n, c in value.items()])


_DIVERSITY = f"""WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{W}'), lambda x: lower(x)) AS w FROM documents),
n AS (SELECT doc_id, w, len(w)::DOUBLE AS n, len(list_distinct(w))::DOUBLE AS t, least(50, len(w)) AS s FROM d WHERE len(w) > 0),
k AS (SELECT doc_id, n, least(42, n) AS m, count(*)::DOUBLE AS k FROM (SELECT doc_id, n, unnest(w) AS x FROM n) GROUP BY doc_id, n, x),
h AS (SELECT doc_id, sum((1 - coalesce(list_product(list_transform(range(m::INT), lambda i: greatest(0, n - k - i) / (n - i))), 1)) / m) AS hdd FROM k GROUP BY doc_id)
SELECT doc_id, round(t / n, 6) AS ttr, round(t / sqrt(n), 6) AS root_ttr, round(t / sqrt(2 * n), 6) AS corrected_ttr,
  round(CASE WHEN n = 1 THEN 0 ELSE log10(t) / log10(n) END, 6) AS herdan, round(CASE WHEN n = t THEN 0 ELSE log10(n) * log10(n) / (log10(n) - log10(t)) END, 6) AS dugast,
  round(list_sum(list_transform(range(floor(n / s)::INT), lambda i: len(list_distinct(w[i * s + 1:i * s + s])))) / (floor(n / s) * s), 6) AS segmented,
  round(list_sum(list_transform(range((n - s)::INT + 1), lambda i: len(list_distinct(w[i + 1:i + s])))) / ((n - s + 1) * s), 6) AS moving, round(hdd, 6) AS hdd
FROM n JOIN h USING (doc_id)"""


@query(_DIVERSITY)
def diversity(spark, sf_dir):
    df = _docs(spark, sf_dir).select("doc_id", tokens.words("text").alias("w")).where(F.size("w") > 0).select("doc_id", stats.diversity_profile("w").alias("d"))
    return df.select("doc_id", *[F.round(f"d.{n}", 6).alias(n) for n in ("ttr", "root_ttr", "corrected_ttr", "herdan", "dugast", "segmented", "moving", "hdd")])


@query()
def diversity_mtld(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(stats.mtld(tokens.words("text")), 6).alias("mtld"))
