"""Clean-up, tokens, extraction and similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.functions import normalize, remove, replace, similarity, tokens
from lexispark.functions.acronyms import SHAPE, is_acronym
from lexispark.functions.columns import make_pipeline
from lexispark.functions.stopwords import STOP_WORDS
from lexispark.operators import augment, extract
from lexispark.plans.registry import query, table

W = r"[\p{L}\p{M}\p{N}]+"


def _on_text(name: str, f, sql: str | None, source: str = "documents", key: str = "doc_id", text: str = "text"):
    """A query that applies a column function to every text of a table."""

    def run(spark, sf_dir):
        return table(spark, sf_dir, source).select(key, f(F.col(text)).alias("result"))

    query(None if sql is None else f"SELECT {key}, {sql} AS result FROM {source}", name)(run)


def _replaced(text: str, *steps: tuple[str, str]) -> str:
    for pattern, repl in steps:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{repl}', 'g')"
    return text


def _escaped(text: str) -> str:
    return text.replace("'", "''")


_on_text("normalize_bullet_points", normalize.bullet_points, _replaced("text", (rf"((?:^|\n)\s*?)[{normalize.BULLETS}]", r"\1-")))
_on_text("normalize_hyphenated_words", normalize.hyphenated_words, _replaced("text", (r"([\p{L}\p{N}_]+[\p{L}_])-\s+([\p{L}_][\p{L}\p{N}_]+)", r"\1\2")))
_on_text("normalize_quotation_marks", normalize.quotation_marks, f"translate(text, '{normalize.FANCY_QUOTES}', '{_escaped(normalize.PLAIN_QUOTES)}')")
_on_text("normalize_repeating_chars", lambda c: normalize.repeating_chars(c, chars="*", maxn=2), _replaced("text", (r"(?:\*){3,}", "**")))
_on_text("normalize_unicode", normalize.unicode, "nfc_normalize(text)")
_on_text("normalize_whitespace", normalize.whitespace, _replaced("html", (normalize.ZERO_WIDTH, ""), (r"(?:\r\n|[\n\x0B])+", "\n"), (normalize.BLANKS, " "), (rf"^{normalize.EDGE}|{normalize.EDGE}$", "")), "pages", "page_id", "html")
_on_text("remove_accents", remove.accents, "strip_accents(text)")
_on_text("remove_accents_fast", lambda c: remove.accents(c, fast=True), None)
_on_text("remove_brackets", remove.brackets, _replaced("html", *((p, "") for p in remove.BRACKETS.values())), "pages", "page_id", "html")
_on_text("remove_html_tags", remove.html_tags, None, "pages", "page_id", "html")
_on_text("remove_visible_text", remove.visible_text, None, "pages", "page_id", "html")
_on_text("remove_punctuation", remove.punctuation, _replaced("text", (r"\p{P}", " ")))
_on_text("remove_punctuation_only", lambda c: remove.punctuation(c, only=[".", ",", "#"]), _replaced("text", (r"[\.\,\#]+", " ")))
_on_text("replace_currency_symbols", replace.currency_symbols, _replaced("text", (replace.CURRENCY, "_CUR_")))
_on_text("replace_emojis", replace.emojis, _replaced("text", (replace.EMOJI, "_EMOJI_")))
_on_text("replace_emails", replace.emails, None)
_on_text("replace_hashtags", replace.hashtags, None)
_on_text("replace_numbers", replace.numbers, None)
_on_text("replace_phone_numbers", replace.phone_numbers, None)
_on_text("replace_urls", replace.urls, None, "pages", "page_id", "html")
_on_text("replace_user_handles", replace.user_handles, None)
_on_text("clean_pipeline", make_pipeline(normalize.quotation_marks, remove.brackets, remove.punctuation, normalize.whitespace),
    _replaced(_replaced(f"translate(text, '{normalize.FANCY_QUOTES}', '{_escaped(normalize.PLAIN_QUOTES)}')", *((p, "") for p in remove.BRACKETS.values())), (r"\p{P}", " "), (normalize.ZERO_WIDTH, ""), (r"(?:\r\n|[\n\x0B])+", "\n"), (normalize.BLANKS, " "), (rf"^{normalize.EDGE}|{normalize.EDGE}$", "")))


@query(f"SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '{W}')) AS word FROM documents) GROUP BY ALL")
def words_by_lang(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", F.explode(tokens.lower_words("text")).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{tokens.TOKEN}')) AS n_tokens, len(list_filter(regexp_extract_all(text, '{tokens.SENTENCE}'), lambda s: regexp_matches(s, '{W}'))) AS n_sents, md5(array_to_string(regexp_extract_all(text, '{tokens.TOKEN}'), ' ')) AS tokens FROM documents")
def tokenize(spark, sf_dir):
    found = tokens.tokens("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n_tokens"), F.size(tokens.sentences("text")).cast("long").alias("n_sents"), F.md5(F.array_join(found, " ")).alias("tokens"))


_STOPS = ", ".join(f"'{_escaped(w)}'" for w in sorted(frozenset().union(*STOP_WORDS.values())))


@query(f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{W}')) AS word FROM documents) WHERE lower(word) NOT IN ({_STOPS}) GROUP BY ALL")
def content_words(spark, sf_dir):
    kept = tokens.without_stop_words(tokens.words("text"), None)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(kept).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def _ngram_sql(n: int) -> str:
    return f"""SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (
        SELECT doc_id, array_to_string(w[i:i + {n - 1}], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '{W}') AS w FROM documents)))
        GROUP BY gram"""


@query(_ngram_sql(2))
def word_bigrams(spark, sf_dir):
    w = F.col("w")
    starts = F.when(F.size(w) >= 2, F.sequence(F.lit(1), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
    grams = table(spark, sf_dir, "documents").select("doc_id", tokens.lower_words("text").alias("w")).select("doc_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(2)), " "))).alias("gram"))
    by_doc = grams.groupBy("gram", "doc_id").agg(F.count("*").alias("n"))
    return by_doc.groupBy("gram").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


@query("SELECT lang, gram, count(*) AS n FROM (SELECT lang, substr(t, i, 3) AS gram FROM (SELECT lang, t, unnest(range(1, length(t) - 1)) AS i FROM (SELECT lang, lower(text) AS t FROM documents))) GROUP BY ALL")
def char_trigrams(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", F.explode(tokens.char_ngrams("text", 3, lower=True)).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))


_KEY = "licen[sc]ed?"


@query(f"""WITH parts AS (SELECT doc_id, text, regexp_extract_all(text, '(?i)(?:{_KEY})') AS m, regexp_split_to_array(text, '(?i)(?:{_KEY})') AS g FROM documents),
    hits AS (SELECT doc_id, text, m, g, unnest(range(1, len(m) + 1)) AS k FROM parts),
    placed AS (SELECT doc_id, text, m[k] AS keyword, list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS place FROM hits)
    SELECT doc_id, keyword, substr(text, (greatest(place - 30, 0) + 1)::INT, (place - greatest(place - 30, 0))::INT) AS pre, substr(text, (place + length(keyword) + 1)::INT, 30) AS post FROM placed""")  # fmt: skip
def keyword_in_context(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(extract.keyword_in_context("text", _KEY, window_width=30)).alias("k"))
    return found.select("doc_id", "k.keyword", "k.pre", "k.post")


@query(f"SELECT acronym, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}][-./&\\p{{L}}\\p{{N}}]*')) AS acronym FROM documents) WHERE NOT contains(acronym, ' ') AND (length(acronym) <> 2 OR regexp_matches(acronym, '\\p{{Lu}}') AND NOT regexp_matches(acronym, '\\p{{Ll}}')) AND len(regexp_extract_all(acronym, '[\\p{{L}}\\p{{N}}]')) BETWEEN 2 AND 10 AND NOT regexp_matches(acronym, '^\\p{{Nd}}+$') AND (regexp_matches(acronym, '\\p{{Lu}}') OR regexp_matches(acronym, '^\\p{{Nd}}|\\p{{Nd}}$')) AND length(acronym) <= 40 AND regexp_matches(acronym, '{SHAPE}') GROUP BY acronym")
def acronyms(spark, sf_dir):
    shapes = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}][-./&\p{L}\p{N}]*"), F.lit(0))
    return table(spark, sf_dir, "documents").select(F.explode(F.filter(shapes, lambda t: is_acronym(t))).alias("acronym")).groupBy("acronym").agg(F.count("*").alias("n"))


def _annotated(spark, sf_dir):
    return tokens.annotate(table(spark, sf_dir, "documents"), lang_col="lang")


@query()
def augmented_texts(spark, sf_dir):
    df = _annotated(spark, sf_dir).withColumn("aug_toks", augment.to_aug_toks("tokens"))
    varied = augment.Augmenter(["swap_words", "delete_words", "swap_chars", "delete_chars"], num=2).apply_transforms(df, seed=7)
    return varied.select("doc_id", "augmented")


_CHAR_UNLIKE = "len(list_filter(range(1, greatest(length(x), length(y)) + 1), lambda i: substr(x, i::INT, 1) <> substr(y, i::INT, 1)))"
_PAIRS = "pairs AS (SELECT a.item_id AS a, b.item_id AS b, regexp_replace(a.text, '[^\x00-\x7F]', '?', 'g') AS x, regexp_replace(b.text, '[^\x00-\x7F]', '?', 'g') AS y FROM benchmark a JOIN benchmark b ON a.item_id < b.item_id)"


def _pairs(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    # DuckDB's distances are of bytes: in ASCII they are of characters
    b = b.withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "?"))
    left, right = b.select(F.col("item_id").alias("a"), F.col("text").alias("x")), b.select(F.col("item_id").alias("b"), F.col("text").alias("y"))
    return left.join(right, F.col("a") < F.col("b"))


def _round(c: Column) -> Column:
    return F.round(c, 6)


def _sorted_sql(x: str) -> str:
    return f"array_to_string(list_sort(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')), ' ')"


@query(f"""WITH {_PAIRS}, s AS (SELECT *, {_sorted_sql('x')} AS u, {_sorted_sql('y')} AS v FROM pairs)
    SELECT a, b, round(1 - {_CHAR_UNLIKE} / greatest(length(x), length(y)), 6) AS hamming, round(1 - levenshtein(x, y) / greatest(length(x), length(y)), 6) AS levenshtein,
    round(jaro_similarity(x, y), 6) AS jaro, round(1 - levenshtein(u, v) / greatest(length(u), length(v)), 6) AS token_sort_ratio FROM s""")  # fmt: skip
def similarity_of_strings(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", *[_round(similarity.METRICS[m]("x", "y")).alias(m) for m in ("hamming", "levenshtein", "jaro", "token_sort_ratio")])


@query()
def similarity_of_sequences(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", *[_round(similarity.METRICS[m]("x", "y")).alias(m) for m in ("character_ngrams", "matching_subsequences_ratio")])


_COUNT = "len(list_filter({s}, lambda z: z = w))"
_REST = "coalesce(list_sum(list_transform(list_distinct({p}), lambda w: greatest(0, len(list_filter({p}, lambda z: z = w)) - len(list_filter({q}, lambda z: z = w))))), 0)"


@query(f"""WITH {_PAIRS}, t AS (SELECT a, b, regexp_extract_all(lower(x), '{W}') AS p, regexp_extract_all(lower(y), '{W}') AS q FROM pairs),
    n AS (SELECT *, len(list_intersect(p, q))::DOUBLE AS i, len(list_distinct(p)) AS m, len(list_distinct(q)) AS k FROM t)
    SELECT a, b, round(i / (m + k - i), 6) AS jaccard, round(2 * i / (m + k), 6) AS sorensen_dice, round(i / (i + 0.5 * (0.3 * (least(m, k) - i) + 0.7 * (greatest(m, k) - i))), 6) AS tversky, round(i / sqrt(m * k), 6) AS cosine,
    round(1 - greatest({_REST.format(p='p', q='q')}, {_REST.format(p='q', q='p')}) / greatest(len(p), len(q)), 6) AS bag FROM n""")  # fmt: skip
def similarity_of_tokens(spark, sf_dir):
    t = _pairs(spark, sf_dir).select("a", "b", tokens.lower_words("x").alias("p"), tokens.lower_words("y").alias("q"))
    return t.select("a", "b", *[_round(similarity.METRICS[m]("p", "q")).alias(m) for m in ("jaccard", "sorensen_dice", "cosine", "bag")], _round(similarity.tversky("p", "q", alpha=0.3, beta=0.5)).alias("tversky"))


_BEST = "list_avg(list_transform({p}, lambda u: list_max(list_transform({q}, lambda v: 1 - levenshtein(u, v) / greatest(length(u), length(v))))))"


@query(f"""WITH {_PAIRS}, t AS (SELECT a, b, regexp_extract_all(lower(x), '{W}') AS p, regexp_extract_all(lower(y), '{W}') AS q FROM pairs)
    SELECT a, b, round(({_BEST.format(p='p', q='q')} + {_BEST.format(p='q', q='p')}) / 2, 6) AS monge_elkan FROM t""")  # fmt: skip
def similarity_monge_elkan(spark, sf_dir):
    t = _pairs(spark, sf_dir).select("a", "b", tokens.lower_words("x").alias("p"), tokens.lower_words("y").alias("q"))
    return t.select("a", "b", _round(similarity.monge_elkan("p", "q")).alias("monge_elkan"))
