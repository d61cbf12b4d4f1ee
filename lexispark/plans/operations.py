"""Corpora, key terms of known scores, resources, variations, similarities, statistics and checks of arguments."""

from __future__ import annotations

import re
from random import Random

import numpy as np
from pyspark.sql import functions as F

from lexispark import utils
from lexispark.functions import remove, replace, similarity, stats, tokens
from lexispark.operators import augment, keyterms, network, topics, vectorize
from lexispark.operators.corpus import Corpus
from lexispark.operators.resources import ConceptNet, DepecheMood
from lexispark.plans.annotated import TOKENS_SQL
from lexispark.plans.fixtures import WORDS_SQL, as_sql, filled, parsed, rows_sql, words_of
from lexispark.plans.registry import query, table
from lexispark.plans.texts import W
from lexispark.shared import scratch

# ---- clean-up whose patterns look behind: sentences with the thing, and the same with its name


def _replaced(name: str, f, *pairs: tuple[str, str]) -> None:
    def run(spark, sf_dir):
        words = words_of(spark, sf_dir)
        parts = [filled(words, before, "text").select("item_id", f(F.col("text")).alias("result")) for before, _ in pairs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out

    query(rows_sql("result", *[(after,) for _, after in pairs]), name)(run)


_replaced("emails_in_sentences", replace.emails, ("write to {a}.{b}@{c}.com now", "write to _EMAIL_ now"), ("mailto:{a}@{b}-{c}.co.uk", "_EMAIL_"), ("{a}@ {b}", "{a}@ {b}"))
_replaced("hashtags_in_sentences", replace.hashtags, ("see #{a} now", "see _TAG_ now"), ("{a}#{b} #1 x", "{a}#{b} #1 x"))
_replaced("numbers_in_sentences", replace.numbers, ("{a} has 1,234.5 {b}", "{a} has _NUMBER_ {b}"), ("{a} or -7, {b}3", "{a} or _NUMBER_, {b}3"))
_replaced("phones_in_sentences", replace.phone_numbers, ("call 555-321-4567 {a}", "call _PHONE_ {a}"), ("+1 (555) 321 4567 ext. 12", "_PHONE_"), ("{a} 12-34", "{a} 12-34"))
_replaced("urls_in_sentences", replace.urls, ("at https://{a}.example.com/x?y=1 {b}", "at _URL_ {b}"), ("www.{a}.org {b}", "_URL_ {b}"), ("{a}.{b} c", "{a}.{b} c"))
_replaced("handles_in_sentences", replace.user_handles, ("by @{a} {b}", "by _USER_ {b}"), ("{a}@{b} x", "{a}@{b} x"))
_replaced("html_in_sentences", remove.html_tags, ("<p>{a} <b>{b}</b> &amp; {c}</p><!-- {d} -->", "{a} {b} & {c}"), ("{a} < {b}", "{a} < {b}"))
_replaced("visible_html_in_sentences", remove.visible_text, ("<p>{a}</p><script>{b}</script> {c}", "{a} {c}"))

# ---- corpora


def _corpus(spark, sf_dir) -> Corpus:
    """All documents, whatever their language, with their language and source as metadata."""
    docs = table(spark, sf_dir, "documents")
    return Corpus.from_texts(docs, meta=F.struct("lang", "source", "n_chars"))


_EN_TOKENS = TOKENS_SQL.replace("CASE lang", "CASE 'en'")
_EN_WORD = "NOT punct AND NOT stop"


@query(f"WITH {_EN_TOKENS} SELECT l AS word, round(count(*) / (SELECT count(*) FROM tok), 9) AS freq, count(*) AS n FROM tok WHERE {_EN_WORD} GROUP BY l")
def word_counts(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    share = corpus.word_counts(by="lower", weighting="freq").select("word", F.round("count", 9).alias("freq"))
    return share.join(corpus.word_counts(by="lower").select("word", F.col("count").alias("n")), "word")


@query(f"WITH {_EN_TOKENS} SELECT l AS word, round(ln(1 + (SELECT count(*) FROM documents) / count(DISTINCT doc_id)), 6) AS idf FROM tok WHERE {_EN_WORD} GROUP BY l")
def word_doc_counts(spark, sf_dir):
    return _corpus(spark, sf_dir).word_doc_counts(by="lower", weighting="idf").select("word", F.round("count", 6).alias("idf"))


@query("SELECT max(n_chars) AS longest, sum(CASE WHEN lang = 'de' THEN 1 ELSE 0 END)::BIGINT AS german, min(coalesce(source, '')) AS first_source FROM documents")
def aggregated_metadata(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    row = (int(corpus.agg_metadata("n_chars", F.max)), int(corpus.agg_metadata("lang", lambda c: F.sum(F.when(c == "de", 1).otherwise(0)))), corpus.agg_metadata("source", F.min, default=""))
    return spark.createDataFrame([row], "longest long, german long, first_source string")


@query("""WITH n AS (SELECT max(doc_id) + 1 AS n FROM documents), k AS (SELECT count(*) AS k FROM benchmark), b AS (SELECT row_number() OVER (ORDER BY text) - 1 AS i, text FROM benchmark)
    SELECT doc_id AS doc_idx, md5(text) AS text_md5, source FROM documents UNION ALL SELECT n + i, md5(text), NULL FROM b, n UNION ALL SELECT n + k + i, md5(text), 'b' FROM b, n, k UNION ALL SELECT n + 2 * k + i, md5(text), 'b' FROM b, n, k UNION ALL SELECT n + 3 * k + doc_id, md5(text), source FROM documents, n, k""")  # fmt: skip
def corpus_with_additions(spark, sf_dir):
    """Texts, records, annotated documents and another corpus, each behind what is there."""
    corpus = _corpus(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select("text").orderBy("text").coalesce(1)
    meta = F.struct(F.lit("en").alias("lang"), F.lit("b").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    records = items.withColumn("meta", meta)
    grown = corpus.add_texts(items).add_records(records)
    made = Corpus.from_texts(table(spark, sf_dir, "benchmark").selectExpr("row_number() OVER (ORDER BY text) - 1 AS doc_id", "text"), meta=meta)
    grown = grown.add_docs(made.df).add(corpus)
    return grown.df.select("doc_idx", F.md5("text").alias("text_md5"), F.col("meta.source").alias("source"))


@query("""WITH n AS (SELECT max(doc_id) + 1 AS n FROM documents)
    SELECT doc_id AS doc_idx, 'got' AS part FROM documents WHERE lang = 'fr' UNION ALL SELECT * FROM (SELECT doc_id, 'first' FROM documents WHERE n_chars > 500 ORDER BY doc_id LIMIT 7) UNION ALL SELECT doc_id, 'rest' FROM documents WHERE lang <> 'es' UNION ALL SELECT 3, 'one'
    UNION ALL SELECT doc_id, 'slice' FROM documents, n WHERE doc_id >= 5 AND doc_id < n - 10 AND (doc_id - 5) % 3 = 0 UNION ALL SELECT doc_id, 'without' FROM documents, n WHERE doc_id < n - 4 UNION ALL SELECT 1, 'contains'""")  # fmt: skip
def corpus_selections(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    parts = {
        "got": corpus.get(F.col("meta.lang") == "fr"), "first": corpus.get(lambda df: df["meta.n_chars"] > 500, limit=7), "rest": corpus.remove(F.col("meta.lang") == "es").df, "one": corpus[3],
        "slice": corpus[5:-10:3], "without": corpus.without(slice(-4, None)).df,
    }
    out = spark.createDataFrame([(int(corpus.contains(0) and not corpus.contains(-1)), "contains")], "doc_idx long, part string")
    for name, df in parts.items():
        out = out.unionAll(df.select("doc_idx", F.lit(name).alias("part")))
    return out


@query("SELECT vec_id AS doc_idx, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def corpus_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_idx"), F.lit("").alias("text"), F.array().cast(tokens.TOKEN_TYPE).alias("tokens"), F.col("embedding").cast("array<double>").alias("vector"))
    corpus = Corpus(rows)
    total = corpus.vectors().select("doc_idx", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))
    return corpus.vector_norms().withColumn("norm", F.round("norm", 6)).join(total, "doc_idx")


@query(f"WITH {_EN_TOKENS} SELECT doc_id AS doc_idx, count(*)::INT AS n_tokens, count(*) FILTER (stop)::INT AS n_stop FROM tok GROUP BY doc_id")
def saved_corpus(spark, sf_dir):
    """Saved with all attributes and loaded again; empty texts have no tokens to count."""
    path = scratch(spark)
    _corpus(spark, sf_dir).save(path)
    found = Corpus.load(spark, path).df
    return found.where(F.size("tokens") > 0).select("doc_idx", F.size("tokens").alias("n_tokens"), F.size(F.filter("tokens", lambda t: t["is_stop"])).alias("n_stop"))


# ---- key terms of texts whose networks are small enough to be solved by hand

# Long endings keep the words unlike, for of terms that are nearly alike only one is ranked.
_LONG = lambda template: re.sub(r"\{(\w)\}", lambda m: f"{m[0]}{m[1] * 7}", template)
_TEXT = _LONG("{a} {b} . {c} {d} {e} .")
# The words' ranks solve the linear systems of PageRank with a damping of 0.85: for textrank on the undirected cycle with a
# tail a - b - . - c - d - e - . , for sgrank on the directed graph of all pairs of words, weighted (1 + ln(7 / distance))
# times ln(8 / (place + 1)) of both. YAKE's scores follow from its formula with five words that occur once and a mark twice.
_KNOWN = {
    "textrank": ({}, [("{c} {d} {e}", 0.484198), ("{a} {b}", 0.278302)]),
    "sgrank": ({"ngrams": 1}, [("{e}", 0.361252), ("{d}", 0.235479), ("{c}", 0.171488), ("{b}", 0.140368), ("{a}", 0.091413)]),
    "yake": ({"ngrams": 1}, [("{a}", 0.700757), ("{b}", 0.700757), ("{c}", 0.846315), ("{e}", 0.846315), ("{d}", 0.888016)]),
    # a complete network of five words: every level is 3, so that a word weighs 12 times the sum of its inverse places
    "scake": ({}, [("{a} {b}", 12 * (1 + 1 / 2)), ("{c} {d} {e}", 12 * (1 / 4 + 1 / 5 + 1 / 6))]),
}


def _known(method: str, options: dict, ranked: list[tuple[str, float]]) -> None:
    def run(spark, sf_dir):
        rows = tokens.annotate(filled(words_of(spark, sf_dir), _TEXT).select("item_id", "text"))
        found = keyterms.extract_keyterms("tokens", method, normalize="lower", include_pos=None, **options)
        return rows.select("item_id", F.explode(found).alias("t")).select("item_id", "t.term", F.round("t.score", 4).alias("score"))

    query(rows_sql("term, score", *[(_LONG(t), round(s, 4)) for t, s in ranked]), f"{method}_of_known_scores")(run)


for _name, (_options, _ranked) in _KNOWN.items():
    _known(_name, _options, _ranked)

# ---- resources


def _assertions(spark, sf_dir):
    uri = lambda c: F.concat(F.lit("/c/en/"), F.col(c), F.lit("_x/n"))
    words, out = words_of(spark, sf_dir), None
    for rel, a, b in (("/r/Synonym", "a", "b"), ("/r/Antonym", "c", "d"), ("/r/IsA", "e", "f"), ("/r/PartOf", "g", "h"), ("/r/Other", "a", "c")):
        part = words.select(F.lit("u").alias("uri"), F.lit(rel).alias("rel"), uri(a).alias("start_uri"), uri(b).alias("end_uri"), F.lit("{}").alias("json"))
        out = part if out is None else out.unionAll(part)
    path = scratch(spark)
    out.write.csv(path, sep="\t", quote="")
    return ConceptNet.read(spark, path)


@query(f"""WITH {WORDS_SQL}, r AS (SELECT 'synonyms' AS kind, a AS x, b AS y FROM f UNION SELECT 'synonyms', b, a FROM f UNION SELECT 'antonyms', c, d FROM f UNION SELECT 'antonyms', d, c FROM f UNION SELECT 'hyponyms', f, e FROM f UNION SELECT 'meronyms', h, g FROM f),
    t AS (SELECT DISTINCT unnest([a, b, c, d, e, f, g, h]) AS x FROM f), k AS (SELECT unnest(['synonyms', 'antonyms', 'hyponyms', 'meronyms']) AS kind)
    SELECT t.x || '_x' AS term, kind, coalesce((SELECT string_agg(DISTINCT y || ' x', '|' ORDER BY y || ' x') FROM r WHERE r.x = t.x AND r.kind = k.kind), '') AS related FROM t, k""")  # fmt: skip
def related_concepts(spark, sf_dir):
    net = _assertions(spark, sf_dir)
    terms = words_of(spark, sf_dir).select(F.explode(F.array(*"abcdefgh")).alias("w")).distinct().select(F.concat("w", F.lit("_x")).alias("term"))
    out = None
    for kind, get in (("synonyms", net.get_synonyms), ("antonyms", net.get_antonyms), ("hyponyms", net.get_hyponyms), ("meronyms", net.get_meronyms)):
        part = get(terms, lang="en", sense="n").select("term", F.lit(kind).alias("kind"), F.array_join(kind, "|").alias("related"))
        out = part if out is None else out.unionAll(part)
    return out


@query(f"""WITH {WORDS_SQL}, w AS (SELECT unnest([a, b, c, d]) AS term, unnest([0.1, 0.2, 0.3, 0.4])::DOUBLE AS joy, unnest([0.9, 0.8, 0.7, 0.6])::DOUBLE AS fear, unnest([5, 3, 2, 9]) AS n FROM f), k AS (SELECT DISTINCT term, joy, fear FROM w WHERE n >= 3),
    t AS (SELECT item_id, unnest([a, a, b, c, d, e]) AS term FROM f) SELECT item_id AS doc_id, round(avg(joy), 6) AS joy, round(avg(fear), 6) AS fear FROM t JOIN k USING (term) GROUP BY item_id""")  # fmt: skip
def emotional_valence(spark, sf_dir):
    words, out = words_of(spark, sf_dir), None
    for c, joy, fear, n in (("a", 0.1, 0.9, 5), ("b", 0.2, 0.8, 3), ("c", 0.3, 0.7, 2), ("d", 0.4, 0.6, 9)):
        part = words.select(F.col(c).alias("term"), F.lit(joy).alias("joy"), F.lit(fear).alias("fear"), F.lit(n).alias("freq"))
        out = part if out is None else out.unionAll(part)
    path = scratch(spark)
    out.distinct().write.csv(path, sep="\t", header=True)
    mood = DepecheMood.read(spark, path)
    valence = mood.get_emotional_valence(words.select("item_id", F.array("a", "a", "b", "c", "d", "e").alias("terms")), id_col="item_id")
    return valence.select("doc_id", F.round("joy", 6).alias("joy"), F.round("fear", 6).alias("fear"))


# ---- variations: those that leave no choice give a text, the others what they can't change


def _varied(name: str, transforms: list, sql: str, shown=lambda c: c) -> None:
    def run(spark, sf_dir):
        rows = parsed(spark, sf_dir).withColumn("aug_toks", augment.to_aug_toks("tokens", F.create_map(F.lit("likes"), F.array(F.lit("loves")), F.lit("sleeps"), F.array(F.lit("rests")))))
        out = augment.Augmenter(transforms).apply_transforms(rows, id_col="item_id", seed=3)
        return out.select("item_id", shown(F.col("augmented")).alias("result"))

    query(f"WITH {WORDS_SQL} SELECT item_id, {sql} AS result FROM f", name)(run)


_PLAIN = "{a} {b} likes {c} {d} . {e} was seen by {f} and {g} . {h} is the {i} . \" {j} never sleeps well \" said {k} ."
_LONG_WORDS = "abcdefghijk"
_N_LONG = len(_LONG_WORDS) + len(("likes", "was", "seen", "and", "the", "never", "sleeps", "well", "said"))
_varied("synonyms_substituted", [augment.fixed("substitute_word_synonyms", num=1.0)], as_sql(_PLAIN.replace("likes", "loves").replace("sleeps", "rests")))
_varied("words_deleted", [augment.fixed("delete_words", num=1.0, pos="ADV")], as_sql(_PLAIN.replace("never ", "").replace(" well", "")))
_varied("words_swapped", [augment.fixed("swap_words", num=1.0, pos=("ADJ", "NOUN"))], as_sql(_PLAIN.replace("{a} {b}", "{b} {a}").replace("{c} {d}", "{d} {c}")))
_varied("synonyms_inserted", [augment.fixed("insert_word_synonyms", num=1.0)], f"length({as_sql(_PLAIN)}) + length('loves ') + length('rests ')", F.length)
_varied("characters_substituted", [augment.fixed("substitute_chars", num=1.0)], f"length({as_sql(_PLAIN)})", F.length)
_varied("characters_inserted", [augment.fixed("insert_chars", num=1.0)], f"length({as_sql(_PLAIN)}) + {_N_LONG}", F.length)
_varied("characters_deleted", [augment.fixed("delete_chars", num=1.0)], f"length({as_sql(_PLAIN)}) - {_N_LONG}", F.length)
_varied("characters_swapped", [augment.fixed("swap_chars", num=1.0)], f"array_to_string(list_sort(string_split({as_sql(_PLAIN)}, '')), '')", lambda c: F.array_join(F.array_sort(F.split(c, "")), ""))


@query("SELECT unnest(['none', 'two', 'all', 'each', 'likely']) AS num, unnest([0, 2, 5, 5, 0]) AS n")
def random_selections(spark, sf_dir):
    """How many of five candidates a count or a probability selects."""
    rng, five = Random(1), list("vwxyz")
    cases = (("none", 0), ("two", 2), ("all", 9), ("each", 1.0), ("likely", 0.0))
    return spark.createDataFrame([(k, len(set(augment.select_random(rng, five, n)))) for k, n in cases], "num string, n int")


# ---- similarities, diversity, syllables

_GRAMS = "list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i::INT, 3))"


@query(f"""WITH {WORDS_SQL}, p AS (SELECT item_id, lower(a || b) AS x, lower(a || c) AS y FROM f), g AS (SELECT item_id, unnest({_GRAMS.format('x')}) AS g, 1 AS side FROM p UNION ALL SELECT item_id, unnest({_GRAMS.format('y')}), 2 FROM p),
    c AS (SELECT item_id, g, count(*) FILTER (side = 1) AS m, count(*) FILTER (side = 2) AS n FROM g GROUP BY item_id, g), w AS (SELECT *, ln(3 / (2 + (m > 0 AND n > 0)::INT)) + 1 AS w FROM c)
    SELECT item_id, round(sum(m * n * w * w) / (sqrt(sum(m * m * w * w)) * sqrt(sum(n * n * w * w))), 6) AS character_ngrams, round(any_value(r), 6) AS matching FROM w
    JOIN (SELECT item_id, 2 * (length(a) + length(c)) / (2 * length(a) + length(b) + 2 * length(c) + length(d)) AS r FROM f) USING (item_id) GROUP BY item_id""")  # fmt: skip
def similarity_of_known_sequences(spark, sf_dir):
    """Trigrams of two words, and the blocks that two sequences of letters share around unlike capitals."""
    words = words_of(spark, sf_dir)
    # nothing but a and c is common: b and d stand in letters of their own
    x, y = F.concat("a", F.regexp_replace("b", ".", "1"), "c"), F.concat("a", F.regexp_replace("d", ".", "2"), "c")
    return words.select("item_id", F.round(similarity.character_ngrams(F.concat("a", "b"), F.concat("a", "c")), 6).alias("character_ngrams"), F.round(similarity.matching_subsequences_ratio(x, y, autojunk=False), 6).alias("matching"))


_STEP = "CASE WHEN len(list_distinct(list_append(seen, w[k + 1]))) / (len(seen) + 1) <= 0.72 THEN {0} ELSE {1} END"


def _mtld_sql(order: str) -> str:
    return f"""(SELECT item_id, len(w) / (n + CASE WHEN len(seen) > 0 THEN (1 - len(list_distinct(seen)) / len(seen)) / (1 - 0.72) ELSE 0 END + 1e-6) AS m FROM (
      WITH RECURSIVE r AS (SELECT item_id, {order} AS w, 0 AS k, []::VARCHAR[] AS seen, 0 AS n FROM d
        UNION ALL SELECT item_id, w, k + 1, {_STEP.format('[]::VARCHAR[]', 'list_append(seen, w[k + 1])')}, {_STEP.format('n + 1', 'n')} FROM r WHERE k < len(w)) SELECT * FROM r WHERE k = len(w)))"""


@query(f"WITH d AS (SELECT item_id, regexp_extract_all(lower(text), '{W}') AS w FROM benchmark) SELECT item_id, round((a.m + b.m) / 2, 4) AS mtld FROM {_mtld_sql('w')} a JOIN {_mtld_sql('list_reverse(w)')} b USING (item_id)")
def mtld_of_items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(stats.mtld(tokens.words("text")), 4).alias("mtld"))


#: Breaks between a and n, and between e and r, but for er at a word's end; two letters stay together at either end.
_PATTERNS = ["a1n", "e1r", "e2r."]
_BREAKS = "len(list_filter(range(2, length(x) - 1), lambda i: substr(x, i::INT, 2) IN ('an', 'er') AND NOT (i = length(x) - 1 AND substr(x, i::INT, 2) = 'er')))"


@query(f"SELECT item_id, array_to_string(list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda x: 1 + {_BREAKS}), ' ') AS syllables FROM benchmark")
def hyphenated_syllables(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.transform(stats.hyphenator(_PATTERNS)(words), lambda n: n.cast("string")), " ").alias("syllables"))


_VOWELS = f"greatest(1, len(regexp_extract_all(lower(x), '{stats.VOWELS}')))"


@query(f"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '{W}') AS w FROM documents) SELECT doc_id, md5(array_to_string(list_transform(w, lambda x: length(x)), ' ')) AS lengths, md5(array_to_string(list_transform(w, lambda x: {_VOWELS}), ' ')) AS syllables FROM d""")
def statistics_by_word(spark, sf_dir):
    shown = lambda c: F.md5(F.array_join(F.transform(c, lambda n: n.cast("string")), " "))
    docs = table(spark, sf_dir, "documents").select("doc_id", tokens.words("text").alias("w"))
    return docs.select("doc_id", shown(stats.n_chars_per_word("w")).alias("lengths"), shown(stats.n_syllables_per_word("w")).alias("syllables"))


@query(f"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '{W}') AS w, len(list_filter(regexp_extract_all(text, '{tokens.SENTENCE}'), lambda s: regexp_matches(s, '{W}'))) AS s FROM documents), n AS (SELECT *, len(w)::DOUBLE AS n, len(list_distinct(list_transform(w, lambda x: lower(x))))::DOUBLE AS t FROM d WHERE len(w) > 0 AND s > 0)
    SELECT doc_id, round(n / s + 100.0 * len(list_filter(w, lambda x: length(x) >= 7)) / n, 6) AS lix, round(t / n, 6) AS ttr, round(CASE WHEN t > 1 AND ln(n) / ln(10) > 0 AND n > 1 AND log10(n) <> 1 THEN log10(log10(t)) / log10(log10(n)) ELSE 0 END, 6) AS summer FROM n WHERE n <> 10""")  # fmt: skip
def statistics_by_name(spark, sf_dir):
    """Formulas by their names; documents of ten words, whose Summer's ratio divides by nothing, have none here."""
    docs = stats.text_stats(table(spark, sf_dir, "documents")).where("stats.n_words > 0 AND stats.n_sents > 0 AND stats.n_words <> 10").withColumn("w", tokens.words("text"))
    return docs.select("doc_id", F.round(stats.readability("lix", "stats"), 6).alias("lix"), F.round(stats.diversity("ttr", "w"), 6).alias("ttr"), F.round(stats.diversity("log-ttr", "w", variant="summer"), 6).alias("summer"))


# ---- networks and topics

_COSINE = f"""b AS (SELECT item_id::VARCHAR AS i, list_distinct(regexp_extract_all(lower(text), '{W}')) AS w FROM benchmark), p AS (SELECT x.i AS s, y.i AS d, len(list_intersect(x.w, y.w)) / sqrt(len(x.w) * len(y.w)) AS w FROM b x JOIN b y ON x.i < y.i),
    e AS MATERIALIZED (SELECT s, d, w FROM p WHERE w > 0 UNION ALL SELECT d, s, w FROM p WHERE w > 0), o AS MATERIALIZED (SELECT s, sum(w) AS t FROM e GROUP BY s), n AS (SELECT count(*) AS n FROM o), h AS MATERIALIZED (SELECT e.s, e.d, w / t AS w FROM e JOIN o USING (s))"""


@query(f"""WITH RECURSIVE {_COSINE}, r AS (SELECT 0 AS k, s AS node, 1 / n::DOUBLE AS x FROM o, n UNION ALL SELECT k + 1, h.d, 0.85 * sum(h.w * r.x) + 0.15 / any_value(n.n) FROM r JOIN h ON h.s = r.node, n WHERE k < 100 GROUP BY k, h.d) SELECT node, round(x, 8) AS score FROM r WHERE k = 100""")
def pagerank_of_items(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("item"), tokens.lower_words("text").alias("w"))
    edges = network.build_similarity_network(items, "cosine", id_col="item", value_col="w").where("weight > 0")
    return network.rank_nodes_by_pagerank(edges, tol=1e-13, max_iter=1000).withColumn("score", F.round("score", 8))


@query("SELECT CASE WHEN r_regionkey = 0 THEN 'n0' ELSE 'r' || r_regionkey END AS node, round((r_regionkey + 2) / 20, 4) AS score FROM region")
def bestcoverage_of_stars(spark, sf_dir):
    """Region r and r + 1 of its nations: a star covers its share of all nodes, and of a pair the first node is taken."""
    nations = table(spark, sf_dir, "nation").where("n_nationkey % 5 = n_regionkey AND n_nationkey < 5 * (n_regionkey + 1)")
    edges = nations.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"), F.lit(1.0).alias("weight"))
    return network.rank_nodes_by_bestcoverage(edges, 5).withColumn("score", F.round("score", 4))


@query("SELECT 'n' || n_nationkey AS node, 0.04::DOUBLE AS score FROM nation")
def divrank_of_a_ring(spark, sf_dir):
    """Where a walk always starts anew, all nodes have the same rank."""
    key = F.col("n_nationkey")
    edges = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), key.cast("string")).alias("src"), F.concat(F.lit("n"), ((key + 1) % 25).cast("string")).alias("dst"), F.lit(1.0).alias("weight"))
    return network.rank_nodes_by_divrank(edges, lambda_=1.0).withColumn("score", F.round("score", 6))


_TF = f"tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{W}')) AS term FROM documents) GROUP BY ALL), v AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, count(*) AS df FROM tf GROUP BY term)"
#: A model of four topics, to which terms belong by turns of their ids, with the weight of their topic.
_TOPICS = "m AS (SELECT doc_id, topic, (topic + 1) * n::DOUBLE AS weight FROM (SELECT doc_id, (term_id % 4)::INT AS topic, sum(tf) AS n FROM tf JOIN v USING (term) GROUP BY ALL)), w AS (SELECT d.doc_id, t.topic, coalesce(m.weight, 0) AS weight FROM (SELECT DISTINCT doc_id FROM tf) d CROSS JOIN (SELECT unnest([0, 1, 2, 3])::INT AS topic) t LEFT JOIN m USING (doc_id, topic)), s AS (SELECT doc_id, topic, weight, weight / sum(weight) OVER (PARTITION BY doc_id) AS share FROM w)"


def _topics(spark, sf_dir):
    """The model, saved and loaded, the matrix of all documents, and its vocabulary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", tokens.lower_words("text").alias("terms"))
    fitted, matrix = vectorize.Vectorizer().fit_transform(docs)
    n = fitted.vocabulary.count()
    h = np.zeros((4, n))
    h[np.arange(n) % 4, np.arange(n)] = np.arange(n) % 4 + 1.0
    path = scratch(spark)
    topics.TopicModel("lsa", 4, components=h).save(path, spark=spark)
    return topics.TopicModel.load(path, spark=spark), matrix, fitted.vocabulary


@query(f"WITH {_TF}, {_TOPICS} SELECT doc_id, topic, round(share, 6) AS weight FROM s")
def document_topics(spark, sf_dir):
    model, matrix, _ = _topics(spark, sf_dir)
    return model.get_doc_topic_matrix(matrix).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_TF}, {_TOPICS} SELECT 'raw' AS kind, doc_id, topic, rank::INT AS rank, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, doc_id) AS rank FROM w) WHERE rank <= 5 UNION ALL SELECT 'share', doc_id, topic, rank::INT, round(share, 6) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, topic) AS rank FROM s) WHERE rank <= 2")
def top_documents_and_topics(spark, sf_dir):
    model, matrix, _ = _topics(spark, sf_dir)
    docs = topics.top_topic_docs(model.transform(matrix), top_n=5).select(F.lit("raw").alias("kind"), "doc_id", "topic", "rank", F.round("weight", 6).alias("weight"))
    own = topics.top_doc_topics(model.get_doc_topic_matrix(matrix), top_n=2).select(F.lit("share").alias("kind"), "doc_id", "topic", "rank", F.round("weight", 6).alias("weight"))
    return docs.unionByName(own)


@query(f"WITH {_TF}, {_TOPICS} SELECT topic, round(sum(weight) / (SELECT sum(weight) FROM w), 6) AS weight FROM w GROUP BY topic")
def weights_of_topics(spark, sf_dir):
    model, matrix, _ = _topics(spark, sf_dir)
    return topics.topic_weights(model.transform(matrix)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_TF} SELECT (term_id % 4)::INT AS topic, rank::INT AS rank, term, weight FROM (SELECT term, term_id, (term_id % 4 + 1)::DOUBLE AS weight, row_number() OVER (PARTITION BY term_id % 4 ORDER BY term) AS rank FROM v) WHERE rank <= 7")
def top_terms_of_topics(spark, sf_dir):
    model, _, vocabulary = _topics(spark, sf_dir)
    return model.top_topic_terms(vocabulary, top_n=7)


@query(f"WITH {_TF} SELECT term, w[1] AS t0, w[2] AS t1, w[3] AS t2, w[4] AS t3 FROM (SELECT term, list_transform([0, 1, 2, 3], lambda t: CASE WHEN term_id % 4 = t THEN (t + 1)::DOUBLE ELSE 0.0 END) AS w FROM v WHERE term_id % 4 = 3 ORDER BY term LIMIT 6)")
def termite_table(spark, sf_dir):
    """The heaviest terms are those of the last topic."""
    model, _, vocabulary = _topics(spark, sf_dir)
    # ids are in the order of the terms and stand for them; six get their names
    found = topics.termite_df(model.components, np.arange(model.components.shape[1]), n_terms=6, sort_terms_by="alphabetical")
    rows = spark.createDataFrame([(int(i), *map(float, row)) for i, row in zip(found.index, found.to_numpy())], "term_id int, t0 double, t1 double, t2 double, t3 double")
    return vocabulary.join(F.broadcast(rows), "term_id").select("term", "t0", "t1", "t2", "t3")  # six rows


@query("SELECT 'T' || n_regionkey AS term, (4 - n_regionkey)::INT AS topic, round(sqrt(sum(CASE WHEN n_regionkey >= 0 THEN (n_regionkey + 1) * (n_regionkey + 1) END)), 4) AS singular FROM nation GROUP BY n_regionkey")
def lsa_of_separate_terms(spark, sf_dir):
    """Documents of one term each: every topic is a term, and the heaviest term is the first topic."""
    cells = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_regionkey").alias("term_id"), (F.col("n_regionkey") + 1.0).alias("weight"))
    model = topics.TopicModel("lsa", 5).fit(cells, 5)
    projected = model.transform(cells).groupBy("topic").agg(F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 4).alias("singular"))
    terms = spark.createDataFrame([(f"T{int(np.abs(row).argmax())}", k) for k, row in enumerate(model.components)], "term string, topic int")
    return terms.join(projected, "topic").select("term", "topic", "singular")


# ---- matrices by their own functions


def _terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", tokens.lower_words("text").alias("terms"))


@query(f"""WITH {_TF}, n AS (SELECT count(*)::DOUBLE AS n FROM documents), x AS (SELECT doc_id, term, term_id::INT AS term_id, tf::INT AS tf, tf * (ln((n + 1) / (df + 1)) + 1) AS w FROM tf JOIN v USING (term), n)
    SELECT doc_id, term, term_id, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight, 'tf * (log((n_docs + 1) / (df + 1)) + 1)' AS weighting FROM x""")  # fmt: skip
def fitted_then_transformed(spark, sf_dir):
    fitted = vectorize.Vectorizer(idf_type="smooth", norm="l2").fit(_terms(spark, sf_dir))
    return fitted.transform(_terms(spark, sf_dir)).withColumn("weight", F.round("weight", 6)).withColumn("weighting", F.lit(fitted.weighting))


@query(f"WITH {_TF}, k AS (SELECT unnest(['der', 'the', 'zz']) AS term, unnest([0, 1, 2]) AS term_id) SELECT doc_id, term, k.term_id::INT AS term_id, tf::INT AS tf FROM tf JOIN k USING (term)")
def fixed_vocabulary(spark, sf_dir):
    ids = vectorize.validate_vocabulary(["the", "zz", "der"])
    if ids != {"der": 0, "the": 1, "zz": 2}:
        raise RuntimeError("a fixed vocabulary is numbered in its order")
    _, out = vectorize.Vectorizer(vocabulary_terms=("the", "zz", "der")).fit_transform(_terms(spark, sf_dir))
    return out.select("doc_id", "term", "term_id", "tf")


@query(f"""WITH {_TF}, g AS (SELECT lang, term, count(*) AS tf FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '{W}')) AS term FROM documents) GROUP BY ALL), l AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS i FROM (SELECT DISTINCT lang FROM documents))
    SELECT 'doc' AS kind, doc_id::INT AS row, term_id::INT AS col, round(sqrt(tf), 6) AS weight FROM tf JOIN v USING (term) UNION ALL SELECT 'grp', i::INT, term_id::INT, tf::DOUBLE FROM g JOIN v USING (term) JOIN l USING (lang)""")  # fmt: skip
def built_matrices(spark, sf_dir):
    docs, _ = vectorize.build_doc_term_matrix(_terms(spark, sf_dir), tf_type="sqrt")
    grps, _, groups = vectorize.build_grp_term_matrix(_terms(spark, sf_dir), grp_col="lang")
    left = docs.select(F.lit("doc").alias("kind"), F.col("doc_id").cast("int").alias("row"), F.col("term_id").alias("col"), F.round("weight", 6).alias("weight"))
    return left.unionByName(grps.join(groups, "grp").select(F.lit("grp").alias("kind"), F.col("grp_id").alias("row"), F.col("term_id").alias("col"), F.col("weight").cast("double").alias("weight")))


@query(f"WITH {_TF} SELECT doc_id, term, round(tf * (ln((SELECT count(*) FROM documents) / df) + 1), 6) AS weight FROM tf JOIN v USING (term)")
def idf_weighted(spark, sf_dir):
    tf = vectorize.count_terms(_terms(spark, sf_dir))
    found = vectorize.apply_idf_weighting(tf, type_="standard", n_docs=table(spark, sf_dir, "documents").count())
    return found.select("doc_id", "term", F.round("weight", 6).alias("weight"))


# ---- checks of arguments, extensions


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{W}'))::INT AS n_words, (len(regexp_extract_all(text, '{W}')) > 0) AS has_entropy FROM documents")
def registered_extensions(spark, sf_dir):
    utils.set_doc_extensions("text_stats")
    try:
        df = table(spark, sf_dir, "documents").select("doc_id", tokens.words("text").alias("w"))
        out = utils.extend(utils.extend(df, "n_words", "w"), "entropy", "w")
        if set(utils.get_doc_extensions("text_stats")) < {"n_words", "entropy"}:
            raise RuntimeError("extensions are known by name")
    finally:
        utils.remove_doc_extensions("text_stats")
    return out.select("doc_id", "n_words", ((F.col("entropy") > 0) | ((F.col("entropy") == 0) & (F.col("n_words") > 0))).alias("has_entropy"))


@query("SELECT unnest(['one', 'several', 'none', 'record', 'no record', 'arguments', 'size', 'cached']) AS what, unnest(['[1]', '[1, 2]', 'None', 'True', 'False', '[''b'']', 'True', 'False']) AS value")
def checks_of_arguments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    record = docs.select("text", F.struct("lang").alias("meta"))
    regions = table(spark, sf_dir, "region").cache()
    sized = utils.get_size(docs) > utils.get_size(regions) > 0
    utils.clear_cache(spark)
    rows = {
        "one": utils.to_collection(1, int, list), "several": sorted(utils.to_collection((2, 1), int, set)), "none": utils.to_collection(None, int, list), "record": utils.is_record(record.schema), "no record": utils.is_record(docs.schema),
        "arguments": list(utils.get_kwargs_for_func(lambda a, b: 0, {"b": 1, "c": 2})), "size": sized, "cached": bool(regions.storageLevel.useMemory),
    }
    return spark.createDataFrame([(k, str(v)) for k, v in rows.items()], "what string, value string")
