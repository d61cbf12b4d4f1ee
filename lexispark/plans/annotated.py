"""Extraction from annotated tokens: lexical ones of all documents, and the parsed sentences of all benchmark items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.functions import stats, tokens
from lexispark.functions.stopwords import STOP_WORDS
from lexispark.operators import corpus, extract, keyterms, triples
from lexispark.plans.fixtures import PARSE, TEMPLATE, WORDS_SQL, as_sql, filled, parsed, rows_sql, words_of
from lexispark.plans.registry import query, table

_quoted = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words))
_STOP = "CASE lang " + " ".join(f"WHEN '{k}' THEN lower(t) IN ({_quoted(v)})" for k, v in sorted(STOP_WORDS.items()) if v) + " ELSE false END"
#: The tokens of every document with what the lexical layer says of them, and the place of each in its text.
TOKENS_SQL = f"""raw AS (SELECT doc_id, lang, regexp_extract_all(text, '{tokens.TOKEN}') AS m, regexp_split_to_array(text, '{tokens.TOKEN}') AS g FROM documents WHERE text IS NOT NULL),
    cut AS (SELECT doc_id, lang, len(m) AS n_tokens, unnest(range(len(m))) AS i, unnest(m) AS t, unnest(g[2:len(m) + 1]) AS ws, unnest(g[1:len(m)]) AS gap FROM raw),
    tok AS (SELECT *, lower(t) AS l, NOT regexp_matches(t, '^[\\p{{L}}\\p{{N}}]') AS punct, {_STOP} AS stop, regexp_full_match(t, '\\p{{Nd}}+') AS num,
      sum(length(gap) + length(t)) OVER (PARTITION BY doc_id ORDER BY i) - length(t) AS idx FROM cut)"""
_WORD = "NOT punct AND NOT stop"


def _annotated(spark, sf_dir):
    return tokens.annotate(table(spark, sf_dir, "documents"), lang_col="lang")


@query(f"""WITH {TOKENS_SQL}, k AS (SELECT doc_id, count(*) FILTER ({_WORD}) AS n_words, count(*) AS n_tokens FROM tok GROUP BY doc_id),
    q AS (SELECT doc_id, sum(c)::BIGINT AS n FROM (SELECT doc_id, l, count(*) AS c FROM tok WHERE {_WORD} AND NOT num GROUP BY ALL) WHERE c >= 2 GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_tokens, 0)::INT AS n_tokens, coalesce(n_words, 0)::INT AS n_words, coalesce(q.n, 0)::INT AS n_frequent FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN q USING (doc_id)""")  # fmt: skip
def annotated_words(spark, sf_dir):
    return _annotated(spark, sf_dir).select("doc_id", F.size("tokens").alias("n_tokens"), F.size(extract.words("tokens")).alias("n_words"), F.size(extract.words("tokens", filter_nums=True, min_freq=2)).alias("n_frequent"))


@query(f"""WITH {TOKENS_SQL}, p AS (SELECT l || ws || lead(l) OVER d AS lower, NOT stop AND NOT punct AND NOT lead(stop OR punct) OVER d AS ok FROM tok WINDOW d AS (PARTITION BY doc_id ORDER BY i))
    SELECT lower, count(*) AS n FROM p WHERE ok GROUP BY lower""")  # fmt: skip
def annotated_ngrams(spark, sf_dir):
    grams = _annotated(spark, sf_dir).select("doc_id", F.explode(extract.ngrams("tokens", 2)).alias("g"))
    return grams.groupBy("g.lower").agg(F.count("*").alias("n"))


@query(f"""WITH {TOKENS_SQL}, p AS (SELECT doc_id, n_tokens, l, ws, lead(l) OVER d AS l2, NOT stop AND NOT punct AS ok, NOT lead(stop OR punct) OVER d AS ok2 FROM tok WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    terms AS (SELECT doc_id, n_tokens, l AS term FROM p WHERE ok UNION ALL SELECT doc_id, n_tokens, l || ws || l2 FROM p WHERE ok AND ok2)
    SELECT doc_id, term, round(count(*) / any_value(n_tokens), 9) AS freq FROM terms GROUP BY doc_id, term""")  # fmt: skip
def bags_of_terms(spark, sf_dir):
    bag = extract.to_bag_of_terms("tokens", by="lower", ngs=(1, 2), weighting="freq")
    return _annotated(spark, sf_dir).select("doc_id", F.explode(bag).alias("term", "freq")).withColumn("freq", F.round("freq", 9))


@query(f"WITH {TOKENS_SQL} SELECT doc_id, l AS term, round(count(*) / any_value(n_tokens), 9) AS weight FROM tok WHERE {_WORD} GROUP BY doc_id, l")
def bag_of_words(spark, sf_dir):
    bag = extract.to_bag_of_words("tokens", by="lower", weighting="freq")
    return _annotated(spark, sf_dir).select("doc_id", F.explode(bag).alias("term", "weight")).withColumn("weight", F.round("weight", 9))


@query(f"""WITH {TOKENS_SQL}, n AS (SELECT doc_id, i, l, punct, num, coalesce(min(CASE WHEN NOT punct THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n_tokens) AS rest FROM tok),
    ends AS (SELECT doc_id, i, unnest(range(i + 1, rest + 1)) AS e FROM n WHERE l = 'license'),
    more AS (SELECT doc_id, i, e FROM ends UNION SELECT ends.doc_id, ends.i, e + 1 FROM ends JOIN tok ON tok.doc_id = ends.doc_id AND tok.i = e WHERE num)
    SELECT doc_id, i::INT AS start, e::INT AS "end" FROM more""")  # fmt: skip
def token_matches(spark, sf_dir):
    found = extract.token_matches("tokens", "LOWER:license IS_PUNCT:bool(True):* LIKE_NUM:bool(True):?")
    return _annotated(spark, sf_dir).select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.start", "m.end")


@query(f"""WITH {TOKENS_SQL}, parts AS (SELECT doc_id, regexp_extract_all(text, '[Ll]icensed under [\\p{{L}}\\p{{N}}_]+') AS m, regexp_split_to_array(text, '[Ll]icensed under [\\p{{L}}\\p{{N}}_]+') AS g FROM documents),
    hits AS (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS k FROM parts),
    placed AS (SELECT doc_id, length(m[k]) AS n, list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS a FROM hits)
    SELECT p.doc_id, min(i)::INT AS start, (max(i) + 1)::INT AS "end" FROM placed p JOIN tok ON tok.doc_id = p.doc_id AND idx < a + n AND idx + length(t) > a GROUP BY p.doc_id, a""")  # fmt: skip
def regex_matches(spark, sf_dir):
    found = extract.regex_matches("text", "tokens", r"[Ll]icensed under \w+", alignment_mode="expand")
    return _annotated(spark, sf_dir).select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.start", "m.end")


_ACRO = "(length(t) <> 2 OR regexp_matches(t, '\\p{Lu}') AND NOT regexp_matches(t, '\\p{Ll}')) AND len(regexp_extract_all(t, '[\\p{L}\\p{N}]')) BETWEEN 2 AND 10 AND NOT regexp_matches(t, '^\\p{Nd}+$') AND (regexp_matches(t, '\\p{Lu}') OR regexp_matches(t, '^\\p{Nd}|\\p{Nd}$'))"


@query(f"WITH {TOKENS_SQL} SELECT doc_id, t AS acronym, count(*) AS n FROM tok WHERE {_ACRO} AND regexp_matches(t, '{extract.SHAPE}') GROUP BY doc_id, t")
def acronym_tokens(spark, sf_dir):
    return _annotated(spark, sf_dir).select("doc_id", F.explode(extract.acronyms("tokens")).alias("t")).groupBy("doc_id", F.col("t.text").alias("acronym")).agg(F.count("*").alias("n"))


@query(f"""WITH {WORDS_SQL}, g AS (SELECT *, upper(a[1]) || a[2:] AS x, upper(b[1]) || b[2:] AS y, upper(c[1]) || c[2:] AS z FROM f)
    SELECT item_id, x[1] || y[1] || z[1] AS acronym, x || ' ' || y || ' ' || z AS definition FROM g""")  # fmt: skip
def acronym_definitions(spark, sf_dir):
    up = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1000))
    short = F.upper(F.concat(*[F.substring(x, 1, 1) for x in "abc"]))
    text = F.concat(up("a"), F.lit(" "), up("b"), F.lit(" "), up("c"), F.lit(" ( "), short, F.lit(" ) "), F.col("d"), F.lit(" "), F.col("e"), F.lit("."))
    rows = tokens.annotate(words_of(spark, sf_dir).select("item_id", text.alias("text")))
    return rows.select("item_id", F.explode(extract.acronyms_and_definitions("tokens")).alias("acronym", "definition"))


# ---- of the parsed sentences


def _exploded(c: Callable[[], Column], *fields: str):
    """(item_id, fields...) of the array of structs that ``c`` makes, over the parsed sentences."""

    def run(spark, sf_dir):
        rows = parsed(spark, sf_dir).select("item_id", F.explode(c()).alias("x"))
        kinds = dict(rows.select("x.*").dtypes)
        return rows.select("item_id", *[(F.array_join(f"x.{f}", " ") if kinds[f].startswith("array") else F.col(f"x.{f}")).alias(f) for f in fields])

    return run


def _texts(c: Callable[[], Column], label: bool = False):
    return _exploded(c, "text", *(["label"] if label else []))


query(rows_sql("subject, verb, object", ("{a} {b}", "likes", "{d}"), ("{e}", "was seen", "{f} {g}")), "subject_verb_object_triples")(_exploded(lambda: triples.subject_verb_object_triples("tokens"), "subject", "verb", "object"))
query(rows_sql("entity, cue, fragment", ("{h}", "is", "the {i}")), "semistructured_statements")(_exploded(lambda: triples.semistructured_statements("tokens", entity=r"\w+qh\b", cue="be"), "entity", "cue", "fragment"))
query(rows_sql("speaker, cue, content", ("{k}", "said", '" {j} never sleeps well "')), "direct_quotations")(_exploded(lambda: triples.direct_quotations("tokens"), "speaker", "cue", "content"))
query(rows_sql("text, label", ("{a} {b}", "ORG"), ("{d}", "DATE"), ("{i}", "GPE")), "entities")(_texts(lambda: extract.entities("tokens"), True))
query(rows_sql("text, label", ("{d}", "DATE")), "numeric_entities")(_texts(lambda: extract.entities("tokens", include_types="NUMERIC"), True))
query(rows_sql("text", *[(x,) for x in ("{a} {b}", "{c} {d}", "{e}", "{f}", "{g}", "{h}", "{i}", "{j}", "{k}")]), "noun_chunks")(_texts(lambda: extract.noun_chunks("tokens")))
query(rows_sql("text", *[(x,) for x in ("{a} {b}", "{c} {d}", "{d}", "{i}", "{e}", "{f}", "{g}", "{h}", "{j}", "{k}")]), "terms_of_three_kinds")(
    _texts(lambda: extract.terms("tokens", ngs=lambda t: extract.ngrams(t, 2, include_pos=("NOUN", "ADJ", "PROPN")), ents=True, ncs=True))
)
query(rows_sql("text", *[(f"{{{x}}}",) for x in "abcdefghijk"], ("{a} {b}",), ("{c} {d}",)), "ngram_candidates")(_texts(lambda: extract.get_ngram_candidates("tokens", (1, 2))))
query(rows_sql("text", ("{a} {b}",), ("likes",), ("seen",), ("sleeps",), ("said",)), "pattern_candidates")(_texts(lambda: extract.get_pattern_matching_candidates("tokens", ["POS:NOUN POS:NOUN", "POS:VERB"])))


@query(rows_sql("text", *[(x,) for x in ("{a} {b}", "{c} {d}", "{e}", "{f}", "{g}", "{h}", "{i}", "{j}", "{k}")]))
def longest_subsequence_candidates(spark, sf_dir):
    runs = extract.get_longest_subsequence_candidates("tokens", lambda t: t["pos"].isin("NOUN", "PROPN", "ADJ"))
    return parsed(spark, sf_dir).select("item_id", F.explode(runs).alias("r")).select("item_id", F.array_join(F.transform("r", lambda t: t["text"]), " ").alias("text"))


@query(rows_sql("verb, subjects, objects, first, last", ("likes", "{b}", "{d}", "likes", "likes"), ("seen", "{e}", "", "was", "seen"), ("sleeps", "{j}", "", "never", "sleeps"), ("said", "", "", "said", "said")))
def verbs_and_their_arguments(spark, sf_dir):
    text = lambda i: F.get("tokens", i)["text"]
    names = lambda places: F.array_join(F.transform(places, text), " ")
    made = parsed(spark, sf_dir).select(
        "item_id", "tokens", tokens.main_verbs("tokens").alias("v"), triples.subjects_of_verbs("tokens").alias("s"), triples.objects_of_verbs("tokens").alias("o"), triples.auxiliary_spans("tokens").alias("a")
    )
    each = made.select("item_id", "tokens", F.explode(F.arrays_zip("v", "s", "o", "a")).alias("x"))
    return each.select("item_id", F.col("x.v.text").alias("verb"), names(F.col("x.s")).alias("subjects"), names(F.col("x.o")).alias("objects"), text(F.col("x.a.start")).alias("first"), text(F.col("x.a.end")).alias("last"))


@query(rows_sql("noun, first", *[(f"{{{x}}}", "{a}" if x == "b" else f"{{{x}}}") for x in "abdefghijk"]))
def compound_nouns(spark, sf_dir):
    spans = parsed(spark, sf_dir).select("item_id", "tokens", F.explode(triples.compound_spans("tokens")).alias("s"))
    return spans.select("item_id", F.get("tokens", F.col("s.end"))["text"].alias("noun"), F.get("tokens", F.col("s.start"))["text"].alias("first"))


def _counted(values) -> str:
    found = list(values)
    return " ".join(f"{v}:{found.count(v)}" for v in sorted(set(found)))


@query(rows_sql("pos, tag, dep, morph", (_counted(x[1] for x in PARSE), _counted(x[1][:2] for x in PARSE), _counted(x[2] for x in PARSE), "Number=Sing:10 Tense=Past:3")))
def annotation_counts(spark, sf_dir):
    shown = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), " ")
    morph = F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(k, F.lit("="), shown(F.col("m")[k])))
    made = parsed(spark, sf_dir).withColumn("m", stats.morph_counts("tokens"))
    return made.select("item_id", *[shown(stats.value_counts("tokens", a)).alias(a) for a in ("pos", "tag", "dep")], F.array_join(morph, " ").alias("morph"))


@query("SELECT unnest(['Number', 'Tense']) AS label")
def morphological_labels(spark, sf_dir):
    return tokens.morph_labels(parsed(spark, sf_dir))


@query(rows_sql("text, normal, kept", *[(x[0], x[4] or x[0], x[1] == "PROPN") for x in PARSE]))
def normalized_tokens(spark, sf_dir):
    return parsed(spark, sf_dir).select("item_id", F.explode("tokens").alias("t")).select("item_id", "t.text", tokens.normalized_text(F.col("t")).alias("normal"), tokens.preserve_case(F.col("t")).alias("kept"))


_MERGED = ["{a} {b}", "likes", "{c} {d}", *[x[0] for x in PARSE[5:]]]


@query(rows_sql("i, text", *[(i, x) for i, x in enumerate(_MERGED)]))
def merged_spans(spark, sf_dir):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((3, 5), (0, 2), (1, 2))])
    merged = parsed(spark, sf_dir).select("item_id", tokens.merge_spans("tokens", spans).alias("m"))
    return merged.select("item_id", F.explode("m").alias("t")).select("item_id", "t.i", "t.text")


@query(f"""WITH {WORDS_SQL}, s AS (SELECT item_id, {as_sql(TEMPLATE)} AS text FROM f)
    SELECT item_id, 'Doc({len(PARSE)} tokens: "' || text[1:47] || '...")' AS preview, {len(PARSE)} AS n_tokens FROM s""")  # fmt: skip
def previews_of_chunked_texts(spark, sf_dir):
    """A piece as long as any text leaves it whole."""
    texts = filled(words_of(spark, sf_dir), TEMPLATE).select("item_id", "text")
    whole = tokens.annotate(texts)
    chunked = tokens.annotate(texts, chunk_size=100_000).select("item_id", F.size("tokens").alias("n_tokens"))
    return whole.select("item_id", tokens.doc_preview("tokens").alias("preview")).join(chunked, "item_id")


@query("""SELECT doc_id, (len(regexp_extract_all(text[1:80], '{0}')) + len(regexp_extract_all(text[81:160], '{0}')))::INT AS n_tokens, lang AS author, n_chars AS pages FROM documents""".format(tokens.TOKEN))
def chunked_documents_with_metadata(spark, sf_dir):
    """The first 160 characters in pieces of 80; the metadata set and read again."""
    docs = table(spark, sf_dir, "documents").withColumn("head", F.substring("text", 1, 160))
    made = tokens.annotate(docs, text_col="head", lang_col="lang", chunk_size=80)
    with_meta = corpus.set_doc_meta(made, F.struct(F.col("lang").alias("author"), F.col("n_chars").alias("pages")))
    return corpus.get_doc_meta(with_meta.select("doc_id", "tokens", "meta"), "doc_id", F.size("tokens").alias("n_tokens"))


@query(f"WITH {TOKENS_SQL} SELECT doc_id, count(*) FILTER (punct) AS n_punct, count(*) FILTER (stop) AS n_stop FROM tok GROUP BY doc_id")
def tokens_by_resolved_language(spark, sf_dir):
    """The language as a function of the text, here by a lookup of the documents' own."""
    named = tokens.annotate(table(spark, sf_dir, "documents"), lang=lambda text: F.when(text.isNotNull(), F.col("lang")))
    count = lambda name: F.size(F.filter("tokens", lambda t: t[name])).cast("long")
    return named.where(F.size("tokens") > 0).select("doc_id", count("is_punct").alias("n_punct"), count("is_stop").alias("n_stop"))


# ---- strings of terms


_DIRTY = (("( {a} {b}", "{a} {b}"), ("{c} - {d}.", "{c} - {d}."), ("-- {e}", "{e}"), ("{f}- {g}", "{f}-{g}"), ("{h}  's", "{h}'s"), ("{i} ,{j}", "{i}, {j}"), ("...", None))


@query(f"WITH {WORDS_SQL} SELECT item_id, " + " || '|' || ".join(f"({as_sql(x)})" for _, x in _DIRTY if x) + " AS cleaned FROM f")
def clean_term_strings(spark, sf_dir):
    words = words_of(spark, sf_dir)
    for k, (dirty, _) in enumerate(_DIRTY):
        words = filled(words, dirty, f"t{k}")
    return words.select("item_id", F.array_join(extract.clean_term_strings(F.array(*[f"t{k}" for k in range(len(_DIRTY))])), "|").alias("cleaned"))


@query(f"""WITH {WORDS_SQL}, p AS (SELECT item_id, c || ' of ' || d AS x, d || ' ' || c AS y, a || ' ' || b || '|' || a || '-' || b AS z FROM f)
    SELECT item_id, z AS variants FROM p UNION ALL SELECT item_id, least(x, y) || '|' || greatest(x, y) FROM p""")  # fmt: skip
def term_variants(spark, sf_dir):
    """A hyphen as a blank, ``x of y`` as ``y x``; each group in order."""
    words = words_of(spark, sf_dir)
    names = ("{a}-{b}", "{a} {b}", "{c} of {d}", "{d} {c}")
    for k, x in enumerate(names):
        words = filled(words, x, f"t{k}")
    groups = extract.aggregate_term_variants(F.array(*[f"t{k}" for k in range(len(names))]), fuzzy_dedupe=False)
    return words.select("item_id", F.explode(groups).alias("g")).select("item_id", F.array_join("g", "|").alias("variants"))


@query(rows_sql("term, score", ("{a} {b}", 4.0), ("{c}", 2.0), ("{d} {e}", 1.0)))
def filtered_topn_terms(spark, sf_dir):
    words = words_of(spark, sf_dir)
    ranked = (("{a} {b}", 4.0), ("{b}", 3.0), ("{c}", 2.0), ("{b} {a}", 1.5), ("{d} {e}", 1.0), ("{f}", 0.5))
    for k, (x, _) in enumerate(ranked):
        words = filled(words, x, f"t{k}")
    given = F.array(*[F.struct(F.col(f"t{k}").alias("term"), F.lit(s).alias("score")) for k, (_, s) in enumerate(ranked)])
    top = extract.get_filtered_topn_terms(given, 3, match_threshold=0.8)
    return words.select("item_id", F.explode(top).alias("x")).select("item_id", "x.term", "x.score")


# ---- key terms of all documents, and of texts whose scores are known


def _keyterms(method: str):
    def run(spark, sf_dir):
        ranked = keyterms.extract_keyterms("tokens", method, normalize="lower", include_pos=None)
        return _annotated(spark, sf_dir).select("doc_id", F.posexplode(ranked).alias("rank", "t")).select("doc_id", "rank", "t.term", "t.score")

    query(name=f"keyterms_{method}")(run)


for _m in keyterms.METHODS:
    _keyterms(_m)
