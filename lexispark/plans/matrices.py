"""Matrices of documents or groups and terms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexispark import shared
from lexispark.functions.tokens import lower_words
from lexispark.operators import topics, vectorize
from lexispark.plans.registry import query, table
from lexispark.plans.texts import W

_TF = f"tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{W}')) AS term FROM documents) GROUP BY ALL)"
_DF = "df AS (SELECT term, count(*) AS df, sum(tf) AS n FROM tf GROUP BY term)"
_N = "(SELECT count(*) FROM documents)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", lower_words("text").alias("terms"))


@query(f"""WITH {_TF}, {_DF}, langs AS (SELECT doc_id, lang FROM documents),
    w AS (SELECT lang, term, sum(tf * (ln(({_N} + 1) / (df + 1)) + 1)) AS weight FROM tf JOIN df USING (term) JOIN langs USING (doc_id) GROUP BY lang, term)
    SELECT lang, rank, term, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(weight, 6) DESC, term) AS rank FROM w) WHERE rank <= 20""")  # fmt: skip
def tfidf_top_terms(spark, sf_dir):
    """The twenty terms of most tf-idf weight in each language."""
    docs = _docs(spark, sf_dir)
    counted = docs.select("doc_id", "lang", F.explode("terms").alias("term")).groupBy("lang", "term", "doc_id").agg(F.count("*").alias("tf"))
    by_lang = counted.groupBy("lang", "term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
    # a term's documents in all languages, by a window over the few rows it has
    total = F.sum("df").over(Window.partitionBy("term"))
    n = table(spark, sf_dir, "documents").agg((F.count("*") + 1.0).alias("n1"))
    weighted = by_lang.withColumn("total", total).crossJoin(F.broadcast(n)).select("lang", "term", F.round(F.col("tf") * (F.log(F.col("n1") / (F.col("total") + 1)) + 1), 6).alias("weight"))  # one row
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("weight"), "term"))
    return weighted.withColumn("rank", rank.cast("long")).where("rank <= 20").select("lang", "rank", "term", "weight")


def _matrix(name: str, options: dict, weight: str):
    """The weighted document-term matrix under some options, and the same weights in SQL."""

    def run(spark, sf_dir):
        _, out = vectorize.Vectorizer(**options).fit_transform(_docs(spark, sf_dir))
        return out.select("doc_id", "term", "term_id", "tf", F.round("weight", 6).alias("weight"))

    norm = {"l1": "sum(abs(w)) OVER d", "l2": "sqrt(sum(w * w) OVER d)", None: "1"}[options.get("norm")]
    sql = f"""WITH {_TF}, {_DF}, v AS (SELECT *, row_number() OVER (ORDER BY term) - 1 AS term_id FROM df), dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id), a AS (SELECT sum(tf) / {_N} AS mean FROM tf),
        x AS (SELECT doc_id, term, term_id, tf, {weight} AS w FROM tf JOIN v USING (term) JOIN dl USING (doc_id), a)
        SELECT doc_id, term, term_id::INT AS term_id, tf::INT AS tf, round(w / {norm}, 6) AS weight FROM x WINDOW d AS (PARTITION BY doc_id)"""
    query(sql, name)(run)


_SMOOTH, _STANDARD, _BM = f"(ln(({_N} + 1) / (df + 1)) + 1)", f"(ln({_N} / df) + 1)", f"ln(({_N} - df + 0.5) / (df + 0.5))"
_matrix("doc_term_matrix", {}, "tf")
_matrix("doc_term_tfidf_l2", {"idf_type": "smooth", "norm": "l2"}, f"tf * {_SMOOTH}")
_matrix("doc_term_sqrt_l1", {"tf_type": "sqrt", "idf_type": "standard", "norm": "l1"}, f"sqrt(tf) * {_STANDARD}")
_matrix("doc_term_log_dl", {"tf_type": "log", "dl_type": "log"}, "(ln(tf) + 1) / (ln(dl) + 1)")
_matrix("doc_term_binary_dl", {"tf_type": "binary", "dl_type": "sqrt"}, "1 / sqrt(dl)")
_matrix("doc_term_bm25", {"tf_type": "bm25", "idf_type": "bm25", "dl_type": "linear"}, f"tf * 2.6 / (tf + 1.6 * (0.25 + 0.75 * dl / mean)) * {_BM}")


@query(f"""WITH tf AS (SELECT lang AS doc_id, term, count(*) AS tf FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '{W}')) AS term FROM documents) GROUP BY ALL), {_DF},
    g AS (SELECT count(DISTINCT lang) AS n FROM documents), v AS (SELECT *, row_number() OVER (ORDER BY term) - 1 AS term_id FROM df)
    SELECT doc_id AS grp, term, term_id::INT AS term_id, tf::INT AS tf, round(tf * (ln((g.n + 1) / (df + 1)) + 1), 6) AS weight FROM tf JOIN v USING (term), g""")  # fmt: skip
def group_term_matrix(spark, sf_dir):
    _, out = vectorize.GroupVectorizer(idf_type="smooth").fit_transform(_docs(spark, sf_dir), grp_col="lang")
    return out.withColumn("weight", F.round("weight", 6))


def _tf(spark, sf_dir):
    return vectorize.count_terms(_docs(spark, sf_dir))


def _n(spark, sf_dir) -> int:
    return table(spark, sf_dir, "documents").count()


@query(f"""WITH {_TF}, {_DF}, x AS (SELECT *, df / {_N} AS p FROM df)
    SELECT term, df, round(sqrt(n), 6) AS sqrt_freq, round({_SMOOTH}, 6) AS smooth_idf, round({_BM}, 6) AS bm25_idf, round(CASE WHEN p < 1 THEN -p * log2(p) - (1 - p) * log2(1 - p) ELSE 0 END, 6) AS ic FROM x""")  # fmt: skip
def term_statistics(spark, sf_dir):
    n, tf = _n(spark, sf_dir), shared.written(_tf(spark, sf_dir))
    parts = (
        vectorize.get_doc_freqs(tf), vectorize.get_term_freqs(tf, type_="sqrt").select("term", F.round("freq", 6).alias("sqrt_freq")), vectorize.get_information_content(tf, n_docs=n).select("term", F.round("ic", 6).alias("ic")),
        *(vectorize.get_inverse_doc_freqs(tf, type_=k, n_docs=n).select("term", F.round("idf", 6).alias(f"{k}_idf")) for k in ("smooth", "bm25")),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "term")
    return out


@query(f"WITH {_TF} SELECT doc_id, round(ln(sum(tf)) + 1, 6) AS length FROM tf GROUP BY doc_id")
def doc_lengths(spark, sf_dir):
    return vectorize.get_doc_lengths(_tf(spark, sf_dir), type_="log").withColumn("length", F.round("length", 6))


@query(f"WITH {_TF}, {_DF}, kept AS (SELECT term FROM df WHERE df BETWEEN 3 AND floor(0.3 * {_N}) ORDER BY n DESC, term LIMIT 2000) SELECT doc_id, term, tf::INT AS tf FROM tf WHERE term IN (SELECT term FROM kept)")
def terms_by_df(spark, sf_dir):
    return vectorize.filter_terms_by_df(_tf(spark, sf_dir), min_df=3, max_df=0.3, max_n_terms=2000, n_docs=_n(spark, sf_dir)).select("doc_id", "term", "tf")


@query(f"WITH {_TF}, {_DF}, x AS (SELECT term, df / {_N} AS p FROM df), kept AS (SELECT term FROM x WHERE p < 1 AND -p * log2(p) - (1 - p) * log2(1 - p) >= 0.2) SELECT doc_id, term, tf::INT AS tf FROM tf WHERE term IN (SELECT term FROM kept)")
def terms_by_ic(spark, sf_dir):
    return vectorize.filter_terms_by_ic(_tf(spark, sf_dir), min_ic=0.2, n_docs=_n(spark, sf_dir)).select("doc_id", "term", "tf")


def _topic_query(model: str):
    def run(spark, sf_dir):
        fitted, matrix = vectorize.Vectorizer(idf_type="smooth", norm="l2", min_df=3, max_df=0.5).fit_transform(_docs(spark, sf_dir))
        n = fitted.vocabulary.count()
        out = topics.TopicModel(model, 8).fit(matrix, n)
        return out.top_topic_terms(fitted.vocabulary, top_n=10).withColumn("weight", F.round("weight", 4))

    query(name=f"topics_{model}")(run)


for _model in ("nmf", "lda", "lsa"):
    _topic_query(_model)
