"""Document-term and group-term matrices in long form, their weights, and statistics of them.

A matrix is a DataFrame of (doc_id, term, tf); with a vocabulary it has term_id too. Nothing is collected: term ids come
from counting the terms before each range of the alphabet.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.shared import written

K1, B = 1.6, 0.75
TF, IDF, DL, NORMS = ("linear", "sqrt", "log", "binary", "bm25"), (None, "standard", "smooth", "bm25"), (None, "linear", "sqrt", "log"), (None, "l1", "l2")


def _scaled(value: Column, kind: str) -> Column:
    """linear, sqrt, or natural logarithm plus 1."""
    known = {"linear": lambda: value.cast("double"), "sqrt": lambda: F.sqrt(value), "log": lambda: F.log(value.cast("double")) + 1}
    if kind not in known:
        raise ValueError(f"type_ = {kind!r}; known are {sorted(known)}")
    return known[kind]()


def idf_of(n: Column, df: Column, kind: str) -> Column:
    known = {
        "standard": lambda: F.log(n / df) + 1,
        "smooth": lambda: F.log((n + 1) / (df + 1)) + 1,
        "bm25": lambda: F.log((n - df + 0.5) / (df + 0.5)),
    }
    if kind not in known:
        raise ValueError(f"type_ = {kind!r}; known are {sorted(known)}")
    return known[kind]()


def count_terms(docs: DataFrame, *, id_col: str = "doc_id", terms_col: str = "terms", vocabulary: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, tf) of arrays of terms; terms outside a fixed ``vocabulary`` (term, ...) are left out."""
    tf = docs.select(F.col(id_col).alias("doc_id"), F.explode(terms_col).alias("term")).where("term IS NOT NULL").groupBy("doc_id", "term").agg(F.count("*").cast("int").alias("tf"))
    return tf if vocabulary is None else tf.join(vocabulary.select("term"), "term", "left_semi")


def build_vocabulary(terms: DataFrame, term_col: str = "term") -> DataFrame:
    """(term, term_id): compact ids from 0 in code-point order.

    Terms are range-partitioned and numbered within their range, which is moved by the number of terms in the ranges before.
    """
    ranged = terms.select(F.col(term_col).alias("term")).distinct().repartitionByRange("term").sortWithinPartitions("term")
    placed = written(ranged.withColumn("part", F.spark_partition_id()))
    within = placed.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("term")))
    sizes = placed.groupBy("part").count()
    before = sizes.select("part", (F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    return within.join(F.broadcast(before), "part").select("term", (F.col("before") + F.col("k") - 1).cast("int").alias("term_id"))  # a row for each partition


def validate_vocabulary(vocabulary: list[str] | dict[str, int]) -> dict[str, int]:
    """Ids of a fixed vocabulary: unique, compact, and in order where a list is given."""
    if not vocabulary:
        raise ValueError("a vocabulary isn't empty")
    if isinstance(vocabulary, dict):
        if sorted(vocabulary.values()) != list(range(len(vocabulary))):
            raise ValueError("the ids of a vocabulary are unique and leave none out")
        return dict(vocabulary)
    if len(set(vocabulary)) != len(vocabulary):
        raise ValueError("a vocabulary has each term once")
    return {t: i for i, t in enumerate(sorted(vocabulary))}


def get_term_freqs(tf: DataFrame, *, type_: str = "linear") -> DataFrame:
    return tf.groupBy("term").agg(_scaled(F.sum("tf"), type_).alias("freq"))


def get_doc_freqs(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def get_doc_lengths(tf: DataFrame, *, type_: str = "linear") -> DataFrame:
    return tf.groupBy("doc_id").agg(_scaled(F.sum("tf"), type_).alias("length"))


def n_docs_of(tf: DataFrame) -> int:
    return tf.select("doc_id").distinct().count()


def get_inverse_doc_freqs(tf: DataFrame, *, type_: str = "smooth", n_docs: int | None = None) -> DataFrame:
    n = F.lit(float(n_docs_of(tf) if n_docs is None else n_docs))
    return get_doc_freqs(tf).select("term", idf_of(n, F.col("df"), type_).alias("idf"))


def get_information_content(tf: DataFrame, *, n_docs: int | None = None) -> DataFrame:
    """Entropy of a term's being in a document, in bits; 0 for one in all or none."""
    p = F.col("df") / F.lit(float(n_docs_of(tf) if n_docs is None else n_docs))
    return get_doc_freqs(tf).select("term", F.when((p > 0) & (p < 1), -p * F.log2(p) - (1 - p) * F.log2(1 - p)).otherwise(F.lit(0.0)).alias("ic"))


def apply_idf_weighting(tf: DataFrame, *, type_: str = "smooth", n_docs: int | None = None) -> DataFrame:
    return tf.join(get_inverse_doc_freqs(tf, type_=type_, n_docs=n_docs), "term").select("doc_id", "term", "tf", (F.col("tf") * F.col("idf")).alias("weight"))


def _top(stats: DataFrame, by: Column, n: int | None) -> DataFrame:
    """The ``n`` rows of greatest value, the lesser term on ties; without a window over all rows."""
    return stats if n is None else stats.orderBy(by.desc(), "term").limit(n)


def filter_terms_by_df(tf: DataFrame, *, min_df: int | float = 1, max_df: int | float = 1.0, max_n_terms: int | None = None, n_docs: int | None = None) -> DataFrame:
    """Terms in [min_df, max_df] documents (a float is a share of all, rounded down), then those of greatest term frequency."""
    for x in (min_df, max_df):
        if x < 0 or isinstance(x, float) and x > 1:
            raise ValueError(f"{x} is neither a count nor a share")
    if max_n_terms is not None and max_n_terms < 1:
        raise ValueError("max_n_terms is 1 at least")
    n = n_docs_of(tf) if n_docs is None and (isinstance(min_df, float) or isinstance(max_df, float)) else n_docs or 0
    low, high = (int(x * n) if isinstance(x, float) else x for x in (min_df, max_df))
    if high < low:
        raise ValueError("max_df gives fewer documents than min_df")
    stats = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n")).where(F.col("df").between(low, high))
    return tf.join(_top(stats, F.col("n"), max_n_terms).select("term"), "term", "left_semi")


def filter_terms_by_ic(tf: DataFrame, *, min_ic: float = 0.0, max_n_terms: int | None = None, n_docs: int | None = None) -> DataFrame:
    """Terms of at least ``min_ic`` bits, then those of most."""
    if not 0 <= min_ic <= 1:
        raise ValueError("min_ic lies between 0 and 1")
    stats = get_information_content(tf, n_docs=n_docs).where(F.col("ic") >= min_ic)
    return tf.join(_top(stats, F.col("ic"), max_n_terms).select("term"), "term", "left_semi")


@dataclass(frozen=True)
class Vectorizer:
    """Weights of terms in documents; ``fit`` learns vocabulary, document frequencies and the mean length."""

    tf_type: str = "linear"
    idf_type: str | None = None
    dl_type: str | None = None
    norm: str | None = None
    min_df: int | float = 1
    max_df: int | float = 1.0
    max_n_terms: int | None = None
    vocabulary_terms: tuple[str, ...] | None = None
    #: What fit found: (term, term_id, df), the number of documents and their mean length.
    vocabulary: DataFrame | None = None
    n_docs: int = 0
    mean_length: float = 0.0

    def __post_init__(self) -> None:
        for value, known in ((self.tf_type, TF), (self.idf_type, IDF), (self.dl_type, DL), (self.norm, NORMS)):
            if value not in known:
                raise ValueError(f"{value!r} is none of {known}")
        if self.vocabulary_terms is not None:
            validate_vocabulary(list(self.vocabulary_terms))

    def _counted(self, docs: DataFrame, id_col: str, terms_col: str) -> DataFrame:
        fixed = None
        if self.vocabulary_terms is not None:
            fixed = docs.sparkSession.createDataFrame([(t,) for t in self.vocabulary_terms], "term string")
        return count_terms(docs, id_col=id_col, terms_col=terms_col, vocabulary=fixed)

    def _learn(self, tf: DataFrame, n_docs: int) -> Vectorizer:
        kept = tf if (self.min_df, self.max_df, self.max_n_terms) == (1, 1.0, None) and not isinstance(self.max_df, int) else filter_terms_by_df(tf, min_df=self.min_df, max_df=self.max_df, max_n_terms=self.max_n_terms, n_docs=n_docs)
        if self.vocabulary_terms is not None:
            # a fixed vocabulary has its terms whether they occur or not
            every = tf.sparkSession.createDataFrame(list(validate_vocabulary(list(self.vocabulary_terms)).items()), "term string, term_id int")
            vocabulary = every.join(get_doc_freqs(kept), "term", "left").select("term", "term_id", F.coalesce("df", F.lit(0)).alias("df"))
        else:
            df = get_doc_freqs(kept)
            vocabulary = build_vocabulary(df).join(df, "term")
        lengths = tf.agg(F.sum("tf")).first()[0] or 0
        return replace(self, vocabulary=written(vocabulary), n_docs=n_docs, mean_length=lengths / n_docs if n_docs else 0.0)

    def fit(self, docs: DataFrame, *, id_col: str = "doc_id", terms_col: str = "terms") -> Vectorizer:
        tf = written(self._counted(docs, id_col, terms_col))
        return self._learn(tf, docs.select(id_col).distinct().count())

    def _weighted(self, tf: DataFrame) -> DataFrame:
        if self.vocabulary is None:
            raise ValueError("fit comes before transform")
        # the vocabulary grows with the data: a hash or merge join, as its measured size tells
        rows = tf.join(self.vocabulary, "term")
        length = F.sum("tf").over(Window.partitionBy("doc_id"))
        if self.dl_type or self.tf_type == "bm25":
            rows = rows.withColumn("length", length)
        tf_ = F.col("tf")
        if self.tf_type == "bm25":
            scale = _scaled(F.col("length"), self.dl_type) / F.lit(self.mean_length) if self.dl_type else F.lit(1.0)
            weight = tf_ * (K1 + 1) / (tf_ + K1 * (1 - B + B * scale)) if self.dl_type else tf_ * (K1 + 1) / (tf_ + K1)
        elif self.tf_type == "binary":
            weight = F.lit(1.0)
        else:
            weight = _scaled(tf_, self.tf_type)
        if self.idf_type:
            weight = weight * idf_of(F.lit(float(self.n_docs)), F.col("df"), self.idf_type)
        if self.dl_type and self.tf_type != "bm25":
            weight = weight / _scaled(F.col("length"), self.dl_type)
        rows = rows.withColumn("weight", weight)
        if self.norm:
            by = Window.partitionBy("doc_id")
            size = F.sum(F.abs("weight")).over(by) if self.norm == "l1" else F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(by))
            rows = rows.withColumn("weight", F.when(size > 0, F.col("weight") / size).otherwise(F.lit(0.0)))
        return rows.select("doc_id", "term", "term_id", "tf", "weight")

    def transform(self, docs: DataFrame, *, id_col: str = "doc_id", terms_col: str = "terms") -> DataFrame:
        """(doc_id, term, term_id, tf, weight) over the fitted vocabulary."""
        return self._weighted(count_terms(docs, id_col=id_col, terms_col=terms_col))

    def fit_transform(self, docs: DataFrame, *, id_col: str = "doc_id", terms_col: str = "terms") -> tuple[Vectorizer, DataFrame]:
        tf = written(self._counted(docs, id_col, terms_col))
        fitted = self._learn(tf, docs.select(id_col).distinct().count())
        return fitted, fitted._weighted(tf)

    @property
    def weighting(self) -> str:
        """The formula in words."""
        tf = {"linear": "tf", "sqrt": "sqrt(tf)", "log": "(log(tf) + 1)", "binary": "1", "bm25": "tf * (k + 1) / (tf + k * (1 - b + b * length / mean length))" if self.dl_type else "tf * (k + 1) / (tf + k)"}[self.tf_type]
        idf = {None: "", "standard": " * (log(n_docs / df) + 1)", "smooth": " * (log((n_docs + 1) / (df + 1)) + 1)", "bm25": " * log((n_docs - df + 0.5) / (df + 0.5))"}[self.idf_type]
        dl = {None: "", "linear": " / length", "sqrt": " / sqrt(length)", "log": " / (log(length) + 1)"}[self.dl_type] if self.tf_type != "bm25" else ""
        return tf + idf + dl


class GroupVectorizer:
    """As :class:`Vectorizer`, with the documents of a group as one row; document frequencies count groups."""

    def __init__(self, *, vocabulary_grps: tuple[str, ...] | None = None, **options):
        self.inner, self.groups = Vectorizer(**options), vocabulary_grps

    def fit_transform(self, docs: DataFrame, *, grp_col: str, terms_col: str = "terms") -> tuple[Vectorizer, DataFrame]:
        """The fitted vectorizer, and (grp, term, term_id, tf, weight); rows whose group is null or unknown are left out."""
        rows = docs.where(F.col(grp_col).isNotNull())
        if self.groups is not None:
            rows = rows.where(F.col(grp_col).isin(*self.groups))
        fitted, out = self.inner.fit_transform(rows, id_col=grp_col, terms_col=terms_col)
        return fitted, out.withColumnRenamed("doc_id", "grp")


def build_doc_term_matrix(docs: DataFrame, *, tf_type: str = "linear", idf_type: str | None = None, dl_type: str | None = None, id_col: str = "doc_id", terms_col: str = "terms", **options) -> tuple[DataFrame, DataFrame]:
    """The weighted matrix and the vocabulary."""
    fitted, out = Vectorizer(tf_type=tf_type, idf_type=idf_type, dl_type=dl_type, **options).fit_transform(docs, id_col=id_col, terms_col=terms_col)
    return out, fitted.vocabulary


def build_grp_term_matrix(docs: DataFrame, *, grp_col: str, tf_type: str = "linear", idf_type: str | None = None, dl_type: str | None = None, terms_col: str = "terms", **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The weighted matrix, the vocabulary and the groups with their ids."""
    fitted, out = GroupVectorizer(tf_type=tf_type, idf_type=idf_type, dl_type=dl_type, **options).fit_transform(docs, grp_col=grp_col, terms_col=terms_col)
    groups = build_vocabulary(docs.where(F.col(grp_col).isNotNull()).select(F.col(grp_col).cast("string").alias("term"))).select(F.col("term").alias("grp"), F.col("term_id").alias("grp_id"))
    return out, fitted.vocabulary, groups
