"""Lexical resources as dimension tables: relations between concepts, and emotions of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RELATIONS = {"synonyms": ("/r/Synonym", True), "antonyms": ("/r/Antonym", True), "hyponyms": ("/r/IsA", False), "meronyms": ("/r/PartOf", False)}


def parse_concept_uri(uri: str | F.Column) -> F.Column:
    """(lang, term, sense) of ``/c/lang/term/sense/...``; underscores are blanks, no sense is the empty one."""
    parts = F.split(F.col(uri) if isinstance(uri, str) else uri, "/")
    return F.struct(F.get(parts, F.lit(2)).alias("lang"), F.replace(F.get(parts, F.lit(3)), F.lit("_"), F.lit(" ")).alias("term"), F.coalesce(F.get(parts, F.lit(4)), F.lit("")).alias("sense"))


class ConceptNet:
    """Assertions (uri, rel, start_uri, end_uri, json), tab-separated or as a DataFrame with these columns."""

    def __init__(self, source: DataFrame):
        self.df = source

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> ConceptNet:
        return cls(spark.read.csv(path, sep="\t", quote="", schema="uri string, rel string, start_uri string, end_uri string, json string"))

    def relation(self, name: str) -> DataFrame:
        """(lang, term, sense, value): pairs of one language; a symmetric relation holds both ways, the others from the whole to its parts."""
        rel, symmetric = RELATIONS[name]
        pairs = self.df.where(F.col("rel") == rel).select(parse_concept_uri("start_uri").alias("a"), parse_concept_uri("end_uri").alias("b")).where("a.lang = b.lang AND a.term <> b.term")
        turned = pairs.select(F.col("b.lang").alias("lang"), F.col("b.term").alias("term"), F.col("b.sense").alias("sense"), F.col("a.term").alias("value"))
        if not symmetric:
            return turned.distinct()
        return turned.unionAll(pairs.select(F.col("a.lang"), F.col("a.term"), F.col("a.sense"), F.col("b.term").alias("value"))).distinct()

    def write_relations(self, path: str) -> None:
        """All relations as Parquet, partitioned by relation and language, so that lookups prune."""
        parts = [self.relation(n).withColumn("relation", F.lit(n)) for n in RELATIONS]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        out.write.partitionBy("relation", "lang").parquet(path)

    def lookup(self, name: str, terms: DataFrame, *, term_col: str = "term", lang: str | None = None, lang_col: str | None = None, sense: str | None = None) -> DataFrame:
        """``terms`` with the array ``name``: the related terms in order, empty where there are none; blanks and underscores are alike."""
        found = self.relation(name)
        if sense is not None:
            found = found.where(F.col("sense") == sense)
        lists = found.groupBy(F.col("lang").alias("_lang"), F.lower("term").alias("_term")).agg(F.sort_array(F.collect_set("value")).alias(name))
        keyed = terms.withColumn("_term", F.lower(F.replace(F.col(term_col), F.lit("_"), F.lit(" ")))).withColumn("_lang", F.col(lang_col) if lang_col else F.lit(lang or "en"))
        return keyed.join(lists, ["_lang", "_term"], "left").drop("_lang", "_term").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))

    def get_synonyms(self, terms: DataFrame, **options) -> DataFrame:
        return self.lookup("synonyms", terms, **options)

    def get_antonyms(self, terms: DataFrame, **options) -> DataFrame:
        return self.lookup("antonyms", terms, **options)

    def get_hyponyms(self, terms: DataFrame, **options) -> DataFrame:
        return self.lookup("hyponyms", terms, **options)

    def get_meronyms(self, terms: DataFrame, **options) -> DataFrame:
        return self.lookup("meronyms", terms, **options)


class DepecheMood:
    """Weights of emotions by term: (term, emotions..., freq)."""

    def __init__(self, source: DataFrame, *, min_freq: int = 3):
        freq = source.columns[-1]
        self.emotions = source.columns[1:-1]
        self.weights = source.where(F.col(freq) >= min_freq).select(F.col(source.columns[0]).alias("term"), *[F.col(f"`{e}`").cast("double").alias(e) for e in self.emotions])

    @classmethod
    def read(cls, spark: SparkSession, path: str, *, min_freq: int = 3) -> DepecheMood:
        return cls(spark.read.csv(path, sep="\t", header=True, inferSchema=True), min_freq=min_freq)

    def get_emotional_valence(self, docs: DataFrame, *, id_col: str = "doc_id", terms_col: str = "terms") -> DataFrame:
        """(doc_id, emotions...): means over the terms that are known; documents without one have no row."""
        rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(terms_col).alias("term")).join(self.weights, "term")
        return rows.groupBy("doc_id").agg(*[F.avg(f"`{e}`").alias(e) for e in self.emotions])
