"""Datasets of texts with filters.

A range filter is half-open, its open bounds are the dataset's own and bounds outside are clipped; a set filter takes
one value or several, any of which fits; an unknown value raises. Filters are conditions on columns, so Catalyst pushes
them into the scan.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.shared import numbered
from lexispark.utils import to_collection, validate_and_clip_range, validate_set_members


def in_set(c: Column, values, known: Collection | None = None, kind: type | tuple = str) -> Column | None:
    return None if values is None else c.isin(*sorted(validate_set_members(values, kind, known)))


def in_range(c: Column, bounds, full: tuple, kind: type | tuple = str) -> Column | None:
    if bounds is None:
        return None
    low, high = validate_and_clip_range(bounds, full, kind)
    return (c >= low) & (c < high)


def at_least(c: Column, min_len: int | None) -> Column | None:
    if min_len is None:
        return None
    if min_len < 1:
        raise ValueError("min_len is 1 at least")
    return F.length(c) >= min_len


def any_of(c: Column, values) -> Column | None:
    return None if values is None else F.arrays_overlap(c, F.array(*[F.lit(v) for v in sorted(to_collection(values, str, set))]))


class Dataset:
    """A name, and records (text, fields...) that filters thin out."""

    name = ""
    content = "text"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def info(self) -> dict[str, str]:
        return {"name": self.name, "path": self.path}

    def load(self) -> DataFrame:
        raise NotImplementedError

    def conditions(self, **filters) -> list[Column | None]:
        raise NotImplementedError

    def records(self, *, limit: int | None = None, **filters) -> DataFrame:
        df = self.load()
        for c in self.conditions(**filters):
            if c is not None:
                df = df.where(c)
        return df if limit is None else df.limit(limit)

    def texts(self, *, limit: int | None = None, **filters) -> DataFrame:
        return self.records(limit=limit, **filters).select(self.content)


class CapitolWords(Dataset):
    """Speeches in a parliament, as JSON lines."""

    name = "capitol_words"
    full_date_range = ("1996-01-01", "2016-06-30")
    parties, chambers, congresses = {"D", "R", "I"}, {"Senate", "House", "Extensions"}, set(range(104, 115))
    schema = "text string, title string, date string, speaker_name string, speaker_party string, congress int, chamber string"

    def load(self) -> DataFrame:
        return self.spark.read.schema(self.schema).json(self.path)

    def conditions(self, *, speaker_name=None, speaker_party=None, chamber=None, congress=None, date_range=None, min_len=None) -> list[Column | None]:
        return [
            at_least(F.col("text"), min_len), in_set(F.col("speaker_name"), speaker_name), in_set(F.col("speaker_party"), speaker_party, self.parties), in_set(F.col("chamber"), chamber, self.chambers),
            in_set(F.col("congress"), congress, self.congresses, int), in_range(F.col("date"), date_range, self.full_date_range),
        ]


class SupremeCourt(Dataset):
    """Decisions of a court, as JSON lines; codes are named by dimension tables."""

    name = "supreme_court"
    full_date_range = ("1946-11-18", "2016-06-27")
    decision_directions = {"conservative", "liberal", "unspecifiable"}
    issue_areas = {-1: "none", 1: "Criminal Procedure", 2: "Civil Rights", 3: "First Amendment", 4: "Due Process", 5: "Privacy", 6: "Attorneys", 7: "Unions", 8: "Economic Activity", 9: "Judicial Power", 10: "Federalism", 11: "Interstate Relations", 12: "Federal Taxation", 13: "Miscellaneous", 14: "Private Action"}
    schema = "text string, case_name string, argument_date string, decision_date string, decision_direction string, maj_opinion_author int, n_maj_votes int, n_min_votes int, issue string, issue_area int, us_cite_id string"

    def load(self) -> DataFrame:
        return self.spark.read.schema(self.schema).json(self.path)

    def conditions(self, *, opinion_author=None, decision_direction=None, issue_area=None, date_range=None, min_len=None) -> list[Column | None]:
        return [
            at_least(F.col("text"), min_len), in_set(F.col("maj_opinion_author"), opinion_author, None, int), in_set(F.col("decision_direction"), decision_direction, self.decision_directions),
            in_set(F.col("issue_area"), issue_area, set(self.issue_areas), int), in_range(F.col("decision_date"), date_range, self.full_date_range),
        ]

    def with_issue_names(self, df: DataFrame) -> DataFrame:
        names = self.spark.createDataFrame(list(self.issue_areas.items()), "issue_area int, issue_area_name string")
        return df.join(F.broadcast(names), "issue_area", "left")  # fifteen rows


class IMDB(Dataset):
    """Reviews of films: files ``subset/label/id_rating.txt`` below a folder; films by line of ``urls_label.txt``."""

    name = "imdb"
    full_rating_range = (1, 11)
    subsets, labels = {"train", "test"}, {"pos", "neg", "unsup"}

    def load(self, subset=None, label=None) -> DataFrame:
        wanted = [f"{self.path}/{s}/{x}/*.txt" for s in sorted(to_collection(subset, str, set) or self.subsets) for x in sorted(to_collection(label, str, set) or self.labels)]
        there = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(self.path) if subset is None and label is None else None
        paths = self.path if there is not None else wanted
        reader = self.spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*_*.txt") if there is not None else self.spark.read
        df = reader.text(paths, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("file"))
        pattern = r"([^/]+)/([^/]+)/(\d+)_(\d+)\.txt$"
        part = lambda k: F.regexp_extract("file", pattern, k)
        rows = df.where(F.col("file").rlike(pattern)).select(
            F.regexp_replace("text", "<br ?/?>", "\n").alias("text"), part(1).alias("subset"), part(2).alias("label"), F.when(part(2) != "unsup", part(4).cast("int")).alias("rating"), part(3).cast("long").alias("line")
        )
        return rows.join(self.movies(), ["subset", "label", "line"], "left").drop("line")

    def movies(self) -> DataFrame:
        """(subset, label, line, movie_id) of the lists of URLs."""
        lists = self.spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "urls_*.txt").text(self.path, wholetext=True).select("value", F.input_file_name().alias("file"))
        lines = lists.select(F.regexp_extract("file", r"([^/]+)/urls_([^/.]+)\.txt$", 1).alias("subset"), F.regexp_extract("file", r"([^/]+)/urls_([^/.]+)\.txt$", 2).alias("label"), F.posexplode(F.split("value", "\n")).alias("line", "url"))
        return lines.select("subset", "label", F.col("line").cast("long").alias("line"), F.regexp_extract("url", r"title/(tt\d+)", 1).alias("movie_id"))

    def records(self, *, subset=None, label=None, rating_range=None, min_len=None, limit: int | None = None) -> DataFrame:
        for values, known in ((subset, self.subsets), (label, self.labels)):
            if values is not None:
                validate_set_members(values, str, known)
        df = self.load(subset, label)
        for c in (at_least(F.col("text"), min_len), in_range(F.col("rating"), rating_range, self.full_rating_range, int)):
            if c is not None:
                df = df.where(c)
        return df if limit is None else df.limit(limit)


class RedditComments(Dataset):
    """Comments, as compressed JSON lines by month; a date range prunes the months that are read."""

    name = "reddit_comments"
    content = "body"
    full_date_range = ("2007-10-01", "2015-06-01")
    full_score_range = (-(2**31), 2**31)
    schema = "body string, created_utc string, retrieved_on string, subreddit string, score int, gilded int"

    @staticmethod
    def months(date_range: tuple[str, str]) -> list[str]:
        """``YYYY/RC_YYYY-MM`` of the months that a range touches."""
        low, high = date_range
        year, month = int(low[:4]), int(low[5:7])
        out = []
        while f"{year:04}-{month:02}" <= high[:7] and f"{year:04}-{month:02}-01" < high:
            out.append(f"{year:04}/RC_{year:04}-{month:02}")
            year, month = (year + 1, 1) if month == 12 else (year, month + 1)
        return out

    @staticmethod
    def clean_content(c: Column) -> Column:
        """Without links' targets, entities, marks of emphasis and doubled white space."""
        c = F.regexp_replace(c, r"\[([^\[\]]+)\]\((?:[^()\s]+)\)", "$1")
        c = F.replace(F.replace(F.replace(c, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))
        c = F.translate(c, "`*~", "")
        return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?:\r\n|[\n\x0B])+", "\n"), r"[^\S\n\x0B]+", " "))

    @staticmethod
    def convert_timestamp(c: Column) -> Column:
        """Seconds since 1970 as an ISO string in UTC; what is no number becomes the empty string."""
        return F.coalesce(F.date_format(F.timestamp_seconds(c.try_cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))

    def load(self, date_range=None) -> DataFrame:
        paths = [f"{self.path}/{m}.bz2" for m in self.months(validate_and_clip_range(date_range, self.full_date_range, str))] if date_range else f"{self.path}/*/RC_*.bz2"
        raw = self.spark.read.schema(self.schema).json(paths)
        return raw.select(self.clean_content(F.col("body")).alias("body"), *[self.convert_timestamp(F.col(c)).alias(c) for c in ("created_utc", "retrieved_on")], "subreddit", "score", "gilded")

    def records(self, *, subreddit=None, date_range=None, score_range=None, min_len=None, limit: int | None = None) -> DataFrame:
        df = self.load(date_range)
        for c in (at_least(F.col("body"), min_len), in_set(F.col("subreddit"), subreddit), in_range(F.col("created_utc"), date_range, self.full_date_range), in_range(F.col("score"), score_range, self.full_score_range, int)):
            if c is not None:
                df = df.where(c)
        return df if limit is None else df.limit(limit)


class OxfordTextArchive(Dataset):
    """Literary works: ``text/id.txt`` files and ``metadata.tsv`` below a folder."""

    name = "oxford_text_archive"
    full_date_range = ("0018", "1990")

    def metadata(self) -> DataFrame:
        """(id, title, author, year) of the English works."""
        raw = self.spark.read.csv(f"{self.path}/metadata.tsv", sep="\t", header=True)
        names = {c.lower(): c for c in raw.columns}
        author = F.transform(F.filter(F.split(F.regexp_replace(F.col(names["author"]), r"[\d?.-]*\d{2,4}[\d?. -]*|\([^)]*\)", ""), ";"), lambda a: F.trim(a) != ""), lambda a: F.regexp_replace(F.trim(a), r"[, ]+$", ""))
        rows = raw.where(F.col(names["language"]).rlike("(?i)english")) if "language" in names else raw
        return rows.select(F.col(names["id"]).alias("id"), F.col(names["title"]).alias("title"), author.alias("author"), F.nullif(F.regexp_extract(F.col(names["year"]), r"\d{4}", 0), F.lit("")).alias("year"))

    def load(self) -> DataFrame:
        texts = self.spark.read.text(f"{self.path}/text/*.txt", wholetext=True).select(F.col("value").alias("text"), F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("id"))
        return texts.join(self.metadata(), "id")

    def conditions(self, *, author=None, date_range=None, min_len=None) -> list[Column | None]:
        return [at_least(F.col("text"), min_len), any_of(F.col("author"), author), in_range(F.col("year"), date_range, self.full_date_range)]


class UDHR(Dataset):
    """A declaration in many languages: ``index.xml`` and text files with a header above ``---``."""

    name = "udhr"

    def load(self) -> DataFrame:
        schema = "`_l` string, `_n` string, `_f` string, `_bcp47` string, `_stage` int"
        index = self.spark.read.format("xml").option("rowTag", "udhr").schema(schema).load(f"{self.path}/index.xml").where(F.col("_bcp47").rlike("^[a-z]{2}$") & (F.col("_stage") >= 3))
        whole = self.spark.read.text(f"{self.path}/*.txt", wholetext=True).select("value", F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("file"))
        body = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", r"(?s)^.*?---", ""), r"\s*\n\s*", "\n"), r"[ \t]+", " "), r"^\s+|\s+$", "")
        return whole.join(index.select(F.concat(F.lit("udhr_"), F.col("_f")).alias("file"), F.col("_bcp47").alias("lang"), F.col("_n").alias("lang_name")), "file").select(body.alias("text"), "lang", "lang_name", F.concat("file", F.lit(".txt")).alias("filename"))

    def conditions(self, *, lang=None) -> list[Column | None]:
        return [in_set(F.col("lang"), lang)]


class Wikimedia(Dataset):
    """Pages of a search index's dump: pairs of lines, an index line and a source line."""

    name, project, namespace = "wikimedia", "wiki", 0
    #: Beginnings of categories that say nothing of a page, by language.
    bad_categories = {"en": ("All articles", "Articles with", "Articles needing", "CS1", "Pages with", "Pages using", "Use dmy", "Use mdy", "Webarchive", "Wikipedia articles")}
    link_prefixes = ("Category:", "File:", "Help:", "Portal:", "Special:", "Talk:", "Template:", "User:", "Wikipedia:")
    schema = "page_id string, title string, text string, headings array<string>, wiki_links array<string>, ext_links array<string>, categories array<string>, dt_created string, n_incoming_links long, popularity_score double"

    def __init__(self, spark: SparkSession, path: str, *, lang: str = "en", namespace: int = 0):
        super().__init__(spark, path)
        self.lang, self.namespace = lang, namespace

    def load(self) -> DataFrame:
        lines = self.spark.read.text(self.path).select("value", F.input_file_name().alias("file"))
        bad, links, namespace = self.bad_categories.get(self.lang, ()), self.link_prefixes, self.namespace

        def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import json

            page = None
            for b in batches:
                rows = []
                for value in b["value"]:
                    x = json.loads(value)
                    if "index" in x:
                        page = x["index"].get("_id")
                    elif page is not None:
                        if x.get("namespace", namespace) == namespace:
                            rows.append((
                                str(page), x.get("title"), x.get("text"), x.get("heading") or [], [y for y in x.get("outgoing_link") or [] if not y.startswith(links)], x.get("external_link") or [],
                                [y for y in x.get("category") or [] if not (bad and y.startswith(bad))], x.get("create_timestamp"), x.get("incoming_links"), x.get("popularity_score"),
                            ))
                        page = None
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in self_schema.split(", ")])

        self_schema = self.schema
        # a gzip file is one partition, so that the lines of a pair stay together and in order
        return lines.select("value").mapInPandas(pairs, self.schema)

    def conditions(self, *, category=None, wiki_link=None, min_len=None) -> list[Column | None]:
        return [at_least(F.col("text"), min_len), any_of(F.col("categories"), category), any_of(F.col("wiki_links"), wiki_link)]


class Wikipedia(Wikimedia):
    name, project = "wikipedia", "wiki"


class Wikinews(Wikimedia):
    name, project = "wikinews", "wikinews"


class LangIdData:
    """Texts with their languages, for training an identifier: (text, lang)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    @staticmethod
    def _long(df: DataFrame, min_len: int) -> DataFrame:
        return df.where(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]")) >= min_len)

    def iso_langs(self, path: str, exclude: Collection[str] = ()) -> DataFrame:
        """(iso_639_3, iso_639_1) of a tab-separated table of codes."""
        raw = self.spark.read.csv(path, sep="\t", header=True)
        three, two = raw.columns[0], next(c for c in raw.columns if "1" in c)
        return raw.where(F.col(two).isNotNull() & ~F.col(two).isin(*exclude, "")).select(F.col(three).alias("iso_639_3"), F.col(two).alias("iso_639_1"))

    def dslcc(self, path: str, langs: Collection[str], min_len: int = 25) -> DataFrame:
        """Lines of text and language (``pt-BR`` is ``pt``), each once, by language."""
        raw = self.spark.read.csv(path, sep="\t", quote="", schema="text string, lang string")
        rows = raw.select("text", F.lower(F.substring_index("lang", "-", 1)).alias("lang")).where(F.col("lang").isin(*langs))
        return self._long(rows, min_len).distinct().orderBy("lang", "text")

    def by_file(self, path: str, langs: Collection[str], min_len: int = 25, pattern: str = r"([a-z]{2}(?:_[a-z]{2})?)(?:\.txt)?(?:\.gz)?$") -> DataFrame:
        """Lines of files whose names end in a language (``pt_br`` is ``pt``): translated news and talks."""
        raw = self.spark.read.text(path).select(F.col("value").alias("text"), F.substring_index(F.regexp_extract(F.input_file_name(), pattern, 1), "_", 1).alias("lang"))
        return self._long(raw.where(F.col("lang").isin(*langs)), min_len)

    setimes = ted2020 = by_file

    def tatoeba(self, path: str, iso: DataFrame, min_len: int = 25) -> DataFrame:
        """Sentences (id, language in three letters, text)."""
        raw = self.spark.read.csv(path, sep="\t", quote="", schema="id long, iso_639_3 string, text string")
        return self._long(raw.join(F.broadcast(iso), "iso_639_3").select("text", F.col("iso_639_1").alias("lang")), min_len)  # a row for each language

    def wili(self, texts: str, labels: str, iso: DataFrame, min_len: int = 25) -> DataFrame:
        """Two parallel files, joined line by line."""
        # numbered in the file's blocks, of which each task reads some
        lines = lambda p, n: numbered(self.spark.read.text(p, lineSep="\n").select(F.col("value").alias(n), F.col("_metadata.file_block_start").alias("_block")), "line", F.col("_block")).drop("_block")
        both = lines(texts, "text").join(lines(labels, "iso_639_3"), "line")
        return self._long(both.join(F.broadcast(iso), "iso_639_3").select("text", F.col("iso_639_1").alias("lang")), min_len)  # a row for each language

    def segments(self, df: DataFrame, *, min_len: int = 25, seed: int | None = None) -> DataFrame:
        """Texts cut at line breaks, or by a seed at random into pieces of 50 to 1000 characters."""
        if seed is None:
            return self._long(df.select(F.explode(F.split("text", r"\n+")).alias("text"), "lang"), min_len)

        @F.pandas_udf("array<string>")
        def pieces(texts: pd.Series, seeds: pd.Series) -> pd.Series:
            from random import Random

            def one(text: str | None, s: int) -> list[str]:
                rng, at, out = Random(int(s)), 0, []
                while text and at < len(text):
                    n = rng.randint(50, 1000)
                    out.append(text[at : at + n])
                    at += n
                return out

            return pd.Series([one(t, s) for t, s in zip(texts, seeds)], dtype=object)

        return self._long(df.select(F.explode(pieces("text", F.xxhash64("text", F.lit(seed)))).alias("text"), "lang"), min_len)

    def ud(self, path: str, langs: Collection[str], min_len: int = 25, pattern: str = r"([a-z]{2,3})_[^/]*\.conllu$") -> DataFrame:
        """The sentences of annotated treebanks, files such as ``de_x-ud-train.conllu``, by the comment lines ``# text = ...``."""
        raw = self.spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.conllu").text(path).where(F.col("value").startswith("# text = "))
        rows = raw.select(F.substring("value", 10, 1 << 30).alias("text"), F.regexp_extract(F.input_file_name(), pattern, 1).alias("lang"))
        return self._long(rows.where(F.col("lang").isin(*langs)), min_len)
