"""Datasets: whole tables written in the layout of each, loaded and filtered."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.plans.registry import query, table
from lexispark.shared import put, put_lines, scratch, written
from lexispark.sources import datasets

def _md5():
    return F.md5("text").alias("text_md5")



def _docs(spark, sf_dir, **columns: str):
    """Documents with columns by Spark SQL expressions."""
    return table(spark, sf_dir, "documents").selectExpr(*[f"{v} AS {k}" for k, v in columns.items()])


_DAY = "strftime(DATE '{0}' + (doc_id % {1})::INT, '%Y-%m-%d')"
_SPARK_DAY = "date_format(date_add(DATE'{0}', CAST(doc_id % {1} AS INT)), 'yyyy-MM-dd')"


@query(f"""WITH d AS (SELECT doc_id, text, {_DAY.format('1996-01-01', 7400)} AS date, ['D', 'R', 'I', 'X'][doc_id % 4 + 1] AS party, 104 + doc_id % 11 AS congress, ['Senate', 'House'][doc_id % 2 + 1] AS chamber FROM documents)
    SELECT doc_id::VARCHAR AS title, md5(text) AS text_md5 FROM d WHERE party IN ('D', 'R') AND chamber = 'House' AND congress IN (105, 107, 109, 111) AND date >= '1997-02-03' AND date < '2016-06-30' AND length(text) >= 200""")  # fmt: skip
def capitol_words(spark, sf_dir):
    path = scratch(spark)
    _docs(spark, sf_dir, text="text", title="CAST(doc_id AS STRING)", date=_SPARK_DAY.format("1996-01-01", 7400), speaker_name="source", speaker_party="element_at(array('D', 'R', 'I', 'X'), CAST(doc_id % 4 + 1 AS INT))", congress="CAST(104 + doc_id % 11 AS INT)", chamber="element_at(array('Senate', 'House'), CAST(doc_id % 2 + 1 AS INT))").write.json(path)
    found = datasets.CapitolWords(spark, path).records(speaker_party={"D", "R"}, chamber="House", congress=(105, 107, 109, 111), date_range=("1997-02-03", None), min_len=200)
    return found.select("title", _md5())


@query(f"""WITH d AS (SELECT doc_id, text, {_DAY.format('1946-11-18', 25000)} AS date, doc_id % 5 AS author, (doc_id % 14 + 1) AS area, ['conservative', 'liberal', 'unspecifiable'][doc_id % 3 + 1] AS way FROM documents)
    SELECT doc_id::VARCHAR AS case_name, md5(text) AS text_md5, CASE area WHEN 1 THEN 'Criminal Procedure' WHEN 4 THEN 'Due Process' ELSE 'Judicial Power' END AS issue_area_name
    FROM d WHERE way IN ('liberal', 'conservative') AND area IN (1, 4, 9) AND author IN (1, 2, 3) AND date >= '1950-01-01' AND date < '2010-01-01'""")  # fmt: skip
def supreme_court(spark, sf_dir):
    path = scratch(spark)
    _docs(spark, sf_dir, text="text", case_name="CAST(doc_id AS STRING)", decision_date=_SPARK_DAY.format("1946-11-18", 25000), decision_direction="element_at(array('conservative', 'liberal', 'unspecifiable'), CAST(doc_id % 3 + 1 AS INT))", maj_opinion_author="CAST(doc_id % 5 AS INT)", issue_area="CAST(doc_id % 14 + 1 AS INT)").write.json(path)
    cases = datasets.SupremeCourt(spark, path)
    found = cases.records(opinion_author={1, 2, 3}, decision_direction=("liberal", "conservative"), issue_area=(1, 4, 9), date_range=("1950-01-01", "2010-01-01"))
    return cases.with_issue_names(found).select("case_name", _md5(), "issue_area_name")


def _items(spark, sf_dir) -> list:
    """The benchmark's items, which files are made of one by one."""
    return table(spark, sf_dir, "benchmark").orderBy("item_id").collect()  # a benchmark's size


@query("""WITH d AS (SELECT item_id, text, ['train', 'test'][item_id % 2 + 1] AS subset, ['pos', 'neg', 'unsup'][item_id % 3 + 1] AS label, item_id % 10 + 1 AS rating FROM benchmark)
    SELECT subset, label, CASE WHEN label <> 'unsup' THEN rating END::INT AS rating, 'tt' || (1000 + item_id) AS movie_id, md5(text || chr(10) || 'end') AS text_md5 FROM d WHERE label <> 'unsup' AND rating >= 3""")  # fmt: skip
def imdb(spark, sf_dir):
    path, urls = scratch(spark), {}
    for r in _items(spark, sf_dir):
        i, subset, label = r["item_id"], ("train", "test")[r["item_id"] % 2], ("pos", "neg", "unsup")[r["item_id"] % 3]
        lines = urls.setdefault((subset, label), [])
        put(spark, f"{path}/{subset}/{label}/{len(lines)}_{i % 10 + 1}.txt", (r["text"] + "<br />end").encode())
        lines.append(f"http://www.imdb.com/title/tt{1000 + i}/usercomments")
    for (subset, label), lines in urls.items():
        put(spark, f"{path}/{subset}/urls_{label}.txt", "\n".join(lines).encode())
    found = datasets.IMDB(spark, path).records(label=("pos", "neg"), rating_range=(3, None), min_len=1)
    return found.select("subset", "label", "rating", "movie_id", _md5())


@query("""WITH d AS (SELECT doc_id, regexp_replace(text, '[^\\p{L}\\p{N} .,]+', ' ', 'g') AS text, 1262304000 + doc_id * 3600 AS sec, doc_id % 50 - 10 AS score FROM documents)
    SELECT doc_id::VARCHAR AS subreddit, strftime(to_timestamp(sec) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS created_utc, score::INT AS score, md5('a > b & c ' || regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '^ | $', '', 'g') || ' link') AS text_md5
    FROM d WHERE score >= 0 AND sec >= 1262304000 + 5 * 86400""")  # fmt: skip
def reddit_comments(spark, sf_dir):
    """By month, with marks and entities that cleaning resolves; a range of dates prunes the months."""
    path = scratch(spark)
    body = "concat('**a** &gt; b &amp; `c`  ', trim(regexp_replace(text, '[^\\\\p{L}\\\\p{N} .,]+', ' ')), ' [link](http://a.example/b)')"
    rows = _docs(spark, sf_dir, body=body, created_utc="CAST(1262304000 + doc_id * 3600 AS STRING)", retrieved_on="'x'", subreddit="CAST(doc_id AS STRING)", score="CAST(doc_id % 50 - 10 AS INT)", gilded="0")
    rows = rows.withColumn("month", F.date_format(F.timestamp_seconds(F.col("created_utc").cast("long")), "yyyy-MM"))
    # written in one pass, a folder for each month, which then gets its name
    made = scratch(spark)
    rows.write.partitionBy("month").json(made, compression="bzip2")
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(made).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in [s.getPath() for s in fs.listStatus(at(made)) if s.getPath().getName().startswith("month=")]:
        month = folder.getName().removeprefix("month=")
        fs.mkdirs(at(f"{path}/{month[:4]}"))
        if not fs.rename(folder, at(f"{path}/{month[:4]}/RC_{month}.bz2")):
            raise OSError(f"the month {month} can't be written")
    comments = datasets.RedditComments(spark, path)
    everything = comments.records(score_range=(0, None))
    last = rows.agg(F.max("month")).first()[0]
    months = comments.months(("2010-01-01", last + "-28"))
    if months[0] != "2010/RC_2010-01" or months[-1] != f"{last[:4]}/RC_{last}":
        raise RuntimeError("a range of dates names its months")
    return everything.where("created_utc >= '2010-01-06T00:00:00'").select("subreddit", "created_utc", "score", F.md5("body").alias("text_md5"))


@query("""SELECT item_id::VARCHAR AS id, 'Work ' || item_id AS title, 'Doe, J ' || item_id % 7 || '|Roe, R' AS authors, (1500 + item_id % 400)::VARCHAR AS year, md5(text) AS text_md5 FROM benchmark WHERE item_id % 5 <> 0 AND 1500 + item_id % 400 >= 1510""")
def oxford_text_archive(spark, sf_dir):
    path, rows = scratch(spark), ["ID\tTitle\tAuthor\tYear\tLanguage"]
    for r in _items(spark, sf_dir):
        i = r["item_id"]
        put(spark, f"{path}/text/{i}.txt", r["text"].encode())
        rows.append(f"{i}\tWork {i}\tDoe, J {i % 7}; Roe, R, 1550-1601 (editor)\t[c. {1500 + i % 400}]\t{'English' if i % 5 else 'Latin'}")
    put(spark, f"{path}/metadata.tsv", "\n".join(rows).encode())
    found = datasets.OxfordTextArchive(spark, path).records(author="Roe, R", date_range=("1510", None), min_len=1)
    return found.select("id", "title", F.array_join("author", "|").alias("authors"), "year", _md5())


_LANGS = ("de", "en", "es", "fr")


@query("SELECT ['de', 'en', 'es', 'fr'][item_id % 4 + 1] AS lang, 'L' || item_id % 4 AS lang_name, 'udhr_' || item_id || '.txt' AS filename, md5(text || chr(10) || 'second line') AS text_md5 FROM benchmark WHERE item_id % 4 IN (0, 3) AND item_id % 3 <> 0")
def udhr(spark, sf_dir):
    path, rows = scratch(spark), []
    for r in _items(spark, sf_dir):
        i = r["item_id"]
        put(spark, f"{path}/udhr_{i}.txt", f"Header of {i}\n---\n\n   {r['text']}\n\n  second   line\n".encode())
        rows.append(f'<udhr f="{i}" n="L{i % 4}" bcp47="{_LANGS[i % 4]}" stage="{i % 3 and 4 or 2}"/>')
    put(spark, f"{path}/index.xml", f"<udhrs>{chr(10).join(rows)}</udhrs>".encode())
    return datasets.UDHR(spark, path).records(lang=("de", "fr")).select("lang", "lang_name", "filename", _md5())


def _dump(spark, sf_dir) -> str:
    """Pairs of lines, an index line and a source line, as they stand in the dump of a search index."""
    path = scratch(spark)
    pages = _docs(
        spark, sf_dir, title="concat('Page ', doc_id)", text="text", namespace="CAST(doc_id % 10 = 9 AS INT)", heading="array(lang)", outgoing_link="array(concat('Page ', doc_id + 1), 'Category:x')", external_link="array('http://a.example/')",
        category="array(concat('Lang ', lang), 'All articles of a kind')", create_timestamp="'2020-01-01T00:00:00Z'", incoming_links="doc_id", popularity_score="CAST(0.5 AS DOUBLE)", doc_id="doc_id",
    )
    fields = [c for c in pages.columns if c != "doc_id"]
    pages.select(F.concat(F.lit('{"index":{"_type":"page","_id":"'), F.col("doc_id").cast("string"), F.lit('"}}\n'), F.to_json(F.struct(*fields))).alias("value")).write.text(path, compression="gzip")
    return path


_PAGES = """SELECT doc_id::VARCHAR AS page_id, 'Page ' || doc_id AS title, 'Page ' || (doc_id + 1) AS links, 'Lang ' || lang AS categories, lang AS headings, doc_id AS n_incoming_links, md5(text) AS text_md5 FROM documents WHERE doc_id % 10 <> 9"""
def _page_fields():
    return ("page_id", "title", F.array_join("wiki_links", "|").alias("links"), F.array_join("categories", "|").alias("categories"), F.array_join("headings", "|").alias("headings"), "n_incoming_links", _md5())



@query(_PAGES + " AND lang = 'en' AND length(text) >= 300")
def wikipedia(spark, sf_dir):
    return datasets.Wikipedia(spark, _dump(spark, sf_dir)).records(category="Lang en", min_len=300).select(*_page_fields())


@query(_PAGES + " AND doc_id % 100 IN (1, 7)")
def wikinews(spark, sf_dir):
    path = _dump(spark, sf_dir)
    wanted = [f"Page {r['i']}" for r in table(spark, sf_dir, "documents").where("doc_id % 100 IN (1, 7)").select((F.col("doc_id") + 1).alias("i")).collect()]
    return datasets.Wikinews(spark, path).records(wiki_link=wanted).select(*_page_fields())


# ---- texts with their languages

_LONG = "len(regexp_extract_all(text, '[\\p{L}\\p{N}]')) >= 25"
#: The documents as single lines without tabs.
_FLAT = "SELECT doc_id, lang, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents"
_THREE = {"de": "deu", "en": "eng", "es": "spa", "fr": "fra"}


def _flat(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.trim(F.regexp_replace("text", r"[\t\n\x0B\f\r ]+", " ")).alias("text"))


def _iso(spark):
    path = scratch(spark)
    put(spark, path, ("Id\tPart1\n" + "".join(f"{t}\t{x}\n" for x, t in _THREE.items()) + "xxx\t\nlat\tla\n").encode())
    return datasets.LangIdData(spark).iso_langs(path, exclude=("la",))


@query("SELECT unnest(['deu', 'eng', 'spa', 'fra']) AS iso_639_3, unnest(['de', 'en', 'es', 'fr']) AS iso_639_1")
def iso_languages(spark, sf_dir):
    return _iso(spark)


@query(f"SELECT DISTINCT md5(text) AS text_md5, lang FROM ({_FLAT}) WHERE lang IN ('de', 'fr') AND {_LONG}")
def dslcc(spark, sf_dir):
    path = scratch(spark)
    _flat(spark, sf_dir).select("text", F.concat("lang", F.lit("-X"))).write.csv(path, sep="\t", quote="")
    return datasets.LangIdData(spark).dslcc(path, ("de", "fr")).select(_md5(), "lang")


@query(f"SELECT md5(text) AS text_md5, lang, kind FROM ({_FLAT}), (SELECT unnest(['setimes', 'ted2020']) AS kind) WHERE lang IN ('de', 'en', 'fr') AND {_LONG}")
def translated_news_and_talks(spark, sf_dir):
    rows, path = _flat(spark, sf_dir), scratch(spark)
    for lang in _LANGS:
        put_lines(rows.where(F.col("lang") == lang).select("text"), f"{path}/news.en-{lang}.{lang}.txt")
    data = datasets.LangIdData(spark)
    found = [f(path, ("de", "en", "fr")).withColumn("kind", F.lit(k)) for k, f in (("setimes", data.setimes), ("ted2020", data.ted2020))]
    return found[0].unionAll(found[1]).select(_md5(), "lang", "kind")


@query(f"SELECT md5(text) AS text_md5, lang FROM ({_FLAT}) WHERE {_LONG}")
def tatoeba(spark, sf_dir):
    path = scratch(spark)
    three = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in _THREE.items()])
    _flat(spark, sf_dir).select("doc_id", three, "text").write.csv(path, sep="\t", quote="")
    return datasets.LangIdData(spark).tatoeba(path, _iso(spark)).select(_md5(), "lang")


@query(f"SELECT md5(text) AS text_md5, lang FROM ({_FLAT}) WHERE {_LONG}")
def wili(spark, sf_dir):
    path = scratch(spark)
    three = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in _THREE.items()])
    # read twice, so that both files have the same order
    rows = written(_flat(spark, sf_dir).select("text", three.alias("label")))
    put_lines(rows.select("text"), f"{path}/x.txt")
    put_lines(rows.select("label"), f"{path}/y.txt")
    return datasets.LangIdData(spark).wili(f"{path}/x.txt", f"{path}/y.txt", _iso(spark)).select(_md5(), "lang")


@query(f"SELECT md5(text) AS text_md5, lang FROM ({_FLAT}) WHERE lang IN ('es', 'fr') AND {_LONG}")
def universal_dependencies(spark, sf_dir):
    rows, path = _flat(spark, sf_dir), scratch(spark)
    sentence = F.concat(F.lit("# sent_id = "), F.col("doc_id").cast("string"), F.lit("\n# text = "), "text", F.lit("\n1\tx\tx\tX\t_\t_\t0\troot\t_\t_\n"))
    for lang in _LANGS:
        put_lines(rows.where(F.col("lang") == lang).select(sentence.alias("text")), f"{path}/UD/{lang}_given-ud-train.conllu")
    return datasets.LangIdData(spark).ud(path, ("es", "fr")).select(_md5(), "lang")


@query(f"SELECT md5(text) AS text_md5, lang FROM (SELECT lang, unnest(regexp_split_to_array(text, chr(10) || '+')) AS text FROM documents) WHERE {_LONG}")
def text_segments(spark, sf_dir):
    return datasets.LangIdData(spark).segments(table(spark, sf_dir, "documents")).select(_md5(), "lang")
