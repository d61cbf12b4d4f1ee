"""Files, datasets and streams."""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.sources import datasets, files
from lexispark.streaming import clean, read_texts, word_counts, write_parquet
from lexispark.functions.normalize import quotation_marks


@pytest.mark.parametrize("suffix", ["", ".gz", ".bz2", ".xz", ".zip"])
def test_compressed_text(spark, tmp_path, suffix):
    path = str(tmp_path / f"a.txt{suffix}")
    with files.open_sesame(path, mode="wb") as f:
        f.write("one\ntwo é\n".encode())
    with files.open_sesame(path, mode="rt", encoding="utf-8") as f:
        assert f.read() == "one\ntwo é\n"
    assert [r["text"] for r in files.read_text(spark, path).collect()] == ["one\ntwo é\n"]
    assert [r["text"] for r in files.read_text(spark, path, lines=True, keep_newlines=True).collect()] == ["one\n", "two é\n"]
    with pytest.raises(OSError):
        files.open_sesame(str(tmp_path / "none"))


def test_json(spark, tmp_path):
    df = spark.createDataFrame([(2, "é"), (1, None)], "b int, a string")
    files.write_json(df, str(tmp_path / "j"), compression="gzip")
    assert sorted(tuple(r) for r in files.read_json(spark, str(tmp_path / "j"), lines=True, schema="b int, a string").collect()) == [(1, None), (2, "é")]
    (tmp_path / "m.json").write_text('{"a": 1}{"a": [2, "x}{"]} 3\n"s"')
    assert [json.loads(r["value"]) for r in files.read_json_mash(spark, str(tmp_path / "m.json")).collect()] == [{"a": 1}, {"a": [2, "x}{"]}, 3, "s"]
    (tmp_path / "d.json").write_text('{"a":\n 1}')
    assert files.read_json(spark, str(tmp_path / "d.json")).first()["a"] == 1
    assert df.select(files.to_json_document(df, sort_keys=True).alias("j")).first()["j"] == '{"a":"é","b":2}'


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,n\n"x, y",1\nz,2.5\n')
    found = files.read_csv(spark, str(tmp_path / "a.csv"), fieldnames=["name", "n"])
    assert [tuple(r) for r in found.collect()] == [("x, y", 1.0), ("z", 2.5)]
    (tmp_path / "b.csv").write_text("name;n\nx;1\ny;2\n")
    assert files.read_csv(spark, str(tmp_path / "b.csv"), dialect="infer").columns == ["name", "n"]
    files.write_csv(found, str(tmp_path / "c"), header=True)
    assert files.read_csv(spark, str(tmp_path / "c"), schema="name string, n double").where("name <> 'name'").count() == 2


def test_matrix(spark, tmp_path):
    cells = spark.createDataFrame([(0, 1, 2.0), (2, 0, 1.5)], "row long, col long, value double")
    files.write_sparse_matrix(cells, str(tmp_path / "m.npz"), npz=True)
    assert sorted(map(tuple, files.read_sparse_matrix(spark, str(tmp_path / "m.npz")).collect())) == [(0, 1, 2.0), (2, 0, 1.5)]
    np.savez(tmp_path / "c.npz", data=np.array([5.0]), indices=np.array([3]), indptr=np.array([0, 0, 1]), shape=np.array([4, 2]))
    assert [tuple(r) for r in files.read_sparse_matrix(spark, str(tmp_path / "c.npz"), kind="csc").collect()] == [(3, 1, 5.0)]


def test_paths_and_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a.txt", "b.md", ".c.txt", "in/d.txt"):
        (tmp_path / n).write_text("x")
    names = lambda **o: [r["path"].rsplit("/", 1)[1] for r in files.get_filepaths(spark, str(tmp_path), **o).collect()]
    assert names(extension=".txt") == ["a.txt"] and names(extension=".txt", recursive=True) == ["a.txt", "d.txt"] and names(match_regex="^b") == ["b.md"] and names(ignore_regex="a") == ["b.md"]
    df = spark.createDataFrame([("https://x.org/a%20b/c%2Ed.zip?q=1", 1)], "url string, n int")
    assert df.select(files.get_filename_from_url(F.col("url")).alias("f")).first()["f"] == "c.d.zip"
    assert [tuple(r) for r in files.split_records(df, "url").collect()][0][1]["n"] == 1 and len(files.unzip(df)) == 2
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("root/x.txt", "1")
    assert files.unpack_archive(str(tmp_path / "z.zip")).endswith("z/root")


def test_speeches(spark, tmp_path):
    rows = [("short", "t", "1999-01-01", "A", "D", 106, "Senate"), ("a longer speech", "t", "2005-05-05", "B", "R", 109, "House"), ("another long one", "t", "2005-05-06", "B", "R", 109, "House")]
    names = [f.split()[0] for f in datasets.CapitolWords.schema.split(", ")]
    with gzip.open(tmp_path / "c.json.gz", "wt") as f:
        f.writelines(json.dumps(dict(zip(names, r))) + "\n" for r in rows)
    data = datasets.CapitolWords(spark, str(tmp_path / "c.json.gz"))
    assert data.records(speaker_name="B").count() == 2 and data.records(date_range=("2005-05-05", "2005-05-06")).count() == 1 and data.texts(min_len=6, limit=1).columns == ["text"]
    assert data.records(congress={106, 109}, chamber=["House"], date_range=(None, "2010-01-01")).count() == 2
    for bad in ({"speaker_party": "X"}, {"min_len": 0}, {"congress": 1}):
        with pytest.raises(ValueError):
            data.records(**bad)


def test_reviews(spark, tmp_path):
    for name, text in {"train/pos/0_9.txt": "good<br />film", "train/neg/1_2.txt": "bad", "train/unsup/0_0.txt": "none", "train/urls_pos.txt": "http://x/title/tt01/\n", "train/urls_neg.txt": "http://x/title/tt05/\nhttp://x/title/tt06/\n", "train/urls_unsup.txt": "http://x/title/tt09/"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    data = datasets.IMDB(spark, str(tmp_path))
    found = {r["label"]: (r["text"], r["rating"], r["movie_id"]) for r in data.records().collect()}
    assert found == {"pos": ("good\nfilm", 9, "tt01"), "neg": ("bad", 2, "tt06"), "unsup": ("none", None, "tt09")}
    assert data.records(rating_range=(1, 5)).count() == 1


def test_comments(spark, tmp_path):
    (tmp_path / "2010").mkdir()
    rows = [{"body": "[a](http://b) &gt; *c*", "created_utc": "1264982400", "subreddit": "s", "score": 0, "gilded": 0}, {"body": "x", "created_utc": "bad", "subreddit": "t", "score": 5, "gilded": 0}]
    with bz2.open(tmp_path / "2010" / "RC_2010-02.bz2", "wt") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    data = datasets.RedditComments(spark, str(tmp_path))
    got = {r["body"]: r["created_utc"] for r in data.records().collect()}
    assert got == {"a > c": "2010-02-01T00:00:00", "x": ""}
    assert data.records(score_range=(0, 5)).count() == 1 and data.records(date_range=("2010-02-01", "2010-03-01")).count() == 1
    assert data.months(("2010-11-15", "2011-01-01")) == ["2010/RC_2010-11", "2010/RC_2010-12"]


def test_works_declarations_and_pages(spark, tmp_path):
    (tmp_path / "text").mkdir()
    (tmp_path / "text" / "1.txt").write_text("whole work")
    (tmp_path / "metadata.tsv").write_text("ID\tTitle\tAuthor\tYear\tLanguage\n1\tT\tDoe, Jane, 1800-1870; Roe, Max\tc1850\tEnglish\n2\tU\tX\t1900\tGerman\n")
    ota = datasets.OxfordTextArchive(spark, str(tmp_path))
    row = ota.records(author="Doe, Jane").first()
    assert row["year"] == "1850" and row["author"] == ["Doe, Jane", "Roe, Max"] and ota.records(date_range=("1900", None)).count() == 0
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "udhr_eng.txt").write_text("header\n---\n\n  All  human \n beings\n")
    (tmp_path / "u" / "index.xml").write_text('<udhrs><udhr l="eng" n="English" f="eng" bcp47="en" stage="4"/><udhr l="x" n="X" f="x" bcp47="x-y" stage="4"/></udhrs>')
    assert [tuple(r) for r in datasets.UDHR(spark, str(tmp_path / "u")).records(lang="en").collect()] == [("All human\nbeings", "en", "English", "udhr_eng.txt")]
    lines = [{"index": {"_id": "7"}}, {"namespace": 0, "title": "T", "text": "body", "category": ["A", "All articles x"], "outgoing_link": ["L", "File:x"], "incoming_links": 3}, {"index": {"_id": "8"}}, {"namespace": 1, "title": "U", "text": "talk"}]
    with gzip.open(tmp_path / "w.json.gz", "wt") as f:
        f.writelines(json.dumps(x) + "\n" for x in lines)
    wiki = datasets.Wikipedia(spark, str(tmp_path / "w.json.gz"))
    assert [(r["page_id"], r["categories"], r["wiki_links"]) for r in wiki.records(category={"A", "B"}).collect()] == [("7", ["A"], ["L"])] and wiki.records(wiki_link="Q").count() == 0


def test_language_data(spark, tmp_path):
    data = datasets.LangIdData(spark)
    (tmp_path / "iso.tsv").write_text("Id\tPart1\neng\ten\ndeu\tde\nxxx\t\n")
    iso = data.iso_langs(str(tmp_path / "iso.tsv"))
    assert iso.count() == 2
    (tmp_path / "t.tsv").write_text("1\teng\tA sentence that is long enough to keep\n2\tdeu\tkurz\n")
    assert [tuple(r) for r in data.tatoeba(str(tmp_path / "t.tsv"), iso).collect()] == [("A sentence that is long enough to keep", "en")]
    (tmp_path / "x.txt").write_text("first text of some length here\nzweiter Text von einiger Länge\n")
    (tmp_path / "y.txt").write_text("eng\ndeu\n")
    assert {r["lang"] for r in data.wili(str(tmp_path / "x.txt"), str(tmp_path / "y.txt"), iso, 10).collect()} == {"en", "de"}
    df = spark.createDataFrame([("a" * 3000, "en")], "text string, lang string")
    assert data.segments(df, seed=1).count() > 2 and data.segments(df).count() == 1
    with lzma.open(tmp_path / "k.xz", "wt") as f:
        f.write("k")


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"ts": "2020-01-01T00:00:00Z", "text": "“a” b a"}\n')
    stream = clean(read_texts(spark, str(tmp_path / "in"), "ts timestamp, text string"), quotation_marks)
    write_parquet(stream, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["text"] == '"a" b a'
    query = word_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["word"]: r["count"] for r in spark.table("counted").collect()} == {"a": 2, "b": 1}
