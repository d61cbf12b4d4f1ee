"""Files of any size: written by many tasks, read in blocks, and sent bit by bit."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark import shared
from lexispark.sources import datasets


def test_lines_of_many_tasks_in_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "CHUNK", 1000)
    shared.put_lines(spark.range(0, 5000, 1, 7).select(F.col("id").cast("string").alias("value")), f"{tmp_path}/a/x.txt")
    assert (tmp_path / "a/x.txt").read_text().split("\n") == [*map(str, range(5000)), ""]
    content = bytes(range(256)) * 40
    shared.put(spark, f"{tmp_path}/b", content)
    assert shared.got(spark, f"{tmp_path}/b") == content


def test_no_task_writes_all_lines(spark, tmp_path, monkeypatch):
    """The largest task of a file's rows has its own partition alone."""
    seen = spark.sparkContext.accumulator(0)
    most = spark.range(0, 4000, 1, 4).select(F.col("id").cast("string").alias("value"))

    def count(batches):
        seen.add(1)
        yield from batches

    shared.put_lines(most.mapInPandas(count, "value string"), f"{tmp_path}/x.txt")
    assert seen.value == 4
    plans = []
    real = spark.createDataFrame([("a",)], "value string")
    monkeypatch.setattr(type(real), "coalesce", lambda *a: plans.append(a) or real)
    shared.put_lines(most, f"{tmp_path}/y.txt")
    assert not plans


def test_parallel_files_in_blocks(spark, tmp_path):
    """Lines meet across files that are read in blocks; a carriage return ends no line."""
    rows = [(f"text number {i} of many\rwith letters enough for it", ("eng", "deu")[i % 2]) for i in range(3000)]
    for k, name in enumerate("xy"):
        with open(tmp_path / f"{name}.txt", "w", newline="") as file:
            file.write("".join(r[k] + "\n" for r in rows))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        iso = spark.createDataFrame([("eng", "en"), ("deu", "de")], "iso_639_3 string, iso_639_1 string")
        assert spark.read.text(f"{tmp_path}/x.txt").rdd.getNumPartitions() > 3
        found = sorted((r["text"], r["lang"]) for r in datasets.LangIdData(spark).wili(f"{tmp_path}/x.txt", f"{tmp_path}/y.txt", iso).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert found == sorted((t, {"eng": "en", "deu": "de"}[x]) for t, x in rows)
