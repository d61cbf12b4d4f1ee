"""Functions of one text that run in Python."""

from __future__ import annotations

from lexispark.functions import columns, normalize, remove


def test_python_takes_portions_of_a_batch(spark):
    """A batch of several portions; nulls and empty texts stay as they are."""
    texts = [None, "", "\u00e9t\u00e9 " * 40_000, "plain", *[f"na\u00efve {i} " * 20_000 for i in range(8)], "e\u0301"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    found = df.select("i", remove.accents("t", fast=True).alias("a"), columns.by_text(str.upper)(df["t"]).alias("u"), normalize.unicode("t").alias("n")).orderBy("i").collect()
    assert [r["a"] for r in found] == [None if t is None else t.replace("\u00e9", "e").replace("\u00ef", "i").replace("\u0301", "") for t in texts]
    assert [r["u"] for r in found] == [None if t is None else t.upper() for t in texts]
    assert found[-1]["n"] == "\u00e9" and found[0]["n"] is None
    assert sum(len(t.encode()) for t in texts if t) > columns.PORTION * 16


def test_char_trigrams_need_no_python(spark, sf):
    from lexispark.plans.registry import QUERIES

    plan = QUERIES["char_trigrams"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
