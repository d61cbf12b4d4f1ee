"""Batches that Python workers take apart, so that their memory doesn't follow the number of rows of a batch."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from lexispark.functions.columns import PORTION, portions
from lexispark.functions.tokens import annotate
from lexispark.operators import augment
from lexispark.operators.extract import plain, token_matches


def test_portions_are_bounded_and_whole():
    texts = pa.array(["a" * 40, None, "", "b" * 70, "c" * 300, "d"])
    parts = list(portions(texts, pa.array(range(6)), most=100))
    assert [len(t) for t, _ in parts] == [3, 1, 1, 1]
    assert [x for t, _ in parts for x in t.to_pylist()] == texts.to_pylist() and [x for _, k in parts for x in k.to_pylist()] == list(range(6))
    assert [len(t) for (t,) in portions(texts.slice(0, 0))] == [0]


def test_a_slice_of_structs_is_its_own():
    rows = [[{"a": 1, "b": "x"}], None, [], [{"a": 2, "b": None}, {"a": 3, "b": "z"}]]
    whole = pa.array(rows, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.string())])))
    assert plain(whole.slice(1)) == rows[1:] and plain(whole.slice(0, 2)) == rows[:2]


def test_documents_of_several_portions_in_one_batch(spark):
    """One batch has more text than a worker takes at once; each document keeps its own tokens, matches and variation."""
    text = "licensed by nobody 12 . " * (PORTION // 40)
    df = spark.range(8).coalesce(1).select(F.col("id").alias("doc_id"), F.when(F.col("id") != 3, F.concat(F.col("id").cast("string"), F.lit(" license "), F.lit(text))).alias("text"))
    made = annotate(df).withColumn("m", token_matches("tokens", "LOWER:license")).withColumn("aug_toks", augment.to_aug_toks("tokens"))
    out = augment.Augmenter(["delete_chars"]).apply_transforms(made, seed=1).selectExpr("doc_id", "tokens[0].text AS first", "size(tokens) AS n", "m[0].start AS start", "length(augmented) AS length").orderBy("doc_id").collect()
    n = 2 + 5 * (PORTION // 40)
    assert [(r["first"], r["n"], r["start"]) for r in out if r["doc_id"] != 3] == [(str(i), n, 1) for i in range(8) if i != 3]
    assert all((r["length"] is None) == (r["doc_id"] == 3) for r in out) and out[3]["first"] is None
