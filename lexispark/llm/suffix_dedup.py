"""Repeated passages by a depth-limited suffix sort.

Suffixes are ordered only through ``THRESHOLD`` tokens, by most-significant-digit passes in which a digit is a run of
tokens in the form of a 64-bit hash; suffixes that end up equal are exactly the windows that repeat.

The first pass has the digit that prunes most: each window's anchor, the least hash among its runs of ``ANCHOR`` tokens.
Equal windows have equal anchors, so a window whose anchor occurs once in the corpus is unlike any other and drops out
before its suffix is made. The passes that follow order what is left: the exchange puts suffixes with the same first
digit into one partition, the sort there orders them by the first and then the last digit, and a suffix that equals
neither neighbour drops out. Windows that repeat inside one batch of texts are known as such before the exchange and send
one representative, so that a hot passage sends one row per batch and not one per occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.llm.common import TOKEN, TOKEN_SQL, LowerHashCache, cut, mix, rank_of, table, text_slices

#: Tokens of a window; two equal windows are a repeated passage.
THRESHOLD = 50
#: Tokens of an anchor.
ANCHOR = 16


def prefix_hashes(h: np.ndarray, depth: int) -> np.ndarray:
    """A hash of the ``depth`` tokens from each place on, put together from hashes of powers of two."""
    n = len(h) - depth + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, block, size = None, 0, h, 1
    with np.errstate(over="ignore"):
        while True:
            if depth & size:
                here = block[done : done + n]
                out = here.copy() if out is None else mix(out * np.uint64(0x9E3779B97F4A7C15) + here)
                done += size
            if done == depth:
                return out
            block = mix(block[: len(block) - size] * np.uint64(0xD6E8FEB86659FD93) + block[size:])
            size *= 2


def window_anchors(h: np.ndarray, threshold: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``threshold`` tokens, the place of its anchor, the first of the least; all anchor hashes."""
    g = prefix_hashes(h, anchor)
    width, n = threshold - anchor + 1, len(h) - threshold + 1
    if n <= 0:
        return np.zeros(0, np.int64), g
    # the least of any width is the lesser of two windows of a power of two
    least, place, size = g, np.arange(len(g)), 1
    while size * 2 <= width:
        right = least[size:] < least[:-size]
        least, place = np.where(right, least[size:], least[:-size]), np.where(right, place[size:], place[:-size])
        size *= 2
    second = slice(width - size, width - size + n)
    return np.where(least[second] < least[:n], place[second], place[:n]), g


class _Tokens:
    """The token hashes of some texts in a row, and which windows lie within one text."""

    def __init__(self, texts: list[str | None], hash_of: LowerHashCache, threshold: int):
        words = [TOKEN.findall(t) if t else () for t in texts]
        n = np.fromiter((len(w) if len(w) >= threshold else 0 for w in words), np.int64, len(words))
        self.begin = np.cumsum(n) - n
        self.h = np.concatenate([np.zeros(0, np.uint64), *(np.fromiter(map(hash_of.__getitem__, w), np.uint64, len(w)) for w in words if len(w) >= threshold)])
        starts = max(0, len(self.h) - threshold + 1)
        self.doc = np.repeat(np.arange(len(texts)), n)
        self.within = self.doc[:starts] == self.doc[threshold - 1 :] if starts else np.zeros(0, bool)


def _anchor_rows(threshold: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = LowerHashCache()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for start, part in text_slices(batch):
                tokens = _Tokens(part, hash_of, threshold)
                place, g = window_anchors(tokens.h, threshold, anchor)
                place = place[tokens.within]
                if len(place):
                    place = place[np.r_[True, place[1:] != place[:-1]]]
                    doc = tokens.doc[place]
                    yield pa.RecordBatch.from_arrays([pa.array(g[place].view(np.int64)), pa.array(keys[start + doc]), pa.array((place - tokens.begin[doc]).astype(np.int32))], names=["anchor", "key", "place"])

    return run


def _suffix_rows(threshold: int, anchor: int):
    """(top, low, key, pos, sent, known): the two digits of each suffix whose anchor repeats; ``sent`` if it takes part in
    the sort, ``known`` if it repeats whatever the sort finds."""
    half = threshold // 2

    def give(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        top, low, key, pos, several = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((low, top))
        new = np.r_[True, (top[order][1:] != top[order][:-1]) | (low[order][1:] != low[order][:-1])]
        first, single = np.empty(len(order), bool), np.empty(len(order), bool)
        first[order], single[order] = new, new & np.r_[new[1:], True]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (top.view(np.int64), low.view(np.int64), key, pos, first, ~single | several)], names=["top", "low", "key", "pos", "sent", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = LowerHashCache()
        for batch in batches:
            keys, places, several = batch.column(0).to_numpy(), batch.column(2), batch.column(3).to_numpy(zero_copy_only=False)
            out, rows = [], 0
            for start, part in text_slices(batch):
                tokens = _Tokens(part, hash_of, threshold)
                place, _ = window_anchors(tokens.h, threshold, anchor)
                if not tokens.within.any():
                    continue
                wanted, here = np.zeros(len(tokens.h), bool), places.slice(start, len(part))
                owner = np.repeat(np.arange(len(part)), here.value_lengths().to_numpy())
                wanted[here.flatten().to_numpy() + tokens.begin[owner]] = True
                at = np.flatnonzero(tokens.within & wanted[place])
                doc = tokens.doc[at]
                out.append((prefix_hashes(tokens.h, half)[at], prefix_hashes(tokens.h, threshold - half)[at + half], keys[start + doc], (at - tokens.begin[doc]).astype(np.int32), several[start + doc]))
                rows += len(at)
                if rows > 1_000_000:
                    yield give(out)
                    out, rows = [], 0
            if rows:
                yield give(out)

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of suffixes in order, those that equal the one before or after; ``known`` ones too, whose equals are elsewhere."""
    held: list | None = None

    def give(rows: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[2][keep]), pa.array(rows[3][keep])], names=["key", "pos"])

    equal_before = False
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if not len(rows[0]):
            continue
        if held is not None:
            rows = [np.concatenate([a, b]) for a, b in zip(held, rows)]
        same = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])
        keep = rows[4] | np.r_[equal_before, same] | np.r_[same, False]
        # the last row waits for what follows
        done = keep[:-1]
        held, equal_before = [x[-1:] for x in rows], bool(same[-1]) if len(same) else equal_before
        if done.any():
            yield give([x[:-1] for x in rows], done)
    if held is not None and (equal_before or held[4][0]):
        yield give(held, np.ones(1, bool))


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, anchor: int = ANCHOR) -> DataFrame:
    """Maximal spans that windows of ``threshold`` tokens cover which occur more than once: (doc_id, tok_start, tok_end, n_windows).

    Tokens are runs of letters and digits, compared in lower case. A window counts as repeated wherever it stands again:
    in another row, also one with the same id, or at another place of its own text; spans of repeated windows that
    overlap or touch are one. ``n_windows`` counts the windows in the span. Null texts and those with fewer tokens than
    ``threshold`` give no rows; each repeated row gives its spans; a null id stays null; other columns aren't read.
    ``anchor`` may not exceed ``threshold``; it changes the cost and never the result.
    """
    if not 2 <= anchor <= threshold:
        raise ValueError("anchor must lie between 2 and threshold")
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).withColumn("key", F.xxhash64("text"))
    anchors = cut(text.select("key", "text").mapInArrow(_anchor_rows(threshold, anchor), "anchor long, key long, place int"))
    often = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    places = anchors.join(often, "anchor", "left_semi").groupBy("key").agg(F.collect_set("place").alias("places"))
    # of equal texts the first stands for all
    rows = text.select("id", "key")
    first = rows.groupBy("key").agg(F.min(rank_of("id")).alias("rank"), (F.count("*") > 1).alias("several"))
    marked = places.join(first, "key").select("key", "places", "rank", "several")
    texts = text.select("key", "text", rank_of("id").alias("own")).join(marked.hint("shuffle_hash"), "key").where(F.col("own").eqNullSafe(F.col("rank")))
    suffixes = cut(texts.select("key", "text", "places", "several").mapInArrow(_suffix_rows(threshold, anchor), "top long, low long, key long, pos int, sent boolean, known boolean"))
    ordered = suffixes.where("sent").select("top", "low", "key", "pos", "known").repartition(F.col("top")).sortWithinPartitions("top", "low")
    found = ordered.mapInArrow(_neighbours, "key long, pos int").unionAll(suffixes.where("known and not sent").select("key", "pos"))
    by = Window.partitionBy("key").orderBy("pos")
    before = F.lag("pos").over(by)
    # a row that stands twice has its windows twice
    marked = found.withColumn("new", F.coalesce((F.col("pos") != before).cast("int"), F.lit(1))).withColumn("b", F.coalesce((F.col("pos") > before + threshold).cast("int"), F.lit(1)))
    spans = marked.withColumn("g", F.sum("b").over(by)).groupBy("key", "g").agg(F.min("pos").alias("tok_start"), (F.max("pos") + threshold).cast("int").alias("tok_end"), F.sum("new").cast("int").alias("n_windows"))
    return rows.join(spans, "key").select(F.col("id").alias("doc_id"), "tok_start", "tok_end", "n_windows")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of 50 tokens or more that repeat anywhere in ``documents``; null and shorter texts have none."""
    return repeated_passages(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH items AS (SELECT row_number() OVER () AS r, doc_id, list_transform(regexp_extract_all(text, '{TOKEN_SQL}'), lambda x: lower(x)) AS m FROM documents WHERE text IS NOT NULL),
windows AS (SELECT r, doc_id, unnest(range(len(m) - {THRESHOLD - 1})) AS pos, m FROM items WHERE len(m) >= {THRESHOLD}),
hashed AS (SELECT r, doc_id, pos, md5(array_to_string(m[pos + 1:pos + {THRESHOLD}], ' ')) AS w FROM windows),
again AS (SELECT r, doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY w) AS n FROM hashed) WHERE n > 1),
marked AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY r ORDER BY pos) + {THRESHOLD} THEN 0 ELSE 1 END AS b FROM again),
grouped AS (SELECT *, sum(b) OVER (PARTITION BY r ORDER BY pos) AS g FROM marked)
SELECT doc_id, min(pos)::INT AS tok_start, (max(pos) + {THRESHOLD})::INT AS tok_end, count(*)::INT AS n_windows
FROM grouped GROUP BY r, doc_id, g
"""
