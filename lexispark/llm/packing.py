"""Packing of documents into sequences by length patterns and non-negative least squares.

Lengths are rounded up to ``BINS`` classes. A pattern is a few classes that together fill a sequence; how often each is
repeated is fitted to the histogram of classes by non-negative least squares and rounded down to what the histogram
has. What remains of the histogram is packed best-fit, class by class, so that all patterns together use up the
histogram exactly. This plan depends on the histogram alone and its size on ``BINS`` alone; each piece then reads its
place off the plan by its rank among the pieces of its class: its number in its partition, behind those of the partitions
before. Texts are encoded once, token ids are written in two bytes each, and those of pieces that share a sequence are shuffled
once, to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.llm.chat import VOCABULARY, encoder
from lexispark.llm.common import SLICE, cut, table, text_slices, tidy

#: Tokens of a sequence.
SEQ_TOKENS = 2048
#: Classes of length; a sequence has room for BINS classes' worth.
BINS = 128
#: Pieces of a pattern at most.
PATTERN_PIECES = 3
#: Rows of numbers before each partition, of some twenty bytes each, that are broadcast at most.
BROADCAST_ROWS = 1_000_000
#: The id that the vocabulary leaves free, behind each document.
END_OF_TEXT = 50256


@cache
def patterns(bins: int, pieces: int) -> np.ndarray:
    """All ways to fill ``bins`` exactly with at most ``pieces`` lengths, as rows of counts for lengths 1..bins."""
    found = []

    def extend(chosen: list[int], rest: int, most: int) -> None:
        if not rest:
            row = np.zeros(bins, np.int16)
            for x in chosen:
                row[x - 1] += 1
            found.append(row)
        elif len(chosen) < pieces:
            for x in range(min(rest, most), 0, -1):
                extend([*chosen, x], rest - x, x)

    extend([], bins, bins)
    return np.array(found)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 of least |a x - b|, by active sets."""
    m, n = a.shape
    x, passive = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, np.abs(b).max(initial=0)) * max(1.0, np.abs(a).sum(0).max(initial=0))
    for _ in range(rounds or 3 * m):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        j = int(np.argmax(gradient))
        if gradient[j] <= tolerance:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            trial = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (trial > 0).all():
                x[:] = 0
                x[at] = trial
                break
            low = trial <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - trial[low], 1e-300))
            x[at] += step * (trial - x[at])
            passive[at[x[at] <= 1e-12 * max(1.0, x.max())]] = False
            passive[at[low & (x[at] <= 1e-9)]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def plan(histogram: np.ndarray, pieces: int = PATTERN_PIECES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns, as descending lengths, with how often each is used; together they use up the histogram exactly.

    ``histogram[i]`` counts the pieces of length i + 1, of len(histogram) at most.
    """
    bins = len(histogram)
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left.sum():
        every = patterns(bins, pieces)
        # long pieces are hard to place, so that their misfit weighs more
        weight = np.sqrt(np.arange(1, bins + 1))
        scale = max(1, left.max())
        # a pattern of one full piece is exact; the rest is fitted
        times = nnls((every * weight).T.astype(float), left / scale * weight) * scale
        for i in np.argsort(-times, kind="stable"):
            row, n = every[i].astype(np.int64), int(round(times[i]))
            used = np.flatnonzero(row)
            n = min([n, *(left[used] // row[used])])
            if n > 0:
                left[used] -= n * row[used]
                out.append((tuple(int(x) for x in np.repeat(used, row[used])[::-1] + 1), n))
    # the rest: best fit, longest first, many equal ones at a time
    open_: dict[tuple[int, ...], int] = {}
    for size in range(bins, 0, -1):
        todo = int(left[size - 1])
        while todo:
            fitting = [p for p in open_ if sum(p) + size <= bins]
            if fitting:
                best = max(fitting, key=lambda p: (sum(p), p))
                n = min(todo, open_[best])
                open_[best] -= n
                if not open_[best]:
                    del open_[best]
                grown = (*best, size)
            else:
                per = bins // size
                # as many full rows of this size as can be, and one with the rest
                n, grown = (todo // per, (size,) * per) if todo >= per else (1, (size,) * todo)
                open_[grown] = open_.get(grown, 0) + n
                todo -= n * len(grown)
                continue
            open_[grown] = open_.get(grown, 0) + n
            todo -= n
    return out + sorted(open_.items())


def _places(plan_: list[tuple[tuple[int, ...], int]], bins: int) -> list[tuple[np.ndarray, ...]]:
    """For each length: ranks at which an entry begins, its first sequence, its slot, and whether the sequence holds no other piece."""
    rows: list[list[tuple[int, int, int, int]]] = [[] for _ in range(bins)]
    ranks, sequence = [0] * bins, 0
    for lengths, n in plan_:
        for slot, size in enumerate(lengths):
            rows[size - 1].append((ranks[size - 1], sequence, slot, len(lengths) == 1))
            ranks[size - 1] += n
        sequence += n
    return [tuple(np.array(r, np.int64).reshape(-1, 4).T) for r in rows]


def _pieces(vocabulary, end_token: int | None, seq_tokens: int, unit: int, bins: int):
    """(part, bin, k, doc_id, piece, n, ids) of the texts; k numbers the pieces of a class in their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, part, made = encoder(vocabulary.value), TaskContext.get().partitionId(), np.zeros(bins + 1, np.int64)
        kind = np.uint16 if max(encoding.n_vocab, (end_token or 0) + 1) <= 1 << 16 else np.uint32
        tail = [] if end_token is None else [end_token]
        for batch in batches:
            for start, texts in text_slices(batch):
                row, piece, size, ids = [], [], [], []
                for i, text in enumerate(texts, start):
                    if not text:
                        continue
                    tokens = np.array(encoding.encode_ordinary(text) + tail, kind)
                    for p, at in enumerate(range(0, len(tokens), seq_tokens)):
                        own = tokens[at : at + seq_tokens]
                        row.append(i)
                        piece.append(p)
                        size.append(len(own))
                        ids.append(own.tobytes())
                if not row:
                    continue
                n = np.array(size, np.int32)
                b = -(-n // unit)
                order = np.argsort(b, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(b[order]) > 0])
                k = np.empty(len(b), np.int64)
                k[order] = np.arange(len(b)) - np.repeat(first, np.diff(np.r_[first, len(b)])) + made[b[order]]
                made += np.bincount(b, minlength=bins + 1)
                columns = [pa.array(np.full(len(b), part, np.int32)), pa.array(b.astype(np.int32)), pa.array(k), batch.column(0).take(pa.array(row)), pa.array(np.array(piece, np.int32)), pa.array(n), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "bin", "k", "doc_id", "piece", "n", "ids"])

    return run


def _placed(places, wanted: bool):
    """(seq_id, slot) of the pieces by their class and rank, before their other columns: of those alone in their sequence, or of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = np.zeros((3, len(size)), np.int64)
            for b in np.unique(size):
                rows = np.flatnonzero(size == b)
                start, sequence, slot, alone = places.value[b - 1]
                at = np.searchsorted(start, rank[rows], side="right") - 1
                out[:, rows] = sequence[at] + rank[rows] - start[at], slot[at], alone[at]
            rest = pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1].astype(np.int32)), *batch.columns[2:]], names=["seq_id", "slot", "doc_id", "piece", "n", "ids"])
            yield rest.filter(pa.array(out[2] == wanted))

    return run


def _assembled(kind: type):
    """Rows ordered by sequence and slot become one row a sequence."""

    def give(table_: pa.Table) -> pa.RecordBatch:
        seq = table_["seq_id"].to_numpy()
        first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        bounds = pa.array(np.r_[first, len(seq)].astype(np.int32))
        n = table_["n"].to_numpy().astype(np.int64)
        tokens = np.frombuffer(b"".join(table_["ids"].to_pylist()), kind).astype(np.int32)
        ends = np.cumsum(n)
        begin = (ends - n)[first]
        starts = ends - n - np.repeat(begin, np.diff(np.r_[first, len(seq)]))
        lists = lambda values: pa.ListArray.from_arrays(bounds, values)
        ids = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(tokens)].astype(np.int32)), pa.array(tokens))
        whole = lambda name: table_[name].combine_chunks()
        return pa.RecordBatch.from_arrays(
            [pa.array(seq[first]), pa.array(np.diff(np.r_[begin, len(tokens)]).astype(np.int32)), ids, lists(whole("doc_id")), lists(whole("piece")), lists(pa.array(starts.astype(np.int32)))], names=["seq_id", "n_tokens", "input_ids", "doc_ids", "pieces", "starts"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                held.append(batch.slice(at, SLICE))
                rows = pa.Table.from_batches(held)
                seq = rows["seq_id"].to_numpy()
                # the last sequence waits for what follows
                done = int(np.searchsorted(seq, seq[-1]))
                if done:
                    yield give(rows.slice(0, done))
                held = rows.slice(done).to_batches()
        if held:
            yield give(pa.Table.from_batches(held))

    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_token: int | None = END_OF_TEXT, seq_tokens: int = SEQ_TOKENS, bins: int = BINS, pattern_pieces: int = PATTERN_PIECES) -> DataFrame:
    """One row for each sequence: (seq_id, n_tokens, input_ids, doc_ids, pieces, starts).

    A document is its tokens in the byte-level BPE of ``vocabulary``, that of the chat formatting, and ``end_token`` behind them (None: nothing). One
    of more than ``seq_tokens`` is cut into full pieces and a rest. Every piece stands in one sequence, whole, from
    token ``starts[i]`` of ``input_ids`` on: piece ``pieces[i]`` of document ``doc_ids[i]``. No sequence exceeds
    ``seq_tokens``. Texts that are null or empty give nothing. Repeated rows are packed each; a null id stays null;
    other columns aren't read. ``seq_tokens`` must be a multiple of ``bins``.
    """
    if seq_tokens % bins:
        raise ValueError("seq_tokens must be a multiple of bins")
    spark, unit = docs.sparkSession, seq_tokens // bins
    id_type = docs.schema[id_col].dataType.simpleString()
    with open(vocabulary, "rb") as file:
        ranks = file.read()
    shared = spark.sparkContext.broadcast(ranks)  # a vocabulary, whatever the data's size
    kind = np.uint16 if max(encoder(ranks).n_vocab, (end_token or 0) + 1) <= 1 << 16 else np.uint32
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces = cut(source.mapInArrow(tidy(_pieces(shared, end_token, seq_tokens, unit, bins)), f"part int, bin int, k long, doc_id {id_type}, piece int, n int, ids binary"))
    sizes = cut(pieces.groupBy("bin", "part").agg(F.count("*").alias("count")))
    histogram = np.zeros(bins, np.int64)
    for r in sizes.groupBy("bin").agg(F.sum("count").alias("count")).collect():  # at most ``bins`` rows
        histogram[r["bin"] - 1] = r["count"]
    places = spark.sparkContext.broadcast(_places(plan(histogram, pattern_pieces), bins))  # bounded by bins
    earlier = F.sum("count").over(Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each class and partition: sent along while it is small, met by a shuffle of the pieces beyond
    before = sizes.select("bin", "part", F.coalesce(earlier, F.lit(0)).alias("before"))
    if sizes.count() <= BROADCAST_ROWS:
        before = F.broadcast(before)
    ranked = pieces.join(before, ["bin", "part"]).select("bin", (F.col("before") + F.col("k")).alias("rank"), "doc_id", "piece", "n", "ids")
    # pieces that fill a sequence stay where they are, the others meet
    alone, together = (ranked.mapInArrow(tidy(_placed(places, x)), f"seq_id long, slot int, doc_id {id_type}, piece int, n int, ids binary") for x in (True, False))
    ordered = together.repartition(F.col("seq_id")).sortWithinPartitions("seq_id", "slot")
    schema = f"seq_id long, n_tokens int, input_ids array<int>, doc_ids array<{id_type}>, pieces array<int>, starts array<int>"
    made = [part.select("seq_id", "doc_id", "piece", "n", "ids").mapInArrow(tidy(_assembled(kind)), schema) for part in (alone, ordered)]
    return made[0].unionAll(made[1])


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as packed sequences of token ids; null and empty texts give nothing."""
    return pack(table(spark, sf_dir, "documents"))
