"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a run of documents of one input partition. Its tokens are numbered by the vocabulary of the benchmark;
all other tokens end a phrase, so that runs of known tokens that are shorter than the shortest phrase can't hold one
and aren't indexed. Over what remains the shard builds a suffix array, the Burrows-Wheeler transform in a wavelet
matrix with popcount ranks, and suffix positions at every ``SAMPLE``-th place. All phrases are searched backwards at
once; occurrences are located by walking to the next sampled position, mapped to documents, and merged.
The text is read once and never shuffled: only the benchmark's phrases travel, in slices of a checked size. A benchmark of
several slices reads the text once for each; the occurrences that the slices find are united by text before they are
merged, so that the result is that of one slice, and where spans are cut out, the texts are joined with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.llm.common import TOKEN, TOKEN_SQL, fresh, merge_intervals, row_key, table, text_slices, tidy

#: Tokens of a phrase: an 8-gram of the benchmark that occurs in a document is contamination.
NGRAM = 8
#: A benchmark item with fewer tokens than NGRAM is searched whole from this length on; shorter ones name nothing.
MIN_ITEM_TOKENS = 5
#: Every so many indexed positions, the suffix position is kept.
SAMPLE = 16
#: Tokens of a shard.
SHARD_TOKENS = 2_000_000
#: Characters of the benchmark that are sent to the executors at once; a larger benchmark takes several passes.
SLICE_CHARS = 16_000_000

SPANS = T.StructType([
    T.StructField("tok_start", T.IntegerType()), T.StructField("tok_end", T.IntegerType()),
    T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType()),
    T.StructField("n_phrases", T.IntegerType()), T.StructField("first_item", T.LongType()),
])


class WaveletMatrix:
    """Rank queries over symbols below 2**levels; each level is a bit vector in 64-bit words with counts before each word."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.n, self.levels = len(symbols), levels
        self.words, self.before, self.zeros = [], [], []
        current = symbols.astype(np.uint32)
        for level in range(levels - 1, -1, -1):
            bits = ((current >> np.uint32(level)) & np.uint32(1)).astype(np.uint8)
            padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
            padded[: len(bits)] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.before.append(np.r_[0, np.cumsum(counts)[:-1]])
            self.zeros.append(int(len(bits) - counts.sum()))
            current = np.concatenate([current[bits == 0], current[bits == 1]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low = np.zeros(len(i), np.int64)
        high = np.asarray(i, np.int64)
        for level in range(self.levels):
            one = ((symbol >> (self.levels - 1 - level)) & 1).astype(bool)
            ones_low, ones_high = self._ones(level, low), self._ones(level, high)
            low = np.where(one, self.zeros[level] + ones_low, low - ones_low)
            high = np.where(one, self.zeros[level] + ones_high, high - ones_high)
        return high - low

    def access(self, i: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        at, symbol = np.asarray(i, np.int64), np.zeros(len(i), np.int64)
        for level in range(self.levels):
            bit = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            ones = self._ones(level, at)
            one = bit.astype(bool)
            symbol = (symbol << 1) | one
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return symbol


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling; 0 is a separator, each smaller than every symbol and unlike any other."""
    n = len(symbols)
    separator = symbols == 0
    rank = np.where(separator, np.cumsum(separator), symbols.astype(np.int64) + separator.sum() + 1)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        ordered = rank[order]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        # a group's rank is the place at which it begins, so that later rounds refine groups in place
        start = np.flatnonzero(new)
        dense = start[np.cumsum(new) - 1]
        rank = np.empty(n, np.int64)
        rank[order] = dense
        open_ = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(open_):
            return order
        rows = order[open_]
        following = rows + step
        second = np.where(following < n, rank[np.minimum(following, n - 1)] + 1, 0)
        inner = np.lexsort((second, rank[rows]))
        order[open_] = rows[inner]
        # ranks become unlike where the second half differs
        refined = rank * np.int64(n + 1)
        refined[rows] += second
        rank = refined
        step *= 2


class FMIndex:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        n = len(symbols)
        order = suffix_array(symbols)
        bwt = symbols[order - 1]
        self.counts = np.r_[0, np.cumsum(np.bincount(symbols, minlength=n_symbols))]
        self.tree = WaveletMatrix(bwt, max(1, int(n_symbols - 1).bit_length()))
        # every SAMPLE-th position is kept, and each that follows a separator: no walk crosses one
        kept = (order % SAMPLE == 0) | (bwt == 0)
        self.kept = WaveletMatrix(kept.astype(np.uint32), 1)
        self.places = order[kept]
        self.n = n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of suffixes that begin with each phrase (a row of symbols), from its last symbol to its first."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, j]
            low[alive] = self.counts[symbol] + self.tree.rank(symbol, low[alive])
            high[alive] = self.counts[symbol] + self.tree.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position of the suffix of each row: steps to the left until a kept one."""
        place, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        at, todo = rows.astype(np.int64), np.arange(len(rows))
        one = np.ones(1, np.int64)
        while len(todo):
            here = at[todo]
            found = self.kept.access(here) == 1
            hit = todo[found]
            place[hit] = self.places[self.kept.rank(np.broadcast_to(one, len(hit)), at[hit])] + steps[hit]
            todo = todo[~found]
            symbol = self.tree.access(at[todo])
            at[todo] = self.counts[symbol] + self.tree.rank(symbol, at[todo])
            steps[todo] += 1
        return place


class Phrases:
    """The phrases of a benchmark: its vocabulary, and for each length an array of symbol rows with the least item of each."""

    def __init__(self, items: list[tuple[int, str | None]], ngram: int, min_item_tokens: int):
        self.ids: dict[str, int] = {}
        found: dict[int, dict[tuple[int, ...], int]] = {}
        for item, text in items:
            words = TOKEN.findall(text or "")
            if len(words) < min(ngram, min_item_tokens):
                continue
            symbols = [self.ids.setdefault(w.lower(), len(self.ids) + 1) for w in words]
            length = min(ngram, len(symbols))
            rows = found.setdefault(length, {})
            item = np.iinfo(np.int64).max if item is None else item
            for i in range(len(symbols) - length + 1):
                key = tuple(symbols[i : i + length])
                rows[key] = min(rows.get(key, item), item)
        self.rows = {k: (np.array(list(v), np.int64), np.array(list(v.values()), np.int64)) for k, v in found.items()}
        self.shortest = min(self.rows, default=0)


class _Symbols(dict):
    """Symbol of a token as written; the lower-case form decides, 0 if the benchmark doesn't have it."""

    def __init__(self, ids: dict[str, int]):
        self.ids = ids

    def __missing__(self, key: str) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[key] = self.ids.get(key.lower(), 0)
        return value


def shard_hits(symbols: np.ndarray, phrases: Phrases) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """For each phrase length: places in ``symbols`` at which a phrase begins, the length, and the phrase's item."""
    known = np.r_[False, symbols > 0, False]
    edges = np.flatnonzero(known[1:] != known[:-1])
    begin, stop = edges[::2], edges[1::2]
    long_ = stop - begin >= phrases.shortest
    begin, stop = begin[long_], stop[long_]
    if not len(begin):
        return
    # each run with a separator before it
    lengths = stop - begin + 1
    ends = np.cumsum(lengths)
    place = np.repeat(begin - 1 - (ends - lengths), lengths) + np.arange(ends[-1])
    kept = symbols[np.maximum(place, 0)]
    kept[ends - lengths] = 0
    index = FMIndex(kept, len(phrases.ids) + 1)
    for length, (rows, items) in phrases.rows.items():
        low, high = index.search(rows)
        n = high - low
        which = np.repeat(np.arange(len(rows)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield place[index.locate(low[which] + inner)], length, items[which]


def _shard_occurrences(texts: list[str | None], symbols_of: _Symbols, phrases: Phrases) -> tuple[np.ndarray, ...] | None:
    """Start, end and item of each occurrence in a shard, in order of the start, and the start of each document; None if there is none."""
    parts, starts, total = [], np.zeros(len(texts), np.int64), 0
    for i, text in enumerate(texts):
        starts[i] = total
        if text:
            words = TOKEN.findall(text)
            parts.append(np.fromiter(map(symbols_of.__getitem__, words), np.int32, len(words)))
            total += len(words) + 1
            parts.append(np.zeros(1, np.int32))
    if not total or not phrases.rows:
        return None
    hits = list(shard_hits(np.concatenate(parts), phrases))
    if not hits:
        return None
    start = np.concatenate([h[0] for h in hits])
    end = np.concatenate([h[0] + h[1] for h in hits])
    item = np.concatenate([h[2] for h in hits])
    order = np.argsort(start, kind="stable")
    return start[order], end[order], item[order], starts


def _merged(start: np.ndarray, end: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Low and high end, number of occurrences and least item of each span of occurrences in order of their start."""
    low, high, group = merge_intervals(start, end)
    n = np.bincount(group, minlength=len(low))
    least = np.minimum.reduceat(item, np.flatnonzero(np.r_[True, group[1:] != group[:-1]])) if len(group) else item
    return low, high, n, least


def shard_spans(texts: list[str | None], symbols_of: _Symbols, phrases: Phrases) -> dict[int, list[tuple[int, ...]]]:
    """Merged spans of each document of a shard that has any, by its place in ``texts``."""
    hits = _shard_occurrences(texts, symbols_of, phrases)
    if hits is None:
        return {}
    start, end, item, starts = hits
    # a separator between two documents keeps their intervals apart
    low, high, n, least = _merged(start, end, item)
    doc = np.searchsorted(starts, low, side="right") - 1
    out: dict[int, list[tuple[int, ...]]] = {}
    for d in np.unique(doc):
        found = [m.span() for m in TOKEN.finditer(texts[d])]
        for k in np.flatnonzero(doc == d):
            a, b = int(low[k] - starts[d]), int(high[k] - starts[d])
            out.setdefault(int(d), []).append((a, b, found[a][0], found[b - 1][1], int(n[k]), int(least[k])))
    return out


def shard_occurrences(texts: list[str | None], symbols_of: _Symbols, phrases: Phrases) -> dict[int, list[tuple[int, ...]]]:
    """(tok_start, tok_end, char_start, char_end, item) of each occurrence in each document of a shard that has any."""
    hits = _shard_occurrences(texts, symbols_of, phrases)
    if hits is None:
        return {}
    start, end, item, starts = hits
    out: dict[int, list[tuple[int, ...]]] = {}
    doc = np.searchsorted(starts, start, side="right") - 1
    for d in np.unique(doc).tolist():
        found = [m.span() for m in TOKEN.finditer(texts[d])]
        of = doc == d
        for a, b, i in zip((start[of] - starts[d]).tolist(), (end[of] - starts[d]).tolist(), item[of].tolist()):
            out.setdefault(d, []).append((a, b, found[a][0], found[b - 1][1], i))
    return out


def _shards(batches: Iterator[pa.RecordBatch], phrases: Phrases, shard_tokens: int, column: int, find=shard_spans) -> Iterator[tuple[pa.RecordBatch, list[str | None], dict]]:
    """Rows of the partition in shards of about ``shard_tokens`` tokens, with their spans."""
    symbols_of = _Symbols(phrases.ids)
    for batch in batches:
        begin, texts, chars = 0, [], 0
        for start, part in text_slices(batch, column):
            texts += part
            chars += sum(len(t) for t in part if t)
            if chars >= 5 * shard_tokens:
                yield batch.slice(begin, len(texts)), texts, find(texts, symbols_of, phrases)
                begin, texts, chars = start + len(part), [], 0
        if texts:
            yield batch.slice(begin, len(texts)), texts, find(texts, symbols_of, phrases)


def _benchmark_slices(benchmark: DataFrame, item_col: str, text_col: str, slice_chars: int) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark in slices of a bounded size, streamed through the driver."""
    part, chars, first = [], 0, True
    for item, text in benchmark.select(F.col(item_col).cast("long"), text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        part.append((item, text))
        chars += len(text)
        if chars >= slice_chars:
            yield part
            part, chars, first = [], 0, False
    if part or first:
        yield part


def _phrases(benchmark: DataFrame, item_col: str, text_col: str, slice_chars: int, ngram: int, min_item_tokens: int) -> tuple[Phrases, Iterator[Phrases]]:
    """The phrases of the first slice, and of those after it, if there are any."""
    slices = (Phrases(part, ngram, min_item_tokens) for part in _benchmark_slices(benchmark, item_col, text_col, slice_chars))
    return next(slices), slices


def _united_spans(source: DataFrame, slices: Iterator[Phrases], shard_tokens: int) -> DataFrame:
    """(key, id, copies, spans) of the rows (id, text, key) in which any slice has phrases; rows of one key are alike.

    An occurrence that several slices find counts once, with the least item. Only occurrences are shuffled.
    """
    id_type = source.schema["id"].dataType.simpleString()
    names = ["tok_start", "tok_end", "char_start", "char_end", "item"]
    hit_type = pa.list_(pa.struct([*((n, pa.int32()) for n in names[:4]), (names[4], pa.int64())]))
    span_names = SPANS.names
    span_type = pa.list_(pa.struct([*((n, pa.int32()) for n in span_names[:5]), (span_names[5], pa.int64())]))

    def finder(phrases: Phrases):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, _, hits in _shards(batches, phrases, shard_tokens, 1, shard_occurrences):
                if hits:
                    at = pa.array(list(hits))
                    found = pa.array([[dict(zip(names, h)) for h in x] for x in hits.values()], hit_type)
                    yield pa.RecordBatch.from_arrays([rows.column(2).take(at), rows.column(0).take(at), found], names=["key", "id", "hits"])

        return run

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for hits in batch.column(3).to_pylist():
                least: dict[tuple[int, int], int] = {}
                chars: dict[int, int] = {}
                for h in hits:
                    place = h["tok_start"], h["tok_end"]
                    least[place] = min(least.get(place, h["item"]), h["item"])
                    chars[h["tok_start"]], chars[-h["tok_end"]] = h["char_start"], h["char_end"]
                places = sorted(least)
                start, end = np.array(places, np.int64).T
                spans = zip(*(x.tolist() for x in _merged(start, end, np.array([least[x] for x in places], np.int64))))
                out.append([dict(zip(span_names, (a, b, chars[a], chars[-b], n, item))) for a, b, n, item in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, span_type)], names=["key", "id", "copies", "spans"])

    hits = None
    for number, phrases in enumerate(slices):
        part = source.mapInArrow(tidy(finder(phrases)), f"key binary, id {id_type}, hits array<struct<tok_start:int,tok_end:int,char_start:int,char_end:int,item:long>>").withColumn("slice", F.lit(number))
        hits = part if hits is None else hits.unionAll(part)
    alike = hits.groupBy("key", "slice").agg(F.first("id").alias("id"), F.first("hits").alias("hits"), F.count("*").alias("copies"))
    by_key = alike.groupBy("key").agg(F.first("id").alias("id"), F.max("copies").cast("int").alias("copies"), F.flatten(F.collect_list("hits")).alias("hits"))
    return by_key.mapInArrow(tidy(merge), f"key binary, id {id_type}, copies int, spans array<{SPANS.simpleString()}>")


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", ngram: int = NGRAM, min_item_tokens: int = MIN_ITEM_TOKENS, shard_tokens: int = SHARD_TOKENS, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """One row for each merged span of a document that benchmark phrases cover.

    Tokens are runs of letters and digits, compared in lower case. A phrase is each ``ngram`` tokens in a row of an
    item, or the whole item if it has ``min_item_tokens`` to ``ngram - 1``. Phrases that overlap or touch make one span
    [tok_start, tok_end) with its characters [char_start, char_end); ``n_phrases`` counts the occurrences in it and
    ``first_item`` is the least item id among them. Null or empty texts, and an empty benchmark, give no rows; a
    repeated row gives its spans each time; a null id stays null; a phrase of an item without id has the largest long;
    other columns of ``docs`` aren't read. A benchmark above ``slice_chars`` is searched slice by slice,
    with the same result.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *SPANS.fields])
    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(docs.schema[id_col].dataType.simpleString())
    source = docs.select(F.col(id_col) if arrow_id else F.col(id_col).cast("string"), text_col)
    arrow_id = arrow_id or pa.string()
    types = [arrow_id, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]

    def finder(phrases: Phrases):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, _, spans in _shards(batches, phrases, shard_tokens, 1):
                if spans:
                    ids = rows.column(0)
                    columns = list(zip(*[(ids[d].as_py(), *s) for d in sorted(spans) for s in spans[d]]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

        return run

    first, others = _phrases(benchmark, item_col, item_text_col, slice_chars, ngram, min_item_tokens)
    second = next(others, None)
    if second is None:
        return source.mapInArrow(tidy(finder(first)), schema)
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    united = _united_spans(keyed, chain([first, second], others), shard_tokens)
    return united.select(F.col("id").alias("doc_id"), F.explode(F.flatten(F.array_repeat("spans", F.col("copies")))).alias("s")).select("doc_id", "s.*")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars", item_col: str = "item_id", item_text_col: str = "text", ngram: int = NGRAM, min_item_tokens: int = MIN_ITEM_TOKENS, shard_tokens: int = SHARD_TOKENS, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """``docs`` with the spans of :func:`contaminated_spans` cut out of the text.

    All rows and columns stay; a span becomes one blank, and ``chars_col``, if there is such a column, follows the new
    length where the text changed. A null text stays null.
    """
    names = docs.columns
    at = names.index(text_col)
    count = names.index(chars_col) if chars_col in names else None

    def cleaner(phrases: Phrases):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, texts, spans in _shards(batches, phrases, shard_tokens, at):
                if not spans:
                    yield rows
                    continue
                yield without(list(rows.columns), texts, {d: [x[2:4] for x in found] for d, found in spans.items()})

        return run

    def without(columns: list[pa.Array], texts: list[str | None], cuts: dict[int, list[tuple[int, int]]]) -> pa.RecordBatch:
        for d, found in cuts.items():
            pieces, last = [], 0
            for a, b in found:
                pieces.append(texts[d][last:a])
                last = b
            texts[d] = " ".join([*pieces, texts[d][last:]])
        columns[at] = pa.array(texts, columns[at].type)
        if count is not None:
            chars = columns[count].to_pylist()
            for d in cuts:
                chars[d] = len(texts[d])
            columns[count] = pa.array(chars, columns[count].type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    def cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = batch.column(len(names))
            cuts = {d: [(c["char_start"], c["char_end"]) for c in marked[d].as_py()] for d in np.flatnonzero(np.asarray(marked.is_valid())).tolist()}
            columns = list(batch.columns)[: len(names)]
            yield without(columns, columns[at].to_pylist(), cuts) if cuts else pa.RecordBatch.from_arrays(columns, names=names)

    first, others = _phrases(benchmark, item_col, item_text_col, slice_chars, ngram, min_item_tokens)
    second = next(others, None)
    if second is None:
        return docs.mapInArrow(tidy(cleaner(first)), docs.schema)
    key, spans = fresh(docs, "text_key", "text_spans")
    text_key = F.unhex(F.md5(F.col(text_col)))
    keyed = docs.select(F.lit(None).cast("long").alias("id"), F.col(text_col).alias("text"), text_key.alias("key"))
    united = _united_spans(keyed, chain([first, second], others), shard_tokens).select(F.col("key").alias(key), F.col("spans").alias(spans))
    joined = docs.withColumn(key, text_key).join(united.hint("shuffle_hash"), key, "left")
    return joined.select(*[F.col(f"`{c}`") for c in names], spans).mapInArrow(tidy(cutter), docs.schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of ``documents`` that phrases of ``benchmark`` cover; null and empty texts have none."""
    return contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SHORT = range(MIN_ITEM_TOKENS, NGRAM)
#: The phrases of each length that begin at a token that the benchmark has: itself and those that follow, without a gap.
_GRAMS = ", ".join(f"CASE WHEN lead(i, {n - 1}) OVER d = i + {n - 1} THEN {' || chr(32) || '.join(['w', *(f'lead(w, {j}) OVER d' for j in range(1, n))])} END AS g{n}" for n in (*_SHORT, NGRAM))
_HITS = " UNION ALL ".join(f"SELECT doc_id, i, {n} AS n, item_id FROM grams JOIN phrases ON k = g{n} AND n = {n}" for n in (*_SHORT, NGRAM))
SQL = rf"""
WITH pieces AS (
  SELECT doc_id, regexp_extract_all(text, '{TOKEN_SQL}') AS m, regexp_split_to_array(text, '{TOKEN_SQL}') AS p
  FROM documents WHERE text IS NOT NULL),
words AS (
  SELECT doc_id, unnest(range(len(m))) AS i, unnest(m) AS w, unnest(p[1:len(m)]) AS gap FROM pieces),
placed AS MATERIALIZED (
  SELECT doc_id, i, lower(w) AS w, length(w) AS n,
    sum(length(w) + length(gap)) OVER (PARTITION BY doc_id ORDER BY i) AS char_end FROM words),
items AS (
  SELECT item_id, list_transform(regexp_extract_all(text, '{TOKEN_SQL}'), lambda x: lower(x)) AS m FROM benchmark WHERE text IS NOT NULL),
phrases AS MATERIALIZED (
  SELECT k, n, min(item_id) AS item_id FROM (
    SELECT item_id, array_to_string(m[j:j + {NGRAM - 1}], ' ') AS k, {NGRAM} AS n
    FROM (SELECT item_id, m, unnest(range(1, len(m) - {NGRAM} + 2)) AS j FROM items WHERE len(m) >= {NGRAM})
    UNION ALL SELECT item_id, array_to_string(m, ' '), len(m) FROM items WHERE len(m) BETWEEN {MIN_ITEM_TOKENS} AND {NGRAM - 1}) GROUP BY k, n),
known AS (SELECT DISTINCT unnest(m) AS w FROM items),
grams AS MATERIALIZED (SELECT doc_id, i, {_GRAMS} FROM placed SEMI JOIN known USING (w) WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
hits AS ({_HITS}),
marked AS (
  SELECT *, CASE WHEN i <= max(i + n) OVER (PARTITION BY doc_id ORDER BY i, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS first FROM hits),
spans AS (
  SELECT doc_id, min(i) AS tok_start, max(i + n) AS tok_end, count(*) AS n_phrases, min(item_id) AS first_item
  FROM (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY i, n) AS g FROM marked) GROUP BY doc_id, g)
SELECT s.doc_id, s.tok_start::INT AS tok_start, s.tok_end::INT AS tok_end, (a.char_end - a.n)::INT AS char_start, b.char_end::INT AS char_end,
  s.n_phrases::INT AS n_phrases, s.first_item
FROM spans s JOIN placed a ON a.doc_id = s.doc_id AND a.i = s.tok_start JOIN placed b ON b.doc_id = s.doc_id AND b.i = s.tok_end - 1
"""
