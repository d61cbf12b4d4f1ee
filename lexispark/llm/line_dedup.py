"""Line deduplication by winnowing over line hashes.

A document is the sequence of the hashes of its lines that aren't blank. Of each ``MIN_LINES`` lines in a row, a window,
the position of the least hash is selected (winnowing; of equal ones the last), so that two equal windows always select
the same line of theirs, and neighbouring windows mostly share a selected position. Only selected positions travel. They
are joined by their hash, the fingerprint: one that stands once in the corpus goes, with all windows that selected it.

The matches that remain are extended both ways: the windows to the left and to the right that selected a position are
compared, by 128 bits, with the earliest place in the corpus at which the same lines stand, and windows that overlap or
touch grow into one run. What isn't earliest is deleted. A line of ``LONG_WORDS`` words is a window of one besides, so
that boilerplate between unlike neighbours goes too, and short lines that stand again by chance stay.

Only hashes travel: a hot line costs partial counts, never pairs of its occurrences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import cut, fresh, mix, rank_of, row_key, table, text_slices, tidy

#: Lines of a window, the shortest run that counts as repeated.
MIN_LINES = 2
#: Words from which a single line counts as a run, whatever its neighbours.
LONG_WORDS = 3
#: White space that is cut off a line before it is compared, and that parts words.
BLANK = " \t\r"

_WIN = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])
_WIN_SQL = "struct<a:long,b:long,pos:int,n:int,first:int,last:int>"


def long_line(words: int) -> str:
    """An expression that the beginning of a line of so many words matches, in Python and in SQL."""
    return rf"^(?:[^ \t\r]+[ \t\r]+){{{words - 1}}}[^ \t\r]"


def _window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` values in a row."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = mix(h[: len(h) - n + 1] + np.uint64(n))
    with np.errstate(over="ignore"):
        for j in range(1, n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
    return out


def winnowed(h: np.ndarray, window: int) -> np.ndarray:
    """The position that each window of hashes selects: of the least hash, the last of equal ones."""
    if len(h) < window:
        return np.zeros(0, np.int64)
    back = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
    return np.arange(len(back)) + window - 1 - back.argmin(1)


def document_windows(text: str, min_lines: int, long_re: re.Pattern | None) -> tuple[np.ndarray, ...] | None:
    """Of each window of a text: the fingerprint, its position, 128 bits of the lines, place, lines, first and last line; by position."""
    lines = [x.strip(BLANK) for x in text.split("\n")]
    at = np.array([k for k, x in enumerate(lines) if x], np.int32)
    if not len(at):
        return None
    lines = [x for x in lines if x]
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), np.uint64).reshape(-1, 2)
    sel = winnowed(h[:, 0], min_lines)
    single = np.array([k for k, x in enumerate(lines) if long_re.match(x)], np.int64) if long_re is not None else np.zeros(0, np.int64)
    owner = np.r_[sel, single]
    if not len(owner):
        return None
    place = np.r_[np.arange(len(sel)), single]
    n = np.r_[np.full(len(sel), min_lines), np.ones(len(single), np.int64)]
    sides = [np.r_[_window_hashes(h[:, k], min_lines), _window_hashes(h[:, k], 1)[single]] for k in (0, 1)]
    order = np.argsort(owner, kind="stable")
    owner, place, n = owner[order], place[order], n[order]
    return h[owner, 0], owner, sides[0][order], sides[1][order], place, n, at[place], at[place + n - 1]


def _fingerprints(min_lines: int, long_words: int | None):
    """(fp, wins, id, key) of each selected position: its line's hash, and the windows that selected it."""
    # where every line is a window, long ones need no other
    long_re = re.compile(long_line(long_words)) if long_words is not None and min_lines > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in text_slices(batch):
                found, rows = [], []
                for i, text in enumerate(part):
                    made = document_windows(text, min_lines, long_re) if text else None
                    if made is not None:
                        found.append(made)
                        rows.append(np.full(len(made[0]), start + i))
                if not found:
                    continue
                fp, owner, a, b, place, n, first, last = (np.concatenate(x) for x in zip(*found))
                row = np.concatenate(rows)
                begin = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])])
                cells = [pa.array(x.view(np.int64)) for x in (a, b)] + [pa.array(x.astype(np.int32)) for x in (place, n, first, last)]
                wins = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(row)].astype(np.int32)), pa.StructArray.from_arrays(cells, fields=list(_WIN)))
                taken = pa.array(row[begin])
                yield pa.RecordBatch.from_arrays([pa.array(fp[begin].view(np.int64)), wins, batch.column(0).take(taken), batch.column(2).take(taken)], names=["fp", "wins", "id", "key"])

    return run


def _repeated_by_document(docs: DataFrame, id_col: str, text_col: str, min_lines: int, long_words: int | None) -> DataFrame:
    """(key, id, runs) of the documents that have repeated runs, in order and parted from one another."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key")).where(F.col("text").isNotNull())
    id_type = docs.schema[id_col].dataType.simpleString()
    found = cut(source.mapInArrow(tidy(_fingerprints(min_lines, long_words)), f"fp long, wins array<{_WIN_SQL}>, id {id_type}, key binary"))
    often = found.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    around = found.join(often, "fp", "left_semi").select("id", "key", F.inline("wins"))
    place = F.struct(*[rank_of("id")[c].alias(c) for c in ("no_id", "id")], F.col("key").alias("key"), F.col("pos").alias("pos"))
    firsts = around.groupBy("a", "b").agg(F.min(place).alias("at"), F.count("*").alias("times")).where("times > 1").select("a", "b", "at")
    is_first = (F.col("key") == F.col("at.key")) & (F.col("pos") == F.col("at.pos")) & F.col("id").eqNullSafe(F.col("at.id"))
    later = around.join(firsts, ["a", "b"]).where(~is_first)
    # a row that stands twice has its windows twice: they are one
    by_doc = later.groupBy("key").agg(F.first("id").alias("id"), F.collect_set(F.struct("pos", "n", "first", "last")).alias("wins"))

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for wins in batch.column(2).to_pylist():
                runs: list[list[int]] = []
                for pos, n, first, last in sorted((w["pos"], w["n"], w["first"], w["last"]) for w in wins):
                    if runs and pos <= runs[-1][1]:
                        runs[-1][1], runs[-1][3] = max(runs[-1][1], pos + n), max(runs[-1][3], last + 1)
                    else:
                        runs.append([pos, pos + n, first, last + 1])
                out.append([{"line_start": f, "line_end": e, "n_lines": b - a} for a, b, f, e in runs])
            kind = pa.list_(pa.struct([("line_start", pa.int32()), ("line_end", pa.int32()), ("n_lines", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["key", "id", "runs"])

    return by_doc.mapInArrow(tidy(grown), f"key binary, id {id_type}, runs array<struct<line_start:int,line_end:int,n_lines:int>>")


def repeated_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, long_words: int | None = LONG_WORDS) -> DataFrame:
    """Runs of lines that already stood earlier: (doc_id, row_key, line_start, line_end, n_lines), the end exclusive.

    Lines are numbered from 0 and compared without white space around them; blank lines neither count nor part a run.
    A run of ``min_lines`` lines, or a line of ``long_words`` words (None: no single line), is repeated if the same lines
    stand in a row in a document before it (by id, a null id last, then by a hash of the text), or before it in its own; repeated
    runs that overlap or touch are one. ``n_lines`` counts lines that aren't blank. Null and empty texts have no runs.
    Rows equal in id and text are one document and get equal rows once. Other columns aren't read.
    """
    found = _repeated_by_document(docs, id_col, text_col, min_lines, long_words)
    return found.select(F.col("id").alias("doc_id"), F.col("key").alias("row_key"), F.inline("runs"))


def delete_repeated_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", min_lines: int = MIN_LINES, long_words: int | None = LONG_WORDS) -> DataFrame:
    """``docs`` without the lines of :func:`repeated_runs`.

    Columns stay as they are; ``chars_col``, if there is such a column, follows the new length where lines went. A document
    of which no line remains but blank ones goes; one that had no such line from the start, or a null text, stays.
    """
    key, spans = fresh(docs, "run_key", "run_spans")
    by_doc = _repeated_by_document(docs, id_col, text_col, min_lines, long_words).select(F.col("key").alias(key), F.col("runs").alias(spans))
    joined = docs.withColumn(key, row_key(id_col, text_col)).join(by_doc.hint("shuffle_hash"), key, "left")
    names, at = docs.columns, docs.columns.index(text_col)
    count = names.index(chars_col) if chars_col in names else None

    def cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = batch.column(len(names))
            hit = np.flatnonzero(np.asarray(marked.is_valid()))
            columns = list(batch.columns)[: len(names)]
            if not len(hit):
                yield pa.RecordBatch.from_arrays(columns, names=names)
                continue
            changed = dict(zip(hit.tolist(), columns[at].take(pa.array(hit)).to_pylist()))
            keep = np.ones(batch.num_rows, bool)
            for i, cuts in zip(hit.tolist(), marked.take(pa.array(hit)).to_pylist()):
                lines = changed[i].split("\n")
                gone = np.zeros(len(lines), bool)
                for c in cuts:
                    gone[c["line_start"] : c["line_end"]] = True
                rest = [x for x, g in zip(lines, gone) if not g]
                changed[i] = "\n".join(rest)
                keep[i] = any(x.strip(BLANK) for x in rest)
            texts = columns[at].to_pylist()
            for i, text in changed.items():
                texts[i] = text
            columns[at] = pa.array(texts, columns[at].type)
            if count is not None:
                chars = columns[count].to_pylist()
                for i, text in changed.items():
                    chars[i] = len(text)
                columns[count] = pa.array(chars, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return joined.select(*[F.col(f"`{c}`") for c in names], spans).mapInArrow(tidy(cutter), docs.schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of lines of ``documents`` that already stood earlier; null and empty texts have none."""
    return repeated_runs(table(spark, sf_dir, "documents")).select("doc_id", "line_start", "line_end", "n_lines")


SQL = rf"""
WITH parts AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(range(len(l))) AS i, trim(unnest(l), chr(32) || chr(9) || chr(13)) AS x FROM parts),
kept AS (SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM lines WHERE x <> ''),
pairs AS (SELECT doc_id, pos, x || chr(10) || lead(x) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM kept),
again AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS k FROM pairs WHERE run IS NOT NULL) WHERE k > 1),
long AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY x ORDER BY doc_id, pos) AS k FROM kept WHERE regexp_matches(x, '{long_line(LONG_WORDS)}')) WHERE k > 1),
gone AS (SELECT doc_id, pos FROM again UNION SELECT doc_id, pos + 1 FROM again UNION SELECT doc_id, pos FROM long),
marked AS (SELECT doc_id, pos, i, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM gone JOIN kept USING (doc_id, pos))
SELECT doc_id, min(i)::INT AS line_start, (max(i) + 1)::INT AS line_end, count(*)::INT AS n_lines FROM marked GROUP BY doc_id, g
"""
assert MIN_LINES == 2  # the SQL's runs are pairs
