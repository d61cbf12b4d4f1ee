"""Helpers that column functions share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str
#: Inside a class: what counts as part of a word. Java's \w has combining marks too, which would swallow more.
WORD_SIGNS = r"\p{L}\p{N}_"


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    Inside the function of an array, an expression from outside is computed again for every element; a bound variable isn't.
    """
    return F.transform(F.array(value), body)[0]


#: Bytes of text, or elements of arrays, that a Python worker takes from an Arrow batch at once; a row that has more is taken alone.
PORTION = 1 << 16


def _extent(values: pa.Array) -> np.ndarray:
    """Bytes of each text, or elements of each array."""
    count = pa.compute.list_value_length if pa.types.is_list(values.type) else pa.compute.binary_length
    return count(values).fill_null(0).to_numpy(zero_copy_only=False)


def portions(first: pa.Array, *rest: pa.Array, most: int = PORTION) -> Iterator[tuple[pa.Array, ...]]:
    """A batch in slices of rows that have ``most`` bytes or elements in the first column together; an empty batch is one slice."""
    ends = np.cumsum(_extent(first))
    start = 0
    while start < len(first) or not start:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield tuple(a.slice(start, stop - start) for a in (first, *rest))
        start = stop


def by_text(f: Callable[[str], str]) -> Callable[[Column], Column]:
    """A function of one text made a column function; a Python worker holds a portion of the texts at once. Null stays null."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for (texts,) in portions(batch, most=16 * PORTION):
                yield pa.array([None if x is None else f(x) for x in texts.to_pylist()], pa.string())

    return run


def quoted_replacement(text: str) -> str:
    """A replacement in which neither ``$`` nor a backslash means anything."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def substitute(c: ColumnOrName, pattern: str, repl: str) -> Column:
    """Every match becomes the literal ``repl``."""
    return F.regexp_replace(col(c), F.lit(pattern), F.lit(quoted_replacement(repl)))


def make_pipeline(*funcs: Callable[[Column], Column]) -> Callable[[ColumnOrName], Column]:
    """Column functions composed from left to right; Catalyst folds them into one projection."""
    if not funcs:
        raise ValueError("a pipeline has one function at least")
    return lambda c: reduce(lambda x, f: f(x), funcs, col(c))
