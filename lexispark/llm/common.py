"""What the operators of this subpackage share: tables, keys, tokens, hashes and lineage cuts."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maximal runs of letters and digits; ``[\p{L}\p{N}]+`` in SQL.
TOKEN = re.compile(r"[^\W_]+")
TOKEN_SQL = r"[\p{L}\p{N}]+"
#: Rows of an Arrow batch that are turned into Python strings at once.
SLICE = 256
#: Temporary folders of sessions that name no shared one, by application.
_UNNAMED: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it; only in local mode, as in tests, it may be unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        named = _UNNAMED.get(app) or _UNNAMED.setdefault(app, "file://" + tempfile.mkdtemp(prefix="lexispark-"))
    return f"{named.rstrip('/')}/{app}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: a lost executor costs no recomputation of what led to it.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits that name a row by its id and its text, nulls included; rows equal in both are one document."""
    part = lambda c: F.coalesce(F.md5(F.col(c).cast("string")), F.lit(""))
    return F.unhex(F.md5(F.concat(part(id_col), F.lit("|"), part(text_col))))


def rank_of(id_col: str) -> Column:
    """Order in which the first of equal documents is chosen: by id, a null id last."""
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't use, also not in another case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_slices(batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[int, list[str | None]]]:
    """The strings of a batch, a few hundred at a time, with the row at which each slice begins."""
    strings = batch.column(column)
    for start in range(0, len(strings), SLICE):
        yield start, strings.slice(start, SLICE).to_pylist()


def give_back() -> None:
    """Returns to the system the memory that Python and Arrow have freed but keep for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, so that a worker, which lives on for tasks of later stages, doesn't hold what earlier ones took."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what is freed only after the end of a task, such as its closure and broadcasts
        yield from run(batches)
        give_back()

    return tidied


class HashCache(dict):
    """64-bit hash of a string, kept for strings that come again; emptied when it has grown large."""

    LIMIT = 400_000

    def __missing__(self, key: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[key] = xxhash.xxh64_intdigest(key)
        return value


class LowerHashCache(HashCache):
    """As HashCache, of the lower-case form."""

    def __missing__(self, key: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[key] = xxhash.xxh64_intdigest(key.lower())
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every bit of a 64-bit word over all others."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def merge_intervals(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of half-open intervals sorted by start; intervals that touch are joined. Also the group of each interval."""
    if len(start) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    reach = np.maximum.accumulate(end)
    first = np.ones(len(start), bool)
    first[1:] = start[1:] > reach[:-1]
    group = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    last = np.r_[at[1:] - 1, len(start) - 1]
    return start[at], reach[last], group
