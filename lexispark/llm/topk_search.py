"""Exact search for the vectors of greatest inner product, in buckets of like length.

Vectors are ordered by length into buckets, which stay where they are: blocks of queries of a bounded size go to them. A
block meets the bucket of the longest vectors first, then in each task that task's buckets from the longest on. With a
query's k-th best product so far, theta, and a bucket's greatest length l, a vector of the bucket must have a cosine of
theta / (|q| l) with the query at least. Above 1 the query is done with this and all shorter buckets. A high local threshold
bounds each coordinate of the vector, and the query's largest coordinate then cuts a range out of the bucket sorted by
it (coordinate pruning); a low one leaves length pruning: the vectors of at least theta / |q|, a prefix of the bucket. The products of
what remains are computed, so the result is exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.llm.common import cut, shared_dir, table

#: Neighbours of each query.
K = 10
#: Vectors of a bucket.
BUCKET_ROWS = 4096
#: Bytes of a block of queries, which is broadcast.
BLOCK_BYTES = 16_000_000
#: Local cosine threshold from which a coordinate prunes more than the length.
COORDINATE_FROM = 0.5
#: Decimals that products are compared in, so that equal vectors tie whatever the order of summation.
DECIMALS = 9
MARGIN = 2 * 10.0**-DECIMALS
NO_ID = np.iinfo(np.int64).max


class Bucket:
    def __init__(self, number: int, ids: np.ndarray, vectors: np.ndarray):
        self.number, self.ids, self.vectors = number, ids, vectors
        self.lengths = np.sqrt((vectors * vectors).sum(1))
        self.longest = float(self.lengths.max(initial=0.0))
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of the vectors by coordinate ``f`` of their directions, and these values."""
        if f not in self.sorted:
            values = self.vectors[:, f] / np.where(self.lengths > 0, self.lengths, 1)
            order = np.argsort(values, kind="stable")
            self.sorted[f] = order, values[order]
        return self.sorted[f]


class Queries:
    """A block of queries: ids, vectors, the bucket and the place in it that each comes from, and what its best are at least."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, home: np.ndarray, place: np.ndarray):
        self.ids, self.vectors, self.home, self.place = ids, vectors, home, place
        self.d = vectors.shape[1]
        self.lengths = np.sqrt((vectors * vectors).sum(1))
        self.floor = np.full(len(ids), -np.inf)

    @classmethod
    def of(cls, rows: list) -> Queries:
        vectors = np.frombuffer(b"".join(r["vector"] for r in rows), np.float64).reshape(len(rows), rows[0]["d"])
        return cls(np.array([r["id"] for r in rows], np.int64), vectors, *(np.array([r[c] for r in rows], np.int64) for c in ("bucket", "place")))


class Best:
    """The k best of each query so far, by rounded product and id; ``floor`` is what the k-th best is known to reach."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.score, self.ids = np.full((n, k), -np.inf), np.full((n, k), NO_ID)
        self.floor = np.full(n, -np.inf) if floor is None else floor
        self.theta = self.floor.copy()

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(rows):
            return
        changed = np.unique(rows)
        all_rows = np.r_[np.repeat(changed, self.k), rows]
        all_score = np.r_[self.score[changed].ravel(), np.round(score, DECIMALS)]
        all_ids = np.r_[self.ids[changed].ravel(), ids]
        order = np.lexsort((all_ids, -all_score, all_rows))
        first = np.flatnonzero(np.r_[True, np.diff(all_rows[order]) > 0])
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        top = order[rank < self.k]
        self.score[changed], self.ids[changed] = all_score[top].reshape(-1, self.k), all_ids[top].reshape(-1, self.k)
        self.theta[changed] = np.maximum(self.floor[changed], self.score[changed, -1])


def search_bucket(queries: Queries, best: Best, bucket: Bucket, coordinate_from: float = COORDINATE_FROM) -> int:
    """Takes the bucket's vectors into the queries' best; the number of products computed."""
    if not len(bucket.ids):
        return 0
    computed = 0

    def verify(rows: np.ndarray, among: np.ndarray | slice) -> int:
        """All products of some queries with some vectors; what can't be among the k best is left out."""
        numbers = np.arange(len(bucket.ids))[among]
        for at in range(0, len(rows), 512):
            part = rows[at : at + 512]
            product = queries.vectors[part] @ bucket.vectors[among].T
            own = np.flatnonzero(queries.home[part] == bucket.number)
            if len(own):
                i, j = np.nonzero(queries.place[part[own]][:, None] == numbers[None])
                product[own[i], j] = -np.inf
            floor = best.theta[part]
            if product.shape[1] > best.k:
                open_ = np.flatnonzero(np.isneginf(floor))
                floor[open_] = np.partition(product[open_], -best.k, axis=1)[:, -best.k]
            i, j = np.nonzero((product >= floor[:, None] - MARGIN) & ~np.isneginf(product))
            best.add(part[i], product[i, j], bucket.ids[numbers[j]])
        return len(rows) * len(numbers)

    length = queries.lengths
    theta = best.theta - MARGIN
    reach = length * bucket.longest
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(reach > 0, theta / reach, np.where(theta > 0, np.inf, -np.inf))
    alive = ~(local > 1)
    by_coordinate = alive & (local >= coordinate_from)
    rows = np.flatnonzero(alive & ~by_coordinate)
    if len(rows):
        # lengths descend in a bucket: those that may be enough are a prefix, a positive threshold given
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(theta[rows] > 0, theta[rows] / length[rows], -np.inf)
        prefix = np.searchsorted(-bucket.lengths, -least, side="right")
        for stop in np.unique(prefix[prefix > 0]) if len(np.unique(prefix)) < 16 else [prefix.max()]:
            mine = rows[prefix == stop] if len(np.unique(prefix)) < 16 else rows
            computed += verify(mine, slice(0, int(stop)))
    rows = np.flatnonzero(by_coordinate)
    if len(rows):
        direction = queries.vectors[rows] / length[rows][:, None]
        focus = np.abs(direction).argmax(1)
        value = direction[np.arange(len(rows)), focus]
        c = np.minimum(local[rows], 1)
        width = np.sqrt((1 - c * c) * np.maximum(0, 1 - value * value)) + 1e-9
        # a vector of at least this cosine has the coordinate within these bounds; a larger cosine narrows them, but for the end beyond the query's own
        low = np.where(value >= -c, value * c - width, -1.0)
        high = np.where(value <= c, value * c + width, 1.0)
        low, high = np.where(-value > c, -1.0, low), np.where(value > c, 1.0, high)
        for f in np.unique(focus):
            mine = np.flatnonzero(focus == f)
            order, values = bucket.by_coordinate(int(f))
            a, b = np.searchsorted(values, low[mine], side="left"), np.searchsorted(values, high[mine], side="right")
            # queries of like ranges together
            turn = np.argsort(a, kind="stable")
            for group in np.array_split(turn, max(1, len(turn) // 64)):
                start, stop = int(a[group].min()), int(b[group].max())
                if start < stop:
                    computed += verify(rows[mine[group]], order[start:stop])
    return computed


def _vectors(values: pa.ListArray, d: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), d)


def _buckets(bucket_rows: int):
    """Rows (id, v, d, asks), by dimension and in descending length, become buckets of one dimension and at most ``bucket_rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] | None = None

        def give(n: int) -> pa.RecordBatch:
            ids, vectors, asks = (x[:n] for x in held)
            return pa.RecordBatch.from_arrays(
                [pa.array([part * 1_000_000 + made]), pa.array([vectors.shape[1]], pa.int32()), pa.array([int(asks.sum())], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, vectors, asks))], names=["bucket", "d", "n_asks", "ids", "vectors", "asks"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column(2).to_numpy()
            for begin, end in zip(*(lambda at: (np.r_[0, at], np.r_[at, len(dims)]))(np.flatnonzero(np.diff(dims)) + 1)):
                rows = batch.slice(begin, end - begin)
                d = int(dims[begin])
                more = [rows.column(0).to_numpy(), _vectors(rows.column(1), d), rows.column(3).to_numpy(zero_copy_only=False)]
                if held is not None and held[1].shape[1] != d:
                    yield give(bucket_rows)
                    held, made = None, made + 1
                held = more if held is None else [np.concatenate(x) for x in zip(held, more)]
                while len(held[0]) > bucket_rows:
                    yield give(bucket_rows)
                    held, made = [x[bucket_rows:] for x in held], made + 1
        if held is not None:
            yield give(bucket_rows)

    return run


def _bucket(row: dict) -> Bucket:
    ids = np.frombuffer(row["ids"], np.int64)
    return Bucket(row["bucket"], ids, np.frombuffer(row["vectors"], np.float64).reshape(len(ids), row["d"]))


def _asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The queries of each bucket: (bucket, d, place in the bucket, id, vector)."""
    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            own = _bucket(row)
            at = np.flatnonzero(np.frombuffer(row["asks"], bool))
            if len(at):
                cells = [pa.array([x] * len(at), t) for x, t in ((row["bucket"], pa.int64()), (row["d"], pa.int32()))]
                yield pa.RecordBatch.from_arrays([*cells, pa.array(at.astype(np.int32)), pa.array(own.ids[at]), pa.array([v.tobytes() for v in own.vectors[at]], pa.binary())], names=["bucket", "d", "place", "id", "vector"])


def _blocks(queries: DataFrame, block_bytes: int) -> Iterator[Queries]:
    """The queries in blocks of one dimension and a bounded size, streamed through the driver."""
    held: list = []
    for row in queries.toLocalIterator():
        if held and (held[0]["d"] != row["d"] or len(held) * 8 * held[0]["d"] >= block_bytes):
            yield Queries.of(held)
            held = []
        held.append(row)
    if held:
        yield Queries.of(held)


def _search(shared, k: int, coordinate_from: float):
    """The best of the buckets of a task for each query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = Best(len(queries.ids), k, queries.floor)
        for batch in batches:
            for i in range(batch.num_rows):
                search_bucket(queries, best, _bucket(batch.slice(i, 1).to_pylist()[0]), coordinate_from)
        row, rank = np.nonzero(~np.isneginf(best.score))
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(best.ids[row, rank]), pa.array(best.score[row, rank] + 0.0)], names=["query", "neighbour", "score"])

    return run


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", asks: Column | None = None, k: int = K, bucket_rows: int = BUCKET_ROWS, block_bytes: int = BLOCK_BYTES, coordinate_from: float = COORDINATE_FROM) -> DataFrame:
    """For every query the ``k`` other vectors of greatest inner product: (vec_id, rank, neighbour_id, score).

    Queries are the rows for which ``asks`` is true, all if it is None; each is held against all rows of its dimension. Products are
    rounded to nine decimals; ties go to the lesser id, a null id last. A row is not its own neighbour, a repeated row is. Rows
    whose vector is null or empty or holds a null or a value that isn't finite take no part. Ids are whole numbers below
    2**63 - 1, which stands for null. With fewer than k others there are fewer rows; other columns aren't read.

    The vectors are shuffled once, into buckets that are written; the queries travel in blocks of ``block_bytes``, and no
    pair of a block and a bucket is shipped. A block's first bucket, of the longest vectors, gives each query a threshold
    that all other buckets are pruned by.
    """
    spark = vectors.sparkSession
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asking = F.coalesce(F.lit(True) if asks is None else asks, F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), asking.alias("asks")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    n = rows.count()
    schema = "vec_id long, rank int, neighbour_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    rows = rows.withColumn("d", F.size("v")).withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    order = ["d", F.desc("length"), "id"]
    ordered = rows.repartitionByRange(-(-n // bucket_rows), *order).sortWithinPartitions(*order).select(F.coalesce("id", F.lit(int(NO_ID))).alias("id"), "v", "d", "asks")
    buckets = cut(ordered.mapInArrow(_buckets(bucket_rows), "bucket long, d int, n_asks int, ids binary, vectors binary, asks binary"))
    queries = cut(buckets.where("n_asks > 0").mapInArrow(_asking, "bucket long, d int, place int, id long, vector binary")).orderBy("d", "bucket", "place")
    longest = {r["d"]: r["b"] for r in buckets.groupBy("d").agg(F.min("bucket").alias("b")).collect()}  # one row a dimension
    payload = buckets.select("bucket", "d", "ids", "vectors")
    found, lists = [], f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    for number, block in enumerate(_blocks(queries, block_bytes)):
        of = payload.where(F.col("d") == block.d)

        def met(part: DataFrame, block: Queries = block) -> DataFrame:
            shared = spark.sparkContext.broadcast(block)  # bounded by block_bytes
            hits = part.mapInArrow(_search(shared, k, coordinate_from), "query int, neighbour long, score double")
            return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "neighbour"))).where(F.col("rank") <= k)

        # at most one row a query of the block
        for r in met(of.where(F.col("bucket") == longest[block.d])).where(F.col("rank") == k).select("query", "score").collect():
            block.floor[r["query"]] = r["score"]
        ids = spark.createDataFrame(pd.DataFrame({"query": np.arange(len(block.ids), dtype=np.int32), "vec": block.ids}))
        met(of).join(F.broadcast(ids), "query").select("vec", "rank", "neighbour", "score").write.parquet(f"{lists}/block={number}")  # a block's ids
        found.append(number)
    if not found:
        return spark.createDataFrame([], schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(lists)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    real = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c))
    return spark.read.schema("vec long, rank int, neighbour long, score double").parquet(lists).select(real("vec").alias("vec_id"), "rank", real("neighbour").alias("neighbour_id"), "score")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all embeddings for each whose id is divisible by 20; null and broken vectors take no part."""
    return top_k(table(spark, sf_dir, "embeddings"), asks=F.col("vec_id") % 20 == 0)


SQL = f"""
WITH products AS (
  SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), {DECIMALS}) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT vec_id, rank::INT AS rank, neighbour_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour_id) AS rank FROM products) WHERE rank <= {K}
"""
