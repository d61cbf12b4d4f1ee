"""Topic models over long-form matrices: lda, lsa and nmf, what they say of topics, terms and documents, and termite plots."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import LDA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.shared import got, put, written

SEED = 1


def rows_of(matrix: DataFrame, value_col: str = "weight") -> DataFrame:
    """(doc_id, term_ids, values) of a long-form matrix, ids ascending."""
    cell = F.struct(F.col("term_id").cast("int").alias("id"), F.col(value_col).cast("double").alias("v"))
    grouped = matrix.groupBy("doc_id").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    return grouped.select("doc_id", F.transform("c", lambda x: x["id"]).alias("term_ids"), F.transform("c", lambda x: x["v"]).alias("values"))


def _vectors(rows: DataFrame, n_terms: int) -> DataFrame:
    @F.pandas_udf(VectorUDT())
    def as_vector(ids: pd.Series, values: pd.Series) -> pd.DataFrame:
        # the fields of a sparse vector
        return pd.DataFrame({"type": np.zeros(len(ids), np.int8), "size": np.full(len(ids), n_terms, np.int32), "indices": ids, "values": values})

    return rows.select("doc_id", as_vector("term_ids", "values").alias("features"))


@dataclass
class TopicModel:
    """A model of ``n_topics``: its topic-term matrix, of the vocabulary's size, and how documents are projected on it."""

    model: str = "nmf"
    n_topics: int = 10
    max_iter: int = 20
    #: Topic by term.
    components: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.model not in ("nmf", "lda", "lsa"):
            raise ValueError(f"model = {self.model!r}; known are nmf, lda and lsa")

    def fit(self, matrix: DataFrame, n_terms: int, *, value_col: str = "weight") -> TopicModel:
        rows = written(rows_of(matrix, value_col))
        if self.model == "lda":
            fitted = LDA(k=self.n_topics, maxIter=self.max_iter, seed=SEED, optimizer="online", learningOffset=10.0, learningDecay=0.7).fit(_vectors(rows, n_terms))
            self._lda = fitted
            self.components = fitted.topicsMatrix().toArray().T
        elif self.model == "lsa":
            # every product with the matrix reads it: in the JVM, from memory or the shared folder
            vectors = MLUtils.convertVectorColumnsFromML(written(_vectors(rows, n_terms).select("features")), "features").persist(StorageLevel.MEMORY_AND_DISK)
            self.components = RowMatrix(vectors, numCols=n_terms).computeSVD(self.n_topics).V.toArray().T
            vectors.unpersist()
        else:
            self.components = self._nmf(rows, n_terms)
        return self

    def partial_fit(self, matrix: DataFrame) -> TopicModel:
        raise TypeError("models are fitted on all documents at once; call fit again")

    def _nmf(self, rows: DataFrame, n_terms: int) -> np.ndarray:
        """Multiplicative updates: documents are projected on the topics in their partitions, and only sums over them come back."""
        rng = np.random.default_rng(SEED)
        h = rng.random((self.n_topics, n_terms)) + 0.1
        context = rows.sparkSession.sparkContext
        k = self.n_topics
        for _ in range(self.max_iter):
            shared = context.broadcast(h)  # topics by terms: bounded by the vocabulary

            def sums(batches: Iterator[pd.DataFrame], shared=shared, k=k) -> Iterator[pd.DataFrame]:
                top, own = np.zeros(shared.value.T.shape), np.zeros((k, k))
                for batch in batches:
                    for ids, values, starts in _cells(batch):
                        w = _project(shared.value, ids, values, starts)
                        cells = np.repeat(w, np.diff(np.r_[starts, len(ids)]), 0) * values[:, None]
                        order = np.argsort(ids, kind="stable")
                        found, first = np.unique(ids[order], return_index=True)
                        top[found] += np.add.reduceat(cells[order], first)
                        own += w.T @ w
                at = np.flatnonzero(top.any(1))
                # the products of topics have the numbers -1, -2, ...
                yield pd.DataFrame({"i": -1 - np.arange(k, dtype=np.int32), **{f"t{j}": own[:, j] for j in range(k)}})
                for a in range(0, len(at), 10_000):
                    part = at[a : a + 10_000]
                    yield pd.DataFrame({"i": part.astype(np.int32), **{f"t{j}": top[part, j] for j in range(k)}})

            names = [f"t{j}" for j in range(k)]
            partial = rows.mapInPandas(sums, ", ".join(["i int", *[f"{n} double" for n in names]]))
            found = partial.groupBy("i").agg(*[F.sum(n).alias(n) for n in names]).toPandas()  # a row for each term
            i, t = found["i"].to_numpy(), found[names].to_numpy(float)
            a, b = np.zeros_like(h), np.zeros((k, k))
            a[:, i[i >= 0]] = t[i >= 0].T
            b[-1 - i[i < 0]] = t[i < 0]
            h = h * a / np.maximum(b @ h, 1e-12)
            shared.unpersist()
        return h

    def transform(self, matrix: DataFrame, *, value_col: str = "weight") -> DataFrame:
        """(doc_id, topic, weight)"""
        if self.components is None:
            raise ValueError("fit comes before transform")
        rows = rows_of(matrix, value_col)
        if self.model == "lda":
            found = self._lda.transform(_vectors(rows, self.components.shape[1])).select("doc_id", vector_to_array("topicDistribution").alias("w"))
        else:
            shared, nmf = rows.sparkSession.sparkContext.broadcast(self.components), self.model == "nmf"
            kind = rows.schema["doc_id"].dataType.simpleString()

            def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    weights = [w for ids, values, starts in _cells(batch) for w in (_project(shared.value, ids, values, starts) if nmf else np.add.reduceat(shared.value.T[ids] * values[:, None], starts)).tolist()]
                    yield pd.DataFrame({"doc_id": batch["doc_id"], "w": weights})

            found = rows.mapInPandas(project, f"doc_id {kind}, w array<double>")
        return found.select("doc_id", F.posexplode("w").alias("topic", "weight"))

    def get_doc_topic_matrix(self, matrix: DataFrame, *, normalize: bool = True, value_col: str = "weight") -> DataFrame:
        found = self.transform(matrix, value_col=value_col)
        if not normalize:
            return found
        total = F.sum("weight").over(Window.partitionBy("doc_id"))
        return found.withColumn("weight", F.coalesce(F.try_divide("weight", total), F.lit(0.0)))

    def topic_terms(self, vocabulary: DataFrame) -> DataFrame:
        """(topic, term, weight)"""
        shared = vocabulary.sparkSession.sparkContext.broadcast(self.components)

        def weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"term": batch["term"], "w": shared.value[:, batch["term_id"].to_numpy()].T.tolist()})

        kind = vocabulary.schema["term"].dataType.simpleString()
        return vocabulary.select("term", "term_id").mapInPandas(weights, f"term {kind}, w array<double>").select("term", F.posexplode("w").alias("topic", "weight"))

    def top_topic_terms(self, vocabulary: DataFrame, *, topics: int | list[int] = -1, top_n: int = 10) -> DataFrame:
        """(topic, rank, term, weight)"""
        return top_per(self.topic_terms(vocabulary), "topic", "term", topics, top_n)

    def save(self, path: str, *, spark: SparkSession | None = None) -> None:
        """To a folder of any file system that Spark reads."""
        spark = spark or SparkSession.getActiveSession()
        if self.model == "lda":
            self._lda.write().overwrite().save(path + "/lda")
        content = {"model": self.model, "n_topics": self.n_topics, "max_iter": self.max_iter}
        put(spark, path + "/model.json", json.dumps(content).encode())
        put(spark, path + "/components.bin", np.ascontiguousarray(self.components, "<f8").data.cast("B"))

    @classmethod
    def load(cls, path: str, *, spark: SparkSession | None = None) -> TopicModel:
        spark = spark or SparkSession.getActiveSession()
        x = json.loads(got(spark, path + "/model.json"))
        out = cls(x["model"], x["n_topics"], x["max_iter"], np.frombuffer(got(spark, path + "/components.bin"), "<f8").reshape(x["n_topics"], -1))
        if out.model == "lda":
            from pyspark.ml.clustering import LocalLDAModel

            out._lda = LocalLDAModel.load(path + "/lda")
        return out


#: Cells of a matrix that are projected together.
CELLS = 1 << 15


def _cells(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids and values of some documents of a batch, one after the other, and where each begins; every document has a cell."""
    ids, values = batch["term_ids"].to_numpy(), batch["values"].to_numpy()
    ends = np.cumsum([len(x) for x in ids])
    start = 0
    while start < len(ids):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + CELLS, "right")))
        yield np.concatenate(ids[start:stop]), np.concatenate(values[start:stop]), np.r_[0, ends[start : stop - 1] - before].astype(int)
        start = stop


def _project(h: np.ndarray, ids: np.ndarray, values: np.ndarray, starts: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights, for each document, of the topics that together come near its values."""
    part, k = h.T[ids], len(h)
    a = np.add.reduceat(part * values[:, None], starts)
    b = np.add.reduceat((part[:, :, None] * part[:, None, :]).reshape(-1, k * k), starts).reshape(-1, k, k)
    w = np.maximum(np.add.reduceat(values, starts), 1e-12) / np.maximum(np.add.reduceat(part.sum(1), starts), 1e-12)
    w = np.repeat(w[:, None], k, 1)
    for _ in range(rounds):
        w = w * a / np.maximum((b @ w[:, :, None])[:, :, 0], 1e-12)
    return w


def top_per(rows: DataFrame, group: str, item: str, chosen: int | list[int], n: int) -> DataFrame:
    """(group, rank, item, weight): the ``n`` greatest of each group, the lesser item on ties; ``chosen`` -1 is all groups."""
    if chosen != -1:
        rows = rows.where(F.col(group).isin([chosen] if isinstance(chosen, int) else chosen))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("weight"), item))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n).select(group, "rank", item, "weight")


def top_topic_docs(doc_topics: DataFrame, *, topics: int | list[int] = -1, top_n: int = 10) -> DataFrame:
    return top_per(doc_topics, "topic", "doc_id", topics, top_n)


def top_doc_topics(doc_topics: DataFrame, *, docs: int | list[int] = -1, top_n: int = 3) -> DataFrame:
    return top_per(doc_topics, "doc_id", "topic", docs, top_n)


def topic_weights(doc_topics: DataFrame) -> DataFrame:
    """(topic, weight): each topic's share of all weight."""
    sums = doc_topics.groupBy("topic").agg(F.sum("weight").alias("weight"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("weight").alias("total")))).select("topic", F.coalesce(F.try_divide("weight", "total"), F.lit(0.0)).alias("weight"))  # one row


def seriation(weights: np.ndarray) -> np.ndarray:
    """An order of rows in which like ones stand together: that of the Fiedler vector of their similarity."""
    similar = weights @ weights.T
    laplacian = np.diag(similar.sum(1)) - similar
    _, vectors = np.linalg.eigh(laplacian)
    return np.argsort(vectors[:, 1] if len(weights) > 1 else np.zeros(len(weights)), kind="stable")


def termite_df(components: np.ndarray, terms: list[str] | np.ndarray, *, topics: list[int] | None = None, n_terms: int = 25, rank_terms_by: str = "topic_weight", sort_terms_by: str = "seriation", topic_weights: np.ndarray | None = None, sort_topics_by: str = "index") -> pd.DataFrame:
    """The table of a termite plot: terms in rows, topics in columns.

    Terms are ranked by their weight in the topics (``topic_weight``), ``corpus_weight``, ``max``, ``mean`` or ``var``, and ordered by ``seriation``, ``weight``, ``index`` or
    ``alphabetical``.
    """
    topics = list(range(len(components))) if topics is None else topics
    if sort_topics_by == "weight" and topic_weights is not None:
        topics = sorted(topics, key=lambda t: -topic_weights[t])
    part = components[topics]
    scores = {"topic_weight": lambda: part.sum(0), "corpus_weight": lambda: components.sum(0), "max": lambda: part.max(0), "mean": lambda: part.mean(0), "var": lambda: part.var(0)}
    if rank_terms_by not in scores:
        raise ValueError(f"rank_terms_by = {rank_terms_by!r}; known are {sorted(scores)}")
    score = scores[rank_terms_by]()
    chosen = np.lexsort((terms, -score))[:n_terms]
    orders = {"seriation": lambda: chosen[seriation(part[:, chosen].T)], "weight": lambda: chosen, "index": lambda: np.sort(chosen), "alphabetical": lambda: np.array(sorted(chosen, key=lambda i: terms[i]), int)}
    if sort_terms_by not in orders:
        raise ValueError(f"sort_terms_by = {sort_terms_by!r}; known are {sorted(orders)}")
    order = orders[sort_terms_by]()
    return pd.DataFrame(part[:, order].T, index=[terms[i] for i in order], columns=[f"topic {t}" for t in topics])


def draw_termite_plot(table: pd.DataFrame, *, highlight_cols: list[int] | None = None, save: str | None = None):
    """Draws :func:`termite_df`'s table on the driver, if matplotlib is installed; at most six columns are highlighted."""
    import matplotlib.pyplot as plt

    if highlight_cols and len(highlight_cols) > 6:
        raise ValueError("six columns can be highlighted at most")
    fig, ax = plt.subplots(figsize=(len(table.columns), len(table) / 3))
    y, x = np.indices(table.shape)
    size = table.to_numpy() / max(table.to_numpy().max(), 1e-12) * 400
    ax.scatter(x.ravel(), y.ravel(), s=size.ravel(), c=["C1" if c in (highlight_cols or []) else "0.5" for c in x.ravel()])
    ax.set_xticks(range(len(table.columns)), table.columns, rotation=60)
    ax.set_yticks(range(len(table)), table.index)
    ax.invert_yaxis()
    if save:
        fig.savefig(save, bbox_inches="tight")
    return ax


def network_layout(edges: pd.DataFrame, *, spread: float = 3.0, rounds: int = 50) -> pd.DataFrame:
    """(node, x, y): a spring layout of a small network's edges."""
    nodes, at = np.unique(np.r_[edges["src"], edges["dst"]].astype(str), return_inverse=True)
    n = len(nodes)
    a, b = at[: len(edges)], at[len(edges) :]
    place = np.random.default_rng(SEED).random((n, 2))
    k = spread / np.sqrt(max(n, 1))
    for heat in np.linspace(0.1, 0.001, rounds):
        delta = place[:, None] - place[None]
        far = np.maximum(np.sqrt((delta**2).sum(-1)), 0.01)
        force = k * k / far**2
        np.add.at(force, (a, b), -far[a, b] / k * edges["weight"].to_numpy())
        np.add.at(force, (b, a), -far[a, b] / k * edges["weight"].to_numpy())
        move = (delta * force[..., None]).sum(1)
        place += move / np.maximum(np.sqrt((move**2).sum(-1, keepdims=True)), 1e-9) * heat
    return pd.DataFrame({"node": nodes, "x": place[:, 0], "y": place[:, 1]})
