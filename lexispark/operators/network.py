"""Networks of co-occurring or similar items, and ranks of their nodes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.columns import col
from lexispark.functions.similarity import METRICS
from lexispark.shared import written

EDGES = "src string, dst string, weight double"


def cooccurrences(words: Column, window_size: int = 2) -> Column:
    """(src, dst, n) of each two places of one window, with the number of windows that hold both.

    Windows of the size slide over the sequence; a shorter sequence is one window. Two places i < j lie together in
    min(i, len - size) - max(0, j - size + 1) + 1 windows, so that no window is ever made.
    """
    w = col(words)
    size = F.least(F.lit(window_size), F.size(w))
    last = F.size(w) - size

    def pairs(i: Column) -> Column:
        others = F.when(i + 1 <= F.least(F.size(w) - 1, i + size - 1), F.sequence(i + 1, F.least(F.size(w) - 1, i + size - 1))).otherwise(F.array().cast("array<int>"))

        def one(j: Column) -> Column:
            a, b = F.element_at(w, i + 1), F.element_at(w, j + 1)
            return F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), (F.least(i, last) - F.greatest(F.lit(0), j - size + 1) + 1).alias("n"))

        return F.transform(others, one)

    starts = F.when(F.size(w) > 1, F.sequence(F.lit(0), F.size(w) - 2)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, pairs))


def build_cooccurrence_network(df: DataFrame, *, words_col: str = "words", window_size: int = 2, edge_weighting: str = "count", graph_col: str | None = None) -> DataFrame:
    """Edges (src, dst, weight) of all sequences together, or of each value of ``graph_col``; src is the lesser of two words.

    ``count`` adds up the windows in which two words stand, ``binary`` gives 1.
    """
    if window_size < 2:
        raise ValueError("window_size is 2 at least")
    if edge_weighting not in ("count", "binary"):
        raise ValueError(f"edge_weighting = {edge_weighting!r}; known are count and binary")
    by = [graph_col] if graph_col else []
    pairs = df.select(*by, F.explode(cooccurrences(F.col(words_col), window_size)).alias("p"))
    weight = F.sum("p.n").cast("double") if edge_weighting == "count" else F.lit(1.0)
    return pairs.groupBy(*by, F.col("p.src").alias("src"), F.col("p.dst").alias("dst")).agg(F.sum("p.n").alias("_n"), weight.alias("weight")).drop("_n")


def build_similarity_network(df: DataFrame, edge_weighting: str | Callable[[Column, Column], Column], *, id_col: str, value_col: str) -> DataFrame:
    """The complete graph over rows, its weights a similarity by name or a function of two columns; every two rows meet once."""
    metric = METRICS[edge_weighting] if isinstance(edge_weighting, str) else edge_weighting
    a, b = df.select(F.col(id_col).alias("src"), F.col(value_col).alias("x")), df.select(F.col(id_col).alias("dst"), F.col(value_col).alias("y"))
    return a.join(b, F.col("src") < F.col("dst")).select("src", "dst", metric("x", "y").alias("weight"))


def pagerank(nodes: list[str], src: np.ndarray, dst: np.ndarray, weight: np.ndarray, *, directed: bool = False, alpha: float = 0.85, tol: float = 1e-6, max_iter: int = 100, personalization: np.ndarray | None = None) -> np.ndarray:
    """Ranks of one graph's nodes, which sum to 1; nodes without outgoing weight give theirs to all."""
    n = len(nodes)
    if not n:
        return np.zeros(0)
    if not directed:
        loops = src == dst
        src, dst, weight = np.r_[src, dst[~loops]], np.r_[dst, src[~loops]], np.r_[weight, weight[~loops]]
    out = np.bincount(src, weight, n)
    share = weight / np.where(out[src] > 0, out[src], 1)
    start = np.full(n, 1 / n) if personalization is None or not personalization.sum() else personalization / personalization.sum()
    x = np.full(n, 1 / n)
    for _ in range(max_iter):
        new = alpha * (np.bincount(dst, share * x[src], n) + x[out == 0].sum() * start) + (1 - alpha) * start
        done = np.abs(new - x).sum() < n * tol
        x = new
        if done:
            break
    return x


def _indexed(edges: pd.DataFrame) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    nodes, at = np.unique(np.concatenate([edges["src"].to_numpy(object), edges["dst"].to_numpy(object)]), return_inverse=True)
    return list(nodes), at[: len(edges)], at[len(edges) :], edges["weight"].to_numpy(float)


def _per_graph(edges: DataFrame, graph_col: str | None, rank: Callable[[list, np.ndarray, np.ndarray, np.ndarray], dict]) -> DataFrame:
    """(graph, node, score) of each graph by itself; a graph fits into a worker's memory."""
    key = graph_col or "_graph"
    e = edges if graph_col else edges.withColumn(key, F.lit(0))
    kind = e.schema[key].dataType.simpleString()

    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = rank(*_indexed(rows))
        return pd.DataFrame({key: [group[0]] * len(found), "node": list(found), "score": list(found.values())})

    out = e.select(key, "src", "dst", "weight").groupBy(key).applyInPandas(run, f"{key} {kind}, node {e.schema['src'].dataType.simpleString()}, score double")
    return out if graph_col else out.drop(key)


def rank_nodes_by_pagerank(edges: DataFrame, *, graph_col: str | None = None, directed: bool = False, **options) -> DataFrame:
    return _per_graph(edges, graph_col, lambda nodes, s, d, w: dict(zip(nodes, pagerank(nodes, s, d, w, directed=directed, **options))))


def pagerank_distributed(edges: DataFrame, *, alpha: float = 0.85, tol: float = 1e-6, max_iter: int = 100) -> DataFrame:
    """(node, score) of one graph that needn't fit anywhere: each round is a join and an aggregation, written to the shared folder."""
    both = edges.select("src", "dst", "weight").unionAll(edges.where("src <> dst").select("dst", "src", "weight"))
    total = both.groupBy("src").agg(F.sum("weight").alias("total"))
    links = written(both.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    nodes = links.select(F.col("src").alias("node")).distinct()
    n = nodes.count()
    if not n:
        return nodes.withColumn("score", F.lit(0.0))
    ranks = written(nodes.withColumn("score", F.lit(1.0 / n)))
    for _ in range(max_iter):
        got = links.join(ranks.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("score")).alias("got"))
        new = written(ranks.join(got, "node", "left").select("node", F.col("score").alias("old"), (F.lit(alpha) * F.coalesce("got", F.lit(0.0)) + F.lit((1 - alpha) / n)).alias("score")))
        change = new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
        ranks = new.select("node", "score")
        if change < n * tol:
            break
    return ranks


def bestcoverage(nodes: list, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, k: int, c: int = 1, alpha: float = 1.0) -> dict:
    """The ``k`` nodes that greedily cover most rank within ``c`` steps, what is covered counting less by ``alpha``."""
    ranks = pagerank(nodes, src, dst, weight, tol=1e-8)
    near: list[set[int]] = [set() for _ in nodes]
    for a, b in zip(src.tolist(), dst.tolist()):
        near[a].add(b)
        near[b].add(a)

    def reach(v: int) -> set[int]:
        out, edge = {v}, {v}
        for _ in range(c):
            edge = set().union(*(near[x] for x in edge))
            out |= edge
        return out

    gain = [sum(ranks[x] for x in reach(v)) for v in range(len(nodes))]
    taken, out = set(), {}
    for _ in range(min(k, len(nodes))):
        best = max(range(len(nodes)), key=lambda v: (gain[v], -v))
        out[nodes[best]] = float(gain[best])
        for v in reach(best) - taken:
            for x in reach(v):
                gain[x] -= alpha * ranks[v]
            taken.add(v)
        gain[best] = 0.0
    return out


def rank_nodes_by_bestcoverage(edges: DataFrame, k: int, *, c: int = 1, alpha: float = 1.0, graph_col: str | None = None) -> DataFrame:
    return _per_graph(edges, graph_col, lambda nodes, s, d, w: bestcoverage(nodes, s, d, w, k, c, alpha))


def divrank(nodes: list, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, r: np.ndarray | None = None, lambda_: float = 0.5, alpha: float = 0.5) -> dict:
    """Ranks by a walk that reinforces what it has visited."""
    n = len(nodes)
    w = np.zeros((n, n))
    w[src, dst] = weight
    w[dst, src] = weight
    rows = w.sum(1, keepdims=True)
    w = np.divide(w, rows, out=np.zeros_like(w), where=rows > 0)
    r = np.full(n, 1 / n) if r is None else np.asarray(r, float).ravel()
    p = np.full(n, 1 / n)
    for _ in range(1000):
        # the first column goes from the diagonal
        step = alpha * w * p
        step = step - np.diag(step[:, 0]) + (1 - alpha) * np.diag(p)
        step = (1 - lambda_) * step / step.sum(1, keepdims=True) + lambda_ * r
        new = p @ step
        done = np.abs(new - p).sum() / p.sum() <= 1e-3
        p = new
        if done:
            break
    return {nodes[i]: float(p[i]) for i in np.argsort(-p, kind="stable")}


def rank_nodes_by_divrank(edges: DataFrame, *, r: np.ndarray | None = None, lambda_: float = 0.5, alpha: float = 0.5, graph_col: str | None = None) -> DataFrame:
    return _per_graph(edges, graph_col, lambda nodes, s, d, w: divrank(nodes, s, d, w, r, lambda_, alpha))
