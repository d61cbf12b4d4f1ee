"""Networks of words and of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions.tokens import lower_words
from lexispark.operators import network
from lexispark.plans.registry import query, table
from lexispark.plans.texts import W

#: The windows of three that hold both places, as a sum over windows, made one by one.
_WINDOWS = f"""d AS (SELECT doc_id, regexp_extract_all(lower(text), '{W}') AS w FROM documents),
    s AS (SELECT doc_id, w, least(3, len(w)) AS n, unnest(range(1, greatest(len(w) - 1, 2))) AS a FROM d WHERE len(w) > 0),
    p AS (SELECT doc_id, w[a:a + n - 1] AS v FROM s), i AS (SELECT v, unnest(range(1, len(v))) AS x FROM p), j AS (SELECT v, x, unnest(range(x + 1, len(v) + 1)) AS y FROM i)"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", lower_words("text").alias("words"))


@query(f"WITH {_WINDOWS} SELECT least(v[x], v[y]) AS src, greatest(v[x], v[y]) AS dst, count(*)::DOUBLE AS weight FROM j GROUP BY ALL")
def cooccurrence_network(spark, sf_dir):
    return network.build_cooccurrence_network(_docs(spark, sf_dir), window_size=3)


@query(f"WITH {_WINDOWS} SELECT DISTINCT least(v[x], v[y]) AS src, greatest(v[x], v[y]) AS dst, 1.0::DOUBLE AS weight FROM j")
def cooccurrence_network_binary(spark, sf_dir):
    return network.build_cooccurrence_network(_docs(spark, sf_dir), window_size=3, edge_weighting="binary")


@query(f"SELECT a.item_id AS src, b.item_id AS dst, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS weight FROM (SELECT item_id, regexp_extract_all(lower(text), '{W}') AS w FROM benchmark) a JOIN (SELECT item_id, regexp_extract_all(lower(text), '{W}') AS w FROM benchmark) b ON a.item_id < b.item_id")
def similarity_network(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", lower_words("text").alias("w"))
    return network.build_similarity_network(items, "jaccard", id_col="item_id", value_col="w").withColumn("weight", F.round("weight", 6))


@query(f"""WITH RECURSIVE d AS (SELECT regexp_extract_all(lower(text), '{W}') AS w FROM documents), p AS (SELECT unnest(w[1:len(w) - 1]) AS a, unnest(w[2:]) AS b FROM d WHERE len(w) > 1),
    u AS (SELECT least(a, b) AS s, greatest(a, b) AS d, count(*)::DOUBLE AS w FROM p GROUP BY ALL), e AS MATERIALIZED (SELECT s, d, w FROM u UNION ALL SELECT d, s, w FROM u WHERE s <> d), o AS MATERIALIZED (SELECT s, sum(w) AS t FROM e GROUP BY s),
    h AS MATERIALIZED (SELECT e.s, e.d, w / t AS w FROM e JOIN o USING (s)), n AS (SELECT count(*) AS n FROM o),
    r AS (SELECT 0 AS k, s AS node, 1 / n::DOUBLE AS x FROM o, n UNION ALL SELECT k + 1, h.d, 0.85 * sum(h.w * r.x) + 0.15 / any_value(n.n) FROM r JOIN h ON h.s = r.node, n WHERE k < 40 GROUP BY k, h.d),
    c AS (SELECT y.k, sum(abs(y.x - z.x)) AS c FROM r y JOIN r z ON y.node = z.node AND y.k = z.k + 1 GROUP BY y.k)
    SELECT node, round(x, 9) AS score FROM r WHERE k = (SELECT min(k) FROM c, n WHERE c < n * 1e-6)""")  # fmt: skip
def pagerank_of_words(spark, sf_dir):
    """Until all ranks together change by less than a millionth of their number."""
    edges = network.build_cooccurrence_network(_docs(spark, sf_dir), window_size=2)
    return network.pagerank_distributed(edges).withColumn("score", F.round("score", 9))


def _items(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("item"), lower_words("text").alias("w"))
    return network.build_similarity_network(items, "cosine", id_col="item", value_col="w").where("weight > 0")


@query()
def bestcoverage_of_items(spark, sf_dir):
    return network.rank_nodes_by_bestcoverage(_items(spark, sf_dir), k=10)


@query()
def divrank_of_items(spark, sf_dir):
    return network.rank_nodes_by_divrank(_items(spark, sf_dir))
