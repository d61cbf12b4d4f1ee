"""Topic models whose documents are projected together, and whose vocabulary stays where it is."""

from __future__ import annotations

import numpy as np

from lexispark.operators import topics
from lexispark.plans.registry import QUERIES


def test_documents_are_projected_together_as_one_by_one():
    rng = np.random.default_rng(5)
    h = rng.random((3, 20)) + 0.1
    docs = [(np.sort(rng.choice(20, n, replace=False)), rng.random(n)) for n in (1, 4, 20, 7)]

    def alone(ids, values):
        part = h[:, ids]
        a, b = part @ values, part @ part.T
        w = np.full(3, values.sum() / part.sum())
        for _ in range(30):
            w = w * a / np.maximum(b @ w, 1e-12)
        return w

    starts = np.cumsum([0, *(len(i) for i, _ in docs)])[:-1]
    found = topics._project(h, np.concatenate([i for i, _ in docs]), np.concatenate([v for _, v in docs]), starts)
    assert np.allclose(found, [alone(*d) for d in docs])


def test_the_driver_takes_no_vocabulary_for_a_termite_table(spark, sf, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    real, rows = DataFrame.collect, []
    monkeypatch.setattr(DataFrame, "collect", lambda self: rows.append(len(x := real(self))) or x)
    out = QUERIES["termite_table"](spark, sf)
    assert max(rows, default=0) <= 6 and len(real(out)) == 6
