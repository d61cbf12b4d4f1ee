"""Comments by month."""

from __future__ import annotations

import re

from lexispark.plans.registry import QUERIES


def test_months_are_written_in_one_pass(spark, sf, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    real, paths = DataFrameWriter.json, []
    monkeypatch.setattr(DataFrameWriter, "json", lambda self, path, **k: paths.append(path) or real(self, path, **k))
    assert QUERIES["reddit_comments"](spark, sf).count()
    assert len(paths) == 1 and not re.search("RC_", paths[0])
