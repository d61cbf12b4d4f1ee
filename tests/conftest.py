"""A session for all tests, and where the driver's tables lie."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for the Python workers

from lexispark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return "/root/testdata/sf0.001"


def same_rows(spark, df, sql: str, sf_dir: str) -> None:
    """Asserts that DuckDB's answer has the rows of ``df``; doubles to nine significant digits."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)

    def plain(x):
        if isinstance(x, float):
            return float(f"{x:.9g}") + 0.0
        if isinstance(x, (list, tuple)):
            return tuple(map(plain, x))
        return x

    columns = sorted(df.columns)
    at = [names.index(c) for c in columns]
    key = repr
    expected = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=key)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    assert len(found) == len(expected)
    assert found == expected
