"""Every registered query against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from tracewell.registry import registered

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v) -> str:
    """A value as text, whatever type pandas gave it: nulls, truth values and numbers are told apart."""
    if pd.isna(v):
        return "-"
    kind = getattr(getattr(v, "dtype", None), "kind", "")
    if isinstance(v, bool) or kind == "b":
        return str(bool(v))
    return f"{float(v):.9g}" if isinstance(v, (int, float)) or kind in tuple("fiu") else str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registered()))
def test_matches_sql(spark, duck, name):
    query = registered()[name]
    got = query.run(spark, SF).toPandas()
    want = duck.sql(query.sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
