"""The queries that SQL can express give what it gives on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from lacuna.llm import queries


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        path = Path(sf, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if path.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, sf, name):
    got = queries.queries()[name](spark, sf)
    want = duck.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    places = [want.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[k] for k in places) for r in want.fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 11))
