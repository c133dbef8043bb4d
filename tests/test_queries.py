"""Every registered analytics query against its SQL, over whole tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tracelode import (
    file_queries,  # noqa: F401  registers its queries
    queries,
)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, small, duck, name):
    got = queries.QUERIES[name](spark, small)
    want = duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    places = [want.columns.index(c) for c in columns]
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got.collect()) == sorted(
        repr([plain(r[k]) for k in places]) for r in want.fetchall()
    )
