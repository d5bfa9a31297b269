"""Every query that SQL can express gives the rows its SQL gives."""

import math
import os

import duckdb
import pytest

from gristmill.plans import registry

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or isinstance(value, float) and math.isnan(value):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, list | tuple):
        return str([plain(x) for x in value])
    try:
        return f"{float(value):.6f}"
    except (TypeError, ValueError):
        return str(value)


def rows(table):
    names = sorted(table.column_names)
    return sorted(tuple(plain(x) for x in r) for r in zip(*(table.column(n).to_pylist() for n in names), strict=True))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toArrow()
    want = duck.execute(registry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)
