"""Every registered query against its SQL, over the driver's smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from chronoledger import plans

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_is_its_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, str(DATA))
    rows = got.collect()
    if name not in plans.ORACLES:
        assert got.columns
        return
    want = duck.sql(plans.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    expected = sorted((tuple(value(r[i]) for i in order) for r in want.fetchall()), key=str)
    assert sorted((tuple(value(r[c]) for c in columns) for r in rows), key=str) == expected


def test_oracles_name_queries():
    assert set(plans.ORACLES) <= set(plans.QUERIES)
