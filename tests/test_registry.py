"""Queries against their DuckDB oracles on the smallest tables."""

import os

import duckdb
import pytest

from plinth.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else str(v) if v is not None else None for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cursor = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.select(*columns).collect()) == plain(cursor.fetchall())
