"""Queries against their oracles where keys are as large as in tables of 1 GB: house numbers there have seven digits."""

import os

import duckdb
import pytest

from plinth.plans import registry
from tests.test_registry import SF, TABLES, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """The smallest tables, part keys raised to either side of a million."""
    folder, c = tmp_path_factory.mktemp("shifted"), duckdb.connect()
    for name in TABLES:
        source = f"SELECT * REPLACE (l_partkey + 999900 AS l_partkey) FROM '{SF}/lineitem.parquet'" if name == "lineitem" else f"SELECT * FROM '{SF}/{name}.parquet'"
        c.execute(f"COPY ({source}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), c


@pytest.mark.parametrize("name", ["x6_addresses", "x7_labelled_addresses", "x12_item_headers", "x17_page_signals", "x22_exhibit_apns", "x23_apn_sweep", "x24_regex_tier"])
def test_addresses_with_long_house_numbers(spark, shifted, name):
    folder, c = shifted
    df = registry.QUERIES[name](spark, folder)
    cursor = c.execute(registry.ORACLE_SQL[name])
    columns = [x[0] for x in cursor.description]
    assert plain(df.select(*columns).collect()) == plain(cursor.fetchall())
