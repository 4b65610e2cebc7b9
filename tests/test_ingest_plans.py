"""What the ingest's queries read, and what a batch moves."""

import os

import pytest

from plinth.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["w4_insert_leads", "w5_insert_junction"])
def test_signals_are_numbered_once(spark, name):
    """Numbering takes a shuffle of all signals; the tables' plans read what one such pass has left of them."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_staged_buckets_are_not_dealt_again(spark, tmp_path):
    """What is staged lies by bucket, so applying it moves no row between tasks."""
    from plinth.operators import stored

    held, name = stored.Stored(spark, str(tmp_path), 4), "parcels"
    rows = spark.createDataFrame([(f"a{i}", i) for i in range(40)], "apn string, n int").withColumn("bucket", held._bucket(name))
    held._write(rows, held._path("staged", "b", name))
    staged = spark.read.schema(rows.schema).parquet(held._path("staged", "b", name))
    held._write(staged, held._path(name), together=True)
    assert sorted(tuple(r) for r in held.read(name).collect()) == sorted((f"a{i}", i) for i in range(40))
    assert all(x.name.startswith("bucket=") or x.name.startswith(("_", ".")) for x in (tmp_path / name).iterdir())
