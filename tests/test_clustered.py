"""Point lookups read a fraction of the row groups, by ranges and by Bloom filters."""

from pyspark.sql import functions as F

from plinth.sources import clustered


def rows_read(df):
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_lookups_read_few_groups(spark, tmp_path):
    n, path = 40_000, str(tmp_path / "t")
    rows = spark.range(n).select(F.format_string("%03d-%03d-%03d", (F.col("id") / 500_000).cast("int"), ((F.col("id") * 2) / 1000).cast("int"), (F.col("id") * 2) % 1000).alias("apn"), F.sha2(F.col("id").cast("string"), 256).alias("rest"))
    clustered.write_clustered(rows, "apn", path, group_bytes=64 << 10, group_keys=5000)
    one = clustered.lookup(spark, path, "apn", ["000-010-002"])
    assert [r.apn for r in one.collect()] == ["000-010-002"]
    assert 0 < rows_read(one) < n / 4
    several = clustered.lookup(spark, path, "apn", ["000-010-002", "000-079-998"])
    assert several.count() == 2 and rows_read(several) < n / 2
    absent = clustered.lookup(spark, path, "apn", ["000-010-003"])  # inside a group's range, so only its filter rules it out
    assert absent.count() == 0 and rows_read(absent) == 0
