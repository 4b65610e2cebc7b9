"""Tables for point lookups: Parquet sorted by a key, with Bloom filters of it, so that a lookup reads few row groups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group, and distinct keys that its filter is made for.
GROUP_BYTES, GROUP_KEYS = 8 << 20, 100_000


def write_clustered(rows: DataFrame, key: str, path: str, group_bytes: int = GROUP_BYTES, group_keys: int = GROUP_KEYS) -> None:
    """Write ``rows`` in ranges of ``key``, sorted by it: least and greatest keys rule out most row groups, filters the rest."""
    options = {f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": str(group_keys), "parquet.block.size": str(group_bytes)}
    rows.repartitionByRange(key).sortWithinPartitions(key).write.options(**options).parquet(path)


def lookup(spark: SparkSession, path: str, key: str, keys: Iterable[str]) -> DataFrame:
    """The rows of the given keys; the condition reaches the scan, with each key up to the session's limit of an IN list there."""
    return spark.read.parquet(path).where(F.col(key).isin(*keys))
