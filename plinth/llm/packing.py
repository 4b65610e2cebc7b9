"""Packing into length buckets that are optimal for the corpus.

The histogram of all lengths (bins of one length below 128, then 64 per power of two: a few thousand at most, whatever
the corpus) goes to a dynamic programme, which places the buckets' upper bounds so that the padding is least. Inside a
bucket, rows fill batches of a token budget, in an order that needs no task for the whole bucket: by shard of the id,
with the shards' counts summed up beforehand.

Defined results: null and empty texts have no tokens and are padded to their bucket's bound as others are; a text over
the budget is a batch of its own, whole; rows that repeat, and null keys, share nothing but their bucket; equal keys are
placed by length, and equal rows alike; an empty table has no rows; columns beside the key and the text aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import WORD_PATTERN, materialize

BUCKETS, BUDGET = 16, 65_536
SHARD_ROWS, SHARDS = 500_000, 64


def token_count(text: Column) -> Column:
    """Words of a text, 0 if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def histogram(lengths: DataFrame) -> np.ndarray:
    """Rows (longest, rows, tokens) of the bins of column ``n_tokens``, by length."""
    spare = F.greatest(F.length(F.bin("n_tokens")) - 7, F.lit(0))
    step = F.pow(F.lit(2), spare).cast("long")
    bins = lengths.groupBy(F.floor(F.col("n_tokens") / step).alias("bin"), step.alias("step")).agg(F.max("n_tokens").alias("longest"), F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"))
    return np.array(sorted((r.longest, r.rows, r.tokens) for r in bins.collect()), np.int64).reshape(-1, 3)


def bounds(bins: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The upper bounds of at most ``buckets`` buckets that pad least, exactly, over whole bins."""
    if not len(bins):
        return []
    longest, rows, tokens = (bins[:, i].astype(np.float64) for i in range(3))
    rows, tokens = np.concatenate([[0], np.cumsum(rows)]), np.concatenate([[0], np.cumsum(tokens)])
    n, back = len(bins), []
    best = np.concatenate([[0], np.full(n, np.inf)])  # least padding of the first i bins with the buckets so far
    for _ in range(min(buckets, n)):
        # the last bucket holds bins j to i - 1 and pads each row to the longest of them
        cost = best[:-1, None] + longest[None, :] * (rows[None, 1:] - rows[:-1, None]) - (tokens[None, 1:] - tokens[:-1, None])
        cost[np.tril_indices(n, -1)] = np.inf
        back.append(cost.argmin(axis=0))
        best = np.concatenate([[0], cost.min(axis=0)])
    out, i = [], n
    for start in reversed(back):
        out.append(int(longest[i - 1]))
        i = int(start[i - 1])
        if not i:
            break
    return out[::-1]


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(key, n_tokens, bucket, pad_to, batch, slot) of every row; batches are numbered within their bucket."""
    lengths = materialize(docs.select(docs[key].alias("key"), token_count(docs[text]).alias("n_tokens")))
    bins = histogram(lengths)
    tops = bounds(bins, buckets)
    shards = max(SHARDS, int(bins[:, 1].sum()) // SHARD_ROWS)
    bucket = F.lit(len(tops) - 1)
    for i, top in reversed(list(enumerate(tops))):
        bucket = F.when(F.col("n_tokens") <= top, i).otherwise(bucket)
    pad_to = F.element_at(F.array(*[F.lit(x) for x in tops or [0]]), F.col("bucket") + 1).cast("long")
    rows = lengths.withColumn("bucket", bucket).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    counts = rows.groupBy("bucket", "shard").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("bucket").alias("b"), F.col("shard").alias("s"), before.alias("before"))
    within = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("key", "n_tokens")) - 1
    placed = rows.withColumn("within", within).join(counts, (F.col("bucket") == F.col("b")) & (F.col("shard") == F.col("s"))).withColumn("place", F.col("before") + F.col("within")).withColumn("pad_to", pad_to)
    size = F.greatest(F.floor(budget / F.greatest("pad_to", F.lit(1))), F.lit(1))
    return placed.select(F.col("key").alias(key), "n_tokens", F.col("bucket").cast("long").alias("bucket"), "pad_to", F.floor(F.col("place") / size).alias("batch"), (F.col("place") % size).alias("slot"))
