"""Connected components of links between integer ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import materialize
from plinth.sources.shared import discard


#: Edges of a partition. A graph that fits in one needs no shuffle; larger ones have partitions in proportion.
PART_EDGES = 200_000


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """One step over edges (u, v): neighbours move to the least neighbour; ``large`` moves the greater ones."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # the least neighbour comes by an aggregate and a join, so that no node's neighbours are listed in one row
    least = both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    at = both.join(least, F.col("u") == F.col("c"))
    moved = at.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v") if not large else at.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).coalesce(parts)
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each linked id but the least of its component, and that least id, from links (u, v) in any order."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if state == seen:
            return now
        seen, parts = state, state[0] // PART_EDGES + 1
        now, before = materialize(_star(_star(now.coalesce(parts), True, parts), False, parts)), now
        discard(before)
