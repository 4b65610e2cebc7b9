"""Line dedup by site-relative frequency, in DataFrame operations only.

Pages are grouped by host. A line is boilerplate on a host if it stands on more than ``ratio`` of the host's pages and
on at least ``min_pages`` of them; every copy of it on that host goes. Pages with equal texts (by their 64-bit hash)
count as one, or else copies of a page would make its own text boilerplate. The ratio decides alone, whatever the
host's size: ``min_pages`` only spares what stands on a single page. Lines are compared whole, by their 64-bit
hash within their host; lines without a word are never counted nor dropped. A host can't have more than (distinct lines
per page) / ratio such lines, so its list of them stays short whatever the host's size. Where texts meet lists by a
shuffle, a host of many pages is dealt into lots, each with its own copy of the list.

Defined results: a null text has no lines and stays null; an empty text stays empty; a null host is a host of its own;
very long texts count as any others, whole; a line on just the ratio stays; repeated rows lose the same lines and count
once; an empty table gives an empty result; other columns pass through, whatever their names, but ones named as
``counts`` names its two give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import WORD_PATTERN, materialize

RATIO = 0.05
MIN_PAGES = 2
#: Pages of a host that share one copy of its list where texts are shuffled.
LOT_PAGES = 50_000


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def boilerplate(docs: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, total, lines): each host's distinct pages, and the hashes of its boilerplate lines, for hosts that have any."""
    hashes = F.array_distinct(F.transform(F.filter(_lines(text), lambda x: x.rlike(WORD_PATTERN)), lambda x: F.xxhash64(x)))
    # Copies of a page go first, while a page is one row, so that its lines move as one array and then as partial counts.
    pages = docs.select(F.col(host).alias("host"), F.xxhash64(text).alias("page"), hashes.alias("hashes")).dropDuplicates(["host", "page"])
    # A page adds one row for itself (null line) and one for each distinct line, so that totals need no second scan.
    rows = pages.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), F.coalesce("hashes", F.array().cast("array<long>")))).alias("line"))
    counts = rows.groupBy("host", "line").agg(F.count("*").alias("pages"))
    totals = F.max(F.when(F.col("line").isNull(), F.col("pages")))
    # Only lines on min_pages or more can count, so the lists that meet in one host's row leave out the long tail.
    often = counts.where(F.col("line").isNull() | (F.col("pages") >= min_pages))
    per_host = often.groupBy("host").agg(totals.alias("total"), F.max("pages").alias("most"))
    listed = often.where(F.col("line").isNotNull()).join(per_host.select(F.col("host").alias("t_host"), "total"), F.col("host").eqNullSafe(F.col("t_host")))
    return listed.where(F.col("pages") > ratio * F.col("total")).groupBy("host").agg(F.max("total").alias("total"), F.array_sort(F.collect_list("line")).alias("lines"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with boilerplate lines out of ``text``; ``counts`` names two more columns: lines before, lines dropped."""
    names = [c for c in docs.columns if not counts or c not in counts]
    # The lists are read twice, so they are written once: with their lots, and as the few hosts that have more than one.
    found = boilerplate(docs, host, text, ratio, min_pages).withColumn("lots", F.ceil(F.col("total") / LOT_PAGES).cast("int"))
    found = materialize(found.select(F.col("host").alias("b_host"), F.col("lines").alias("b_lines"), "lots"))
    large = found.where("lots > 1").select(F.col("b_host").alias("l_host"), "lots")  # a row for LOT_PAGES pages at most
    found = found.select("b_host", "b_lines", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("b_lot"))
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs[host].alias("host"), F.split(docs[text], "\n", -1).alias("lines"), F.xxhash64(docs[text]).alias("page"))
    rows = rows.join(F.broadcast(large), F.col("host").eqNullSafe(F.col("l_host")), "left").withColumn("lot", F.pmod("page", F.coalesce("lots", F.lit(1))).cast("int"))
    out = rows.join(found, F.col("host").eqNullSafe(F.col("b_host")) & (F.col("lot") == F.col("b_lot")), "left")
    out = out.withColumn("kept", F.when(F.col("b_lines").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("b_lines", F.xxhash64(x)))))
    more = [] if counts is None else [F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias(counts[0]), F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("long").alias(counts[1])]
    return out.select(*[F.array_join("kept", "\n").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in names], *more)
