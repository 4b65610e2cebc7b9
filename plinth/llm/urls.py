"""URL filters, in DataFrame operations only: rules by host and path, then a list of canonical URLs.

The list becomes a blocked Bloom filter: one 64-bit block per hash value, some bits of a block per URL. A page's URL
can only be listed if all its bits are set in its block; those possible hits go on to an exact hash join with the
list, which removes the false positives.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is never listed;
very long URLs are judged whole; repeated rows are judged one by one; an empty
table gives an empty result, and an empty list blocks nothing; of rules of one length the later given wins; other columns pass through, but
ones named host, path, rule or verdict give way to the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import ascii_lower

#: Bits set per URL in its block, and listed URLs per block on average: about one false positive in 60.
BITS, PER_BLOCK = 4, 5
#: Query parameters that don't change what a URL shows.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty. A later ``://`` is never taken for the first."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?>.*?://)[^/?#]*(/[^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """A URL's identity: host without ``www.`` or ``m.``, path without a last ``/`` or ``.html``, query without tracking."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.|:(?:80|443)$", "")
    path = F.regexp_replace(path_of(url), r"(?:\.html|/)$", "")
    query = F.coalesce(F.regexp_extract(url, r"(?s)^(?>.*?://)[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(f"^{TRACKING}=")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the ``rules`` (verdict, host, path) that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last to be tried first is the longest
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bits(url: Column) -> Column:
    """The URL's bits within its block, as one long."""
    h = F.xxhash64(F.lit("bits"), url)
    out = F.lit(0).cast("long")
    for i in range(BITS):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return out


def bloom_filter(listed: DataFrame, url: str) -> tuple[DataFrame, int]:
    """(blocks with any bits set, number of blocks) for the canonical URLs in a column; grows with the list."""
    blocks = max(1, listed.count() // PER_BLOCK)
    return listed.groupBy(_block(F.col(url), blocks).alias("block")).agg(F.bit_or(_bits(F.col(url))).alias("bits")), blocks


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict: the rule's, else block for listed URLs and allow for the others.

    ``listed`` has distinct canonical URLs in its one column ``listed_url``. It is read three times (for its size, its
    filter and the exact join), so pass a materialised table where it takes work to make. Its joins are plain ones, so Spark
    broadcasts the list or its filter where it measures them as small, and shuffles by URL otherwise; no row of
    ``pages`` is dropped or doubled.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = pages.withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("_plinth_verdict", verdict)
    asks = F.col("_plinth_verdict").isNull() & (F.col("host") != "")
    out = out.withColumn("_plinth_canonical", F.when(asks, canonical(F.col(url))))
    blocks, n = bloom_filter(listed, "listed_url")
    blocks = blocks.select(F.col("block").alias("_plinth_block"), F.col("bits").alias("_plinth_bits"))
    # Rows that need no lookup get keys of their own below zero, so that no null key gathers them in one task.
    spread = -1 - F.pmod(F.xxhash64(F.col(url)), F.lit(1 << 20))
    out = out.withColumn("_plinth_key", F.when(F.col("_plinth_canonical").isNotNull(), _block(F.col("_plinth_canonical"), n)).otherwise(spread))
    possible = out.join(blocks, F.col("_plinth_key") == F.col("_plinth_block"), "left")
    hit = F.coalesce(F.col("_plinth_bits").bitwiseAND(_bits(F.col("_plinth_canonical"))) == _bits(F.col("_plinth_canonical")), F.lit(False))
    possible = possible.withColumn("_plinth_ask", F.when(hit, F.col("_plinth_canonical")).otherwise(F.concat(F.lit("://"), spread.cast("string"))))
    exact = possible.join(listed.select(F.col("listed_url").alias("_plinth_listed")), F.col("_plinth_ask") == F.col("_plinth_listed"), "left")
    method = F.when(F.col("_plinth_listed").isNotNull(), "block").otherwise("allow")
    return exact.withColumn("verdict", F.coalesce(F.col("_plinth_verdict"), method)).drop("_plinth_verdict", "_plinth_canonical", "_plinth_block", "_plinth_bits", "_plinth_key", "_plinth_ask", "_plinth_listed")
