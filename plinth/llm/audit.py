"""Filter interaction audit: what each of five filters removes, alone and after others, in every order.

The words of a text are rows: they are aggregated by (document, word), then by document, which gives totals and
distinct words. An outer join brings the other flags, and each document becomes a pattern of five bits. Per part (a
language), 32 conditional counts, one a pattern, hold all that any order of the filters can show; the orders are made
from these counts, so their number doesn't touch the documents.

Filters, by letter (``FILTERS`` has their order in a pattern): A few words; B few distinct words; C many capitals; D a
symbol; E the text of a smaller id.

Defined results: a null text is empty (fails A, and E where a smaller id has an empty text too); a null part is the
empty string; rows without an id count nowhere; rows that repeat an id count as one document, that of the least text;
values just at a bound pass; of equal texts all but the least id fail E, however many they are; of a document's
repeated label rows any that is 1 counts; very long texts count whole; an empty table gives no part and no row; other
columns, whatever their names, aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import join_few, materialize, one_per_id

FILTERS = "ABCDE"
LEAST_WORDS = 200
#: In hundredths: distinct words of all words, capitals of all code points.
LEAST_DISTINCT, MOST_CAPITALS = 50, 3
SYMBOLS = "[#$%&*|]"
_SPACES = r"[\x20\x09-\x0D]+"
_PATTERNS = 1 << len(FILTERS)


def word_counts(held: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_distinct) of texts (doc_id, text) that are dealt by ``doc_id``; none of a text without words.

    As rows of a document stay in one partition, both aggregates go without another exchange.
    """
    words = held.select("doc_id", F.explode(F.split("text", _SPACES)).alias("word")).where("word <> ''")
    per_word = words.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return per_word.groupBy("doc_id").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def _bit(letter: str, fails: Column) -> Column:
    return F.when(fails, 1 << FILTERS.index(letter)).otherwise(0)


def patterns(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, pattern): per document, a bit for each filter that it fails, A the lowest."""
    rows = one_per_id(docs.select(docs[key].cast("long").alias("doc_id"), docs[part].cast("string").alias("part"), docs[text].alias("text")).where("doc_id IS NOT NULL"), "doc_id", "text")
    rows = rows.select("doc_id", F.coalesce("part", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    flags = rows.select("doc_id", "part", F.sha2("text", 256).alias("same"), (100 * capitals > MOST_CAPITALS * F.length("text")).alias("c"), F.col("text").rlike(SYMBOLS).alias("d"))
    n, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    bits = _bit("A", n < LEAST_WORDS) + _bit("B", 100 * distinct < LEAST_DISTINCT * n) + _bit("C", F.col("c")) + _bit("D", F.col("d"))
    counts = word_counts(rows.select("doc_id", "text").repartition("doc_id"))  # texts move once: smaller than their (document, word) rows
    base = materialize(flags.join(counts, "doc_id", "left").select("doc_id", "part", "same", bits.alias("bits")))
    firsts = materialize(base.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("same", "first"))
    copies = join_few(base, firsts, "same", "doc_id", "left")
    return copies.select("doc_id", "part", (F.col("bits") + F.coalesce(_bit("E", F.col("doc_id") > F.col("first")), F.lit(0))).alias("pattern"))


def pattern_counts(found: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per part, arrays of the 32 counts by pattern: of all documents, of the good and of the toxic ones."""
    marks = labels.where(labels[key].isNotNull()).groupBy(labels[key].cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.coalesce(labels["quality"] == 1, F.lit(False))).alias("good"), F.max(F.coalesce(labels["toxic"] == 1, F.lit(False))).alias("toxic"))
    each = found.join(marks, "doc_id", "left")
    kinds = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = each.groupBy("part").agg(*[F.count_if((F.col("pattern") == p) & of).alias(f"{kind}_{p}") for kind, of in kinds.items() for p in range(_PATTERNS)])
    return counts.select("part", *[F.array(*[f"{kind}_{p}" for p in range(_PATTERNS)]).alias(kind) for kind in kinds])


def _those(holds: Callable[[Column], Column]) -> Column:
    """The patterns p for which ``holds(p)``."""
    return F.filter(F.sequence(F.lit(0), F.lit(_PATTERNS - 1)), holds)


def _total(counts: str, holds: Callable[[Column], Column]) -> Column:
    """Sum of the counts of those patterns."""
    return F.aggregate(_those(holds), F.lit(0).cast("long"), lambda total, p: total + F.get(counts, p))


def orders(counts: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from the counts by pattern."""
    letters, values = F.array(*[F.lit(x) for x in FILTERS]), F.array(*[F.lit(1 << i) for i in range(len(FILTERS))])
    bit = lambda letter: F.element_at(values, F.array_position(letters, letter).cast("int"))
    each = counts.withColumn("order", F.array().cast("array<string>"))
    for _ in FILTERS:
        each = each.withColumn("next", F.explode(F.array_except(letters, "order"))).withColumn("order", F.array_append("order", F.col("next")))
    each = each.select("*", F.posexplode("order").alias("at", "letter"))
    each = each.withColumn("own", bit(F.col("letter"))).withColumn("before", F.aggregate(F.slice("order", F.lit(1), F.col("at")), F.lit(0), lambda mask, x: mask + bit(x)))
    own, before = F.col("own"), F.col("before")
    fails, passed = lambda p: p.bitwiseAND(own) != 0, lambda p: p.bitwiseAND(before) == 0
    # of all orders, a filter is the first of the m that a document fails in one of m
    share = lambda p: F.lit(math.factorial(len(FILTERS))).cast("long") / F.bit_count(p)
    shapley = F.aggregate(_those(fails), F.lit(0).cast("long"), lambda total, p: total + (F.get("n", p) * share(p)).cast("long"))
    return each.select(
        "part",
        F.array_join("order", "").alias("filter_order"),
        (F.col("at") + 1).cast("int").alias("step"),
        _total("n", lambda p: passed(p) & ~fails(p)).alias("kept"),
        _total("n", lambda p: passed(p) & fails(p)).alias("removed"),
        _total("n", lambda p: ~passed(p) & fails(p)).alias("redundant"),
        F.get("n", own).alias("unique_fails"),
        _total("good", lambda p: passed(p) & fails(p)).alias("good_lost"),
        _total("toxic", lambda p: passed(p) & fails(p)).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Counts of documents per part, order of the filters and step; ``labels`` has ``key``, ``quality`` and ``toxic``."""
    return orders(pattern_counts(patterns(docs, key, text, part), labels, key))
