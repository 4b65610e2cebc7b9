"""Quality rules with thresholds that follow the corpus.

Every text gets a few integer features. Each feature's distribution is kept per (language, source) as a mergeable
quantile sketch: counts in buckets of fixed relative width (16 per power of two, so a quantile is off by at most
1/16 of its value). Sketches merge by adding counts. A group's sketch is its own counts plus those of its language,
scaled down to at most ``PRIOR`` texts, and a language's takes in the corpus's likewise; so small groups lean on what
they are part of, and large ones on themselves, without a switch.

A sketch gives two fences. Beyond its outer quartile, texts of another kind stand out as a second mode: the fence lies
in the emptiest stretch before it, if the rise behind that is more than chance. Without a second mode, the fence lies
as far beyond the ``TAIL`` quantile as that is from the median, so without any spread only what outranks the ``TAIL``
is out. No cutoff is fixed. A join applies the fences to all texts.

Defined results: a null or empty text has no words and fails the base rules; very long texts are measured whole; null
languages and sources are groups of their own; a value just at a fence is kept; an empty table gives an empty result;
repeated rows are counted and judged one by one; other columns, whatever their names, pass ``filter_documents`` unchanged.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm.common import WHITE_SPACE, materialize

FEATURES = T.StructType([T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
SYMBOLS = "#*$%&|<>"
#: Measures are features per 1000 words, each feature being at the least what a text can show of it besides nothing; so
#: short texts without any stand where they could just hide it, and no gap opens between nothing and little.
MEASURES = {"symbols": ("n_symbols", 1), "repeats": ("n_repeat_words", 4), "dup_lines": ("n_dup_lines", 1), "word_length": ("word_chars", 0)}
#: Texts that a group's language (and a language's corpus) counts for at most.
PRIOR = 1000
TAIL = 0.995
#: Buckets of a stretch, and how many standard deviations (of counts) a second mode must rise above the stretch before it.
STRETCH, RISE = 5, 3.0


def text_features(text: str | None) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated 3-word windows) of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()  # bytes split at the six white-space characters of WORD_PATTERN, and at no others
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(seen := Counter(windows)) < len(windows):
        covered = 0  # end of what is counted so far
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, covered)
                covered = i + 3
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE_SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
    )


@F.pandas_udf(FEATURES)
def features(texts: pd.Series) -> pd.DataFrame:
    """The features of each text as a struct column."""
    return pd.DataFrame([text_features(x) for x in texts], columns=FEATURES.names)


def base_failed(f: str) -> Column:
    """The base rules: too few words, or over half of them in repeated windows."""
    return (F.col(f"{f}.n_words") < 50) | (100 * F.col(f"{f}.n_repeat_words") > 50 * F.col(f"{f}.n_words"))


def bucket_top(value: Column) -> Column:
    """The largest integer in the sketch bucket of ``value`` (exact below 32, then 16 buckets per power of two)."""
    spare = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    step = F.expr("1L") * F.pow(F.lit(2), spare).cast("long")
    return F.expr("0L") + (F.floor(value / step) + 1) * step - 1


def sketches(df: DataFrame, group: list[str], measures: list[str]) -> DataFrame:
    """Sketch rows (*group, measure, top, n) of long columns; rows of several tables merge by adding ``n``."""
    stacked = df.select(*group, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket_top(F.col(m)).alias("top")) for m in measures])).alias("x"))
    return stacked.groupBy(*group, "x.measure", "x.top").agg(F.count("*").alias("n"))


def bucket_of(top: np.ndarray) -> np.ndarray:
    """The number of the bucket that ends at ``top``."""
    octave = np.maximum(np.floor(np.log2(np.maximum(top, 1))).astype(np.int64) - 4, 0)
    return np.where(top < 32, top, 16 * octave + (top >> octave))


def top_of(bucket: np.ndarray) -> np.ndarray:
    """The last value of a bucket."""
    octave = np.maximum((bucket - 16) // 16, 0)
    return np.where(bucket < 32, bucket, ((bucket - 16 * octave + 1) << octave) - 1)


def quantile(counts: np.ndarray, q: float) -> int:
    """The bucket of the q-quantile of counts by bucket."""
    total = np.cumsum(counts)
    return int(np.searchsorted(total, q * total[-1] - 1e-9 * total[-1]))


def _second_mode(counts: np.ndarray, start: int) -> int | None:
    """Above bucket ``start``: the middle of the emptiest stretch before the clearest rise; None if no rise is clear."""
    near = np.convolve(counts, np.ones(STRETCH), "same")
    least, best, found = start, RISE, None
    for i in range(start + 1, len(near)):
        rise = (near[i] - near[least]) / np.sqrt(near[i] + near[least] + 1)
        if rise >= best and near[i] >= 2 * near[least]:
            best, found = rise, (least, i)
        if near[i] < near[least]:
            least = i
    if found is None:
        return None
    low, peak = found
    alike = np.flatnonzero(near[low:peak] > near[low])
    return low + (int(alike[0]) if len(alike) else peak - low) // 2


def fences_of(tops: np.ndarray, n: np.ndarray) -> tuple[int, int]:
    """(low, high): the least and the greatest value to keep, from a sketch's buckets."""
    at = bucket_of(tops)
    counts = np.zeros(int(at.max()) + 1 + STRETCH)
    np.add.at(counts, at, n)
    top = lambda bucket: int(top_of(np.array(bucket)))
    bottom = lambda bucket: top(bucket - 1) + 1 if bucket else 0
    middle = quantile(counts, 0.5)
    above = _second_mode(counts, quantile(counts, 0.75))
    high = 2 * top(quantile(counts, TAIL)) - top(middle) if above is None else top(above)
    mirrored = counts[::-1]
    below = _second_mode(mirrored, quantile(mirrored, 0.75))
    low = 2 * bottom(quantile(counts, 1 - TAIL)) - bottom(middle) if below is None else bottom(len(counts) - 1 - below)
    return low, high


def _with_prior(own: DataFrame, parent: DataFrame, group: list[str], shared: list[str]) -> DataFrame:
    """Sketch rows of each ``group``: its own, and its parent's (by ``shared``) scaled to PRIOR texts at most."""
    names = [*shared, "measure"]
    sizes = parent.groupBy(*[F.col(k).alias(f"p_{k}") for k in names]).agg(F.sum("n").alias("p_all"))
    met = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in names])
    share = parent.join(sizes, met).select(*[f"p_{k}" for k in names], "top", (F.col("n") * F.least(F.lit(1.0), PRIOR / F.col("p_all"))).alias("n"))
    groups = own.select(*group, "measure").distinct()
    lent = groups.join(share, met).select(*group, "measure", "top", "n")
    return own.select(*group, "measure", "top", F.col("n").cast("double").alias("n")).unionByName(lent).groupBy(*group, "measure", "top").agg(F.sum("n").alias("n"))


def fences(measured: DataFrame) -> DataFrame:
    """(lang, source, low and high fence per measure) from rows (lang, source, measures)."""
    own = materialize(sketches(measured, ["lang", "source"], list(MEASURES)))
    by_lang = own.groupBy("lang", "measure", "top").agg(F.sum("n").alias("n"))
    by_all = own.groupBy("measure", "top").agg(F.sum("n").alias("n"))
    by_lang = materialize(_with_prior(by_lang, by_all, ["lang"], []))
    merged = _with_prior(own, by_lang, ["lang", "source"], ["lang"])

    def fence(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = fences_of(rows["top"].to_numpy(np.int64), rows["n"].to_numpy(np.float64))
        return rows[["lang", "source", "measure"]].iloc[:1].assign(low=low, high=high)

    kinds = dict(own.dtypes)
    found = merged.groupBy("lang", "source", "measure").applyInPandas(fence, f"lang {kinds['lang']}, source {kinds['source']}, measure string, low long, high long")
    of = lambda m, side: F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}")
    return found.groupBy("lang", "source").agg(*[of(m, side) for m in MEASURES for side in ("low", "high")])


FENCES = [f"{m}_{side}" for m in MEASURES for side in ("low", "high")]


def judge(df: DataFrame, lang: str = "lang", source: str = "source", f: str = "features") -> DataFrame:
    """Add ``base_failed``, each measure with its fence, and ``kept`` to rows that carry the features struct ``f``.

    ``df`` is read twice, so pass a materialised table. Fences come from rows that meet the base rules; a group without
    any such row has no fence and its rows are out by the base rules anyway.
    """
    measured = df.withColumn("base_failed", base_failed(f)).withColumns({m: F.when(F.col(f"{f}.n_words") > 0, F.floor(1000 * F.greatest(F.col(f"{f}.{x}"), F.lit(least)) / F.col(f"{f}.n_words"))) for m, (x, least) in MEASURES.items()})
    good = measured.where(~F.col("base_failed")).select(F.col(lang).alias("lang"), F.col(source).alias("source"), *MEASURES)
    limits = fences(good)
    limits = limits.select(F.col("lang").alias("_fence_lang"), F.col("source").alias("_fence_source"), *FENCES)
    out = measured.join(limits, F.col(lang).eqNullSafe(F.col("_fence_lang")) & F.col(source).eqNullSafe(F.col("_fence_source")), "left").drop("_fence_lang", "_fence_source")
    within = F.lit(True)
    for m in MEASURES:
        within = within & F.coalesce(F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & within)


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text, lang, source and any more columns) that the rules keep, with the same columns."""
    names = docs.columns
    held = materialize(docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs["lang"].alias("lang"), docs["source"].alias("source"), features(docs["text"]).alias("features")))
    return judge(held).where("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in names])
