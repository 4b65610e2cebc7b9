"""Quality rules against plain Python: features, sketches, fences and what they keep."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from plinth.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """The features by their definitions."""
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = (text or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated)


def test_features_equal_their_definitions():
    rng = random.Random(1)
    parts = ["a", "b", "é", "ab", "$", "#<", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\u00a0", "😀", "\n\n", "a b c\n"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert quality.text_features(text) == brute(text), text
    assert quality.text_features(None) == (0,) * 5


def test_buckets_and_quantiles(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([np.arange(3000), rng.integers(0, 1 << 40, 500)])
    df = spark.createDataFrame([(int(v),) for v in values], "v long")
    tops = np.array([r.t for r in df.select(quality.bucket_top(F.col("v")).alias("t")).collect()])
    assert (tops >= values).all() and (tops - values <= values / 16).all() and (tops[:32] == values[:32]).all()
    assert (quality.top_of(quality.bucket_of(tops)) == tops).all()
    counts = np.bincount(quality.bucket_of(tops))
    for q in (0.005, 0.25, 0.5, 0.75, 0.995):
        exact = np.sort(values)[int(np.ceil(q * len(values))) - 1]
        got = quality.top_of(np.array(quality.quantile(counts, q)))
        assert exact <= got <= exact * 17 / 16


def sketch(values):
    tops, n = np.unique(quality.top_of(quality.bucket_of(np.asarray(values))), return_counts=True)
    return tops, n


def test_fences_lie_between_modes_or_beyond_the_tail():
    rng = np.random.default_rng(3)
    bulk = rng.normal(5000, 150, 4000).astype(int)
    low, high = quality.fences_of(*sketch(bulk))
    assert low < bulk.min() and high > bulk.max()
    two = np.concatenate([bulk, rng.normal(8000, 150, 200).astype(int), rng.normal(3000, 60, 200).astype(int)])
    low, high = quality.fences_of(*sketch(two))
    assert 3200 < low < 4400 and 5700 < high < 7400
    low, high = quality.fences_of(*sketch(two * 4))  # the fences move with the data
    assert 12800 < low < 17600 and 22800 < high < 29600
    assert quality.fences_of(*sketch([7] * 1000)) == (7, 7)  # without any spread, only the value itself is within
    assert quality.fences_of(*sketch([7] * 999 + [9])) == (7, 7)
    low, high = quality.fences_of(*sketch([5000, 5000]))  # a bucket is kept whole
    assert low <= 5000 <= high and high - low < 5000 / 8


def test_groups_have_fences_of_their_own(spark):
    """The same share of symbols is usual in one group and stands out in another; a tie at a fence is kept."""
    rng = random.Random(4)

    def text(symbols, n=100):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for i in rng.sample(range(n), symbols):
            words[i] += "$"
        return " ".join(words)

    rows = [(i, text(rng.randint(0, 2)), "en", "prose") for i in range(2500)] + [(10_000 + i, text(rng.randint(30, 50)), "en", "code") for i in range(2500)]
    rows += [(20_000 + i, text(40), "en", "prose") for i in range(60)] + [(30_000, text(40), "en", "small"), (30_001, None, "en", "prose"), (30_002, text(1), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    judged = quality.judge(docs.select("doc_id", "lang", "source", quality.features("text").alias("features")))
    got = {r.doc_id: r for r in judged.collect()}
    assert got[0].symbols_high < 300 <= got[10_000].symbols_high
    assert sum(got[i].kept for i in range(2500)) > 2450 and not any(got[20_000 + i].kept for i in range(60)) and sum(got[10_000 + i].kept for i in range(2500)) > 2450
    assert got[30_001].base_failed and not got[30_001].kept and got[30_002].kept
    for r in got.values():
        within = all(getattr(r, f"{m}_low") <= getattr(r, m) <= getattr(r, f"{m}_high") for m in quality.MEASURES) if r.features.n_words else True
        assert r.kept == (not r.base_failed and within)
    ties = [(i, text(0), "en", "x") for i in range(300)]
    assert quality.filter_documents(spark.createDataFrame(ties + ties, "doc_id long, text string, lang string, source string")).count() == 600
