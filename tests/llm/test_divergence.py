"""The divergence audit against a direct evaluation in Python integers."""

import random
import re
from collections import Counter

import pytest

from plinth.llm import divergence


def brute(docs, least=10):
    groups, langs, df = {}, {}, {}
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        groups.setdefault((lang, source), Counter()).update(terms)
        langs.setdefault(lang, Counter()).update(terms)
        df.setdefault(lang, Counter()).update(set(terms))
    rows = []
    for lang in langs:
        kept = sorted((t for t, n in df[lang].items() if n >= least), key=str.encode)
        v = len(kept)

        def p_of(counts, kept=kept, v=v):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * v) for t in kept}

        p = {s: p_of(c) for (of, s), c in groups.items() if of == lang}
        q = p_of(langs[lang])
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in p:
            pairs = sorted(((sum(f(p[s][t], p[o][t]) for t in kept), o) for o in p if o != s), key=lambda x: (-x[0], x[1].encode()))
            rows += [(lang, s, "pair", o, value, i) for i, (value, o) in enumerate(pairs, 1)]
            terms = sorted(((f(p[s][t], q[t]), t) for t in kept if groups[lang, s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:10]
            rows += [(lang, s, "term", t, value, i) for i, (value, t) in enumerate(terms, 1)]
    return sorted(rows)


def got(spark, docs):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "text string, lang string, source string, term string, n int")
    return sorted(tuple(r) for r in divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect())


def some(seed, n=240):
    r = random.Random(seed)
    words = ["the", "The", "Ärger", "ärger", "naïve", "x1y", "日本", "z", "Z_z", "été", "\U0001f600", "ﬀ", "a\x00b"]
    docs = [(" ".join(r.choices(words, k=r.randrange(1, 12))), r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "Ü", None, "😀", "ﬀ"])) for _ in range(n)]
    return [*docs, (None, "en", "bare"), ("", "en", "bare2"), ("12 34", "xx", "s1"), ("rare", "xx", "s2"), (None, "yy", "alone"), ("w " * 50_000, "en", "s1"), *[("tie same", "tt", s) for s in "abcdefghijkl"]]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_direct_evaluation(spark, seed):
    docs = some(seed)
    assert got(spark, docs) == brute(docs)


def test_chunks_and_pieces_of_any_size(spark, monkeypatch):
    docs = some(3)
    want = brute(docs)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(divergence)  # so that tasks see the small bounds
    try:
        for name, value in (("CHUNK_TERMS", 2), ("PIECE", 5), ("STEP", 3), ("FLUSH", 4)):
            monkeypatch.setattr(divergence, name, value)
        assert got(spark, docs) == want
        monkeypatch.setattr(divergence, "CHUNK_CELLS", 1)
        assert got(spark, docs) == want
    finally:
        cloudpickle.unregister_pickle_by_value(divergence)


def test_large_numbers_are_exact():
    import numpy as np

    for count, total in ((2, 9 * 10**15), (9 * 10**15, 9 * 10**15), (8 * 10**15 + 12345, 9 * 10**15 - 7), (3, 7)):
        assert divergence.scaled(np.array([count]), np.array([total]))[0] == 1 + 10**9 * count // total


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
