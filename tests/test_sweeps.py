"""Sweeps against direct searches, and the automaton against scans word by word."""

import random

import pytest
from pyspark.sql import functions as F

from plinth.functions import text as t
from plinth.operators import extraction, keywords, sweeps


def disjoint(r, n, top):
    """Disjoint matches (start, end) that may touch."""
    cuts = sorted(r.sample(range(top), 2 * n))
    return [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]


def direct(found, anchor, low, high, reach):
    for a, b in ((max(low, anchor - reach), min(high, anchor + reach)), (low, high)):
        inside = [(abs(s - anchor), s, e) for s, e in found if s >= a and e <= b]
        if inside:
            return min(inside)[1:]
    return None


@pytest.mark.parametrize("seed", [1, 2])
def test_sweep_equals_direct_search(spark, seed):
    r = random.Random(seed)
    places, anchors, want = [], [], {}
    for key in range(30):
        top = r.choice([60, 400, 5000])
        found = {k: disjoint(r, r.randrange(0, 12), top) for k in "xy"}
        places += [(key, k, s, e, f"{k}{s}") for k, rows in found.items() for s, e in rows]
        for i in range(12):
            pos = r.choice([r.randrange(top), *(s for s, _ in found["x"]), *(e for _, e in found["y"])])
            low, high = r.randrange(pos + 1), r.randrange(pos, top + 1)
            anchors.append((key, i, pos, low, high))
            want[key, i] = tuple(direct(found[k], pos, low, high, t.SEARCH) for k in "xy")
    m = spark.createDataFrame(places, "key int, kind string, start int, end int, text string")
    a = spark.createDataFrame(anchors, "key int, i int, pos int, low int, high int").repartition(5)
    out = sweeps.sweep(a, m, ["key"], "pos", ["x", "y"])
    near = [sweeps.nearest(k, F.col("pos"), F.col("low"), F.col("high")) for k in "xy"]
    got = {(x.key, x.i): tuple((m.start, m.end) if m else None for m in (x.x, x.y)) for x in out.select("key", "i", near[0].alias("x"), near[1].alias("y")).collect()}
    assert got == want


def test_match_rows_equal_matches(spark):
    texts = [(1, "Item 1: x\nItem no. 22\nitem 3"), (2, ""), (3, None), (4, "no"), (5, "Item 9"), (6, "é Item 7 123-456-789"), (7, "123-456-789 Item 2")]
    df = spark.createDataFrame(texts, "id int, x string")
    patterns = {"item": t.ITEM, "apn": t.APN}
    got = sorted(tuple(r) for r in sweeps.match_rows(df, ["id"], "x", patterns).collect())
    each = [df.select("id", F.lit(k).alias("kind"), F.inline(t.matches(F.col("x"), p))) for k, p in patterns.items()]
    assert got == sorted(tuple(r) for r in each[0].unionByName(each[1]).collect())
    assert len(got) == 8


def test_page_of_offset(spark):
    pages = spark.createDataFrame([(1, 1, "abc"), (1, 2, ""), (1, 3, "de"), (2, 5, "x")], "document_id long, page_number int, page_text string")
    asked = [(1, 0), (1, 3), (1, 4), (1, 5), (1, 99), (1, 99), (1, -1), (2, 7), (3, 0), (1, None)]
    got = sorted(((r.document_id, r.offset, r.page_number) for r in extraction.page_of_offset(pages, spark.createDataFrame(asked, "document_id long, offset long")).collect()), key=str)
    assert got == sorted([(1, 0, 1), (1, 3, 1), (1, 4, 2), (1, 5, 3), (1, 99, 3), (1, 99, 3), (1, -1, 1), (2, 7, 5), (3, 0, 1), (1, None, 1)], key=str)


def test_automaton_equals_scans(spark):
    r = random.Random(3)
    lists = {"a": ["rezone", "rezoning", "aa", "variance"], "b": ["zone", "rezone", "Historic".lower()]}
    texts = ["".join(r.choice(["rezone", "REZONING", "a", "aaa", "zone", " ", "é", "historic", "vari", "ance"]) for _ in range(40)) for _ in range(20)] + ["", None]
    got = keywords.with_hits(spark.createDataFrame(list(enumerate(texts)), "id int, x string"), "x", lists).select("id", F.inline("hits")).collect()
    want = set()
    for i, text in enumerate(texts):
        low = (text or "").lower()
        for name, words in lists.items():
            for o, w in enumerate(words):
                pos = low.find(w)
                while pos >= 0:
                    want.add((i, name, o, w, pos))
                    pos = low.find(w, pos + len(w))
    assert sorted(tuple(x) for x in got) == sorted(want)


def test_signals_of_a_cut_match(spark):
    """An address that the item's end cuts isn't taken, nor a shorter form of it."""
    page = "PUBLIC HEARINGS\nItem 1: variance at 12 Oak\nItem 2 St"
    got = extraction.page_signals(spark.createDataFrame([(1, 1, page), (1, 2, "PUBLIC HEARINGS\nItem 1: variance, APN 123-456-789, 12 Oak St")], "document_id long, page_number int, page_text string")).orderBy("page_number").collect()
    assert [(r.apn, r.address) for r in got] == [(None, None), ("123-456-789", "12 Oak St")]
