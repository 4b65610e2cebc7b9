"""The filter audit against a direct evaluation of every order."""

import re
from itertools import permutations

import pytest

from plinth.llm import audit

COLUMNS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def brute(docs, labels):
    seen, each = {}, []
    least = {}
    for i, text, lang in docs:  # rows that repeat an id: the least text, nulls last
        if i is not None and (i not in least or (text is None, text or "") < (least[i][0] is None, least[i][0] or "")):
            least[i] = (text, lang)
    good = {i for i, q, t in labels if q == 1}
    toxic = {i for i, q, t in labels if t == 1}
    for i in sorted(least):
        text, lang = least[i][0] or "", least[i][1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": text in seen}
        seen.setdefault(text, i)
        each.append((i, lang, fails))
    rows = []
    for part in {p for _, p, _ in each}:
        own = [(i, f) for i, p, f in each if p == part]
        removed, made = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                here = [(i, f) for i, f in left if f[letter]]
                gone = len([1 for i, f in own if f[letter]]) - len(here)
                left = [(i, f) for i, f in left if not f[letter]]
                removed[letter] += len(here)
                unique = sum(1 for _, f in own if f[letter] and sum(f.values()) == 1)
                made.append((part, "".join(order), step, len(left), len(here), gone, unique, sum(i in good for i, _ in here), sum(i in toxic for i, _ in here), letter))
        rows += [(*m[:-1], removed[m[-1]]) for m in made]
    return sorted(rows)


LONG = " ".join(f"w{i}" for i in range(250))
DOCS = [
    (1, LONG, "en"), (2, LONG, "en"), (3, LONG, "de"), (4, None, "en"), (5, "", "en"), (6, None, None),
    (7, "a b " * 300, "en"), (8, LONG + " #", "en"), (9, "AB " + LONG, "de"), (10, "A" * 3 + "b" * 97, ""),
    (11, " ".join(f"x{i}" for i in range(200)), "en"), (12, " ".join(f"x{i % 100}" for i in range(200)), "en"), (13, " ".join(f"x{i % 99}" for i in range(200)), "en"),
    (14, "A" * 4 + "b" * 96, "fr"), (15, "  one word", "fr"), (15, "zzz", "de"), (None, LONG, "en"), (16, LONG * 400, "en"), (16, LONG * 400, "en"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, 0, 1), (7, None, 1), (None, 1, 1), (99, 1, 1), (9, 1, None)]


def test_audit_equals_every_order(spark):
    docs = spark.createDataFrame([(*d, "x", d[1]) for d in DOCS], "doc_id long, text string, lang string, pattern string, word string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    out = audit.audit(docs, labels)
    assert ", ".join(f"{n} {t.replace('bigint', 'long')}" for n, t in out.dtypes) == COLUMNS
    assert sorted(tuple(r) for r in out.collect()) == brute(DOCS, LABELS)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(spark.createDataFrame([], "doc_id long, text string, lang string"), labels).count() == 0
    one = audit.audit(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string"), labels)
    assert one.count() == 600 and one.where("filter_order LIKE 'A%' AND step = 1").select("removed", "kept").distinct().collect() == [(1, 0)]


@pytest.mark.parametrize("copies", [500])
def test_many_copies(spark, copies):
    docs = spark.range(copies).selectExpr("id AS doc_id", f"'{LONG}' AS text", "'en' AS lang")
    out = audit.audit(docs, spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int"))
    got = out.where("filter_order = 'EABCD' AND step = 1").select("kept", "removed", "unique_fails", "good_lost").first()
    assert tuple(got) == (1, copies - 1, copies - 1, 1)
