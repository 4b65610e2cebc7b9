"""Rows that repeat an id count as one document, also near the threshold."""

from plinth.llm import ngrams


def text(*runs):
    return " ".join(f"w{i}" for a, b in runs for i in range(a, b))


def test_repeated_ids_count_once(spark):
    # 100 shingles each, 50 of them in common; the other 50 of 1 stand in 4, 6 and 7, so that it meets 2 by the common ones
    a, b = text((0, 104)), text((50, 154))
    rows = [(2, a), (2, a), (1, b), (3, text((0, 54), (1000, 1060))), *[(i, text((100, 154), (1000 * i, 1000 * i + 60))) for i in (4, 6, 7)], (None, a), (None, a), (5, None), (5, "five"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngrams.jaccard_components(docs).collect())
    assert [x[0] for x in got] == [x[2] for x in got] == [1, 2, 3, 4, 5, 6, 7] and got[1][1] == 100 and got[4][1] == 1
    kept = [tuple(r) for r in ngrams.one_of_each(docs).collect()]
    assert sorted(kept, key=repr) == sorted([(2, a), (1, b), *rows[3:7], (None, a), (None, a), (5, "five")], key=repr)
