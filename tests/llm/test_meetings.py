"""How often members meet before their pairs are listed."""

from pyspark.sql import functions as F

from plinth.llm import ngrams


def _members(spark, rows):
    """Members (token, doc_id, ref, f, s, i) with sizes and masks that let any two of them be similar."""
    df = spark.createDataFrame(rows, "token long, doc_id long, ref long, f long, s long, i long")
    return df.select("*", F.lit(100).cast("long").alias("n"), *[F.lit(0).cast("long").alias(f"m{i}") for i in range(ngrams.MASKS)])


def test_postings_with_the_same_members_stand_once(spark):
    rows = [(t, d, 9, 700, 40, t) for t in (1, 2, 3) for d in (10, 11, 12)]  # the three tokens give the same pairs
    rows += [(4, 10, 9, 700, 40, 4), (4, 11, 9, 700, 40, 4)]  # fewer members
    rows += [(5, d, 8, 700, 40, 1) for d in (10, 11, 12)]  # of another reference, whose order is another
    stars = spark.createDataFrame([], "u long, v long")
    open_, left, work = ngrams._open(_members(spark, rows), stars, len(rows))
    assert sorted((r.token, r.doc_id) for r in open_.select("token", "doc_id").collect()) == [(1, 10), (1, 11), (1, 12), (4, 10), (4, 11), (5, 10), (5, 11), (5, 12)]
    assert (left, work) == (8, 6 + 2 + 6)


def test_pairs_come_from_meetings_that_can_be_their_first(spark):
    # f = 1750 each: 10 common tokens are needed, so a first one stands at the 31st of 40 places at most
    rows = [(t, d, 9, 1750, 40, t) for t in (30, 31, 32, 33, 40) for d in (10, 11)]
    members = _members(spark, rows)
    side = lambda x: members.select("token", F.col("doc_id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", *ngrams._FILTER)])
    met = side("a").join(side("b"), "token").where("a < b")
    late = met.where("token >= 32")
    assert ngrams._pairs(late, 75).count() == 0
    assert [(r.a, r.b) for r in ngrams._pairs(met, 75).collect()] == [(10, 11)]
    assert ngrams._pairs(met.where("token = 31"), 75).count() == 1
