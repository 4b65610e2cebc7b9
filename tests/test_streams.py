"""Stateful discovery: duplicates, lateness, undated documents, restarts and the size of the state."""

from datetime import date, timedelta

from plinth.streaming import jobs

SCHEMA = "file_url string, document_id long, meeting_date date"


def put(spark, feed, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(feed)


def run(spark, feed, folder, seen=()):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(feed)
    found, queries = jobs.stream_discovery(stream, spark.createDataFrame([(x,) for x in seen], "file_url string"), folder)
    return sorted(r.file_url for r in found.collect()), queries


def test_discovery_over_restarts(spark, tmp_path):
    feed, folder, day = str(tmp_path / "feed"), str(tmp_path / "out"), date(2026, 7, 1)
    put(spark, feed, [("a", 1, day), ("a", 2, day + timedelta(5)), ("old", 3, day), ("u", 4, None), ("u", 5, None)])
    assert run(spark, feed, folder, ["old"])[0] == ["a", "u"]
    put(spark, feed, [("a", 6, day + timedelta(20)), ("b", 7, day + timedelta(60)), ("u", 8, None)])  # the watermark goes on
    assert run(spark, feed, folder, ["old"])[0] == ["a", "b", "u"]
    put(spark, feed, [("late", 9, day), ("c", 10, day + timedelta(61)), ("late", 11, None), ("b", 12, None)])
    want = ["a", "b", "c", "late", "u"]  # the late listing is dropped, the undated one of the same address counts
    assert run(spark, feed, folder, ["old"])[0] == want
    assert run(spark, feed, folder, ["old"])[0] == want


def test_state_is_bounded_by_the_look_back(spark, tmp_path):
    feed, day = str(tmp_path / "feed"), date(2026, 1, 1)
    for part in range(4):
        put(spark, feed, [(f"{part}-{i}", i, day + timedelta(90 * part + i % 10)) for i in range(50)])
    found, queries = run(spark, feed, str(tmp_path / "out"))
    assert len(found) == 200
    state = [p["stateOperators"][0]["numRowsTotal"] for p in queries[0].recentProgress if p["stateOperators"]]
    assert max(state) <= 100 and state[-1] <= 50
