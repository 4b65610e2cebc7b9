"""Queries that run a stream to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.plans.serving_queries import ORACLE_SQL as _SERVING
from plinth.plans.views import oracle, view
from plinth.sources.shared import new_path
from plinth.sources.tables import table
from plinth.streaming import jobs


def z7_stream_job_states(spark, d):
    return jobs.fold_jobs(jobs.job_event_stream(spark, f"{d}/events*.parquet"), new_path(spark))


def z1_stream_unseen(spark, d):
    """Each customer's orders as a stream of documents under one address; some customers have been seen before."""
    address = lambda c: F.concat(F.lit("https://portal.example/c/"), F.col(c).cast("string"))
    orders = table(spark, d, "orders")
    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/orders*.parquet")
    seen = orders.where("o_orderstatus = 'P'").select(address("o_custkey").alias("file_url"))
    return jobs.stream_unseen(stream.select(address("o_custkey").alias("file_url"), F.col("o_orderkey").alias("document_id")), seen, new_path(spark))


def z1_stream_window(spark, d):
    """All documents, listed twice ten days apart, as a stream in parts; of some an old listing comes last, too late.

    Spark drops what is late against the watermark of the batch before, so that part comes by itself.
    """
    docs = view(spark, d, "v_document")
    listed = docs.select("file_url", "document_id", "meeting_date")
    again = listed.withColumns({"document_id": -F.col("document_id"), "meeting_date": F.date_add("meeting_date", 10)})
    late = listed.where("document_id % 50 = 0").withColumns({"file_url": F.concat("file_url", F.lit("?late")), "meeting_date": F.lit("1995-01-01").cast("date")})
    early, feed = F.coalesce(F.col("meeting_date") < F.lit("1998-01-01").cast("date"), F.col("document_id") > 0), new_path(spark)
    both = listed.unionByName(again)
    for part in (both.where(early), both.where(~early), late):
        part.coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema(listed.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    found, _ = jobs.stream_discovery(stream, docs.where("processed_status = 'PROCESSED'"), new_path(spark))
    return found.select("file_url", F.col("meeting_date").isNotNull().alias("dated"))


QUERIES: dict = {"z7_stream_job_states": z7_stream_job_states, "z1_stream_unseen": z1_stream_unseen, "z1_stream_window": z1_stream_window}
ORACLE_SQL: dict[str, str] = {
    "z7_stream_job_states": _SERVING["z3_job_states"],
    "z1_stream_unseen": "SELECT concat('https://portal.example/c/', CAST(o_custkey AS VARCHAR)) AS file_url, min(o_orderkey) AS document_id FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY o_custkey",
    "z1_stream_window": oracle("SELECT file_url, meeting_date IS NOT NULL AS dated FROM v_document WHERE processed_status <> 'PROCESSED'"),
}
