"""Streams: job states folded from an event log, and discovery of documents not seen before.

Batch n of a stream writes version n of its table from the versions before it, so a batch that is run again after a
failure overwrites its own version with the same rows. A restart on the same folder goes on from the newest version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from plinth.operators.store import final_states, partial_states

STATE = "job_id long, n_events long, hard_seq long, hard_status string, cancelled boolean"


def _merge(states: DataFrame) -> DataFrame:
    return states.groupBy("job_id").agg(F.sum("n_events").alias("n_events"), F.max("hard_seq").alias("hard_seq"), F.max_by("hard_status", "hard_seq").alias("hard_status"), F.bool_or("cancelled").alias("cancelled"))


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions of a table that a stream has written, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(x.getPath().getName()[1:]) for x in found)


def _run(stream: DataFrame, folder: str, fold) -> None:
    stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def fold_jobs(events: DataFrame, folder: str) -> DataFrame:
    """Run a stream of events to its present end and return (job_id, status, n_events)."""
    spark = events.sparkSession
    read = lambda n: spark.read.schema(STATE).parquet(f"{folder}/v{n}")

    def fold(batch: DataFrame, n: int) -> None:
        now = partial_states(batch)
        if before := [v for v in versions(spark, folder) if v < n]:
            now = _merge(now.unionByName(read(before[-1])))
        now.write.mode("overwrite").parquet(f"{folder}/v{n}")

    _run(events, folder, fold)
    done = versions(spark, folder)
    return final_states(read(done[-1]) if done else spark.createDataFrame([], STATE))


def job_event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The event log as a stream of job events, one file at a time."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "cancelled").otherwise("processing")
    return raw.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), status.alias("status"))


def unseen(documents: DataFrame, seen: DataFrame, key: str = "file_url") -> DataFrame:
    """Documents whose key isn't among those seen, each key once (the least row of it)."""
    others = [c for c in documents.columns if c != key]
    new = documents.join(seen.select(key).distinct(), key, "left_anti")
    if not others:
        return new.distinct()
    return new.groupBy(key).agg(F.min(F.struct(*others)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in others])


def stream_unseen(documents: DataFrame, seen: DataFrame, folder: str, key: str = "file_url") -> DataFrame:
    """Run a stream of documents to its present end and return those that neither ``seen`` nor an earlier batch has."""
    spark, schema = documents.sparkSession, documents.schema
    read = lambda n: spark.read.schema(schema).parquet(f"{folder}/v{n}")

    def fold(batch: DataFrame, n: int) -> None:
        known = [read(v).select(key) for v in versions(spark, folder) if v < n]
        unseen(batch, reduce(DataFrame.unionByName, known, seen.select(key)), key).select(*schema.names).write.mode("overwrite").parquet(f"{folder}/v{n}")

    _run(documents, folder, fold)
    done = [read(v) for v in versions(spark, folder)]
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], schema)


def _to_end(stream: DataFrame, folder: str, name: str) -> StreamingQuery:
    """Append a stream to a Parquet sink, whose log names each batch's files once, until what is there is done."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/checkpoints/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stream_discovery(documents: DataFrame, seen: DataFrame, folder: str, look_back: str = "30 days", key: str = "file_url", date: str = "meeting_date") -> tuple[DataFrame, list[StreamingQuery]]:
    """Run a stream of listed documents to its present end: (those not seen before, one a key; the two queries).

    The keys of dated documents are in the state store, and leave it once ``look_back`` has passed them; what comes later
    than that is dropped. A null date can't stand against a watermark, so undated documents take a side path without
    one: they are never late, and each of their keys stays in its state. ``seen`` (a table with the key) holds what
    earlier runs had. A restart on the same folder goes on from there; a batch that is replayed gives the same files.
    """
    new = lambda rows: rows.join(seen.select(key).distinct(), key, "left_anti").select(*documents.columns)
    at = F.col(date).cast("timestamp")
    dated = documents.where(F.col(date).isNotNull()).withColumn("_at", at).withWatermark("_at", look_back).dropDuplicatesWithinWatermark([key])
    undated = documents.where(F.col(date).isNull()).dropDuplicates([key])
    queries = [_to_end(new(dated), folder, "dated"), _to_end(new(undated), folder, "undated")]
    read = lambda name: documents.sparkSession.read.schema(documents.schema).parquet(f"{folder}/{name}")
    return read("dated").unionByName(read("undated").join(read("dated").select(key), key, "left_anti").select(*documents.columns)), queries
