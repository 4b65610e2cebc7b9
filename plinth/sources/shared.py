"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the session names none and runs on this machine alone, as tests may, is it a new local one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path in it that nothing uses."""
    return f"{shared_folder(spark)}/plinth-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Later steps reread the files rather than recompute, so a lost executor costs only its running tasks.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._plinth_folder = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the folder of a materialised table that nothing reads any more."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df._plinth_folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
