"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without that setting gets one of its own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusmill-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes at path and when it was last modified: changes when a table is written anew."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(target).getLength(), fs.getFileStatus(target).getModificationTime()


def materialize(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write df as Parquet, with options of the writer, to the shared folder and read it back: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corpusmill-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    atexit.register(discard, spark, path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_path = path
    return written


def done_with(df: DataFrame) -> None:
    """Delete a materialized table that nothing will read again."""
    discard(df.sparkSession, df.written_path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table; a session that has already ended leaves it to the folder's owner."""
    if spark.sparkContext._jsc is None:
        return
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the gateway has gone with the session
        return
