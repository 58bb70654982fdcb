"""Durable intermediate tables in the folder that the cluster shares.

``spark.checkpoint.dir`` names that folder.  Tables written here cut lineage and
survive lost executors, which cached or locally checkpointed blocks would not.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; in local mode, where one machine is all there is, a default."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file:///tmp/framewright-scratch"


#: Bytes of an Arrow batch between the JVM and Python; documents are long, and a batch has copies on both sides.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> SparkSession:
    """Hold this session's Arrow batches to ``BATCH_BYTES``; an administrator's lower bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and broadcasts that nothing refers to any more.

    Its cleaner acts only when the driver collects garbage, which an operator of many small jobs on a
    large heap would put off until the disk and the heap are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` once nothing reads it again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.toUri().getPath().startswith(root.toUri().getPath() + "/"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
