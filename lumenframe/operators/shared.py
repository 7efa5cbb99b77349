"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a table that a task gets.
DEALT = 100_000


def work_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a session within one process may lack it and gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lumenframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def small_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Bound the bytes of this session's Arrow batches where they may be more: rows that hold pixels are large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(key, str(most))


def dealt(df: DataFrame, key: str, beside: DataFrame | None = None) -> DataFrame:
    """``df`` dealt out by ``key``; joins on the key and further columns leave the rows where they are, so a key's rows have to fit in a task.

    A task gets about :data:`DEALT` rows of a larger table, however few shuffle
    partitions the session has: later steps sort what they make of them in memory.
    A table that is to meet another, dealt ``beside`` it, goes to as many tasks as that one.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    parts = -(-(df if beside is None else beside).count() // DEALT)
    return df.repartition(parts, key) if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else df.repartition(key)


def stored(df: DataFrame, name: str, steps: bool = False) -> tuple[DataFrame, str]:
    """``df`` written as a Parquet table and read again, and where it is: a lost executor costs its tasks only. ``steps``: whole numbers as differences from row to row."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    options = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"} if steps else {}
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def deleted(spark: SparkSession, path: str | None) -> None:
    """Delete a stored table that no plan reads any more."""
    if path:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
