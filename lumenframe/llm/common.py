"""Helpers that the operators of this subpackage share.

Rows are told apart by a number of their own, ``row``, which :func:`numbered`
gives them before anything else happens: repeated rows stay repeated rows, a
null ``doc_id`` is an ordinary value, and rows with one id but different texts
keep results of their own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables up to this many bytes (counted before, never guessed) may be broadcast.
BROADCAST_BYTES = 32 << 20
#: A key with more rows than this share of all is joined by broadcast: there are fewer such keys than 1 / HOT_SHARE.
HOT_SHARE = 1 / 4096
#: Rows and bytes of an Arrow batch: what a Python worker holds does not grow with the length of texts.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a session within one process may lack it and gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lumenframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, if they are larger."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


_made: list[str] = []


def stored_at(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As :func:`stored`, with the path."""
    small_batches(spark)
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it again."""
    return stored_at(spark, df, name)[0]


def deleted(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that no plan reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if path in _made:
            _made.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end; what is to stay has to be written elsewhere by then."""
    before = len(_made)
    try:
        yield
    finally:
        deleted(spark, *_made[before:])


def if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows, at ``row_bytes`` each, stay under ``limit``; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def base(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text`` (null: empty): other columns, whatever their names, take no part."""
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def fresh(docs: DataFrame, name: str = "row") -> str:
    """A column name that ``docs`` lacks."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def numbered(spark: SparkSession, docs: DataFrame, table: str, row: str = "row") -> tuple[DataFrame, str]:
    """``docs``, stored, with a number for each row, and the name of that column."""
    row = fresh(docs, row)
    return stored(spark, docs.withColumn(row, F.monotonically_increasing_id()), table), row


def many_to_one(rows: DataFrame, side: DataFrame, key: str | list[str], count: str = "n_rows", how: str = "left") -> DataFrame:
    """``rows`` joined to ``side``, which has each ``key`` (a column or some) once with the number of its rows in ``count``; ``rows`` is a stored table.

    The rows of a hot key would all go to one task: those keys, fewer than
    1 / HOT_SHARE, are broadcast instead.
    """
    total = rows.count()
    least = max(1000, int(total * HOT_SHARE))
    hot = F.broadcast(side.where(F.col(count) > least).drop(count))
    rest = rows.join(F.broadcast(side.where(F.col(count) > least).select(*([key] if isinstance(key, str) else key))), key, "left_anti")
    cold = rest.join(side.where(F.col(count) <= least).drop(count), key, how)
    return cold.unionByName(rows.join(hot, key))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
