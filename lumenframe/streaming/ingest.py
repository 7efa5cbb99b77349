"""Incremental ingest of label files, and predictions through a user's function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenframe.sources import labels
from lumenframe.sources.yolo import named


def stream_labels(spark: SparkSession, root: str) -> DataFrame:
    """Parsed rows of label files as they appear."""
    lines = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    rows = lines.select(named(F.col("_metadata.file_path")).alias("label"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")).where(F.trim("line") != "")
    return labels.parse_detect(rows.withColumn("line_no", F.col("n") + 1)).drop("p", "n")


def ingest(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append good rows to ``out``/annotations and bad ones to ``out``/issues, each file once; a batch that runs again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        for name, rows in (("annotations", batch.where("problem is null").drop("problem")), ("issues", batch.where("problem is not null").select("label", "line_no", "problem"))):
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return stream_labels(spark, root).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def predict(samples: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Predictions of a caller's model, batch by batch on the executors; lazy, one model at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield model(pdf)

    return samples.mapInPandas(run, schema)
