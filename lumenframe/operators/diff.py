"""Comparison of two datasets: one full outer join feeds all four tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keyed(rows: DataFrame, key: str = "relative_path") -> DataFrame:
    """With ``occurrence``: 0-based number within the key."""
    order = Window.partitionBy(key).orderBy("relative_path", "split", *(["image_id"] if "image_id" in rows.columns else []))
    return rows.withColumn("occurrence", F.row_number().over(order) - 1)


def match_key(path: str, parent: str | None, original: str | None, shared: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with ``key``: ``path:`` for paths that both sides have (``shared``: path), else the parent's path, else the original's digest, else the path."""
    side = shared.select(F.col("path").alias(path)).distinct().withColumn("common", F.lit(True))
    choices = [F.when(F.col("common"), F.concat(F.lit("path:"), path))]
    choices += [F.concat(F.lit("parent:"), F.col(parent))] if parent else []
    choices += [F.concat(F.lit("original:"), F.col(original))] if original else []
    return rows.join(side, path, "left").withColumn("key", F.coalesce(*choices, F.concat(F.lit("path:"), path))).drop("common")


def images(before: DataFrame, after: DataFrame, changed: str = "edited", key: str = "relative_path") -> DataFrame:
    """(key, occurrence, before_split, after_split, status): removed, added, modified, moved or unchanged, in that precedence."""
    b = keyed(before, key).select(F.col(key).alias("key"), "occurrence", F.col("split").alias("before_split"), F.col(changed).alias("b_mark"))
    a = keyed(after, key).select(F.col(key).alias("key"), "occurrence", F.col("split").alias("after_split"), F.col(changed).alias("a_mark"))
    both = b.join(a, ["key", "occurrence"], "full_outer")
    status = (
        F.when(F.col("after_split").isNull(), "removed")
        .when(F.col("before_split").isNull(), "added")
        .when(~F.col("b_mark").eqNullSafe(F.col("a_mark")), "modified")
        .when(F.col("before_split") != F.col("after_split"), "moved")
        .otherwise("unchanged")
    )
    return both.select("key", "occurrence", "before_split", "after_split", status.alias("status"))


def overview(compared: DataFrame) -> DataFrame:
    """Images by status."""
    return compared.groupBy("status").agg(F.count("*").alias("images"))


def _delta(before: DataFrame, after: DataFrame, by: str, measure: str) -> DataFrame:
    b = before.groupBy(by).agg(F.count("*").alias(f"before_{measure}"))
    a = after.groupBy(by).agg(F.count("*").alias(f"after_{measure}"))
    both = b.join(a, by, "full_outer").na.fill(0, [f"before_{measure}", f"after_{measure}"])
    return both.withColumn("delta", F.col(f"after_{measure}") - F.col(f"before_{measure}"))


def splits(before: DataFrame, after: DataFrame) -> DataFrame:
    return _delta(before, after, "split", "images")


def classes(before: DataFrame, after: DataFrame) -> DataFrame:
    return _delta(before, after, "class_id", "annotations")
