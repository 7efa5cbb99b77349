"""Dataset summaries and audits: two-level aggregations, small dimension tables on the broadcast side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _per_image(samples: DataFrame, annotations: DataFrame) -> DataFrame:
    """Samples with ``n``, their annotations: annotations shrink to a row an image before they meet."""
    return samples.join(annotations.groupBy("image_id").agg(F.count("*").alias("n")), "image_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def dataset_summary(samples: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images, annotated, empty and annotations of each split, and of ``all``: grouping sets over one pass."""
    rows = _per_image(samples, annotations)
    out = rows.rollup("split").agg(F.count("*").alias("images"), F.count_if(F.col("n") > 0).alias("annotated"), F.count_if(F.col("n") == 0).alias("empty"), F.sum("n").alias("annotations"), F.min("width").alias("min_width"), F.max("width").alias("max_width"))
    return out.withColumn("split", F.coalesce("split", F.lit("all")))


def class_summary(classes: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations, images and share of each class; classes without any are zero."""
    per = annotations.groupBy("class_id", "image_id").agg(F.count("*").alias("n")).groupBy("class_id").agg(F.sum("n").alias("annotations"), F.count("*").alias("images"))
    total = per.agg(F.sum("annotations").alias("total"))
    out = classes.join(per, "class_id", "left").join(F.broadcast(total))  # one row
    return out.select("class_id", F.coalesce("annotations", F.lit(0)).alias("annotations"), F.coalesce("images", F.lit(0)).alias("images"), F.round(F.coalesce(F.try_divide(F.col("annotations").cast("double"), F.col("total")), F.lit(0.0)), 6).alias("fraction"))


def split_image_summary(samples: DataFrame, annotations: DataFrame, label: str | None = None) -> DataFrame:
    """Total, labelled and background images of each split; a null label flag gives way to the count."""
    has = F.col("n") > 0
    flag = has if label is None else F.coalesce(F.col(label), has)
    return _per_image(samples, annotations).groupBy("split").agg(F.count("*").alias("total"), F.count_if(flag).alias("labelled"), F.count_if(~flag).alias("background"))


def group_isolation(samples: DataFrame) -> DataFrame:
    """Groups that are in several splits: (group_key, splits, images)."""
    return samples.groupBy("group_key").agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.count("*").alias("images")).where(F.contains("splits", F.lit(",")))


def missing_groups(samples: DataFrame) -> DataFrame:
    return samples.where("group_key is null").select("image_id", F.lit("missing group").alias("problem"))


def group_sizes(samples: DataFrame) -> DataFrame:
    """Images and distinct groups of each split, and the sizes' minimum, maximum, mean and median."""
    per = samples.groupBy("split", "group_key").agg(F.count("*").alias("n"))
    return per.groupBy("split").agg(F.sum("n").alias("images"), F.count("*").alias("groups"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"))


def group_size_histogram(samples: DataFrame) -> DataFrame:
    return samples.groupBy("split", "group_key").agg(F.count("*").alias("size")).groupBy("split", "size").agg(F.count("*").alias("groups"))


def group_membership(samples: DataFrame, order: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Distinct splits of each group, in the canonical order."""
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (s, i)])
    seen = F.collect_set(F.struct(rank[F.col("split")].alias("r"), "split"))
    return samples.groupBy("group_key").agg(F.array_join(F.transform(F.array_sort(seen), lambda s: s["split"]), ",").alias("splits"))


def duplicate_content(rows: DataFrame, content: str, split: str, key: str) -> DataFrame:
    """Contents that occur in several splits: (sha, copies, splits, first)."""
    per = rows.groupBy(F.sha2(F.col(content), 256).alias("sha")).agg(F.count("*").alias("copies"), F.count_distinct(split).alias("splits"), F.min(key).alias("first"))
    return per.where("splits > 1")


def class_composition(before: DataFrame, after: DataFrame) -> DataFrame:
    """Annotation counts by class before and after: one aggregation, pivoted."""
    both = before.select("class_id", F.lit("before").alias("state")).unionByName(after.select("class_id", F.lit("after").alias("state")))
    out = both.groupBy("class_id").pivot("state", ["before", "after"]).agg(F.count(F.lit(1)))
    return out.select("class_id", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def split_kind_counts(samples: DataFrame, annotations: DataFrame) -> DataFrame:
    """Chart data: images by split and kind."""
    kind = F.when(F.col("n") > 0, "labelled").otherwise("background")
    return _per_image(samples, annotations).groupBy("split", kind.alias("kind")).agg(F.count("*").alias("images"))


def content_fingerprint(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Order-free SHA-256 of each group's rows: the digest of the sorted row digests' sum of halves.

    Row digests are added up as four 64-bit parts, so no group is gathered or sorted.
    """
    sha = F.sha2(F.to_json(F.struct(*order)), 256)
    parts = [F.conv(F.substring(sha, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = rows.groupBy(group).agg(F.count("*").alias("n"), *[F.sum(p).cast("string").alias(f"s{i}") for i, p in enumerate(parts)])
    return sums.select(group, "n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), "s0", "s1", "s2", "s3"), 256).alias("fingerprint"))
