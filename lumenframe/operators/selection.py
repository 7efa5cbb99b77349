"""Filters, class algebra, moves and set operations over samples and annotations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.text import seed_of



def filter_samples(samples: DataFrame, annotations: DataFrame | None = None, gt_annotated: bool | None = None, predictions: DataFrame | None = None, has_prediction: bool | None = None, splits: Sequence[str] | None = None) -> DataFrame:
    """Conjunction of presence conditions, as semi and anti joins."""
    out = samples if splits is None else samples.where(F.col("split").isin(list(splits)))
    for wanted, side in ((gt_annotated, annotations), (has_prediction, predictions)):
        if wanted is not None:
            out = out.join(side.select("image_id"), "image_id", "left_semi" if wanted else "left_anti")
    return out


def confident(predictions: DataFrame, threshold: float) -> DataFrame:
    return predictions.where(F.col("score") >= threshold)


def resolve_classes(classes: DataFrame, selectors: Sequence[int | str]) -> list[int]:
    """Ids of class names or ids; a name must be that of exactly one class. ``classes``: the small metadata frame."""
    rows = [(r["class_id"], r["name"]) for r in classes.select("class_id", "name").collect()]
    out = []
    for s in selectors:
        hits = [i for i, n in rows if (i == s if isinstance(s, int) else n == s)]
        if len(hits) != 1:
            raise ValueError(f"class {s!r} names {len(hits)} classes")
        out.append(hits[0])
    return out


def remove_classes(samples: DataFrame, annotations: DataFrame, n_classes: int, removed: Sequence[int], merge_into: int | None = None, splits: Sequence[str] | None = None, drop_empty: bool = False, drop_containing: bool = False) -> tuple[DataFrame, DataFrame]:
    """(samples, annotations) without the classes, or with them merged into one; ids are compacted. Steps in the order in which they apply."""
    if drop_containing and merge_into is not None:
        raise ValueError("images are either dropped or their classes merged")
    if splits is not None:
        samples = samples.where(F.col("split").isin(list(splits)))
    if drop_containing:
        samples = samples.join(annotations.where(F.col("class_id").isin(list(removed))).select("image_id"), "image_id", "left_anti")
    gone = [c for c in removed if c != merge_into]
    kept = [c for c in range(n_classes) if c not in gone]
    number = {c: i for i, c in enumerate(kept)}
    if merge_into is not None:
        number |= {c: number[merge_into] for c in gone}
    ids = F.create_map(*[F.lit(x) for kv in number.items() for x in kv])
    out = annotations.join(samples.select("image_id"), "image_id", "left_semi").withColumn("class_id", ids[F.col("class_id")]).where("class_id is not null")
    if drop_empty:
        samples = samples.join(out.select("image_id"), "image_id", "left_semi")
    return samples, out


def rename_classes(classes: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """New names; they must stay unique and differ from the old ones somewhere."""
    names = {r["class_id"]: r["name"] for r in classes.collect()}
    after = {i: renames.get(n, n) for i, n in names.items()}
    if after == names:
        raise ValueError("nothing is renamed")
    if len(set(after.values())) < len(after):
        raise ValueError("names are not unique after renaming")
    pairs = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv])
    return classes.withColumn("name", F.coalesce(pairs[F.col("name")], F.col("name")))


def move_images_with_classes(samples: DataFrame, annotations: DataFrame, classes: Sequence[int], to_split: str, source_splits: Sequence[str] | None = None) -> DataFrame:
    """Images with a class go to a split, and their whole group with them."""
    seen = samples if source_splits is None else samples.where(F.col("split").isin(list(source_splits)))
    hit = annotations.where(F.col("class_id").isin(list(classes))).select("image_id")
    groups = seen.join(hit, "image_id", "left_semi").select("group_key").distinct().withColumn("triggered", F.lit(True))
    movable = F.lit(True) if source_splits is None else F.col("split").isin(list(source_splits))
    return samples.join(groups, "group_key", "left").withColumn("split", F.when(F.col("triggered") & movable, to_split).otherwise(F.col("split"))).drop("triggered")


def add(left: DataFrame, right: DataFrame, key: str = "relative_path") -> DataFrame:
    """Ordered union: left rows first, then right rows whose key the left lacks; the first row of a key stays. ``ord`` gives each side's order."""
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    first = F.row_number().over(Window.partitionBy(key).orderBy("side", "ord"))
    return both.withColumn("k", first).where("k = 1").drop("k")


def size_policy(samples: DataFrame, max_width: int, max_height: int, errors: str = "skip") -> tuple[DataFrame, DataFrame]:
    """(kept, audit of those too large); ``errors='raise'`` refuses any."""
    large = (F.col("height") > max_height) | (F.col("width") > max_width)
    if errors == "raise" and not samples.where(large).isEmpty():
        raise ValueError("images exceed the maximum size")
    return samples.where(~large), samples.where(large)


def rebalance_quota(samples: DataFrame, annotations: DataFrame, max_empty_fraction: float) -> DataFrame:
    """(split, positive, empty, allowed): empty images that a split may keep."""
    marked = samples.join(annotations.select("image_id").distinct().withColumn("has", F.lit(1)), "image_id", "left")
    per = marked.groupBy("split").agg(F.count("has").alias("positive"), (F.count("*") - F.count("has")).alias("empty"))
    allowed = F.least(F.col("empty"), F.floor(F.col("positive") * max_empty_fraction / (1 - max_empty_fraction)).cast("long"))
    return per.withColumn("allowed", F.when(F.col("positive") == 0, F.lit(0)).otherwise(allowed).cast("long"))


def rebalance_empty(samples: DataFrame, annotations: DataFrame, max_empty_fraction: float, seed: int = 0) -> DataFrame:
    """Samples with at most the allowed empty images of each split; which ones, a seeded hash decides.

    The k-th smallest hash of a split is found on counts of hash cells, so that no split is sorted as a whole.
    """
    quota = rebalance_quota(samples, annotations, max_empty_fraction)
    full = samples.join(annotations.select("image_id"), "image_id", "left_semi")
    empty = samples.join(annotations.select("image_id"), "image_id", "left_anti").withColumn("h", seed_of(F.lit(str(seed)), F.col("split"), F.col("image_id").cast("string")))
    cell = F.shiftright("h", 16)
    cells = empty.groupBy("split", cell.alias("cell")).agg(F.count("*").alias("n"))  # at most 65,536 a split
    before = F.sum("n").over(Window.partitionBy("split").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    budget = cells.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(quota.select("split", "allowed")), "split")
    ranked = empty.withColumn("cell", cell).join(budget.where("before < allowed"), ["split", "cell"])
    order = F.row_number().over(Window.partitionBy("split", "cell").orderBy("h", "image_id"))
    kept = ranked.withColumn("k", order).where(F.col("before") + F.col("k") <= F.col("allowed")).select(*samples.columns)
    return full.unionByName(kept)


def quarantine(rows: DataFrame, issues: DataFrame, key: Sequence[str], examples: int = 4) -> tuple[DataFrame, DataFrame]:
    """(rows without issues, (category, n, examples)): bad rows are set aside and reported."""
    report = issues.groupBy("category").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("message")), 1, examples).alias("examples")) if "message" in issues.columns else issues.groupBy("category").agg(F.count("*").alias("n"))
    return rows.join(issues.select(*key).distinct(), list(key), "left_anti"), report


def orphan_labels(label_paths: DataFrame, image_label_paths: DataFrame) -> DataFrame:
    """Labels without an image, by path."""
    return label_paths.join(image_label_paths, "path", "left_anti")


def leakage(train: DataFrame, evaluation: DataFrame, key: str = "original_id") -> DataFrame:
    """Evaluation originals that were trained on: (model, leaked)."""
    return evaluation.join(train.select("model", key).distinct(), ["model", key], "left_semi").groupBy("model").agg(F.count_distinct(key).alias("leaked"))


def prediction_join(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions of samples; a path that occurs twice, or no coverage at all, is refused."""
    if not samples.groupBy("relative_path").count().where("count > 1").isEmpty():
        raise ValueError("sample paths are not unique")
    out = predictions.join(samples.select("image_id", "relative_path"), "image_id")
    if out.isEmpty():
        raise ValueError("no prediction belongs to a sample")
    return out


def exact_cover(cohort: DataFrame, predicted: DataFrame) -> DataFrame:
    """(image_id, problem) where the predicted images are not exactly the cohort's."""
    missing = cohort.select("image_id").exceptAll(predicted.select("image_id")).withColumn("problem", F.lit("missing"))
    return missing.unionByName(predicted.select("image_id").exceptAll(cohort.select("image_id")).withColumn("problem", F.lit("unexpected")))


def largest_polygon(parts: Column) -> Column:
    """Of array<array<struct<x, y>>>, the polygon with the largest area: what stays of a multipart object if loss is allowed."""
    from lumenframe.functions.geometry import polygon_area

    return F.array_max(F.transform(parts, lambda p: F.struct(polygon_area(p).alias("area"), p.alias("points"))))["points"]


def trainability(samples: DataFrame, classes: DataFrame, required: Sequence[str] = ("train", "val"), task: str = "detect", keypoint_shape: Sequence[int] | None = None) -> DataFrame:
    """(problem, value) of what keeps a dataset from being trained on: missing splits, class names, keypoint shape or radii."""
    spark = samples.sparkSession
    wanted = spark.createDataFrame([(s,) for s in required], "split string")
    issues = wanted.join(samples.select("split").distinct(), "split", "left_anti").select(F.lit("missing split").alias("problem"), F.col("split").alias("value"))
    none = classes.agg(F.count("name").alias("n")).where("n = 0").select(F.lit("no class names").alias("problem"), F.lit(None).cast("string").alias("value"))
    issues = issues.unionByName(none)
    if task == "pose" and not keypoint_shape:
        issues = issues.unionByName(spark.createDataFrame([("no keypoint shape", None)], "problem string, value string"))
    if task == "polo":
        bad = ~(F.col("radius") > 0) | F.col("radius").isNull() if "radius" in classes.columns else F.lit(True)
        issues = issues.unionByName(classes.where(bad).select(F.lit("no radius").alias("problem"), F.col("name").alias("value")))
    return issues
