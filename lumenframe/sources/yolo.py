"""YOLO datasets: metadata on the driver, files and labels through Spark's readers."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.text import label_path, split_name
from lumenframe.sources import labels

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
SPLIT_KEYS = ("train", "val", "valid", "validation", "test")


def read_yaml(spark: SparkSession, path: str) -> dict[str, Any]:
    """A small metadata file, wherever Spark reads from."""
    import yaml

    rows = spark.read.text(path, wholetext=True).collect()
    return yaml.safe_load(rows[0]["value"]) if rows else {}


def class_frame(spark: SparkSession, meta: dict[str, Any], largest_id: int = -1) -> DataFrame:
    """(class_id, name, radius); names that are missing are class_0, class_1, ..."""
    names, radii = meta.get("names") or {}, meta.get("radii") or {}
    named = dict(enumerate(names)) if isinstance(names, list) else {int(k): v for k, v in names.items()}
    radius = dict(enumerate(radii)) if isinstance(radii, list) else {int(k): v for k, v in radii.items()}
    ids = sorted(named) if named else range(largest_id + 1)
    return spark.createDataFrame([(i, str(named.get(i, f"class_{i}")), float(radius[i]) if i in radius else None) for i in ids], "class_id int, name string, radius double")


def files_under(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")


def images_under(spark: SparkSession, root: str) -> DataFrame:
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    return files_under(spark, root).where(suffix.isin(*IMAGE_SUFFIXES))


def split_entry(spark: SparkSession, root: str, entry: str | list[str]) -> DataFrame:
    """Images of a split's entry: a folder, an image, a list of either, or a text file of paths; relative to the root."""
    entries = entry if isinstance(entry, list) else [entry]
    out = None
    for e in entries:
        full = e if "://" in e or e.startswith("/") else f"{root.rstrip('/')}/{e}"
        if full.endswith(".txt"):
            line = F.trim("value")
            part = spark.read.text(full).where(line != "").select(F.when(F.startswith(line, F.lit("/")) | F.contains(line, F.lit("://")), line).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(line, r"^\./", ""))).alias("path"))
        elif full.rsplit(".", 1)[-1].lower() in IMAGE_SUFFIXES:
            part = spark.createDataFrame([(full,)], "path string")
        else:
            part = images_under(spark, full)
        out = part if out is None else out.unionByName(part)
    return out


def split_by_path(path: Column) -> Column:
    """The split that a path's folder names; ``train`` if none does."""
    found = F.regexp_extract(path, r"(?:^|/)(train|val|valid|validation|test)/", 1)
    return F.when(found == "", F.lit("train")).otherwise(split_name(F.nullif(found, F.lit(""))))


def image_sizes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, width, height) by the JVM's own image reader; unreadable images have -1."""
    return spark.read.format("image").load(paths).select(named(F.col("image.origin")).alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"))


def local(path: Column) -> Column:
    """Paths without a file scheme, so that listed and given ones meet."""
    return F.regexp_replace(path, r"^file:(//)?(?=/)", "")


def named(url: Column) -> Column:
    """The path of a file that Spark names by URL, as its metadata column does: blanks and the like are themselves again."""
    return local(F.url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))))


def canonical(at: Column) -> Column:
    """A path below a dataset's root without the folders that only say split and kind: ``train/images/a/1.jpg`` and ``images/train/a/1.jpg`` are ``a/1.jpg``."""
    split = "(?:train|val|valid|validation|test)"
    return F.regexp_replace(at, rf"^(?:\./)?(?:{split}/images/|images/{split}/|images/|{split}/)", "")


def open_dataset(spark: SparkSession, root: str, yaml_name: str | None = "data.yaml", task: str | None = None, errors: str = "raise") -> dict[str, DataFrame]:
    """samples, annotations, classes and issues of a dataset.

    Without metadata the layout ``{split}/images`` gives the splits. ``errors``:
    ``raise`` refuses bad rows; ``skip`` reports them and goes on.
    """
    meta = read_yaml(spark, f"{root}/{yaml_name}") if yaml_name else {}
    entries = {split: meta[split] for split in SPLIT_KEYS if meta.get(split)}
    base = f"{root}/{meta['path']}" if meta.get("path") and not str(meta["path"]).startswith(("/", ".")) else root
    if entries:
        images = None
        for split, entry in entries.items():
            part = split_entry(spark, base, entry).withColumn("split", split_name(F.lit(split)))
            images = part if images is None else images.unionByName(part)
    else:
        images = images_under(spark, root).withColumn("split", split_by_path(F.col("path")))
    images = images.withColumn("path", local(F.col("path")))
    sizes = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(IMAGE_SUFFIXES) + "}").load(base).select(named(F.col("image.origin")).alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"))
    samples = images.distinct().join(sizes, "path", "left").withColumn("image_id", F.xxhash64("path")).withColumn("label", label_path(F.col("path")))
    below = lambda at: "^" + re.escape(re.sub(r"^file:(//)?(?=/)", "", at.rstrip("/"))) + "/"
    inside = F.regexp_replace(F.regexp_replace(F.col("path"), below(base), ""), below(root), "")
    samples = samples.withColumn("relative_path", canonical(inside)).withColumn("group_key", F.concat_ws("/", "split", "relative_path"))
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(base, wholetext=True).select(named(F.col("_metadata.file_path")).alias("label"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")).where(F.trim("line") != "")
    rows = lines.join(samples.select("image_id", "label", "width", "height"), "label").select("image_id", "label", (F.col("n") + 1).alias("line_no"), "line", "width", "height")
    shape = tuple(meta["kpt_shape"]) if meta.get("kpt_shape") else None
    task = task or labels.infer_task(rows.withColumn("ord", F.col("label")), bool(shape)) or "detect"
    parsed = labels.parse(rows, task, shape)
    issues = parsed.where("problem is not null").select("image_id", "line_no", F.col("problem").alias("category"))
    if errors == "raise" and not issues.isEmpty():
        raise ValueError(f"bad label rows: {[tuple(r) for r in issues.limit(4).collect()]}")
    good = parsed.where("problem is null").withColumn("source_id", F.concat_ws(":", "label", F.col("line_no").cast("string"))).withColumn("ann_idx", (F.col("line_no") - 1).cast("int")).drop("problem", "line", "label", "line_no", "width", "height")
    largest = -1 if meta.get("names") else (good.agg(F.max("class_id")).first()[0] if not good.isEmpty() else -1)
    return {"samples": samples.drop("label"), "annotations": good, "classes": class_frame(spark, meta, largest), "issues": issues, "task": task}


def orphans(spark: SparkSession, root: str) -> DataFrame:
    """Label files without an image: (path)."""
    found = files_under(spark, root).where(F.endswith("path", F.lit(".txt")) & F.contains("path", F.lit("/labels/")))
    return found.join(images_under(spark, root).select(label_path(F.col("path")).alias("path")), "path", "left_anti")
