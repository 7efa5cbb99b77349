"""COCO JSON: explode, join, compact the categories; what does not fit is set aside and becomes an issue.

Numbers of images and annotations are a file's own, so ``image_id`` is a digest
of the file and its number. A segmentation is a row for each of its polygons, or
one row of runs where it is a run-length mask.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.sources import rle
from lumenframe.sources.yolo import canonical, files_under, local, named

SCHEMA = """images array<struct<id: bigint, file_name: string, width: int, height: int>>,
annotations array<struct<id: bigint, image_id: bigint, category_id: bigint, bbox: array<string>, segmentation: string, keypoints: array<string>>>,
categories array<struct<id: bigint, name: string, keypoints: array<string>, skeleton: array<array<int>>>>"""


def compact_categories(categories: DataFrame) -> DataFrame:
    """(id, class_id): sorted ids become 0, 1, 2, ...; a category list is small."""
    return categories.select("id").distinct().withColumn("class_id", (F.row_number().over(Window.orderBy("id")) - 1).cast("int"))


def split_of(path: str) -> F.Column:
    """Split by the file's name: test, then val, else train."""
    name = F.lower(F.element_at(F.split(F.col(path), "/"), -1))
    return F.when(F.contains(name, F.lit("test")), "test").when(F.contains(name, F.lit("val")), "val").otherwise("train")


def keypoint_triples(flat: F.Column) -> F.Column:
    n = F.floor(F.size(flat) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.named_struct(F.lit("x"), F.get(flat, i * 3), F.lit("y"), F.get(flat, i * 3 + 1), F.lit("v"), F.get(flat, i * 3 + 2))))


def polygons(segmentation: F.Column) -> F.Column:
    """Of a list segmentation, its polygons; null for an RLE object."""
    parts = F.from_json(segmentation, "array<array<double>>")
    points = lambda p: F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / 2).cast("int") - 1), lambda i: F.struct(F.get(p, i * 2).alias("x"), F.get(p, i * 2 + 1).alias("y")))
    return F.when(F.startswith(segmentation, F.lit("[")), F.transform(F.filter(parts, lambda p: F.size(p) >= 6), points))


def numbers(texts: str) -> Column:
    """Texts as doubles; null where one is none, or is not finite."""
    as_double = F.transform(texts, lambda t: t.try_cast("double"))
    return F.transform(as_double, lambda v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v))


def first_of(rows: DataFrame, what: str) -> tuple[DataFrame, DataFrame]:
    """(first row of each file and id, issues of the others and of rows without an id)."""
    ranked = rows.withColumn("again", F.row_number().over(Window.partitionBy("file", "id").orderBy("pos")))
    fine = F.col("id").isNotNull() & (F.col("again") == 1)
    name = F.when(F.col("id").isNull(), F.lit(f"{what} without id")).otherwise(F.lit(f"duplicate {what} id"))
    return ranked.where(fine).drop("again"), ranked.where(~fine).select("file", "id", name.alias("category"))


def placed(spark: SparkSession, images: DataFrame, root: str) -> DataFrame:
    """``images`` with the ``path`` of their files below ``root``, null where there is none: the first of six places that has it, else the only file of that name."""
    base = root.rstrip("/") + "/"
    files = files_under(spark, root).select(local(F.col("path")).alias("path"))
    at = F.substring_index(F.col("path"), F.lit(base), -1) if "://" in base else F.expr(f"substr(path, {len(base) + 1})")
    listed = files.select("path", at.alias("at"), F.element_at(F.split("path", "/"), -1).alias("base"))
    choices = [F.col("file_name"), F.concat_ws("/", F.lit("images"), "file_name"), F.concat_ws("/", "split", "file_name"), F.concat_ws("/", "split", F.lit("images"), "file_name"), F.concat_ws("/", F.lit("images"), "split", "file_name"), F.element_at(F.split("file_name", "/"), -1)]
    tried = images.select("image_id", F.posexplode(F.array(*choices)).alias("rank", "at"))
    found = tried.join(listed.select("at", "path"), "at").groupBy("image_id").agg(F.min_by("path", "rank").alias("exact"))
    only = listed.groupBy("base").agg(F.count("*").alias("n"), F.first("path").alias("single")).where("n = 1").drop("n")
    rows = images.join(found, "image_id", "left").withColumn("base", F.element_at(F.split("file_name", "/"), -1)).join(only, "base", "left")
    return rows.withColumn("path", F.coalesce("exact", "single")).drop("exact", "single", "base")


def read(spark: SparkSession, path: str | Sequence[str], root: str | None = None, task: str | None = None) -> dict[str, DataFrame]:
    """samples, annotations, classes and issues of one or more files; rows with an issue are not among the others.

    ``root``: the folder of the images; those without a file are set aside.
    ``task``: detect, segment or pose; by default what the annotations hold.
    Two images of a split with one path are refused, as are files that name a category differently.
    """
    names = [path] if isinstance(path, str) else list(path)
    files = spark.read.schema(SCHEMA).option("multiLine", True).json(names).withColumn("file", named(F.input_file_name())).withColumn("split", split_of("file"))
    images = files.select("file", "split", F.posexplode("images").alias("pos", "i")).select("file", "split", "pos", "i.*")
    images, no_image_id = first_of(images, "image")
    sized = (F.col("width") > 0) & (F.col("height") > 0) & F.col("file_name").isNotNull()
    bad_images = images.where(~F.coalesce(sized, F.lit(False))).select("file", "id", F.lit("image record").alias("category"))
    images = images.where(sized).withColumn("image_id", F.xxhash64("file", "id"))
    issues = no_image_id.unionByName(bad_images)
    if root is not None:
        images = placed(spark, images, root)
        issues = issues.unionByName(images.where("path is null").select("file", "id", F.lit("missing image").alias("category")))
        images = images.where("path is not null")
    clean = F.col("file_name") if root is None else F.regexp_replace("path", "^" + root.rstrip("/").replace(".", r"\.") + "/", "")
    samples = images.select("image_id", "split", canonical(clean).alias("relative_path"), "width", "height", *(["path"] if root is not None else []), "file", F.col("id").alias("source_id"))
    samples = samples.withColumn("group_key", F.concat_ws("/", "split", "relative_path"))
    clash = samples.groupBy("split", "relative_path").count().where("count > 1").limit(4).collect()
    if clash:
        raise ValueError(f"images of one path: {[tuple(r) for r in clash]}")

    categories = files.select(F.explode("categories").alias("c")).select("c.id", "c.name").distinct()
    twice = categories.groupBy("id").count().where("count > 1").limit(4).collect()
    if twice:
        raise ValueError(f"categories that files name differently: {[r['id'] for r in twice]}")
    classes = categories.join(compact_categories(categories), "id").select("id", "class_id", "name")

    rows, no_id = first_of(files.select("file", F.posexplode("annotations").alias("pos", "a")).select("file", "pos", "a.*"), "annotation")
    rows = rows.join(samples.select("file", F.col("source_id").alias("image_id"), F.col("image_id").alias("number"), "width", "height"), ["file", "image_id"], "left")
    rows = rows.join(classes.select(F.col("id").alias("category_id"), "class_id"), "category_id", "left")
    rows = rows.withColumns({"box": numbers("bbox"), "flat": numbers("keypoints"), "rle": F.when(F.startswith("segmentation", F.lit("{")), F.col("segmentation")), "parts": polygons(F.col("segmentation"))})
    rows = rle.decoded(rows, problem="mask_problem")
    b = lambda i: F.get("box", F.lit(i))
    right = (F.size("box") == 4) & ~F.exists("box", lambda v: v.isNull()) & (b(2) > 0) & (b(3) > 0)
    finite = lambda c: F.exists(c, lambda v: v.isNull())
    listed = F.startswith("segmentation", F.lit("["))
    nothing = F.col("box").isNull() & F.col("rle").isNull() & (F.coalesce(F.size("parts"), F.lit(0)) < 1)
    problem = (
        F.when(F.col("number").isNull(), "dangling image")
        .when(F.col("class_id").isNull(), "dangling category")
        .when(F.col("box").isNotNull() & ~F.coalesce(right, F.lit(False)), "box")
        .when(F.coalesce(finite("flat"), F.lit(False)) | (F.size("flat") % 3 != 0), "keypoints")
        .when(F.col("mask_problem").isNotNull(), F.col("mask_problem"))
        .when(listed & F.col("box").isNull() & (F.coalesce(F.size("parts"), F.lit(0)) < 1), "polygon")
        .when(nothing, "no geometry")
    )
    judged = rows.withColumn("problem", problem)
    issues = issues.unionByName(no_id).unionByName(judged.where("problem is not null").select("file", "id", F.col("problem").alias("category")))
    good = judged.where("problem is null")
    parts = F.when(F.size("parts") > 0, F.col("parts")).otherwise(F.array(F.lit(None).cast("array<struct<x:double,y:double>>")))
    each = good.select("file", F.col("number").alias("image_id"), "id", "class_id", b(0).alias("x1"), b(1).alias("y1"), (b(0) + b(2)).alias("x2"), (b(1) + b(3)).alias("y2"), F.posexplode(parts).alias("part", "polygon"), "runs", keypoint_triples(F.col("flat")).alias("keypoints"))
    order = Window.partitionBy("image_id").orderBy("id", "part")
    annotations = each.withColumn("ann_idx", (F.row_number().over(order) - 1).cast("int")).withColumn("source_id", F.concat_ws(":", "file", F.col("id").cast("string")))
    if task is None:
        held = annotations.agg(F.count("keypoints").alias("k"), F.count("polygon").alias("p"), F.count("runs").alias("r")).first()
        task = "pose" if held["k"] else "segment" if held["p"] or held["r"] else "detect"
    box = ["x1", "y1", "x2", "y2"]
    shape = {"detect": box, "pose": [*box, "keypoints"], "segment": ["polygon", "runs"]}[task]
    if task == "segment":
        annotations = annotations.where("polygon is not null or runs is not null")
        if annotations.where("runs is not null").isEmpty():
            shape = ["polygon"]
    elif task in ("detect", "pose"):
        annotations = annotations.where("x1 is not null and part = 0")
    return {"samples": samples.drop("file", "source_id"), "annotations": annotations.select("image_id", "ann_idx", "class_id", *shape, "part", "source_id"), "classes": classes, "issues": issues, "task": task}


