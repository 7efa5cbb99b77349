"""Training layouts that follow their source: content decides what is written.

Every image is a record whose digest covers its bytes, what is annotated on it
and the settings. Records fall into buckets by name; a bucket's digest is over
its records', the layout's identity over the buckets'. A call compares bucket
digests with those of the call before, then the records of buckets that differ,
and writes or deletes the files of those records only. The table of records is
replaced last, so a call that breaks off is made good by the next.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.text import slug
from lumenframe.sources import labels, sinks
from lumenframe.sources.yolo import named

KINDS = ("yolo-seg", "yolo-sem", "nnunet")
REVISION = "1"
BUCKETS = 256
STATE = "_records"
#: Values that a lossless binary mask may hold.
MASK_VALUES = (0, 1, 255)


@dataclass(frozen=True)
class Prepared:
    """A layout: where it is, its identity, and what the call did."""

    root: str
    identity: str
    written: int
    deleted: int
    skipped: DataFrame
    records: DataFrame


def case_names(samples: DataFrame) -> Column:
    """``{split}_{slug of the stem}_{first eight of the path's SHA-1}``."""
    stem = F.regexp_extract("relative_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.concat_ws("_", "split", slug(stem), F.substring(F.sha1("relative_path"), 1, 8))


def places(kind: str) -> tuple[Column, Column]:
    """(image, label) paths of a case (case_id, split, suffix) in the layout."""
    folder = F.when(F.col("split") == "val", "valid").otherwise(F.col("split"))
    if kind == "nnunet":
        part = F.when(F.col("split") == "test", "Ts").otherwise("Tr")
        return F.concat(F.lit("images"), part, F.lit("/"), "case_id", F.lit("_0000"), "suffix"), F.concat(F.lit("labels"), part, F.lit("/"), "case_id", F.lit(".png"))
    return F.concat_ws("/", folder, F.lit("images"), F.concat("case_id", "suffix")), F.concat_ws("/", folder, F.lit("labels"), F.concat("case_id", F.lit(".txt" if kind == "yolo-seg" else ".png")))


def mapped_masks(spark: SparkSession, paths: list[str] | str, threshold: int = 128, value: int = 255) -> DataFrame:
    """(mask, content, foreground, width, height, problem) of mask images as PNGs of 0 and ``value``.

    JPEG pixels count from ``threshold`` on; other formats may hold 0, 1 and 255
    alone, anything else is a ``problem``. Decoded by the JVM's reader.
    """
    images = spark.read.format("image").option("recursiveFileLookup", True).load(paths).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = {"mask": r["mask"], "content": None, "foreground": None, "width": r["width"], "height": r["height"], "problem": None}
                if r["width"] < 1:
                    found["problem"] = "unreadable mask"
                else:
                    x = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])[:, :, :3].max(2)
                    lossy = r["mask"].lower().endswith((".jpg", ".jpeg"))
                    if not lossy and not np.isin(x, MASK_VALUES).all():
                        found["problem"] = "mask values"
                    else:
                        on = x >= threshold if lossy else x > 0
                        found |= {"content": sinks.png(on, value), "foreground": int(on.sum())}
                schema = pa.schema([("mask", pa.string()), ("content", pa.binary()), ("foreground", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("problem", pa.string())])
                yield pa.RecordBatch.from_pylist([found], schema)

    rows = images.select(named(F.col("origin")).alias("mask"), "width", "height", "nChannels", "data")
    return rows.mapInArrow(run, "mask string, content binary, foreground long, width int, height int, problem string")


def annotated(samples: DataFrame, annotations: DataFrame) -> DataFrame:
    """(image_id, label_sha256): digest of each image's annotations in their order; that of nothing where it has none."""
    shape = [c for c in ("class_id", "polygon", "runs", "keypoints", "x1", "y1", "x2", "y2", "px", "py", "radius") if c in annotations.columns]
    rows = annotations.groupBy("image_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("ann_idx", *shape)))), 256).alias("label_sha256"))
    return samples.select("image_id").join(rows, "image_id", "left").select("image_id", F.coalesce("label_sha256", F.sha2(F.lit(""), 256)).alias("label_sha256"))


def digests(records: DataFrame) -> DataFrame:
    """(bucket, bucket_sha256) of records (bucket, case_id, digest)."""
    return records.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ","), 256).alias("bucket_sha256"))


def identity(buckets: list[tuple[int, str]]) -> str:
    return hashlib.sha256(",".join(f"{b}:{d}" for b, d in sorted(buckets)).encode()).hexdigest()


def delete_files(files: DataFrame, root: str) -> int:
    """Delete files (path below ``root``) from the tasks; one that is gone already counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                full = f"{base.rstrip('/')}/{path}"
                if target.get_file_info(full).type != fs.FileType.NotFound:
                    target.delete_file(full)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("path").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def prepare(spark: SparkSession, destination: str, samples: DataFrame, annotations: DataFrame, classes: DataFrame, kind: str, masks: DataFrame | None = None, mask_threshold: int = 128, max_size: tuple[int, int] | None = None, errors: str = "raise") -> Prepared:
    """Bring the layout at ``destination`` in line with a dataset of whole image files (``path``).

    ``kind``: ``yolo-seg`` (polygon label files), ``yolo-sem`` (masks of 0 and 1)
    or ``nnunet`` (likewise, in its folders). ``masks`` (image_id, mask): mask
    files to map instead of drawing the annotations. ``max_size`` (width,
    height): larger images are refused, or with ``errors='skip'`` left out and
    reported. Images are copied as they are, never resized.
    """
    if kind not in KINDS or errors not in ("raise", "skip") or not 0 <= mask_threshold <= 255:
        raise ValueError("a kind of layout, errors raise or skip, and a threshold of 0 to 255 are needed")
    if {"crop", "copy"} & set(samples.columns) or "path" not in samples.columns:
        raise ValueError("only whole image files can be prepared: export the dataset first")
    if kind == "yolo-seg" and (masks is not None or "polygon" not in annotations.columns or "runs" in annotations.columns):
        raise ValueError("segments need polygons")
    large = F.lit(False) if max_size is None else (F.col("width") > max_size[0]) | (F.col("height") > max_size[1])
    skipped = samples.where(large).select("split", "relative_path", "width", "height", F.lit("image exceeds the size").alias("reason"))
    if errors == "raise" and not skipped.isEmpty():
        raise ValueError(f"images exceed the size: {[tuple(r) for r in skipped.limit(4).collect()]}")
    rows = samples.where(~large).drop("sha256").join(sinks.file_digests(samples), "path", "left")
    rows = rows.withColumns({"case_id": case_names(samples), "suffix": F.lower(F.regexp_extract("relative_path", r"(\.[^./]*)$", 1))})
    image_at, label_at = places(kind)
    if masks is None:
        rows = rows.join(annotated(samples, annotations), "image_id")
    else:
        of_masks = sinks.file_digests(masks.select(F.col("mask").alias("path"))).select(F.col("path").alias("mask"), F.col("sha256").alias("label_sha256"))
        rows = rows.join(masks.select("image_id", "mask").join(of_masks, "mask", "left"), "image_id", "left")
    settings = json.dumps([REVISION, kind, mask_threshold if masks is not None else None])
    digest = F.sha2(F.concat_ws("\x00", F.lit(settings), "case_id", "sha256", "label_sha256", "suffix"), 256)
    bucket = F.pmod(F.xxhash64("case_id"), F.lit(BUCKETS)).cast("int")
    records = rows.select("image_id", "case_id", "split", "suffix", "path", *(["mask"] if masks is not None else []), bucket.alias("bucket"), digest.alias("digest"), "sha256", "label_sha256", image_at.alias("image"), label_at.alias("label"))
    lost = records.where("sha256 is null or label_sha256 is null").limit(4).collect()
    if lost:
        raise ValueError(f"images or masks are not there: {[r['path'] for r in lost]}")
    doubled = records.groupBy("case_id").count().where("count > 1").limit(4).collect()
    if doubled:
        raise ValueError(f"cases of one name: {[r['case_id'] for r in doubled]}")
    if kind == "nnunet" and records.select("suffix").distinct().count() > 1:
        raise ValueError("this layout needs images of one format")

    state = f"{destination.rstrip('/')}/{STATE}"
    kept = ["case_id", "bucket", "digest", "image", "label"]
    before = spark.read.parquet(state) if sinks.exists(spark, state) else spark.createDataFrame([], "case_id string, bucket int, digest string, image string, label string")
    now, then = ({r["bucket"]: r["bucket_sha256"] for r in digests(df).collect()} for df in (records, before))  # at most BUCKETS rows each
    differ = [b for b in now.keys() | then.keys() if now.get(b) != then.get(b)]
    root = identity(list(now.items()))
    if not differ and sinks.exists(spark, state):
        return Prepared(destination, root, 0, 0, skipped, before)
    old = before.where(F.col("bucket").isin(differ))
    fresh = records.where(F.col("bucket").isin(differ)).join(old.select("case_id", F.col("digest").alias("old")), "case_id", "left").where("old is null or old <> digest").drop("old")
    gone = old.join(records.select("case_id"), "case_id", "left_anti")
    stale = old.join(fresh.select("case_id", F.col("image").alias("new_image")), "case_id").where("image <> new_image").select(F.col("image").alias("path"))
    none = F.lit(None).cast("binary")
    images = fresh.select(F.col("image").alias("path"), none.alias("content"), F.col("path").alias("source"))
    deleted = delete_files(gone.select(F.explode(F.array("image", "label")).alias("path")).unionByName(stale), destination)
    written = sinks.write_tree(images.unionByName(label_files(spark, fresh, samples, annotations, kind, masks, mask_threshold)), destination)
    written += write_metadata(spark, destination, kind, samples, classes, records)
    sinks.publish(spark, state, lambda at: records.select(*kept).write.parquet(at), overwrite=True)
    return Prepared(destination, root, written, deleted, skipped, spark.read.parquet(state))


def label_files(spark: SparkSession, fresh: DataFrame, samples: DataFrame, annotations: DataFrame, kind: str, masks: DataFrame | None, threshold: int) -> DataFrame:
    """(path, content, source) of the labels of ``fresh`` records."""
    source = F.lit(None).cast("string").alias("source")
    some = samples.join(fresh.select("image_id", "label"), "image_id")
    notes = annotations.join(fresh.select("image_id"), "image_id", "left_semi")
    if kind == "yolo-seg":
        text = labels.format_detect(some, notes)
        content = F.coalesce(F.concat("content", F.lit("\n")), F.lit("")).cast("binary")
        return some.select("image_id", "label").join(text, "image_id", "left").select(F.col("label").alias("path"), content.alias("content"), source)
    if masks is None:
        return sinks.mask_files(some, notes, F.col("label"), 1).select("path", "content", source)
    folders = [r["at"] for r in fresh.select(F.regexp_replace("mask", "/[^/]*$", "").alias("at")).distinct().collect()]  # folders of masks, a handful
    made = mapped_masks(spark, folders, threshold, 1) if folders else None
    if made is None:
        return fresh.select(F.col("label").alias("path"), F.lit(None).cast("binary").alias("content"), source)
    rows = fresh.select("image_id", "label", "mask").join(samples.select("image_id", F.col("width").alias("w"), F.col("height").alias("h")), "image_id").join(made, "mask", "left")
    wrong = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("content").isNull(), "unreadable mask").when((F.col("width") != F.col("w")) | (F.col("height") != F.col("h")), "mask size")
    refuse = F.raise_error(F.concat_ws(": ", wrong, "mask")).cast("binary")
    return rows.select(F.col("label").alias("path"), F.when(wrong.isNotNull(), refuse).otherwise(F.col("content")).alias("content"), source)


def write_metadata(spark: SparkSession, destination: str, kind: str, samples: DataFrame, classes: DataFrame, records: DataFrame) -> int:
    """The layout's own metadata file, if it is not there as it should be; returns how many were written."""
    if kind == "nnunet":
        ending = (records.select("suffix").first() or [".png"])[0]
        name, text = "dataset.json", json.dumps({"channel_names": {"0": "R", "1": "G", "2": "B"}, "labels": {"background": 0, "foreground": 1}, "numTraining": records.where("split <> 'test'").count(), "file_ending": ending}, sort_keys=True)
    else:
        splits = sorted(r[0] for r in samples.select("split").distinct().collect())
        names = [r["name"] for r in classes.orderBy("class_id").collect()] if kind == "yolo-seg" else ["background", "foreground"]
        name, text = "data.yaml", "".join(f"{s}: {'valid' if s == 'val' else s}/images\n" for s in splits) + f"names: {json.dumps(names)}\n"
    at = f"{destination.rstrip('/')}/{name}"
    if sinks.exists(spark, at) and spark.read.text(at, wholetext=True).first()[0] == text:
        return 0
    return sinks.write_tree(spark.createDataFrame([(name, bytearray(text.encode()), None)], "path string, content binary, source string"), destination)
