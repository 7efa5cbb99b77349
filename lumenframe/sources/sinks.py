"""Sinks: staged writes, label files, report tables and the prediction cache."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.operators import lineage, raster
from lumenframe.sources import labels, yolo

#: Of the tables that :func:`write_dataset` writes; 2: samples have ``annotation_count`` and ``sha256`` after an update.
SCHEMA = 2
REPORT_BYTES = 64 << 20


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def publish(spark: SparkSession, destination: str, write: Callable[[str], None], check: Callable[[str], None] | None = None, overwrite: bool = False) -> None:
    """Write to a staging folder beside the destination, check it, then rename: readers see all or nothing.

    What is overwritten is moved aside first, put back if the rename fails, and deleted last.
    """
    fs, final = _fs(spark, destination)
    if fs.exists(final) and not overwrite:
        raise FileExistsError(destination)
    staging = f"{destination.rstrip('/')}.staging-{uuid.uuid4().hex}"
    staged = _fs(spark, staging)[1]
    try:
        write(staging)
        if check:
            check(staging)
        old = _fs(spark, staging.replace(".staging-", ".old-"))[1] if fs.exists(final) else None
        if old is not None and not fs.rename(final, old):
            raise OSError(f"cannot move {destination} aside")
        if not fs.rename(staged, final):
            if old is not None:
                fs.rename(old, final)
            raise OSError(f"cannot rename {staging}")
        if old is not None:
            fs.delete(old, True)
    finally:
        if fs.exists(staged):
            fs.delete(staged, True)


def write_dataset(spark: SparkSession, destination: str, frames: Mapping[str, DataFrame], info: Mapping[str, Any], dry_run: bool = False, overwrite: bool = False) -> dict[str, int]:
    """Frames as Parquet, samples and annotations partitioned by split where they have one, and a manifest. Returns row counts, read back from what was staged."""
    counts: dict[str, int] = {}
    if dry_run:
        return {k: f.count() for k, f in frames.items()}

    def write(path: str) -> None:
        for name, frame in frames.items():
            w = frame.write.option("compression", "zstd")
            (w.partitionBy("split") if "split" in frame.columns else w).parquet(f"{path}/{name}")
        for name in frames:
            counts[name] = spark.read.parquet(f"{path}/{name}").count()
        manifest = json.dumps({**info, "rows": counts}, sort_keys=True)
        spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/manifest")

    def check(path: str) -> None:
        if {"samples", "annotations"} <= set(frames):
            s, a = (spark.read.parquet(f"{path}/{n}") for n in ("samples", "annotations"))
            if not a.join(s.select("image_id"), "image_id", "left_anti").isEmpty():
                raise ValueError("annotations without an image")

    publish(spark, destination, write, check, overwrite)
    return counts


def read_dataset(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{path}/{n}") for n in names]


def file_digests(paths: DataFrame) -> DataFrame:
    """(path, sha256) of files (path), read in pieces by the tasks; null for a file that is not there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                at, name = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
                if at.get_file_info(name).type != fs.FileType.File:
                    found.append(None)
                    continue
                digest = hashlib.sha256()
                with at.open_input_stream(name) as source:
                    while piece := source.read(1 << 20):
                        digest.update(piece)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string())], ["path", "sha256"])

    return paths.where("path is not null").select("path").distinct().mapInArrow(run, "path string, sha256 string")


def read_manifest(spark: SparkSession, path: str) -> dict[str, Any]:
    """What :func:`write_dataset` recorded; empty where there is nothing."""
    at = f"{path.rstrip('/')}/manifest"
    row = spark.read.text(at).first() if exists(spark, at) else None
    return json.loads(row[0]) if row else {}


def manifests_below(spark: SparkSession, roots: Sequence[str], ids: Sequence[str]) -> dict[str, str]:
    """Where below ``roots`` a dataset of each of ``ids`` lies; the first root, then the smallest path."""
    found: dict[str, str] = {}
    for root in roots:
        left = [i for i in ids if i not in found]
        if not left or not exists(spark, root):
            continue
        path = F.regexp_extract(yolo.named(F.col("_metadata.file_path")), r"^(.*)/manifest/part-[^/]*$", 1)
        lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "part-*.txt").text(root).select(path.alias("path"), F.get_json_object("value", "$.dataset_id").alias("id"))
        rows = lines.where((F.col("path") != "") & F.col("id").isin(left)).groupBy("id").agg(F.min("path").alias("path")).collect()  # a row for each dataset of a chain
        found |= {r["id"]: r["path"] for r in rows}
    return found


def listed(spark: SparkSession, records: DataFrame, roots: Sequence[str], rewrites: Mapping[str, str]) -> DataFrame:
    """(root, path, sha256) of the files that could be those of ``records`` (path, sha256): the paths themselves and where they moved (root -1), and files below ``roots`` that bear their names. Only files that a digest has to tell apart are read."""
    name = F.element_at(F.split("path", "/"), -1)
    paths = records.where("path is not null").select("path", "sha256")
    near = paths.unionByName(paths.select(lineage.rewritten(F.col("path"), rewrites).alias("path"), "sha256")).where("path is not null")
    out = file_digests(near).where("sha256 is not null").select(F.lit(-1).alias("root"), "path", "sha256")
    names = paths.groupBy(name.alias("name")).agg(F.max(F.col("sha256").isNotNull()).alias("exact"))
    for i, root in enumerate(roots):
        if exists(spark, root):
            under = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(yolo.local(F.col("path")).alias("path")).withColumn("name", name).join(names, "name")
            plain = under.where("not exact").select(F.lit(i).alias("root"), "path", F.lit(None).cast("string").alias("sha256"))
            out = out.unionByName(plain).unionByName(file_digests(under.where("exact")).select(F.lit(i).alias("root"), "path", "sha256"))
    return out


def update_dataset(spark: SparkSession, path: str, destination: str | None = None) -> dict[str, int]:
    """Bring what :func:`write_dataset` wrote to the current schema, in place or as a copy: digests of the images that are there, annotation counts, the manifest's number. A folder without manifest is refused."""
    if not exists(spark, f"{path}/manifest"):
        raise ValueError(f"no manifest in {path}: export the dataset first")
    info = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    frames = {n: spark.read.parquet(f"{path}/{n}") for n in info["rows"]}
    samples = frames["samples"].drop("annotation_count")
    counts = frames["annotations"].groupBy("image_id").agg(F.count("*").alias("annotation_count"))
    samples = samples.join(counts, "image_id", "left").withColumn("annotation_count", F.coalesce("annotation_count", F.lit(0)))
    if "path" in samples.columns:
        old = F.col("sha256") if "sha256" in samples.columns else F.lit(None).cast("string")
        samples = samples.withColumn("old", old).drop("sha256").join(file_digests(samples), "path", "left").withColumn("sha256", F.coalesce("sha256", "old")).drop("old")
    return write_dataset(spark, destination or path, {**frames, "samples": samples}, {**info, "schema": SCHEMA}, overwrite=destination in (None, path))


def _without_pairs(value: Any) -> Any:
    """A report without its earlier half: ``before`` entries go, ``x_after`` is ``x``, ``after`` is ``result``."""
    if isinstance(value, list):
        return [_without_pairs(v) for v in value]
    if not isinstance(value, dict):
        return value
    out = {k.removesuffix("_after"): _without_pairs(v) for k, v in value.items() if k not in ("before", "after") and not k.endswith("_before")}
    return out | ({"result": _without_pairs(value["after"])} if "after" in value else {})


def _report(name: str, content: bytes) -> Any:
    """A JSON document, the rows of JSON lines or of a CSV table with its header, as text."""
    try:
        text = content.decode()
        if name.lower().endswith(".csv"):
            return list(csv.DictReader(io.StringIO(text, newline="")))
        try:
            return _without_pairs(json.loads(text))
        except json.JSONDecodeError:
            return _without_pairs([json.loads(line) for line in text.splitlines() if line.strip()])
    except (UnicodeDecodeError, json.JSONDecodeError):
        return [] if name.lower().endswith(".csv") else {"status": "unreadable"}


def fold_reports(spark: SparkSession, root: str, prune: bool = False, keep: Sequence[str] = ("dataset-info.json", "source-info.json")) -> dict[str, Any]:
    """The JSON and CSV reports below ``root``, by their dotted names, as one payload; ``prune`` then deletes all but the files ``keep``.

    A name with both gives its document as ``summary`` and its table as ``rows``.
    Reports are audits of a run; over ``REPORT_BYTES`` in all they are refused.
    """
    fs, base = _fs(spark, root)
    start = len(fs.makeQualified(base).toString()) + 1
    sizes, entries = {}, fs.listFiles(base, True)
    while entries.hasNext():
        entry = entries.next()
        if re.search(r"/[^._/][^/]*\.(json|csv)$", name := entry.getPath().toString(), re.IGNORECASE):
            sizes[name[start:]] = entry.getLen()
    if sum(sizes.values()) > REPORT_BYTES:
        raise ValueError(f"over {REPORT_BYTES} bytes of reports in {root}")
    contents = dict.fromkeys(sizes, b"")  # the reader skips empty files
    if any(sizes.values()):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.lower("path").rlike(r"\.(json|csv)$"))
        contents |= {r["path"][start:]: bytes(r["content"]) for r in files.select("path", "content").collect()}
    documents: dict[str, Any] = {}
    rows: dict[str, Any] = {}
    for path, content in sorted(contents.items()):
        if path.rsplit("/", 1)[-1] in keep:
            continue
        stem, part = path.rsplit(".", 1)[0], re.search(r"/(?:csv|json)/part-[^/]*$", path)
        key = (path[: part.start()] if part else stem).replace("/", ".")
        found, into = _report(path, content), rows if path.lower().endswith(".csv") else documents
        into[key] = into[key] + found if part and isinstance(into.get(key), list) and isinstance(found, list) else found
    if prune:
        for entry in fs.listStatus(base):
            if entry.isDirectory() or entry.getPath().getName() not in keep:
                fs.delete(entry.getPath(), True)
    return {k: {"summary": documents[k], "rows": rows[k]} if k in documents and k in rows else documents.get(k, rows.get(k)) for k in sorted({*documents, *rows})}


def write_label_rows(samples: DataFrame, annotations: DataFrame, path: str) -> None:
    """(split, image_id, content) of every image, background ones empty, by split."""
    rows = samples.select("image_id", "split").join(labels.format_detect(samples, annotations), "image_id", "left").withColumn("content", F.coalesce("content", F.lit("")))
    rows.write.partitionBy("split").option("compression", "gzip").json(path)


def write_report(table: DataFrame, path: str) -> None:
    """A small table as CSV, nested cells as JSON, and as JSON lines."""
    flat = table.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in table.dtypes])
    flat.coalesce(1).write.option("header", True).option("escape", '"').option("lineSep", "\r\n").csv(f"{path}/csv")
    table.coalesce(1).write.json(f"{path}/json")


def latex(table: DataFrame, most: int = 200) -> str:
    """A report of at most ``most`` rows as a LaTeX table."""
    quote = lambda v: "" if v is None else str(v).translate(str.maketrans({"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$"}))
    rows = table.limit(most).collect()
    lines = [" & ".join(map(quote, r)) + r" \\" for r in [table.columns, *rows]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(table.columns)}}}", r"\hline", lines[0], r"\hline", *lines[1:], r"\hline", r"\end{tabular}"])


class PredictionCache:
    """Predictions by key (model and settings) in partitioned Parquet; a lookup returns hits and what is missing."""

    KEY = ("relative_path", "width", "height", "sha256")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def put(self, cache_key: str, predictions: DataFrame) -> None:
        predictions.withColumn("cache_key", F.lit(cache_key)).write.mode("append").partitionBy("cache_key").parquet(self.path)

    def get(self, cache_key: str, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(predictions of the samples that are stored, samples that are not); ids follow the samples, as stored ones may differ."""
        stored = self.spark.read.parquet(self.path).where(F.col("cache_key") == cache_key).drop("cache_key", "image_id")
        hits = stored.join(samples.select("image_id", *self.KEY), list(self.KEY))
        return hits, samples.join(stored.select(*self.KEY).distinct(), list(self.KEY), "left_anti")


def write_tree(files: DataFrame, root: str) -> int:
    """Write files (path below ``root``, content, text or bytes, or source path to copy where content is null) from the tasks; a retried task writes the same again. Returns how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        for batch in batches:
            for path, content, source in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "source")), strict=True):
                full = f"{base.rstrip('/')}/{path}"
                target.create_dir(full.rsplit("/", 1)[0])
                if content is None:
                    at, name = fs.FileSystem.from_uri(source) if "://" in source or source.startswith("file:") else (fs.LocalFileSystem(), source)
                    fs.copy_files(name, full, source_filesystem=at, destination_filesystem=target)
                else:
                    with target.open_output_stream(full) as out:
                        out.write(content if isinstance(content, bytes) else content.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("path", "content", "source").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_yolo(spark: SparkSession, destination: str, samples: DataFrame, annotations: DataFrame, classes: DataFrame, images: bool = True, overwrite: bool = False) -> dict[str, int]:
    """Publish ``{split}/images``, ``{split}/labels`` and ``data.yaml``: a label file for every image, empty ones for backgrounds, named by split and image number where file names clash.

    Images are copied from ``path`` if ``samples`` have it and they are neither crops nor copies.
    """
    name = F.element_at(F.split("relative_path" if "relative_path" in samples.columns else "path", "/"), -1)
    named = samples.withColumn("name", name).withColumn("again", F.count("*").over(Window.partitionBy("split", "name")) > 1)
    stem, suffix = F.regexp_replace("name", r"\.[^.]*$", ""), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    named = named.withColumn("stem", F.when(F.col("again"), F.concat(stem, F.lit("-"), F.hex("image_id"))).otherwise(stem)).withColumn("suffix", suffix)
    texts = labels.format_detect(samples, annotations)
    rows = named.join(texts, "image_id", "left")
    files = rows.select(F.concat_ws("/", "split", F.lit("labels"), F.concat("stem", F.lit(".txt"))).alias("path"), F.coalesce(F.concat("content", F.lit("\n")), F.lit("")).alias("content"), F.lit(None).cast("string").alias("source"))
    if images and "path" in samples.columns and not {"crop", "copy"} & set(samples.columns):
        copies = rows.select(F.concat_ws("/", "split", F.lit("images"), F.concat("stem", "suffix")).alias("path"), F.lit(None).cast("string").alias("content"), F.col("path").alias("source"))
        files = files.unionByName(copies)
    splits = [r[0] for r in samples.select("split").distinct().orderBy("split").collect()]
    names = [r[0] for r in classes.orderBy("class_id").select("name").collect()]
    yaml = "".join(f"{s}: {s}/images\n" for s in splits) + f"names: {json.dumps(names)}\n"
    counts: dict[str, int] = {}

    def write(path: str) -> None:
        counts["files"] = write_tree(files, path)
        write_tree(spark.createDataFrame([("data.yaml", yaml, None)], "path string, content string, source string"), path)

    publish(spark, destination, write, overwrite=overwrite)
    return counts


def png(mask: np.ndarray, value: int = 255) -> bytes:
    """An 8-bit grey image of a boolean mask, 0 and ``value``."""
    h, w = mask.shape
    lines = np.zeros((h, w + 1), np.uint8)
    lines[:, 1:] = mask * np.uint8(value)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def mask_files(samples: DataFrame, annotations: DataFrame, where: Column | None = None, value: int = 255) -> DataFrame:
    """(path, content): a mask of every image, the union of its polygons and runs, at ``where``, by default below ``{split}/masks/0``; images without any have empty masks."""
    lists = [F.collect_list("polygon").alias("polygons"), F.flatten(F.collect_list("runs")).alias("runs") if "runs" in annotations.columns else F.array().cast("array<struct<y:int,x0:int,x1:int>>").alias("runs")]
    kept = annotations.groupBy("image_id").agg(*lists)  # bounded by an image
    if where is None:
        where = F.concat_ws("/", "split", F.lit("masks/0"), F.concat(F.regexp_replace("relative_path", r"\.[^./]*$", ""), F.lit(".png")))
    rows = samples.join(kept, "image_id", "left").select(where.alias("path"), "width", "height", "polygons", "runs")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                mask = np.zeros((row["height"], row["width"]), bool)
                for polygon in row["polygons"] or []:
                    points = np.array([(p["x"], p["y"]) for p in polygon], float).reshape(-1, 2)
                    for y, x0, x1 in raster.polygon_runs(points, row["width"], row["height"]):
                        mask[y, x0:x1] = True
                for r in row["runs"] or []:
                    mask[r["y"], r["x0"] : r["x1"]] = True
                yield pa.RecordBatch.from_pydict({"path": [row["path"]], "content": pa.array([png(mask, value)], pa.binary())})

    return rows.mapInArrow(draw, "path string, content binary")


def write_masks(spark: SparkSession, destination: str, samples: DataFrame, annotations: DataFrame, overwrite: bool = False) -> dict[str, int]:
    """Publish the masks of :func:`mask_files`; images whose masks would share a path, case aside, are refused."""
    stem = F.lower(F.regexp_replace("relative_path", r"\.[^./]*$", ""))
    clash = samples.groupBy("split", stem.alias("stem")).count().where("count > 1").limit(4).collect()
    if clash:
        raise ValueError(f"images share a mask path: {[tuple(r) for r in clash]}")
    counts: dict[str, int] = {}

    def write(path: str) -> None:
        counts["files"] = write_tree(mask_files(samples, annotations).withColumn("source", F.lit(None).cast("string")), path)

    publish(spark, destination, write, overwrite=overwrite)
    return counts
