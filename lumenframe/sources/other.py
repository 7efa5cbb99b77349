"""Masks, lineage files, archives and the choice among formats."""

from __future__ import annotations

import hashlib
import zipfile
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.sources.sinks import exists
from lumenframe.sources.yolo import local

YAML_NAMES = ("data.yaml", "dataset.yaml", "data.yml")
REPORT_NAMES = ("dataset-info.json", "provenance.json")


def sniff(names: list[str]) -> str:
    """Format of a folder by its file names: metadata makes it yolo, any other JSON than a report coco, else flat yolo."""
    tops = [n for n in names if "/" not in n]
    yamls = [n for n in tops if n.endswith((".yaml", ".yml"))]
    if any(n in YAML_NAMES for n in tops) or len(yamls) == 1:
        return "yolo"
    if any(n.endswith(".json") and n.rsplit("/", 1)[-1] not in REPORT_NAMES for n in names):
        return "coco"
    return "flat"


def resolve(spark: SparkSession, path: str, format: str | None = None) -> tuple[str, str, list[str]]:
    """(format, root, files) of a folder or a metadata file: for yolo its metadata's name, for coco the paths of its files."""
    path = path.rstrip("/")
    parent, _, name = path.rpartition("/")
    if name.endswith(".json"):
        return "coco", parent, [path]
    if name.endswith((".yaml", ".yml")):
        return "yolo", parent, [name]
    if format == "parquet" or format is None and exists(spark, f"{path}/manifest") and exists(spark, f"{path}/samples"):
        return "parquet", path, []
    if format == "flat":
        return "flat", path, []
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,yaml,yml}").load(path).select(local(F.col("path")).alias("path"))
    base = path.removeprefix("file://").removeprefix("file:") + "/"
    names = sorted(r["path"].removeprefix(base) for r in found.collect())  # metadata files, a handful
    kind = format or sniff(names)
    tops = [n for n in names if "/" not in n and n.endswith((".yaml", ".yml"))]
    if kind == "yolo":
        return kind, path, [next((n for n in YAML_NAMES if n in tops), tops[0] if tops else YAML_NAMES[0])]
    return kind, path, [f"{path}/{n}" for n in names if n.endswith(".json") and n.rsplit("/", 1)[-1] not in REPORT_NAMES] if kind == "coco" else []


def mask_pixels(spark: SparkSession, root: str) -> DataFrame:
    """(path, foreground, total) of mask images, decoded by the JVM; one pass over the bytes."""
    images = spark.read.format("image").option("recursiveFileLookup", True).load(root).select("image.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                x = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                rows.append((r.origin, int((x.max(2) > 0).sum()), r.height * r.width))
            yield pd.DataFrame(rows, columns=["path", "foreground", "total"])

    return images.where("width > 0").select("origin", "width", "height", "nChannels", "data").mapInPandas(run, "path string, foreground long, total long")


def pair_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Images and masks (path, split) by stem and split; ``mask`` is null where there is none."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return images.withColumn("stem", stem("path")).join(masks.select("split", stem("path").alias("stem"), F.col("path").alias("mask")), ["split", "stem"], "left")


STEP = "struct<operation: string, settings_fingerprint: string>"
LINEAGE = f"output_image string, parent_image string, original_image string, output_sha256 string, original_sha256 string, output_split string, output_annotation_count bigint, chain array<string>, definitions map<string, {STEP}>"


def write_lineage(records: DataFrame, path: str) -> None:
    """Records with their chains as numbers ``t0``, ``t1``, ... of distinct steps; gzipped JSON lines, the definitions beside."""
    steps = records.select(F.explode("chain").alias("s")).select("s.*").distinct().orderBy("operation", "settings_fingerprint").collect()  # a handful by nature
    ids = {(r["operation"], r["settings_fingerprint"]): f"t{i}" for i, r in enumerate(steps)}
    key = lambda s: F.concat_ws("\x00", s["operation"], s["settings_fingerprint"])
    names = F.create_map(*[F.lit(x) for (o, f), t in ids.items() for x in (f"{o}\x00{f}", t)]) if ids else None
    chain = F.transform("chain", lambda s: names[key(s)]) if ids else F.array().cast("array<string>")
    records.withColumn("chain", chain).write.option("compression", "gzip").json(f"{path}/records")
    records.sparkSession.createDataFrame([(t, o, f) for (o, f), t in ids.items()], "id string, operation string, settings_fingerprint string").coalesce(1).write.option("compression", "gzip").json(f"{path}/definitions")


def read_lineage(spark: SparkSession, path: str) -> DataFrame:
    """Records with their steps spelled out again."""
    definitions = spark.read.schema("id string, operation string, settings_fingerprint string").json(f"{path}/definitions").collect()
    records = spark.read.schema("output_image string, parent_image string, original_image string, output_split string, chain array<string>").json(f"{path}/records")
    if not definitions:
        return records.withColumn("chain", F.array().cast(f"array<{STEP}>"))
    steps = F.create_map(*[x for r in definitions for x in (F.lit(r["id"]), F.struct(F.lit(r["operation"]).alias("operation"), F.lit(r["settings_fingerprint"]).alias("settings_fingerprint")))])
    return records.withColumn("chain", F.transform("chain", lambda t: steps[t]))


def safe_members(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """Members of an archive; absolute paths, parent folders and links are refused."""
    out = []
    for m in archive.infolist():
        p = PurePosixPath(m.filename)
        if p.is_absolute() or ".." in p.parts or (m.external_attr >> 16) & 0o170000 == 0o120000:
            raise ValueError(f"unsafe member {m.filename!r}")
        out.append(m)
    return out


def extract_zip(path: str, cache: str) -> str:
    """Folder of an archive's content, by its digest; extracted once. The shared folder must be one that the driver can write files to."""
    with Path(path).open("rb") as source:  # in pieces: archives may be larger than memory
        digest = hashlib.file_digest(source, "sha256").hexdigest()[:16]
    target = Path(cache) / digest
    if not target.exists():
        part = Path(cache) / f".{digest}.part"
        with zipfile.ZipFile(path) as z:
            z.extractall(part, safe_members(z))
        part.rename(target)
    roots = [p for p in target.iterdir() if p.is_dir()]
    return str(roots[0] if len(roots) == 1 and not any(p.is_file() for p in target.iterdir()) else target)


def content_digests(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) of files, hashed by the executors."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.sha2("content", 256).alias("sha256"))
