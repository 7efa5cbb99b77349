"""A lazy handle over a dataset's frames. Every operation returns a new one and records itself."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import augmentation, backgrounds, comparison, diff, lineage, planning, selection, summary, tiling
from lumenframe.operators.shared import work_dir
from lumenframe.sources import coco, other, prepare, sinks, yolo

GroupBy = Column | Callable[[str], Any]


@dataclass(frozen=True)
class Trace:
    """The datasets of a chain, and the samples with where their files are; None where samples have no path."""

    datasets: DataFrame
    samples: DataFrame | None


@dataclass(frozen=True)
class Dataset:
    """samples, annotations and classes, and the operations that led to them."""

    samples: DataFrame
    annotations: DataFrame
    classes: DataFrame
    name: str = "dataset"
    plan: tuple[tuple[str, str], ...] = ()
    issues: DataFrame | None = None
    #: Where it was opened, and what the export there recorded.
    location: str | None = None
    manifest: Mapping[str, Any] | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, format: str | None = None, name: str = "dataset", errors: str = "raise", task: str | None = None) -> Dataset:
        """Read a dataset: ``yolo``, ``flat`` (without metadata), ``coco`` or ``parquet`` (of :meth:`export`); by default what the path looks like.

        ``path``: a folder, a metadata file, or a ZIP archive. ``errors``: ``raise``
        refuses bad records, ``skip`` sets them aside and keeps their ``issues``.
        Samples have a ``relative_path`` that does not change with the split, and a
        ``group_key``: the image itself, until :meth:`grouped` says otherwise.
        """
        if path.endswith(".zip"):
            path = other.extract_zip(path, f"{work_dir(spark).removeprefix('file://')}/archives")
        found, root, files = other.resolve(spark, path, format)
        if found == "parquet":
            return cls(*sinks.read_dataset(spark, root, "samples", "annotations", "classes"), name, location=root, manifest=sinks.read_manifest(spark, root))
        if found == "coco":
            frames = coco.read(spark, files, root if not yolo.images_under(spark, root).isEmpty() else None, task)
            bad = frames["issues"]
            if errors == "raise" and not bad.isEmpty():
                raise ValueError(f"bad records: {[tuple(r) for r in bad.limit(4).collect()]}")
        else:
            frames = yolo.open_dataset(spark, root, files[0] if found == "yolo" else None, task, errors)
        return cls(frames["samples"], frames["annotations"], frames["classes"], name, issues=frames["issues"], location=root)

    @classmethod
    def update(cls, spark: SparkSession, path: str, destination: str | None = None, name: str = "dataset") -> Dataset:
        """Bring what :meth:`export` wrote to the current schema, in place or as a copy, and open it."""
        sinks.update_dataset(spark, path, destination)
        return cls.open(spark, destination or path, "parquet", name)

    def _next(self, operation: str, settings: dict[str, Any], **changes: DataFrame | None) -> Dataset:
        step = (operation, lineage.fingerprint(settings))
        return replace(self, name=lineage.derived_name(self.name, operation, settings), plan=(*self.plan, step), **changes)

    def _with_samples(self, operation: str, settings: dict[str, Any], samples: DataFrame) -> Dataset:
        kept = self.annotations.join(samples.select("image_id"), "image_id", "left_semi")
        return self._next(operation, settings, samples=samples, annotations=kept)

    def _names(self) -> dict[int, str]:
        return {r["class_id"]: r["name"] for r in self.classes.select("class_id", "name").collect()}

    def grouped(self, group_by: GroupBy) -> Dataset:
        """With ``group_key`` from a column or a function of the path."""
        key = group_by
        if not isinstance(group_by, Column):
            of_paths = F.pandas_udf(lambda paths: paths.map(lambda p: None if (v := group_by(p)) is None else str(v)), "string")
            key = of_paths("relative_path" if "relative_path" in self.samples.columns else "path")
        return replace(self, samples=self.samples.withColumn("group_key", key))

    def filter(self, gt_annotated: bool | None = None, predictions: DataFrame | None = None, has_prediction: bool | None = None, splits: Sequence[str] | None = None) -> Dataset:
        return self._with_samples("filter", {"annotated": gt_annotated, "predicted": has_prediction, "splits": splits}, selection.filter_samples(self.samples, self.annotations, gt_annotated, predictions, has_prediction, splits))

    def remove_classes(self, classes: Sequence[int | str], merge_into: int | str | None = None, **options: Any) -> Dataset:
        ids, names = selection.resolve_classes(self.classes, classes), self._names()
        into = None if merge_into is None else selection.resolve_classes(self.classes, [merge_into])[0]
        n = self.classes.count()
        s, a = selection.remove_classes(self.samples, self.annotations, n, ids, into, **options)
        left = [c for c in range(n) if c == into or c not in ids]
        number = F.create_map(*[F.lit(x) for i, c in enumerate(left) for x in (c, i)])
        kept = self.classes.where(F.col("class_id").isin(left)).withColumn("class_id", number[F.col("class_id")])
        return self._next("remove_classes", {"classes": [names.get(i, i) for i in ids], "merge_into": names.get(into, into), **options}, samples=s, annotations=a, classes=kept)

    def rename_classes(self, renames: Mapping[str, str]) -> Dataset:
        return self._next("rename_classes", dict(renames), classes=selection.rename_classes(self.classes, renames))

    def move_images_with_classes(self, classes: Sequence[int | str], to_split: str, source_splits: Sequence[str] | None = None) -> Dataset:
        ids, names = selection.resolve_classes(self.classes, classes), self._names()
        return self._with_samples("move_images_with_classes", {"classes": [names.get(i, i) for i in ids], "to": to_split}, selection.move_images_with_classes(self.samples, self.annotations, ids, to_split, source_splits))

    def move_n_groups(self, n: int, from_split: str, to_split: str, seed: int = 0, method: str = "exact") -> Dataset:
        return self._with_samples("move_n_groups", {"n": n, "from": from_split, "to": to_split, "seed": seed}, planning.move_n_groups(self.samples, n, from_split, to_split, seed, method))

    def split(self, ratios: Mapping[str, float], seed: int = 0, source_splits: Sequence[str] | None = None, assign: Mapping[str, str] | None = None, method: str = "exact") -> Dataset:
        """Whole groups to splits; ``assign`` pins groups. ``method='classes'`` balances by size classes, without a row a group on the driver."""
        out = planning.split(self.samples, self.annotations, ratios, seed, source_splits, assign, method=method)
        return self._with_samples("split", {"ratios": dict(ratios), "seed": seed}, out)

    def sample(self, n: int, split: str | None = None, seed: int = 0) -> Dataset:
        return self._with_samples("sample", {"n": n, "split": split, "seed": seed}, planning.sample(self.samples, n, seed, split).drop("ord"))

    def rebalance_empty(self, max_empty_fraction: float, seed: int = 0) -> Dataset:
        return self._with_samples("rebalance_empty", {"fraction": max_empty_fraction, "seed": seed}, selection.rebalance_empty(self.samples, self.annotations, max_empty_fraction, seed))

    def add(self, second: Dataset) -> Dataset:
        """This dataset's images, then those of ``second`` whose path (and occurrence of it) this one lacks, each with its own side's annotations.

        The classes must be the same. Images of ``second`` whose id another image has here get a new one.
        """
        if self._names() != second._names():
            raise ValueError("the datasets have different classes")
        key = ["relative_path", "occurrence"]  # unique on each side
        ours = self.samples
        theirs = diff.keyed(second.samples).join(diff.keyed(ours).select(*key), key, "left_anti")
        new_id = F.when(F.col("taken"), F.xxhash64(F.lit("add"), "image_id", *key)).otherwise(F.col("image_id"))
        theirs = theirs.join(ours.select("image_id", F.lit(True).alias("taken")), "image_id", "left").withColumn("new_id", new_id).drop("taken", "occurrence")
        renamed = lambda df: df.drop("image_id").withColumnRenamed("new_id", "image_id")
        samples = ours.unionByName(renamed(theirs), allowMissingColumns=True)
        first = self.annotations.join(ours.select("image_id"), "image_id", "left_semi")
        rest = renamed(second.annotations.join(theirs.select("image_id", "new_id"), "image_id"))
        return self._next("add", {"other": second.name}, samples=samples, annotations=first.unionByName(rest, allowMissingColumns=True))

    def _drawn(self, what: str) -> None:
        if "runs" in self.annotations.columns:
            raise ValueError(f"{what} needs polygons: this dataset has run-length masks")

    def tile(self, size: int, overlap: float = 0.2, min_area_ratio: float = 0.1, negatives: str | float = "all", mode: str = "grid", appearances: int = 1, seed: int = 0, lossy: bool = False, background_share: float | None = None, background_each: int | None = None, most: int | None = None, background_filter: Callable[[Any], Any] | None = None, roots: Sequence[str] = ()) -> Dataset:
        """Tiles as new images, with their boxes, keypoints, polygons or points clipped.

        ``mode``: ``grid``, or ``coverage``: random crops that hold each object
        (of a box) ``appearances`` times. ``negatives``: all or none of the empty
        tiles, or the share of a split's tiles that they may have; a seeded hash picks them.
        ``background_share``: crops of empty space, or of images without objects, up to this share
        of a split's tiles, ``background_each`` an image at most, ``most`` with its tiles.
        ``background_filter`` decides on a crop's pixels (rows, columns, RGB) of images below
        ``roots``. Samples then have an ``origin``, and ``issues`` the shortfall by split.
        """
        if mode not in ("grid", "coverage") or not (negatives in ("all", "none") or isinstance(negatives, float) and 0 <= negatives < 1):
            raise ValueError("the mode is grid or coverage; negatives are all, none or a share under 1")
        self._drawn("tiling")
        samples = self.samples
        tiles = tiling.grid_tiles(samples, size, overlap) if mode == "grid" else tiling.coverage_tiles(samples, tiling.boxed(self.annotations), size, appearances, seed=seed).join(samples.select("image_id", "split"), "image_id")
        issues = self.issues
        if background_share is not None:
            more = backgrounds.propose(samples, self.annotations, tiles, size, background_share, seed, background_each, most, background_filter, list(roots))
            tiles, issues = tiles.unionByName(more.crops, allowMissingColumns=True), more.report.where("shortfall > 0")
        cut = tiling.clip_any(tiles, self.annotations, min_area_ratio, lossy)
        new_id = F.xxhash64("image_id", "tile").alias("new_id")
        s = tiles.join(samples.select("image_id", *(c for c in ("relative_path", "path", "group_key") if c in samples.columns)), "image_id")
        s = s.select(new_id, *(c for c in ("relative_path", "path", "group_key") if c in s.columns), "split", (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"), F.struct("x1", "y1", "x2", "y2").alias("crop"), *(["origin"] if "origin" in s.columns else [])).withColumnRenamed("new_id", "image_id")
        a = cut.select(new_id, *(c for c in cut.columns if c not in ("image_id", "tile"))).withColumnRenamed("new_id", "image_id")
        if negatives == "none":
            s = s.join(a.select("image_id").distinct(), "image_id", "left_semi")
        elif negatives != "all":
            s = selection.rebalance_empty(s, a, negatives, seed)
        settings = {"mode": mode, "size": size, "overlap": overlap, "ratio": min_area_ratio, "negatives": negatives, "appearances": appearances, "seed": seed}
        if background_share is not None:
            settings |= {"background_share": background_share, "background_each": background_each, "most": most, "background_filter": lineage.described(background_filter)}
        return self._next("tile", settings, samples=s, annotations=a, issues=issues)

    def augment(self, copies: int, seed: int = 0, include_original: bool = True, splits: Sequence[str] = ("train",), flip_x: float = 0.5, flip_y: float = 0.0, transforms: Sequence[augmentation.Transform] | None = None, min_visibility: float = 0.0) -> Dataset:
        """Copies with seeds of their own and their annotations. Samples have what each copy drew (``replay``) and its ``matrix``.

        ``transforms``: what to draw from, in order; by default mirroring with the given chances.
        """
        self._drawn("augmentation")
        if transforms is None:
            transforms = [augmentation.Transform("flip_x", p=flip_x), augmentation.Transform("flip_y", p=flip_y)]
        s = augmentation.copies(self.samples, copies, transforms, seed, include_original, splits)
        a = self.annotations.withColumnRenamed("image_id", "parent_id").join(s.select("parent_id", "image_id"), "parent_id").drop("parent_id")
        originals = a.join(s.where("copy = 0").select("image_id"), "image_id", "left_semi")  # as they are, whether inside their image or not
        moved = augmentation.transformed(a, s.where("copy > 0"), min_visibility)
        settings = {"copies": copies, "seed": seed, "transforms": [[t.kind, t.low, t.high, t.p] for t in transforms], "visibility": min_visibility}
        return self._next("augment", settings, samples=s, annotations=originals.unionByName(moved))

    def summary(self) -> DataFrame:
        return summary.dataset_summary(self.samples, self.annotations)

    def class_summary(self) -> DataFrame:
        return summary.class_summary(self.classes.select("class_id"), self.annotations)

    def _source(self) -> dict[str, Any] | None:
        """The record of what this dataset was opened from, with that one's own source."""
        if self.location is None:
            return None
        m = self.manifest or {}
        return {"id": m.get("dataset_id"), "name": m.get("name"), "path": self.location, "source": m.get("source")}

    def trace(self, search_paths: Sequence[str] = (), path_rewrites: Mapping[str, str] | None = None) -> Trace:
        """The datasets that this one comes from, nearest first, and where its samples' files are now.

        A dataset is where a rewrite or its recorded path has its id, else wherever below
        the search paths a manifest has it. Files are found as :func:`lineage.resolved` says, by
        the samples' ``sha256`` where they have one.
        """
        spark, moves, chain = self.samples.sparkSession, dict(path_rewrites or {}), []
        step = self._source()
        while step:
            chain.append(step)
            step = step.get("source")
        searched = sinks.manifests_below(spark, search_paths, [c["id"] for c in chain if c["id"]])
        rows = []
        for depth, c in enumerate(chain):  # a row for each dataset of a chain
            moved = lineage.moved_path(c["path"], moves)
            tries = [(moved, "path-rewrite")] * (moved is not None) + [(c["path"], "stored-path")]
            here = next(((p, how) for p, how in tries if sinks.exists(spark, p) and (not c["id"] or sinks.read_manifest(spark, p).get("dataset_id") == c["id"])), None)
            here = here or ((searched[c["id"]], "search") if c["id"] in searched else (None, "unresolved"))
            rows.append((depth, c["id"], c["name"], c["path"], *here))
        datasets = spark.createDataFrame(rows, "depth int, dataset_id string, name string, path string, resolved string, resolved_by string")
        if "path" not in self.samples.columns:
            return Trace(datasets, None)
        s = self.samples.withColumn("path", yolo.local(F.col("path")))
        s = s if "sha256" in s.columns else s.withColumn("sha256", F.lit(None).cast("string"))
        files = sinks.listed(spark, s, search_paths, moves)
        return Trace(datasets, lineage.resolved(s, files, moves).select("image_id", "relative_path", "path", "sha256", "resolved", "resolved_by"))

    def audit(self) -> DataFrame:
        return summary.group_isolation(self.samples)

    def _marked(self, changed: str) -> DataFrame:
        """Samples with the column that tells whether an image changed; digests of the files where they are missing."""
        if changed in self.samples.columns:
            return self.samples
        if changed == "sha256" and "path" in self.samples.columns:
            return self.samples.join(sinks.file_digests(self.samples), "path", "left")
        return self.samples.withColumn(changed, F.lit(None).cast("string"))

    def compare(self, later: Dataset, changed: str = "sha256") -> dict[str, DataFrame]:
        """overview, splits, classes and images tables of this dataset against a later one."""
        images = diff.images(self._marked(changed), later._marked(changed), changed)
        return {"overview": diff.overview(images), "splits": diff.splits(self.samples, later.samples), "classes": diff.classes(self.annotations, later.annotations), "images": images}

    def export_yolo(self, destination: str, images: bool = True, overwrite: bool = False) -> dict[str, int]:
        """Publish label files by split and ``data.yaml``, and copy the images where they are whole files."""
        self._drawn("a label tree")
        return sinks.write_yolo(self.samples.sparkSession, destination, self.samples, self.annotations, self.classes, images, overwrite)

    def export_masks(self, destination: str, overwrite: bool = False) -> dict[str, int]:
        """Publish a mask of every image by split, the union of its polygons; classes and objects are not told apart."""
        return sinks.write_masks(self.samples.sparkSession, destination, self.samples, self.annotations, overwrite)

    def export_formats(self, yolo: str | None = None, masks: str | None = None, images: bool = True) -> dict[str, dict[str, int]]:
        """Label trees, then masks, into folders that must all be new; nothing is written if one is not."""
        for place in filter(None, (yolo, masks)):
            if sinks.exists(self.samples.sparkSession, place):
                raise FileExistsError(place)
        done = {}
        if yolo:
            done["yolo"] = self.export_yolo(yolo, images)
        if masks:
            done["masks"] = self.export_masks(masks)
        return done

    def prepare(self, kind: str, destination: str, masks: DataFrame | None = None, mask_threshold: int = 128, max_size: tuple[int, int] | None = None, errors: str = "raise") -> prepare.Prepared:
        """Bring a training layout (``yolo-seg``, ``yolo-sem``, ``nnunet``) in line with this dataset; only what changed is written. Steps that no export has written are refused."""
        if self.plan:
            raise ValueError(f"not exported yet: {[p[0] for p in self.plan]}")
        return prepare.prepare(self.samples.sparkSession, destination, self.samples, self.annotations, self.classes, kind, masks, mask_threshold, max_size, errors)

    def assert_trainable(self, required: Sequence[str] = ("train", "val"), task: str = "detect", keypoint_shape: Sequence[int] | None = None) -> None:
        """Raise with all that keeps the dataset from being trained on; steps that no export has written count."""
        if self.plan:
            raise ValueError(f"not exported yet: {[p[0] for p in self.plan]}")
        issues = selection.trainability(self.samples, self.classes, required, task, keypoint_shape).collect()  # splits and classes are few
        if issues:
            raise ValueError(f"not trainable: {[tuple(r) for r in issues]}")

    def compare_models(self, predictions: DataFrame, split: str | None = "val", models: DataFrame | None = None, trained: DataFrame | None = None) -> comparison.Comparison:
        """Score and rank the models of ``predictions`` on a split (None: all images)."""
        samples = self.samples if split is None else self.samples.where(F.col("split") == split)
        return comparison.compare_models(samples, self.annotations, predictions, models, trained)

    def export(self, destination: str, dry_run: bool = False, overwrite: bool = False) -> dict[str, int]:
        """Publish all frames at once, with a manifest of the plan."""
        frames = {"samples": self.samples, "annotations": self.annotations, "classes": self.classes}
        return sinks.write_dataset(self.samples.sparkSession, destination, frames, {"name": self.name, "plan": [list(p) for p in self.plan], "dataset_id": uuid.uuid4().hex, "source": self._source()}, dry_run, overwrite)
