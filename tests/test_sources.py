"""Readers, sinks, the dataset handle and the stream, on small files."""

from __future__ import annotations

import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lumenframe.dataset import Dataset
from lumenframe.operators import lineage
from lumenframe.plans.fixtures import table
from lumenframe.sources import coco, labels, other, sinks, yolo
from lumenframe.streaming import ingest

SMALL = "/root/testdata/sf0.001"


def png(path, width, height, value=255):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    rows = b"".join(b"\0" + bytes([value]) * width for _ in range(height))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


@pytest.fixture
def root(tmp_path):
    for i, split in enumerate(("train", "train", "val")):
        png(tmp_path / split / "images" / f"i{i}.png", 40, 20)
        if i != 1:
            (tmp_path / split / "labels").mkdir(exist_ok=True)
            (tmp_path / split / "labels" / f"i{i}.txt").write_text(f"{i % 2} 0.5 0.5 0.5 0.5\n\n1 0.25 0.25 0.1 0.1\n")
    (tmp_path / "val" / "labels" / "lost.txt").write_text("0 0.5 0.5 0.1 0.1\n")
    (tmp_path / "data.yaml").write_text("train: train/images\nval: val/images\nnames: [fruit, damaged]\n")
    return tmp_path


def test_yolo(spark, root):
    frames = yolo.open_dataset(spark, str(root))
    s = {r["path"].rsplit("/", 1)[-1]: (r["split"], r["width"], r["height"]) for r in frames["samples"].collect()}
    assert s == {"i0.png": ("train", 40, 20), "i1.png": ("train", 40, 20), "i2.png": ("val", 40, 20)}
    boxes = sorted((r["class_id"], r["ann_idx"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in frames["annotations"].collect())
    assert boxes[0] == (0, 0, 10.0, 5.0, 30.0, 15.0) and len(boxes) == 4
    assert [r["name"] for r in frames["classes"].orderBy("class_id").collect()] == ["fruit", "damaged"]
    assert [r["path"].rsplit("/", 1)[-1] for r in yolo.orphans(spark, str(root)).collect()] == ["lost.txt"]
    flat = yolo.open_dataset(spark, str(root), None)
    assert flat["samples"].groupBy("split").count().count() == 2


def test_yolo_bad_rows(spark, root):
    (root / "train" / "labels" / "i1.txt").write_text("0 0.5 0.5\n1.5 0 0 1 1\nx 0 0 1 1\n")
    with pytest.raises(ValueError, match="column count|integral|number"):
        yolo.open_dataset(spark, str(root), task="detect")
    frames = yolo.open_dataset(spark, str(root), task="detect", errors="skip")
    assert sorted(r["category"] for r in frames["issues"].collect()) == ["class not integral", "column count", "not a number"]


def test_label_tasks(spark):
    df = spark.createDataFrame([(1, 1, "0 0.1 0.1 0.5 0.1 0.5 0.5", 100, 10), (1, 2, "0 4 0.5 0.5", 100, 10), (1, 3, "0 .5 .5 1 1 .1 .2 2 .3 .4 0", 100, 10)], "image_id long, line_no int, line string, width int, height int")
    seg = labels.parse(df.where("line_no = 1"), "segment").first()
    assert [(p["x"], p["y"]) for p in seg["polygon"]] == [(10.0, 1.0), (50.0, 1.0), (50.0, 5.0)]
    polo = labels.parse(df.where("line_no = 2"), "polo").first()
    assert (polo["px"], polo["py"], polo["radius"]) == (50.0, 5.0, 4.0)
    pose = labels.parse(df.where("line_no = 3"), "pose", (2, 3)).first()
    assert [(round(p["x"], 6), p["v"]) for p in pose["keypoints"]] == [(10.0, 2.0), (30.0, 0.0)]
    assert labels.infer_task(df.where("line_no = 2").withColumn("ord", F.lit(0))) == "polo"


def test_coco(spark, tmp_path):
    data = {
        "images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 10}, {"id": 2, "file_name": "b.jpg", "width": 10, "height": 10}],
        "annotations": [
            {"id": 1, "image_id": 1, "category_id": 7, "bbox": [1, 1, 2, 3], "segmentation": [[1, 1, 3, 1, 3, 4]]},
            {"id": 2, "image_id": 1, "category_id": 3, "bbox": [0, 0, 1, 1], "keypoints": [1, 2, 2]},
            {"id": 3, "image_id": 9, "category_id": 3, "bbox": [0, 0, 1, 1]},
            {"id": 4, "image_id": 2, "category_id": 8, "bbox": [0, 0, 1, 1]},
        ],
        "categories": [{"id": 7, "name": "x"}, {"id": 3, "name": "y"}],
    }
    (tmp_path / "val.json").write_text(json.dumps(data))
    out = coco.read(spark, str(tmp_path / "val.json"), task="pose")
    rows = {r["source_id"].rsplit(":", 1)[-1]: r for r in out["annotations"].collect()}
    assert len(coco.read(spark, str(tmp_path / "val.json"), task="segment")["annotations"].first()["polygon"]) == 3
    assert set(rows) == {"1", "2"} and rows["1"]["class_id"] == 1 and rows["2"]["class_id"] == 0
    assert (rows["1"]["x2"], rows["1"]["y2"]) == (3.0, 4.0) and rows["2"]["keypoints"][0]["v"] == 2
    assert sorted(r["category"] for r in out["issues"].collect()) == ["dangling category", "dangling image"]
    assert {r["split"] for r in out["samples"].collect()} == {"val"}


def test_masks(spark, tmp_path):
    png(tmp_path / "m" / "a.png", 5, 4)
    png(tmp_path / "m" / "b.png", 5, 4, 0)
    got = {r["path"].rsplit("/", 1)[-1]: (r["foreground"], r["total"]) for r in other.mask_pixels(spark, str(tmp_path / "m")).collect()}
    assert got == {"a.png": (20, 20), "b.png": (0, 20)}


def test_lineage_files(spark, tmp_path):
    rows = spark.sql("select 'o' as output_image, 'p' as parent_image, 'q' as original_image, 'train' as output_split, array(named_struct('operation', 'split', 'settings_fingerprint', 'ab')) as chain")
    two = lineage.chained(rows, "tile", {"size": 3})
    other.write_lineage(two, str(tmp_path / "l"))
    back = other.read_lineage(spark, str(tmp_path / "l")).first()
    assert [s["operation"] for s in back["chain"]] == ["split", "tile"]


def test_zip(tmp_path):
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("set/data.yaml", "names: [a]")
    assert other.extract_zip(str(tmp_path / "d.zip"), str(tmp_path / "c")).endswith("/set")
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("../x", "")
    with pytest.raises(ValueError):
        other.extract_zip(str(tmp_path / "e.zip"), str(tmp_path / "c"))
    assert other.sniff(["data.yaml"]) == "yolo" and other.sniff(["a/x.json"]) == "coco" and other.sniff(["train/images/a.jpg"]) == "flat"


@pytest.fixture
def dataset(spark):
    from lumenframe.plans.registry import classes

    return Dataset(table(spark, SMALL, "samples"), table(spark, SMALL, "annotations"), classes(spark))


def test_dataset_round_trip(spark, dataset, tmp_path):
    ds = dataset.remove_classes(["raw"]).rename_classes({"ripe": "red"}).split({"train": 3, "val": 1}, 1)
    assert ds.audit().isEmpty() and ds.classes.count() == 4
    rows = ds.export(str(tmp_path / "out"))
    again = Dataset.open(spark, str(tmp_path / "out"), "parquet")
    assert again.samples.count() == rows["samples"] and again.annotations.count() == rows["annotations"]
    with pytest.raises(FileExistsError):
        ds.export(str(tmp_path / "out"))
    assert ds.export(str(tmp_path / "x"), dry_run=True) == rows and not (tmp_path / "x").exists()
    assert len(ds.plan) == 3 and ds.name != dataset.name


def test_dataset_operations(dataset):
    assert dataset.filter(gt_annotated=False).annotations.isEmpty()
    assert dataset.sample(25, seed=2).samples.count() == 25
    tiled = dataset.filter(splits=["test"]).tile(512, negatives="none")
    assert tiled.samples.join(tiled.annotations, "image_id", "left_anti").isEmpty()
    twice = dataset.filter(splits=["train"]).augment(1, 3)
    assert twice.samples.count() == 2 * dataset.samples.where("split = 'train'").count() and twice.samples.select("image_id").distinct().count() == twice.samples.count()
    both = dataset.filter(splits=["train"]).add(dataset)
    assert both.samples.count() == dataset.samples.count() and both.annotations.count() == dataset.annotations.count()
    with pytest.raises(ValueError):
        dataset.remove_classes(["no such class"])


def test_prediction_cache(spark, tmp_path):
    s = spark.createDataFrame([(1, "a", 1, 1, "x"), (2, "b", 1, 1, "y")], "image_id long, relative_path string, width int, height int, sha256 string")
    cache = sinks.PredictionCache(spark, str(tmp_path / "c"))
    cache.put("k", s.where("image_id = 1").withColumn("score", F.lit(0.5)))
    hits, missing = cache.get("k", s.withColumn("image_id", F.col("image_id") + 10))
    assert [r["image_id"] for r in hits.collect()] == [11] and [r["image_id"] for r in missing.collect()] == [12]


def test_stream(spark, root, tmp_path):
    (root / "val" / "labels" / "bad.txt").write_text("0 0.5\n")
    for _ in range(2):
        q = ingest.ingest(spark, str(root), str(tmp_path / "o"), str(tmp_path / "ck"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o" / "annotations")).count() == 5
    assert spark.read.parquet(str(tmp_path / "o" / "issues")).count() == 1


TASKS = {
    "detect": "0 0.5 0.5 0.5 0.5\n1 0.25 0.25 0.1 0.2\n",
    "segment": "0 0.25 0.25 0.75 0.25 0.75 0.75\n",
    "pose": "0 0.5 0.5 0.5 0.5 0.4 0.4 2 0.6 0.6 1\n",
    "polo": "1 4.0 0.5 0.5\n",
}


@pytest.mark.parametrize("task", list(TASKS))
def test_yolo_round_trip_tiles_and_copies(spark, tmp_path, task):
    """What is exported reads the same again; tiles and mirrored copies keep each task's geometry."""
    root = tmp_path / "in"
    for i, split in enumerate(("train", "train", "val")):
        png(root / split / "images" / f"i{i}.png", 40, 20)
    for split, i in (("train", 0), ("val", 2)):
        (root / split / "labels").mkdir()
        (root / split / "labels" / f"i{i}.txt").write_text(TASKS[task])
    (root / "data.yaml").write_text("train: train/images\nval: val/images\nnames: [a, b]\n" + ("kpt_shape: [2, 3]\n" if task == "pose" else ""))
    frames = yolo.open_dataset(spark, str(root), task=task)
    ds = Dataset(frames["samples"], frames["annotations"], frames["classes"])
    out = str(tmp_path / "out")
    assert ds.export_yolo(out)["files"] == 6
    assert ds.export_yolo(out, overwrite=True)["files"] == 6 and not [p for p in tmp_path.iterdir() if "old-" in p.name or "staging-" in p.name]
    text = (tmp_path / "out" / "train" / "labels" / "i0.txt").read_text()
    numbers = lambda t: [[float(x) for x in line.split()] for line in t.splitlines()]
    assert numbers(text) == numbers(TASKS[task]) and (tmp_path / "out" / "train" / "labels" / "i1.txt").read_text() == ""
    assert (tmp_path / "out" / "val" / "images" / "i2.png").read_bytes() == (root / "val" / "images" / "i2.png").read_bytes()
    again = yolo.open_dataset(spark, out, task=task) if task != "pose" else None
    if again:
        assert again["annotations"].count() == frames["annotations"].count()
    tiles = ds.tile(20, 0.0)
    assert tiles.samples.count() == 6 and tiles.name.startswith("dataset__tile-grid-20__")
    cut = tiles.annotations.collect()
    if task == "segment":
        box = lambda r: (r["x1"], r["y1"], r["x2"], r["y2"])
        assert sorted({box(r) for r in cut}) == [(0.0, 5.0, 10.0, 15.0), (10.0, 5.0, 20.0, 10.0)]
    if task == "pose":
        seen = sorted([(q["x"], q["y"], q["v"]) for q in r["keypoints"]] for r in cut)
        assert seen[:2] == [[(0.0, 0.0, 0.0), (4.0, 12.0, 1.0)]] * 2 and seen[2:] == [[(16.0, 8.0, 2.0), (0.0, 0.0, 0.0)]] * 2
    if task == "polo":
        assert not cut and {(r["px"], r["py"]) for r in ds.tile(30, 0.5).annotations.collect()} == {(20.0, 10.0), (10.0, 10.0)}
    share = ds.tile(20, 0.0, negatives=0.5)
    assert ds.tile(20, 0.0, negatives="none").samples.count() <= share.samples.count() <= tiles.samples.count()
    copies = ds.augment(1, seed=3, flip_x=1.0, flip_y=1.0)
    both = copies.samples.where("copy = 1").join(copies.annotations, "image_id").collect()
    first = next(r for r in both if r["ann_idx"] == 0)
    if task == "segment":
        assert [(q["x"], q["y"]) for q in first["polygon"]] == [(30.0, 15.0), (10.0, 15.0), (10.0, 5.0)]
    if task == "pose":
        assert [(q["x"], q["y"]) for q in first["keypoints"]] == [(24.0, 12.0), (16.0, 8.0)]
    if task == "detect":
        assert {(r["x1"], r["y1"], r["x2"], r["y2"]) for r in both if r["ann_idx"] == 1} == {(28.0, 13.0, 32.0, 17.0)}


def test_clip_polygon_against_pixels(spark):
    """Areas of random convex polygons inside a box, against fine sampling."""
    import numpy as np

    from lumenframe.functions.geometry import clip_polygon, polygon_area

    rng = np.random.default_rng(0)
    rows = []
    for i in range(20):
        angle = np.sort(rng.uniform(0, 2 * np.pi, 6))
        rows.append((i, [{"x": float(10 + 8 * np.cos(a)), "y": float(8 + 6 * np.sin(a))} for a in angle]))
    df = spark.createDataFrame(rows, "i int, p array<struct<x:double,y:double>>")
    got = {r[0]: r[1] for r in df.select("i", polygon_area(clip_polygon("p", F.lit(5), F.lit(5), F.lit(14), F.lit(12)))).collect()}
    x, y = np.meshgrid(np.arange(5, 14, 0.02) + 0.01, np.arange(5, 12, 0.02) + 0.01)
    for i, p in rows:
        inside = np.ones_like(x, bool)
        for a, b in zip(p, p[1:] + p[:1], strict=True):
            inside &= (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]) >= 0
        assert abs(got[i] - inside.sum() * 0.0004) < 0.3


def test_fold_reports(spark, tmp_path):
    root = tmp_path / "reports"
    (root / "audit").mkdir(parents=True)
    (root / "dataset-info.json").write_text("{}")
    (root / "audit" / "split.json").write_text(json.dumps({"images_before": 3, "images_after": 2, "before": 1, "after": {"n_before": 1, "n": 5}, "rows": [{"x_after": 1}]}))
    (root / "audit" / "split.csv").write_text('a,b\n1,"x, y"\n,2\n')
    (root / "odd.json").write_text("{not json")
    (root / "empty.csv").write_text("")
    sinks.write_report(spark.createDataFrame([(1, ["p"]), (2, None)], "n int, v array<string>").orderBy("n"), str(root / "table"))
    found = sinks.fold_reports(spark, str(root), prune=True)
    assert found == {
        "audit.split": {"summary": {"images": 2, "result": {"n": 5}, "rows": [{"x": 1}]}, "rows": [{"a": "1", "b": "x, y"}, {"a": "", "b": "2"}]},
        "empty": [],
        "odd": {"status": "unreadable"},
        "table": {"summary": [{"n": 1, "v": ["p"]}, {"n": 2}], "rows": [{"n": "1", "v": '["p"]'}, {"n": "2", "v": ""}]},
    }
    assert [p.name for p in root.iterdir() if not p.name.startswith(".")] == ["dataset-info.json"]
    assert sinks.fold_reports(spark, str(root)) == {}


def test_update(spark, root, tmp_path):
    import hashlib

    out, copy = str(tmp_path / "out"), str(tmp_path / "copy")
    with pytest.raises(ValueError, match="no manifest"):
        Dataset.update(spark, str(root))
    ds = Dataset.open(spark, str(root))
    ds.export(out)
    (root / "train" / "images" / "i1.png").unlink()
    made = Dataset.update(spark, out, copy)
    rows = {r["path"].rsplit("/", 1)[-1]: (r["annotation_count"], r["sha256"]) for r in made.samples.collect()}
    digest = lambda n, s: hashlib.sha256((root / s / "images" / n).read_bytes()).hexdigest()
    assert rows["i0.png"] == (2, digest("i0.png", "train")) and rows["i2.png"] == (2, digest("i2.png", "val")) and rows["i1.png"][0] == 0
    assert "annotation_count" not in spark.read.parquet(f"{out}/samples").columns
    Dataset.update(spark, out)
    again = Dataset.update(spark, out)
    assert {r["path"].rsplit("/", 1)[-1]: (r["annotation_count"], r["sha256"]) for r in again.samples.collect()} == rows
    assert json.loads(spark.read.text(f"{out}/manifest").first()[0])["schema"] == sinks.SCHEMA and again.annotations.count() == 4
