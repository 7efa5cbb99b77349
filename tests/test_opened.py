"""Every method of the handle on datasets as they are opened, and the faults that opening once had."""

from __future__ import annotations

import json
import random
import zipfile
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.dataset import Dataset
from lumenframe.operators import raster
from lumenframe.sources import coco, rle
from tests.test_sources import TASKS, png


def yolo_root(root, task):
    for i, split in enumerate(("train", "train", "val", "val", "test")):
        png(root / split / "images" / "deep" / f"i{i}.png", 40, 20, 50 + i)
        if i != 1:
            (root / split / "labels" / "deep").mkdir(exist_ok=True, parents=True)
            (root / split / "labels" / "deep" / f"i{i}.txt").write_text(TASKS[task])
    png(root / "val" / "images" / "deep" / "i0.png", 40, 20, 9)  # the same name in another split
    names = "names: [a, b]\n" + ("kpt_shape: [2, 3]\n" if task == "pose" else "") + ("radii: {0: 4.0, 1: 4.0}\n" if task == "polo" else "")
    (root / "set.yaml").write_text("train: train/images\nval: val/images\ntest: test/images\n" + names)
    return root


def coco_root(root, task="segment"):
    for split, number in (("train", 3), ("val", 2)):
        images, notes = [], []
        for i in range(1, number + 1):
            png(root / split / "images" / f"{split}{i}.png", 40, 20, 10 * i)
            images.append({"id": i, "file_name": f"{split}{i}.png", "width": 40, "height": 20})
            extra = {"segmentation": [[1, 1, 9, 1, 9, 9], [20, 2, 30, 2, 30, 12]]} if task == "segment" else {"keypoints": [1, 2, 2, 0, 0, 0]} if task == "pose" else {}
            notes.append({"id": i, "image_id": i, "category_id": 7 if i % 2 else 3, "bbox": [i, i, 8 + i, 8], **extra})
        (root / f"{split}.json").write_text(json.dumps({"images": images, "annotations": notes, "categories": [{"id": 7, "name": "a"}, {"id": 3, "name": "b"}]}))
    return root


def opened(spark, tmp_path, kind):
    what, _, task = kind.partition("-")
    if what == "yolo":
        return Dataset.open(spark, str(yolo_root(tmp_path / "set", task)))
    if what == "flat":
        root = yolo_root(tmp_path / "set", "detect")
        (root / "set.yaml").unlink()
        return Dataset.open(spark, str(root))
    if what == "coco":
        return Dataset.open(spark, str(coco_root(tmp_path / "set", task)))
    Dataset.open(spark, str(yolo_root(tmp_path / "set", "detect"))).export(str(tmp_path / "parquet"))
    return Dataset.open(spark, str(tmp_path / "parquet"))


KINDS = [*(f"yolo-{t}" for t in TASKS), "flat", "coco-detect", "coco-segment", "coco-pose", "parquet"]


def whole(ds):
    """No annotation without its image, no id twice."""
    images = [r[0] for r in ds.samples.select("image_id").collect()]
    notes = [r[0] for r in ds.annotations.select("image_id").collect()]
    assert set(notes) <= set(images) and len(set(images)) == len(images)
    return len(images), len(notes)


@pytest.mark.parametrize("kind", KINDS)
def test_every_method(spark, light, tmp_path, kind):
    ds = opened(spark, tmp_path, kind)
    ds = replace(ds, samples=ds.samples.cache(), annotations=ds.annotations.cache(), classes=ds.classes.cache())
    first, second = (r["name"] for r in ds.classes.orderBy("class_id").collect())
    n, a = whole(ds)
    assert n == (5 if kind.startswith("coco") else 6) and a > 0
    assert {r["relative_path"].split("/")[0] for r in ds.samples.collect()} & {"train", "val", "images"} == set()
    assert ds.audit().isEmpty() and ds.summary().where("split = 'all'").first()["images"] == n and ds.class_summary().count() == 2
    assert sum(r["images"] for r in ds.compare(ds)["overview"].collect()) == n == ds.compare(ds)["images"].where("status = 'unchanged'").count()
    assert whole(ds.sample(3, seed=2))[0] == 3 and whole(ds.filter(gt_annotated=True, splits=["train"]))[1] > 0
    split = ds.split({"train": 1, "test": 1}, seed=7)
    assert whole(split) == (n, a) and {r[0] for r in split.samples.select("split").distinct().collect()} == {"train", "test"}
    assert whole(ds.move_n_groups(1, "train", "val", 3)) == (n, a)
    moved = ds.move_images_with_classes([first, second], "test")
    assert whole(moved) == (n, a) and moved.samples.join(moved.annotations, "image_id", "left_semi").where("split <> 'test'").isEmpty()
    moves = ds.compare(moved)["images"].where("status = 'moved'").count()
    assert moves > 0
    assert whole(ds.rebalance_empty(0.4)) <= (n, a) and whole(ds.grouped(lambda p: p[:1]).split({"train": 1}))[0] == n
    assert whole(ds.add(ds)) == (n, a) and whole(ds.filter(splits=["train"]).add(ds)) == (n, a)
    gone = ds.remove_classes([second], merge_into=first).rename_classes({first: "c"})
    assert whole(gone) == (n, a) and [r["name"] for r in gone.classes.collect()] == ["c"]
    assert whole(ds.tile(20, 0.0))[0] == 2 * n and whole(ds.tile(20, mode="coverage", lossy=True))[0] >= 1
    assert whole(ds.augment(1, seed=3))[0] > n
    done = ds.export_formats(str(tmp_path / "labels"), str(tmp_path / "masks") if "polygon" in ds.annotations.columns else None)
    assert done["yolo"]["files"] == 2 * n
    again = Dataset.open(spark, str(tmp_path / "labels"), task={"coco-segment": "segment"}.get(kind)) if "pose" not in kind else None
    if again:
        assert whole(again) == (n, a)
    if "polygon" in ds.annotations.columns:
        assert done["masks"]["files"] == n
    rows = ds.export(str(tmp_path / "out"))
    assert whole(Dataset.open(spark, str(tmp_path / "out"))) == (rows["samples"], rows["annotations"]) == (n, a)


def test_files_do_not_share_ids(spark, tmp_path):
    ds = Dataset.open(spark, str(coco_root(tmp_path / "set", "detect")))
    assert ds.summary().where("split = 'all'").first()["annotations"] == 5
    ds.export_yolo(str(tmp_path / "out"))
    for split, number in (("train", 3), ("val", 2)):
        for i in range(1, number + 1):
            lines = (tmp_path / "out" / split / "labels" / f"{split}{i}.txt").read_text().splitlines()
            assert len(lines) == 1 and float(lines[0].split()[3]) == pytest.approx((8 + i) / 40, abs=1e-6)


def test_coco_sets_bad_records_aside(spark, tmp_path):
    root = tmp_path / "set"
    png(root / "images" / "one.png", 100, 80)
    mask = {"size": [80, 100], "counts": [5, 3, 80 * 100 - 8]}
    notes = [
        {"id": 11, "image_id": 1, "category_id": 4, "bbox": [10, 10, 20, 30]}, {"id": 12, "image_id": 1, "category_id": 4, "bbox": ["bad", 10, 20, 30]}, {"id": 13, "image_id": 99, "category_id": 4, "bbox": [1, 1, 2, 3]},
        {"id": 11, "image_id": 1, "category_id": 4, "bbox": [1, 1, 2, 3]}, {"id": 14, "image_id": 1, "category_id": 4, "bbox": [1, 1, 0, 3]}, {"id": 15, "image_id": 1, "category_id": 9, "bbox": [1, 1, 2, 3]},
        {"id": 16, "image_id": 1, "category_id": 4, "bbox": [1, 1, 2, 3], "segmentation": {**mask, "size": [80, 99]}}, {"id": 17, "image_id": 1, "category_id": 4, "bbox": [1, 1, 2, 3], "segmentation": {**mask, "counts": [8001]}},
        {"id": 18, "image_id": 1, "category_id": 4, "segmentation": mask}, {"id": 19, "image_id": 2, "category_id": 4, "bbox": [1, 1, 2, 3]}, {"id": 20, "image_id": 1, "category_id": 4}, {"id": 21, "image_id": 1, "category_id": 4, "bbox": [1, 1, 2, 3], "keypoints": [1, 2]},
    ]
    images = [{"id": 1, "file_name": "one.png", "width": 100, "height": 80}, {"id": 2, "file_name": "missing.png", "width": 100, "height": 80}, {"id": 1, "file_name": "again.png", "width": 1, "height": 1}, {"id": 3, "file_name": "flat.png", "width": 0, "height": 1}]
    (root / "notes.json").write_text(json.dumps({"images": images, "annotations": notes, "categories": [{"id": 4, "name": "apple"}]}))
    with pytest.raises(ValueError, match="bad records"):
        Dataset.open(spark, str(root))
    ds = Dataset.open(spark, str(root / "notes.json"), errors="skip", task="detect")
    assert [(r["x1"], r["x2"]) for r in ds.annotations.collect()] == [(10.0, 30.0)] and ds.samples.count() == 1
    found = sorted((r["id"], r["category"]) for r in ds.issues.collect())
    assert found == [(1, "duplicate image id"), (2, "missing image"), (3, "image record"), (11, "duplicate annotation id"), (12, "box"), (13, "dangling image"), (14, "box"), (15, "dangling category"), (16, "mask size"), (17, "mask"), (19, "dangling image"), (20, "no geometry"), (21, "keypoints")]
    both = Dataset.open(spark, str(root), errors="skip", task="segment")
    assert [[tuple(q) for q in r["runs"]] for r in both.annotations.collect()] == [[(5, 0, 1), (6, 0, 1), (7, 0, 1)]]
    with pytest.raises(ValueError, match="polygons"):
        both.tile(20)
    assert both.export_masks(str(tmp_path / "masks"))["files"] == 1


def test_coco_refuses_one_path_twice(spark, tmp_path):
    root = tmp_path / "set"
    for folder in ("train/images", "images/train"):
        png(root / folder / "one.png", 10, 10)
    images = [{"id": 1, "file_name": "train/images/one.png", "width": 10, "height": 10}, {"id": 2, "file_name": "images/train/one.png", "width": 10, "height": 10}]
    (root / "a.json").write_text(json.dumps({"images": images, "annotations": [], "categories": []}))
    with pytest.raises(ValueError, match="one path"):
        Dataset.open(spark, str(root), errors="skip")
    other = {"images": [], "annotations": []}
    (tmp_path / "x.json").write_text(json.dumps(other | {"categories": [{"id": 1, "name": "a"}]}))
    (tmp_path / "y.json").write_text(json.dumps(other | {"categories": [{"id": 1, "name": "b"}]}))
    with pytest.raises(ValueError, match="differently"):
        coco.read(spark, [str(tmp_path / "x.json"), str(tmp_path / "y.json")])


def test_add_keeps_each_sides_annotations(spark):
    frame = lambda rows: spark.createDataFrame(rows, "image_id long, relative_path string, split string, group_key string, width int, height int")
    notes = lambda rows: spark.createDataFrame(rows, "image_id long, ann_idx int, class_id int, x1 double, y1 double, x2 double, y2 double")
    classes = spark.createDataFrame([(0, "a")], "class_id int, name string")
    ours = Dataset(frame([(1, "p", "train", "g", 9, 9)]), notes([(1, 0, 0, 1.0, 1.0, 2.0, 2.0)]), classes)
    same_path = Dataset(frame([(2, "p", "train", "g", 9, 9)]), notes([(2, 0, 0, 3.0, 3.0, 4.0, 4.0)]), classes)
    same_id = Dataset(frame([(1, "q", "train", "h", 9, 9)]), notes([(1, 0, 0, 5.0, 5.0, 6.0, 6.0)]), classes)
    out = ours.add(same_path)
    assert whole(out) == (1, 1) and out.annotations.first()["x1"] == 1.0
    out = ours.add(same_id)
    assert whole(out) == (2, 2)
    assert {r["relative_path"]: r["x1"] for r in out.samples.join(out.annotations, "image_id").collect()} == {"p": 1.0, "q": 5.0}
    with pytest.raises(ValueError, match="classes"):
        ours.add(Dataset(ours.samples, ours.annotations, classes.withColumn("name", F.lit("b"))))


def test_archive_and_explicit_metadata(spark, tmp_path):
    root = yolo_root(tmp_path / "set", "detect")
    with zipfile.ZipFile(tmp_path / "set.zip", "w") as z:
        for p in root.rglob("*"):
            if p.is_file():
                z.write(p, f"set/{p.relative_to(root)}")
    want = sorted((r["split"], r["relative_path"]) for r in Dataset.open(spark, str(root / "set.yaml")).samples.collect())
    assert sorted((r["split"], r["relative_path"]) for r in Dataset.open(spark, str(tmp_path / "set.zip")).samples.collect()) == want
    assert ("val", "deep/i0.png") in want and ("train", "deep/i0.png") in want


# --- run-length masks ---------------------------------------------------------


def slow_counts(mask):
    flat = mask.T.ravel()
    out, value, n = [], False, 0
    for v in flat:
        if v != value:
            out.append(n)
            value, n = v, 0
        n += 1
    return [*out, n]


def test_rle_round_trip():
    rng = np.random.default_rng(4)
    for density in (0.0, 0.02, 0.5, 0.98, 1.0):
        for w, h in ((1, 1), (7, 5), (3, 40), (60, 50)):
            mask = rng.random((h, w)) < density
            counts = slow_counts(mask)
            assert rle.encode(raster.runs_of(mask), w, h).tolist() == counts
            assert (raster.mask_of(rle.decode(np.array(counts), w, h), w, h) == mask).all()
            assert rle.counts_of(rle.text_of(np.array(counts))).tolist() == counts
    big = np.array([0, 5_000_000, 3, 1, 70_000, 2])
    assert rle.counts_of(rle.text_of(big)).tolist() == big.tolist()


def test_rle_known_strings():
    # Plain digits: 48 + count; six bits with sign and continuation beyond.
    assert rle.text_of(np.array([0, 4, 2])) == "042" and rle.counts_of("042").tolist() == [0, 4, 2]
    assert rle.text_of(np.array([16])) == "`0" and rle.counts_of("`0").tolist() == [16]
    assert rle.text_of(np.array([3, 5, 6, 4])) == "356O" and rle.counts_of("356O").tolist() == [3, 5, 6, 4]
    for bad in ("`", "\x1f", "O", "p" * 20 + "0"):
        with pytest.raises(ValueError):
            rle.counts_of(bad)


def test_rle_columns(spark):
    rng = random.Random(2)
    boxes = [(i, x := rng.randrange(20), y := rng.randrange(10), x + 1 + rng.randrange(12), y + 1 + rng.randrange(10)) for i in range(40)]
    df = spark.createDataFrame([*boxes, (98, 0, 0, 32, 20), (99, None, None, None, None)], "image_id long, x1 int, y1 int, x2 int, y2 int").withColumns({"width": F.lit(32), "height": F.lit(20)})
    plain = df.withColumn("rle", F.when(F.col("x1").isNotNull(), F.to_json(F.struct(F.array("height", "width").alias("size"), rle.of_box(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height"))).alias("counts")))))
    found = rle.decoded(plain)
    assert found.where("problem is not null").isEmpty() and found.where("image_id = 99").first()["runs"] is None
    for r in found.where("image_id < 99").collect():
        assert [tuple(q) for q in r["runs"]] == [(y, r["x1"], r["x2"]) for y in range(r["y1"], r["y2"])]
    again = rle.decoded(rle.encoded(found.drop("rle", "problem")).withColumnRenamed("runs", "before"))
    assert again.where("not (runs <=> before)").isEmpty() and again.where("problem is not null").isEmpty()


def test_rle_of_many_masks_at_once_as_one_by_one():
    rng = np.random.default_rng(6)
    masks = [rng.random(rng.integers(1, 12, 2)) < rng.choice([0, 0.1, 0.5, 0.9, 1]) for _ in range(200)]
    runs = [raster.runs_of(m) for m in masks]
    height, width = (np.array([m.shape[i] for m in masks]) for i in (0, 1))
    counts, sizes = rle.encode_all(np.concatenate(runs), np.array([len(r) for r in runs]), width, height)
    cut = np.split(counts, np.cumsum(sizes)[:-1])
    assert [c.tolist() for c in cut] == [slow_counts(m) for m in masks]
    drawn, lengths, out = rle.decode_all(counts, sizes, width, height)
    assert not out.any() and (lengths == [len(r) for r in runs]).all() and (drawn == np.concatenate(runs)).all()
    # Broken ones among them change no other's.
    texts = [t.encode() for t in rle.all_texts(counts, sizes)]
    texts[3], texts[50], texts[120] = b"`", b"\x1f0", b"p" * 20 + b"0"
    again, sizes, bad = rle.all_counts(texts)
    assert np.flatnonzero(bad).tolist() == [3, 50, 120]
    assert (again == np.concatenate([c for i, c in enumerate(cut) if not bad[i]])).all()
    broken = rle.decode_all(np.array([1, 2, -1, 3, 1 << 62, 1 << 62, 1, 2, 0, 1]), np.array([4, 2, 4]), np.array([2] * 3), np.array([2] * 3))
    assert broken[2].tolist() == [True, True, False] and broken[0].tolist() == [[0, 1, 2], [1, 0, 2]]
