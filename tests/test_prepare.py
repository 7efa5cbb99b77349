"""Training layouts: what is written, and what is left alone."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lumenframe.dataset import Dataset
from lumenframe.sources import prepare
from tests.test_sources import png


def root_with(tmp_path, n=4):
    root = tmp_path / "set"
    for i in range(n):
        split = "val" if i == n - 1 else "train"
        png(root / split / "images" / f"Im {i}.png", 20, 10, 40 + i)
        (root / split / "labels").mkdir(exist_ok=True)
        (root / split / "labels" / f"Im {i}.txt").write_text("" if i == 1 else "0 0.1 0.1 0.6 0.1 0.6 0.8\n")
    (root / "data.yaml").write_text("train: train/images\nval: val/images\nnames: [a]\n")
    return root


def listing(out):
    return {str(p.relative_to(out)): p.stat().st_mtime_ns for p in out.rglob("*") if p.is_file() and prepare.STATE not in str(p)}


@pytest.mark.parametrize("kind", prepare.KINDS)
def test_only_changes_are_written(spark, light, tmp_path, kind):
    root, out = root_with(tmp_path), tmp_path / "out"
    open_ = lambda: Dataset.open(spark, str(root), task="segment")
    first = open_().prepare(kind, str(out))
    before = listing(out)
    assert first.written == 9 == len(before) and first.records.count() == 4
    again = open_().prepare(kind, str(out))
    assert (again.written, again.deleted, again.identity) == (0, 0, first.identity) and listing(out) == before
    png(root / "train" / "images" / "Im 2.png", 20, 10, 99)
    changed = open_().prepare(kind, str(out))
    after = listing(out)
    moved = {p for p in after if after[p] != before.get(p)}
    assert changed.written == 2 and changed.identity != first.identity and set(after) == set(before)
    assert len(moved) == 2 and all("im-2" in p for p in moved)
    image = next(p for p in moved if "images" in p)
    assert (out / image).read_bytes() == (root / "train" / "images" / "Im 2.png").read_bytes()
    (root / "train" / "labels" / "Im 0.txt").write_text("0 0.2 0.2 0.6 0.1 0.6 0.8\n")
    (root / "val" / "images" / "Im 3.png").rename(root / "train" / "images" / "Im 3.png")
    (root / "val" / "labels" / "Im 3.txt").rename(root / "train" / "labels" / "Im 3.txt")
    third = open_().prepare(kind, str(out))
    assert third.deleted == 2 and third.written in (4, 5) and sum("im-3" in p for p in listing(out)) == 2
    if kind == "nnunet":
        assert json.loads((out / "dataset.json").read_text())["numTraining"] == 4
    # A call that broke off before its table was replaced is made good.
    png(root / "train" / "images" / "Im 1.png", 20, 10, 7)
    next(p for p in out.rglob("*im-1*.png") if "images" in str(p)).unlink()
    assert open_().prepare(kind, str(out)).written >= 2 and any("im-1" in p for p in listing(out))


def test_labels_and_masks(spark, light, tmp_path):
    root = root_with(tmp_path)
    ds = Dataset.open(spark, str(root), task="segment")
    ds.prepare("yolo-seg", str(tmp_path / "seg"))
    texts = {p.name[:10]: p.read_text() for p in (tmp_path / "seg").rglob("*.txt")}
    assert texts["train_im-1"] == "" and len(texts["train_im-0"].split()) == 7 and (tmp_path / "seg" / "valid" / "labels").is_dir()
    ds.prepare("yolo-sem", str(tmp_path / "sem"))
    found = {r["mask"].rsplit("/", 1)[-1][:10]: r for r in prepare.mapped_masks(spark, str(tmp_path / "sem" / "train" / "labels")).collect()}
    assert found["train_im-1"]["foreground"] == 0 and 30 < found["train_im-0"]["foreground"] < 60 and found["train_im-0"]["problem"] is None
    with pytest.raises(ValueError, match="exceed"):
        ds.prepare("yolo-sem", str(tmp_path / "big"), max_size=(10, 10))
    none = ds.prepare("yolo-sem", str(tmp_path / "big"), max_size=(10, 10), errors="skip")
    assert none.skipped.count() == 4 and none.records.count() == 0
    with pytest.raises(ValueError, match="exported"):
        ds.rename_classes({"a": "b"}).prepare("yolo-seg", str(tmp_path / "x"))
    with pytest.raises(ValueError, match="whole image"):
        prepare.prepare(spark, str(tmp_path / "x"), ds.samples.withColumn("crop", F.lit(1)), ds.annotations, ds.classes, "yolo-seg")


def test_mask_files(spark, light, tmp_path):
    root, masks = root_with(tmp_path), tmp_path / "masks"
    ds = Dataset.open(spark, str(root), task="segment")
    rows = []
    for r in ds.samples.collect():
        name = r["relative_path"]
        png(masks / name, 20, 10, 255 if "0" in name else 1 if "1" in name else 0)
        rows.append((r["image_id"], str(masks / name)))
    side = spark.createDataFrame(rows, "image_id long, mask string")
    made = ds.prepare("nnunet", str(tmp_path / "out"), masks=side)
    assert made.written == 9
    found = {p: r["foreground"] for r in prepare.mapped_masks(spark, str(tmp_path / "out" / "labelsTr")).collect() for p in ("0", "1", "2", "3") if f"im-{p}" in r["mask"]}
    assert found == {"0": 200, "1": 200, "2": 0, "3": 0}
    assert ds.prepare("nnunet", str(tmp_path / "out"), masks=side).written == 0
    png(masks / "Im 2.png", 20, 10, 7)
    with pytest.raises(Exception, match="mask values"):
        ds.prepare("nnunet", str(tmp_path / "out"), masks=side)
    png(masks / "Im 2.png", 21, 10, 1)
    with pytest.raises(Exception, match="mask size"):
        ds.prepare("nnunet", str(tmp_path / "out"), masks=side)
    with pytest.raises(ValueError, match="not there"):
        ds.prepare("nnunet", str(tmp_path / "out"), masks=side.limit(3))
