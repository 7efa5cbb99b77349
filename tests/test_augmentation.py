"""Geometric copies against numpy, their inverses and their records."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.dataset import Dataset
from lumenframe.functions import projective as P
from lumenframe.operators import augmentation
from lumenframe.operators.augmentation import Transform
from lumenframe.plans import registry

ALL = [Transform("rotate", -40, 40), Transform("scale", 0.7, 1.4), Transform("shear_x", -15, 15), Transform("shear_y", -10, 10), Transform("shift_x", -0.1, 0.1), Transform("shift_y", -0.1, 0.1), Transform("flip_x", p=0.5), Transform("flip_y", p=0.5), Transform("perspective_x", -0.3, 0.3), Transform("perspective_y", -0.2, 0.2, 0.5)]


def slow_matrix(replay, w, h):
    m = np.eye(3)
    for t in replay:
        v, k = t["value"], t["kind"]
        c, s, tan = np.cos(np.radians(v)), np.sin(np.radians(v)), np.tan(np.radians(v))
        own = {"rotate": [[c, -s, 0], [s, c, 0], [0, 0, 1]], "scale": [[v, 0, 0], [0, v, 0], [0, 0, 1]], "shear_x": [[1, tan, 0], [0, 1, 0], [0, 0, 1]], "shear_y": [[1, 0, 0], [tan, 1, 0], [0, 0, 1]], "shift_x": [[1, 0, v * w], [0, 1, 0], [0, 0, 1]], "shift_y": [[1, 0, 0], [0, 1, v * h], [0, 0, 1]], "flip_x": [[-1, 0, 0], [0, 1, 0], [0, 0, 1]], "flip_y": [[1, 0, 0], [0, -1, 0], [0, 0, 1]], "perspective_x": [[1, 0, 0], [0, 1, 0], [2 * v / w, 0, 1]], "perspective_y": [[1, 0, 0], [0, 1, 0], [0, 2 * v / h, 1]]}[k]
        to = np.array([[1, 0, -w / 2], [0, 1, -h / 2], [0, 0, 1]])
        m = np.linalg.inv(to) @ np.array(own, float) @ to @ m
    return m


def image(m, x, y):
    a = m @ np.array([x, y, 1.0])
    return a[:2] / a[2]


@pytest.fixture(scope="module")
def made(spark):
    samples = spark.createDataFrame([(i, f"p{i}", "train", 200, 100) for i in range(20)], "image_id long, relative_path string, split string, width int, height int")
    return augmentation.copies(samples, 2, ALL, seed=5).cache()


def test_matrices_and_records(made):
    rows = made.collect()
    assert len(rows) == 60 and len({r["image_id"] for r in rows}) == 60
    for r in rows:
        assert (r["copy"] > 0) == (len(r["replay"]) > 0)
        assert np.allclose(np.array(r["matrix"]).reshape(3, 3), slow_matrix(r["replay"], 200, 100), atol=1e-9)
        bounds = {t.kind: (t.low, t.high) for t in ALL}
        assert all(bounds[t["kind"]][0] <= t["value"] <= bounds[t["kind"]][1] for t in r["replay"])
    flips = sum(any(t["kind"] == "flip_x" for t in r["replay"]) for r in rows if r["copy"] > 0)
    assert 10 <= flips <= 30
    back = made.select(P.product(P.inverse(F.col("matrix")), F.col("matrix")).alias("i")).collect()
    assert all(np.allclose(r["i"], np.eye(3).ravel(), atol=1e-9) for r in back)
    again = augmentation.replayed(made.drop("matrix").withColumnRenamed("image_id", "i").repartition(3))
    assert {r["i"]: r["matrix"] for r in again.collect()} == {r["image_id"]: r["matrix"] for r in rows}


def test_geometry_moves_and_returns(spark, made):
    rng = random.Random(1)
    ids = {r["image_id"]: np.array(r["matrix"]).reshape(3, 3) for r in made.collect()}
    rows = []
    for i in ids:
        x, y = rng.uniform(90, 110), rng.uniform(45, 55)
        rows.append((i, 0, 0, x - 6, y - 4, x + 6, y + 4, [(x, y, 2.0), (x + 3, y, 0.0), (900.0, 900.0, 1.0)]))
    df = spark.createDataFrame(rows, "image_id long, ann_idx int, class_id int, x1 double, y1 double, x2 double, y2 double, keypoints array<struct<x:double,y:double,v:double>>")
    got = {r["image_id"]: r for r in augmentation.transformed(df, made).collect()}
    assert len(got) == len(rows)
    for i, _, _, x1, y1, x2, y2, k in rows:
        corners = np.array([image(ids[i], x, y) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))])
        low, high = np.clip(corners.min(0), 0, [200, 100]), np.clip(corners.max(0), 0, [200, 100])
        r = got[i]
        assert np.allclose([r["x1"], r["y1"], r["x2"], r["y2"]], [*low, *high], atol=1e-8)
        assert np.allclose([r["keypoints"][0]["x"], r["keypoints"][0]["y"]], image(ids[i], *k[0][:2]), atol=1e-8)
        assert tuple(r["keypoints"][1]) == (0.0, 0.0, 0.0)
    shapes = spark.createDataFrame([(i, 0, 0, [(95.0, 45.0), (108.0, 47.0), (101.0, 56.0)]) for i in ids], "image_id long, ann_idx int, class_id int, polygon array<struct<x:double,y:double>>")
    there = augmentation.transformed(shapes, made)
    for r in augmentation.undone(there, made).collect():
        start = [(95.0, 45.0), (108.0, 47.0), (101.0, 56.0)]
        found = [(q["x"], q["y"]) for q in r["polygon"]]
        assert all(min(abs(a - c) + abs(b - d) for c, d in found) < 1e-6 for a, b in start)
    circles = spark.createDataFrame([(i, 0, 0, 100.0, 50.0, 3.0) for i in ids], "image_id long, ann_idx int, class_id int, px double, py double, radius double")
    for r in augmentation.transformed(circles, made).collect():
        m, e = ids[r["image_id"]], 1e-4
        dx, dy = (image(m, 100 + e, 50) - image(m, 100 - e, 50)) / (2 * e), (image(m, 100, 50 + e) - image(m, 100, 50 - e)) / (2 * e)
        assert r["radius"] == pytest.approx(3 * abs(dx[0] * dy[1] - dx[1] * dy[0]) ** 0.5, rel=1e-5)


def test_visibility_and_horizon(spark):
    samples = spark.createDataFrame([(1, 100, 100, [1.0, 0.0, 60.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]), (2, 100, 100, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, -0.02, 0.0, 1.0])], "image_id long, width int, height int, matrix array<double>")
    boxes = spark.createDataFrame([(1, 0, 0, 20.0, 0.0, 60.0, 10.0), (1, 1, 0, 35.0, 0.0, 45.0, 10.0), (1, 2, 0, 50.0, 0.0, 60.0, 10.0), (2, 0, 0, 10.0, 0.0, 20.0, 10.0), (2, 1, 0, 40.0, 0.0, 60.0, 10.0)], "image_id long, ann_idx int, class_id int, x1 double, y1 double, x2 double, y2 double")
    seen = lambda v: {(r["image_id"], r["ann_idx"]) for r in augmentation.transformed(boxes, samples, v).collect()}
    assert seen(0.0) == {(1, 0), (1, 1), (2, 0)} and seen(0.5) == {(1, 0), (1, 1), (2, 0)} and seen(0.51) == {(2, 0)}
    with pytest.raises(Exception, match="inverse"):
        augmentation.undone(boxes, samples.withColumn("matrix", F.array(*[F.lit(0.0)] * 9))).collect()
    for bad in (("spin",), ("scale", 0.0, 1.0), ("rotate", 2.0, 1.0), ("perspective_x", 0.0, 1.0), ("shear_x", -90.0, 0.0), ("flip_x", 0.0, 0.0, 2.0)):
        with pytest.raises(ValueError):
            Transform(*bad)


def test_dataset_augment(spark):
    samples = spark.createDataFrame([(i, f"p{i}", s, "g", 100, 100) for i, s in ((1, "train"), (2, "val"))], "image_id long, relative_path string, split string, group_key string, width int, height int")
    notes = spark.createDataFrame([(1, 0, 0, 40.0, 40.0, 60.0, 60.0), (2, 0, 0, -5.0, 0.0, 10.0, 10.0)], "image_id long, ann_idx int, class_id int, x1 double, y1 double, x2 double, y2 double")
    ds = Dataset(samples, notes, spark.createDataFrame([(0, "a")], "class_id int, name string"))
    out = ds.augment(3, seed=1, transforms=[Transform("rotate", 90, 90), Transform("shift_x", 0.2, 0.2)])
    assert out.samples.count() == 5 and out.annotations.count() == 5
    turned = out.samples.where("copy > 0").join(out.annotations, "image_id").select("x1", "y1", "x2", "y2").collect()
    assert all(np.allclose(r, (60, 40, 80, 60)) for r in turned)
    assert out.annotations.where("x1 < 0").count() == 1 and "rotate" in str(out.samples.where("copy = 1").first()["replay"])


def test_matrices_and_corners_are_worked_out_once(spark):
    plan = registry.QUERIES["augment_affine"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # The only product of matrices is where a copy gets its own; filters name plain columns.
    assert sum("aggregate(" in line for line in plan.splitlines()) == 1
    assert not any("transform(" in line or "aggregate(" in line for line in plan.splitlines() if line.lstrip(" :+-").startswith(("Filter", "Join")))
