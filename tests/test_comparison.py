"""Model comparison, polygons, Dice matching, calibration from maps, masks and trainability against brute force."""

from __future__ import annotations

import itertools
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.dataset import Dataset
from lumenframe.operators import comparison, matching, polygons, raster, selection
from lumenframe.sources import sinks
from tests.test_operators import slow_averaged

PRED = "model string, image_id long, pred_idx int, class_id int, x1 double, y1 double, x2 double, y2 double, score double"
TRUTH = "image_id long, ann_idx int, class_id int, x1 double, y1 double, x2 double, y2 double"


def iou(g, p):
    inter = max(0.0, min(g[2], p[2]) - max(g[0], p[0])) * max(0.0, min(g[3], p[3]) - max(g[1], p[1]))
    return inter / ((g[2] - g[0]) * (g[3] - g[1]) + (p[2] - p[0]) * (p[3] - p[1]) - inter)


def most_pairs(truth, preds):
    """Size of the largest matching of an image, by trying all."""
    ok = [[g[2] == p[2] and iou(g[3], p[3]) >= 0.5 for p in preds] for g in truth]

    def best(i, used):
        if i == len(truth):
            return 0
        return max([best(i + 1, used), *(1 + best(i + 1, used | {j}) for j in range(len(preds)) if ok[i][j] and j not in used)])

    return best(0, frozenset())


def test_compare_models(spark):
    rng = random.Random(8)
    box = lambda x, y: (float(x), float(y), float(x + 10), float(y + 10))
    truth = [(i, k, rng.randrange(2), box(rng.randrange(14), rng.randrange(9))) for i in range(10) for k in range(3)]
    models = {m: [(i, 2 * k + h, c, box(b[0] + rng.randrange(-spread, spread + 1), b[1] + rng.randrange(-2, 3)), rng.randrange(8) / 8) for i, k, c, b in truth for h in range(2)] for m, spread in (("far", 6), ("near", 2))}
    samples = spark.createDataFrame([(i, f"g{i // 2}", f"p{i}") for i in range(12)], "image_id long, group_key string, relative_path string")
    a = spark.createDataFrame([(i, k, c, *b) for i, k, c, b in truth] + [(99, 0, 0, *box(0, 0))], TRUTH)
    p = spark.createDataFrame([(m, i, k, c, *b, s) for m, rows in models.items() for i, k, c, b, s in rows] + [("far", 99, 0, 0, *box(0, 0), 0.5)], PRED)
    known = spark.createDataFrame([("far",), ("near",), ("silent",)], "model string")
    trained = spark.createDataFrame([("near", "g0"), ("near", "g5"), ("far", "elsewhere")], "model string, group_key string")
    out = comparison.compare_models(samples, a, p, known, trained, resamples=200)
    ranks = out.ranking.orderBy("rank").collect()
    assert [r["model"] for r in ranks] == ["near", "far", "silent"] and [r["rank"] for r in ranks] == [1, 2, 3]
    for r in ranks:
        preds = models.get(r["model"], [])
        tp = sum(most_pairs([g for g in truth if g[0] == i], [q for q in preds if q[0] == i]) for i in range(12))
        assert (r["tp"], r["fp"], r["fn"]) == (tp, len(preds) - tp, len(truth) - tp)
        want = slow_averaged(truth, preds, [round(0.5 + 0.05 * i, 2) for i in range(10)], iou, False)
        assert r["map50_95"] == pytest.approx(np.mean(list(want.values())), abs=1e-6)
        assert r["ap50"] == pytest.approx(np.mean([v[0] for v in want.values()]), abs=1e-6)
    assert out.images.count() == 36
    pairs = out.pairs.collect()
    assert {(r["model_a"], r["model_b"]) for r in pairs} == {("far", "near"), ("far", "silent"), ("near", "silent")}
    assert all(r["p"] <= r["adjusted"] + 1e-6 <= 1.000002 for r in pairs)
    assert sorted(tuple(r) for r in out.issues.collect()) == [("far", "outside the cohort", 1), ("near", "trained on", 2)]
    empty = comparison.compare_models(samples, a.limit(0), p.limit(0), known)
    assert {(r["model"], r["tp"], r["fp"], r["fn"]) for r in empty.ranking.collect()} == {(m, 0, 0, 0) for m in ("far", "near", "silent")}


def inside(poly, x, y):
    """Even-odd test of points."""
    odd = np.zeros(x.shape, bool)
    for (x0, y0), (x1, y1) in zip(poly, np.roll(poly, -1, axis=0), strict=True):
        if y0 != y1:
            odd ^= (min(y0, y1) <= y) & (y < max(y0, y1)) & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))
    return odd


def test_polygon_areas_against_a_fine_grid():
    rng = np.random.default_rng(2)
    y, x = (np.mgrid[:600, :600] + 0.5) / 60

    def star(n):
        at = np.sort(rng.uniform(0, 2 * np.pi, n))
        far = rng.uniform(0.5, 3.5, n)
        return np.column_stack([np.cos(at) * far, np.sin(at) * far]) + rng.uniform(3.5, 6.5, 2)

    for _ in range(25):
        first, parts = star(rng.integers(3, 9)), [star(rng.integers(3, 9)) for _ in range(rng.integers(1, 4))]
        a, b = inside(first, x, y), np.any([inside(p, x, y) for p in parts], axis=0)
        shapes = [first, *parts]
        edges = np.concatenate([np.column_stack([q, np.roll(q, -1, axis=0)]) for q in shapes])
        (inter,), (union,) = polygons.shared_areas(edges, np.zeros(len(edges), int), np.repeat(np.arange(len(shapes)), [len(q) for q in shapes]), 1)
        assert inter == pytest.approx((a & b).sum() / 3600, abs=0.06) and union == pytest.approx((a | b).sum() / 3600, abs=0.08)


def test_many_pairs_of_polygons_are_swept_at_once():
    rng = np.random.default_rng(7)
    whole, owner, part = [], [], []
    for i in range(60):
        for k in range(1 + int(rng.integers(1, 90 if i % 20 == 0 else 4))):
            xy = rng.integers(0, 8, (int(rng.integers(3, 8)), 2)).astype(float) + (0.0 if i % 3 else rng.uniform(0, 1))
            whole.append(np.column_stack([xy, np.roll(xy, -1, axis=0)]))
            owner.append(np.full(len(xy), i))
            part.append(np.full(len(xy), k))
    edges, owner, part = np.concatenate(whole), np.concatenate(owner), np.concatenate(part)
    inter, union = polygons.shared_areas(edges, owner, part, 60)
    y, x = (np.mgrid[:400, :400] + 0.5) / 400 * 9
    for i in range(0, 60, 5):
        held = [inside(edges[(owner == i) & (part == k), :2], x, y) for k in range(part[owner == i].max() + 1)]
        a, b = held[0], np.any(held[1:], axis=0)
        cell = (9 / 400) ** 2
        assert inter[i] == pytest.approx((a & b).sum() * cell, abs=0.25) and union[i] == pytest.approx((a | b).sum() * cell, abs=0.25)


def test_the_sweep_of_polygons_skips_level_edges_and_pairs_apart(monkeypatch):
    square = [{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}, {"x": 2.0, "y": 2.0}, {"x": 0.0, "y": 2.0}]
    moved = lambda d: [{"x": p["x"] + d, "y": p["y"]} for p in square]
    seen, sweep = [], polygons._swept
    monkeypatch.setattr(polygons, "_swept", lambda e, p: seen.append(int(np.isfinite(e).all(2).sum())) or sweep(e, p))
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    got = polygons.ious(pa.array([square, square, square], kind), pa.array([[moved(1.0)], [moved(2.0)], [moved(9.0)]], pa.list_(kind)))
    assert got == pytest.approx([1 / 3, 0.0, 0.0]) and seen == [4]


def test_polygon_iou_of_broken_ones(spark):
    square = [{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}, {"x": 2.0, "y": 2.0}, {"x": 0.0, "y": 2.0}]
    right = [{"x": p["x"] + 1, "y": p["y"]} for p in square]
    lost = [{"x": None, "y": 0.0}, *square[:3]]
    cases = [(square, [square], 1.0), (square, [right], 1 / 3), (square, [right, square], 2 / 3), (square, [], 0.0), (None, [square], 0.0), (square, None, 0.0), (square[:2], [square], 0.0), (lost, [square], 0.0), (square, [None], 0.0)]
    cases += [(square, [[{"x": p["x"] + 5, "y": p["y"]} for p in square]], 0.0), ([{"x": float("nan"), "y": 1.0}, *square[:2]], [square], 0.0)]
    kind = "array<struct<x:double,y:double>>"
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, a {kind}, b array<{kind}>")
    got = {r["i"]: r["v"] for r in rows.select("i", polygons.polygon_iou("a", "b").alias("v")).collect()}
    assert all(got[i] == pytest.approx(w) for i, (_, _, w) in enumerate(cases))
    assert rows.limit(0).select(polygons.polygon_iou("a", "b")).count() == 0


def test_dice_matching_has_the_largest_total(spark):
    rng = random.Random(3)
    pairs = [(i, r, p, rng.randrange(1, 9) / 8) for i in range(8) for r in range(4) for p in range(3) if rng.random() < 0.6]
    got = matching.dice_matching(spark.createDataFrame(pairs, "image_id long, ref long, pred long, dice double"), ("image_id",)).collect()
    for i in range(8):
        gain = {(r, p): d for k, r, p, d in pairs if k == i}
        best = max(sum(gain.get((r, p), 0.0) for p, r in enumerate(rs)) for rs in itertools.permutations(range(4), 3))
        mine = [(r["ref"], r["pred"]) for r in got if r["image_id"] == i]
        assert all(m in gain for m in mine) and len({r for r, _ in mine}) == len({p for _, p in mine}) == len(mine)
        assert sum(gain[m] for m in mine) == pytest.approx(best)


def test_component_dice_keeps_classes_apart(spark):
    kind = "image_id long, class_id int, component long, y int, x0 int, x1 int"
    ref = spark.createDataFrame([(1, 0, 0, 0, 0, 4), (1, 0, 0, 1, 0, 4), (1, 1, 0, 5, 0, 3)], kind)
    pred = spark.createDataFrame([(1, 0, 7, 1, 2, 6), (1, 0, 8, 5, 0, 3)], kind)
    got = matching.component_dice(ref, pred, ("image_id", "class_id"), raster.run_overlap).collect()
    assert [(r["class_id"], r["ref"], r["pred"], r["dice"]) for r in got] == [(0, 0, 7, pytest.approx(2 * 2 / 12))]


def test_threshold_counts_of_odd_scores(spark):
    rows = [("m", "g", 1, s, t) for s, t in ((0.5, True), (0.25, False), (float("nan"), True), (None, False), (0.75, None), (0.5, False))]
    pixels = spark.createDataFrame(rows, "model string, group_key string, case_id long, score double, truth boolean")
    got = {r["threshold"]: (r["tp"], r["fp"], r["fn"]) for r in comparison.threshold_counts(pixels, [0.5, 0.25, 0.5, 0.8]).collect()}
    assert got == {0.25: (1, 3, 1), 0.5: (1, 2, 1), 0.8: (0, 0, 2)}


def test_projection_joins_neighbours(spark):
    runs = spark.createDataFrame([("m", 1, 0, 0, 6, 0.6), ("m", 1, 0, 4, 9, 0.9), ("m", 1, 0, 12, 14, 0.4), ("m", 1, 1, 0, 2, 0.7)], "model string, image_id long, y int, x0 int, x1 int, score double")
    scores = comparison.score_map(runs)
    assert sorted((r["y"], r["x0"], r["x1"], r["score"]) for r in scores.collect()) == [(0, 0, 4, 0.6), (0, 4, 6, 0.9), (0, 6, 9, 0.9), (0, 12, 14, 0.4), (1, 0, 2, 0.7)]
    assert sorted((r["y"], r["x0"], r["x1"]) for r in comparison.projection(scores, 0.6).collect()) == [(0, 0, 9), (1, 0, 2)]


def test_sliced_predictions_merge(spark):
    tiles = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (1, 1, 8, 0, 18, 10)], "image_id long, tile int, x1 int, y1 int, x2 int, y2 int")
    p = spark.createDataFrame([(1, 0, "m", 0, 0, 0.8, 6.0, 1.0, 10.0, 5.0), (1, 1, "m", 0, 0, 0.6, 0.0, 1.0, 4.0, 5.0)], "image_id long, tile int, model string, pred_idx int, class_id int, score double, x1 double, y1 double, x2 double, y2 double")
    got = [(r["x1"], r["y1"], r["x2"], r["y2"], r["score"], r["members"]) for r in matching.merge_sliced(tiles, p).collect()]
    assert got == [(6.0, 1.0, 12.0, 5.0, 0.8, 2)]


def decoded(path):
    body = path.read_bytes()
    w, h = struct.unpack(">II", body[16:24])
    n = struct.unpack(">I", body[33:37])[0]
    return np.frombuffer(zlib.decompress(body[41 : 41 + n]), np.uint8).reshape(h, w + 1)[:, 1:]


def test_masks_and_formats(spark, tmp_path):
    corner = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    samples = spark.createDataFrame([(1, "a/one.jpg", "train", 12, 8), (2, "two.png", "val", 5, 4)], "image_id long, relative_path string, split string, width int, height int")
    shapes = [corner((1, 1), (6, 1), (6, 4)), corner((4, 3), (9, 3), (9, 6), (4, 6))]
    a = spark.createDataFrame([(1, k, 0, s) for k, s in enumerate(shapes)] + [(1, 2, 0, None)], "image_id long, ann_idx int, class_id int, polygon array<struct<x:double,y:double>>")
    names = spark.createDataFrame([(0, "thing")], "class_id int, name string")
    ds = Dataset(samples, a.where("polygon is not null"), names)
    out = tmp_path / "masks"
    assert ds.export_masks(str(out)) == {"files": 2}
    want = np.any([raster.fill_polygon(np.array([(p["x"], p["y"]) for p in s]), 12, 8) for s in shapes], axis=0)
    assert (decoded(out / "train" / "masks" / "0" / "a" / "one.png") == want * 255).all()
    assert decoded(out / "val" / "masks" / "0" / "two.png").shape == (4, 5) and not decoded(out / "val" / "masks" / "0" / "two.png").any()
    with pytest.raises(FileExistsError):
        ds.export_formats(yolo=str(tmp_path / "new"), masks=str(out))
    assert not (tmp_path / "new").exists()
    twice = samples.unionByName(samples.where("image_id = 2").withColumns({"image_id": F.lit(3).cast("long"), "relative_path": F.lit("TWO.jpg")}))
    with pytest.raises(ValueError, match="share a mask path"):
        sinks.write_masks(spark, str(tmp_path / "clash"), twice, a)
    assert sinks.mask_files(samples.limit(0), a).count() == 0


def test_trainability(spark):
    samples = spark.createDataFrame([(1, "train")], "image_id long, split string")
    names = spark.createDataFrame([(0, "a", 2.0), (1, "b", None), (2, "c", -1.0)], "class_id int, name string, radius double")
    found = lambda *x, **y: sorted(map(tuple, selection.trainability(*x, **y).collect()), key=str)
    assert found(samples, names) == [("missing split", "val")]
    assert found(samples, names, ("train",), "pose") == [("no keypoint shape", None)] and not found(samples, names, ("train",), "pose", (3, 2))
    assert found(samples, names, ("train",), "polo") == [("no radius", "b"), ("no radius", "c")]
    assert found(samples, names.limit(0), ("train",)) == [("no class names", None)]
    ds = Dataset(samples, spark.createDataFrame([], "image_id long"), names)
    ds.assert_trainable(("train",))
    with pytest.raises(ValueError, match="missing split"):
        ds.assert_trainable()
    with pytest.raises(ValueError, match="not exported"):
        ds.filter(splits=["train"]).assert_trainable(("train",))
