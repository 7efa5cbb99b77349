"""Free places against every position, proposals against the objects, verdicts on pixels, quotas and shortfalls."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.dataset import Dataset
from lumenframe.operators import backgrounds
from tests.test_sources import png

NOTES = "image_id long, ann_idx int, class_id int, x1 double, y1 double, x2 double, y2 double"
SAMPLES = "image_id long, split string, width int, height int"


def touches(b, x, y, w, h):
    return b[0] < x + w and b[2] > x and b[1] < y + h and b[3] > y


@pytest.fixture(scope="module")
def scene(spark):
    rng = random.Random(2)
    samples, notes = [], []
    for i in range(30):
        w, h = rng.randrange(5, 40), rng.randrange(5, 40)
        samples.append((i, ("train", "val")[i % 2], w, h))
        for k in range(rng.choice([0, 1, 3, 6])):
            x, y = rng.uniform(-2, w), rng.uniform(-2, h)
            wide, high = rng.choice([0, 1, rng.uniform(0, 9)]), rng.uniform(0, 9)
            x, y = (float(round(x)), float(round(y))) if rng.random() < 0.5 else (x, y)
            notes.append((i, k, 0, x, y, x + wide, y + high))
    notes.append((0, 99, 0, None, 1.0, 2.0, 3.0))  # no whole box: forbids nothing
    return samples, notes, spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(notes, NOTES)


def boxes_of(notes):
    out = {}
    for i, _, _, *b in notes:
        if None not in b:
            out.setdefault(i, []).append(b)
    return out


@pytest.mark.parametrize("size", [1, 7, 12, 100])
def test_free_places_are_all_and_once(light, scene, size):
    samples, notes, s, a = scene
    got = {}
    for r in backgrounds.free_places(s, a, size).collect():
        for y in range(r["y0"], r["y1"]):
            for x in range(r["x0"], r["x1"]):
                at = (r["image_id"], x, y)
                assert at not in got
                got[at] = True
    boxes, want = boxes_of(notes), set()
    for i, _, w, h in samples:
        tw, th = min(size, w), min(size, h)
        want |= {(i, x, y) for x in range(w - tw + 1) for y in range(h - th + 1) if not any(touches(b, x, y, tw, th) for b in boxes.get(i, ()))}
    assert set(got) == want


def test_proposals_touch_nothing_and_leave_no_room(light, scene):
    samples, notes, s, a = scene
    boxes, crops = boxes_of(notes), {}
    for r in backgrounds.proposals(s, a, 7, 3).collect():
        crops.setdefault(r["image_id"], []).append((r["x1"], r["y1"], r["x2"], r["y2"]))
        assert r["origin"] == (backgrounds.POPULATED if r["image_id"] in {n[0] for n in notes} else backgrounds.EMPTY)
    for i, _, w, h in samples:
        mine, tw, th = crops.get(i, []), min(7, w), min(7, h)
        assert all(0 <= x and 0 <= y and x2 <= w and y2 <= h and (x2 - x, y2 - y) == (tw, th) for x, y, x2, y2 in mine)
        shut = boxes.get(i, []) + mine
        for k, (x, y, *_) in enumerate(mine):
            assert not any(touches(b, x, y, tw, th) for b in boxes.get(i, []) + mine[:k])
        assert not [1 for x in range(w - tw + 1) for y in range(h - th + 1) if not any(touches(b, x, y, tw, th) for b in shut)]
    again = backgrounds.proposals(s.repartition(3), a.repartition(2), 7, 3).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("tile", "x1", "y1", "x2", "y2"))).alias("c"))
    assert {r["image_id"]: [tuple(c)[1:] for c in r["c"]] for r in again.collect()} == crops


def test_quotas_caps_and_shortfall(light, scene):
    _, _, s, a = scene
    tiles = s.where("width >= 12").select("image_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("tile"), "split")
    out = backgrounds.propose(s, a, tiles, 7, 0.2, 1, each=2, most=3)
    per = {r["image_id"]: r["count"] for r in out.crops.groupBy("image_id").count().collect()}
    tiled = {r["image_id"] for r in tiles.collect()}
    assert per and all(n <= (1 if i in tiled else 2) for i, n in per.items())
    assert all(r["tile"] >= 2 for r in out.crops.collect() if r["image_id"] in tiled)
    report = {r["split"]: r for r in out.report.collect()}
    assert set(report) == {"train", "val"} and all(r["target"] == r["allocated"] + r["shortfall"] for r in report.values())
    full = backgrounds.propose(s, a, tiles, 7, 0.95, 1, each=1)
    assert {r["image_id"]: r["count"] for r in full.crops.groupBy("image_id").count().collect()} == dict.fromkeys({r["image_id"] for r in backgrounds.proposals(s, a, 7, 1).collect()}, 1)
    assert all(r["shortfall"] > 0 for r in full.report.collect())
    none = backgrounds.propose(s.limit(0), a, tiles.limit(0), 7, 0.5)
    assert none.crops.isEmpty() and none.report.isEmpty()
    with pytest.raises(ValueError, match="under 1"):
        backgrounds.propose(s, a, tiles, 7, 1.0)


def test_filter_sees_pixels(spark, light, tmp_path):
    rows = []
    for i, value in enumerate((10, 200, 210)):
        png(tmp_path / f"a b+{i}.png", 20, 16, value)
        rows.append((i, "train", 20, 16, f"{tmp_path}/a b+{i}.png"))
    rows.append((7, "train", 20, 16, f"{tmp_path}/lost.png"))
    s = spark.createDataFrame(rows, SAMPLES + ", path string")
    a = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 8.0, 16.0)], NOTES)
    tiles = s.select("image_id", F.lit(0).alias("tile"), "split")
    bright = lambda rgb: rgb.shape == (8, 8, 3) and rgb.mean() > 100
    out = backgrounds.propose(s, a, tiles, 8, 0.9, predicate=bright, roots=[str(tmp_path)])
    assert {r["image_id"] for r in out.crops.collect()} == {1, 2}
    tried = {r["image_id"]: r["count"] for r in backgrounds.proposals(s, a, 8).groupBy("image_id").count().collect()}
    got = {r["origin"]: (r["evaluated"], r["accepted"], r["rejected"], r["unread"]) for r in out.verdicts.collect()}
    assert got == {backgrounds.POPULATED: (tried[1], tried[1], 0, 0), backgrounds.EMPTY: (tried[0] + tried[2], tried[2], tried[0], tried[7])}
    with pytest.raises(Exception, match="one truth value"):
        backgrounds.propose(s, a, tiles, 8, 0.9, predicate=lambda rgb: rgb > 0, roots=[str(tmp_path)]).crops.collect()
    with pytest.raises(ValueError, match="folders"):
        backgrounds.propose(s, a, tiles, 8, 0.9, predicate=bright)
    classes = spark.createDataFrame([(0, "c")], "class_id int, name string")
    ds = Dataset(s.withColumns({"relative_path": F.col("path"), "group_key": F.col("path")}), a, classes)
    made = ds.tile(8, mode="coverage", background_share=0.5, background_each=1, background_filter=bright, roots=[str(tmp_path)])
    found = made.samples.where("origin is not null")
    assert found.count() >= 1 and made.annotations.join(found, "image_id", "left_semi").isEmpty()
    assert set(made.issues.columns) == {"split", "positives", "target", "allocated", "shortfall"} and made.plan[0][0] == "tile"


def test_many_rectangles_are_cut_at_once():
    rng = np.random.default_rng(3)
    owner = np.sort(rng.integers(0, 6, 40))
    low = rng.integers(0, 9, (40, 2))
    rects = np.column_stack([low, low + rng.integers(1, 7, (40, 2))])
    corner = rng.integers(0, 9, (6, 2))
    hole = np.column_stack([corner, corner + rng.integers(1, 6, (6, 2))])[owner]
    of, left = backgrounds.cut_away(owner, rects, hole)
    assert (np.diff(of) >= 0).all()
    cells = lambda r: [(x, y) for x in range(r[0], r[2]) for y in range(r[1], r[3])]
    for g in range(6):
        want = sorted(p for r, h in zip(rects[owner == g], hole[owner == g], strict=True) for p in cells(r) if p not in set(cells(h)))
        assert sorted(p for r in left[of == g] for p in cells(r)) == want
