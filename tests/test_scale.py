"""Steps whose rows must grow with objects, not with pixels or thresholds, against plain counts."""

from __future__ import annotations

import io
import re
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import geometry
from lumenframe.operators import comparison, grouped, matching, metrics, raster, scan, shared, tiling
from lumenframe.plans import registry
from lumenframe.plans.fixtures import table

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def drawn_boxes(seed, images=3, n=12):
    """(image, number, x0, y, x1, rows) of random boxes, some empty, some above the image."""
    rng = np.random.default_rng(seed)
    return [(i, k, int(x), int(y), int(x + w), int(h)) for i in range(images) for k, (x, y, w, h) in enumerate(zip(rng.integers(0, 40, n), rng.integers(-70, 150, n), rng.integers(0, 30, n), rng.integers(0, 140, n), strict=True))]


def as_runs(spark, boxes):
    return spark.createDataFrame([(i, y, h, a, b, k) for i, k, a, y, b, h in boxes], "image_id long, y int, rows int, x0 int, x1 int, component long")


def test_repeated_runs_share_what_their_pixels_do(spark, light):
    a, b = drawn_boxes(1), drawn_boxes(2)
    want = {}
    for i, k, x0, y, x1, h in a:
        for j, m, p0, q, p1, g in b:
            n = max(0, min(x1, p1) - max(x0, p0)) * max(0, min(y + h, q + g) - max(y, q))
            if i == j and n:
                want[i, k, m] = n
    one, two = as_runs(spark, a), as_runs(spark, b)
    lines = two.where("rows > 0").select("image_id", F.explode(F.sequence("y", F.expr("y + rows - 1"))).alias("y"), "x0", "x1", "component")
    for right in (two, lines):
        got = raster.run_overlap(one, right, ["image_id"]).collect()
        assert {(r["image_id"], r["ref"], r["pred"]): r["pixels"] for r in got} == want


@pytest.mark.parametrize("name", ["mask_overlap", "overlap_matching", "component_dice", "component_dice_matching", "score_map", "score_projection", "connected_components"])
def test_boxes_travel_once_and_whole(spark, name):
    # Beside the lines only the distinct models, a row each and task, are shuffled.
    keys = set(re.findall(r"hashpartitioning\(([^)]*)\)", plan(registry.QUERIES[name](spark, SMALL))))
    assert keys and all(re.fullmatch(r"(l_orderkey|model)#\d+L?, \d+", k) for k in keys)


@pytest.mark.parametrize("name", ["component_dice", "component_dice_matching", "score_map", "score_projection", "sliced_to_source"])
def test_a_task_gets_a_bounded_number_of_lines(spark, monkeypatch, name):
    lines = table(spark, SMALL, "lineitem").count()
    monkeypatch.setattr(shared, "DEALT", 500, raising=False)
    found = {int(n) for n in re.findall(r"hashpartitioning\(l_orderkey#\d+L?, (\d+)\)", plan(registry.QUERIES[name](spark, SMALL)))}
    assert found == {-(-lines // 500)} and lines > 2000


def test_many_groups_are_matched_at_once_as_one_by_one():
    rng = np.random.default_rng(3)
    owner = np.sort(rng.integers(0, 40, 300))
    left, right = rng.integers(-3, 5, 300), rng.integers(0, 6, 300)
    taken, want = set(), []
    for i, (g, a, b) in enumerate(zip(owner.tolist(), left.tolist(), right.tolist(), strict=True)):
        if ("a", g, a) not in taken and ("b", g, b) not in taken:
            taken |= {("a", g, a), ("b", g, b)}
            want.append(i)
    assert grouped.in_order(owner, left, right).tolist() == want
    free = [len(set(left[owner == g])) == len(set(right[owner == g])) == (owner == g).sum() for g in owner]
    assert grouped.lone(owner, left, right).tolist() == free
    assert grouped.in_order(*(np.zeros(0, int),) * 3).tolist() == []


def test_thresholds_are_bits_of_one_row(spark):
    a, p = (table(spark, SMALL, n) for n in ("annotations", "predictions"))
    pairs = metrics.candidates(a, p)
    hits = metrics.hits_at(pairs, p, (0.5, 0.7, 0.9))
    assert hits.count() == p.count()
    got = {(r["threshold"], r["model"], r["image_id"], r["pred_idx"]) for r in metrics.flags_at(pairs, p, (0.5, 0.7, 0.9)).where("tp = 1").collect()}
    want = {(t, r["model"], r["image_id"], r["pred_idx"]) for t in (0.5, 0.7, 0.9) for r in matching.greedy_matching(pairs.where(F.col("iou") >= t)).collect()}
    assert got == want and len(want) > 100


def test_levels_that_a_recall_reaches(spark):
    recalls = [-1.0, 0.0, 1.0, 1 / 3, *(i * 0.01 for i in range(101)), *(float(np.nextafter(i * 0.01, s)) for i in range(101) for s in (-1, 2)), *(i / 29 for i in range(30))]
    rows = spark.createDataFrame([(r,) for r in recalls], "r double").select("r", metrics._reached(F.col("r")).alias("n")).collect()
    assert [r["n"] for r in rows] == [sum(i * 0.01 <= r["r"] for i in range(101)) for r in rows]


def test_score_map_and_components_of_repeated_runs(spark, light):
    boxes = [b for b in drawn_boxes(4, 2, 7) if b[5] and b[4] > b[2]]
    runs = as_runs(spark, boxes)
    scored = runs.withColumns({"model": F.lit("m"), "score": (F.col("component") + 1) / 8.0}).drop("component")
    lines = scored.select("model", "image_id", F.explode(F.sequence("y", F.expr("y + rows - 1"))).alias("y"), "x0", "x1", "score")
    each = F.explode(F.sequence("y", F.expr("y + rows - 1"))).alias("y")
    made, plain = comparison.score_map(scored), comparison.score_map(lines)
    assert sorted(made.select("image_id", each, "x0", "x1", "score").collect()) == sorted(plain.select("image_id", "y", "x0", "x1", "score").collect())
    assert sorted(comparison.projection(made, 0.5).select("image_id", each, "x0", "x1").collect()) == sorted(comparison.projection(plain, 0.5).select("image_id", "y", "x0", "x1").collect())
    got = raster.connected_components(runs).collect()
    assert sorted(got) == sorted(raster.connected_components(lines.select("image_id", "y", "x0", "x1")).collect())
    for image in {b[0] for b in boxes}:
        drawn = [(y, a, b) for i, _, a, top, b, h in boxes if i == image for y in range(top, top + h)]
        assert sum(r["image_id"] == image for r in got) == raster.label_runs(np.array(drawn)).max() + 1


@pytest.mark.parametrize("method", ["NMS", "GREEDYNMM", "NMM"])
@pytest.mark.parametrize("metric", ["ios", "iou"])
def test_many_images_are_suppressed_at_once_as_one_by_one(method, metric):
    rng = np.random.default_rng(5)
    owner = np.sort(rng.integers(0, 12, 150))
    corner, score, classes = rng.integers(0, 40, (150, 2)), rng.integers(0, 6, 150) / 8, rng.integers(0, 2, 150)
    b = np.column_stack([corner, corner + rng.integers(0, 25, (150, 2))]).astype(float)
    order = np.lexsort((np.arange(150), -score, owner))
    got = order[matching.winners(owner, b[order], classes[order], method, metric, 0.2, False)]
    want = {}
    for g in np.unique(owner):
        at = np.flatnonzero(owner == g)
        for group in matching.suppressed(b[at], score[at], classes[at], method, metric, 0.2, False):
            want |= {int(at[k]): int(at[group[0]]) for k in group}
    assert dict(zip(order.tolist(), got.tolist(), strict=True)) == want


def test_outline_pixels_are_sorted_as_one_number_each(monkeypatch):
    rng = np.random.default_rng(8)
    sizes = np.array([3, 0, 5, 2, 6])
    xy = rng.uniform(-10, 60, (sizes.sum(), 2))
    width, height = np.array([40, 9, 64, 50, 33]), np.array([50, 9, 30, 64, 41])
    sorted_keys, lexsort = [], np.lexsort
    monkeypatch.setattr(raster.np, "lexsort", lambda keys: sorted_keys.append(len(keys)) or lexsort(keys))
    got = raster.all_runs(xy, sizes, width, height)
    # Only crossings, by line and place; images too wide for one number are drawn alike.
    assert sorted_keys == [2]
    ends = np.cumsum(sizes)
    for i, (a, b) in enumerate(zip(ends - sizes, ends, strict=True)):
        alone = raster.all_runs(xy[a:b], sizes[i : i + 1], width[i : i + 1], height[i : i + 1])
        assert (got[got[:, 0] == i, 1:] == alone[:, 1:]).all()
    wide = raster.all_runs(xy, sizes, width + (1 << 29), height)
    assert (wide == raster.all_runs(xy, sizes, np.full(5, 1 << 12), height)).all()


def test_issues_of_a_comparison_run_no_matching(spark, monkeypatch):
    monkeypatch.setattr(scan, "stored", lambda *_: pytest.fail("a curve was stored"))
    monkeypatch.setattr(matching, "optimal_matching", lambda *_: pytest.fail("a matching was planned"))
    assert registry.QUERIES["model_comparison_issues"](spark, SMALL).count() == 4


def test_issues_count_images_once_and_no_missing_ones(spark):
    samples = spark.createDataFrame([(1, "g")], "image_id long, group_key string")
    p = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("a", 2, 1), ("b", None, 0), ("a", None, 0)], "model string, image_id long, pred_idx int")
    found = comparison.compare_models(samples, samples, p).issues.collect()
    assert sorted((r["model"], r["n"]) for r in found) == [("a", 1), ("b", 0)]


def test_tiles_of_many_images_are_stitched_at_once(spark, light, monkeypatch):
    rng = np.random.default_rng(11)
    tiles = [(i, int(rng.integers(-3, 9)), int(rng.integers(-3, 9)), int(w), int(h), rng.uniform(0, 9, w * h).tolist()) for i in range(20) for w, h in rng.integers(0, 7, (1 + i % 3, 2))]
    weight, total = {}, {}
    for i, x, y, w, h, values in sorted(tiles, key=lambda t: (t[0], t[2], t[1])):
        f = np.outer(raster.feather(h), raster.feather(w)).ravel()
        for k, v in enumerate(values):
            at = (i, y + k // w, x + k % w)
            weight[at], total[at] = weight.get(at, 0.0) + f[k], total.get(at, 0.0) + f[k] * v
    monkeypatch.setattr(raster, "DRAWN", 200)
    rows = spark.createDataFrame(tiles, "image_id long, x1 int, y1 int, width int, height int, values array<double>")
    got = {(r["image_id"], r["y"], r["x"]): r["value"] for r in raster.feather_stitch(rows).collect()}
    assert got == {at: pytest.approx(total[at] / weight[at], abs=2e-9) for at in weight} and len(got) > 200
    assert not hasattr(raster, "per_group")  # nothing is stitched image by image


def test_coverage_tiles_cover_and_keep_the_cap(spark, light):
    boxes = [(1, k, float(x), float(x % 50), float(x + 9), float(x % 50 + 9)) for k, x in enumerate(range(0, 500, 20))] + [(2, 0, 0.0, 0.0, 390.0, 20.0)]
    a = spark.createDataFrame(boxes, "image_id long, ann_idx int, x1 double, y1 double, x2 double, y2 double")
    samples = spark.createDataFrame([(1, 600, 100), (2, 400, 60)], "image_id long, width int, height int")
    whole = [tuple(r) for r in tiling.coverage_tiles(samples, a, 64, 3).collect()]
    assert {r[0] for r in whole} == {1, 2} and all(r[4] - r[2] == 64 and r[5] - r[3] == (64 if r[0] == 1 else 60) for r in whole)
    for _, k, x1, y1, x2, y2 in boxes[1:-1]:  # the first one has a single place
        assert sum(r[0] == 1 and r[2] <= x1 and r[3] <= y1 and r[4] >= x2 and r[5] >= y2 for r in whole) >= 3, k
    few = [tuple(r) for r in tiling.coverage_tiles(samples, a, 64, 3, cap=12).collect() if r["image_id"] == 1]
    assert len(few) == 12 and {r[2:] for r in few} <= {r[2:] for r in whole}
    assert not hasattr(tiling, "per_group")


def test_geometry_names_a_polygon_once(spark):
    # Inside lambdas nothing is shared: a column that is named twice is worked out twice.
    assert str(geometry.polygon_area("corners")).count("corners") == 1
    assert str(geometry.oks("truth", "guess", F.lit(9.0))).count("guess") == 1


def test_a_polygon_inside_a_tile_is_turned_not_cut(spark, light):
    five = [{"x": float(x), "y": float(y)} for x, y in ((1, 0), (3, 0), (4, 2), (2, 4), (0, 2))]
    row = spark.createDataFrame([(five,)], "p array<struct<x:double,y:double>>")
    got = row.select(geometry.clip_polygon("p", *(F.lit(float(v)) for v in (0, 0, 4, 4)))).first()[0]
    assert [(q["x"], q["y"]) for q in got] == [(4, 2), (2, 4), (0, 2), (1, 0), (3, 0)][2:] + [(4, 2), (2, 4)]


@pytest.mark.parametrize("name", ["sliced_to_source", "tile_annotation_clip"])
def test_images_travel_before_they_are_cut_into_tiles(spark, name):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to be sent whole
    try:
        lines = plan(registry.QUERIES[name](spark, SMALL)).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    depth = [len(re.match(r"[ :+*\-|]*", line)[0]) for line in lines]
    at = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    below = [next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines)) for i in at]
    assert at and any("Generate" in line for line in lines)
    assert not any("Generate" in line for i, j in zip(at, below, strict=True) for line in lines[i:j])


def test_contested_matchings_are_solved_together(monkeypatch):
    rng = np.random.default_rng(13)
    rows = np.unique(np.column_stack([rng.integers(0, 60, 500), rng.integers(-2, 4, 500), rng.integers(5, 10, 500)]), axis=0)
    owner, left, right = rows.T
    value = rng.integers(4, 9, len(rows)) / 8
    steps, solve = [], matching.assign_all
    monkeypatch.setattr(matching, "assign_all", lambda cost: steps.append(cost.shape) or solve(cost))
    got = matching.best_pairs(owner, left, right, value)
    assert len(steps) == len({s[1:] for s in steps}) < 30  # one call a size, not one a group
    for g in np.unique(owner):
        at = np.flatnonzero(owner == g)
        cost = np.full((6, 5), 1e6)
        cost[left[at] + 2, right[at] - 5] = -value[at]
        want = [cost[i, j] for i, j in matching.assign(cost) if cost[i, j] < 0]
        mine = got[owner[got] == g]
        assert len(set(left[mine])) == len(set(right[mine])) == len(mine) == len(want)
        assert value[mine].sum() == -sum(want)
    assert matching.best_pairs(*(np.zeros(0, int),) * 4).tolist() == []
