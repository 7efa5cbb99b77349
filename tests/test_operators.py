"""Kernels and seeded plans against brute force."""

from __future__ import annotations

import hashlib
import itertools
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.functions import text
from lumenframe.operators import lineage, matching, metrics, planning, raster, stats, tiling
from lumenframe.plans import registry
from lumenframe.plans.fixtures import table

SMALL = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
def test_assignment_is_optimal(n, m, rng):
    cost = np.array([[rng.randrange(-20, 20) for _ in range(m)] for _ in range(n)], float)
    found = matching.assign(cost)
    k = min(n, m)
    best = min(sum(cost[r, c] for r, c in zip(rows, cols, strict=True)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
    assert len(found) == k and sum(cost[i, j] for i, j in found) == pytest.approx(best)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=1))
def test_bipartite_matching_is_largest(edges):
    a, b = (np.array(x) for x in zip(*sorted(edges), strict=True))
    found = matching.bipartite_matching(a, b)
    assert set(found) <= edges and len({x for x, _ in found}) == len({y for _, y in found}) == len(found)
    best = max(k for k in range(6) if any(len({x for x, _ in c}) == len({y for _, y in c}) == k for c in itertools.combinations(edges, k)))
    assert len(found) == best


def test_optimal_and_greedy_on_tables(spark):
    pairs = metrics.candidates(table(spark, SMALL, "annotations"), table(spark, SMALL, "predictions"))
    best = matching.optimal_matching(pairs)
    assert best.groupBy("model", "image_id", "ann_idx").count().where("count > 1").isEmpty()
    assert best.groupBy("model", "image_id", "pred_idx").count().where("count > 1").isEmpty()
    assert best.count() >= matching.greedy_matching(pairs).count()


def slow_averaged(truth, preds, thresholds, value, points):
    """{class: [ap by threshold]} of one model: lists of (image, idx, class, shape[, score]); by the definition."""
    out = {}
    for c in sorted({g[2] for g in truth}):
        n = sum(g[2] == c for g in truth)
        for t in thresholds:
            used, tps = set(), []
            for p in sorted((p for p in preds if p[2] == c), key=lambda p: (-p[4], p[0], p[1])):
                found = [(value(g[3], p[3]), g[1]) for g in truth if g[0] == p[0] and g[2] == c and (g[0], g[1]) not in used]
                found = [x for x in found if (x[0] <= t if points else x[0] >= t)]
                if found:
                    used.add((p[0], (min if points else max)(found)[1]))
                tps.append(bool(found))
            ctp = np.cumsum(tps)
            recall, precision = ctp / n, ctp / np.arange(1, len(tps) + 1)
            out.setdefault(c, []).append(float(np.mean([max(precision[recall >= i * 0.01], default=0.0) for i in range(101)])))
    return out


@pytest.mark.parametrize("points", [False, True])
def test_averaged_precision(spark, points):
    """Greedy matching at each of ten thresholds, against brute force, where predictions compete for truths."""
    rng = random.Random(4)
    box = lambda x, y, w: (float(x), float(y), float(x + w), float(y + w))
    truth = [(i, k, rng.randrange(2), box(rng.randrange(14), rng.randrange(9), 10)) for i in range(12) for k in range(4)]
    preds = [(i, 2 * k + h, c, box(b[0] + rng.randrange(-3, 4), b[1] + rng.randrange(-2, 3), 10), rng.randrange(8) / 8) for i, k, c, b in truth for h in range(2)]
    preds.append((3, 90, 7, box(0, 0, 10), 0.9))  # a class without truth
    truth.append((3, 90, 5, box(0, 0, 10)))  # a class without predictions

    def value(g, p):
        if points:
            return float(np.hypot(g[0] - p[0], g[1] - p[1])) / 4.0
        inter = max(0.0, min(g[2], p[2]) - max(g[0], p[0])) * max(0.0, min(g[3], p[3]) - max(g[1], p[1]))
        return inter / (200.0 - inter)

    grid = [round(1.0 - 0.1 * i, 1) for i in range(10)] if points else [round(0.5 + 0.05 * i, 2) for i in range(10)]
    want = slow_averaged(truth, preds, grid, value, points)
    centre = [((F.col("x1") + F.col("x2")) / 2).alias("px"), ((F.col("y1") + F.col("y2")) / 2).alias("py")]
    a = spark.createDataFrame([(i, k, c, *b) for i, k, c, b in truth], "image_id long, ann_idx int, class_id int, x1 double, y1 double, x2 double, y2 double").select("*", *centre, F.lit(4.0).alias("radius"))
    p = spark.createDataFrame([("m", i, k, c, *b, s) for i, k, c, b, s in preds], "model string, image_id long, pred_idx int, class_id int, x1 double, y1 double, x2 double, y2 double, score double").select("*", *centre)
    pairs = metrics.point_candidates(a, p) if points else metrics.candidates(a, p)
    classes, total = metrics.averaged_precision(pairs, p, a, points)
    first, mean = ("map100", "map100_10") if points else ("ap50", "map50_95")
    got = {r["class_id"]: (r[first], r["ap"]) for r in classes.collect()}
    assert set(got) == set(want) == {0, 1, 5} and got[5] == (0.0, 0.0)
    assert all(got[c] == pytest.approx((v[0], np.mean(v)), abs=1e-6) for c, v in want.items())
    row = total.first()
    assert row[first] == pytest.approx(np.mean([v[0] for v in want.values()]), abs=1e-6)
    assert row[mean] == pytest.approx(np.mean(list(want.values())), abs=1e-6) and row[mean] < row[first]


def test_suppression():
    boxes = np.array([[0, 0, 10, 10], [5, 0, 15, 10], [10, 0, 20, 10], [40, 40, 50, 50]], float)
    scores, classes = np.array([0.9, 0.8, 0.7, 0.6]), np.zeros(4, int)
    assert matching.suppressed(boxes, scores, classes, "NMS", "ios", 0.4, False) == [[0, 1], [2], [3]]
    assert matching.suppressed(boxes, scores, classes, "NMM", "ios", 0.4, False) == [[0, 1, 2], [3]]
    assert matching.suppressed(boxes, scores, np.array([0, 1, 0, 0]), "NMM", "ios", 0.4, False) == [[0], [1], [2], [3]]
    assert matching.suppressed(boxes, scores, np.array([0, 1, 0, 0]), "NMM", "ios", 0.4, True) == [[0, 1, 2], [3]]


def test_components(spark):
    rng = np.random.default_rng(0)
    masks = rng.random((12, 14)) < 0.4
    runs = raster.runs_of(masks)
    assert (raster.mask_of(runs, 14, 12) == masks).all()
    labels = raster.label_runs(runs)
    seen, n = np.zeros(masks.shape, int), 0
    for y, x in zip(*np.nonzero(masks), strict=True):
        if not seen[y, x]:
            n += 1
            stack = [(y, x)]
            while stack:
                i, j = stack.pop()
                if 0 <= i < 12 and 0 <= j < 14 and masks[i, j] and not seen[i, j]:
                    seen[i, j] = n
                    stack += [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    groups = {}
    for (y, a, _), k in zip(runs, labels, strict=True):
        groups.setdefault(k, set()).add(seen[y, a])
    assert len(groups) == n and all(len(g) == 1 for g in groups.values())
    df = spark.createDataFrame([(1, *map(int, r)) for r in runs], "image_id long, y int, x0 int, x1 int")
    got = raster.connected_components(df)
    assert got.count() == n and got.agg(F.sum("area")).first()[0] == masks.sum()


def test_fill():
    square = np.array([(1, 1), (3, 1), (3, 3), (1, 3)], float)
    assert raster.fill_polygon(square, 6, 6).sum() == 9
    assert raster.fill_polygon(np.zeros((0, 2)), 3, 3).sum() == 0


def test_confusion(spark):
    ref = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 0, 4), (2, 0, 0, 2)], "image_id long, y int, x0 int, x1 int")
    pred = spark.createDataFrame([(1, 1, 2, 6), (3, 0, 0, 5)], "image_id long, y int, x0 int, x1 int")
    got = {r["image_id"]: (r["tp"], r["fp"], r["fn"]) for r in raster.confusion(ref, pred, ["image_id"]).collect()}
    assert got == {1: (2, 2, 6), 2: (0, 0, 2), 3: (0, 5, 0)}


def test_stitching_constant_tiles(spark):
    tiles = spark.createDataFrame([(1, 0, 0, 4, 4, [2.0] * 16), (1, 2, 0, 4, 4, [2.0] * 16)], "image_id long, x1 int, y1 int, width int, height int, values array<double>")
    rows = raster.feather_stitch(tiles).collect()
    assert len(rows) == 24 and all(abs(r["value"] - 2) < 1e-6 for r in rows)


def test_stitching_against_plain_sums(spark):
    rng = np.random.default_rng(3)
    tiles = [(i % 3, int(rng.integers(0, 9)), int(rng.integers(0, 9)), int(rng.integers(1, 6)), int(rng.integers(1, 6))) for i in range(18)]
    rows, sums = [], {}
    for image, x1, y1, w, h in tiles:
        values = rng.random(w * h)
        rows.append((image, x1, y1, w, h, values.tolist()))
        for k, v in enumerate(values):
            f = raster.feather(h)[k // w] * raster.feather(w)[k % w]
            s = sums.setdefault((image, y1 + k // w, x1 + k % w), [0.0, 0.0])
            s[0], s[1] = s[0] + f * v, s[1] + f
    frame = spark.createDataFrame([*rows, (9, 5, 5, 0, 0, [])], "image_id long, x1 int, y1 int, width int, height int, values array<double>")
    got = {(r["image_id"], r["y"], r["x"]): r["value"] for r in raster.feather_stitch(frame).collect()}
    assert set(got) == set(sums) and all(abs(got[k] - a / b) < 1e-8 for k, (a, b) in sums.items())


def test_split_plan():
    rng = random.Random(1)
    groups = [(f"g{i}", rng.randrange(1, 9), rng.randrange(0, 5)) for i in range(60)]
    plan = planning.assign_splits(groups, {"train": 7, "val": 2, "test": 1}, 3, pinned={"g0": "test"})
    assert set(plan) == {g for g, _, _ in groups} and plan["g0"] == "test"
    n = sum(k for _, k, _ in groups)
    share = {s: sum(k for g, k, _ in groups if plan[g] == s) / n for s in ("train", "val", "test")}
    assert abs(share["train"] - 0.7) < 0.06 and plan == planning.assign_splits(groups, {"train": 7, "val": 2, "test": 1}, 3, pinned={"g0": "test"})
    with pytest.raises(ValueError):
        planning.assign_splits(groups, {"train": 0})


def test_folds():
    sizes = [(f"g{i}", i % 5 + 1) for i in range(20)]
    out = planning.folds(sizes, 5)
    load = [sum(n for g, n in sizes if out[g] == k) for k in range(5)]
    assert max(load) - min(load) <= 5 and len(set(planning.folds(sizes[:3], 5).values())) == 3


def test_sample_follows_the_generator(spark):
    s = table(spark, SMALL, "samples")
    paths = sorted(r["relative_path"] for r in s.select("relative_path").collect())
    want = [paths[i] for i in sorted(random.Random(5).sample(range(len(paths)), 20))]
    assert [r["relative_path"] for r in planning.sample(s, 20, 5).collect()] == want


def test_paired_test():
    rng = np.random.default_rng(1)
    lo, hi, p = stats.paired_test(rng.normal(0.5, 0.1, 50), rng, 500)
    assert 0.4 < lo < 0.5 < hi < 0.6 and p == pytest.approx(1 / 501)
    assert all(np.isnan(stats.interval(np.array([1.0]))))


def test_coverage_tiles_hold_every_object(spark):
    s, a = table(spark, SMALL, "samples").limit(50), table(spark, SMALL, "annotations")
    tiles = tiling.coverage_tiles(s, a, 320, 2)
    held = a.join(tiles.withColumnsRenamed({"x1": "t1", "y1": "t2", "x2": "t3", "y2": "t4"}), "image_id").where("x1 >= t1 and y1 >= t2 and x2 <= t3 and y2 <= t4")
    seen = held.select("image_id", "ann_idx").distinct().count()
    assert seen == a.join(s, "image_id", "left_semi").count()


def test_lineage_of_any_depth(spark):
    """Chains of more than 32 steps keep all rows; only cycles, what is behind them and lost parents are left out."""
    rows = [(i, i - 1 if i else None, f"d{i}") for i in range(101)] + [(200, 201, "c"), (201, 202, "c"), (202, 200, "c"), (203, 200, "behind"), (300, 999, "lost")]
    got = {r["node_id"]: (r["root_id"], r["depth"], r["chain"]) for r in lineage.trace(spark.createDataFrame(rows, "node_id long, parent_id long, dataset_name string")).collect()}
    assert got == {i: (0, i, ">".join(f"d{k}" for k in range(i, -1, -1))) for i in range(101)}
    assert lineage.trace(spark.createDataFrame(rows[-5:], "node_id long, parent_id long, dataset_name string")).isEmpty()


def test_fingerprint_query_returns_the_digest(spark):
    names, groups = ["image_id", "relative_path", "split", "width", "height"], {}
    for r in table(spark, SMALL, "samples").collect():
        sha = hashlib.sha256(json.dumps({c: r[c] for c in names}, separators=(",", ":")).encode()).hexdigest()
        groups.setdefault(r["group_key"], []).append([int(sha[12 * i : 12 * i + 12], 16) for i in range(4)])
    want = {g: (len(x), hashlib.sha256(":".join(map(str, [len(x), *map(sum, zip(*x, strict=True))])).encode()).hexdigest()) for g, x in groups.items()}
    assert {r["group_key"]: (r["n"], r["fingerprint"]) for r in registry.QUERIES["content_fingerprint"](spark, SMALL).collect()} == want


def test_queries_resample_and_stitch_in_full(spark, monkeypatch):
    seen = []
    whole = stats.resampled_means
    monkeypatch.setattr(stats, "bootstrap_intervals", lambda scores, value, resamples=stats.RESAMPLES: seen.append(resamples))
    monkeypatch.setattr(stats, "paired_bootstrap", lambda pairs, resamples=stats.RESAMPLES: seen.append(resamples))
    registry.QUERIES["bootstrap_interval"](spark, SMALL), registry.QUERIES["paired_bootstrap"](spark, SMALL)
    assert seen == [10_000, 10_000] and len(whole(np.arange(5.0), np.random.default_rng(0), seen[0])) == 10_000
    images = registry.QUERIES["feather_stitch"](spark, SMALL).select("image_id").distinct()
    assert images.count() == table(spark, SMALL, "samples").count()


def test_derived_names():
    name = lambda op, s: lineage.derived_name("my set", op, s).split("__")
    for op, settings, detail in (
        ("split", {"ratios": {"train": 0.8, "val": 0.2}}, "split-train80-val20"),
        ("move_images_with_classes", {"classes": ["a b", "c", "d", "e"], "to": "val"}, "move-a-b-c-d-to-val"),
        ("move_n_groups", {"n": 3, "from": "train", "to": "test"}, "move-3-groups-train-to-test"),
        ("remove_classes", {"classes": ["x"], "merge_into": None}, "remove-x"),
        ("remove_classes", {"classes": ["x"], "merge_into": "y z"}, "merge-x-into-y-z"),
        ("rename_classes", {"a": "b c"}, "rename-b-c"),
        ("rebalance_empty", {"fraction": 0.25}, "empty-max25"),
        ("tile", {"mode": "grid", "size": 320}, "tile-grid-320"),
        ("augment", {"copies": 2}, "augment-2x"),
        ("filter", {}, "filter"),
    ):
        assert name(op, settings) == ["my-set", detail, lineage.fingerprint(settings)]


def slow_fill(points, width, height):
    """Pixel by pixel: even-odd crossings of the scan line, and the outline."""
    mask = np.zeros((height, width), bool)
    edges = [(points[i], points[(i + 1) % len(points)]) for i in range(len(points))]
    for y in range(height):
        xs = sorted(a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in edges if min(a[1], b[1]) <= y < max(a[1], b[1]))
        for x in range(width):
            mask[y, x] = any(l - 1e-9 <= x <= r + 1e-9 for l, r in zip(xs[::2], xs[1::2], strict=False))
    for a, b in edges:
        n = int(max(abs(b[0] - a[0]), abs(b[1] - a[1]), 1))
        for x, y in zip(np.rint(np.linspace(a[0], b[0], n + 1)), np.rint(np.linspace(a[1], b[1], n + 1)), strict=True):
            if 0 <= x < width and 0 <= y < height:
                mask[int(y), int(x)] = True
    return mask


def test_polygon_runs_against_brute_force():
    rng = np.random.default_rng(0)
    for i in range(200):
        points = rng.uniform(-10, 40, (rng.integers(1, 8), 2))
        points = np.round(points) if i % 2 else points
        assert np.array_equal(raster.fill_polygon(points, 32, 24), slow_fill(points, 32, 24))


def test_text_functions(spark):
    long = "é" + "X" * 79 + "._" + "y" * 40
    df = spark.createDataFrame([("a b/ç",), ("x" * 100,), ("  -Ab.C-_",), ("ç",), ("",), (None,), (long,)], "s string")
    rows = [r[0] for r in df.select(text.slug(F.col("s"))).collect()]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()[:12]
    whole = "x" * 79 + "._" + "y" * 40
    assert rows == ["a-b", f"{'x' * 67}-{digest('x' * 100)}", "ab.c", "dataset", "dataset", None, f"{whole[:67]}-{digest(whole)}"]
    splits = spark.createDataFrame([("Validation",), ("TRAIN",), (None,)], "s string")
    assert [r[0] for r in splits.select(text.split_name(F.col("s"))).collect()] == ["val", "train", None]
    with pytest.raises(Exception, match="no split"):
        spark.createDataFrame([("dev",)], "s string").select(text.split_name(F.col("s"))).collect()
    assert [r[0] for r in df.select(text.elided(F.col("s"), 9)).collect()][1] == "xxxx…xxxx"
    got = spark.sql("select 'd/images/a/images/b.c.jpg' as p").select(text.label_path(F.col("p"))).first()[0]
    assert got == "d/images/a/labels/b.c.txt"


def test_visual_cases(spark):
    cases = spark.createDataFrame([(f"c{i:03d}", i % 3) for i in range(90)], "relative_path string, n int").repartition(5)
    filled = [f"c{i:03d}" for i in range(90) if i % 3]
    expected = [filled[i] for i in sorted(np.random.default_rng(7).choice(60, size=10, replace=False).tolist())]
    of = lambda df: [r["relative_path"] for r in df.orderBy("ord").collect()]
    assert of(planning.visual_cases(cases, 10, F.col("n") > 0, 7)) == expected
    assert of(planning.visual_cases(cases, 60, F.col("n") > 0, 7)) == filled
    assert len(of(planning.visual_cases(cases, 70, F.col("n") > 5, 7))) == 70
    assert len(of(planning.visual_cases(cases, 100))) == 90
    assert of(planning.visual_cases(cases.limit(0), 3, F.col("n") > 0)) == []


def test_trace_without_checkpoint_folder(spark):
    rows = [(i, i - 1 if i else None, f"d{i}") for i in range(40)] + [(50, 51, "x"), (51, 50, "y"), (52, 51, "z"), (60, None, "r")]
    got = {r["node_id"]: (r["root_id"], r["depth"]) for r in lineage.trace(spark.createDataFrame(rows, "node_id long, parent_id long, dataset_name string")).collect()}
    assert got == {i: (0, i) for i in range(40)} | {60: (60, 0)}
