"""The distributed scan against a plain loop, with one key that holds nearly all rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import metrics, scan


def slow(rows):
    """{(key, score, id): (k, running sum, best value from there on)}."""
    out = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        total, places = 0, []
        for k, r in enumerate(mine, 1):
            total += r[3]
            places.append((r, k, total))
        best = 0.0
        for r, k, total in reversed(places):
            best = max(best, total / k)
            out[key, r[1], r[2]] = (k, total, best)
    return out


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_running_and_suffix(spark, n):
    rng = random.Random(n)
    rows = [("hot" if rng.random() < 0.97 else f"k{rng.randrange(5)}", rng.randrange(40) / 8, i, int(rng.random() < 0.4)) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, score double, id long, tp int")
    order = [F.desc("score"), F.asc("id")]
    dealt = scan.ranged(df, ["key"], order)
    run = scan.running(dealt, ["key"], order, {"ctp": "tp"}).withColumn("value", F.col("ctp") / F.col("k"))
    got = {(r["key"], r["score"], r["id"]): (r["k"], r["ctp"], r["best"]) for r in scan.suffix_max(run, ["key"], "k", "value", "best").collect()}
    assert got == slow(rows)
    if n > 1:  # a hot key fills several ranges
        parts = dealt.groupBy("key", scan.PART).count().where("key = 'hot'").collect()
        assert len(parts) > 1 and max(r["count"] for r in parts) < 0.6 * n


def test_curve_without_windows_over_a_class(spark):
    flags = spark.createDataFrame([("m", 0, i, 0, float(i % 7), i % 2) for i in range(50)], "model string, class_id int, image_id long, pred_idx int, score double, tp int")
    truth = spark.createDataFrame([(i, 0, 0) for i in range(30)], "image_id long, ann_idx int, class_id int")
    plan = metrics.average_precision(flags, truth)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window " in line or line.lstrip(" :+-").startswith("Window")]
    assert windows and all(scan.PART in line for line in windows)


def test_sums_are_made_where_a_range_is_sorted(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 20 + ["a", "b", None]), rng.randrange(40) / 8, i, rng.choice([0, 0, 1, None])) for i in range(3000)]
    order = [F.desc("score"), F.asc("id")]
    ranges = scan.ranged(spark.createDataFrame(rows, "key string, score double, id long, tp int"), ["key"], order, {"ctp": "tp"}, ["id"])
    assert ranges.where("key = 'hot'").select(scan.PART).distinct().count() > 1
    want = slow([(k or "", s, i, t or 0) for k, s, i, t in rows])
    run = scan.running(ranges.fillna("", ["key"]), ["key"], order, {"ctp": "tp"})
    assert {r["id"]: (r["k"], r["ctp"]) for r in run.collect()} == {i: v[:2] for (_, _, i), v in want.items()}
    # Only the totals of ranges are sorted; rows stay where they are read.
    plan = run._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" :+-").startswith("Window") for line in plan.splitlines()) == 1


def test_average_precision_keeps_levels_not_points(spark, monkeypatch):
    monkeypatch.setattr(scan, "suffix_max", lambda *_: pytest.fail("every point was sorted again"))
    rng = random.Random(9)
    flags = [(m, c, i, 0, rng.randrange(20) / 8, int(rng.random() < 0.5 and m != "none")) for m in ("a", "b", "none") for c in (0, 1, 7) for i in range(150)]
    truth = [(i, 0, c) for c in (0, 1, 2) for i in range(170)]
    got = metrics.average_precision(spark.createDataFrame(flags, "model string, class_id int, image_id long, pred_idx int, score double, tp int"), spark.createDataFrame(truth, "image_id long, ann_idx int, class_id int"))
    want = {}
    for m in ("a", "b", "none"):
        for c in (0, 1, 2):
            mine = sorted((f for f in flags if f[:2] == (m, c)), key=lambda f: (-f[4], f[2]))
            points = [(sum(f[5] for f in mine[: k + 1]) / 170, sum(f[5] for f in mine[: k + 1]) / (k + 1)) for k in range(len(mine))]
            want[m, c] = pytest.approx(sum(max((p for r, p in points if r >= i * 0.01), default=0.0) for i in range(101)) / 101, abs=2e-6)
    assert {(r["model"], r["class_id"]): r["ap"] for r in got.collect()} == want
