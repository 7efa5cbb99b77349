"""Splits and folds by size classes against the exact order, and resampling from partial sums against the plain one."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import planning, stats


@pytest.fixture(scope="module")
def grouped(spark):
    rng = random.Random(6)
    samples, notes, i = [], [], 0
    for g in range(400):
        for _ in range(rng.choice([1, 1, 2, 3, 5, 9, 30, 31, 33])):
            samples.append((i, f"g{g}", f"p{i}", "old" if g % 4 else "rest"))
            if rng.random() < 0.6 * (g % 3 > 0):
                notes.append((i, 0))
            i += 1
    return spark.createDataFrame(samples, "image_id long, group_key string, relative_path string, split string").cache(), spark.createDataFrame(notes, "image_id long, class_id int").cache()


def shares(out, notes):
    n = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    a = {r["split"]: r["count"] for r in out.join(notes, "image_id").groupBy("split").count().collect()}
    return ({s: v / sum(x.values()) for s, v in x.items()} for x in (n, a))


def test_split_by_classes(spark, grouped):
    samples, notes = grouped
    want = {"train": 0.7, "val": 0.2, "test": 0.1}
    out = planning.split(samples, notes, want, 5, method="classes").cache()
    assert out.count() == samples.count() and out.select("group_key", "split").distinct().count() == 400
    n, a = shares(out, notes)
    exact_n, exact_a = shares(planning.split(samples, notes, want, 5), notes)
    for s in want:
        assert abs(n[s] - exact_n[s]) < 0.03 and abs(a[s] - exact_a[s]) < 0.02 and abs(a[s] - want[s]) < 0.02
    again = planning.split(samples.repartition(7), notes, want, 5, method="classes")
    assert again.exceptAll(out).isEmpty() and not planning.split(samples, notes, want, 6, method="classes").exceptAll(out).isEmpty()
    pins = {f"g{g}": "test" for g in range(12)}
    pinned = planning.split(samples, notes, want, 5, ["old"], pins, method="classes").cache()
    assert {r[0] for r in pinned.where(F.col("group_key").isin(list(pins))).select("split").distinct().collect()} == {"test"}
    assert pinned.count() == samples.where("split = 'old'").count()
    for bad in ({"method": "other"}, {"method": "classes", "ratios": {"train": 0.0}}):
        with pytest.raises(ValueError):
            planning.split(samples, notes, bad.get("ratios", want), method=bad["method"])


def test_quotas_keep_all_groups():
    rng = random.Random(2)
    for _ in range(50):
        classes = [(c, k := rng.randrange(1, 40), k * rng.randrange(1, 9), rng.choice([0, k])) for c in range(rng.randrange(1, 12))]
        want = {"a": 0.6, "b": 0.4, "c": 0.0}
        out = planning.quotas(classes, want, {"b": (3, 1)})
        for cls, count, _, _ in classes:
            ends = out[cls]
            assert ends[-1] == count and ends == sorted(ends) and ends[1] == count


def test_moves_and_folds_by_classes(spark, grouped):
    samples, _ = grouped
    moved = planning.move_n_groups(samples, 9, "old", "new", 3, "classes")
    assert moved.where("split = 'new'").select("group_key").distinct().count() == 9 and moved.count() == samples.count()
    with pytest.raises(ValueError):
        planning.move_n_groups(samples, 9999, "old", "new", 3, "classes")
    cases = samples.withColumnRenamed("image_id", "case_id")
    folds = planning.grouped_folds(cases, 5, 1, "classes")
    assert folds.count() == 400
    load = [r["count"] for r in cases.join(folds, "group_key").groupBy("fold").count().collect()]
    assert len(load) == 5 and max(load) - min(load) <= 66
    assert planning.grouped_folds(cases.where("group_key in ('g1', 'g2')"), 5, 1, "classes").select("fold").distinct().count() == 2


def test_bootstrap_from_partial_sums(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(0.7, 0.2, 300), "b": rng.normal(0.2, 0.05, 40), "one": np.array([0.5])}
    rows = [(m, f"k{i}", float(v)) for m, x in values.items() for i, v in enumerate(x)] + [("a", "null", None), ("none", "k", None)]
    df = spark.createDataFrame(rows, "model string, key string, dice double")
    got = {r["model"]: r for r in stats.bootstrap_intervals(df, "dice").collect()}
    again = {r["model"]: r for r in stats.bootstrap_intervals(df.repartition(5), "dice").collect()}
    assert {m: tuple(r)[1:3] for m, r in got.items() if m != "none"} == {m: (len(x), pytest.approx(x.mean())) for m, x in values.items()}
    assert got["none"]["n"] == 0 and np.isnan(got["none"]["mean"]) and np.isnan(got["one"]["low"])
    for m in ("a", "b"):
        lo, hi = stats.interval(values[m])
        spread = values[m].std() / len(values[m]) ** 0.5
        assert abs(got[m]["low"] - lo) < 0.08 * spread and abs(got[m]["high"] - hi) < 0.08 * spread
        assert (again[m]["low"], again[m]["high"]) == (got[m]["low"], got[m]["high"])


def test_paired_from_partial_sums(spark):
    rng = np.random.default_rng(4)
    pairs = {("a", "b"): rng.normal(0.02, 0.1, 120), ("a", "c"): rng.normal(0.5, 0.1, 60), ("b", "c"): np.zeros(10)}
    df = spark.createDataFrame([(*p, f"k{i}", float(v)) for p, x in pairs.items() for i, v in enumerate(x)], "model_a string, model_b string, key string, d double")
    for r in stats.paired_bootstrap(df).collect():
        d = pairs[r["model_a"], r["model_b"]]
        lo, hi, p = stats.paired_test(d, np.random.default_rng(1))
        assert r["n"] == len(d) and r["difference"] == pytest.approx(d.mean())
        assert abs(r["low"] - lo) < 0.1 * d.std() / len(d) ** 0.5 + 1e-9 and abs(r["high"] - hi) < 0.1 * d.std() / len(d) ** 0.5 + 1e-9
        assert abs(r["p"] - p) < 0.02


def test_cell_sums_in_slices(monkeypatch):
    monkeypatch.setattr(stats, "DRAWN", 50)
    counts = np.array([0, 3, 200, 49, 1, 60, 0])
    out = stats.cell_sums(np.array([2.0]), counts, np.random.default_rng(0))
    assert out.tolist() == (2.0 * counts).tolist()
    flips = stats.flipped_sums(np.ones(120), 30, np.random.default_rng(0))
    assert len(flips) == 30 and abs(flips).max() <= 120 and (flips % 2 == 0).all() and abs(flips.mean()) < 8
