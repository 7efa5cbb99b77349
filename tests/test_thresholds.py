"""Curves at many thresholds, summed where their ranges are sorted, against plain counts."""

from __future__ import annotations

import io
import random
import re
from contextlib import redirect_stdout
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lumenframe.operators import metrics, scan, shared
from lumenframe.plans.fixtures import table

SMALL = "/root/testdata/sf0.001"


def windows(df) -> int:
    return sum(line.lstrip(" :+-").startswith("Window") for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_curve_at_thresholds_sorts_no_row_twice(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice([0] * 20 + [1, 2, 7]), i, 0, rng.randrange(30) / 8, rng.randrange(8)) for i in range(2500)]
    truth = [(i or None, 0, c) for c, n in ((0, 900), (1, 40), (2, 30), (3, 5)) for i in range(n)]  # none of class 7; one of each has no image
    hits = spark.createDataFrame(rows, "model string, class_id int, image_id long, pred_idx int, score double, hits long")
    curve = metrics.pr_curve_at(hits, spark.createDataFrame(truth, "image_id long, ann_idx int, class_id int"), (0.5, 0.6, 0.9))
    assert windows(curve) == 1  # of the ranges' totals
    want = []
    for model in "ab":
        for c, n in ((0, 900), (1, 40), (2, 30)):
            mine = sorted((r for r in rows if r[0] == model and r[1] == c), key=lambda r: (-r[4], r[2]))
            for i, t in enumerate((0.5, 0.6, 0.9)):
                total = 0
                for k, r in enumerate(mine, 1):
                    total += r[5] >> i & 1
                    want.append((model, c, t, k, r[4], total, total / n, total / k))
    assert sorted(tuple(r) for r in curve.collect()) == sorted(want)
    assert hits.where("class_id = 0").count() > 1000


def test_matched_predictions_do_not_travel(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")  # as for tables too large to be sent whole; models are few
    try:
        a, p = (table(spark, SMALL, n) for n in ("annotations", "predictions"))
        out = io.StringIO()
        with redirect_stdout(out):
            metrics.hits_at(metrics.candidates(a, p), p).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    moved = re.findall(r"(?<!Broadcast)Exchange (\w+\([^,)]*)", out.getvalue())
    assert moved and all(re.fullmatch(r"hashpartitioning\(l_orderkey#\d+L?", m) for m in moved)


def test_predictions_without_truth_or_values_keep_their_row(spark, light):
    box = "x1 double, y1 double, x2 double, y2 double"
    truth = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 8.0, 8.0), (1, 1, 0, 0.0, 0.0, 8.0, 6.0), (None, 0, 0, 0.0, 0.0, 8.0, 8.0)], f"image_id long, ann_idx int, class_id int, {box}")
    guess = [("m", 1, 0, 0, 0.5, 8.0, 8.0), ("m", 1, 1, 0, None, 8.0, 5.0), ("m", 1, 2, 0, 0.9, 8.0, 7.0), ("m", 1, 3, None, 0.3, 8.0, 8.0), ("m", None, 0, 0, 0.2, 8.0, 8.0), ("n", 2, 0, 0, 0.1, 8.0, 8.0)]
    p = spark.createDataFrame([(m, i, k, c, s, 0.0, 0.0, x, y) for m, i, k, c, s, x, y in guess], f"model string, image_id long, pred_idx int, class_id int, score double, {box}")
    got = {(r["model"], r["image_id"], r["pred_idx"]): (r["class_id"], r["score"], r["hits"]) for r in metrics.hits_at(metrics.candidates(truth, p), p, (0.5, 0.8, 0.9)).collect()}
    # The best score meets both truths about as well (7/8 and 6/7) and takes the first; 8/8 is left with 6/8; the one without a score comes last.
    assert got == {("m", 1, 2): (0, 0.9, 3), ("m", 1, 0): (0, 0.5, 1 + 4), ("m", 1, 1): (0, None, 2), ("m", 1, 3): (None, 0.3, 0), ("m", None, 0): (0, 0.2, 0), ("n", 2, 0): (0, 0.1, 0)}


def test_sums_are_stored_as_steps(spark):
    df = spark.range(20000).select(F.lit("a").alias("key"), (F.col("id") / 7).alias("score"), "id", (F.col("id") % 8).alias("hits"))
    sums = {f"c{i}": ("hits", i) for i in range(3)}
    ranges = scan.ranged(df, ["key"], [F.desc("score"), F.asc("id")], sums, ["score"])
    assert "hits" not in ranges.columns and "id" not in ranges.columns
    path = shared.work_dir(spark)
    files = [f.removeprefix("file://").removeprefix("file:") for f in ranges.inputFiles()]
    assert files and all(str(Path(f)).startswith(path.removeprefix("file:")) for f in files)
    size = rows = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        rows += meta.num_rows
        size += sum(meta.row_group(g).column(c).total_compressed_size for g in range(meta.num_row_groups) for c in range(meta.num_columns) if meta.row_group(g).column(c).path_in_schema.startswith("__c"))
    assert rows == 20000 and size < 3 * rows  # of 24 bytes a row


def test_truths_read_the_shuffle_that_hits_read(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(metrics, "stored", lambda df, name: kept.append((name, df)) or shared.stored(df, name))
    a, p = (table(spark, SMALL, n) for n in ("annotations", "predictions"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        metrics.pr_curve_at(metrics.hits_at(metrics.candidates(a, p), p), a)
        found = dict(kept)["unranged"]
        found.collect()
        out = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    lines = [line for line in out.splitlines() if "Exchange hashpartitioning(l_orderkey" in line]
    assert len(lines) > 1 and sum("ReusedExchange" not in line for line in lines) == 1
