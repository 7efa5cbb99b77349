"""Run-length masks read, measured and written anew where they lie, against the steps one by one."""

from __future__ import annotations

import io
import json
import re
from contextlib import redirect_stdout

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.plans import registry
from lumenframe.sources import rle
from tests.test_opened import slow_counts

ODD_MASKS = [
    '{"size":[3,4],"counts":[2,1,9]}', '{"size": [3, 4], "counts": [0, 12]}', '{"size":[3,4],"counts":[12]}', '{"counts":[0,3,9],"size":[3,4]}', ' {"size":[3,4],"counts":[0,3,9]}\n',
    '{"size": [3, 4], "counts": "042"}', '{"size": [3, 4], "counts": "0\\\\0"}', '{"size": [3, 4], "counts": ""}', '{"size":[3,4],"counts":[]}', None,
    '{"size":[4,3],"counts":[2,1,9]}', '{"size":[3,4],"counts":[02,1,9]}', '{"size":[3,4],"counts":[2,11]}', '{"size":[3,4],"counts":[-1,3]}', '{"size":[3,4],"counts":[2,1000000000000000000000]}',
    '{"size":[3,4],"counts":"`"}', '{"size":[3],"counts":[2,1,9]}', '{"size":[3,4]}', "{", "", "[]", '{"size":[3000000000,4],"counts":[2,1,9]}',
]


def test_masks_are_measured_and_recoded_as_decoded_and_encoded(spark, light):
    rows = spark.createDataFrame([(i, t, 4, 3) for i, t in enumerate(ODD_MASKS)] + [(98, ODD_MASKS[0], None, None), (99, ODD_MASKS[10], None, None)], "image_id long, rle string, width int, height int")
    found = {r["image_id"]: r for r in rle.decoded(rows).collect()}
    drawn = {i: [tuple(q) for q in r["runs"]] for i, r in found.items() if r["runs"] is not None}
    problems = {i: r["problem"] for i, r in found.items() if r["problem"]}
    assert problems == {10: "mask size", 21: "mask size", **dict.fromkeys(range(11, 21), "mask")} and sorted({*drawn, *problems, 9}) == [*range(22), 98, 99]
    assert drawn[0] == drawn[98] == [(2, 0, 1)] and drawn[1] == drawn[6] == [(y, 0, 4) for y in range(3)] and drawn[3] == drawn[4] == [(y, 0, 1) for y in range(3)] and drawn[2] == drawn[7] == drawn[8] == []
    want = {(i, len(d), sum(b - a for _, a, b in d), min(y for y, _, _ in d), max(y for y, _, _ in d), min(a for _, a, _ in d), max(b for _, _, b in d)) for i, d in drawn.items() if d}
    assert {tuple(r) for r in rle.measured(rows).select("image_id", *rle.MEASURES).collect()} == want
    for compressed in (True, False):
        made = rle.encoded(rle.decoded(rows.where("image_id < 98")).withColumn("was", F.col("rle")).drop("rle", "problem"), compressed)
        assert {(r["image_id"], r["rle"]) for r in rle.recoded(rows.where("image_id < 98"), compressed).collect()} == {(r["image_id"], r["rle"]) for r in made.collect()}


def test_usual_json_of_masks_needs_no_parser(monkeypatch):
    rng = np.random.default_rng(9)
    masks = [rng.random((5, 7)) < d for d in (0, 0.2, 0.5, 1) * 700]
    counts = [slow_counts(m) for m in masks]
    texts = [json.dumps({"size": [5, 7], "counts": c if i % 2 else rle.text_of(np.array(c))}, separators=((",", ":"), (", ", ": "))[i % 3 == 0]) for i, c in enumerate(counts)]
    big = np.array([0, 44, 5_000_044, 3, 70_000, 44])  # backslashes
    texts.append(json.dumps({"size": [5000, 3000], "counts": rle.text_of(big)}))
    assert "\\" in texts[-1]
    monkeypatch.setattr(rle, "parsed", lambda _: pytest.fail("a parser was called"))
    none = pa.nulls(len(texts), pa.int32())
    got, sizes, width, height, wrong = rle._read(pa.array(texts), none, none)
    assert not wrong.any() and [c.tolist() for c in np.split(got, np.cumsum(sizes)[:-1])] == [*counts, big.tolist()]
    assert (width[:-1] == 7).all() and (height[:-1] == 5).all() and (width[-1], height[-1]) == (3000, 5000)


def test_text_of_a_box_is_its_json(spark, light):
    boxes = [(0, 0, 8, 6), (0, 0, 1, 6), (3, 2, 4, 3), (2, 1, 7, 5), (7, 5, 8, 6), (2, 2, 2, 4)]
    df = spark.createDataFrame([tuple(map(float, b)) + (8, 6) for b in boxes], "x1 double, y1 double, x2 double, y2 double, width int, height int")
    sides = [F.col(c) for c in df.columns]
    both = df.select(rle.text_of_box(*sides).alias("a"), F.to_json(F.struct(F.array("height", "width").alias("size"), rle.of_box(*sides).alias("counts"))).alias("b")).collect()
    assert len(both) == 6 and all(r["a"] == r["b"] for r in both)


def test_masks_of_a_query_stay_where_their_lines_lie(spark):
    out = io.StringIO()
    with redirect_stdout(out):
        registry.QUERIES["rle_masks"](spark, "/root/testdata/sf0.001").explain()
    moved = re.findall(r"(?<!Broadcast)Exchange (\w+\([^,)]*)", out.getvalue())
    assert moved and all(re.fullmatch(r"hashpartitioning\(l_orderkey#\d+L?", m) for m in moved)
