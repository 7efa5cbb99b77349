"""Files and datasets that moved are found again."""

from __future__ import annotations

import random
import re
import shutil

from pyspark.sql import functions as F

from lumenframe.dataset import Dataset
from lumenframe.operators import lineage
from tests.test_sources import png

FILES = "root int, path string, sha256 string"


def slow(path, sha, files, rewrites):
    """The rule, file by file."""
    if path is None:
        return None, None
    fits = [f for f in files if f[1] is not None and (sha is None or sha == f[2])]
    for candidate, how in ((lineage.moved_path(path, rewrites), "path-rewrite"), (path, "stored-path")):
        if any(f[1] == candidate for f in fits):
            return candidate, how

    def shared(f):
        names = lambda p: [x for x in p.split("/") if x][::-1]
        n = 0
        for a, b in zip(names(path), names(f[1])):  # noqa: B905
            if a != b:
                break
            n += 1
        return n

    best = sorted((-shared(f), f[0], f[1]) for f in fits if f[0] >= 0 and shared(f))
    return (best[0][2], "search") if best else (None, "unresolved")


def test_files_against_the_rule(light, spark):
    rng = random.Random(4)
    path = lambda: "/" + "/".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) + "/" + rng.choice(["0.jpg", "1.jpg"])
    files = [(rng.randrange(-1, 3), path(), rng.choice(["s", "t", "u", None])) for _ in range(60)] + [(0, None, "s"), (1, "/", None)]
    records = [(i, path(), rng.choice(["s", "t", "gone", None])) for i in range(120)] + [(500, None, "s"), (501, "", None), (502, "0.jpg", "s")]
    rewrites = {"/a/b": "/b", "/a": "/c/", "/b": "/b/b"}
    got = {r["i"]: (r["resolved"], r["resolved_by"]) for r in lineage.resolved(spark.createDataFrame(records, "i int, path string, sha256 string"), spark.createDataFrame(files, FILES), rewrites).collect()}
    want = {i: slow(p, s, files, rewrites) for i, p, s in records}
    assert got == want and len({how for _, how in want.values()}) == 5
    nothing = lineage.resolved(spark.createDataFrame(records[:3], "i int, path string, sha256 string"), spark.createDataFrame([], FILES)).collect()
    assert {(r["resolved"], r["resolved_by"]) for r in nothing} == {(None, "unresolved")}


def test_folder_names_are_whole(spark):
    rows = spark.createDataFrame([("/a/b/x",), ("/a/bc/x",), ("/a/b",)], "path string")
    got = [r[0] for r in rows.select(lineage.rewritten(F.col("path"), {"/a/b/": "/n/"})).collect()]
    assert got == ["/n/x", None, "/n"] == [lineage.moved_path(p, {"/a/b/": "/n/"}) for p in ("/a/b/x", "/a/bc/x", "/a/b")]


def test_trace_of_a_moved_set(spark, light, tmp_path):
    source = tmp_path / "first" / "set"
    for split, names in (("train", "ab"), ("val", "c")):
        for n in names:
            png(source / split / "images" / f"{n} +.png", 20, 10, ord(n))
    ds = Dataset.open(spark, str(source), "flat", task="detect")
    assert [tuple(r)[3:] for r in ds.trace().datasets.collect()] == [(str(source), str(source), "stored-path")]
    ds.export(str(tmp_path / "one"))
    one = Dataset.update(spark, str(tmp_path / "one"))
    one.filter(splits=["train"]).export(str(tmp_path / "two"))
    two = Dataset.open(spark, str(tmp_path / "two"))
    here = two.trace()
    assert [r["resolved_by"] for r in here.datasets.orderBy("depth").collect()] == ["stored-path"] * 3
    assert {r["resolved"] for r in here.samples.collect()} == {f"{source}/train/images/{n} +.png" for n in "ab"}
    # The source moves below another root, beside a file of the same name with other content; the first export moves too.
    shutil.move(source, tmp_path / "later" / "kept" / "set")
    shutil.move(tmp_path / "one", tmp_path / "later" / "exports" / "uno")
    png(tmp_path / "later" / "a" / "train" / "images" / "a +.png", 20, 10, 1)
    lost = two.trace()
    assert {r["resolved_by"] for r in lost.samples.collect()} == {"unresolved"}
    found = two.trace([str(tmp_path / "nowhere"), str(tmp_path / "later")])
    assert {r["resolved"] for r in found.samples.collect()} == {f"{tmp_path}/later/kept/set/train/images/{n} +.png" for n in "ab"}
    assert [(r["resolved"], r["resolved_by"]) for r in found.datasets.orderBy("depth").collect()] == [(str(tmp_path / "two"), "stored-path"), (str(tmp_path / "later/exports/uno"), "search"), (None, "unresolved")]
    moves = {str(tmp_path / "first"): str(tmp_path / "later" / "kept")}
    moved = two.trace(path_rewrites=moves)
    assert {r["resolved_by"] for r in moved.samples.collect()} == {"path-rewrite"}
    assert moved.datasets.where("depth = 2").first()["resolved"] == str(tmp_path / "later/kept/set")
    png(tmp_path / "later" / "kept" / "set" / "train" / "images" / "a +.png", 20, 10, 9)  # changed since
    assert {r["path"][-7:]: r["resolved_by"] for r in two.trace(path_rewrites=moves).samples.collect()} == {"a +.png": "unresolved", "b +.png": "path-rewrite"}


def test_suffixes_and_records_travel_as_short_keys(spark):
    records = spark.createDataFrame([("/old/a/0.jpg", None), ("/old/a/0.jpg", "x"), ("/old/a/0.jpg", "x"), ("/b/0.jpg", "y"), ("/old/a/0.jpg", ""), (None, "x")], "path string, sha256 string")
    files = spark.createDataFrame([(0, "/new/a/0.jpg", "x"), (0, "/new/c/0.jpg", None), (1, "/aa/0.jpg", "y"), (-1, "/b/0.jpg", "z")], "root int, path string, sha256 string")
    out = lineage.resolved(records, files)
    plan = [line.lstrip(" :+-") for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    # Nothing is joined or grouped by whole suffixes, paths or digests.
    shuffled = [line for line in plan if line.startswith("Join") or line.startswith("Aggregate")]
    assert shuffled and all(re.search(r"(Join \w+, \(?(key|__record)#|Aggregate \[(key|__record)#)", line) for line in shuffled)
    found = sorted((str(r["path"]), str(r["sha256"]), r["resolved"], r["resolved_by"]) for r in out.collect())
    a = "/new/a/0.jpg"
    assert found == sorted([("/old/a/0.jpg", "None", a, "search"), *[("/old/a/0.jpg", "x", a, "search")] * 2, ("/old/a/0.jpg", "", a, "search"), ("/b/0.jpg", "y", "/aa/0.jpg", "search"), ("None", "x", None, None)])
