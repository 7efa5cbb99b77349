"""Background crops: where a crop fits between an image's objects, crops drawn from there, a caller's verdict on their pixels, and quotas."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.grouped import per_batch
from lumenframe.operators.shared import small_batches
from lumenframe.operators.tiling import allocate_backgrounds, background_count, boxed
from lumenframe.sources.yolo import local, named

#: What a background crop comes from.
POPULATED, EMPTY = "populated_image_empty_space", "empty_source_image"


def side(length: str, size: int) -> Column:
    """A crop's side: ``size``, or the image's own where that is shorter."""
    return F.least(F.col(length), F.lit(size))


def free_places(samples: DataFrame, annotations: DataFrame, size: int) -> DataFrame:
    """(image_id, x0, y0, x1, y1): rectangles, ends exclusive, of the upper left corners at which a crop touches no object.

    An object forbids its box widened by a crop to the left and above. A sweep
    over the bands between the forbidden boxes' ends leaves the gaps of each band:
    disjoint rectangles that hold every free corner once. Work is an image's own
    objects by the bands that they meet. Objects without a whole box forbid nothing.
    """
    s = samples.select("image_id", (F.col("width") - side("width", size) + 1).cast("int").alias("w"), (F.col("height") - side("height", size) + 1).cast("int").alias("h"), side("width", size).alias("tw"), side("height", size).alias("th"))
    low = lambda c, t: F.greatest(F.lit(0), F.floor(F.col(c) - F.col(t)) + 1).cast("int")
    high = lambda c, end: F.least(F.col(end), F.ceil(F.col(c))).cast("int")
    whole = boxed(annotations).where(" and ".join(f"{c} is not null and not isnan({c})" for c in ("x1", "y1", "x2", "y2")))
    shut = whole.select("image_id", "x1", "y1", "x2", "y2").join(s, "image_id")
    shut = shut.select("image_id", low("x1", "tw").alias("a"), high("x2", "w").alias("b"), low("y1", "th").alias("c"), high("y2", "h").alias("d")).where("a < b and c < d")
    ends = s.select("image_id", F.explode(F.array(F.lit(0), "h")).alias("y0")).union(shut.select("image_id", F.explode(F.array("c", "d")))).distinct()
    bands = ends.withColumn("y1", F.lead("y0").over(Window.partitionBy("image_id").orderBy("y0"))).where("y1 is not null")
    inside = bands.join(shut, "image_id").where("c <= y0 and d >= y1").select("image_id", "y0", "y1", "a", "b")
    walls = bands.join(s, "image_id").select("image_id", "y0", "y1", F.col("w").alias("a"), F.col("w").alias("b"))
    before = Window.partitionBy("image_id", "y0").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    gaps = inside.unionByName(walls).withColumn("x0", F.coalesce(F.max("b").over(before), F.lit(0)))
    return gaps.where("x0 < a").select("image_id", "x0", "y0", F.col("a").alias("x1"), "y1")


def cut_away(owner: np.ndarray, rects: np.ndarray, hole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rectangles (x0, y0, x1, y1), by ``owner``, each without the ``hole`` of its row: what lies above, below, left and right of it stays."""
    met = (rects[:, 0] < hole[:, 2]) & (rects[:, 2] > hole[:, 0]) & (rects[:, 1] < hole[:, 3]) & (rects[:, 3] > hole[:, 1])
    (a, b, c, d), (x0, y0, x1, y1) = rects[met].T, hole[met].T
    top, low = np.maximum(b, y0), np.minimum(d, y1)
    parts = [np.column_stack(p) for p in ((a, b, c, top), (a, low, c, d), (a, top, np.maximum(a, np.minimum(c, x0)), low), (np.minimum(c, np.maximum(a, x1)), top, c, low))]
    left, of = np.concatenate([rects[~met], *parts]), np.concatenate([owner[~met], *[owner[met]] * 4])
    some = np.flatnonzero((left[:, 0] < left[:, 2]) & (left[:, 1] < left[:, 3]))
    some = some[np.argsort(of[some], kind="stable")]
    return of[some], left[some]


def proposals(samples: DataFrame, annotations: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """(image_id, tile, x1, y1, x2, y2, origin): crops that touch no object and not each other, until no further one fits.

    Each is drawn evenly from the free places that the ones before it left, by a
    generator of the image's own, so neither attempts nor partitions decide what
    is found. ``origin``: whether the image has objects.
    """
    rows = free_places(samples, annotations, size).join(samples.select("image_id", side("width", size).alias("tw"), side("height", size).alias("th")), "image_id")

    def many(x: dict[str, np.ndarray], owner: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        tw, th = (x[c][first].astype(np.int64) for c in ("tw", "th"))
        rngs = [np.random.default_rng(int.from_bytes(hashlib.sha256(f"background:{seed}:{i}".encode()).digest()[:8])) for i in x["image_id"][first].tolist()]
        of, rects, made = owner, np.column_stack([x[c] for c in ("x0", "y0", "x1", "y1")]).astype(np.int64), []
        # In every round each image that has room draws one crop.
        while len(rects):
            area = (rects[:, 2] - rects[:, 0]) * (rects[:, 3] - rects[:, 1])
            ends = np.cumsum(area)
            start = np.flatnonzero(np.diff(of, prepend=-1))
            image, before = of[start], (ends - area)[start]
            room = np.append(before[1:], ends[-1]) - before
            pick = before + np.array([rngs[g].integers(n) for g, n in zip(image.tolist(), room.tolist(), strict=True)])
            i = np.searchsorted(ends, pick, side="right")
            pick, wide = pick - (ends - area)[i], rects[i, 2] - rects[i, 0]
            left, top = rects[i, 0] + pick % wide, rects[i, 1] + pick // wide
            hole = np.column_stack([left - tw[image] + 1, top - th[image] + 1, left + tw[image], top + th[image]])
            made.append((image, np.full(len(image), len(made)), left, top))
            of, rects = cut_away(of, rects, np.repeat(hole, np.diff(np.append(start, len(of))), 0))
        image, tile, left, top = (np.concatenate(m) for m in zip(*made, strict=True))
        order = np.argsort(image, kind="stable")
        image, tile, left, top = image[order], tile[order], left[order], top[order]
        return image, {"tile": tile, "x1": left, "y1": top, "x2": left + tw[image], "y2": top + th[image]}

    drawn = per_batch(rows, ("image_id",), ("y0", "x0"), ("image_id", "tw", "th", "x0", "y0", "x1", "y1"), many, dict.fromkeys(("tile", "x1", "y1", "x2", "y2"), "int"))
    peopled = annotations.select("image_id").distinct().withColumn("origin", F.lit(POPULATED))
    return drawn.join(peopled, "image_id", "left").withColumn("origin", F.coalesce("origin", F.lit(EMPTY)))


def judged(crops: DataFrame, roots: list[str], predicate: Callable[[np.ndarray], Any]) -> DataFrame:
    """``crops`` (path, x1, y1, x2, y2, ...) with ``accepted``: the predicate's truth on the crop's pixels, rows by columns by RGB.

    The JVM decodes each image below ``roots`` once and cuts its crops, so a Python
    task holds crops, never whole images. A crop of an image that is missing, unreadable
    or too small has null. An exception of the predicate, or an answer without one
    truth value, ends the job and names the crop.
    """
    spark = crops.sparkSession
    small_batches(spark)
    images = spark.read.format("image").option("recursiveFileLookup", True).load(roots).select("image.*").where("width > 0")
    places = crops.where("path is not null").select(local(F.col("path")).alias("file"), "path", "x1", "y1", "x2", "y2").distinct()
    pairs = images.withColumn("file", named(F.col("origin"))).join(places, "file").where("x1 >= 0 and y1 >= 0 and x1 < x2 and y1 < y2 and x2 <= width and y2 <= height")
    wide = (F.col("x2") - F.col("x1")) * F.col("nChannels")
    lines = F.transform(F.sequence(F.col("y1"), F.col("y2") - 1), lambda y: F.substr(F.col("data"), ((y * F.col("width") + F.col("x1")) * F.col("nChannels") + 1).cast("int"), wide))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                pixels = np.frombuffer(b"".join(r["lines"]), np.uint8).reshape(r["y2"] - r["y1"], r["x2"] - r["x1"], r["nChannels"])
                rgb = np.repeat(pixels, 3, 2) if r["nChannels"] == 1 else pixels[:, :, 2::-1].copy()
                try:
                    found.append(bool(predicate(rgb)))
                except Exception as e:
                    raise ValueError(f"background filter on {r['path']} {[r[c] for c in ('x1', 'y1', 'x2', 'y2')]}: {type(e).__name__}: {e}; it has to return one truth value") from e
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("path", "x1", "y1", "x2", "y2")] + [pa.array(found, pa.bool_())], ["path", "x1", "y1", "x2", "y2", "accepted"])

    verdicts = pairs.select("path", "x1", "y1", "x2", "y2", "nChannels", lines.alias("lines")).mapInArrow(run, "path string, x1 int, y1 int, x2 int, y2 int, accepted boolean")
    return crops.join(verdicts, ["path", "x1", "y1", "x2", "y2"], "left")


@dataclass(frozen=True)
class Backgrounds:
    """crops (image_id, tile, split, x1, y1, x2, y2, origin) and, by split, what was asked for and found; verdicts by origin where a predicate decided."""

    crops: DataFrame
    report: DataFrame
    verdicts: DataFrame | None = None


def propose(samples: DataFrame, annotations: DataFrame, tiles: DataFrame, size: int, share: float, seed: int = 0, each: int | None = None, most: int | None = None, predicate: Callable[[np.ndarray], Any] | None = None, roots: list[str] | None = None) -> Backgrounds:
    """Background crops that bring their share of each split's crops nearest to ``share``, beside the ``tiles`` (image_id, tile, split) that it has.

    ``each``: background crops an image at most; ``most``: crops of any kind an image
    at most. Numbers go on from those of the image's tiles. ``predicate`` decides on
    candidates before the quotas do, so a rejected one is made up for by another.
    The report (split, positives, target, allocated, shortfall) says what could not be had.
    """
    if not 0 <= share < 1:
        raise ValueError("the share of backgrounds is under 1")
    have = tiles.groupBy("image_id").agg(F.count("*").alias("have"), F.max("tile").alias("last"))
    kept = [c for c in ("path",) if c in samples.columns]
    found = proposals(samples, annotations, size, seed).join(samples.select("image_id", "split", *kept), "image_id").join(have, "image_id", "left")
    rooms = [F.lit(each).cast("long")] * (each is not None) + [F.lit(most).cast("long") - F.coalesce("have", F.lit(0))] * (most is not None)
    room = F.least(*rooms) if len(rooms) > 1 else (rooms or [F.lit(None).cast("long")])[0]
    found = found.select("image_id", (F.col("tile") + F.coalesce("last", F.lit(-1)) + 1).cast("int").alias("tile"), "split", "x1", "y1", "x2", "y2", "origin", *kept, room.alias("room"))
    verdicts = None
    if predicate is not None:
        if not kept or not roots:
            raise ValueError("a background filter needs the images' paths and the folders that hold them")
        found = judged(found, roots, predicate)
        verdicts = found.groupBy("origin").agg(F.count("accepted").alias("evaluated"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), F.count_if(F.col("accepted").isNull()).alias("unread"))
        found = found.where("accepted").drop("accepted")
    quotas = samples.select("split").distinct().join(tiles.groupBy("split").agg(F.count("*").alias("n")), "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("positives"))
    quotas = quotas.withColumn("target", background_count(F.col("positives"), share))
    crops = allocate_backgrounds(found, quotas, seed, None if not rooms else F.col("room")).drop("room", *kept)
    done = crops.groupBy("split").agg(F.count("*").alias("n"))
    report = quotas.join(done, "split", "left").withColumn("allocated", F.coalesce("n", F.lit(0))).select("split", "positives", "target", "allocated", (F.col("target") - F.col("allocated")).alias("shortfall"))
    return Backgrounds(crops, report, verdicts)
