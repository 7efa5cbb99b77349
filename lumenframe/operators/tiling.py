"""Tiles: grid windows, clipping of annotations, densities, histograms and quotas."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.geometry import box, box_area, clip_polygon, grid_cell, intersection, moved, polygon_area, polygon_bounds, ratio
from lumenframe.functions.text import seed_of
from lumenframe.operators.grouped import per_batch


def starts(length: Column, size: int, overlap: float) -> Column:
    """Edge-aligned window starts: strides from 0, the last window flush with the edge."""
    stride = max(1, round(size * (1 - overlap)))  # half to even
    last = length - size
    inner = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride))
    return F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(inner, F.array(last))))


def grid_tiles(samples: DataFrame, size: int, overlap: float = 0.2) -> DataFrame:
    """(image_id, x1, y1, x2, y2, tile) windows; an image that fits is one. Rows outer, columns inner."""
    small = (F.col("width") <= size) & (F.col("height") <= size)
    s = lambda c: F.when(small, F.array(F.lit(0))).otherwise(starts(F.col(c), size, overlap))
    rows = samples.select("image_id", "split", "width", "height", F.posexplode(s("height")).alias("row", "top"), s("width").alias("lefts"))
    cells = rows.select("image_id", "split", "width", "height", "row", "top", F.size("lefts").alias("n"), F.posexplode("lefts").alias("column", "left"))
    return cells.select("image_id", "split", (F.col("row") * F.col("n") + F.col("column")).cast("int").alias("tile"), F.col("left").alias("x1"), F.col("top").alias("y1"), F.least(F.col("left") + size, "width").alias("x2"), F.least(F.col("top") + size, "height").alias("y2"))


def clip_boxes(tiles: DataFrame, annotations: DataFrame, min_area_ratio: float = 0.1) -> DataFrame:
    """Boxes cut to each tile that they reach and moved into it; slivers are dropped. The pairs are an image's own: an equi-join with a range test."""
    t = tiles.select("image_id", "tile", *(F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")))
    pairs = annotations.join(t, "image_id").where("x1 < t_x2 and x2 > t_x1 and y1 < t_y2 and y2 > t_y1")
    inside = intersection(box(), box("t_"))
    kept = pairs.where(ratio(inside, box_area(box())) >= min_area_ratio)
    return kept.select("image_id", "tile", "ann_idx", "class_id", (F.greatest("x1", "t_x1") - F.col("t_x1")).alias("x1"), (F.greatest("y1", "t_y1") - F.col("t_y1")).alias("y1"), (F.least("x2", "t_x2") - F.col("t_x1")).alias("x2"), (F.least("y2", "t_y2") - F.col("t_y1")).alias("y2"))


def clip_polygons(tiles: DataFrame, annotations: DataFrame, min_area_ratio: float = 0.1) -> DataFrame:
    """Polygons cut to each tile that they reach and moved into it, with their boxes; slivers are dropped."""
    t = tiles.select("image_id", "tile", *(F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")))
    rows = annotations.withColumn("b", polygon_bounds("polygon"))
    pairs = rows.join(t, "image_id").where("b.x1 < t_x2 and b.x2 > t_x1 and b.y1 < t_y2 and b.y2 > t_y1")
    # explode keeps the cut polygon from being worked out again wherever it is named.
    cut = F.explode(F.array(clip_polygon("polygon", *(F.col(f"t_{c}") for c in ("x1", "y1", "x2", "y2")))))
    kept = pairs.select("*", cut.alias("cut")).where(ratio(polygon_area("cut"), polygon_area("polygon")) >= min_area_ratio)
    inner = F.explode(F.array(moved("cut", -F.col("t_x1"), -F.col("t_y1"))))
    return kept.select("image_id", "tile", "ann_idx", "class_id", inner.alias("polygon")).withColumn("b", polygon_bounds("polygon")).select("image_id", "tile", "ann_idx", "class_id", "polygon", "b.*")


def clip_any(tiles: DataFrame, annotations: DataFrame, min_area_ratio: float = 0.1, lossy: bool = False) -> DataFrame:
    """(image_id, tile, ann_idx, class_id and geometry) of polygons, points, or boxes with keypoints if there are; a pose whose keypoints are all outside keeps its box."""
    if "polygon" in annotations.columns:
        return clip_polygons(tiles, annotations, min_area_ratio)
    if "px" in annotations.columns:
        return clip_points(tiles, annotations, lossy).select("image_id", "tile", "ann_idx", "class_id", "px", "py", "radius")
    boxes = clip_boxes(tiles, annotations, min_area_ratio)
    if "keypoints" not in annotations.columns:
        return boxes
    t = tiles.select("image_id", "tile", *(F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")))
    points = annotations.select("image_id", "ann_idx", F.col("keypoints").alias("all"))
    found = boxes.join(points, ["image_id", "ann_idx"]).join(t, ["image_id", "tile"])
    none = F.transform("all", lambda q: F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("v")))
    inside = clip_keypoints(F.col("all"), *(F.col(f"t_{c}") for c in ("x1", "y1", "x2", "y2")))
    return found.select(*boxes.columns, F.coalesce(inside, none).alias("keypoints"))


def boxed(annotations: DataFrame) -> DataFrame:
    """``annotations`` with a box: their own, or that of their polygon or circle."""
    if "x1" in annotations.columns:
        return annotations
    if "polygon" in annotations.columns:
        return annotations.withColumn("b", polygon_bounds("polygon")).select("*", "b.*").drop("b")
    return annotations.withColumns({"x1": F.col("px") - F.col("radius"), "y1": F.col("py") - F.col("radius"), "x2": F.col("px") + F.col("radius"), "y2": F.col("py") + F.col("radius")})


def clip_points(tiles: DataFrame, points: DataFrame, lossy: bool = False) -> DataFrame:
    """Circles (px, py, radius) inside a tile; lossy: centre inside, radius cut to the nearest edge."""
    t = tiles.select("image_id", "tile", *(F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")))
    pairs = points.join(t, "image_id")
    edge = F.least(F.col("px") - F.col("t_x1"), F.col("t_x2") - F.col("px"), F.col("py") - F.col("t_y1"), F.col("t_y2") - F.col("py"))
    kept = pairs.where(edge > 0) if lossy else pairs.where(edge >= F.col("radius"))
    return kept.withColumn("radius", F.least("radius", edge)).withColumn("px", F.col("px") - F.col("t_x1")).withColumn("py", F.col("py") - F.col("t_y1")).drop("t_x1", "t_y1", "t_x2", "t_y2")


def clip_keypoints(points: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Keypoints moved into a tile, hidden or outside ones zeroed; null if none is left."""
    inside = lambda q: (F.coalesce(q["v"], F.lit(2.0)) > 0) & (q["x"] >= x1) & (q["x"] < x2) & (q["y"] >= y1) & (q["y"] < y2)
    zero = lambda: F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("v"))
    out = F.transform(points, lambda q: F.when(inside(q), F.struct((q["x"] - x1).alias("x"), (q["y"] - y1).alias("y"), q["v"].alias("v"))).otherwise(zero()))
    return F.when(F.exists(points, inside), out)


def empty_tiles(tiles: DataFrame, clipped: DataFrame) -> DataFrame:
    return tiles.join(clipped.select("image_id", "tile").distinct(), ["image_id", "tile"], "left_anti")


def dense_neighbours(annotations: DataFrame, radius: float, least: int) -> DataFrame:
    """(image_id, ann_idx, neighbours, dense) by centre distance; a grid of cells of the radius bounds what meets."""
    c = annotations.select("image_id", "ann_idx", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    c = c.withColumn("i", F.floor(F.col("cx") / radius)).withColumn("j", F.floor(F.col("cy") / radius))
    around = c.withColumn("i", F.explode(F.array(*[F.col("i") + d for d in (-1, 0, 1)]))).withColumn("j", F.explode(F.array(*[F.col("j") + d for d in (-1, 0, 1)])))
    other = c.select("image_id", F.col("ann_idx").alias("o_idx"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), "i", "j")
    near = around.join(other, ["image_id", "i", "j"]).where((F.col("ann_idx") != F.col("o_idx")) & (F.hypot(F.col("cx") - F.col("ox"), F.col("cy") - F.col("oy")) <= radius))
    counts = near.groupBy("image_id", "ann_idx").agg(F.count("*").alias("neighbours"))
    return c.select("image_id", "ann_idx").join(counts, ["image_id", "ann_idx"], "left").select("image_id", "ann_idx", F.coalesce("neighbours", F.lit(0)).alias("neighbours"), (F.coalesce("neighbours", F.lit(0)) >= least).alias("dense"))


def position_histogram(samples: DataFrame, annotations: DataFrame, columns: int = 24, rows: int = 12) -> DataFrame:
    """Counts of normalised box centres on a zero-filled grid."""
    both = annotations.join(samples.select("image_id", "width", "height"), "image_id")
    cx, cy = (F.col("x1") + F.col("x2")) / 2 / F.col("width"), (F.col("y1") + F.col("y2")) / 2 / F.col("height")
    counts = both.groupBy(grid_cell(cx, columns).alias("bx"), grid_cell(cy, rows).alias("by")).agg(F.count("*").alias("n"))
    grid = samples.sparkSession.range(columns * rows).select((F.col("id") % columns).cast("int").alias("bx"), F.floor(F.col("id") / columns).cast("int").alias("by"))
    return grid.join(F.broadcast(counts), ["bx", "by"], "left").select("bx", "by", F.coalesce("n", F.lit(0)).alias("n"))  # at most columns x rows counts


def object_coverage(annotations: DataFrame, clipped: DataFrame, requested: int) -> DataFrame:
    """Appearances of each object in tiles against the requested number."""
    seen = clipped.groupBy("image_id", "ann_idx").agg(F.count("*").alias("actual"))
    rows = annotations.select("image_id", "ann_idx").join(seen, ["image_id", "ann_idx"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return rows.withColumn("covered", F.col("actual") >= requested)


def coverage_rollup(objects: DataFrame) -> DataFrame:
    """Per image: objects, covered ones, percent."""
    return objects.groupBy("image_id").agg(F.count("*").alias("objects"), F.count_if("covered").alias("covered"), F.round(100.0 * F.count_if("covered") / F.count("*"), 6).alias("percent"))


def footprint(tiles: DataFrame, samples: DataFrame) -> DataFrame:
    """Share of each image's pixels under any tile: coordinates are compressed to bands, the covered lengths of each band added up."""
    ys = tiles.select("image_id", F.col("y1").alias("y")).union(tiles.select("image_id", F.col("y2").alias("y"))).distinct()
    bands = ys.withColumn("y_to", F.lead("y").over(Window.partitionBy("image_id").orderBy("y"))).where("y_to is not null")
    inside = tiles.join(bands, "image_id").where("y1 <= y and y2 >= y_to")
    order = Window.partitionBy("image_id", "y").orderBy("x1", "x2")
    reach = F.coalesce(F.max("x2").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("x1"))
    added = F.greatest(F.lit(0), F.col("x2") - F.greatest(F.col("x1"), reach))
    area = inside.withColumn("added", added * (F.col("y_to") - F.col("y"))).groupBy("image_id").agg(F.sum("added").alias("area"))
    return samples.join(area, "image_id", "left").select("image_id", F.round(F.coalesce("area", F.lit(0)) / (F.col("width") * F.col("height")), 6).alias("coverage"))


def background_count(positives: Column, share: float) -> Column:
    """How many background tiles bring their share nearest to ``share``; ties to fewer."""
    x = positives * share / (1 - share)
    low, high = F.floor(x), F.ceil(x)
    miss = lambda c: F.abs(F.coalesce(F.try_divide(c.cast("double"), positives + c), F.lit(0.0)) - share)
    return F.when(miss(low) <= miss(high), low).otherwise(high).cast("long")


def background_range(positives: Column, low: float, high: float) -> tuple[Column, Column]:
    """(target, required) of a share range, with 1e-12 of slack."""
    at = lambda r: positives * r / (1 - r)
    return F.floor(at(high) + 1e-12).cast("long"), F.ceil(at(low) - 1e-12).cast("long")


def allocate_backgrounds(candidates: DataFrame, quotas: DataFrame, seed: int = 0, each: int | Column | None = None) -> DataFrame:
    """Candidates (image_id, tile, split) up to the quota (split, target) of their split, spread evenly over the images, at most ``each`` (a number, or a column of the candidates) of one.

    A seeded hash orders an image's candidates; all images give their first before
    any gives a second. Where a split's quota ends is found on counts of hash
    cells, so that no split is sorted as a whole.
    """
    h = seed_of(F.lit(str(seed)), F.col("split"), F.col("image_id").cast("string"), F.col("tile").cast("string"))
    turn = F.row_number().over(Window.partitionBy("split", "image_id").orderBy("h", "tile"))
    rows = candidates.withColumn("h", h).withColumn("turn", turn).withColumn("cell", F.shiftright("h", 18))
    if each is not None:
        rows = rows.where(F.col("turn") <= each)
    cells = rows.groupBy("split", "turn", "cell").agg(F.count("*").alias("n"))  # at most 16,384 a split and turn
    before = F.sum("n").over(Window.partitionBy("split").orderBy("turn", "cell").rowsBetween(Window.unboundedPreceding, -1))
    open_cells = cells.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(quotas.select("split", "target")), "split").where("before < target").drop("n")
    order = F.row_number().over(Window.partitionBy("split", "turn", "cell").orderBy("h", "image_id", "tile"))
    ranked = rows.join(open_cells, ["split", "turn", "cell"]).withColumn("k", order)
    return ranked.where(F.col("before") + F.col("k") <= F.col("target")).select(*candidates.columns)


def coverage_tiles(samples: DataFrame, annotations: DataFrame, size: int, appearances: int = 1, attempts: int = 15, cap: int = 100, seed: int = 0) -> DataFrame:
    """Random crops that hold each object whole often enough, image by image: (image_id, tile, x1, y1, x2, y2).

    Each image draws from its own generator, seeded by (seed, image), so the
    result does not depend on the partitioning. After the attempts a crop centred
    on the object is taken; at most ``cap`` crops an image, a greedy cover first.
    """
    rows = annotations.join(samples.select("image_id", "width", "height"), "image_id").select("image_id", "width", "height", "ann_idx", "x1", "y1", "x2", "y2")

    def one(image: int, w: int, h: int, boxes: list[tuple[float, float, float, float]]) -> tuple[list[tuple[int, int]], int, int]:
        # An image has few boxes: plain numbers are quicker than arrays.
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{image}".encode()).digest()[:8]))
        tw, th = min(size, w), min(size, h)
        holds = lambda t: [b[0] >= t[0] and b[1] >= t[1] and b[2] <= t[0] + tw and b[3] <= t[1] + th for b in boxes]
        found: list[tuple[int, int]] = []
        taken: set[tuple[int, int]] = set()
        counts = [0] * len(boxes)
        for i, (x1, y1, x2, y2) in enumerate(boxes):
            tries = 0
            lo = (max(0, math.ceil(x2) - tw), max(0, math.ceil(y2) - th))
            hi = (min(w - tw, int(x1)), min(h - th, int(y1)))
            while counts[i] < appearances:
                if tries < attempts and lo[0] <= hi[0] and lo[1] <= hi[1]:
                    t = (int(rng.integers(lo[0], hi[0] + 1)), int(rng.integers(lo[1], hi[1] + 1)))
                else:
                    t = (int(min(max(0, (x1 + x2 - tw) // 2), w - tw)), int(min(max(0, (y1 + y2 - th) // 2), h - th)))
                tries += 1
                if t in taken and tries <= attempts:
                    continue
                taken.add(t)
                found.append(t)
                held = holds(t)
                counts = [c + k for c, k in zip(counts, held, strict=True)]
                if not held[i]:
                    break  # larger than a tile
                if tries > attempts:
                    break
        if len(found) > cap:
            left, chosen, held = set(range(len(boxes))), [], [{i for i, k in enumerate(holds(t)) if k} for t in found]
            while len(chosen) < cap and left:
                best = max(range(len(found)), key=lambda j: (len(held[j] & left), -j))
                if not held[best] & left:
                    break
                chosen.append(best)
                left -= held[best]
            rest = [j for j in range(len(found)) if j not in chosen]
            rng.shuffle(rest)
            found = [found[j] for j in sorted([*chosen, *rest[: cap - len(chosen)]])]
        return found, tw, th

    def many(x: dict[str, np.ndarray], owner: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        boxes = list(zip(*(x[c].astype(float).tolist() for c in ("x1", "y1", "x2", "y2")), strict=True))
        images, ends = zip(*(x[c][first].tolist() for c in ("image_id", "width", "height")), strict=True), [*first[1:].tolist(), len(owner)]
        made = [one(int(i), int(w), int(h), boxes[a:b]) for (i, w, h), a, b in zip(images, first.tolist(), ends, strict=True)]
        of = np.repeat(np.arange(len(made)), [len(t) for t, _, _ in made])
        at = np.array([t for tiles, _, _ in made for t in tiles], np.int64).reshape(-1, 2)
        wide, tall = np.array([(w, h) for _, w, h in made], np.int64).reshape(-1, 2)[of].T
        number = np.arange(len(of)) - np.searchsorted(of, of)
        return of, {"tile": number, "x1": at[:, 0], "y1": at[:, 1], "x2": at[:, 0] + wide, "y2": at[:, 1] + tall}

    return per_batch(rows, ("image_id",), ("ann_idx",), ("image_id", "width", "height", "x1", "y1", "x2", "y2"), many, dict.fromkeys(("tile", "x1", "y1", "x2", "y2"), "int"))
