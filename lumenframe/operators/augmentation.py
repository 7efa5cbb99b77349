"""Seeded geometric copies: each draws its transforms, carries them as a record and their product as a matrix, and takes its annotations along.

A draw is the first four bytes of a SHA-256 over the copy's seed, so copies do
not depend on partitioning, and a record replays to the same matrix anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import projective as P
from lumenframe.functions.geometry import clip_polygon, polygon_area
from lumenframe.functions.text import seed_of
from lumenframe.operators import planning

KINDS = ("rotate", "scale", "shear_x", "shear_y", "shift_x", "shift_y", "flip_x", "flip_y", "perspective_x", "perspective_y")


@dataclass(frozen=True)
class Transform:
    """With chance ``p``, one of ``KINDS`` with a value between ``low`` and ``high``.

    Rotation and shear are in degrees, x towards y; shifts in parts of the side;
    perspective is how far the depth changes from the centre to the edge (under 1).
    All but shifts are about the image's centre.
    """

    kind: str
    low: float = 0.0
    high: float = 0.0
    p: float = 1.0

    def __post_init__(self) -> None:
        if self.kind not in KINDS or self.low > self.high or not 0 <= self.p <= 1:
            raise ValueError(f"not a transform: {self}")
        if self.kind == "scale" and self.low <= 0 or self.kind.startswith("perspective") and max(-self.low, self.high) >= 1 or self.kind.startswith("shear") and max(-self.low, self.high) >= 90:
            raise ValueError(f"values out of range: {self}")


def matrix_of(kind: Column, value: Column, width: Column, height: Column) -> Column:
    """Matrix of one transform."""
    c, s, t = F.cos(F.radians(value)), F.sin(F.radians(value)), F.tan(F.radians(value))
    own = (
        F.when(kind == "rotate", P.matrix(c, -s, 0, s, c, 0, 0, 0, 1))
        .when(kind == "scale", P.matrix(value, 0, 0, 0, value, 0, 0, 0, 1))
        .when(kind == "shear_x", P.matrix(1, t, 0, 0, 1, 0, 0, 0, 1))
        .when(kind == "shear_y", P.matrix(1, 0, 0, t, 1, 0, 0, 0, 1))
        .when(kind == "flip_x", P.matrix(-1, 0, 0, 0, 1, 0, 0, 0, 1))
        .when(kind == "flip_y", P.matrix(1, 0, 0, 0, -1, 0, 0, 0, 1))
        .when(kind == "shift_x", P.matrix(1, 0, value * width, 0, 1, 0, 0, 0, 1))
        .when(kind == "shift_y", P.matrix(1, 0, 0, 0, 1, value * height, 0, 0, 1))
        .when(kind == "perspective_x", P.matrix(1, 0, 0, 0, 1, 0, 2 * value / width, 0, 1))
        .when(kind == "perspective_y", P.matrix(1, 0, 0, 0, 1, 0, 0, 2 * value / height, 1))
    )
    return P.about(own, width / 2, height / 2)


def drawn(samples: DataFrame, transforms: Sequence[Transform]) -> DataFrame:
    """``samples`` (copy, copy_seed) with ``replay``, array<struct<kind, value>> of what each copy draws; originals draw nothing."""
    chance = lambda i, what: seed_of(F.col("copy_seed").cast("string"), F.lit(str(i)), F.lit(what)) / float(1 << 32)
    each = [F.when(chance(i, "p") < t.p, F.struct(F.lit(t.kind).alias("kind"), (F.lit(float(t.low)) + chance(i, "value") * float(t.high - t.low)).alias("value"))) for i, t in enumerate(transforms)]
    none = F.array().cast("array<struct<kind:string,value:double>>")
    return samples.withColumn("replay", F.when(F.col("copy") > 0, F.array_compact(F.array(*each))).otherwise(none) if each else none)


def replayed(samples: DataFrame) -> DataFrame:
    """``samples`` (replay, width, height) with the ``matrix`` that takes their original's pixels to theirs."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    return samples.withColumn("matrix", P.composed(F.transform("replay", lambda t: matrix_of(t["kind"], t["value"], w, h))))


def _points(m: Column, points: Column) -> Column:
    return F.transform(points, lambda q: q.withField("x", P.image_x(m, q["x"], q["y"])).withField("y", P.image_y(m, q["x"], q["y"])))


def transformed(annotations: DataFrame, samples: DataFrame, min_visibility: float = 0.0) -> DataFrame:
    """Annotations of images (image_id, width, height, matrix), moved by their matrices and cut to the image.

    A box becomes the box around its moved corners. Boxes and polygons stay if
    more than nothing, and at least ``min_visibility`` of their moved area, is
    inside; points and keypoints if they are inside, a pose with its box; hidden
    and outside keypoints are zero. What lies behind a perspective's horizon goes.
    """
    entries = [f"__m{i}" for i in range(9)]
    # explode keeps a matrix, and inline a box's corners, from being worked out again wherever a filter names them.
    per = samples.select("image_id", F.col("width").cast("double").alias("__w"), F.col("height").cast("double").alias("__h"), F.explode(F.array("matrix")).alias("__m"))
    rows = annotations.join(per.select("*", *(F.col("__m")[i].alias(e) for i, e in enumerate(entries))), "image_id")
    m, w, h = F.col("__m"), F.col("__w"), F.col("__h")
    kept = lambda after, before: (after > 0) & (after >= min_visibility * before)
    inside = lambda x, y: (x >= 0) & (x < w) & (y >= 0) & (y < h)
    if "polygon" in annotations.columns:
        front = F.forall("polygon", lambda q: P.depth(m, q["x"], q["y"]) > 0)
        rows = rows.where(front).withColumn("__p", _points(m, F.col("polygon")))
        whole = F.forall("__p", lambda q: (q["x"] >= 0) & (q["x"] <= w) & (q["y"] >= 0) & (q["y"] <= h))
        rows = rows.withColumn("polygon", F.when(whole, F.col("__p")).otherwise(clip_polygon("__p", F.lit(0.0), F.lit(0.0), w, h)))
        rows = rows.where(kept(polygon_area("polygon"), polygon_area("__p")))
    if "px" in annotations.columns:
        rows = rows.where(P.depth(m, F.col("px"), F.col("py")) > 0)
        rows = rows.withColumns({"px": P.image_x(m, F.col("px"), F.col("py")), "py": P.image_y(m, F.col("px"), F.col("py")), "radius": F.col("radius") * P.stretch(m, F.col("px"), F.col("py"))})
        rows = rows.where(inside(F.col("px"), F.col("py")))
    if "x1" in annotations.columns:
        flat, ends = [F.col(e) for e in entries], [(F.col(x).cast("double"), F.col(y).cast("double")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))]
        rows = rows.where(reduce(and_, (P.depth(flat, x, y) > 0 for x, y in ends)))
        places = [of(flat, x, y).alias(f"__{k}{i}") for i, (x, y) in enumerate(ends) for k, of in (("cx", P.image_x), ("cy", P.image_y))]
        rows = rows.select("*", F.inline(F.array(F.struct(*places))))
        side = lambda pick, k: pick(*(f"__{k}{i}" for i in range(4)))
        rows = rows.withColumns({"__x1": side(F.least, "cx"), "__y1": side(F.least, "cy"), "__x2": side(F.greatest, "cx"), "__y2": side(F.greatest, "cy")})
        cut = {"x1": F.greatest("__x1", F.lit(0.0)), "y1": F.greatest("__y1", F.lit(0.0)), "x2": F.least("__x2", w), "y2": F.least("__y2", h)}
        rows = rows.withColumns(cut)
        area = F.greatest(F.lit(0.0), F.col("x2") - F.col("x1")) * F.greatest(F.lit(0.0), F.col("y2") - F.col("y1"))
        rows = rows.where(kept(area, (F.col("__x2") - F.col("__x1")) * (F.col("__y2") - F.col("__y1"))))
    if "keypoints" in annotations.columns:
        zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("v"))

        def point(q: Column) -> Column:
            x, y = P.image_x(m, q["x"], q["y"]), P.image_y(m, q["x"], q["y"])
            seen = (F.coalesce(q["v"], F.lit(2.0)) > 0) & (P.depth(m, q["x"], q["y"]) > 0) & inside(x, y)
            return F.when(seen, F.struct(x.alias("x"), y.alias("y"), q["v"].alias("v"))).otherwise(zero)

        rows = rows.withColumn("keypoints", F.transform("keypoints", point))
    return rows.select(*annotations.columns)


def undone(annotations: DataFrame, samples: DataFrame) -> DataFrame:
    """:func:`transformed` by the inverses: predictions on copies in their originals' pixels; matrices without an inverse are refused."""
    back = F.coalesce(P.inverse(F.col("matrix")), F.raise_error(F.lit("a matrix has no inverse")).cast("array<double>"))
    return transformed(annotations, samples.withColumn("matrix", back))


def copies(samples: DataFrame, n: int, transforms: Sequence[Transform], seed: int = 0, include_original: bool = True, splits: Sequence[str] = ("train",)) -> DataFrame:
    """A row for each copy, with ``replay``, ``matrix`` and the original's id in ``parent_id``."""
    rows = planning.augment(samples, n, seed, include_original, splits).withColumn("parent_id", F.col("image_id"))
    rows = rows.withColumn("image_id", F.when(F.col("copy") > 0, F.xxhash64("image_id", "copy")).otherwise(F.col("image_id")))
    return replayed(drawn(rows, transforms))
