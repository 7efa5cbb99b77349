"""Geometry as column expressions, inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    """The four columns of a box."""
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def box_area(b: tuple[Column, ...]) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), width) * F.greatest(F.lit(0.0), height)


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union; 0 where a box is missing or the union empty."""
    inter = intersection(a, b)
    return F.coalesce(F.try_divide(inter, box_area(a) + box_area(b) - inter), F.lit(0.0))


def box_ios(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over the smaller box."""
    return F.coalesce(F.try_divide(intersection(a, b), F.least(box_area(a), box_area(b))), F.lit(0.0))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: inside lambdas a column is worked out anew wherever it is named."""
    return F.get(F.transform(F.array(value), body), 0)


def polygon_area(points: Column | str) -> Column:
    """Shoelace area of array<struct<x, y>>."""

    def area(p: Column) -> Column:
        n = F.size(p)
        edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(p, i).alias("p"), F.get(p, (i + 1) % n).alias("q")))
        total = F.aggregate(edges, F.lit(0.0), lambda a, e: a + (e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]))
        return F.when(n >= 3, F.abs(total) / 2).otherwise(F.lit(0.0))

    return bound(_col(points), area)


def polygon_bounds(points: Column | str) -> Column:
    """struct<x1, y1, x2, y2>."""
    p = _col(points)
    xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def clip_polygon(points: Column | str, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The part of a polygon inside a box, cut by one side after the other; empty without overlap. Parts of a concave polygon stay joined along the box's sides."""
    side = lambda a, b, c: F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), c.cast("double").alias("c"))
    sides = F.array(side(1, 0, -x1), side(-1, 0, x2), side(0, 1, -y1), side(0, -1, y2))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def cut(acc: Column, h: Column) -> Column:
        depth = lambda p: h["a"] * p["x"] + h["b"] * p["y"] + h["c"]
        deep = F.transform(acc, lambda p: F.struct(p.alias("p"), depth(p).alias("d")))

        def step(f: Column, s: Column) -> Column:
            p, q, d, e = f["p"], s["p"], f["d"], s["d"]
            t = F.try_divide(d, d - e)
            # On the side itself, the cut coordinate is the side's.
            met = point(F.when(h["a"] != 0, -h["c"] / h["a"]).otherwise(p["x"] + t * (q["x"] - p["x"])), F.when(h["b"] != 0, -h["c"] / h["b"]).otherwise(p["y"] + t * (q["y"] - p["y"])))
            return F.when((d >= 0) & (e >= 0), F.array(q)).when(d >= 0, F.array(met)).when(e >= 0, F.array(met, q)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))

        around = lambda v: F.zip_with(v, F.concat(F.slice(v, 2, F.size(v)), F.slice(v, 1, 1)), step)
        return F.when(F.size(acc) > 0, F.flatten(bound(deep, around))).otherwise(acc)

    start = F.transform(_col(points), lambda q: point(q["x"].cast("double"), q["y"].cast("double")))
    # A polygon that is inside as a whole only starts at another corner, a step further after each side.
    inside = lambda v: F.forall(v, lambda q: (q["x"] >= x1) & (q["x"] <= x2) & (q["y"] >= y1) & (q["y"] <= y2))
    turned = lambda v: F.concat(F.slice(v, 4 % F.size(v) + 1, F.size(v)), F.slice(v, 1, 4 % F.size(v)))
    return bound(start, lambda v: F.when((F.size(v) > 0) & inside(v), turned(v)).otherwise(F.aggregate(sides, v, cut)))


def moved(points: Column | str, dx: Column, dy: Column, sx: Column | float = 1.0, sy: Column | float = 1.0) -> Column:
    """Points scaled, then translated."""
    return F.transform(_col(points), lambda q: q.withField("x", q["x"] * sx + dx).withField("y", q["y"] * sy + dy))


def oks(gt: Column | str, pred: Column | str, area: Column | str, sigmas: Column | None = None) -> Column:
    """Object keypoint similarity over visible keypoints (v null or above 0); null without one. Sigma is 0.1 by default, area 1 at least."""
    g, p, a = _col(gt), _col(pred), F.greatest(_col(area), F.lit(1.0))
    sigma = sigmas if sigmas is not None else F.transform(g, lambda _: F.lit(0.1))
    three = F.zip_with(F.arrays_zip(g.alias("g"), p.alias("p")), sigma, lambda z, s: F.struct(z["g"].alias("g"), z["p"].alias("p"), s.alias("s")))
    seen = F.filter(three, lambda t: t["g"].isNotNull() & t["p"].isNotNull() & (F.coalesce(t["g"]["v"], F.lit(2.0)) > 0))
    one = lambda t, size: F.exp(-(F.pow(t["g"]["x"] - t["p"]["x"], 2) + F.pow(t["g"]["y"] - t["p"]["y"], 2)) / (2 * size * F.pow(2 * t["s"], 2) + 1e-12))
    of = F.struct(seen.alias("seen"), a.alias("size"))
    return bound(of, lambda o: F.try_divide(F.aggregate(o["seen"], F.lit(0.0), lambda x, t: x + one(t, o["size"])), F.size(o["seen"])))


def point_distance(x1: Column, y1: Column, x2: Column, y2: Column, radius: Column) -> Column:
    """Distance of two points in radii; null without a radius."""
    return F.try_divide(F.hypot(x1 - x2, y1 - y2), radius)


def ratio(a: Column, b: Column) -> Column:
    """Null where undefined."""
    return F.try_divide(a.cast("double"), b)


def ratio0(a: Column, b: Column) -> Column:
    """0 where undefined."""
    return F.coalesce(ratio(a, b), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio0(2 * tp, 2 * tp + fp + fn)


def grid_cell(x: Column, cells: int) -> Column:
    """Cell of a normalised coordinate, clipped to the grid."""
    return F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(0.999999)) * cells).cast("int")


def softmax(logits: Column | str) -> Column:
    z = _col(logits)
    e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def sigmoid(x: Column | str) -> Column:
    """Stable for either sign."""
    v = _col(x)
    return F.when(v >= 0, 1 / (1 + F.exp(-v))).otherwise(F.exp(v) / (1 + F.exp(v)))


def argmax(values: Column | str) -> Column:
    """First index of the maximum, from 0."""
    v = _col(values)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")
