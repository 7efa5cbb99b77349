"""Plane transforms as 3 x 3 matrices in columns: nine doubles, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(*entries: Column | float) -> Column:
    """Of nine entries; numbers or columns."""
    return F.array(*(e.cast("double") if isinstance(e, Column) else F.lit(float(e)) for e in entries))


def identity() -> Column:
    return matrix(1, 0, 0, 0, 1, 0, 0, 0, 1)


def product(a: Column, b: Column) -> Column:
    """``a`` after ``b``."""
    return F.array(*(sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)))


def composed(matrices: Column) -> Column:
    """Of an array of matrices in the order in which they apply."""
    return F.aggregate(matrices, identity(), lambda done, m: product(m, done))


def about(m: Column, x: Column, y: Column) -> Column:
    """``m`` with the point (x, y) as its origin."""
    return composed(F.array(matrix(1, 0, -x, 0, 1, -y, 0, 0, 1), m, matrix(1, 0, x, 0, 1, y, 0, 0, 1)))


def minor(m: Column, i: int, j: int) -> Column:
    r, c = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
    at = lambda p, q: m[3 * p + q]
    return at(r[0], c[0]) * at(r[1], c[1]) - at(r[0], c[1]) * at(r[1], c[0])


def determinant(m: Column) -> Column:
    return m[0] * minor(m, 0, 0) - m[1] * minor(m, 0, 1) + m[2] * minor(m, 0, 2)


def inverse(m: Column) -> Column:
    """Null where there is none."""
    det = F.nullif(determinant(m), F.lit(0.0))
    return F.when(det.isNotNull(), F.array(*((minor(m, j, i) * (1 if (i + j) % 2 == 0 else -1)) / det for i in range(3) for j in range(3))))


def depth(m: Column, x: Column, y: Column) -> Column:
    """The third coordinate of a point's image: the point is in front where it is over 0."""
    return m[6] * x + m[7] * y + m[8]


def image_x(m: Column, x: Column, y: Column) -> Column:
    return (m[0] * x + m[1] * y + m[2]) / depth(m, x, y)


def image_y(m: Column, x: Column, y: Column) -> Column:
    return (m[3] * x + m[4] * y + m[5]) / depth(m, x, y)


def stretch(m: Column, x: Column, y: Column) -> Column:
    """By how much lengths grow at a point: the root of the area's growth."""
    return F.sqrt(F.abs(determinant(m) / F.pow(depth(m, x, y), 3)))
