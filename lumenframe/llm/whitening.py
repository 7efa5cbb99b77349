"""Whitening of embeddings from streamed moments.

Each task runs over its vectors with Welford's update: mean and scatter matrix
move by one rank-one term a vector, so nothing cancels however far from zero
the vectors lie; sums are kept as whole numbers beside them. Parts of tasks are
merged, sixteen at a time, by the parallel update formula, on the executors,
until one is left. The driver solves its covariance, a matrix of the vectors'
dimensions, by Householder reflections to tridiagonal form and implicitly
shifted symmetric QR steps. A second pass projects, and the same moments of
what it wrote tell how far its covariance is from the identity.

Results in odd cases: vectors that are null or hold a null or non-finite entry
take no part; repeated rows and ids, null ids among them, each keep their rows;
vectors of another length are a fit list of their own; components whose
eigenvalue is zero to rounding have a null ``whitened``; a ``deviation`` over
what a long holds is null; an empty table, and empty vectors, give no rows.
Entries for which ``floor(scale * c)`` leaves 2^52 raise.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import small_batches, stored

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Parts that one merge takes: what it holds is so many matrices.
FAN = 16
PART = "dim int, part int, n long, sums array<decimal(38,0)>, mean array<double>, scatter binary"


@dataclass
class Moments:
    """Count, mean and scatter matrix (sum of centred outer products) of vectors; ``sums`` of whole-numbered ones."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def empty(cls, dim: int, whole: bool) -> Moments:
        return cls(0, [0] * dim if whole else [], np.zeros(dim), np.zeros((dim, dim)))

    def add(self, block: np.ndarray) -> None:
        """Vectors one by one, by Welford's rank-one update."""
        if self.sums:
            self.sums = [a + b for a, b in zip(self.sums, block.sum(0).tolist(), strict=True)]
        for x in block.astype(float):
            self.n += 1
            off = x - self.mean
            self.mean += off / self.n
            self.scatter += np.multiply.outer(off, off * ((self.n - 1) / self.n))

    def merge(self, other: Moments) -> Moments:
        """Of both parts' vectors, by the parallel update formula."""
        n = self.n + other.n
        off = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.multiply.outer(off, off) * (self.n / n * other.n)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], self.mean + off * (other.n / n), scatter)


def as_batch(found: list[tuple[int, int, Moments]]) -> pa.RecordBatch:
    columns = [pa.array([d for d, _, _ in found], pa.int32()), pa.array([p for _, p, _ in found], pa.int32()), pa.array([m.n for _, _, m in found], pa.int64())]
    columns += [pa.array([list(map(Decimal, m.sums)) for _, _, m in found], pa.list_(pa.decimal128(38, 0))), pa.array([m.mean.tolist() for _, _, m in found], pa.list_(pa.float64())), pa.array([m.scatter.tobytes() for _, _, m in found], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["dim", "part", "n", "sums", "mean", "scatter"])


def from_row(row: dict) -> Moments:
    dim = len(row["mean"])
    return Moments(row["n"], [int(s) for s in row["sums"]], np.array(row["mean"], float), np.frombuffer(row["scatter"]).reshape(dim, dim).copy())


def blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of a batch's lists, those of one length together."""
    sizes = np.asarray(column.value_lengths())
    flat, ends = np.asarray(column.flatten()), np.cumsum(sizes)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        if dim:
            yield at, flat[(ends[at] - dim)[:, None] + np.arange(dim)]


def moments(vectors: DataFrame, column: str) -> dict[int, Moments]:
    """Moments by length of the lists in ``column``, which have no null entries."""
    whole = vectors.schema[column].dataType.elementType.typeName() in ("long", "integer")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[int, Moments] = {}
        for batch in batches:
            for _, block in blocks(batch.column(0)):
                found.setdefault(block.shape[1], Moments.empty(block.shape[1], whole)).add(block)
        yield as_batch([(d, TaskContext.get().partitionId(), m) for d, m in sorted(found.items())])

    def together(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        total = from_row(rows[0])
        for r in rows[1:]:
            total = total.merge(from_row(r))
        return pa.Table.from_batches([as_batch([(rows[0]["dim"], rows[0]["slot"], total)])])

    parts = vectors.select(column).mapInArrow(stream, PART)
    left = vectors.rdd.getNumPartitions()
    while left > 1:
        parts = parts.withColumn("slot", F.floor(F.col("part") / FAN).cast("int")).groupBy("dim", "slot").applyInArrow(together, PART)
        left = -(-left // FAN)
    return {r["dim"]: from_row(r.asDict()) for r in parts.collect()}  # one row for each length of vectors


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with ``q.T @ a @ q`` tridiagonal, by Householder reflections."""
    a, n = np.array(a, float), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if norm == 0:
            continue
        v[0] += np.copysign(norm, v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix."""
    d, e, q = tridiagonal(a)
    q = np.ascontiguousarray(q.T)  # a vector a row: rotations run over whole rows
    eps, hi = np.finfo(float).eps, len(d) - 1
    while hi > 0:
        small = np.abs(e[:hi]) <= eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0.0
        if small[hi - 1]:
            hi -= 1
            continue
        lo = hi - 1
        while lo > 0 and not small[lo - 1]:
            lo -= 1
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k] = c * c * dk + 2 * c * s * ek + s * s * dn
            d[k + 1] = s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    return d[order], q[order].T


@dataclass
class Projection:
    """What whitens the vectors of one length."""

    n: int
    sums: list[int]
    matrix: np.ndarray  # dimensions x components that have an eigenvalue over zero
    explained: list[float | None]  # of all components asked for


def projection(m: Moments, components: int = COMPONENTS) -> Projection:
    values, vectors = symmetric_qr(m.scatter / m.n)
    asked = min(components, len(values))
    trace = float(np.trace(m.scatter) / m.n)
    used = int((values[:asked] > len(values) * np.finfo(float).eps * max(values[0], 0.0)).sum())
    return Projection(m.n, m.sums, vectors[:, :used] / np.sqrt(values[:used]), [float(max(v, 0.0)) / trace if trace > 0 else None for v in values[:asked]])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - sum)^2, exactly."""
    reach = max((abs(n * int(e) - s) for col, s in zip(x.T, sums, strict=True) for e in (col.min(), col.max())), default=0)
    if n * int(np.abs(x).max(initial=0)) < 2**62 and reach**2 * x.shape[1] < 2**63:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(1).tolist()
    exact = [sum((n * e - s) ** 2 for e, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whole_vectors(rows: DataFrame, vector: str, keep: list[str], x: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``keep`` and ``x``, the list of floor(scale * c) + shift, of rows whose vector is usable."""
    entry = lambda c: c.cast("double")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(entry(c)) | (F.abs(entry(c)) == float("inf")))
    wide = F.exists(vector, lambda c: F.abs(entry(c) * scale) >= float(2**52))
    good = rows.where(F.col(vector).isNotNull()).where(~bad)
    whole = F.transform(vector, lambda c: F.floor(entry(c) * scale).cast("long") + F.lit(shift).cast("long"))
    return good.select(*keep, F.when(wide, F.raise_error(F.lit("an entry is too large")).cast("array<bigint>")).otherwise(whole).alias(x))


def whiten(spark: SparkSession, rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every usable vector."""
    small_batches(spark)
    x = f"x_{uuid.uuid4().hex}"
    fit = whole_vectors(rows.select(rows[key].alias(key), rows[vector].alias("v")), "v", [key], x, scale, shift)
    by_dim = {d: projection(m, components) for d, m in moments(fit, x).items()}
    sent = spark.sparkContext.broadcast({d: (p.n, p.sums, p.matrix) for d, p in by_dim.items()})  # a matrix a length of vectors
    kind = fit.schema[key].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in blocks(batch.column(1)):
                n, sums, matrix = sent.value[block.shape[1]]
                centred = block - np.array([s / n for s in sums])
                white = (centred @ matrix).tolist()
                columns = [batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), block.shape[1]), pa.int32()), pa.array(deviations(block, n, sums), pa.int64()), pa.array(white, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "dim", "deviation", "white"])

    made = stored(spark, fit.mapInArrow(project, f"id {kind}, dim int, deviation long, white array<double>"), "whitened")
    sent.destroy()
    error = {d: float(np.abs(m.scatter / m.n - np.eye(len(m.mean))).max()) for d, m in errors(made, by_dim).items()}

    def of_dim(value: dict[int, Column], kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for d, c in value.items():
            out = F.when(F.col("dim") == d, c).otherwise(out)
        return out

    explained = of_dim({d: F.array(*(F.lit(v).cast("double") for v in p.explained)) for d, p in by_dim.items()}, "array<double>")
    each = made.select("id", F.posexplode(explained).alias("i", "explained"), of_dim({d: F.lit(p.n) for d, p in by_dim.items()}, "long").alias("n"), "deviation", "white", of_dim({d: F.lit(v) for d, v in error.items()}, "double").alias("identity_error"))
    return each.select(F.col("id").alias(key), (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", F.get("white", F.col("i")).alias("whitened"), "explained", "identity_error")


def errors(made: DataFrame, by_dim: dict[int, Projection]) -> dict[int, Moments]:
    """Moments of the whitened rows, by length of the vectors that they come from."""
    return {d: found for d, p in by_dim.items() if p.matrix.shape[1] and (found := moments(made.where(F.col("dim") == d), "white").get(p.matrix.shape[1]))}
