"""Exact top-k inner-product search with multi-resolution segment statistics.

Vectors are turned by an orthogonal rotation, fitted to a bounded sample, that
puts the directions of large variance first. At 1, 4 and 16 segments, the first
coordinates are segments of their own and the rest is the last one; every
vector keeps each segment's mean and deviation. By Cauchy-Schwarz,
``sum_s n_s (m_q m_v + d_q d_v)`` bounds the inner product from above, which
bounds the squared distance ``|q|^2 + |v|^2 - 2 <q, v>`` from below; more
segments tighten it. A pair is dropped, at the coarsest level that can, once
its bound falls under the k-th best exact score that the task has seen for the
query; survivors get the exact integer product.

Queries and candidates meet in blocks of bounded size, dealt to cells; a task
leaves at most k candidates a query.

Results in odd cases: null vectors, and those holding null or non-finite
components, take no part; vectors of unlike lengths never meet (a query then
sees those of its own length); fewer than k candidates give all; rows that
share an id are rows of their own, as queries and as candidates, and a row is
left out for itself only; equal scores go by vec_id, a null id last; a component
or a score among the k best beyond 64 bits raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import shuffle_partitions, small_batches, stored

#: Candidates and queries in a block; with 64 components a block is 1 MB at most.
BLOCK, QUERIES = 2048, 512
LEVELS = (1, 4, 16)
#: Most vectors of each length that the rotation is fitted to.
SAMPLE = 2000

PACKED = "dim int, block long, row binary, id binary, has_id binary, data binary"


def packed(rows: DataFrame, most: int) -> DataFrame:
    """(PACKED) blocks of at most ``most`` vectors of one length, from rows (row, vec_id, v binary of longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        number = TaskContext.get().partitionId() << 33

        def block(size: int) -> pa.RecordBatch:
            nonlocal number
            rows, ids, data = zip(*held.pop(size), strict=True)
            number += 1
            has = np.array([i is not None for i in ids])
            columns = [pa.array([size // 8], pa.int32()), pa.array([number], pa.int64())]
            parts = (np.array(rows, np.int64), np.array([i or 0 for i in ids], np.int64), has)
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([x.tobytes()], pa.binary()) for x in parts), pa.array([b"".join(data)], pa.binary())], ["dim", "block", "row", "id", "has_id", "data"])

        for batch in batches:
            for r, i, v in zip(*(batch.column(c).to_pylist() for c in ("row", "vec_id", "v")), strict=True):
                mine = held.setdefault(len(v), [])
                mine.append((r, i, v))
                if len(mine) == most:
                    yield block(len(v))
        for size in list(held):
            yield block(size)

    return rows.mapInArrow(run, PACKED)


def quantised(vectors: DataFrame, is_query: F.Column) -> DataFrame:
    """(row, vec_id, asked, v): floor(256 x) as packed longs, rows that can take part only."""
    fit = F.expr("embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('Infinity'))")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            sizes = column.value_lengths().to_numpy()
            x = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            if len(x) and np.abs(x).max() >= 2.0**63:
                raise OverflowError("a component is beyond 64 bits")
            raw, ends = x.astype(np.int64).tobytes(), 8 * np.cumsum(sizes)
            v = [raw[e - 8 * n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), batch.column("asked"), pa.array(v, pa.binary())], ["row", "vec_id", "asked", "v"])

    rows = vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("asked")).where(fit)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "asked", "embedding").mapInArrow(run, "row long, vec_id long, asked boolean, v binary")


def rotations(rows: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """By length, orthonormal directions of falling second moment, fitted to at most ``sample`` vectors, those of the smallest hashes."""
    sized = rows.select(F.length("v").alias("size"), F.xxhash64("row").alias("h"), "v")
    picked = sized.withColumn("k", F.row_number().over(Window.partitionBy("size").orderBy("h"))).where(F.col("k") <= sample).select("size", "v")
    by: dict[int, list[np.ndarray]] = {}
    for r in picked.collect():
        by.setdefault(r["size"] // 8, []).append(np.frombuffer(r["v"], np.int64).astype(np.float64))
    return {d: np.linalg.eigh(np.stack(x).T @ np.stack(x))[1][:, ::-1] for d, x in by.items() if d}


def statistics(turned: np.ndarray, segments: int) -> np.ndarray:
    """Single coordinates, and mean and deviation of the last segment scaled by the root of its length: a dot product of two such rows is the bound."""
    head, rest = turned[:, : segments - 1], turned[:, segments - 1 :]
    scale = np.sqrt(rest.shape[1])
    return np.hstack([head, rest.mean(1, keepdims=True) * scale, rest.std(1, keepdims=True) * scale])


def products(q: np.ndarray, c: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs (qi, ci): as longs, or as unbounded integers where those could overflow."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53 and 8 * len(qi) > len(q) * len(c):
        return (q.astype(np.float64) @ c.astype(np.float64).T)[qi, ci].astype(np.int64)  # exact below 2^53
    if most >= 2.0**63:
        q, c = q.astype(object), c.astype(object)
    out = np.empty(len(qi), q.dtype)
    for i in range(0, len(qi), 1 << 16):
        j = slice(i, i + (1 << 16))
        out[j] = (q[qi[j]] * c[ci[j]]).sum(1)
    return out


class Side:
    """Unpacked vectors of a block with their statistics at every level."""

    def __init__(self, row: bytes, ids: bytes, has: bytes, data: bytes, dim: int, turn: np.ndarray | None) -> None:
        self.row, self.id, self.has = np.frombuffer(row, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(has, bool)
        self.v = np.frombuffer(data, np.int64).reshape(len(self.row), dim)
        x = self.v.astype(np.float64)
        self.norm = np.sqrt((x**2).sum(1))
        self.levels = [statistics(x @ turn, s) for s in LEVELS if s <= dim] if turn is not None else []


def best_of_block(q: Side, c: Side, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(query index, candidate index, score) of each query's k best in a block among those that reach ``kth``, exact; and how many pairs are left after each level."""
    n, m = len(q.row), len(c.row)
    own = q.row[:, None] == c.row[None, :]
    slack = 1e-9 * q.norm[:, None] * c.norm.max(initial=0) + 1e-6
    if q.levels and m > k and np.isneginf(kth).any():
        # A first threshold: the exact scores of the k best by the means alone.
        guess = q.levels[-1][:, :-1] @ c.levels[-1][:, :-1].T
        guess[own] = -np.inf
        at = np.argpartition(-guess, k - 1, axis=1)[:, :k]
        score = products(q.v, c.v, np.repeat(np.arange(n), k), at.ravel()).astype(np.float64).reshape(n, k)
        score[np.take_along_axis(own, at, 1)] = -np.inf
        kth = np.maximum(kth, score.min(1))
    left = [n * m]
    qi, ci = None, None
    for a, b in zip(q.levels, c.levels, strict=True):
        if qi is None or 4 * len(qi) > n * m:
            alive = a @ b.T + slack >= kth[:, None]
            if qi is None:
                alive &= ~own
            else:
                seen = np.zeros((n, m), bool)
                seen[qi, ci] = True
                alive &= seen
            qi, ci = np.nonzero(alive)
        else:
            keep = np.empty(len(qi), bool)
            for i in range(0, len(qi), 1 << 17):
                j = slice(i, i + (1 << 17))
                keep[j] = np.einsum("ij,ij->i", a[qi[j]], b[ci[j]]) + slack[qi[j], 0] >= kth[qi[j]]
            qi, ci = qi[keep], ci[keep]
        left.append(len(qi))
    if qi is None:
        qi, ci = np.nonzero(~own)
    return *top(qi, ci, products(q.v, c.v, qi, ci), c.id, c.has, k), left


def top(qi: np.ndarray, ci: np.ndarray, score: np.ndarray, ids: np.ndarray, has: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids[ci], ~has[ci], -score, qi)) if score.dtype != object else np.array(sorted(range(len(qi)), key=lambda i: (qi[i], -score[i], not has[ci[i]], ids[ci[i]])), int)
    qi, ci, score = qi[order], ci[order], score[order]
    keep = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < k
    return qi[keep], ci[keep], score[keep]


def search(spark: SparkSession, vectors: DataFrame, is_query: F.Column, k: int = 5, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row where ``is_query``."""
    small_batches(spark)
    rows = stored(spark, quantised(vectors, is_query), "topk-rows")
    turns = rotations(rows, sample)
    # Candidate blocks are dealt to cells; every cell gets all query blocks.
    cells = 2 * shuffle_partitions(spark)
    blocks = stored(spark, packed(rows, BLOCK), "topk-blocks").withColumn("cell", F.pmod(F.col("block") + F.shiftright("block", 33) * 7, F.lit(cells)).cast("int"))
    asked = rows.where("asked")
    asked = stored(spark, packed(asked.coalesce(max(1, min(cells, asked.count() // QUERIES))), QUERIES), "topk-queries")
    each = F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell")
    queries = asked.select("dim", *(F.col(c).alias(f"q_{c}") for c in ("block", "row", "id", "has_id", "data")), each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[int, Side] = {}
        best: dict[int, list[np.ndarray]] = {}  # by query block: query, candidate's id, whether it has one, score
        last, now = None, None
        for batch in batches:
            for r in batch.to_pylist():
                turn = turns.get(r["dim"])
                if r["q_block"] not in sides:
                    sides[r["q_block"]] = Side(r["q_row"], r["q_id"], r["q_has_id"], r["q_data"], r["dim"], turn)
                q = sides[r["q_block"]]
                if r["block"] != last:
                    last, now = r["block"], Side(r["row"], r["id"], r["has_id"], r["data"], r["dim"], turn)
                held = best.get(r["q_block"])
                kth = np.full(len(q.row), -np.inf)
                if held is not None:
                    full = np.bincount(held[0], minlength=len(kth)) == k
                    kth[full] = [float(held[3][i]) for i in np.searchsorted(held[0], np.nonzero(full)[0], side="right") - 1]
                    kth -= np.abs(kth) * 1e-12
                qi, ci, score, _ = best_of_block(q, now, kth, k)
                new = [qi, now.id[ci], now.has[ci], score]
                if held is not None:
                    new = [np.concatenate([a, b]) for a, b in zip(held, new, strict=True)]
                qi, at, score = top(new[0], np.arange(len(new[0])), new[3], new[1], new[2], k)
                best[r["q_block"]] = [qi, new[1][at], new[2][at], score]
        for block, (qi, ids, has, score) in best.items():
            q = sides[block]
            if score.dtype == object and any(not -(2**63) <= s < 2**63 for s in score):
                raise OverflowError("a score is beyond 64 bits")
            columns = [pa.array(q.row[qi]), pa.array(q.id[qi], mask=~q.has[qi]), pa.array(ids, mask=~has), pa.array(score.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "query_id", "vec_id", "score"])

    met = blocks.repartition(cells, "dim", "cell").join(queries.repartition(cells, "dim", "cell"), ["dim", "cell"]).drop("cell")
    found = met.mapInArrow(run, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
