"""Resampling statistics from partial sums.

A model's (or a pair's) clusters are dealt to cells by a hash of their key. A
resample of all clusters is a multinomial draw of how many fall to each cell,
which every cell works out alike from its seed and the cells' sizes, and draws
with replacement inside the cell: together the ordinary bootstrap. A cell
returns one sum a resample; those are added up. No task holds all clusters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESAMPLES, SEED = 10_000, 42
#: Cells that a model's clusters are dealt to; a cell's sums are two numbers a resample.
CELLS = 32
#: Draws that are held at once.
DRAWN = 1 << 22


def resampled_means(values: np.ndarray, rng: np.random.Generator, resamples: int) -> np.ndarray:
    """Means of samples with replacement, in slices of bounded memory."""
    n, out = len(values), []
    step = max(1, DRAWN // max(n, 1))
    for i in range(0, resamples, step):
        out.append(values[rng.integers(0, n, (min(step, resamples - i), n))].mean(1))
    return np.concatenate(out)


def interval(values: np.ndarray, resamples: int = RESAMPLES, seed: int = SEED) -> tuple[float, float]:
    """2.5 and 97.5 percent quantiles of resampled means; NaN for fewer than two values."""
    values = values[np.isfinite(values)]
    if len(values) < 2:
        return float("nan"), float("nan")
    lo, hi = np.quantile(resampled_means(values, np.random.default_rng(seed), resamples), [0.025, 0.975])
    return float(lo), float(hi)


def paired_test(d: np.ndarray, rng: np.random.Generator, resamples: int = RESAMPLES) -> tuple[float, float, float]:
    """(low, high, p) of paired differences: resampled means, then random sign flips."""
    lo, hi = np.quantile(resampled_means(d, rng, resamples), [0.025, 0.975])
    n, hits = len(d), 0
    step = max(1, (1 << 22) // max(n, 1))
    for i in range(0, resamples, step):
        signs = rng.integers(0, 2, (min(step, resamples - i), n)) * 2 - 1
        hits += int((np.abs((signs * d).mean(1)) >= abs(d.mean()) - 1e-15).sum())
    return float(lo), float(hi), (hits + 1) / (resamples + 1)


def cell_sums(values: np.ndarray, counts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Sum of ``counts[r]`` draws with replacement from ``values``, for each resample r; in slices of bounded memory."""
    out = np.zeros(len(counts))
    at = 0
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(np.cumsum(counts[at:]), DRAWN)) + at)
        if counts[at] > DRAWN:
            left = int(counts[at])
            while left:
                k = min(left, DRAWN)
                out[at] += values[rng.integers(0, len(values), k)].sum()
                left -= k
        else:
            part = counts[at:end]
            drawn = values[rng.integers(0, len(values), int(part.sum()))]
            out[at:end] = np.bincount(np.repeat(np.arange(len(part)), part), drawn, len(part))
        at = end
    return out


def flipped_sums(values: np.ndarray, resamples: int, rng: np.random.Generator) -> np.ndarray:
    """Sum of ``values`` under random signs, for each resample."""
    out = np.zeros(resamples)
    for a in range(0, len(values), DRAWN):
        part = values[a : a + DRAWN]
        step = max(1, DRAWN // len(part))
        for i in range(0, resamples, step):
            signs = rng.integers(0, 2, (min(step, resamples - i), len(part)), np.int8) * np.int8(2) - np.int8(1)
            out[i : i + step] += signs @ part
    return out


def _seeds(seed: int, names: Sequence[str], *more: int) -> list[int]:
    return [seed, *more, *"\0".join(map(str, names)).encode()]


def partial_sums(rows: DataFrame, by: Sequence[str], value: str, resamples: int, seed: int, flips: bool = False, cells: int = CELLS) -> DataFrame:
    """(by, n, total, boot, flip): resampled and sign-flipped sums of ``value`` over each ``by``, as bytes of doubles; null and non-finite values take no part."""
    by = list(by)
    usable = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    dealt = usable.select(*by, "key", F.col(value).cast("double").alias("__v"), F.pmod(F.xxhash64("key"), F.lit(cells)).cast("int").alias("__cell"))
    sizes: dict[tuple, dict[int, int]] = {}
    for r in dealt.groupBy(*by, "__cell").agg(F.count("*").alias("n")).collect():  # models are few, and so are cells
        sizes.setdefault(tuple(r[c] for c in by), {})[r["__cell"]] = r["n"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{kinds}, n long, total double, boot binary, flip binary"

    def as_table(key: tuple, n: int, total: float, boot: np.ndarray, flip: np.ndarray) -> pa.Table:
        return pa.table({**{c: pa.array([k]) for c, k in zip(by, key, strict=True)}, "n": pa.array([n], pa.int64()), "total": pa.array([total]), "boot": pa.array([boot.tobytes()], pa.binary()), "flip": pa.array([flip.tobytes()], pa.binary())})

    def one(table: pa.Table) -> pa.Table:
        key, cell = tuple(table.column(c)[0].as_py() for c in by), table.column("__cell")[0].as_py()
        table = table.sort_by([("key", "ascending"), ("__v", "ascending")])
        values, of = table.column("__v").to_numpy(), sizes[key]
        order = sorted(of)
        n = sum(of.values())
        # Every cell draws the same table of counts and takes its own column.
        shares = np.random.default_rng(_seeds(seed, key)).multinomial(n, [of[c] / n for c in order], resamples)
        rng = np.random.default_rng(_seeds(seed, key, cell + 1))
        boot = cell_sums(values, shares[:, order.index(cell)], rng)
        return as_table(key, len(values), float(values.sum()), boot, flipped_sums(values, resamples, rng) if flips else np.zeros(0))

    def together(table: pa.Table) -> pa.Table:
        key = tuple(table.column(c)[0].as_py() for c in by)
        table = table.sort_by([("n", "ascending"), ("total", "ascending")])
        add = lambda c: np.sum([np.frombuffer(b) for b in table.column(c).to_pylist()], axis=0)
        return as_table(key, sum(table.column("n").to_pylist()), float(sum(table.column("total").to_pylist())), add("boot"), add("flip"))

    # With a number: few bytes are much work here, and must not end in one task.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = dealt.repartition(tasks, *by, "__cell").groupBy(*by, "__cell").applyInArrow(one, schema)
    return parts.groupBy(*by).applyInArrow(together, schema)  # a row a cell


def _settled(sums: DataFrame, by: Sequence[str], columns: str, row) -> DataFrame:
    """``by`` and ``columns`` that ``row`` makes of (n, total, boot, flip)."""
    by = list(by)
    names = [c.split()[0] for c in columns.split(", ")]
    schema = ", ".join(f"{c} {sums.schema[c].dataType.simpleString()}" for c in by) + f", {columns}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [row(r["n"], r["total"], np.frombuffer(r["boot"]), np.frombuffer(r["flip"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), *(pa.array(list(x)) for x in zip(*found, strict=True))], [*by, *names])

    return sums.mapInArrow(run, schema)


def _bounds(boot: np.ndarray, n: int) -> tuple[float, float]:
    if n < 2:
        return float("nan"), float("nan")
    lo, hi = np.quantile(boot / n, [0.025, 0.975])
    return float(lo), float(hi)


def bootstrap_intervals(scores: DataFrame, value: str, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(model, n, mean, low, high) of scores (model, key, value): 2.5 and 97.5 percent quantiles of resampled means, NaN for fewer than two values."""
    models = scores.select("model").distinct()
    sums = partial_sums(scores, ["model"], value, resamples, seed)
    made = _settled(sums, ["model"], "n long, mean double, low double, high double", lambda n, total, boot, _: (n, total / n, *_bounds(boot, n)))
    nan = F.lit(float("nan"))
    return models.join(made, "model", "left").select("model", F.coalesce("n", F.lit(0)).alias("n"), *(F.coalesce(c, nan).alias(c) for c in ("mean", "low", "high")))


def paired_bootstrap(pairs: DataFrame, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(model_a, model_b, n, difference, low, high, p) of pairs (model_a, model_b, key, d): resampled means, then random sign flips."""

    def row(n: int, total: float, boot: np.ndarray, flip: np.ndarray) -> tuple:
        if n < 2:
            return n, total / n, *_bounds(boot, n), float("nan")
        hits = int((np.abs(flip / n) >= abs(total / n) - 1e-15).sum())
        return n, total / n, *_bounds(boot, n), (hits + 1) / (resamples + 1)

    sums = partial_sums(pairs, ["model_a", "model_b"], "d", resamples, seed, flips=True)
    return _settled(sums, ["model_a", "model_b"], "n long, difference double, low double, high double, p double", row)
