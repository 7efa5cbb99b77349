"""Running sums and suffix maxima along an order, however many rows a key has.

Rows are dealt by ranges of (key, order), so a hot key fills as many tasks as its
rows need. A task works on its own range; what comes before it, or after it, is
one total a key and range: few rows, carried from range to range by a window
over those alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lumenframe.operators.shared import deleted, stored

PART = "__part"
PLACE = "__place"


def ranged(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, str | tuple[str, int]] | None = None, keep: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """``rows``, dealt and stored by ranges of keys and order, with the number of each row's range. ``order`` must leave no ties within a key.

    With ``sums`` (name to a column of whole numbers, or to one and the bit to count) a task that
    has its range in order also writes what :func:`running` needs of it, which then neither shuffles
    nor sorts; of the other columns only keys, those to ``keep`` and those summed whole are stored then.
    ``path``: where ``rows`` are stored already.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Dealing by ranges reads rows twice, the first time for a sample.
    plain, path = (rows, path) if path else stored(rows, "unranged")
    dealt = plain.repartitionByRange(n, *keys, *order)
    if sums:
        whole = [c for c in sums.values() if isinstance(c, str)]
        used = dict.fromkeys([*keep, *(c if isinstance(c, str) else c[0] for c in sums.values())])
        dealt = _summed(dealt.sortWithinPartitions(*keys, *order).select(*keys, *used), keys, sums).drop(*(c for c in used if c not in {*keep, *whole}))
    # Sums never fall: stored as steps they are a few bits each.
    out = stored(dealt.withColumn(PART, F.spark_partition_id()), "ranged", steps=bool(sums))[0]
    deleted(spark, path)
    return out


def _summed(rows: DataFrame, keys: Sequence[str], sums: Mapping[str, str | tuple[str, int]]) -> DataFrame:
    """Sorted ``rows`` with their place within key and task, from 1, and their running sums up to there."""
    names = {PLACE: None, **{f"__{name}": c for name, c in sums.items()}}

    def values(batch: pa.RecordBatch, c: str | tuple[str, int] | None) -> np.ndarray:
        if c is None:
            return np.ones(batch.num_rows, np.int64)
        x = pc.fill_null(batch.column(c if isinstance(c, str) else c[0]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return x if isinstance(c, str) else x >> c[1] & 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, dict.fromkeys(names, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for i, k in enumerate(keys):
                column = batch.column(k)
                column = pa.concat_arrays([column.slice(0, 1) if last is None else last[i], column])
                codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
                new |= codes[1:] != codes[:-1]
            last = [batch.column(k).slice(batch.num_rows - 1) for k in keys]
            starts = np.flatnonzero(new)
            group, made = np.cumsum(new), []
            for name, c in names.items():
                x = values(batch, c)
                total = np.cumsum(x)
                made.append(total - np.append(-carry[name], total[starts] - x[starts])[group])
                carry[name] = int(made[-1][-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v) for v in made)], [*batch.schema.names, *names])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *(StructField(name, LongType()) for name in names)]))


def _carried(totals: DataFrame, keys: Sequence[str], columns: Mapping[str, Column], backwards: bool = False) -> DataFrame:
    """``columns``, aggregates over a key's other ranges before (or after) each range, of ``totals``, a row a key and range."""
    order = Window.partitionBy(*keys).orderBy(F.desc(PART) if backwards else F.asc(PART)).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, PART, *(c.over(order).alias(name) for name, c in columns.items()))


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, str | tuple[str, int]], number: str = "k") -> DataFrame:
    """``rows`` of :func:`ranged` with their 1-based ``number`` within the key and the running ``sums`` (name to column)."""
    keys = list(keys)
    if PLACE in rows.columns:
        totals = rows.groupBy(*keys, PART).agg(F.max(PLACE).alias("__n"), *(F.max_by(f"__{name}", PLACE).alias(f"__{name}") for name in sums))
        before = _carried(totals, keys, {"__n0": F.sum("__n"), **{f"__{name}0": F.sum(f"__{name}") for name in sums}})
        both = rows.join(F.broadcast(before), [*keys, PART])  # a row a range, and one more a key: models and classes are few
        added = {number: (PLACE, "__n0"), **{name: (f"__{name}", f"__{name}0") for name in sums}}
        out = both.withColumns({name: F.col(inner) + F.coalesce(outer, F.lit(0)) for name, (inner, outer) in added.items()})
        return out.drop(*(c for pair in added.values() for c in pair))
    totals = rows.groupBy(*keys, PART).agg(F.count("*").alias("__n"), *(F.sum(c).alias(f"__{name}") for name, c in sums.items()))
    before = _carried(totals, keys, {"__n0": F.sum("__n"), **{f"__{name}0": F.sum(f"__{name}") for name in sums}})
    along = Window.partitionBy(*keys, PART).orderBy(*order)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({"__i": F.row_number().over(along), **{name: F.sum(c).over(upto) for name, c in sums.items()}})
    both = inside.join(before, [*keys, PART])
    carried = lambda inner, outer: F.col(inner) + F.coalesce(outer, F.lit(0))
    out = both.withColumns({number: carried("__i", "__n0"), **{name: carried(name, f"__{name}0") for name in sums}})
    return out.drop("__i", "__n0", *(f"__{name}0" for name in sums))


def suffix_max(rows: DataFrame, keys: Sequence[str], number: str, value: str, name: str) -> DataFrame:
    """``rows`` with the largest ``value`` of their key from their ``number`` on."""
    return suffix_maxima(rows, keys, number, {name: value})


def suffix_maxima(rows: DataFrame, keys: Sequence[str], number: str, values: Mapping[str, str]) -> DataFrame:
    """``rows`` with the largest of each of the ``values`` (name to column) of their key from their ``number`` on."""
    keys = list(keys)
    totals = rows.groupBy(*keys, PART).agg(*(F.max(value).alias(f"__{name}") for name, value in values.items()))
    after = _carried(totals, keys, {f"__{name}1": F.max(f"__{name}") for name in values}, backwards=True)
    back = Window.partitionBy(*keys, PART).orderBy(F.desc(number)).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.withColumns({name: F.max(value).over(back) for name, value in values.items()}).join(after, [*keys, PART])
    return both.withColumns({name: F.greatest(name, f"__{name}1") for name in values}).drop(*(f"__{name}1" for name in values))
