"""Areas that polygons share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Pairs of edges that are compared at once.
AT_ONCE = 1 << 20
#: Polygons that the bits of a word tell apart.
PARTS = 62


def expanded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number within the owner) of ``counts[i]`` rows for each i."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _heights(e: np.ndarray) -> np.ndarray:
    """(pairs, n), sorted, nan at the end: the heights of all corners, and of all crossings, of the edges (pairs, edges, 4)."""
    i, j = np.triu_indices(e.shape[1], 1)
    x, y, dx, dy = e[:, :, 0], e[:, :, 1], e[:, :, 2] - e[:, :, 0], e[:, :, 3] - e[:, :, 1]
    gx, gy = x[:, j] - x[:, i], y[:, j] - y[:, i]
    cross = dx[:, i] * dy[:, j] - dy[:, i] * dx[:, j]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gx * dy[:, j] - gy * dx[:, j]) / cross
        u = (gx * dy[:, i] - gy * dx[:, i]) / cross
    met = (cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    crossing = np.where(met, y[:, i] + t * dy[:, i], np.nan)
    # Pairs that meet most often bound the width.
    most = int(met.sum(1).max(initial=0))
    if most < crossing.shape[1]:
        crossing = np.sort(crossing, 1)[:, :most]
    return np.sort(np.concatenate([e[:, :, 1], e[:, :, 3], crossing], 1), 1)


def _swept(e: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`shared_areas` of edges (pairs, edges, 4) with their parts (pairs, edges); edges of nan fill up."""
    n, wide = part.shape
    height = _heights(e)
    of, k = np.nonzero(height[:, 1:] > height[:, :-1])
    both, either = np.zeros(n), np.zeros(n)
    # Every second crossing of a polygon leaves it: which ones hold a stretch is a bit a polygon, in as many words as they need.
    word, bit = part // PARTS, np.left_shift(1, part % PARTS)
    for at in range(0, len(of), max(1, AT_ONCE // wide)):
        s, c = of[at : at + max(1, AT_ONCE // wide)], k[at : at + max(1, AT_ONCE // wide)]
        mid, high = (height[s, c] + height[s, c + 1])[:, None] / 2, height[s, c + 1] - height[s, c]
        x0, y0, x1, y1 = (e[s, :, i] for i in range(4))
        met = (np.minimum(y0, y1) <= mid) & (mid < np.maximum(y0, y1))
        with np.errstate(divide="ignore", invalid="ignore"):
            x = np.where(met, x0 + (mid - y0) * (x1 - x0) / (y1 - y0), np.inf)
        order = np.argsort(x, 1)
        x = np.take_along_axis(x, order, 1)
        in_first, in_others = np.zeros((2, len(s), wide - 1), bool)
        for w in range(int(part.max()) // PARTS + 1):
            held = np.bitwise_xor.accumulate(np.take_along_axis(np.where(met & (word[s] == w), bit[s], 0), order, 1), 1)[:, :-1]
            if w == 0:
                in_first, held = held & 1 != 0, held >> 1
            in_others = in_others | (held != 0)
        with np.errstate(invalid="ignore"):
            area = np.where(in_first | in_others, x[:, 1:] - x[:, :-1], 0.0) * high[:, None]
        both += np.bincount(s, np.where(in_first & in_others, area, 0.0).sum(1), n)
        either += np.bincount(s, area.sum(1), n)
    return both, either


def shared_areas(edges: np.ndarray, pair: np.ndarray, part: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """(intersection, union) of the polygon 0 and the union of the others of each pair, exact.

    ``edges`` (x, y, x, y) are sorted by ``pair``; ``part`` tells the polygons of
    a pair apart. Between the heights of corners and crossings all are
    trapezoids, whose area follows from their width halfway. A polygon that
    crosses itself is filled even-odd.
    """
    # No slab meets a level edge, and its ends are those of others.
    sloped = edges[:, 1] != edges[:, 3]
    edges, pair, part = edges[sloped], pair[sloped], part[sloped]
    count = np.bincount(pair, minlength=pairs)
    number = np.arange(len(pair)) - (np.cumsum(count) - count)[pair]
    inter, union = np.zeros(pairs), np.zeros(pairs)
    # Pairs of about equally many edges are swept at once, filled up to a multiple of four.
    room = -(-count // 4) * 4
    for wide in np.unique(room[room > 0]).tolist():
        some = np.flatnonzero(room == wide)
        for at in range(0, len(some), step := max(1, AT_ONCE // wide**2)):
            chosen = some[at : at + step]
            place = np.full(pairs, -1)
            place[chosen] = np.arange(len(chosen))
            rows = np.flatnonzero(place[pair] >= 0)
            e, p = np.full((len(chosen), wide, 4), np.nan), np.zeros((len(chosen), wide), np.int64)
            e[place[pair[rows]], number[rows]], p[place[pair[rows]], number[rows]] = edges[rows], part[rows]
            inter[chosen], union[chosen] = _swept(e, p)
    return inter, union


def _corners(points: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(x and y of all corners, corners of each polygon) of an array of corner lists."""
    flat = points.flatten()
    xy = [flat.field(c).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in ("x", "y")]
    broken = flat.is_null().to_numpy(zero_copy_only=False)
    return np.where(broken[:, None], np.nan, np.column_stack(xy)), points.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def ious(first: pa.Array, parts: pa.Array) -> np.ndarray:
    """IoU of each polygon and the union of its partners; 0 where one of them has under three corners or a corner that is not finite."""
    n = len(first)
    xy_a, size_a = _corners(first)
    xy_b, size_b = _corners(parts.flatten())
    owner, number = expanded(parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    # A pair's own polygon, then its partners: corners sorted by pair and part.
    shape_pair, shape_part, shape_size = np.concatenate([np.arange(n), owner]), np.concatenate([np.zeros(n, int), number + 1]), np.concatenate([size_a, size_b])
    corner, xy = np.repeat(np.arange(len(shape_size)), shape_size), np.concatenate([xy_a, xy_b])
    bad = np.bincount(shape_pair[shape_size < 3], minlength=n) + np.bincount(shape_pair[corner[~np.isfinite(xy).all(1)]], minlength=n) + (np.bincount(owner, minlength=n) == 0)
    ends = np.cumsum(shape_size)
    follow = np.arange(1, len(xy) + 1)
    follow[ends[shape_size > 0] - 1] = (ends - shape_size)[shape_size > 0]
    edges, pair, part = np.column_stack([xy, xy[follow]]), shape_pair[corner], shape_part[corner]
    keep = bad[pair] == 0
    order = np.flatnonzero(keep)[np.argsort(pair[keep], kind="stable")]
    edges, pair, part = edges[order], pair[order], part[order]
    if len(pair):
        # Where the boxes of both sides are apart nothing is shared.
        turn = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(part > 0, prepend=False) != 0))
        low, high = np.minimum.reduceat(edges[:, :2], turn), np.maximum.reduceat(edges[:, :2], turn)
        near = np.zeros(n, bool)
        near[pair[turn[::2]]] = ((low[::2] < high[1::2]) & (low[1::2] < high[::2])).all(1)
        edges, pair, part = edges[near[pair]], pair[near[pair]], part[near[pair]]
    out, count = np.zeros(n), np.bincount(pair, minlength=n)
    chunk = np.cumsum(count.astype(np.int64) ** 2) // AT_ONCE
    for c in np.unique(chunk):
        low, high = np.searchsorted(chunk, [c, c + 1])
        i, j = np.searchsorted(pair, [low, high])
        if i < j:
            inter, union = shared_areas(edges[i:j], pair[i:j] - low, part[i:j], high - low)
            out[low:high] = np.divide(inter, union, out=np.zeros(high - low), where=union > 0)
    return out


def _run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for first, parts in batches:
        yield pa.array(ious(first, parts))


def polygon_iou(first: Column | str, parts: Column | str) -> Column:
    """IoU of a polygon, array of (x, y), and the union of an array of polygons; null or broken ones have 0."""
    return F.arrow_udf(_run, DoubleType(), F.ArrowUDFType.SCALAR_ITER)(first, parts)
