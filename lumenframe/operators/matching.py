"""Matching that is sequential by nature: an equi-join finds the candidate pairs, a numpy kernel settles each image.

Groups are an image, or an image and class: bounded by what an image holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.geometry import box, box_area, intersection
from lumenframe.operators.grouped import ROW, in_order, linked, lone, per_batch
from lumenframe.operators.polygons import AT_ONCE, expanded

#: Cost of a pair that may not be matched: any number of valid pairs outweighs it.
FORBIDDEN = 1e6


def contested(rows: DataFrame, by: Sequence[str], ends: tuple[str, str], value: str | None, solve: Callable[[dict[str, np.ndarray]], dict[str, Sequence]], out: dict[str, str]) -> DataFrame:
    """A matching of each group's ``rows``, sorted by ``ends``: all of them where none shares an end with another, for many groups at once, else what ``solve`` makes of the group."""
    columns = (*ends, value) if value else ends

    def many(x: dict[str, np.ndarray], owner: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        free = lone(owner, x[ends[0]], x[ends[1]])
        of, parts = [owner[free]], {c: [x[c][free]] for c in columns}
        hard = np.flatnonzero(~free)
        for i in np.split(hard, np.flatnonzero(np.diff(owner[hard])) + 1) if len(hard) else ():
            made = solve({c: x[c][i] for c in columns})
            of.append(np.full(len(made[ends[0]]), owner[i[0]]))
            for c in columns:
                parts[c].append(np.asarray(made[c], x[c].dtype))
        return np.concatenate(of), {c: np.concatenate(p) for c, p in parts.items()}

    return per_batch(rows, by, ends, columns, many, out)


#: Cells of the cost matrices that are solved at once.
CELLS = 1 << 21


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment of rows to columns."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assign(cost.T))
    return sorted((int(i), j) for j, i in enumerate(assign_all(cost[None])[0]) if i >= 0)


def assign_all(cost: np.ndarray) -> np.ndarray:
    """The row of each column, or -1, in minimum-cost assignments of many matrices (b, n, m), n at most m: shortest augmenting paths with potentials, a step in all of them at a time."""
    b, n, m = cost.shape
    u, v = np.zeros((b, n)), np.zeros((b, m))
    row_of, every = np.full((b, m), -1), np.arange(b)
    for row in range(n):
        free = np.ones((b, m), bool)
        dist, via = np.full((b, m), np.inf), np.full((b, m), -1)
        i, j, live = np.full(b, row), np.full(b, -1), every
        while len(live):
            at = i[live]
            base = np.where(j[live] < 0, 0.0, dist[live, j[live]])
            reached = cost[live, at] - u[live, at][:, None] - v[live] + base[:, None]
            better = free[live] & (reached < dist[live])
            dist[live] = np.where(better, reached, dist[live])
            via[live] = np.where(better, j[live][:, None], via[live])
            j[live] = np.argmin(np.where(free[live], dist[live], np.inf), axis=1)
            free[live, j[live]] = False
            i[live] = row_of[live, j[live]]
            live = live[i[live] >= 0]
        reach = dist[every, j]
        done = ~free
        done[every, j] = False
        u[:, row] += reach
        k, c = np.nonzero(done)
        gain = reach[k] - dist[k, c]
        u[k, row_of[k, c]] += gain
        v[k, c] -= gain
        k, c = every, j
        while len(k):
            back = via[k, c]
            row_of[k, c] = np.where(back < 0, row, row_of[k, back])
            k, c = k[back >= 0], back[back >= 0]
    return row_of


def best_pairs(owner: np.ndarray, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Indices of the pairs that each group keeps: as many as can be and, among those, of most ``value``. Groups of one size are solved together."""

    def ranks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.unique(x, return_inverse=True)[1]
        ends, at = np.unique(group * (x.max() + 1) + x, return_inverse=True)
        sizes = np.bincount(ends // (x.max() + 1), minlength=groups)
        return at - (np.cumsum(sizes) - sizes)[group], sizes

    if not len(owner):
        return np.zeros(0, int)
    group = np.unique(owner, return_inverse=True)[1]
    groups = group[-1] + 1
    (i, n), (j, m) = ranks(left), ranks(right)
    turned = n > m
    i, j = np.where(turned[group], j, i), np.where(turned[group], i, j)
    n, m = np.minimum(n, m), np.maximum(n, m)
    first = np.searchsorted(group, np.arange(groups + 1))
    taken = []
    order = np.lexsort((m, n))
    for same in np.split(order, np.flatnonzero(np.diff(n[order]) | np.diff(m[order])) + 1):
        rows, columns = n[same[0]], m[same[0]]
        most = max(1, CELLS // int(rows * columns))
        for some in (same[a : a + most] for a in range(0, len(same), most)):
            sizes = first[some + 1] - first[some]
            mine = np.repeat(first[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            of = np.repeat(np.arange(len(some)), sizes)
            cost, pair = np.full((len(some), rows, columns), FORBIDDEN), np.full((len(some), rows, columns), -1)
            cost[of, i[mine], j[mine]], pair[of, i[mine], j[mine]] = -value[mine], mine
            row_of = assign_all(cost)
            k, c = np.nonzero(row_of >= 0)
            found = pair[k, row_of[k, c], c]
            taken.append(found[found >= 0])
    return np.sort(np.concatenate(taken))


def optimal_matching(pairs: DataFrame, by: tuple[str, ...] = ("model", "image_id"), similarity: str = "iou") -> DataFrame:
    """The matching of most valid pairs and, among those, of most similarity. ``pairs``: by, ann_idx, pred_idx, similarity; all of them valid."""
    ends = ("ann_idx", "pred_idx")

    def many(x: dict[str, np.ndarray], owner: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        free = lone(owner, *(x[c] for c in ends))
        hard = np.flatnonzero(~free)
        free[hard[best_pairs(owner[hard], *(x[c][hard] for c in (*ends, similarity)))]] = True
        return owner[free], {c: v[free] for c, v in x.items()}

    return per_batch(pairs, by, ends, (*ends, similarity), many, {"ann_idx": "int", "pred_idx": "int", similarity: "double"})


def by_score(x: dict[str, np.ndarray], owner: np.ndarray, similarity: str, smaller_is_better: bool) -> np.ndarray:
    """Order of candidate pairs by group: predictions in score order, the best candidate of each first."""
    sign = 1 if smaller_is_better else -1
    return np.lexsort((sign * x["ann_idx"], sign * x[similarity], x["pred_idx"], -x["score"], owner))


def greedy_matching(pairs: DataFrame, by: tuple[str, ...] = ("model", "image_id", "class_id"), smaller_is_better: bool = False, similarity: str = "iou") -> DataFrame:
    """Predictions in score order each take the best unused truth; ties go to the highest truth index, or the lowest where smaller is better.

    An image's predictions meet only its own truths, so the order over all images need not be gathered.
    """

    def many(x: dict[str, np.ndarray], owner: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        order = by_score(x, owner, similarity, smaller_is_better)
        i = order[in_order(owner[order], x["ann_idx"][order], x["pred_idx"][order])]
        return owner[i], {c: x[c][i] for c in ("ann_idx", "pred_idx")}

    return per_batch(pairs, by, ("pred_idx", "ann_idx"), ("ann_idx", "pred_idx", "score", similarity), many, {"ann_idx": "int", "pred_idx": "int"})


def greedy_hits(predictions: DataFrame, pairs: DataFrame, thresholds: Sequence[float], by: tuple[str, ...] = ("model", "image_id", "class_id"), smaller_is_better: bool = False, similarity: str = "iou") -> DataFrame:
    """(by, pred_idx, score, hits) of all ``predictions``: the bit of every threshold at which :func:`greedy_matching`, anew among the ``pairs`` valid there, gives one a truth.

    Predictions meet their pairs where both lie, so what has been matched need not travel to those without a truth.
    """

    def many(x: dict[str, np.ndarray], owner: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        fresh = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (x["pred_idx"][1:] != x["pred_idx"][:-1])))
        paired = np.flatnonzero(~np.isnan(x[similarity]))
        pair = {c: v[paired] for c, v in x.items()}
        order = by_score(pair, owner[paired], similarity, smaller_is_better)
        group, truth, pred, near = owner[paired][order], pair["ann_idx"][order].astype(np.int64), pair["pred_idx"][order], pair[similarity][order]
        bits = np.zeros(len(owner), np.int64)
        for i, t in enumerate(thresholds):
            valid = np.flatnonzero(near <= t if smaller_is_better else near >= t)
            bits[paired[order[valid[in_order(group[valid], truth[valid], pred[valid])]]]] |= 1 << i
        # At different thresholds a prediction may take different truths, but at each only one.
        return owner[fresh], {ROW: fresh, "pred_idx": x["pred_idx"][fresh], "hits": np.add.reduceat(bits, fresh)}

    ends = [*by, "pred_idx"]
    both = predictions.select(*ends, "score").join(pairs.select(*ends, "ann_idx", similarity), ends, "left")
    return per_batch(both, by, ("pred_idx", "ann_idx"), ("ann_idx", "pred_idx", "score", similarity), many, {"pred_idx": "int", "hits": "long"}, ["score"])


def nearest_matching(pairs: DataFrame, most: float = 50.0, by: tuple[str, ...] = ("model", "image_id")) -> DataFrame:
    """Closest pairs first, each end once, up to a distance; classes do not matter."""

    def many(x: dict[str, np.ndarray], owner: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        i = in_order(owner, x["ann_idx"], x["pred_idx"])
        return owner[i], {c: v[i] for c, v in x.items()}

    near = pairs.where(F.col("distance") <= most)
    return per_batch(near, by, ("distance", "ann_idx", "pred_idx"), ("ann_idx", "pred_idx", "distance"), many, {"ann_idx": "int", "pred_idx": "int", "distance": "double"})


def bipartite_matching(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A maximum matching of the edges (left, right), by breadth-first augmenting paths."""
    edges: dict[int, list[int]] = {}
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        edges.setdefault(a, []).append(b)
    mate_l: dict[int, int] = {}
    mate_r: dict[int, int] = {}
    for start in edges:
        came: dict[int, int] = {}  # right -> left it was reached from
        queue, free = [start], None
        for a in queue:
            for b in edges[a]:
                if b in came:
                    continue
                came[b] = a
                if b not in mate_r:
                    free = b
                    break
                queue.append(mate_r[b])
            if free is not None:
                break
        while free is not None:
            a = came[free]
            mate_l[a], mate_r[free], free = free, a, mate_l.get(a)
    return sorted(mate_l.items())


def overlap_matching(edges: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Maximum-cardinality matching of components that share a pixel: (by, ref, pred)."""

    def one(x: dict[str, np.ndarray]) -> dict[str, list]:
        found = bipartite_matching(x["ref"], x["pred"])
        return {"ref": [a for a, _ in found], "pred": [b for _, b in found]}

    return contested(edges, by, ("ref", "pred"), None, one, {"ref": "long", "pred": "long"})


def component_dice(ref: DataFrame, pred: DataFrame, by: Sequence[str], overlap: Callable[[DataFrame, DataFrame, list[str]], DataFrame]) -> DataFrame:
    """(by, ref, pred, dice) of components (by, component, y, x0, x1, and ``rows`` as in ``overlap``, if there) that share pixels; ``by`` holds the class, as only equal classes match."""
    pixels = lambda runs: (F.col("x1") - F.col("x0")) * (F.col("rows") if "rows" in runs.columns else 1)
    size = lambda runs, key, n: runs.groupBy(*by, F.col("component").alias(key)).agg(F.sum(pixels(runs)).alias(n))
    shared = overlap(ref, pred, list(by))
    both = shared.join(size(ref, "ref", "a"), [*by, "ref"]).join(size(pred, "pred", "b"), [*by, "pred"])
    return both.select(*by, "ref", "pred", (2.0 * F.col("pixels") / (F.col("a") + F.col("b"))).alias("dice"))


def dice_matching(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """The matching of largest total Dice among ``pairs`` (by, ref, pred, dice), each end once; only pairs that share a pixel."""

    def one(x: dict[str, np.ndarray]) -> dict[str, list]:
        g, gi = np.unique(x["ref"], return_inverse=True)
        p, pi = np.unique(x["pred"], return_inverse=True)
        gain = np.zeros((len(g), len(p)))
        gain[gi, pi] = x["dice"]
        found = [(i, j) for i, j in assign(-gain) if gain[i, j] > 0]
        return {"ref": [g[i] for i, _ in found], "pred": [p[j] for _, j in found], "dice": [gain[i, j] for i, j in found]}

    return contested(pairs.where("dice > 0"), by, ("ref", "pred"), "dice", one, {"ref": "long", "pred": "long", "dice": "double"})


def to_source(tiles: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions of tiles (image_id, tile, box) in the coordinates of their images, numbered anew by tile and number."""
    corner = tiles.select("image_id", "tile", F.col("x1").alias("left"), F.col("y1").alias("top"))
    moved = predictions.join(corner, ["image_id", "tile"]).withColumns({c: F.col(c) + F.col(o) for c, o in (("x1", "left"), ("x2", "left"), ("y1", "top"), ("y2", "top"))})
    order = Window.partitionBy("model", "image_id").orderBy("tile", "pred_idx")
    return moved.withColumn("pred_idx", F.row_number().over(order) - 1).drop("left", "top", "tile")


def merge_sliced(tiles: DataFrame, predictions: DataFrame, method: str = "GREEDYNMM", **options) -> DataFrame:
    """Predictions made tile by tile, merged into those of whole images; ``method`` and options are those of :func:`non_maximum`."""
    return non_maximum(to_source(tiles, predictions), method, **options)


def overlaps(b: np.ndarray, metric: str = "ios") -> np.ndarray:
    """Pairwise IoU or intersection over the smaller box of boxes (n, 4)."""
    wide = np.maximum(0, np.minimum(b[:, None, 2], b[None, :, 2]) - np.maximum(b[:, None, 0], b[None, :, 0]))
    high = np.maximum(0, np.minimum(b[:, None, 3], b[None, :, 3]) - np.maximum(b[:, None, 1], b[None, :, 1]))
    inter, area = wide * high, (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    low = np.minimum(area[:, None], area[None, :]) if metric == "ios" else area[:, None] + area[None, :] - inter
    return np.divide(inter, low, out=np.zeros_like(inter), where=low > 0)


def suppressed(boxes: np.ndarray, scores: np.ndarray, classes: np.ndarray, method: str, metric: str, threshold: float, agnostic: bool) -> list[list[int]]:
    """Groups of indices, the winner first: NMS keeps the winner, GREEDYNMM merges what it beats, NMM the transitive closure."""
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], i))
    near = overlaps(boxes, metric) >= threshold
    if not agnostic:
        near &= classes[:, None] == classes[None, :]
    left, out = dict.fromkeys(order), []
    for w in order:
        if w not in left:
            continue
        del left[w]
        group, queue = [w], [w]
        while queue:
            i = queue.pop(0)
            for j in [j for j in left if near[i, j]]:
                del left[j]
                group.append(j)
                queue.append(j)
            if method != "NMM":
                break
        out.append(group)
    return out


def near_pairs(owner: np.ndarray, b: np.ndarray, classes: np.ndarray, metric: str, threshold: float, agnostic: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of the boxes of a group that overlap by at least ``threshold``; groups lie one after the other."""
    ends = np.cumsum(np.bincount(owner))[owner]
    count, found, area = ends - np.arange(len(owner)) - 1, [], (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    for part in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(np.cumsum(count) // AT_ONCE)) + 1):
        i, k = expanded(count[part])
        i = part[i]
        j = i + 1 + k
        wide = np.maximum(0, np.minimum(b[i, 2], b[j, 2]) - np.maximum(b[i, 0], b[j, 0]))
        high = np.maximum(0, np.minimum(b[i, 3], b[j, 3]) - np.maximum(b[i, 1], b[j, 1]))
        inter = wide * high
        low = np.minimum(area[i], area[j]) if metric == "ios" else area[i] + area[j] - inter
        near = np.divide(inter, low, out=np.zeros_like(inter), where=low > 0) >= threshold
        if not agnostic:
            near &= classes[i] == classes[j]
        found.append((i[near], j[near]))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def winners(owner: np.ndarray, b: np.ndarray, classes: np.ndarray, method: str, metric: str, threshold: float, agnostic: bool) -> np.ndarray:
    """Of the boxes of many groups, best first in each, the place of the one that :func:`suppressed` gives each to."""
    n = len(owner)
    i, j = near_pairs(owner, b, classes, metric, threshold, agnostic)
    if method == "NMM":
        return linked(n, i, j)
    # A box without an open better one near it wins, and those near a winner are out; until none is open.
    win, out = np.zeros(n, bool), np.zeros(n, bool)
    a, c = i, j
    while not (win | out).all():
        blocked = np.zeros(n, bool)
        blocked[c] = True
        win |= ~blocked & ~out
        out[j[win[i]]] = True
        live = ~win[a] & ~out[a] & ~out[c]
        a, c = a[live], c[live]
    # A beaten one goes to its best winner.
    winner = np.arange(n)
    of = win[i] & out[j]
    winner[out] = n
    np.minimum.at(winner, j[of], i[of])
    return winner


def non_maximum(predictions: DataFrame, method: str = "GREEDYNMM", metric: str = "ios", threshold: float = 0.2, agnostic: bool = False) -> DataFrame:
    """Predictions after suppression or merging, each image by itself; merged boxes are unions, with ``members`` of them."""
    if method not in ("NMS", "LSNMS", "NMM", "GREEDYNMM"):
        raise ValueError(f"unknown method {method!r}")
    columns = ("pred_idx", "class_id", "score", "x1", "y1", "x2", "y2")

    def many(x: dict[str, np.ndarray], owner: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        order = np.lexsort((np.arange(len(owner)), -x["score"], owner))
        b = np.column_stack([x[c][order] for c in ("x1", "y1", "x2", "y2")]).astype(float)
        winner = winners(owner, b, x["class_id"][order], method, metric, threshold, agnostic)
        first = np.flatnonzero(winner == np.arange(len(winner)))
        out = {c: x[c][order[first]] for c in columns}
        if method in ("NMM", "GREEDYNMM"):
            low, high = b.copy(), b.copy()
            np.minimum.at(low, winner, b)
            np.maximum.at(high, winner, b)
            out |= {"x1": low[first, 0], "y1": low[first, 1], "x2": high[first, 2], "y2": high[first, 3]}
        return owner[first], out | {"members": np.bincount(winner, minlength=len(winner))[first]}

    return per_batch(predictions, ("model", "image_id"), ("pred_idx",), columns, many, {"pred_idx": "int", "class_id": "int", "score": "double", "x1": "double", "y1": "double", "x2": "double", "y2": "double", "members": "int"})


def suppression_edges(predictions: DataFrame, threshold: float = 0.2) -> DataFrame:
    """(model, image_id, winner, loser) direct matches by intersection over the smaller box, without division."""
    b = predictions.select("model", "image_id", "class_id", F.col("pred_idx").alias("loser"), F.col("score").alias("l_score"), *(F.col(c).alias(f"l_{c}") for c in ("x1", "y1", "x2", "y2")))
    pairs = predictions.join(b, ["model", "image_id", "class_id"])
    first = (F.col("score") > F.col("l_score")) | ((F.col("score") == F.col("l_score")) & (F.col("pred_idx") < F.col("loser")))
    p, q = box(), box("l_")
    return pairs.where(first & (intersection(p, q) >= threshold * F.least(box_area(p), box_area(q)))).select("model", "image_id", F.col("pred_idx").alias("winner"), "loser")


def merged_payload(members: DataFrame, by: list[str]) -> DataFrame:
    """Union of the boxes and score-weighted points of each merged group."""
    w = F.col("score")
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * w), F.sum(w)).alias(c)
    points = [weighted(c) for c in ("px", "py", "radius") if c in members.columns]
    return members.groupBy(*by).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.max("score").alias("score"), *points)
