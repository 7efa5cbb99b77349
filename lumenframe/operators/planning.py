"""Seeded plans. Decisions that follow one order over all groups are taken on the driver, on one row a group; those by size classes from a row a class. Rows never leave the executors."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.text import seed_of
from lumenframe.operators import scan
from lumenframe.operators.shared import stored


def group_sizes(samples: DataFrame, annotations: DataFrame | None = None) -> list[tuple[str, int, int]]:
    """(group, images, annotated images) in the order in which groups first appear (``ord``, else image_id)."""
    order = "ord" if "ord" in samples.columns else "image_id"
    if annotations is None:
        marked = samples.withColumn("has", F.lit(0))
    else:
        marked = samples.join(annotations.select("image_id").distinct().withColumn("has", F.lit(1)), "image_id", "left")
    rows = marked.groupBy("group_key").agg(F.min(order).alias("first"), F.count("*").alias("n"), F.sum(F.coalesce("has", F.lit(0))).alias("a"))
    return [(r["group_key"], r["n"], r["a"]) for r in sorted(rows.collect(), key=lambda r: r["first"])]


def assign_splits(groups: Sequence[tuple[str, int, int]], ratios: Mapping[str, float], seed: int = 0, pinned: Mapping[str, str] | None = None, preview: bool = False) -> dict[str, str]:
    """Split of each group. Pinned groups first, then shuffled ones, each to the split with the largest relative deficit.

    ``preview`` looks at images only; otherwise groups with more annotated images
    come first and the deficit of annotated images decides for them.
    """
    total = sum(ratios.values())
    if total <= 0:
        raise ValueError("ratios must have a positive sum")
    want = {s: r / total for s, r in ratios.items()}
    images, annotated = sum(n for _, n, _ in groups), sum(a for _, _, a in groups)
    got_n, got_a = dict.fromkeys(want, 0), dict.fromkeys(want, 0)
    out: dict[str, str] = {}

    def put(group: tuple[str, int, int], split: str) -> None:
        out[group[0]] = split
        got_n[split] = got_n.get(split, 0) + group[1]
        got_a[split] = got_a.get(split, 0) + group[2]

    rest = []
    for g in groups:
        if pinned and g[0] in pinned:
            put(g, pinned[g[0]])
        else:
            rest.append(g)
    random.Random(seed).shuffle(rest)
    if not preview:
        rest.sort(key=lambda g: -g[2])
    open_splits = [s for s in want if want[s] > 0]
    for g in rest:
        def deficits(s: str, g: tuple[str, int, int] = g) -> tuple[float, ...]:
            dn = (want[s] * images - got_n[s]) / max(want[s] * images, 1)
            da = (want[s] * annotated - got_a[s]) / max(want[s] * annotated, 1)
            return (dn,) if preview else (da, dn) if g[2] else (dn, da)

        put(g, max(open_splits, key=deficits))
    return out


def sized_groups(samples: DataFrame, annotations: DataFrame | None, seed: int) -> DataFrame:
    """(group_key, n, a, cls, h): images, annotated images, size class and seeded hash of each group. Sizes of a class differ by under a fifth."""
    marked = samples.withColumn("has", F.lit(0)) if annotations is None else samples.join(annotations.select("image_id").distinct().withColumn("has", F.lit(1)), "image_id", "left")
    groups = marked.groupBy("group_key").agg(F.count("*").alias("n"), F.sum(F.coalesce("has", F.lit(0))).alias("a"))
    level = lambda c: F.when(F.col(c) < 6, F.col(c)).otherwise(F.floor(F.log2(c) * 4)).cast("int")
    return groups.select("group_key", "n", "a", (level("n") * 1000 + level("a")).alias("cls"), seed_of(F.lit(str(seed)), F.col("group_key")).alias("h"))


def quotas(classes: Sequence[tuple[int, int, int, int]], want: Mapping[str, float], got: Mapping[str, tuple[int, int]] | None = None) -> dict[int, list[int]]:
    """For each size class (cls, groups, images, annotated images), how many of its groups come before the end of each name's share.

    Large sizes first; a class is shared out by what its names still lack of
    annotated images, or of images where the class has none, whole groups by
    largest remainders. So each name ends within one group of a class, and the
    spread of sizes inside classes, of its share.
    """
    names = list(want)
    got_n, got_a = ({s: (got or {}).get(s, (0, 0))[i] for s in names} for i in range(2))
    total = [sum(c[i] for c in classes) + sum(g[i - 2] for g in (got or {}).values()) for i in (2, 3)]
    out = {}
    for cls, count, images, annotated in sorted(classes, key=lambda c: (-c[3] / c[1], -c[2] / c[1], c[0])):
        by_a = annotated > 0
        lack = {s: max(0.0, want[s] * total[1 if by_a else 0] - (got_a if by_a else got_n)[s]) if want[s] > 0 else 0.0 for s in names}
        whole = sum(lack.values())
        ideal = {s: count * (lack[s] / whole if whole > 0 else want[s]) for s in names}
        take = {s: int(ideal[s]) for s in names}
        for s in sorted(names, key=lambda s: (take[s] - ideal[s], names.index(s)))[: count - sum(take.values())]:
            take[s] += 1
        for s in names:
            got_n[s] += take[s] * images / count
            got_a[s] += take[s] * annotated / count
        out[cls] = np.cumsum([take[s] for s in names]).tolist()
    return out


def dealt_groups(groups: DataFrame, want: Mapping[str, float], pinned: Mapping[str, str] | None = None) -> DataFrame:
    """(group_key, name) of groups of :func:`sized_groups`: quotas from the classes' totals on the driver, ordinals inside a class by :mod:`scan` on the executors. No row a group leaves them."""
    spark = groups.sparkSession
    side = spark.createDataFrame(list((pinned or {}).items()), "group_key string, name string")
    fixed = groups.join(side, "group_key")
    got = {r["name"]: (r["n"], r["a"]) for r in fixed.groupBy("name").agg(F.sum("n").alias("n"), F.sum("a").alias("a")).collect()} if pinned else {}
    rest = groups.join(side.select("group_key"), "group_key", "left_anti") if pinned else groups
    totals = [tuple(r) for r in rest.groupBy("cls").agg(F.count("*"), F.sum("n"), F.sum("a")).collect()]  # some hundred size classes
    ends = spark.createDataFrame(list(quotas(totals, want, got).items()), "cls int, ends array<long>")
    order = [F.asc("h"), F.asc("group_key")]
    ranked = scan.running(scan.ranged(rest, ["cls"], order), ["cls"], order, {}).join(F.broadcast(ends), "cls")
    names = F.array(*(F.lit(s) for s in want))
    out = ranked.select("group_key", names[F.size(F.filter("ends", lambda e: e < F.col("k")))].alias("name"))
    return out.unionByName(fixed.select("group_key", "name")) if pinned else out


def split(samples: DataFrame, annotations: DataFrame | None, ratios: Mapping[str, float], seed: int = 0, source_splits: Sequence[str] | None = None, pinned: Mapping[str, str] | None = None, preview: bool = False, method: str = "exact") -> DataFrame:
    """Samples with new splits, whole groups at a time; unselected source splits are left out.

    ``method``: ``exact`` follows one order over all groups, on the driver, a row
    a group; ``classes`` balances by size classes and keeps groups on the executors.
    """
    rows = samples if source_splits is None else samples.where(F.col("split").isin(list(source_splits)))
    if method == "classes":
        total = sum(ratios.values())
        if total <= 0:
            raise ValueError("ratios must have a positive sum")
        side = dealt_groups(sized_groups(rows, None if preview else annotations, seed), {s: r / total for s, r in ratios.items()}, pinned)
        return rows.join(side, "group_key").withColumn("split", F.col("name")).drop("name")
    if method != "exact":
        raise ValueError("the method is exact or classes")
    plan = assign_splits(group_sizes(rows, annotations), ratios, seed, pinned, preview)
    side = samples.sparkSession.createDataFrame(list(plan.items()), "group_key string, new_split string")
    return rows.join(side, "group_key").withColumn("split", F.col("new_split")).drop("new_split")


def with_ordinal(samples: DataFrame, *order: str) -> DataFrame:
    """0-based ordinal in a global order (by default of ``relative_path``): a range sort, stored, and partition offsets from one count a partition."""
    rows = samples.sort(*(order or ("relative_path",))).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    rows = stored(rows, "ordinals")[0]
    first = {r["__p"]: (r["n"], r["lo"]) for r in rows.groupBy("__p").agg(F.count("*").alias("n"), F.min("__i").alias("lo")).collect()}
    offset, table = 0, []
    for p in sorted(first):
        table.append((p, offset - first[p][1]))
        offset += first[p][0]
    side = samples.sparkSession.createDataFrame(table, "__p int, __o long")
    return rows.join(F.broadcast(side), "__p").withColumn("ord", F.col("__i") + F.col("__o")).drop("__p", "__i", "__o")  # a row a partition


def sample(samples: DataFrame, n: int, seed: int = 0, split_name: str | None = None, order: str = "relative_path") -> DataFrame:
    """``n`` samples drawn by a seeded generator over the ordinals; order is kept. Rows are numbered first."""
    rows = samples if split_name is None else samples.where(F.col("split") == split_name)
    numbered = with_ordinal(rows, order, "image_id")  # paths may repeat over splits
    total = numbered.count()
    if n > total:
        raise ValueError(f"{n} of {total} samples")
    drawn = sorted(random.Random(seed).sample(range(total), n))
    side = samples.sparkSession.createDataFrame([(i,) for i in drawn], "ord long")
    return numbered.join(side, "ord", "left_semi").orderBy("ord")


def visual_cases(cases: DataFrame, n: int, filled: Column | None = None, seed: int = 0, order: Sequence[str] = ("relative_path",)) -> DataFrame:
    """``n`` cases to look at, with their ordinal ``ord``: drawn by a seeded generator among those that are ``filled``, or among all if none is or no column is given; all of them if they are fewer."""
    some = cases if filled is None else cases.where(filled)
    numbered = with_ordinal(cases if filled is not None and some.isEmpty() else some, *order)
    total = numbered.count()
    if n >= total:
        return numbered
    drawn = np.random.default_rng(seed).choice(total, size=n, replace=False).tolist()
    return numbered.join(cases.sparkSession.createDataFrame([(i,) for i in drawn], "ord long"), "ord", "left_semi")


def move_n_groups(samples: DataFrame, n: int, from_split: str, to_split: str, seed: int = 0, method: str = "exact") -> DataFrame:
    """``n`` groups that have images in a split move theirs to another; ``method`` as of :func:`split` (``classes``: those with the smallest seeded hashes)."""
    if method == "classes":
        groups = sized_groups(samples.where(F.col("split") == from_split), None, seed).withColumn("cls", F.lit(0))
        order = [F.asc("h"), F.asc("group_key")]
        ranked = scan.running(scan.ranged(groups, ["cls"], order), ["cls"], order, {})
        total = ranked.count()
        if n > total:
            raise ValueError(f"{n} of {total} groups")
        first = ranked.where(F.col("k") <= n).select("group_key", F.lit(True).alias("go"))
        return samples.join(first, "group_key", "left").withColumn("split", F.when(F.col("go") & (F.col("split") == from_split), to_split).otherwise(F.col("split"))).drop("go")
    eligible = [g for g, _, _ in group_sizes(samples.where(F.col("split") == from_split))]
    if n > len(eligible):
        raise ValueError(f"{n} of {len(eligible)} groups")
    chosen = samples.sparkSession.createDataFrame([(g,) for g in random.Random(seed).sample(eligible, n)], "group_key string").withColumn("go", F.lit(True))
    return samples.join(chosen, "group_key", "left").withColumn("split", F.when(F.col("go") & (F.col("split") == from_split), to_split).otherwise(F.col("split"))).drop("go")


def folds(groups: Sequence[tuple[str, int]], k: int, seed: int = 0) -> dict[str, int]:
    """Shuffled groups, largest first, each to the lightest fold; at most as many folds as groups."""
    k = min(k, len(groups))
    order = np.random.default_rng(seed).permutation(len(groups))
    load, out = [0] * k, {}
    for i in sorted(order.tolist(), key=lambda i: -groups[i][1]):
        best = min(range(k), key=load.__getitem__)
        out[groups[i][0]] = best
        load[best] += groups[i][1]
    return out


def grouped_folds(cases: DataFrame, k: int, seed: int = 0, method: str = "exact") -> DataFrame:
    """(group_key, fold); ``method`` as of :func:`split`."""
    if method == "classes":
        images = cases.select("group_key", F.col("case_id").alias("image_id")).distinct()
        groups = sized_groups(images, None, seed)
        many = min(k, groups.count())
        return dealt_groups(groups, {str(f): 1 / many for f in range(many)}).select("group_key", F.col("name").cast("int").alias("fold"))
    sizes = [(r["group_key"], r["n"]) for r in cases.groupBy("group_key").agg(F.count_distinct("case_id").alias("n")).orderBy("group_key").collect()]
    return cases.sparkSession.createDataFrame(list(folds(sizes, k, seed).items()), "group_key string, fold int")


def augment(samples: DataFrame, copies: int, seed: int = 0, include_original: bool = True, splits: Sequence[str] = ("train",)) -> DataFrame:
    """A row for each copy with its own seed: the first four bytes of SHA-256 of seed, split, path and number."""
    first = 0 if include_original else 1
    last = F.when(F.col("split").isin(list(splits)), F.lit(copies)).otherwise(F.lit(0))
    rows = samples.withColumn("copy", F.explode(F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array())))
    return rows.withColumn("copy_seed", F.when(F.col("copy") > 0, seed_of(F.lit(str(seed)), F.col("split"), F.col("relative_path" if "relative_path" in samples.columns else "path"), F.col("copy").cast("string"))))


def flipped(annotations: DataFrame, samples: DataFrame, horizontal: bool = True) -> DataFrame:
    """Boxes of images that are mirrored."""
    rows = annotations.join(samples.select("image_id", "width", "height"), "image_id")
    if horizontal:
        return rows.withColumns({"x1": F.col("width") - F.col("x2"), "x2": F.col("width") - F.col("x1")}).drop("width", "height")
    return rows.withColumns({"y1": F.col("height") - F.col("y2"), "y2": F.col("height") - F.col("y1")}).drop("width", "height")


def mirrored(annotations: DataFrame, samples: DataFrame) -> DataFrame:
    """Boxes, polygons, points and keypoints of images (image_id, width, height, flip_x, flip_y) that are mirrored or not; hidden keypoints at the origin stay there."""
    rows = annotations.join(samples.select("image_id", "width", "height", "flip_x", "flip_y"), "image_id")
    w, h = F.col("width"), F.col("height")
    x = lambda c: F.when(F.col("flip_x"), w - c).otherwise(c)
    y = lambda c: F.when(F.col("flip_y"), h - c).otherwise(c)
    new = {}
    if "x1" in annotations.columns:
        new |= {"x1": F.least(x(F.col("x1")), x(F.col("x2"))), "x2": F.greatest(x(F.col("x1")), x(F.col("x2"))), "y1": F.least(y(F.col("y1")), y(F.col("y2"))), "y2": F.greatest(y(F.col("y1")), y(F.col("y2")))}
    if "px" in annotations.columns:
        new |= {"px": x(F.col("px")), "py": y(F.col("py"))}
    if "polygon" in annotations.columns:
        new["polygon"] = F.transform("polygon", lambda q: q.withField("x", x(q["x"])).withField("y", y(q["y"])))
    if "keypoints" in annotations.columns:
        seen = lambda q: F.coalesce(q["v"], F.lit(2.0)) > 0
        new["keypoints"] = F.transform("keypoints", lambda q: F.when(seen(q), q.withField("x", x(q["x"])).withField("y", y(q["y"]))).otherwise(q))
    return rows.withColumns(new).select(*annotations.columns)
