"""Scores of predictions. Undefined ratios are null inside and, where a score is defined so, 0 at the edge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.geometry import box, box_area, box_iou, f1, intersection, point_distance, ratio, ratio0
from lumenframe.operators import scan
from lumenframe.operators.matching import greedy_hits
from lumenframe.operators.shared import stored


def _r(x: Column) -> Column:
    return F.round(x, 6)


def candidates(annotations: DataFrame, predictions: DataFrame, least: float = 0.5) -> DataFrame:
    """(model, image_id, ann_idx, pred_idx, class_id, score, iou) of same-class pairs of an image whose IoU is at least ``least``; compared without division."""
    g = annotations.select("image_id", "class_id", "ann_idx", *(F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")))
    pairs = predictions.join(g, ["image_id", "class_id"])
    p, t = box(), box("g_")
    inter = intersection(p, t)
    return pairs.where(inter >= least * (box_area(p) + box_area(t) - inter)).select("model", "image_id", "ann_idx", "pred_idx", "class_id", "score", box_iou(p, t).alias("iou"))


def per_image(samples: DataFrame, annotations: DataFrame, flags: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """(model, image_id, group_key, tp, fp, fn) of every image and model; ``flags``: predictions with tp 0/1; ``models``: distinct, those of ``flags`` unless given."""
    hits = flags.groupBy("model", "image_id").agg(F.sum("tp").alias("tp"), F.count("*").alias("n_pred"))
    truth = samples.join(annotations.groupBy("image_id").agg(F.count("*").alias("n_gt")), "image_id", "left").select("image_id", "group_key", F.coalesce("n_gt", F.lit(0)).alias("n_gt"))
    models = models if models is not None else flags.select("model").distinct()
    grid = truth.join(F.broadcast(models))  # models are few by nature
    return grid.join(hits, ["model", "image_id"], "left").select("model", "image_id", "group_key", F.coalesce("tp", F.lit(0)).alias("tp"), (F.coalesce("n_pred", F.lit(0)) - F.coalesce("tp", F.lit(0))).alias("fp"), (F.col("n_gt") - F.coalesce("tp", F.lit(0))).alias("fn"))


def detection_summary(images: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, F1, macro F1 over images and over groups, of each model."""
    cluster = images.groupBy("model", "group_key").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.sum(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("f1_sum"), F.count("*").alias("n"))
    out = cluster.groupBy("model").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.sum("f1_sum").alias("s"), F.sum("n").alias("n"), F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("cluster_macro_f1"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select("model", "tp", "fp", "fn", _r(ratio0(tp, tp + fp)).alias("precision"), _r(ratio0(tp, tp + fn)).alias("recall"), _r(f1(tp, fp, fn)).alias("f1"), _r(ratio0(F.col("s"), F.col("n"))).alias("macro_f1"), _r(F.col("cluster_macro_f1")).alias("cluster_macro_f1"))


def class_scores(annotations: DataFrame, flags: DataFrame) -> DataFrame:
    """Per model and class: tp and fp by predicted class, support by truth."""
    truth = annotations.groupBy("class_id").agg(F.count("*").alias("support"))
    got = flags.groupBy("model", "class_id").agg(F.sum("tp").alias("tp"), (F.count("*") - F.sum("tp")).alias("fp"))
    both = got.join(F.broadcast(truth), "class_id", "left")
    tp = F.col("tp")
    return both.select("model", "class_id", "tp", "fp", "support", _r(ratio0(tp, tp + F.col("fp"))).alias("precision"), _r(ratio0(tp, F.col("support"))).alias("recall"))


def count_metrics(images: DataFrame) -> DataFrame:
    """Counting errors from per-image counts (model, n_ref, n_pred): MAE, RMSE, bias, relative error and agreement."""
    d = (F.col("n_pred") - F.col("n_ref")).cast("double")
    agree = F.when(F.greatest("n_ref", "n_pred") == 0, F.lit(1.0)).otherwise(F.least("n_ref", "n_pred").cast("double") / F.greatest("n_ref", "n_pred", F.lit(1)))
    return images.groupBy("model").agg(_r(F.avg(F.abs(d))).alias("mae"), _r(F.sqrt(F.avg(d * d))).alias("rmse"), _r(F.avg(d)).alias("bias"), _r(F.avg(ratio(F.abs(d), F.when(F.col("n_ref") > 0, F.col("n_ref"))))).alias("relative_error"), _r(F.avg(agree)).alias("agreement"))


#: Thresholds of the averaged AP: IoU and the like, and distances in radii; the first is the primary one.
IOU_GRID = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
POINT_GRID = tuple(round(1.0 - 0.1 * i, 1) for i in range(10))


def point_candidates(annotations: DataFrame, predictions: DataFrame, most: float = POINT_GRID[0]) -> DataFrame:
    """(model, image_id, ann_idx, pred_idx, class_id, score, distance) of same-class points (px, py) of an image at most ``most`` of the truth's ``radius`` (none: 1) apart."""
    g = annotations.select("image_id", "class_id", "ann_idx", F.col("px").alias("g_px"), F.col("py").alias("g_py"), F.coalesce(F.nullif("radius", F.lit(0.0)), F.lit(1.0)).alias("g_radius"))
    pairs = predictions.join(g, ["image_id", "class_id"]).withColumn("distance", point_distance(F.col("px"), F.col("py"), F.col("g_px"), F.col("g_py"), F.col("g_radius")))
    return pairs.where(F.col("distance") <= most).select("model", "image_id", "ann_idx", "pred_idx", "class_id", "score", "distance")


def hits_at(pairs: DataFrame, predictions: DataFrame, thresholds: Sequence[float] = IOU_GRID, similarity: str = "iou", smaller_is_better: bool = False) -> DataFrame:
    """(model, class_id, image_id, pred_idx, score, hits): a row a prediction, with the bit of every threshold at which it has a truth, matched greedily anew at each among ``pairs``."""
    return greedy_hits(predictions, pairs, thresholds, ("model", "image_id", "class_id"), smaller_is_better, similarity).select("model", "class_id", "image_id", "pred_idx", "score", "hits")


def _bit(i: int) -> Column:
    return F.shiftright("hits", i).bitwiseAND(F.lit(1)).cast("int")


def flags_at(pairs: DataFrame, predictions: DataFrame, thresholds: Sequence[float] = IOU_GRID, similarity: str = "iou", smaller_is_better: bool = False) -> DataFrame:
    """(model, class_id, image_id, pred_idx, score, threshold, tp) of every prediction at every threshold, each matched greedily anew among ``pairs``."""
    hits = hits_at(pairs, predictions, thresholds, similarity, smaller_is_better)
    return hits.select("model", "class_id", "image_id", "pred_idx", "score", F.inline(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), _bit(i).alias("tp")) for i, t in enumerate(thresholds)])))


def _curve_keys(flags: DataFrame) -> list[str]:
    return ["model", "class_id", *(["threshold"] if "threshold" in flags.columns else [])]


def pr_curve(flags: DataFrame, annotations: DataFrame) -> DataFrame:
    """Cumulative precision and recall of each model and class, and threshold if ``flags`` have one, in score order."""
    keys = _curve_keys(flags)
    run = _curve(_in_score_order(flags), keys).join(F.broadcast(_truth(annotations)), "class_id")
    return run.select(*keys, "k", "score", "ctp", ratio0(F.col("ctp"), F.col("n_gt")).alias("recall"), ratio0(F.col("ctp"), F.col("k")).alias("precision"))


ORDER = ("score", False), ("image_id", True), ("pred_idx", True)


def _order() -> list[Column]:
    return [F.asc(c) if up else F.desc(c) for c, up in ORDER]


def _truth(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("class_id").agg(F.count("*").alias("n_gt"))


def _in_score_order(flags: DataFrame) -> DataFrame:
    """``flags`` stored by ranges of the curves' order, with the running ``tp`` of each range: no task holds a whole curve."""
    keys = _curve_keys(flags)
    return scan.ranged(flags.select(*keys, *(c for c, _ in ORDER), "tp"), keys, _order(), {"ctp": "tp"}, ["score"])


def _curve(ranges: DataFrame, keys: list[str]) -> DataFrame:
    return scan.running(ranges, keys, _order(), {"ctp": "tp"})


def _ranked(hits: DataFrame, annotations: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(model, class_id, k, score, n_gt, range) of :func:`hits_at` with ``tp0``, ``ctp0`` and so on of each threshold: the order is the same at all of them, so a prediction is one row."""
    truth = _truth(annotations)
    keys, order = ["model", "class_id"], _order()
    flags = scan.ranged(hits, keys, order).withColumns({f"tp{i}": _bit(i) for i in range(len(thresholds))}).drop("hits")
    run = scan.running(flags, keys, order, {f"ctp{i}": f"tp{i}" for i in range(len(thresholds))})
    return run.join(F.broadcast(truth), "class_id").drop("image_id", "pred_idx")


def pr_curve_at(hits: DataFrame, annotations: DataFrame, thresholds: Sequence[float] = IOU_GRID) -> DataFrame:
    """:func:`pr_curve` at every threshold, from :func:`hits_at`; a row a threshold is only made at the end.

    Hits and the truth of each class are stored at once. Hits need annotations that
    have an image; counted apart from the others, truths read the same shuffle.
    """
    keys, order, names = ["model", "class_id"], _order(), [f"ctp{i}" for i in range(len(thresholds))]
    lost = F.col("image_id").isNull()
    truth = _truth(annotations.where(~lost).unionByName(annotations.where(lost)))
    both, path = stored(hits.unionByName(truth, allowMissingColumns=True), "unranged")
    truth = stored(both.where("n_gt IS NOT NULL").select("class_id", "n_gt"), "truth")[0]
    sums = {name: ("hits", i) for i, name in enumerate(names)}
    flags = both.where("n_gt IS NULL").select(*keys, *(c for c, _ in ORDER), "hits")
    run = scan.running(scan.ranged(flags, keys, order, sums, ["score"], path), keys, order, sums).join(F.broadcast(truth), "class_id")
    each = F.inline(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(name).alias("ctp")) for t, name in zip(thresholds, names, strict=True)]))
    rows = run.select(*keys, "k", "score", "n_gt", each)
    return rows.select(*keys, "threshold", "k", "score", "ctp", ratio0(F.col("ctp"), F.col("n_gt")).alias("recall"), ratio0(F.col("ctp"), F.col("k")).alias("precision"))


LEVELS = 101


def _reached(recall: Column) -> Column:
    """How many levels, hundredths as doubles, a recall reaches: its floor, put right by comparing."""
    c, at = F.floor(recall * 100), lambda i: i * F.lit(0.01)
    found = c + F.when(at(c + 1) <= recall, 2).when(at(c) <= recall, 1).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(LEVELS), found))


def average_precision(flags: DataFrame, annotations: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """101-point interpolated AP of each model and class with truth, and threshold if ``flags`` have one; 0 without predictions.

    A curve's points are brought down to the best precision at each number of
    levels that a recall reaches, at most 101 rows; the best from a level on is
    the largest of those that reach more.
    """
    return _exact_ap(flags, annotations, models).withColumn("ap", _r(F.col("ap")))


def _exact_ap(flags: DataFrame, annotations: DataFrame, models: DataFrame | None = None) -> DataFrame:
    keys, ranges, truth = _curve_keys(flags), _in_score_order(flags), stored(_truth(annotations), "truth")[0]
    # A false positive has the recall of the hit before it and less precision; before the first hit precision is 0.
    hits = _curve(ranges, keys).where("tp > 0").join(F.broadcast(truth), "class_id")
    at = hits.groupBy(*keys, _reached(ratio0(F.col("ctp"), F.col("n_gt"))).alias("reached")).agg(F.max(ratio0(F.col("ctp"), F.col("k"))).alias("best"))
    best = lambda i: F.coalesce(F.array_max(F.transform(F.filter("at", lambda x: x["reached"] >= i), lambda x: x["best"])), F.lit(0.0))
    sums = at.groupBy(*keys).agg(F.collect_list(F.struct("reached", "best")).alias("at")).select(*keys, F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(LEVELS)), best), F.lit(0.0), lambda s, x: s + x).alias("s"))
    grid = truth.join(F.broadcast(models if models is not None else ranges.select("model").distinct()))
    if "threshold" in keys:
        grid = grid.join(F.broadcast(ranges.select("threshold").distinct()))
    return grid.join(sums, keys, "left").select(*keys, (F.coalesce("s", F.lit(0.0)) / LEVELS).alias("ap"))


def _ap_at(hits: DataFrame, annotations: DataFrame, models: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """:func:`average_precision`, unrounded, at every threshold, from :func:`hits_at`: a column a threshold, not a row."""
    numbers, keys = range(len(thresholds)), ["model", "class_id"]
    run = _ranked(hits, annotations, thresholds).withColumns({f"p{i}": ratio0(F.col(f"ctp{i}"), F.col("k")) for i in numbers})
    best = scan.suffix_maxima(run, keys, "k", {f"best{i}": f"p{i}" for i in numbers})

    def gain(i: int) -> Column:
        before = F.when(F.col("k") == 1, F.lit(-1.0)).otherwise(ratio0(F.col(f"ctp{i}") - F.col(f"tp{i}"), F.col("n_gt")))
        return F.when((F.col("k") == 1) | (F.col(f"tp{i}") > 0), F.col(f"best{i}") * (_reached(ratio0(F.col(f"ctp{i}"), F.col("n_gt"))) - _reached(before)))

    sums = best.groupBy(*keys).agg(*(F.sum(gain(i)).alias(f"s{i}") for i in numbers))
    grid = annotations.select("class_id").distinct().join(F.broadcast(models)).join(sums, keys, "left")
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), (F.coalesce(f"s{i}", F.lit(0.0)) / LEVELS).alias("ap")) for i, t in enumerate(thresholds)])
    return grid.select(*keys, F.inline(each))


def mean_ap(ap: DataFrame) -> DataFrame:
    return ap.groupBy("model").agg(_r(F.avg("ap")).alias("map"))


def averaged_precision(pairs: DataFrame, predictions: DataFrame, annotations: DataFrame, points: bool = False, models: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """AP over ten thresholds from candidate ``pairs``: (model, class_id, primary, ap), its mean over thresholds, and (model, ap50, map50_95), or map100, map100_10 of points."""
    thresholds, similarity = (POINT_GRID, "distance") if points else (IOU_GRID, "iou")
    primary, mean = ("map100", "map100_10") if points else ("ap50", "map50_95")
    models = models if models is not None else predictions.select("model").distinct()
    ap = _ap_at(hits_at(pairs, predictions, thresholds, similarity, points), annotations, models, thresholds)
    first = F.avg(F.when(F.col("threshold") == thresholds[0], F.col("ap")))
    classes = ap.groupBy("model", "class_id").agg(_r(first).alias(primary), _r(F.avg("ap")).alias("ap"))
    return classes, ap.groupBy("model").agg(_r(first).alias(primary), _r(F.avg("ap")).alias(mean))


def binary_breakdown(cases: DataFrame) -> DataFrame:
    """Mask scores of each model: micro Dice and IoU, positive cases only, and presence; null where undefined."""
    pos, empty, seen = F.col("n_ref") > 0, F.col("n_ref") == 0, F.col("n_pred") > 0
    c = F.count_if
    s = lambda x: F.sum(x)
    when = lambda x: F.sum(F.when(pos, F.col(x)))
    agg = cases.groupBy("model").agg(s("tp").alias("tp"), s("fp").alias("fp"), s("fn").alias("fn"), when("tp").alias("ptp"), when("fp").alias("pfp"), when("fn").alias("pfn"), c(pos).alias("positives"), c(pos & seen).alias("detected"), c(empty).alias("empties"), c(empty & seen).alias("fp_empties"))
    tp, fp, fn, ptp, pfp, pfn = (F.col(x) for x in ("tp", "fp", "fn", "ptp", "pfp", "pfn"))
    return agg.select("model", "positives", "empties", _r(ratio(2 * tp, 2 * tp + fp + fn)).alias("micro_dice"), _r(ratio(tp, tp + fp + fn)).alias("micro_iou"), _r(ratio(tp, tp + fp)).alias("precision"), _r(ratio(tp, tp + fn)).alias("recall"), _r(ratio(2 * ptp, 2 * ptp + pfp + pfn)).alias("positive_dice"), _r(ratio(F.col("detected"), F.col("positives"))).alias("positive_image_recall"), _r(ratio(F.col("empties") - F.col("fp_empties"), F.col("empties"))).alias("empty_image_specificity"), _r(ratio(F.col("fp_empties"), F.col("empties"))).alias("empty_image_fpr"), _r(ratio(F.col("detected"), F.col("detected") + F.col("fp_empties"))).alias("presence_precision"))


def case_dice(cases: DataFrame) -> DataFrame:
    """Dice and IoU of each case: null for empty against empty, 0 for empty against something."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cases.withColumn("dice", ratio(2 * tp, 2 * tp + fp + fn)).withColumn("iou", ratio(tp, tp + fp + fn))


def presence_filtered(cases: DataFrame, components: DataFrame, least: float) -> DataFrame:
    """Presence scores where only components of an area of at least ``least`` make a prediction."""
    big = components.where(F.col("area") >= least).select("model", "case_id").distinct().withColumn("seen", F.lit(True))
    rows = cases.join(big, ["model", "case_id"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    pos = F.col("n_ref") > 0
    agg = rows.groupBy("model").agg(F.count_if(pos).alias("positives"), F.count_if(pos & F.col("seen")).alias("detected"), F.count_if(~pos).alias("empties"), F.count_if(~pos & F.col("seen")).alias("fp_empties"))
    return agg.select("model", "positives", "detected", "empties", "fp_empties", _r(ratio(F.col("detected"), F.col("positives"))).alias("recall"), _r(ratio(F.col("empties") - F.col("fp_empties"), F.col("empties"))).alias("specificity"))


def grouped_macro(cases: DataFrame) -> DataFrame:
    """Confusion pooled in groups, scored, then averaged over the groups where a score is defined."""
    g = cases.groupBy("model", "group_key").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    g = case_dice(g)
    return g.groupBy("model").agg(F.count("*").alias("groups"), F.count("dice").alias("defined"), _r(F.avg("dice")).alias("macro_dice"), _r(F.avg("iou")).alias("macro_iou"))


def object_size_bins(objects: DataFrame, cases: DataFrame) -> DataFrame:
    """Objects by size against the 10th and 90th percentile of areas (small wins ties), with the mean Dice of their cases."""
    cuts = objects.agg(F.percentile("area", F.array(F.lit(0.1), F.lit(0.9))).alias("p"))
    rows = objects.join(F.broadcast(cuts))  # one row
    size = F.when(F.col("area") <= F.col("p")[0], "small").when(F.col("area") >= F.col("p")[1], "large").otherwise("medium")
    scored = rows.withColumn("bin", size).join(case_dice(cases).select("model", "case_id", "dice"), ["model", "case_id"])
    return scored.groupBy("model", "bin").agg(F.count("*").alias("objects"), _r(F.avg(F.coalesce("dice", F.lit(0.0)))).alias("mean_dice"))


def calibrate(scored: DataFrame) -> DataFrame:
    """Best threshold of each model over all its cases: rows (model, group_key, case_id, threshold, tp, fp, fn); by macro Dice, micro Dice, then the larger threshold."""
    per = case_dice(scored).groupBy("model", "threshold").agg(F.avg("dice").alias("macro"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    micro = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    key = F.struct(_r(F.coalesce("macro", F.lit(-1.0))).alias("a"), _r(F.coalesce(micro, F.lit(-1.0))).alias("b"), "threshold")
    return per.groupBy("model").agg(F.max(key).alias("k")).select("model", F.col("k.threshold").alias("threshold"), F.col("k.a").alias("macro_dice"), F.col("k.b").alias("micro_dice"))


def cross_validated(scored: DataFrame, folds: DataFrame) -> DataFrame:
    """(model, fold, threshold, dice): for each fold the threshold that is best on the others, scored on the fold. Sums are subtracted, not recomputed."""
    rows = case_dice(scored).join(F.broadcast(folds), "group_key")
    per = rows.groupBy("model", "fold", "threshold").agg(F.sum("dice").alias("s"), F.count("dice").alias("n"))
    total = per.groupBy("model", "threshold").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    other = per.join(total, ["model", "threshold"]).withColumn("rest", ratio(F.col("ts") - F.col("s"), F.col("tn") - F.col("n")))
    best = other.groupBy("model", "fold").agg(F.max(F.struct(_r(F.coalesce("rest", F.lit(-1.0))).alias("a"), "threshold", ratio(F.col("s"), F.col("n")).alias("dice"))).alias("k"))
    return best.select("model", "fold", F.col("k.threshold").alias("threshold"), _r(F.col("k.dice")).alias("dice"))


def holm(tests: DataFrame, p: str = "p", by: list[str] | None = None, tie: str = "test") -> DataFrame:
    """Step-down adjusted p values: running maximum of min(1, p (m - rank))."""
    part = Window.partitionBy(*(by or [F.lit(1)]))
    order = part.orderBy(p, tie)
    m = F.count("*").over(part)
    step = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(order) + 1))
    return tests.withColumn("step", step).withColumn("adjusted", _r(F.max("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("step")


def ranking(scores: DataFrame, score: str) -> DataFrame:
    """1-based rank, best first; what is not finite comes last; ties by model."""
    value = F.when(F.isnan(score) | (F.abs(F.col(score)) == float("inf")), None).otherwise(F.col(score))
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(value), "model")))


def worst_cases(images: DataFrame, k: int) -> DataFrame:
    """The k images with the most errors over all models."""
    per = images.groupBy("image_id").agg(F.sum(F.col("fp") + F.col("fn")).alias("errors"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "model", F.col("fp").cast("string"), F.col("fn").cast("string")))), ";").alias("models"))
    return per.orderBy(F.desc("errors"), "image_id").limit(k)


def melted(scores: DataFrame) -> DataFrame:
    """fp and fn columns as rows."""
    return scores.unpivot(["model"], ["fp", "fn"], "error", "count")


def model_pairs(scores: DataFrame, key: str, value: str) -> DataFrame:
    """(model_a, model_b, key, d) of every unordered pair of models on their common keys, undefined values left out."""
    rows = scores.where(F.col(value).isNotNull() & ~F.isnan(value))
    a = rows.select(F.col("model").alias("model_a"), key, F.col(value).alias("a"))
    b = rows.select(F.col("model").alias("model_b"), key, F.col(value).alias("b"))
    return a.join(b, key).where("model_a < model_b").select("model_a", "model_b", key, (F.col("b") - F.col("a")).alias("d"))


def example_cases(objects: DataFrame, largest: int = 2, most: int = 4) -> DataFrame:
    """Cases to show: those of the largest objects, then those with the worst Dice; (case_id, reason), each case once. ``objects``: case_id, area, dice."""
    per = objects.groupBy("case_id").agg(F.max("area").alias("area"), F.avg(F.coalesce("dice", F.lit(0.0))).alias("dice"))
    big = per.orderBy(F.desc("area"), "case_id").limit(largest).select("case_id", F.lit(0).alias("order"), (-F.col("area")).cast("double").alias("v"), F.lit("large").alias("reason"))
    bad = per.orderBy("dice", "case_id").limit(most + largest).select("case_id", F.lit(1).alias("order"), F.col("dice").alias("v"), F.lit("worst").alias("reason"))
    first = big.unionByName(bad.join(big.select("case_id"), "case_id", "left_anti"))
    return first.orderBy("order", "v", "case_id").limit(most).select("case_id", "reason")


def ranking_invariants(cases: DataFrame) -> DataFrame:
    """(fingerprints, ok): every model must have been scored on the same cases with the same references."""
    per = cases.groupBy("model").agg(F.count("*").alias("n"), F.sum("n_ref").alias("refs"), F.sum(F.xxhash64("case_id", "n_ref").cast("decimal(38,0)")).alias("h"))
    return per.agg(F.count_distinct(F.struct("n", "refs", "h")).alias("fingerprints")).withColumn("ok", F.col("fingerprints") <= 1)
