"""Models scored on one cohort, from their predictions to a ranking."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.geometry import f1
from lumenframe.operators import matching, metrics, selection, stats


@dataclass(frozen=True)
class Comparison:
    """A comparison, whose tables are made when they are asked for: one that needs no matching or AP runs none.

    ``ranking``: a row a model, best ``map50_95`` first. ``classes``: AP a model
    and class. ``images``: tp, fp and fn a model and image. ``pairs``: paired
    bootstrap of the groups' F1, Holm-adjusted. ``worst``: the images with most
    errors. ``issues``: (model, problem, n): images predicted outside the cohort
    (they count nowhere), originals that a model was trained on.
    """

    samples: DataFrame
    annotations: DataFrame
    predictions: DataFrame
    models: DataFrame
    trained: DataFrame | None
    most: int
    resamples: int

    @cached_property
    def _inside(self) -> DataFrame:
        return self.predictions.join(self.samples.select("image_id"), "image_id", "left_semi")

    @cached_property
    def _truth(self) -> DataFrame:
        return self.annotations.join(self.samples.select("image_id"), "image_id", "left_semi")

    @cached_property
    def _candidates(self) -> DataFrame:
        return metrics.candidates(self._truth, self._inside)

    @cached_property
    def _averaged(self) -> tuple[DataFrame, DataFrame]:
        return metrics.averaged_precision(self._candidates, self._inside, self._truth, models=self.models)

    @cached_property
    def images(self) -> DataFrame:
        return metrics.per_image(self.samples, self._truth, matched_flags(self._candidates, self._inside), self.models)

    @property
    def classes(self) -> DataFrame:
        return self._averaged[0]

    @cached_property
    def ranking(self) -> DataFrame:
        scores = metrics.detection_summary(self.images).join(F.broadcast(self._averaged[1]), "model", "left")  # a row a model
        return metrics.ranking(scores, "map50_95")

    @cached_property
    def pairs(self) -> DataFrame:
        paired = stats.paired_bootstrap(metrics.model_pairs(group_scores(self.images), "key", "f1"), self.resamples)
        return metrics.holm(paired.withColumn("test", F.concat_ws("/", "model_a", "model_b")), "p").drop("test")

    @cached_property
    def worst(self) -> DataFrame:
        return metrics.worst_cases(self.images, self.most)

    @cached_property
    def issues(self) -> DataFrame:
        # A row an image and model, made where the predictions lie.
        predicted = self.predictions.select("image_id", "model").distinct()
        outside = predicted.join(self.samples.select("image_id"), "image_id", "left_anti")
        per = outside.groupBy("model").agg(F.count("image_id").alias("n"))
        out = per.select("model", F.lit("outside the cohort").alias("problem"), "n")
        if self.trained is not None:
            evaluated = self.samples.select("group_key").distinct().join(F.broadcast(self.models))
            out = out.unionByName(selection.leakage(self.trained, evaluated, "group_key").select("model", F.lit("trained on").alias("problem"), F.col("leaked").alias("n")))
        return out


def matched_flags(pairs: DataFrame, predictions: DataFrame) -> DataFrame:
    """(model, class_id, image_id, pred_idx, score, tp): every prediction, 1 where the optimal matching of ``pairs`` gives it a truth."""
    hits = matching.optimal_matching(pairs).select("model", "image_id", "pred_idx", F.lit(1).alias("tp"))
    rows = predictions.select("model", "class_id", "image_id", "pred_idx", "score")
    return rows.join(hits, ["model", "image_id", "pred_idx"], "left").select("model", "class_id", "image_id", "pred_idx", "score", F.coalesce("tp", F.lit(0)).alias("tp"))


def group_scores(images: DataFrame) -> DataFrame:
    """(model, key, f1) of each group's pooled counts."""
    per = images.groupBy("model", "group_key").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return per.select("model", F.col("group_key").alias("key"), f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def compare_models(samples: DataFrame, annotations: DataFrame, predictions: DataFrame, models: DataFrame | None = None, trained: DataFrame | None = None, worst: int = 50, resamples: int = stats.RESAMPLES) -> Comparison:
    """Compare box predictions (model, image_id, pred_idx, class_id, score, box) on all of ``samples``.

    Counts come from the matching of most pairs at an IoU of 0.5, AP from greedy
    matching at ten thresholds. ``models`` (model) adds models that predicted
    nothing; ``trained`` (model, group_key) is checked for leakage.
    """
    models = (models if models is not None else predictions).select("model").distinct()
    return Comparison(samples, annotations, predictions, models, trained, worst, resamples)


def threshold_counts(pixels: DataFrame, thresholds: list[float]) -> DataFrame:
    """(model, group_key, case_id, threshold, tp, fp, fn) of score maps under every threshold: a pixel is predicted from ``threshold <= score`` on.

    ``pixels``: model, group_key, case_id, score, truth (boolean). A pixel is
    counted once, at the number of thresholds it reaches, and suffix sums over
    those few counts give all thresholds; null and NaN scores reach none.
    """
    grid = sorted({float(t) for t in thresholds})
    score = F.coalesce(F.nanvl(F.col("score"), F.lit(float("-inf"))), F.lit(float("-inf")))
    level = sum((F.when(score >= t, 1).otherwise(0) for t in grid), F.lit(0))
    case = ["model", "group_key", "case_id"]
    # Grouped by case alone, with an array element a level: no row a threshold before the end.
    levels = pixels.select(*case, level.alias("level"), F.coalesce("truth", F.lit(False)).alias("truth"))
    sums = [F.count_if((F.col("level") > i) & F.col("truth")).alias(f"t{i}") for i in range(len(grid))] + [F.count_if((F.col("level") > i) & ~F.col("truth")).alias(f"f{i}") for i in range(len(grid))]
    per = levels.groupBy(*case).agg(F.count_if("truth").alias("n_ref"), *sums)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("tp"), F.col(f"f{i}").alias("fp"), (F.col("n_ref") - F.col(f"t{i}")).alias("fn")) for i, t in enumerate(grid)])
    return per.select(*case, F.inline(rows))


def calibrate_maps(pixels: DataFrame, thresholds: list[float]) -> DataFrame:
    """Best threshold of each model from its score maps."""
    return metrics.calibrate(threshold_counts(pixels, thresholds))


def _row(runs: DataFrame) -> list[str]:
    """Key of a pixel row, or of equal neighbouring ones with their number ``rows``."""
    return ["model", "image_id", "y", *(["rows"] if "rows" in runs.columns else [])]


def levelled(runs: DataFrame) -> DataFrame:
    """Runs that repeat over ``rows`` pixel rows, cut at every row where a run of their image starts or ends: between these all pixel rows are alike."""
    case = ["model", "image_id"]
    whole = runs.where("rows > 0 and x0 < x1").withColumn("low", F.col("y") + F.col("rows"))
    ends = whole.select(*case, F.explode(F.array("y", "low")).alias("a")).distinct()
    bands = ends.withColumn("b", F.lead("a").over(Window.partitionBy(*case).orderBy("a"))).where("b is not null")
    return whole.join(bands, case).where("y <= a and b <= low").select(*case, F.col("a").alias("y"), (F.col("b") - F.col("a")).alias("rows"), "x0", "x1", "score")


def score_map(runs: DataFrame) -> DataFrame:
    """(model, image_id, y, x0, x1, score): the highest score over each stretch of a pixel row that any run (model, image_id, y, x0, x1, score) covers.

    Rows are cut where a run starts or ends, so the work follows the number of
    runs that meet in a row, not its pixels. Runs with a number of ``rows``, over which
    they repeat from ``y`` on, give stretches with one, and no row a pixel row.
    """
    runs = levelled(runs) if "rows" in runs.columns else runs
    row = _row(runs)
    cuts = runs.select(*row, F.explode(F.array("x0", "x1")).alias("a")).distinct()
    cuts = cuts.withColumn("b", F.lead("a").over(Window.partitionBy(*row).orderBy("a"))).where("b is not null")
    met = runs.join(cuts, row).where("x0 <= a and b <= x1")
    return met.groupBy(*row, "a", "b").agg(F.max("score").alias("score")).select(*row, F.col("a").alias("x0"), F.col("b").alias("x1"), "score")


def projection(scores: DataFrame, threshold: float) -> DataFrame:
    """Runs (model, image_id, y, x0, x1, and ``rows`` if there) of a score map at least ``threshold``, neighbours joined."""
    row = _row(scores)
    order = Window.partitionBy(*row).orderBy("x0")
    kept = scores.where(F.col("score") >= threshold)
    fresh = F.coalesce((F.lag("x1").over(order) != F.col("x0")).cast("int"), F.lit(1))
    numbered = kept.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    return numbered.groupBy(*row, "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("run")
