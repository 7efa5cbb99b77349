"""Text labels: parsing, formatting and rule-based issues, all as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a row by task; segments have an odd number of at least seven.
COLUMNS = {"detect": 5, "polo": 4}


def fields(lines: DataFrame) -> DataFrame:
    """With ``p``: the line's numbers, null where one is none."""
    raw = F.split(F.trim("line"), r"\s+")
    return lines.withColumn("p", F.transform(raw, lambda x: x.try_cast("double")))


def problem(columns: Column) -> Column:
    """What is wrong with a row, or null."""
    p = F.col("p")
    number = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(~columns, "column count").when(F.exists(p, number), "not a number").when(F.get(p, F.lit(0)) != F.floor(F.get(p, F.lit(0))), "class not integral")


def parse_detect(lines: DataFrame) -> DataFrame:
    """class_id, cx, cy, w, h and ``problem`` of rows ``line``."""
    rows = fields(lines)
    rows = rows.withColumn("problem", problem(F.size("p") == 5))
    ok = F.col("problem").isNull()
    at = lambda i: F.when(ok, F.get("p", F.lit(i)))
    return rows.withColumns({"class_id": at(0).cast("int"), "cx": at(1), "cy": at(2), "w": at(3), "h": at(4)})


def infer_task(lines: DataFrame, keypoints: bool = False) -> str | None:
    """Task of the first non-empty row by ``ord``, ``line_no``."""
    if keypoints:
        return "pose"
    first = lines.where(F.trim("line") != "").agg(F.min_by(F.size(F.split(F.trim("line"), r"\s+")), F.struct("ord", "line_no")).alias("n")).first()["n"]
    if first is None:
        return None
    return "polo" if first == 4 else "detect" if first == 5 else "segment" if first >= 7 and first % 2 else None


def parse(lines: DataFrame, task: str, keypoint_shape: tuple[int, int] | None = None) -> DataFrame:
    """Annotations in absolute pixels of rows (image_id, line_no, line, width, height), with ``problem``."""
    rows = fields(lines)
    n, p = F.size("p"), F.col("p")
    right = {"detect": n == 5, "polo": n == 4, "segment": (n >= 7) & (n % 2 == 1), "pose": n == 5 + (keypoint_shape[0] * keypoint_shape[1] if keypoint_shape else 0)}[task]
    rows = rows.withColumn("problem", problem(right))
    ok = F.col("problem").isNull()
    at = lambda i: F.when(ok, F.get(p, F.lit(i)))
    out = rows.withColumn("class_id", at(0).cast("int"))
    w, h = F.col("width"), F.col("height")
    if task in ("detect", "pose"):
        out = out.withColumns({"x1": (at(1) - at(3) / 2) * w, "y1": (at(2) - at(4) / 2) * h, "x2": (at(1) + at(3) / 2) * w, "y2": (at(2) + at(4) / 2) * h})
    if task == "polo":
        out = out.withColumns({"radius": at(1), "px": at(2) * w, "py": at(3) * h})
    if task == "segment":
        points = F.transform(F.sequence(F.lit(1), n - 2, F.lit(2)), lambda i: F.struct((F.get(p, i) * w).alias("x"), (F.get(p, i + 1) * h).alias("y")))
        out = out.withColumn("polygon", F.when(ok, points))
    if task == "pose":
        k, dims = keypoint_shape
        points = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct((F.get(p, 5 + i * dims) * w).alias("x"), (F.get(p, 6 + i * dims) * h).alias("y"), (F.get(p, 7 + i * dims) if dims == 3 else F.lit(None).cast("double")).alias("v")))
        out = out.withColumn("keypoints", F.when(ok, points))
    return out.drop("p")


def normalised(annotations: DataFrame) -> Column:
    """The label row of an annotation with its image's ``width`` and ``height``: a polygon, a point (radius as it is), a box, or a box with keypoints."""
    w, h = F.col("width"), F.col("height")
    six = lambda *c: F.format_string(" ".join(["%.6f"] * len(c)), *c)
    kind = F.col("class_id").cast("string")
    each = lambda name, f: F.array_join(F.transform(name, f), " ")
    if "polygon" in annotations.columns:
        return F.concat_ws(" ", kind, each("polygon", lambda q: six(q["x"] / w, q["y"] / h)))
    if "px" in annotations.columns:
        return F.concat_ws(" ", kind, six(F.col("radius"), F.col("px") / w, F.col("py") / h))
    box = six((F.col("x1") + F.col("x2")) / 2 / w, (F.col("y1") + F.col("y2")) / 2 / h, (F.col("x2") - F.col("x1")) / w, (F.col("y2") - F.col("y1")) / h)
    if "keypoints" in annotations.columns:
        point = lambda q: F.concat_ws(" ", six(q["x"] / w, q["y"] / h), q["v"].cast("int").cast("string"))
        return F.concat_ws(" ", kind, box, each("keypoints", point))
    return F.concat_ws(" ", kind, box)


def format_detect(samples: DataFrame, annotations: DataFrame) -> DataFrame:
    """(image_id, content): normalised rows with six decimals, in order; see :func:`normalised`."""
    rows = annotations.join(samples.select("image_id", "width", "height"), "image_id").withColumn("line", normalised(annotations))
    lines = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ann_idx", "line"))).alias("l"))  # an image's own labels
    return lines.select("image_id", F.array_join(F.transform("l", lambda s: s["line"]), "\n").alias("content"))


def issues(rows: DataFrame, rules: Mapping[str, Column], key: Sequence[str]) -> DataFrame:
    """(key, category): one row for each rule that a row breaks."""
    hit = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return rows.select(*key, F.explode(hit).alias("category"))
