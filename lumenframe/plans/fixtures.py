"""The engine's entities as views over the driver's tables.

The SQL runs unchanged in Spark and DuckDB; views build on each other in this order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lumenframe.operators.shared import dealt

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "samples": """SELECT o_orderkey AS image_id,
  concat('group_', cast(o_custkey AS varchar(20)), '/img_', cast(o_orderkey AS varchar(20)), '.jpg') AS relative_path,
  concat('group_', cast(o_custkey AS varchar(20))) AS group_key,
  CASE WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 < 9 THEN 'val' ELSE 'test' END AS split,
  cast(640 + (o_orderkey % 5) * 64 AS int) AS width, cast(480 + (o_orderkey % 4) * 32 AS int) AS height FROM orders""",
    "annotations": """SELECT image_id, cast(row_number() OVER (PARTITION BY image_id ORDER BY x1, y1, x2, y2, class_id) - 1 AS int) AS ann_idx, class_id, x1, y1, x2, y2 FROM (
  SELECT DISTINCT l_orderkey AS image_id, cast(l_suppkey % 5 AS int) AS class_id,
    cast(l_partkey % 400 AS double) AS x1, cast((l_partkey * 7) % 300 AS double) AS y1,
    cast(l_partkey % 400 + 16 + l_linenumber * 12 AS double) AS x2, cast((l_partkey * 7) % 300 + 16 + l_quantity AS double) AS y2 FROM lineitem) t""",
    "predictions": """SELECT a.image_id, a.ann_idx AS pred_idx, m.model,
  cast(CASE WHEN (a.image_id + a.ann_idx * 3) % 11 = 0 THEN (a.class_id + 1) % 5 ELSE a.class_id END AS int) AS class_id,
  1.0E0 - cast((a.image_id * 31 + a.ann_idx * 17) % 97 AS double) / 128 AS score,
  a.x1 + (a.ann_idx + m.k) % 5 AS x1, a.y1 + (a.ann_idx * 2 + m.k) % 7 AS y1, a.x2 + (a.ann_idx + m.k) % 5 AS x2, a.y2 + (a.ann_idx * 2 + m.k) % 7 AS y2
FROM annotations a CROSS JOIN (VALUES ('model_a', 0), ('model_b', 2)) AS m(model, k) WHERE (a.image_id * 7 + a.ann_idx * 5 + m.k) % 9 <> 0""",
    "samples_after": """SELECT image_id, relative_path, group_key, CASE WHEN image_id % 7 = 0 THEN 'test' ELSE split END AS split, width, height, CASE WHEN image_id % 5 = 0 THEN 1 ELSE 0 END AS edited
FROM samples WHERE image_id % 13 <> 0
UNION ALL SELECT image_id + 1000000, concat('new/', relative_path), group_key, split, width, height, 0 FROM samples WHERE image_id % 17 = 0""",
    "match_flags": """SELECT p.model, p.class_id, p.image_id, p.pred_idx, p.score, cast(CASE WHEN a.image_id IS NOT NULL AND
    greatest(0.0E0, least(a.x2,p.x2)-greatest(a.x1,p.x1)) * greatest(0.0E0, least(a.y2,p.y2)-greatest(a.y1,p.y1)) * 2 >= (a.x2-a.x1)*(a.y2-a.y1) + (p.x2-p.x1)*(p.y2-p.y1)
    - greatest(0.0E0, least(a.x2,p.x2)-greatest(a.x1,p.x1)) * greatest(0.0E0, least(a.y2,p.y2)-greatest(a.y1,p.y1)) THEN 1 ELSE 0 END AS int) AS tp
FROM predictions p LEFT JOIN annotations a ON a.image_id = p.image_id AND a.ann_idx = p.pred_idx AND a.class_id = p.class_id""",
    "cases": """SELECT model, image_id AS case_id, group_key, tp, n_pred - tp AS fp, n_ref - tp AS fn, n_ref, n_pred FROM (
  SELECT m.model, s.image_id, s.group_key, n_ref, n_pred, least(least(n_ref, n_pred), (s.image_id * 13 + m.k) % 211) AS tp
  FROM (SELECT image_id, group_key, CASE WHEN image_id % 4 = 0 THEN 0 ELSE 100 + image_id % 37 END AS n_ref, CASE WHEN image_id % 6 = 2 THEN 0 ELSE 60 + image_id % 91 END AS n_pred FROM samples WHERE split = 'val') s
  CROSS JOIN (VALUES ('model_a', 0), ('model_b', 40)) AS m(model, k)) t""",
    "components": """SELECT model, case_id, j AS component_idx, 1 + (case_id * 7 + j * 29) % 160 AS area
FROM cases CROSS JOIN (VALUES (0), (1), (2)) AS c(j) WHERE n_pred > 0 AND j <= case_id % 3""",
    "label_lines": """SELECT image_id, ann_idx + 1 AS line_no,
  CASE WHEN (image_id + ann_idx) % 23 = 0 THEN concat(cast(class_id AS varchar(9)), ' 0.5 0.5') WHEN (image_id + ann_idx) % 29 = 0 THEN '1.5 0.5 0.5 0.1 0.1'
  ELSE concat(cast(class_id AS varchar(9)), ' 0.', lpad(cast(cast(x1 AS int) AS varchar(9)), 3, '0'), ' 0.', lpad(cast(cast(y1 AS int) AS varchar(9)), 3, '0'), ' 0.125 0.25') END AS line FROM annotations""",
    "lineage": """SELECT image_id AS node_id, CASE WHEN image_id % 8 = 0 THEN cast(NULL AS bigint) ELSE image_id - 1 END AS parent_id, concat('ds', cast(image_id % 8 AS varchar(9))) AS dataset_name FROM samples""",
}


def needed(sql: str) -> list[str]:
    """Views that a text names, directly or through others, in order."""
    found: set[str] = set()
    texts = [sql]
    while texts:
        text = texts.pop()
        for name in VIEWS:
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                texts.append(VIEWS[name])
    return [v for v in VIEWS if v in found]


def chained(sql: str) -> str:
    """``sql`` (a SELECT, or CTEs before one) behind the views that it names."""
    parts = [f"{v} AS ({VIEWS[v]})" for v in needed(sql)]
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        recursive = body[5:].strip().upper().startswith("RECURSIVE ")
        rest = body[5:].strip()[10:] if recursive else body[5:]
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join([*parts, rest])
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or a view over base tables."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    chain = chained(f"SELECT * FROM {name}")
    used = [b for b in BASE if re.search(rf"\b{b}\b", chain)]
    for b in used:
        chain = re.sub(rf"\b(FROM|JOIN) {b}\b", rf"\1 {{{b}}}", chain)
    return spark.sql(chain, **{b: _base(spark, sf_dir, b) for b in used})


def _base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table as views read it: the lines of an order come together once, for all steps that go by image."""
    df = table(spark, sf_dir, name)
    return dealt(df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"), "l_orderkey") if name == "lineitem" else df


def beside_lines(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view with a row an image, dealt as the lines are: what is made of an image afterwards meets its lines without a shuffle of its own."""
    return dealt(table(spark, sf_dir, name), "image_id", table(spark, sf_dir, "lineitem"))
