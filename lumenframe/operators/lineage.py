"""Lineage: recursive tracing, frozen cohorts and digests."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.text import frozen_id, plain_slug
from lumenframe.operators.shared import deleted, stored


def trace(lineage: DataFrame) -> DataFrame:
    """(node_id, root_id, depth, chain) of nodes (node_id, parent_id, dataset_name): pointers are doubled, so log2(depth) joins do.

    A node on a cycle, or behind one, has no root and is left out: doubling goes on, each step
    written to the shared folder, until no further node ends.
    """
    spark, before = lineage.sparkSession, None
    now = lineage.select("node_id", F.coalesce("parent_id", "node_id").alias("up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"), F.array("dataset_name").alias("chain"), F.col("parent_id").isNull().alias("done"))
    left = None
    while True:
        now, path = stored(now, "lineage-trace")
        deleted(spark, before)
        before = path
        unsettled = now.where(~F.col("done")).count()
        # A chain that ends has a node at every depth below its own, so each step ends some.
        if unsettled in (0, left):
            break
        left = unsettled
        above = now.select(F.col("node_id").alias("u"), F.col("up").alias("u_up"), F.col("depth").alias("u_depth"), F.col("chain").alias("u_chain"), F.col("done").alias("u_done"))
        both = now.join(above, now["up"] == above["u"], "left")
        go = ~F.col("done")
        now = both.select("node_id", F.when(go, F.col("u_up")).otherwise(F.col("up")).alias("up"), F.when(go, F.col("depth") + F.col("u_depth")).otherwise(F.col("depth")).alias("depth"), F.when(go, F.concat("chain", "u_chain")).otherwise(F.col("chain")).alias("chain"), (F.col("done") | F.coalesce("u_done", F.lit(False))).alias("done"))
    return now.where("done").select("node_id", F.col("up").alias("root_id"), "depth", F.array_join("chain", ">").alias("chain"))


def rewritten(paths: F.Column, rewrites: Mapping[str, str]) -> F.Column:
    """Paths below a folder that moved, by the first of ``rewrites`` that holds them; null for others. Whole folder names only: ``/a/b`` does not hold ``/a/bc``."""
    out = F.lit(None).cast("string")
    for old, new in reversed(list(rewrites.items())):
        old, new = old.rstrip("/"), new.rstrip("/")
        out = F.when((paths == old) | F.startswith(paths, F.lit(old + "/")), F.concat(F.lit(new), F.substring(paths, len(old) + 1, 1 << 20))).otherwise(out)
    return out


def moved_path(path: str, rewrites: Mapping[str, str]) -> str | None:
    """As :func:`rewritten`, of one path."""
    for old, new in rewrites.items():
        old = old.rstrip("/")
        if path == old or path.startswith(old + "/"):
            return new.rstrip("/") + path[len(old) :]
    return None


def suffixes(path: str) -> F.Column:
    """(suffix, parts) of a path, from the file's name on, as an array."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) < 1, F.array().cast("array<struct<suffix:string,parts:int>>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, -n, n), "/").alias("suffix"), n.alias("parts"))))


def resolved(records: DataFrame, files: DataFrame, rewrites: Mapping[str, str] | None = None) -> DataFrame:
    """``records`` (path, sha256) with where each file is now, ``resolved``, and how that was found, ``resolved_by``.

    ``files`` (root int, path, sha256) lists the roots' files, in the order in which
    the roots are searched; those of root -1 are found by their whole paths only. A path
    that moved by one of ``rewrites`` comes first (``path-rewrite``), then the path itself
    (``stored-path``), then the file that shares the most trailing names with it
    (``search``); ties go to the earlier root, then the smaller path. A file counts only if
    it has the recorded digest, where there is one. Others are ``unresolved``; a null
    path has null.

    Every suffix of a file keeps one file by digest, and one of all, so a common
    name such as ``0.jpg`` meets each record once, however many files bear it. Suffixes
    and records travel as the first 128 bits of their SHA-256.
    """
    named = files.where("path is not null")
    whole = named.select("root", "path", "sha256", F.lit(0).alias("kind"), F.col("path").alias("suffix"))
    ends = whole.unionByName(named.where("root >= 0").select("root", "path", "sha256", F.lit(1).alias("kind"), F.explode(suffixes("path")["suffix"]).alias("suffix")))
    both = F.array(_short("kind", "suffix", F.lit("")), F.when(F.col("sha256").isNotNull(), _short("kind", "suffix", F.col("sha256"))))
    index = ends.select("root", "path", F.explode(both).alias("key")).groupBy("key").agg(F.min(F.struct("root", F.col("path").alias("found"))).alias("best")).select("key", "best.found")
    digest = F.coalesce("sha256", F.lit(""))
    rows = records.withColumn("__record", F.when(F.col("path").isNotNull(), _short(F.lit(2), "path", digest)))
    key = lambda kind, step, suffix, parts: F.struct(F.lit(kind).alias("kind"), F.lit(step).alias("step"), suffix.alias("suffix"), parts.cast("int").alias("parts"))
    direct = F.array(key(0, 0, rewritten(F.col("path"), rewrites or {}), F.lit(0)), key(0, 1, F.col("path"), F.lit(0)))
    wanted = F.concat(direct, F.transform(suffixes("path"), lambda s: key(1, 2, s["suffix"], s["parts"])))
    keys = rows.where("path is not null").select("__record", digest.alias("digest"), F.explode(wanted).alias("k")).where("k.suffix is not null")
    met = keys.select("__record", "k.step", "k.parts", F.explode(F.array(_short("k.kind", "k.suffix", F.col("digest")))).alias("key")).join(index, "key")
    best = met.groupBy("__record").agg(F.min(F.struct("step", (-F.col("parts")).alias("parts"), "found")).alias("b"))
    how = F.element_at(F.array(F.lit("path-rewrite"), F.lit("stored-path"), F.lit("search")), F.col("b.step") + 1)
    found = best.select("__record", F.col("b.found").alias("resolved"), how.alias("resolved_by"))
    out = rows.join(found, "__record", "left").select(*records.columns, "resolved", "resolved_by")
    return out.withColumn("resolved_by", F.when(F.col("path").isNotNull(), F.coalesce("resolved_by", F.lit("unresolved"))))


def _short(kind: F.Column | str, suffix: F.Column | str, digest: F.Column) -> F.Column:
    """16 bytes that stand for a suffix of a kind and the digest that its file has to have."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    text = F.concat(kind.cast("string"), F.length(digest).cast("string"), F.lit(":"), digest, suffix)
    return F.unhex(F.left(F.sha2(text, 256), F.lit(32)))


def freeze(samples: DataFrame, annotations: DataFrame) -> DataFrame:
    """(image_id, original_id, annotation_sha256): digests of identity and of the ordered annotations of each image."""
    line = F.concat_ws(" ", "class_id", *(F.format_string("%.6f", c) for c in ("x1", "y1", "x2", "y2")))
    per = annotations.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ann_idx", line.alias("line")))), lambda s: s["line"]), "\n").alias("lines"))
    rows = samples.join(per, "image_id", "left")
    return rows.select("image_id", frozen_id(F.col("group_key"), F.col("relative_path")).alias("original_id"), F.sha2(F.coalesce("lines", F.lit("")), 256).alias("annotation_sha256"))


def fingerprint(value: Any, digits: int = 8) -> str:
    """First digits of the SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:digits]


def described(callback: Callable | None) -> dict[str, str | None] | None:
    """What a record keeps of a caller's function: its name and a digest of its source, or of its code where there is no source."""
    if callback is None:
        return None
    try:
        text = inspect.getsource(callback).encode()
    except (OSError, TypeError):
        text = getattr(getattr(callback, "__code__", None), "co_code", b"")
    name = f"{getattr(callback, '__module__', None)}.{getattr(callback, '__qualname__', type(callback).__qualname__)}"
    return {"name": name, "sha256": hashlib.sha256(text).hexdigest() if text else None}


def _first(names: Any) -> str:
    return "-".join(plain_slug(str(x)) for x in list(names)[:3])


#: What an operation adds to a name, from its settings; others add their own name.
DETAILS: dict[str, Callable[[dict[str, Any]], str]] = {
    "split": lambda s: "split-" + "-".join(f"{k}{int(v * 100)}" for k, v in s["ratios"].items()),
    "move-images-with-classes": lambda s: f"move-{_first(s['classes'])}-to-{s['to']}",
    "move-n-groups": lambda s: f"move-{s['n']}-groups-{s['from']}-to-{s['to']}",
    "remove-classes": lambda s: f"merge-{_first(s['classes'])}-into-{plain_slug(str(s['merge_into']))}" if s.get("merge_into") is not None else f"remove-{_first(s['classes'])}",
    "rename-classes": lambda s: f"rename-{_first(s.values())}",
    "rebalance-empty": lambda s: f"empty-max{int(float(s['fraction']) * 100)}",
    "tile": lambda s: f"tile-{s['mode']}-{s['size']}",
    "augment": lambda s: f"augment-{s['copies']}x",
}


def derived_name(name: str, operation: str, settings: dict[str, Any]) -> str:
    """Name, what the operation adds and eight digits of the settings' fingerprint, as a slug."""
    kind = operation.replace("_", "-")
    detail = DETAILS.get(kind, lambda _: kind)(settings)
    return plain_slug("__".join((name, detail, fingerprint(settings))))


def chained(lineage: DataFrame, operation: str, settings: dict[str, Any]) -> DataFrame:
    """Records with one more step at the end of their chains."""
    step = F.struct(F.lit(operation).alias("operation"), F.lit(fingerprint(settings)).alias("settings_fingerprint"))
    return lineage.withColumn("chain", F.concat(F.coalesce("chain", F.array().cast("array<struct<operation:string,settings_fingerprint:string>>")), F.array(step)))
