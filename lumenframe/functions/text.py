"""Names, paths and digests as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of splits, and what a slug may hold and falls back to.
SPLITS = {"train": "train", "training": "train", "val": "val", "valid": "val", "validation": "val", "test": "test"}
SLUG_CHARACTERS, SLUG_EDGES, SLUG_EMPTY = "A-Za-z0-9._-", "-._", "dataset"


def slug(x: Column, most: int = 80) -> Column:
    """Lower-case letters, digits, dot, dash and underscore; longer ones end in 12 digits of the digest of the whole slug."""
    if most < 14:
        raise ValueError("a slug has at least 14 characters")
    clean = F.btrim(F.regexp_replace(x, f"[^{SLUG_CHARACTERS}]+", "-"), F.lit(SLUG_EDGES))
    whole = F.lower(F.when(clean == "", F.lit(SLUG_EMPTY)).otherwise(clean))
    cut = F.rtrim(F.substring(whole, 1, most - 13), F.lit(SLUG_EDGES))
    return F.when(F.length(whole) > most, F.concat(cut, F.lit("-"), F.substring(F.sha2(whole, 256), 1, 12))).otherwise(whole)


def plain_slug(x: str) -> str:
    """As :func:`slug` for one text on the driver, in its own case and at any length."""
    return re.sub(f"[^{SLUG_CHARACTERS}]+", "-", x).strip(SLUG_EDGES) or SLUG_EMPTY


def elided(x: Column, most: int) -> Column:
    """The middle of a long text gives way to an ellipsis."""
    head, tail = (most - 1) // 2, most - 1 - (most - 1) // 2
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, head), F.lit("…"), F.right(x, F.lit(tail)))).otherwise(x)


def split_name(x: Column) -> Column:
    """Canonical split of any spelling; null stays null, any other name raises."""
    names = F.create_map(*[F.lit(v) for kv in SPLITS.items() for v in kv])
    refused = F.raise_error(F.concat(F.lit("no split: "), x)).cast("string")
    return F.when(x.isNotNull(), F.coalesce(names[F.lower(x)], refused))


def number_token(x: Column) -> Column:
    """Eight decimals, trailing zeros trimmed, p for the dot."""
    s = F.regexp_replace(F.regexp_replace(F.format_string("%.8f", x), "0+$", ""), r"\.$", "")
    return F.replace(s, F.lit("."), F.lit("p"))


def label_path(image: Column) -> Column:
    """The label file of an image: the last ``images`` segment becomes ``labels``, the suffix ``.txt``."""
    swapped = F.regexp_replace(image, r"^(.*/|)images/((?:(?!images/).)*)$", "$1labels/$2")
    return F.concat(F.regexp_replace(swapped, r"\.[^./]*$", ""), F.lit(".txt"))


def seed_of(*parts: Column) -> Column:
    """First four bytes of the SHA-256 of the parts joined by colons, as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 8), 16, 10).cast("long")


def frozen_id(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL."""
    return F.sha2(F.concat_ws("\x00", *parts), 256)
