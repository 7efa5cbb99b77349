"""SimHash near-duplicates, found with pivot distance tables.

A document's fingerprint is the bitwise majority over the XXH64 of its word
shingles. Every distinct fingerprint gets, once, a stored table of its Hamming
distances to many reference fingerprints. A pair whose tables differ by more
than ``max_bits`` in any coordinate is discarded (triangle inequality), and
what is left is verified on the bits.

Which pairs of tables are compared: distinct fingerprints at most 3 bits apart
agree on at least three of six bit groups, so they meet under one of twenty
keys; tables alone cannot deal pairs to machines. A bucket leaves only a
spanning set of its links, never all pairs. A bucket over ``BUCKET``
fingerprints is split under keys that fix all but twelve bits, so that no
bucket can exceed 4,096. Components come from min-label star contraction on
the links.

Results in odd cases: null, empty and word-less texts have fingerprint zero
and are linked like any other; fewer words than a shingle give one shingle;
repeated rows each keep a row; a null doc_id keeps its row and joins its
component, whose id is the smallest non-null one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import fresh, if_small, many_to_one, numbered, small_batches, stored

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Distinct fingerprints in a bucket beyond which it is split under longer keys.
BUCKET = 256
PIVOTS = 24


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = text.encode().lower().split()  # bytes: only A-Z and the six ASCII spaces
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(b" ".join(x), seed) for x in zip(*(words[i:] for i in range(shingle)), strict=False)]
    n, ones = len(hashes), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        part = np.array(hashes[i : i + (1 << 14)], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, row: str, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(row, doc_id, fp) of each row; ``row``: the column that numbers them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle, seed) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(fps, pa.int64())], ["row", "doc_id", "fp"])

    small_batches(docs.sparkSession)
    rows = docs.select(docs[row].alias("row"), docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def masks(groups: int, kept: int, bits: range = range(64)) -> list[int]:
    """Signed masks that each keep ``kept`` of ``groups`` groups of ``bits``."""
    parts = np.array_split(np.array(list(bits)), groups)
    out = []
    for chosen in combinations(range(groups), kept):
        mask = sum(1 << int(b) for g in chosen for b in parts[g])
        out.append(signed(mask))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Any two fingerprints 3 bits apart agree on 3 of 6 groups, and on 13 of 16 (all but 12 bits).
COARSE = masks(6, 3)
FINE = masks(16, 13)


def keyed(fps: DataFrame, keep: list[int]) -> DataFrame:
    """(mask, key, fp, pivots): every fingerprint, with its table, under every mask."""
    return fps.select("fp", "pivots", F.posexplode(F.array(*[F.lit(m).cast("long") for m in keep])).alias("mask", "bits")).select("mask", (F.col("fp").bitwiseAND(F.col("bits"))).alias("key"), "fp", "pivots")


def pivot_table(fp: F.Column, n: int = PIVOTS) -> F.Column:
    """Hamming distances to ``n`` reference fingerprints, the same everywhere, a byte each."""
    points = np.random.default_rng(SEED).integers(0, 1 << 64, n, dtype=np.uint64)
    return F.unhex(F.concat(*(F.lpad(F.hex(F.bit_count(fp.bitwiseXOR(F.lit(signed(int(p)))))), 2, "0") for p in points)))


def differences(tables: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The maximum coordinate difference of the tables of each pair."""
    return np.abs(tables[a] - tables[b]).max(-1)


def bucket_links(fp: np.ndarray, tables: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning set (fp, root) of the links among distinct fingerprints, sorted, of one bucket; root is the smallest of its local component."""
    n, bits = len(fp), fp.view(np.uint64)
    root = np.arange(n)
    for i in range(n - 1):
        near = np.arange(i + 1, n)
        near = near[differences(tables, near, np.int64(i)) <= max_bits]
        near = near[np.bitwise_count(bits[near] ^ bits[i]) <= max_bits]
        if len(near):
            roots = np.unique(np.append(root[near], root[i]))
            if len(roots) > 1:
                root[np.isin(root, roots[1:])] = roots[0]
    moved = np.nonzero(root != np.arange(n))[0]
    return [(int(fp[i]), int(fp[root[i]])) for i in moved]


def links_of(buckets: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) of rows (mask, key, fp, pivots); each bucket, already bounded, in one place."""

    def run(pdf_iter: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(pdf: pd.DataFrame) -> pd.DataFrame:
            mask, key, fp = (pdf[c].to_numpy() for c in ("mask", "key", "fp"))
            tables = np.frombuffer(b"".join(pdf["pivots"]), np.int8).reshape(len(fp), -1)
            cut = np.nonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))[0] + 1
            start, end = np.append(0, cut), np.append(cut, len(fp))
            out = []
            first = start[end - start == 2]
            first = first[differences(tables, first, first + 1) <= max_bits]
            first = first[np.bitwise_count((fp[first] ^ fp[first + 1]).view(np.uint64)) <= max_bits]
            out += list(zip(fp[first + 1].tolist(), fp[first].tolist(), strict=True))
            for s, e in zip(start[end - start > 2], end[end - start > 2], strict=True):
                out += bucket_links(fp[s:e], tables[s:e], max_bits)
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        for pdf in pdf_iter:
            pdf = pd.concat([*held, pdf]) if held else pdf
            if not len(pdf):
                continue
            last = pdf.iloc[-1]
            open_ = ((pdf["mask"] == last["mask"]) & (pdf["key"] == last["key"])).to_numpy()
            held = [pdf[open_]]
            if not open_.all():
                yield done(pdf[~open_])
        if held:
            yield done(held[0])

    return buckets.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInPandas(run, "a long, b long")


def all_links(spark: SparkSession, fps: DataFrame, bucket: int = BUCKET, max_bits: int = MAX_BITS) -> DataFrame:
    """Links that connect what is linked at all, among distinct fingerprints ``fps`` (fp)."""
    if max_bits > MAX_BITS:
        raise ValueError("the keys are made for 3 differing bits at most")
    small_batches(spark)
    tables = stored(spark, fps.select("fp", pivot_table(F.col("fp")).alias("pivots")), "simhash-pivots")
    coarse = keyed(tables, COARSE)
    sizes = coarse.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = stored(spark, sizes.select("mask", "key", "n"), "simhash-buckets")
    small = coarse.join(sizes.where(F.col("n") <= bucket).select("mask", "key"), ["mask", "key"], "left_semi")
    links = links_of(small, max_bits)
    large = sizes.where(F.col("n") > bucket)
    if not large.isEmpty():
        # Split: pairs that meet in a large bucket also meet under keys that fix 52 bits.
        hot = coarse.join(large.select("mask", "key"), ["mask", "key"], "left_semi").select("fp", "pivots").dropDuplicates(["fp"])
        fine = keyed(hot, FINE)
        shared = fine.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1").select("mask", "key")
        links = links.unionByName(links_of(fine.join(shared, ["mask", "key"], "left_semi"), max_bits))
    return stored(spark, links.distinct(), "simhash-links")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(fp, root) for all linked fingerprints: alternating large-star and small-star steps until the links are stars."""
    # Rows (u, v) with u > v.
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every neighbour above u goes to u's smallest neighbour.
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: u and its neighbours below go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array_distinct(F.array("u", "v"))).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        edges = stored(spark, small, "simhash-stars")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("fp"), "root")
        before = now


def near_duplicates(spark: SparkSession, docs: DataFrame, row: str | None = None, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(row, doc_id, fp, root, component_id) of each row of ``docs``; root: the component's smallest fingerprint; ``row``: a column that numbers the rows."""
    if row is None:
        row = fresh(docs)
        docs = docs.withColumn(row, F.monotonically_increasing_id())
    rows = stored(spark, fingerprints(docs, row, shingle), "simhash-fp")
    fps = stored(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_rows")), "simhash-distinct")
    roots = components(spark, all_links(spark, fps.select("fp"), max_bits=max_bits))
    rooted = fps.join(roots, "fp", "left").select("fp", "first", "n_rows", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stored(spark, rooted.join(least, "root").select("fp", "n_rows", "root", "component_id"), "simhash-classes")
    return many_to_one(rows, classes, "fp").select("row", "doc_id", "fp", "root", "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one of each component: the one with the smallest doc_id (null last), then the first row."""
    docs, row = numbered(spark, docs, "simhash-docs")
    rows = stored(spark, near_duplicates(spark, docs, row, shingle, max_bits).select("row", "doc_id", "root"), "simhash-rows")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("x")).select("x.row")
    kept = if_small(stored(spark, best, "simhash-best"), 16)
    return docs.join(kept, docs[row] == kept["row"], "left_semi").drop(row)
