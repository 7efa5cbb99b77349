"""Mixing to target weights with soft domain membership.

A classifier fitted to the labelled table gives every document its posterior
over domains. Nonnegative rates, one a document, are then sought so that the
expected token total of each domain, ``sum_d rate_d n_d p_d``, matches its
target: least squares in the metric of the domains' token-weighted Gram
matrix, by projected gradient steps from rate 1. A rate follows from the
document's posterior and the few gradient vectors of the steps so far, so a
step is one aggregation over the stored posteriors.

Domains: ``clean`` (quality 1, not toxic), ``low`` (quality 0, not toxic) and
``toxic``.

Results in odd cases: null and empty texts have no tokens; they get the prior
and a rate, and weigh nothing; without usable labels every document gets equal
posteriors; repeated rows each keep a row; label rows with a null, or without a
document, are not used; of several labels of a document the smallest counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from lumenframe.llm.common import base, fresh, small_batches, stored

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.9, "low": 0.1, "toxic": 0.0}
#: Most labelled documents that the classifier is fitted to, of each domain.
FIT_ROWS = 4000
BUCKETS = 1 << 18
#: A word is a feature if it is in so many of the fitted documents.
MIN_DOCS = 4
STEPS = 40
TOLERANCE = 1e-4
#: Rates below it count as none where a mix is carried out.
LEAST_RATE = 0.01


def features(text: str) -> tuple[np.ndarray, int]:
    """(distinct feature numbers, number of words) of a whole text: its words' hashes and a few shape classes."""
    words = text.lower().encode().split()
    n = len(words)
    distinct = set(words)
    crc = zlib.crc32
    ids = {crc(w.strip(b".,;:!?")) % BUCKETS for w in distinct}
    if n:
        letters = sum(map(str.isalpha, text)) / len(text)
        shape = (f"letters {int(letters * 20)}", f"distinct {int(10 * len(distinct) / n)} {min(n, 4095).bit_length()}", f"length {min(20, len(text) // n)}", f"size {n.bit_length()}")
        ids |= {crc(s.encode()) % BUCKETS for s in shape}
    return np.fromiter(ids, np.int64, len(ids)), n


def fit(rows: list[tuple[np.ndarray, int]], rounds: int = 120, l2: float = 2e-3) -> np.ndarray:
    """Multinomial logistic regression over feature presence: (BUCKETS + 1) x domains, the last row the bias."""
    k = len(DOMAINS)
    weights = np.zeros((BUCKETS + 1, k), np.float32)
    if not rows:
        return weights
    sets = [f for f, _ in rows]
    y = np.array([d for _, d in rows])
    seen = np.bincount(np.concatenate(sets), minlength=BUCKETS) if sets else np.zeros(BUCKETS)
    used = np.nonzero(seen >= MIN_DOCS)[0]
    number = np.full(BUCKETS, -1)
    number[used] = np.arange(len(used))
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    col = number[np.concatenate(sets)]
    row, col = row[col >= 0], col[col >= 0]
    w, bias = np.zeros((len(used), k)), np.log((np.bincount(y, minlength=k) + 1) / (len(y) + k))
    hot = np.eye(k)[y]
    scale, speed = np.zeros_like(w), 0.3
    for _ in range(rounds):
        z = np.stack([np.bincount(row, w[col, j], len(sets)) for j in range(k)], 1) + bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        miss = p - hot
        g = np.stack([np.bincount(col, miss[row, j], len(used)) for j in range(k)], 1) / len(sets) + l2 * w / 10
        scale += g * g
        w -= speed * g / (np.sqrt(scale) + 1e-6)
        bias -= speed * miss.mean(0)
    weights[used] = w
    weights[BUCKETS] = bias
    return weights


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[tuple[np.ndarray, int]]:
    """(features, domain) of at most ``fit_rows`` labelled documents of each domain, those with the smallest hashes; taken from whole texts on the executors."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    marks = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(F.struct("quality", "toxic")).alias("x")).select("doc_id", "x.quality", "x.toxic")
    marks = marks.select("doc_id", domain.alias("domain"), F.xxhash64("doc_id").alias("h"))
    count = {r["domain"]: r["n"] for r in marks.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not count:
        return []
    share = F.create_map(*[F.lit(x) for d, n in count.items() for x in (d, min(1.0, fit_rows / n))])
    chosen = marks.where(F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share[F.col("domain")])
    # About fit_rows of each domain at most: small enough to broadcast by construction. Ids may repeat; rows are counted.
    rows = docs.join(F.broadcast(chosen), "doc_id").select("h", "domain", F.xxhash64("text").alias("th"), "text")
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("domain").orderBy("h", "th"))).where(F.col("k") <= fit_rows).drop("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py())[0].astype(np.int32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", "th", "domain")), pa.array(found, pa.binary())], ["h", "th", "domain", "ids"])

    got = first.mapInArrow(run, "h long, th long, domain int, ids binary").collect()
    return [(np.frombuffer(r["ids"], np.int32).astype(np.int64), r["domain"]) for r in sorted(got, key=lambda r: (r["h"], r["th"]))]


def posterior(text: str, weights: np.ndarray) -> tuple[np.ndarray, int]:
    """(probability of each domain, number of words)."""
    ids, n = features(text)
    z = weights[ids].sum(0, dtype=np.float64) + weights[-1]
    p = np.exp(z - z.max())
    return p / p.sum(), n


def posteriors(spark: SparkSession, rows: DataFrame, text: str, keep: list[str], weights: np.ndarray, n: str = "n_tokens", p: str = "p") -> DataFrame:
    """The columns ``keep`` of ``rows`` with each text's number of words ``n`` and posterior ``p``, stored."""
    sent = spark.sparkContext.broadcast(weights)
    places, at = [rows.columns.index(c) for c in keep], rows.columns.index(text)
    k = len(DOMAINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            found = [posterior(t.as_py() or "", w) for t in batch.column(at)]
            flat = pa.array(np.concatenate([x for x, _ in found]) if found else np.zeros(0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * k, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), pa.array([x for _, x in found], pa.int64()), lists], [*keep, n, p])

    small_batches(spark)
    schema = StructType([*(rows.schema.fields[i] for i in places), StructField(n, LongType()), StructField(p, ArrayType(DoubleType()))])
    soft = stored(spark, rows.mapInArrow(run, schema), "mixing-soft")
    sent.destroy()
    return soft


def replay(p: str, steps: np.ndarray) -> F.Column:
    """Rates after the given gradient steps, from 1, of posteriors in the column ``p``."""
    rate = F.lit(1.0)
    if not len(steps):
        return rate
    vectors = F.array(*(F.array(*(F.lit(float(x)) for x in g)) for g in steps))

    def step(r: F.Column, g: F.Column) -> F.Column:
        down = F.lit(0.0)
        for i in range(steps.shape[1]):
            down = down + F.col(p)[i] * g[i]
        return F.greatest(F.lit(0.0), r - down)

    return F.aggregate(vectors, rate, step)


def fitted_steps(soft: DataFrame, target: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE, n: str = "n_tokens", p: str = "p") -> tuple[np.ndarray, np.ndarray]:
    """(gradient vectors, expected domain shares they lead to); targets are shares of all tokens."""
    k = len(target)
    soft = soft.select(n, p)
    pairs = soft.agg(*(F.coalesce(F.sum(F.col(n) * F.col(p)[i] * F.col(p)[j]), F.lit(0.0)).alias(f"g{i}_{j}") for i in range(k) for j in range(k))).first()
    gram = np.array(list(pairs), float).reshape(k, k)
    made, total = np.zeros((0, k)), gram.sum()  # posteriors add up to 1
    if total == 0:
        return made, np.zeros(k)
    metric = np.linalg.inv(gram / total + 1e-6 * np.eye(k))

    def shares() -> np.ndarray:
        rated = soft.select(n, p, replay(p, made).alias("rate"))
        return np.array(list(rated.agg(*(F.sum(F.col(n) * F.col("rate") * F.col(p)[i]).alias(f"s{i}") for i in range(k))).first()), float) / total

    share, last = shares(), None
    for _ in range(steps):
        miss = share - target
        if np.abs(miss).max() < tolerance or (last is not None and np.abs(share - last).max() < tolerance / 20):
            break
        last = share
        made = np.vstack([made, metric @ miss])
        share = shares()
    return made, share


def target_shares(targets: dict[str, float] | None) -> np.ndarray:
    target = np.array([(targets or TARGETS)[d] for d in DOMAINS], float)
    return target / target.sum()


def mix(spark: SparkSession, documents: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, n_tokens, p, rate) of each row of ``documents``."""
    docs = base(documents)
    soft = posteriors(spark, docs, "text", ["doc_id"], fit(labelled(docs, labels, fit_rows)))
    steps, _ = fitted_steps(soft, target_shares(targets))
    return soft.select("doc_id", "n_tokens", "p", replay("p", steps).alias("rate"))


def apply_rates(spark: SparkSession, documents: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, fit_rows: int = FIT_ROWS, least: float = LEAST_RATE) -> DataFrame:
    """The rows of ``documents`` and their ``rate``, less those whose likeliest domain has target 0 and whose rate is under ``least``: the mix leaves them out. All columns stay, but one named rate is replaced."""
    rows = documents.drop("rate")
    n, p = fresh(rows, "n_tokens"), fresh(rows, "p")
    soft = posteriors(spark, rows, "text", rows.columns, fit(labelled(base(documents), labels, fit_rows)), n, p)
    target = target_shares(targets)
    steps, _ = fitted_steps(soft, target, n=n, p=p)
    wanted = F.array(*(F.lit(float(t)) for t in target))[F.array_position(p, F.array_max(p)).cast("int") - 1] > 0
    return soft.withColumn("rate", replay(p, steps)).where((F.col("rate") >= least) | wanted).drop(n, p)
