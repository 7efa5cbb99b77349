"""The pipeline's stages, each against its own operator or brute force on its own input."""

from __future__ import annotations

import re


import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import decontaminate, mixing, pii, queries, simhash
from tests.llm.test_operators import ODD, SCHEMA, rows_of, slow_components, slow_fingerprint

SMALL = "/root/testdata/sf0.001"


def slow_words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow_contamination(docs, items, size):
    wins = {}
    for i, t in items:
        w = slow_words(t)
        n = min(size, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    import hashlib

    for d, t in docs:
        w = slow_words(t)
        hit, found = set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                k = tuple(w[s : s + n])
                if k in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[k]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontamination_odd(spark):
    items = [(1, "one two"), (2, "the same id text"), (3, None), (4, "..."), (5, "Long LONG"), (5, "long long"), (None, "a row without"), (7, "é 漢字 ÀÉ"), (8, "b a b a b a b a b a b a b a"), (9, "never there")]
    docs = [*ODD, (20, "b a b a b a b a b a b a! b, a-b", "en", "s", 0), (21, "one  TWO three One\ntwo", "en", "s", 0), (22, "à É straße 漢字 ÀÉ É 漢字 Àé é 漢字 ÀÉ", "fr", "s", 0), (None, "a row without an id", "en", "a", 9)]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("term", F.lit("x")).withColumn("row", F.lit(5)).withColumn("tid", F.lit(5)).withColumn("pos", F.lit(1)).withColumn("item_id", F.lit(9))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("wid", F.lit(1))
    got = decontaminate.contamination(spark, df, bench, 10).select(*COLUMNS)
    assert rows_of(got) == slow_contamination([(r[0], r[1]) for r in docs], items, 10)


@pytest.mark.parametrize("size", [3, 10])
def test_decontamination_small_tables(spark, size):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    got = decontaminate.contamination(spark, docs, items, size).select(*COLUMNS)
    assert rows_of(got) == slow_contamination(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect(), size)


def test_decontamination_empty(spark):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert decontaminate.contamination(spark, docs.limit(0), items).count() == 0
    clean = decontaminate.contamination(spark, docs, items.limit(0))
    assert clean.count() == docs.count() and clean.where("contaminated").count() == 0


def test_decontamination_stays_native(spark):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    plan = decontaminate.contamination(spark, docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x c y b z a"), (2, "a q q q q q b c"), (3, "c b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    got = lambda d: {r["doc_id"] for r in decontaminate.proximity(spark, docs, items, d).collect()}
    assert got(2) == set() and got(4) == {1} and got(7) == {1, 2}
    more = docs.unionByName(spark.createDataFrame([(1, "x c y b z a"), (None, None), (4, "")], "doc_id long, text string"))
    rows = decontaminate.proximity(spark, more, items, 4).collect()
    assert [(r["doc_id"], r["terms"], r["pos"]) for r in rows] == [(1, ["a", "b", "c"], rows[0]["pos"])] * 2 and rows[0]["row"] != rows[1]["row"]


def test_mixing_meets_targets(spark):
    df, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = mixing.mix(spark, df, labels).toPandas()
    p, n, rate = np.stack(rows["p"]), rows["n_tokens"].to_numpy(), rows["rate"].to_numpy()
    assert len(rows) == df.count() and (rate >= 0).all() and np.allclose(p.sum(1), 1)
    share = (n * rate) @ p / n.sum()
    assert np.abs(share - [0.9, 0.1, 0.0]).max() < 0.02


def slow_projected_gradient(p, n, target, steps=4000):
    """All rates by plain projected gradient descent, in the metric of the Gram matrix."""
    total = n.sum()
    metric = np.linalg.inv((p.T @ (p * n[:, None])) / total + 1e-6 * np.eye(p.shape[1]))
    rate = np.ones(len(p))
    for _ in range(steps):
        rate = np.maximum(0, rate - p @ (metric @ ((n * rate) @ p / total - target)))
    return rate


def test_mixing_steps_solve_the_least_squares(spark):
    """The distributed steps against plain projected gradient descent on all rates."""
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3] * 3, 200)
    n = rng.integers(1, 50, 200)
    soft = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    target = np.array([0.6, 0.3, 0.1])
    steps, share = mixing.fitted_steps(soft, target, 40, 1e-7)
    assert np.abs(share - target).max() < 1e-3
    rate = np.array([r[0] for r in soft.select(mixing.replay("p", steps)).collect()])
    assert np.allclose((n * rate) @ p / n.sum(), share)
    assert np.allclose(rate, slow_projected_gradient(p, n, target), atol=1e-3)


def slow_features(text):
    import zlib

    words = (text or "").lower().encode().split()
    ids = {zlib.crc32(w.strip(b".,;:!?")) % mixing.BUCKETS for w in words}
    if words:
        letters = sum(c.isalpha() for c in text) / len(text)
        d = len(set(words))
        for s in (f"letters {int(letters * 20)}", f"distinct {int(10 * d / len(words))} {min(len(words), 4095).bit_length()}", f"length {min(20, len(text) // len(words))}", f"size {len(words).bit_length()}"):
            ids.add(zlib.crc32(s.encode()) % mixing.BUCKETS)
    return sorted(ids), len(words)


def slow_mixture(docs, labels):
    """(p, n, rate) of each text of docs (doc_id, text): dense logistic regression, then projected gradient descent on all rates."""
    mark = {}
    for d, q, t in labels:
        if None not in (d, q, t):
            mark[d] = min(mark.get(d, (q, t)), (q, t))
    domain = {d: 2 if t == 1 else 1 if q == 0 else 0 for d, (q, t) in mark.items()}
    found = [slow_features(t) for _, t in docs]
    train = [(i, domain[d]) for i, (d, _) in enumerate(docs) if d in domain]
    seen = np.zeros(mixing.BUCKETS)
    for i, _ in train:
        seen[found[i][0]] += 1
    used = {f: j for j, f in enumerate(np.nonzero(seen >= mixing.MIN_DOCS)[0].tolist())}
    dense = np.zeros((len(docs), len(used)))
    for i, (ids, _) in enumerate(found):
        dense[i, [used[f] for f in ids if f in used]] = 1
    x, y = dense[[i for i, _ in train]], np.array([d for _, d in train])
    hot = np.eye(3)[y]
    w, bias, scale = np.zeros((len(used), 3)), np.log((hot.sum(0) + 1) / (len(y) + 3)), np.zeros((len(used), 3))
    soft = lambda z: np.exp(z - z.max(1, keepdims=True)) / np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)
    for _ in range(120):
        miss = soft(x @ w + bias) - hot
        g = x.T @ miss / len(y) + 2e-3 * w / 10
        scale += g * g
        w, bias = w - 0.3 * g / (np.sqrt(scale) + 1e-6), bias - 0.3 * miss.mean(0)
    p, n = soft(dense @ w + bias), np.array([k for _, k in found])
    return p, n, slow_projected_gradient(p, n, np.array([0.9, 0.1, 0.0]))


def test_mixing_query_against_brute_force(spark):
    """Every row of the query on the smallest tables: posteriors, and expected shares as good as those of all rates descended at once."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    p, n, rate = slow_mixture(docs, labels)
    got = {r["doc_id"]: r for r in queries.op3_mixing(spark, SMALL).collect()}
    assert len(got) == len(docs)
    mine = np.array([[got[d][f"p_{k}"] for k in mixing.DOMAINS] for d, _ in docs])
    assert np.allclose(mine, p, atol=2e-4) and [got[d]["n_tokens"] for d, _ in docs] == n.tolist()
    rates = np.array([got[d]["rate"] for d, _ in docs])
    share = lambda r: (n * r) @ p / n.sum()
    assert np.abs(share(rates) - share(rate)).max() < 5e-3 and (rates >= 0).all()


def test_mixing_odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA).withColumn("rate", F.lit("clash")).withColumn("p", F.lit(1))
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 1, 1), (None, 1, 0), (5, None, 0), (6, 1, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    assert mixing.mix(spark, df, labels).count() == len(ODD)
    assert mixing.mix(spark, df, labels.limit(0)).count() == len(ODD)
    assert mixing.mix(spark, df.limit(0), labels).count() == 0
    assert mixing.apply_rates(spark, df, labels).count() == len(ODD)


def test_near_duplicates_leave_one(spark):
    df = spark.createDataFrame([*ODD, (None, None, None, None, None)], SCHEMA).withColumn("root", F.lit("clash")).withColumn("__x", F.lit(1))
    got = simhash.one_of_each(spark, df)
    assert got.columns == df.columns
    rows = df.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r["text"]) for r in rows]
    groups = slow_components([(i, fp) for i, fp in enumerate(fps)])
    assert got.count() == len(set(groups))
    kept = [r["doc_id"] for r in got.collect()]
    want = [min((rows[i]["doc_id"] for i in range(len(rows)) if groups[i] == g and rows[i]["doc_id"] is not None), default=None) for g in set(groups)]
    assert sorted(kept, key=repr) == sorted(want, key=repr)


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminated", "personal_data", "mixed"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if i < 4:
            assert out.columns == docs.columns
        rows = out.toPandas()
        assert 0 < len(rows) <= docs.count() and rows["doc_id"].is_unique
        if name == "language":
            assert len(rows) >= 0.97 * docs.count()
        if name == "near_duplicates":
            fps = docs.select("doc_id", "text").collect()
            want = {c for c in slow_components([(r["doc_id"], slow_fingerprint(r["text"])) for r in fps])}
            assert set(rows["doc_id"]) == want
        if name == "decontaminated":
            items = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()
            assert set(rows["doc_id"]) == {r[0] for r in slow_contamination(docs.select("doc_id", "text").collect(), items, 10) if not r[5]}
        if name == "personal_data":
            assert len(rows) == docs.count()
            assert not any(s for t in rows["text"] for s in pii.base_spans(t)["email"])
            assert (rows["n_chars"] == rows["text"].str.len()).all()
        if name == "mixed":
            assert (rows["rate"] >= 0).all()
            marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
            left = {d for d in marks if d in set(docs.toPandas()["doc_id"])} - set(rows["doc_id"])
            assert all(marks[d] == 1 for d in left)  # only toxic ones go
        docs = spark.createDataFrame(rows[docs.columns], docs.schema)


def test_whole_run(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", "rate"] and rows.count() > 100


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_stages_on_odd_tables(spark, which):
    """Each stage keeps the columns and does not fail on nulls, repeated rows, long texts and clashing columns, or without rows."""
    df = spark.createDataFrame(ODD, SCHEMA).withColumn("row", F.lit("clash")).withColumn("p", F.lit(1)).withColumn("th", F.lit(2)).withColumn("n_tokens", F.lit("c"))
    df = df.limit(0) if which == "empty" else df
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, df, SMALL)
        assert got.columns == (df.columns if name != "mixed" else [*df.columns, "rate"])
        n = got.count()
        if which == "empty":
            assert n == 0
        elif name in ("decontaminated", "personal_data"):
            assert n == len(ODD)
        elif name == "near_duplicates":
            assert n == len({c for c in slow_components([(i, slow_fingerprint(r[1])) for i, r in enumerate(ODD)])})


def test_run_on_an_empty_table(spark, tmp_path):
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
