"""Filter audit, whitening and packing against brute force, and in odd cases."""

from __future__ import annotations

import random
import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenframe.llm import filter_audit, packing, queries, whitening
from tests.llm.test_operators import ODD, SCHEMA, rows_of

SMALL = "/root/testdata/sf0.001"
VOCABULARY = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def odd_docs(spark, extra=()):
    return spark.createDataFrame([*ODD, *extra], SCHEMA).withColumns({"row": F.lit("x"), "part": F.lit(1), "n": F.lit(2), "digest": F.lit(3), "word": F.lit(4), "mask": F.lit(5), "ids": F.lit(6), "piece": F.lit(7)})


# --- filter audit -----------------------------------------------------------


def slow_audit(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    out = {}
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > smallest[t]}
        good = any(i is not None and j == i and q == 1 for j, q, _ in labels)
        toxic = any(i is not None and j == i and x == 1 for j, _, x in labels)
        for o in permutations("ABCDE"):
            for s, k in enumerate(o):
                row = out.setdefault((lang or "", "".join(o), s + 1), [0] * 6)
                gone = any(f[x] for x in o[:s])
                row[0] += not gone and not f[k]
                row[1] += not gone and f[k]
                row[2] += gone and f[k]
                row[3] += f[k] and sum(f.values()) == 1
                row[4] += not gone and f[k] and good
                row[5] += not gone and f[k] and toxic
    shapley = {}
    for (part, o, s), row in out.items():
        shapley[part, o[s - 1]] = shapley.get((part, o[s - 1]), 0) + row[1]
    return sorted((*k, *row, shapley[k[0], k[1][k[2] - 1]]) for k, row in out.items())


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_filter_audit_odd(spark):
    many = " ".join(f"w{i}" for i in range(150))
    extra = [(30, many, "en", "a", 0), (31, many, "de", "a", 0), (29, many, "en", "a", 0), (31, many, "de", "a", 0), (None, many, None, "a", 0), (40, many + " A#", "", "a", 0), (41, "ABC " * 120, "en", "a", 0), (42, "\x0b\x0c", "en", "a", 0), (43, " no space ÀÉ", "en", "a", 0)]
    labels = [(30, 1, 0), (30, 0, 1), (31, 1, None), (None, 1, 1), (4, None, 1), (99, 1, 1), (41, 1, 1)]
    df = odd_docs(spark, extra)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("z"))
    got = filter_audit.audit(spark, df, marks).select(*AUDIT)
    want = slow_audit([(r[0], r[1], r[2]) for r in [*ODD, *extra]], labels)
    assert rows_of(got) == sorted(want, key=repr)


def test_filter_audit_empty_and_hot(spark):
    none = spark.createDataFrame([], SCHEMA)
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark, none, no_labels).count() == 0
    # 5,000 copies of one text pass the bound under which a key is joined by broadcast.
    hot = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"))
    rest = spark.range(5000, 5200).select(F.col("id").alias("doc_id"), F.concat(F.lit("own "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    failed = filter_audit.failures(spark, hot.unionByName(rest).repartition(3))
    assert failed.count() == 5200 and failed.where("e").count() == 4999 and failed.where("e and doc_id = 0").isEmpty()


def test_filter_audit_query(spark, docs):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(f"SELECT {', '.join(AUDIT)} FROM ({queries.SQL['op11_filter_audit']})").fetchall()
    got = rows_of(queries.op11_filter_audit(spark, SMALL).select(*AUDIT))
    assert got == sorted(want, key=repr) and len(got) % 600 == 0
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality", "toxic")
    assert got == sorted(slow_audit([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], [tuple(r) for r in labels.collect()]), key=repr)


# --- whitening --------------------------------------------------------------


def slow_whitening(vectors, k=8):
    """{place: (deviation, [|whitened|])}, explained, of vectors by numpy's own solver in one go."""
    x = np.floor(1024 * np.asarray(vectors, float)).astype(object) + 100000
    n, s = len(x), x.sum(0)
    centred = np.array([[float(n * e - t) / n for e, t in zip(r, s)] for r in x])
    values, q = np.linalg.eigh(centred.T @ centred / n)
    values, q = values[::-1], q[:, ::-1]
    white = np.abs(centred @ q[:, :k] / np.sqrt(values[:k]))
    return [sum((n * e - t) ** 2 for e, t in zip(r, s)) for r in x], white, values[:k] / values.sum()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    m = rng.normal(size=(n, n))
    for a in (m + m.T, m @ m.T, np.zeros((n, n)), np.eye(n), np.diag(np.arange(n) // 2), np.ones((n, n)) * 1e9 + np.eye(n)):
        values, q = whitening.symmetric_qr(a)
        size = max(1.0, np.abs(a).max())
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-11 * size)
        assert np.allclose(q.T @ q, np.eye(n), atol=1e-12) and np.allclose(a @ q, q * values, atol=1e-10 * size)


def test_moments_merge_far_from_zero():
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (999, 5)) + 10**8
    whole = whitening.Moments.empty(5, True)
    whole.add(x)
    parts = []
    for a, b in ((0, 1), (1, 500), (500, 999)):
        parts.append(whitening.Moments.empty(5, True))
        parts[-1].add(x[a:b])
    merged = parts[0].merge(parts[1]).merge(parts[2])
    want = np.cov((x - 10**8).T, bias=True)
    for m in (whole, merged):
        assert m.n == 999 and m.sums == x.sum(0).tolist() and np.allclose(m.scatter / m.n, want, rtol=1e-9, atol=1e-5)


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = {(r["vec_id"], r["component"]): r for r in queries.op12_whitening(spark, SMALL).collect()}
    deviation, white, explained = slow_whitening([r["embedding"] for r in rows])
    assert len(got) == 8 * len(rows)
    for i, r in enumerate(rows):
        for k in range(8):
            row = got[r["vec_id"], k + 1]
            assert row["n"] == len(rows) and row["deviation"] == deviation[i]
            assert abs(abs(row["whitened"]) - white[i, k]) < 1e-7
            assert abs(row["explained"] / explained[k] - 1) < 1e-9 and 0 <= row["identity_error"] < 1e-9


def test_whitening_many_partitions_same_sign(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    one = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whiten(spark, df.coalesce(1)).collect()}
    many = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whiten(spark, df.repartition(37)).collect()}
    for k in range(1, 9):
        a, b = (np.array([w[i, c] for i, c in sorted(one) if c == k]) for w in (one, many))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6


def test_whitening_odd(spark):
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (2, [3.5, -1.0], "b"), (None, [0.25, 0.125], "c"), (3, None, "d"), (4, [1.0, None], "e"), (5, [float("nan"), 1.0], "f"), (6, [float("inf"), 1.0], "g"), (7, [], "h"), (8, [1.0, 2.0, 3.0], "i"), (9, [5.0], "j"), (10, [5.0], "k")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").withColumns({"component": F.lit(1), "x": F.lit("y"), "dim": F.lit(4)})
    got = whitening.whiten(spark, df).collect()
    assert sorted(((r["vec_id"], r["component"], r["n"]) for r in got), key=repr) == sorted([(i, c, 4) for i in (1, 1, 2, None) for c in (1, 2)] + [(8, c, 1) for c in (1, 2, 3)] + [(9, 1, 2), (10, 1, 2)], key=repr)
    deviation, white, explained = slow_whitening([[1.0, 2.0], [1.0, 2.0], [3.5, -1.0], [0.25, 0.125]])
    of = {(r["vec_id"], r["component"]): r for r in got}
    assert of[2, 1]["deviation"] == deviation[2] and abs(abs(of[2, 2]["whitened"]) - white[2, 1]) < 1e-9 and abs(of[None, 1]["explained"] - explained[0]) < 1e-12
    assert all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in got if r["vec_id"] in (8, 9, 10))
    assert whitening.whiten(spark, df.where("false")).count() == 0
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark, spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")).collect()


def test_deviation_is_exact_or_null():
    x = np.array([[3, 2**40], [5, -(2**40)], [7, 0]])
    assert whitening.deviations(x, 3, x.sum(0).tolist()) == [None, None, 36 - 36 + (3 * 7 - 15) ** 2]
    y = np.array([[2**30, 1], [2**30 + 5, 4]])
    assert whitening.deviations(y, 2, y.sum(0).tolist()) == [25 + 9, 25 + 9]


# --- packing ----------------------------------------------------------------


def library_ids(texts):
    tok = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    return [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def checked(rows, docs, size):
    """Pieces hold their documents whole, cuts are where they must be, and sequences are gapless; returns the number of sequences."""
    def text(r):
        return np.frombuffer(r["ids"], "<u4").tolist()

    want = sorted(((d, p, at, tuple(ids[at : at + size])) for (d, _), ids in zip(docs, library_ids([t for _, t in docs]), strict=True) for p, at in enumerate(range(0, len(ids), size))), key=repr)
    assert sorted(((r["doc_id"], r["piece"], r["start"], tuple(text(r))) for r in rows), key=repr) == want
    by = {}
    for r in rows:
        assert r["length"] == len(text(r))
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing_odd(spark):
    strange = ["it's we'll they've 'tis don't. end.", "a.b c... d!? $5,000.00 (x), \"y\". 'z'.", "İstanbul ΣΑΣ ﬁne é é́, ‍x y. ½. ²,", "<|endoftext|>. <|ENDOFTEXT|>, a<|startoftext|>; x<|endoftext|", "ÀÉ. straße, 漢字。漢字. ١٢٣. 1a2b. _x_. -. .", "\x1c\x1d\x85a b　c.", "word " * 300 + "word.", "H\u0331. h\u0331 T\u0308 t\u0308, E\u0301e\u0301. A\u030a", "<|EndOfText|> A<|END. B.<|endoftext|>C. K\u212a\u2126"]
    data = [*ODD, *((50 + i, t, "en", "s", 0) for i, t in enumerate(strange))]
    for size in (2048, 7):
        rows = packing.pack(spark, odd_docs(spark, data[len(ODD) :]), public_tokenizers.path(VOCABULARY), size, most=5, window=3).collect()
        checked(rows, [(r[0], r[1]) for r in data], size)
    assert packing.pack(spark, spark.createDataFrame([], SCHEMA), public_tokenizers.path(VOCABULARY)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_packing_other_vocabularies(spark, name):
    import sentencepiece

    path = public_tokenizers.path(name)
    encode = (lambda t: sentencepiece.SentencePieceProcessor(model_file=path).encode(t)) if name.endswith(".model") else (lambda t: Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids)
    rows = packing.pack(spark, odd_docs(spark).where("doc_id in (2, 5, 6)"), path, end_id=1).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in rows} == {r[0]: [*encode(r[1]), 1] for r in ODD if r[0] in (2, 5, 6)}


def test_packing_query(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    ids = library_ids([r["text"] for r in rows])
    packed = packing.pack(spark, docs, public_tokenizers.path(VOCABULARY))
    count = checked(packed.collect(), [tuple(r) for r in rows], 2048)
    assert count <= 1.01 * -(-sum(map(len, ids)) // 2048) + 1
    got = {(r["doc_id"], r["piece"]): r for r in queries.op13_packing(spark, SMALL).collect()}
    for r, i in zip(rows, ids, strict=True):
        for p, at in enumerate(range(0, len(i), 2048)):
            cut = np.array(i[at : at + 2048], "<u4")
            row = got.pop((r["doc_id"], p))
            assert (row["start"], row["length"], row["ids_crc32"]) == (at, len(cut), zlib.crc32(cut.tobytes()))
    assert not got
    whole = packing.sequences(packed).collect()
    assert len(whole) == count and all(len(r["ids"]) == 4 * r["length"] for r in whole)


def test_packing_stays_narrow(spark, docs):
    plan = packing.pack(spark, docs, public_tokenizers.path(VOCABULARY))._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_chunk_ids_forgets_without_changing(monkeypatch):
    monkeypatch.setattr(packing, "CHUNKS_KEPT", 40)
    path = public_tokenizers.path(VOCABULARY)
    encode = packing.encoder(path, open(path, "rb").read())
    assert isinstance(encode, packing.ChunkIds)
    rng = random.Random(5)
    stems = ["alpha", "Beta", "γάμμα", "don't", "x1", "42", "ﬁ", "É", "and,so", "a.b"]
    texts = [" ".join(rng.choice(stems) + rng.choice(["", ".", ",", "...", "!?", "'", "\".", "*", "|"]) for _ in range(rng.randrange(30))) for _ in range(200)]
    for i in range(0, 200, 20):
        assert [np.frombuffer(b, "<u4").tolist() for b in encode(pa.array(texts[i : i + 20]))] == [x[:-1] for x in library_ids(texts[i : i + 20])]


def slow_best_fit(pieces, size, most):
    """The same rule over a plain list of open sequences: [id, free], and the number opened."""
    opened, n, out = [], 0, []
    for p in pieces:
        fits = [b for b in opened if b[1] >= p]
        if fits:
            least = min(b[1] for b in fits)
            b = [x for x in opened if x[1] == least][-1]
            opened.remove(b)
        else:
            b, n = [n, size], n + 1
        out.append((b[0], size - b[1]))
        b[1] -= p
        if b[1]:
            if len(opened) == most:
                least = min(x[1] for x in opened)
                opened.remove([x for x in opened if x[1] == least][-1])
            opened.append(b)
    return out


@pytest.mark.parametrize("most", [1, 3, 50])
def test_best_fit_against_brute_force(most):
    rng = random.Random(most)
    pieces = [rng.choice([rng.randint(1, 40), rng.randint(1, 8), 40]) for _ in range(400)]
    bins = packing.OpenSequences(40, most)
    assert [bins.place(p) for p in pieces] == slow_best_fit(pieces, 40, most)
