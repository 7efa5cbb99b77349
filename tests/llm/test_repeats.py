"""Byte and word deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import common, repeats, suffix_dedup, word_windows
from tests.llm.test_operators import ODD, SCHEMA


def slow(units, width):
    """Mask of covered units of each sequence."""
    count = Counter(tuple(u[i : i + width]) for u in units for i in range(len(u) - width + 1))
    masks = []
    for u in units:
        m = [False] * len(u)
        for i in range(len(u) - width + 1):
            if count[tuple(u[i : i + width])] > 1:
                m[i : i + width] = [True] * width
        masks.append(m)
    return masks


def corpus(seed, letters, n, length):
    """Random texts with copies, near copies, shared passages and runs."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 5)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(length // 6) for _ in range(3)]
    out = []
    for _ in range(n):
        kind = rng.randrange(6)
        t = text(rng.randrange(1, length // 3))
        if kind == 1 and out:
            t = rng.choice(out)
        elif kind == 2 and out:
            w = rng.choice(out).split(" ")
            for _ in range(3):
                w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        elif kind == 3:
            t = text(5) + " " + rng.choice(passages) + " " + text(7)
        elif kind == 4:
            t = (word() + " ") * rng.randrange(1, length)
        out.append(t)
    return out


def check_bytes(spark, rows, width, core, most):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("runs", F.lit("clash"))
    units = [list((r[1] or "").encode()) for r in rows]
    want = []
    for r, u, m in zip(rows, units, slow(units, width), strict=True):
        kept = bytes(b for b, x in zip(u, m, strict=True) if not x)
        spans = sum(1 for i, x in enumerate(m) if x and (i == 0 or not m[i - 1]))
        want.append((r[0], len(u), sum(m), spans, hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.deduplicate(spark, df, width, core, most).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    return want


def check_words(spark, rows, width, core, most):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("runs", F.lit("clash"))
    units = [(r[1] or "").encode().split() for r in rows]
    want = []
    for r, u, m in zip(rows, units, slow(units, width), strict=True):
        kept = b" ".join(b for b, x in zip(u, m, strict=True) if not x)
        want.append((r[0], len(u), sum(m), hashlib.sha256(kept).hexdigest()))
    got = word_windows.deduplicate(spark, df, width, core, most).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    return want


@pytest.mark.parametrize("most", [1, 3, 1024])
def test_random(spark, most):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(corpus(most, "abc", 120, 60))]
    assert sum(r[2] for r in check_bytes(spark, rows, 40, 24, most)) > 0
    assert sum(r[2] for r in check_words(spark, rows, 8, 4, most)) > 0


def test_odd(spark):
    rows = [r for r in ODD if r[0] not in (7, 8)] + [(7, "long " * 500, "en", "b", 9), (8, "x" * 2500, None, "b", 9), (9, "x" * 399, None, "b", 9)]
    check_bytes(spark, rows, 400, 200, 1024)
    check_words(spark, rows, 35, 7, 1024)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.deduplicate(spark, df).count() == 0
    assert word_windows.deduplicate(spark, df).count() == 0


def test_long_text_in_pieces(spark):
    rng = random.Random(5)
    a = " ".join(str(rng.randrange(10**6)) for _ in range(120_000))
    rows = [(1, a, "", "", 0), (2, a[300_000:700_000], "", "", 0), (3, "tail " + a[-600:], "", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.deduplicate(spark, df).collect()}
    tail = 601 if a[-601] == " " else 600
    assert got == {1: 400_000 + tail, 2: 400_000, 3: tail}


def test_long_words_in_pieces(spark, monkeypatch):
    """Blocks of a few words, so that texts fall into many pieces."""
    monkeypatch.setattr(repeats, "BLOCK", 64)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(corpus(9, "ab", 60, 400))]
    assert sum(r[2] for r in check_words(spark, rows, 8, 4, 50)) > 0
    assert sum(r[2] for r in check_bytes(spark, rows, 40, 24, 50)) > 0


def thue_morse(n, flip=0):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


def test_words_with_equal_polynomial_hashes(spark):
    """Thue-Morse words and their complements collide under every polynomial hash modulo 2**64; no window repeats."""
    common = " ".join(f"w{i}" for i in range(34))
    for n in (1024, 2048, 4096):
        rows = [(1, f"{thue_morse(n)} {common}", "", "", 0), (2, f"{thue_morse(n, 1)} {common}", "", "", 0)]
        assert all(r[2] == 0 for r in check_words(spark, rows, 35, 7, 1024))
        rows = [(i, "x" * 30 + thue_morse(n, i) + "y" * 500, "", "", 0) for i in range(2)]
        check_bytes(spark, rows, 400, 200, 1024)


def test_rows_without_an_id(spark):
    """Rows of one id, or of none, keep results of their own."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(420)) for _ in range(3)]
    rows = [(None, texts[0], "", "", 0), (None, texts[1], "", "", 0), (3, texts[0], "", "", 0), (3, texts[2], "", "", 0), (3, texts[2], "", "", 0)]
    assert sorted(r[2] for r in check_bytes(spark, rows, 400, 200, 1024)) == [0, 420, 420, 420, 420]


@pytest.mark.parametrize("passage", [300, 500])
def test_hot_key_is_split_by_context(spark, passage):
    """One passage in many contexts: its buckets are split until they are small, with the same result."""
    rng = random.Random(passage)
    p = "".join(rng.choice("abcdefgh ") for _ in range(passage))
    fresh = lambda: "".join(rng.choice("abcdefgh ") for _ in range(250))
    rows = [(i, fresh() + p + fresh(), "", "", 0) for i in range(60)] + [(99, p * 3, "", "", 0)]
    got = check_bytes(spark, rows, 400, 200, 8)
    assert all(r[2] >= passage for r in got) == (passage == 500)
    check_words(spark, rows, 35, 7, 8)


def test_blocks_are_bounded_in_texts(spark):
    """Null and empty texts have no units; they fill blocks by number, and each keeps its row."""
    n = 3 * repeats.TEXTS
    docs = spark.range(n, numPartitions=2).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("")).when(F.col("id") % 1000 == 1, F.lit("seven words that a text may have")).alias("text"))
    table = repeats.pieces(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), word_windows.Words(), 35)
    per = [r["count"] for r in table.groupBy("home").count().collect()]
    assert max(per) <= repeats.TEXTS and sum(per) == n
    out = word_windows.deduplicate(spark, docs).groupBy("n_removed").count().collect()
    assert [tuple(r) for r in out] == [(0, n)]


@pytest.mark.parametrize("share", [0, 1])
def test_hot_keys_and_strings_by_broadcast(spark, monkeypatch, share):
    """Rows of a hot key (over 1,000 of them), by one column or two, are joined by broadcast with the same result."""
    monkeypatch.setattr(common, "HOT_SHARE", share)
    side = spark.createDataFrame([(1, "a", 5), (2, "b", 1)], "k long, v string, n_rows long")
    rows = spark.createDataFrame([(1, i) for i in range(2000)] + [(2, 7), (3, 8)], "k long, i long")
    side = side.withColumn("n_rows", F.when(F.col("k") == 1, 2000).otherwise(1))
    for key, s in (("k", side), (["k", "j"], side.withColumn("j", F.lit(0)))):
        r = rows if key == "k" else rows.withColumn("j", F.lit(0))
        got = common.many_to_one(r, s, key, how="inner").groupBy("k", "v").count().collect()
        assert {tuple(x) for x in got} == {(1, "a", 2000), (2, "b", 1)}


def test_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    check_bytes(spark, rows, 400, 200, 1024)
    check_words(spark, rows, 35, 7, 1024)


def test_common_prefixes_from_the_transform():
    rng = np.random.default_rng(2)
    text = np.concatenate([rng.integers(0, 3, 400), [900]])
    order, common = suffix_dedup.settled(text, 6)
    s = [tuple(text[i:]) for i in range(len(text))]
    assert [s[i] for i in order] == sorted(s)
    for j in range(1, len(order)):
        a, b = s[order[j - 1]], s[order[j]]
        n = next(k for k in range(len(a)) if k >= len(b) or a[k] != b[k])
        assert common[j] == (n if n < 6 else -1)
