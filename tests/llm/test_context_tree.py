"""Context-tree scores against a direct, recursive tree."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import context_tree
from tests.llm.test_operators import ODD, SCHEMA


def slow(rows, depth):
    """Expected rows of (doc_id, text)."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) + [None] for _, t in rows]
    c = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    node = defaultdict(lambda: [0, 0])  # (context, prefix) -> counts

    def steps(text):
        x = bytes(depth) + (text or "").encode() + b"\xff"
        for i in range(depth, len(x)):
            bits = format(x[i], "08b")
            for b in range(8):
                yield [(x[i - d : i], bits[:b]) for d in range(depth + 1)], int(bits[b])

    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            for path, bit in steps(t):
                for k in path:
                    node[k][bit] += 1
    kids = defaultdict(list)
    for ctx, pre in list(node):
        if ctx:
            kids[ctx[1:], pre].append((ctx, pre))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    mix, stop = {}, {}
    for k in sorted(node, key=lambda k: -len(k[0])):
        own = kt(*node[k])
        if len(k[0]) == depth:
            mix[k], stop[k] = own, 1.0
        else:
            below = sum(mix[j] for j in kids[k])
            hi = max(own, below)
            mix[k] = hi + math.log((math.exp(own - hi) + math.exp(below - hi)) / 2)
            stop[k] = math.exp(own - math.log(2) - mix[k])

    def probability(path, bit):
        p = 0.5
        for k in reversed(path):
            if k in node:
                a = node[k]
                p = stop[k] * (a[bit] + 0.5) / (sum(a) + 1) + (1 - stop[k]) * p
            else:
                p = 0.5
        return p

    out = []
    for (i, t), h, ws in zip(rows, held, words, strict=True):
        bs = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        s = sum(math.log10(probability(path, bit)) for path, bit in steps(t))
        out.append((i, h, len(ws), sum(c[w] > 0 for w in ws), n, bs, s))
    return out


def compare(got, want):
    got, want = sorted(map(tuple, got), key=repr), sorted(want, key=repr)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda r: (repr(r[:5]), r[6])), sorted(want, key=lambda r: (repr(r[:5]), r[6])), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-7, abs=1e-9)


COLUMNS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@pytest.mark.parametrize("depth", [2, 3])
def test_scores(spark, depth, monkeypatch):
    rows = [r for r in ODD if r[0] not in (7, 8)] + [(7, "long " * 300, "en", "b", 9), (9, "é" * 40000, "en", "b", 9), (16, "held out? The one two", "en", "b", 9), (23, "ONE zwei", None, None, None)]
    monkeypatch.setattr(context_tree, "BLOCK_ROWS", 3)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("clash")).withColumn("k", F.lit(1))
    rows = [(r[0], r[1]) for r in rows]
    assert {zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows} == {True, False}
    compare(context_tree.score(spark, df, depth=depth).select(*COLUMNS).collect(), slow(rows, depth))


def test_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 1500")
    compare(context_tree.score(spark, df).select(*COLUMNS).collect(), slow([(r["doc_id"], r["text"]) for r in df.collect()], 3))


def test_words_are_compared_as_they_are(spark):
    """Words that collide under every polynomial hash modulo 2**64 are counted apart."""
    word = lambda flip: "".join("ab"[(i.bit_count() + flip) % 2] for i in range(1024))
    rows = [(i, " ".join([word(i % 2)] * (1 + i)), "", "", 0) for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    compare(context_tree.score(spark, df, depth=2).select(*COLUMNS).collect(), slow([(r[0], r[1]) for r in rows], 2))


def test_empty_and_untrained(spark):
    assert context_tree.score(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = context_tree.score(spark, spark.createDataFrame([(held, "ab", "", "", 2)], SCHEMA)).select(*COLUMNS).collect()
    assert [tuple(r) for r in got] == [(held, True, 2, 0, 0, 0.0, pytest.approx(-24 * math.log10(2)))]
