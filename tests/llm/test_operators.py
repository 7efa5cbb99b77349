"""Operators against brute force, on small fixtures and the smallest tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from pathlib import Path

import public_tokenizers
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenframe.llm import language_id, pii, queries, simhash, token_counts, topk_search

SMALL = "/root/testdata/sf0.001"

ODD = [
    (1, None, "en", "a", 9),
    (2, "", "en", None, 9),
    (3, "  \t\n", None, "a", 9),
    (4, "one two", "en", "a", 9),
    (4, "one two", "en", "a", 9),
    (4, "other text with the same id", "de", "a", 9),
    (None, "a row without an id", "en", "a", 9),
    (5, "ÀÉÎ straße 漢字   é <|endoftext|> x<|startoftext|>y", "fr", "b", 9),
    (6, "12345 67,89 !!! ?! don't we'll", "en", "b", 9),
    (7, "long " * 30000, "en", "b", 9),
    (8, "x" * 50000, None, "b", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("n_tokens", F.lit("clash")).withColumn("fp", F.lit(1)).withColumn("th", F.lit(2)).withColumn("key", F.lit(3))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def library_counts(texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_token_counts(spark, which, request, tmp_path):
    df = request.getfixturevalue(which)
    texts = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = sorted(((i, len((t or "").encode()), n) for (i, t), n in zip(texts, library_counts([t for _, t in texts]), strict=True)), key=repr)
    for _ in range(2):  # the second time all comes from the cache
        got = token_counts.count_tokens(spark, df, public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "cache"))
        assert rows_of(got) == want
    cached = spark.read.parquet(str(tmp_path / "cache"))
    assert cached.count() == cached.select("digest").distinct().count()


def test_token_counts_empty(spark, docs, tmp_path):
    assert token_counts.count_tokens(spark, docs.limit(0), public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "c")).count() == 0


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps):
    """Smallest id reachable, over (id, fp); ids None sort last."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            groups[find(i)] = min(groups.get(find(i), d), d)
    return [groups.get(find(i)) for i in range(len(fps))]


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_simhash(spark, which, request):
    df = request.getfixturevalue(which)
    fps = [(r["doc_id"], slow_fingerprint(r["text"])) for r in df.collect()]
    want = sorted(((d, fp, c) for (d, fp), c in zip(fps, slow_components(fps), strict=True)), key=repr)
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(spark, df).collect()), key=repr)
    assert got == want


def test_simhash_empty(spark, docs):
    assert simhash.near_duplicates(spark, docs.limit(0)).count() == 0


def test_simhash_large_buckets(spark):
    """Buckets over the limit are dealt anew and lose no link."""
    import random

    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(60)}
    core = rng.getrandbits(64)
    for _ in range(150):
        x = core
        for b in rng.sample(range(64), rng.randrange(7)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = simhash.all_links(spark, spark.createDataFrame(signed, "fp long"), bucket=8)
    roots = {r["fp"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(spark, links).collect()}
    want = slow_components([(i, x) for i, x in enumerate(fps)])
    groups, expected = {}, {}
    for i, x in enumerate(fps):
        groups.setdefault(roots.get(x, x), set()).add(x)
        expected.setdefault(want[i], set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def slow_base(text):
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    ok = lambda d: sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m.group())) <= 19 and ok(digits(m.group()))]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m.group())) <= 15]
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def test_pii_base(spark, docs):
    cases = ["a@b", "a@b.c@d.e x@y.z", "..@a-b.c.d.", "1.2.3.4.5.6.7.8", "1.2.3", "999.1.1.1 001.002.0003.4", "4111 1111-1111 1111", "4111111111111112", "+1 (415) 555-2671+44", "+12", "é@x.y ü.a@b.co", "@@a@b.c", "1" * 300 + ".1.1.1"]
    for text in [*cases, *(r["text"] for r in docs.collect())]:
        assert pii.base_spans(text) == slow_base(text), text[:80]


def test_pii_odd(spark, odd):
    got = pii.find(odd)
    assert got.count() == len(ODD)
    for r in got.collect():
        assert r["n_email"] == r["n_ip"] == r["n_card"] == r["n_phone"] == 0
        assert r["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_pii_crf_adds_and_keeps():
    crf = pii.train()
    text = "call (415) 555-2671 or mail a.b@c.org , order 4012 8888 8888 1882 today in 2020"
    base = [(k, a, b) for k, v in pii.base_spans(text).items() for a, b in v]
    more = pii.crf_spans(text, crf, [s[1:] for s in base])
    assert base == [("email", 28, 37)]
    assert {(k, text[a:b]) for k, a, b in more} == {("phone", "(415) 555-2671"), ("card", "4012 8888 8888 1882")}


def test_pii_viterbi_is_exact():
    """Short chains between clamped tokens decode as the whole text does."""
    import itertools

    import numpy as np

    crf = pii.train(rounds=40)
    for text in ("tel +44 20 7946 , x 10.0.0.1 y", "415-555-2671 a", "a 4012 8888"):
        x = np.stack([crf.scores(t) for t in pii.TOKEN.findall(text)])
        best = max(itertools.product(range(5), repeat=len(x)), key=lambda y: sum(x[i, k] for i, k in enumerate(y)) + sum(crf.trans[a, b] for a, b in itertools.pairwise(y)))
        assert crf.viterbi([x])[0].tolist() == list(best)
        whole = [m.span() for m, k in zip(pii.TOKEN.finditer(text), best, strict=True) if k]
        found = pii.crf_spans(text, crf, [])
        assert all(any(a <= s and e <= b for _, a, b in found) or not pii.accepted("phone", text[s:e]) for s, e in whole)


def test_pii_mask(spark, odd):
    df = odd.limit(0).unionByName(spark.createDataFrame([(1, "x a@b.org y", "en", "s", 3), (2, None, "en", "s", 3)], SCHEMA).withColumn("n_tokens", F.lit("c")).withColumn("fp", F.lit(1)).withColumn("th", F.lit(2)).withColumn("key", F.lit(3)))
    got = {r["doc_id"]: r["text"] for r in pii.mask(df).collect()}
    assert got == {1: "x [email] y", 2: None}


def test_language_id_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op9_language_id(spark, "/root/testdata/sf0.01")
    fold = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in df.collect()}
    rows = got.join(df.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == df.count() and all(r["held_out"] == fold[r["doc_id"]] for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_id_odd(spark, odd):
    got = language_id.identify(odd)
    assert got.count() == len(ODD)
    by = {(r["doc_id"], r["lang_pred"]) for r in got.where("doc_id in (1, 2, 3)").collect()}
    assert by == {(1, "und"), (2, "und"), (3, "und")}
    assert language_id.identify(odd.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_pii_long_tokens_keep_their_own_scores():
    """Scores of a long token come from all of it, whatever token came before."""
    rng = np.random.default_rng(0)
    emit, trans = rng.normal(size=(pii.N_FEATURES, len(pii.KINDS) + 1)), np.zeros((len(pii.KINDS) + 1,) * 2)
    head = "1" + "a-" * 40
    a, b, c = head + "xxxxxxxxxx", head + "1234.5@6.7", head + "AbAbAbAbAb"
    together = pii.Crf(emit, trans)
    got = [together.scores(t) for t in (a, b, c)]
    for t, scores in zip((a, b, c), got, strict=True):
        assert np.array_equal(scores, pii.Crf(emit, trans).scores(t))
    assert len({pii.shape(t) for t in (a, b, c)}) == 3


def test_language_id_long_texts(spark):
    """Clean texts of 1 MB and more are called and stay, and the margin does not fall with length."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null and lang is not null")
    model = language_id.fit(df.where(~language_id.held_out(3, 1)))
    coders, rows = language_id.Coders(model), []
    for lang in model:
        text = "\n".join(r["text"] for r in df.where(language_id.held_out(3, 1) & (F.col("lang") == lang)).orderBy("doc_id").collect())
        for size in (100_000, 1_000_000, 4_000_000):
            rows.append((lang, (text * (size // len(text) + 1))[:size], lang, "a", size))
        assert coders.classify(rows[-1][1])[1] > 0.7 * coders.classify(rows[-3][1])[1]
    long = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars long")
    assert language_id.accepted(long, model).count() == len(rows)
    assert all(r["doc_id"] == r["lang_pred"] and not r["rejected"] for r in language_id.predict(long, model).collect())


def slow_topk(rows, k):
    """Query by row: a row is left out for itself only."""
    import math

    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(good):
        if q is not None and q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), c is None, c or 0) for b, (c, w) in enumerate(good) if a != b and len(w) == len(v))[:k]
            out += [(q, n + 1, None if null else c, -s) for n, (s, null, c) in enumerate(best)]
    return sorted(out, key=repr)


def single(rows):
    """Components as the table's floats."""
    import struct

    return [(i, None if v is None else [None if x is None else struct.unpack("f", struct.pack("f", x))[0] for x in v]) for i, v in rows]


def test_topk_odd(spark):
    import random

    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(7)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 2.0, 0.0, 0.0, 0.0, 0.0]), (350, [float("nan")] * 7), (400, [float("inf")] * 7), (450, [0.5, 0.25]), (451, [0.5, 0.5]), (500, []), (501, [0.0] * 7), (502, [0.0] * 7), (550, []), (600, [3.0])]
    # Ids that repeat, as queries and candidates, and none.
    rows += [(50, [rng.gauss(0, 1) for _ in range(7)]), rows[100], (100, [9.0] * 7), (None, [9.0] * 7), (None, [9.0] * 7), (None, None), (7, [9.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("dim", F.lit("clash")).withColumn("row", F.lit("clash"))
    for k in (1, 5):
        assert rows_of(topk_search.search(spark, df, F.col("vec_id") % 50 == 0, k)) == slow_topk(single(rows), k)
    assert topk_search.search(spark, df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_topk_large_components(spark):
    """Sums beyond 2^53 and 2^63 stay exact; a score that is no long raises."""
    rng = np.random.default_rng(1)
    for scale in (2.0**18, 2.0**22):
        rows = [(i, (rng.normal(size=5) * scale).tolist()) for i in range(120)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert rows_of(topk_search.search(spark, df, F.col("vec_id") % 50 == 0, 5)) == slow_topk(rows, 5)
    df = spark.createDataFrame([(0, [2.0**30]), (1, [2.0**30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk_search.search(spark, df, F.col("vec_id") % 50 == 0, 5).count()


def test_topk_levels_discard(spark):
    """On clustered vectors, under a tenth of the pairs are scored exactly, and the result is that of all."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 64))
    v = centres[rng.integers(0, 40, 3000)] + 0.1 * rng.normal(size=(3000, 64))
    raw = np.floor(256 * v).astype(np.int64)
    x = raw.astype(float)
    turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    side = lambda a: topk_search.Side(np.arange(len(v))[a].tobytes(), np.arange(len(v))[a].tobytes(), np.ones(len(v), bool)[a].tobytes(), raw[a].tobytes(), 64, turn)
    q, c = side(slice(0, 60)), side(slice(0, 3000))
    qi, ci, score, left = topk_search.best_of_block(q, c, np.full(60, -np.inf), 5)
    full = raw[:60] @ raw.T
    full[np.arange(60), np.arange(60)] = -(1 << 60)
    assert np.array_equal(score.reshape(60, 5), -np.sort(-full, axis=1)[:, :5])
    assert left[-1] < 0.1 * left[0]


def test_token_counts_lost_digest_raises(spark, docs, tmp_path, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(token_counts, "encode_missing", lambda misses, _: misses.select("digest", F.lit(1).cast("long").alias("n_tokens")).limit(5))
    with pytest.raises(Exception, match="not in the cache"):
        token_counts.count_tokens(spark, docs, path, str(tmp_path / "c")).collect()


def test_token_counts_hot_digest(spark, tmp_path):
    """One text that most rows share."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("text "), "id")).otherwise(F.lit("the same text")).alias("text"))
    path = public_tokenizers.path("word_bpe_49k.json")
    got = dict((r[0], r[2]) for r in token_counts.count_tokens(spark, df, path, str(tmp_path / "c")).collect())
    want = library_counts([r["text"] for r in df.orderBy("doc_id").collect()])
    assert [got[i] for i in range(3000)] == want


def test_token_counts_sentencepiece(spark, odd, tmp_path):
    models = [p for p in Path("/opt/tokenizers").iterdir() if p.suffix == ".model"]
    if not models:
        pytest.skip("no sentencepiece model")
    import sentencepiece

    encode = sentencepiece.SentencePieceProcessor(model_file=str(models[0])).encode
    got = token_counts.count_tokens(spark, odd, str(models[0]), str(tmp_path / "c"))
    assert rows_of(got) == sorted(((r["doc_id"], len((r["text"] or "").encode()), len(encode(r["text"] or ""))) for r in odd.collect()), key=repr)


def test_pii_rows_against_brute_force(spark):
    texts = ["mail a.b@c.org, 10.0.0.1 and 4111 1111 1111 1111 or +1 (415) 555-2671 x", "card 5500-0000-0000-0004 at 999.1.1.1", "(415) 555-2671", None, "", "é a@b.co " * 50, "none"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 0)]
    crf = pii.train()
    want = []
    for i, t, *_ in rows:
        base = [(k, a, b) for k in pii.KINDS for a, b in slow_base(t or "")[k]]
        both = base + pii.crf_spans(t or "", crf, [s[1:] for s in base])
        text = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2])))
        want.append((i, *(sum(s[0] == k for s in base) for k in pii.KINDS), hashlib.sha256(text(base).encode()).hexdigest(), text(both)))
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(pii.find(df)) == sorted(want, key=repr)
    assert pii.find(df.limit(0)).count() == 0


def slow_language(train, text):
    """Plain zstandard with the same dictionaries, one call a piece."""
    import zstandard

    clean = lambda t: bytes(b for b in t.replace("\n", " ").lower().encode() if b >= 128 or b == 32 or chr(b).isalpha())
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    sizes = {}
    for lang, content in train.items():
        params = zstandard.ZstdCompressionParameters.from_level(language_id.LEVEL, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
        total = 0
        for i in range(0, len(clean(text)), 16384):
            coder = zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            total += len(coder.compress(clean(text)[i : i + 16384]))
        sizes[lang] = total
    order = sorted(sizes, key=lambda x: (sizes[x], list(train).index(x)))
    return order[0], (sizes[order[1]] - sizes[order[0]]) / sizes[order[1]]


def test_language_id_against_brute_force(spark, docs):
    """Every row of the query on the smallest table, and dictionaries of whole texts."""
    rows = docs.select("doc_id", "text", "lang").collect()
    train = language_id.fit(docs.where(~language_id.held_out(3, 1)))
    whole = {}
    for r in rows:
        if r["text"] and r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            whole.setdefault(r["lang"], set()).add(language_id.letters(r["text"]))
    for lang, content in train.items():
        assert len(content) <= language_id.DICT_BYTES or content in whole[lang]
        rest = content
        while rest:  # whole texts, one after the other
            head = max((t for t in whole[lang] if rest == t or rest.startswith(t + b" ")), key=len)
            rest = rest[len(head) + 1 :]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs).collect()}
    for r in rows:
        lang, margin = slow_language(train, r["text"])
        assert got[r["doc_id"]] == (lang, pytest.approx(margin))
