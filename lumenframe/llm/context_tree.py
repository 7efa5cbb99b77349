"""Scores of texts by context-tree weighting.

Every byte is coded as eight binary decisions, each with a tree over the
preceding bytes: a node is a context of 0 to ``depth`` bytes and the bits of
this byte so far. A node's Krichevsky-Trofimov estimate of the training counts
is mixed, half and half, with the product of its children's mixtures; so all
depths weigh in, each node by its posterior. The code length of a text under the frozen tree
is the sum over its bytes and one end symbol (0xFF, in no UTF-8 text); zero
bytes stand before its start.

Documents are dealt to blocks. A block counts its own words, which are compared
as they are, and its distinct (depth + 1)-grams once; global counts come from
one shuffle by word or gram; and only what a block cannot know goes back to it. The tree is built where grams that
share their two latest context bytes meet, which bounds a group by the alphabet;
what lies above has at most 256 x 255 nodes.

Results in odd cases: null and empty texts are the end symbol alone; a null id
counts as the empty text for its fold; repeated rows each keep a row and count
each; without training documents every count is 0 and each bit costs one bit;
a text over 64 kB is a block of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import base, if_small, stored
from lumenframe.llm.language_id import held_out

DEPTH = 3
#: Documents of a block, and the bytes over which one is a block of its own.
BLOCK_ROWS, LONG = 3000, 1 << 16
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Nodes of one byte's binary decomposition: numbers 1 to 255.
NODES = 256


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for positive numbers: Stirling's series, shifted up for small ones."""
    x = np.asarray(x, np.float64)
    shift = np.where(x < 10, 10, 0)
    small = np.where(x < 10, x, 1.0)
    product = np.ones_like(small)
    for i in range(10):
        product *= small + i
    y = x + shift
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.where(shift > 0, np.log(product), 0.0)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram at each byte and end, number of them in each text); the newest byte is the lowest."""
    pad = bytes(depth)
    x = np.frombuffer(b"".join(pad + t + b"\xff" for t in texts), np.uint8).astype(np.int64)
    sizes = np.array([len(t) + 1 for t in texts])
    g = x[depth:].copy()
    for d in range(1, depth + 1):
        g |= x[depth - d : len(x) - d] << (8 * d)
    starts = np.concatenate([[0], np.cumsum(sizes + depth)[:-1]])
    at = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return g[at], sizes


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of each token, tokens of each text, the distinct tokens): A-Z lower-cased words and, last in each text, the end token."""
    x = np.frombuffer(b"".join(t + b"\n" for t in texts).lower(), np.uint8)
    space = SPACES[x]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    start, stop = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    last = np.cumsum([len(t) + 1 for t in texts]) - 1
    before = np.searchsorted(start, last)  # words up to each text's end
    lengths = np.insert(stop - start, before, 0)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(x[~space].tobytes())])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), np.diff(before, prepend=0) + 1, coded.dictionary.cast(pa.binary())


def own_counts(docs: DataFrame, depth: int) -> DataFrame:
    """(word, gram, block, c): each block's distinct words and grams, the other of the two null, with their counts in training documents."""

    def batch_of(words: pa.Array | None, k: np.ndarray | None, block: int, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(c), 1 << 16):
            part = slice(i, i + (1 << 16))
            n = len(c[part])
            word = pa.nulls(n, pa.binary()) if words is None else words.slice(i, n)
            gram = pa.nulls(n, pa.int64()) if k is None else pa.array(k[part])
            yield pa.RecordBatch.from_arrays([word, gram, pa.array(np.full(n, block, np.int64)), pa.array(c[part].astype(np.int64))], ["word", "gram", "block", "c"])

    def count(block: int, texts: list[bytes], train: list[bool]) -> Iterator[pa.RecordBatch]:
        number, sizes, words = word_numbers(texts)
        c = np.bincount(number, np.repeat(np.array(train), sizes), len(words))
        yield from batch_of(words, None, block, c.astype(np.int64))
        values, sizes = grams(texts, depth)
        seen = np.repeat(np.array(train), sizes)
        k, c = np.unique(values[seen], return_counts=True)
        rest = np.setdiff1d(values[~seen], k)
        yield from batch_of(None, np.concatenate([k, rest]), block, np.concatenate([c, np.zeros(len(rest), np.int64)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, train = None, [], []
        for batch in batches:
            for block, text, held in zip(batch.column("block").to_pylist(), batch.column("text"), batch.column("held_out").to_pylist(), strict=True):
                if block != now and texts:
                    yield from count(now, texts, train)
                    texts, train = [], []
                now = block
                texts.append(text.as_py().encode()), train.append(not held)
        if texts:
            yield from count(now, texts, train)

    return docs.select("block", "text", "held_out").mapInArrow(run, "word binary, gram long, block long, c long")


class Level:
    """Nodes of one depth, sorted by key (context << 8 | node): counts and, once known, the posterior of stopping here."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> None:
        self.key, inverse = np.unique(key, return_inverse=True)
        self.zeros = np.bincount(inverse, zeros, len(self.key))
        self.ones = np.bincount(inverse, ones, len(self.key))
        self.stop = np.ones(len(self.key))

    def mix(self, below: np.ndarray | None) -> np.ndarray:
        """ln of the nodes' mixtures, ``below``: the sums of their children's; None at the deepest level."""
        own = log_kt(self.zeros, self.ones)
        if below is None:
            return own
        both = np.logaddexp(own, below) - math.log(2)
        self.stop = np.exp(own - math.log(2) - both)
        return both

    def predict(self, key: np.ndarray, bit: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """Probability of each bit at the nodes ``key``, given that of the next depth; a node without data leaves one half."""
        if not len(self.key):
            return np.full(len(key), 0.5)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        n = self.zeros[at] + self.ones[at]
        kt = (np.where(bit == 1, self.ones[at], self.zeros[at]) + 0.5) / (n + 1.0)
        mixed = self.stop[at] * kt + (1 - self.stop[at]) * deeper
        return np.where((self.key[at] == key) & (n > 0), mixed, 0.5)


def decisions(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, bit) of the eight decisions of each gram's newest byte: arrays (n, 8)."""
    x = gram & 255
    steps = np.arange(8)
    node = (1 << steps)[None, :] | (x[:, None] >> (8 - steps)[None, :])
    return node, (x[:, None] >> (7 - steps)[None, :]) & 1


def levels(gram: np.ndarray, count: np.ndarray, depths: range) -> list[Level]:
    """The nodes with data of some depths, from (depth + 1)-grams."""
    seen = count > 0
    gram, count = gram[seen], count[seen]
    node, bit = decisions(gram)
    weight = np.repeat(count, 8).astype(np.float64)
    bits = bit.ravel()
    return [Level(((((gram >> 8) & ((1 << (8 * d)) - 1)) << 8)[:, None] | node).ravel(), weight * (bits == 0), weight * (bits == 1)) for d in depths]


def climb(lower: Level, mixtures: np.ndarray, upper: Level, depth: int) -> np.ndarray:
    """Sums of the children's ln mixtures for each node of depth ``depth``."""
    context, node = lower.key >> 8, lower.key & 255
    parent = ((context & ((1 << (8 * depth)) - 1)) << 8) | node
    return np.bincount(np.searchsorted(upper.key, parent), mixtures, len(upper.key))


def deep_levels(gram: np.ndarray, count: np.ndarray, depth: int) -> tuple[list[Level], np.ndarray]:
    """Levels 2 to depth of grams that hold whole groups of the two latest context bytes, and the ln mixtures at depth 2."""
    made = levels(gram, count, range(2, depth + 1))
    mixture = made[-1].mix(None)
    for d in range(depth - 1, 1, -1):
        mixture = made[d - 2].mix(climb(made[d - 1], mixture, made[d - 2], d))
    return made, mixture


def top_levels(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> list[Level]:
    """Levels 0 and 1 from depth-1 nodes and their children's mixtures: at most 256 x 255 rows."""
    one = Level(key, zeros, ones)
    mixture = one.mix(np.bincount(np.searchsorted(one.key, key), below, len(one.key)))
    zero = Level(key & 255, zeros, ones)
    zero.mix(climb(one, mixture, zero, 0))
    return [zero, one]


def gram_lengths(spark: SparkSession, counts: DataFrame, depth: int) -> DataFrame:
    """(k, v): ln probability of each gram's newest byte."""
    total = stored(spark, counts.where("gram is not null").groupBy(F.col("gram").alias("k")).agg(F.sum("c").alias("c")), "ctw-grams")
    # Grams with the same two latest context bytes meet.
    grouped = total.repartition(F.shiftright("k", 8).bitwiseAND(F.lit(0xFFFF)))

    def gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        rows = [(b.column("k").to_numpy(), b.column("c").to_numpy()) for b in batches]
        return (np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])) if rows else (np.zeros(0, np.int64),) * 2

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, mixture = deep_levels(*gathered(batches), depth)
        two = made[0]
        one = Level(two.key & 0xFFFF, two.zeros, two.ones)
        below = np.bincount(np.searchsorted(one.key, two.key & 0xFFFF), mixture, len(one.key))
        yield pa.RecordBatch.from_arrays([pa.array(one.key), pa.array(one.zeros), pa.array(one.ones), pa.array(below)], ["key", "zeros", "ones", "below"])

    # Bounded by the alphabet: 256 x 255 nodes of depth 1.
    nodes = grouped.mapInArrow(first, "key long, zeros double, ones double, below double").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).toArrow()
    columns = {c: nodes[c].to_numpy() for c in nodes.column_names}
    top = top_levels(columns["key"], columns["zeros"], columns["ones"], columns["below"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, count = gathered(batches)
        made = top + deep_levels(gram, count, depth)[0]
        for i in range(0, len(gram), 1 << 16):
            g = gram[i : i + (1 << 16)]
            node, bit = decisions(g)
            p = np.full(node.size, 0.5)
            for d in range(depth, -1, -1):
                key = ((((g >> 8) & ((1 << (8 * d)) - 1)) << 8)[:, None] | node).ravel()
                p = made[d].predict(key, bit.ravel(), p)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.log(p).reshape(-1, 8).sum(1))], ["k", "v"])

    return stored(spark, grouped.mapInArrow(second, "k long, v double"), "ctw-lengths")


def score(spark: SparkSession, documents: DataFrame, folds: int = 7, fold: int = 2, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row; learns outside the held-out fold."""
    if not 2 <= depth <= 6:
        raise ValueError("depth is 2 to 6")
    kept = stored(spark, base(documents).select("doc_id", "text", held_out(folds, fold).alias("held_out")), "ctw-docs")
    place = F.when(F.octet_length("text") > LONG, F.col("_metadata.row_index") + (1 << 40)).otherwise(F.floor(F.col("_metadata.row_index") / BLOCK_ROWS))
    docs = kept.select("doc_id", "text", "held_out", F.xxhash64("_metadata.file_path", place).alias("block"))
    counts = stored(spark, own_counts(docs, depth), "ctw-counts")
    words = counts.where("word is not null").select("word", "block", "c")
    # Totals by word, and one row of each word marked; a block knows its own counts: only totals that differ go back.
    of_word = Window.partitionBy("word")
    totals = words.select("word", "block", "c", F.sum("c").over(of_word).alias("v"), (F.row_number().over(of_word.orderBy("block")) == 1).alias("first"))
    totals = stored(spark, totals.where("first or v != c"), "ctw-words")
    total = words.agg(F.sum("c")).first()[0] or 0
    distinct = totals.where("first and v > 0").count()
    lengths = gram_lengths(spark, counts, depth)
    asked = counts.where("gram is not null").select(F.col("gram").alias("k"), "block").join(if_small(lengths, 32), "k").select(F.lit(None).cast("binary").alias("word"), F.col("k").alias("gram"), "block", "v")
    told = totals.where("v != c").select("word", F.lit(None).cast("long").alias("gram"), "block", F.col("v").cast("double").alias("v")).unionByName(asked)
    unit = math.log10(total + distinct + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = [t.as_py().encode() for t in left["text"]]
        of_word = pc.is_valid(right["word"])
        number, sizes, words = word_numbers(texts)
        train = np.repeat(~left["held_out"].to_numpy(zero_copy_only=False), sizes)
        c = np.bincount(number, train, len(words))  # the block's own counts, where no other is told
        told_words = right.filter(of_word)
        c[pc.index_in(told_words["word"].combine_chunks(), words).to_numpy()] = told_words["v"].to_numpy()
        each, first = c[number], np.cumsum(sizes) - sizes
        n_known = np.add.reduceat((each > 0).astype(np.int64), first)
        base_score = np.add.reduceat(np.log10(each + 1), first) - sizes * unit
        g, n = grams(texts, depth)
        told_grams = right.filter(pc.invert(of_word))
        gk, gv = told_grams["gram"].to_numpy(), told_grams["v"].to_numpy()
        order = np.argsort(gk)
        values = gv[order][np.searchsorted(gk[order], g)]
        natural = np.add.reduceat(values, np.cumsum(n) - n) if len(g) else n.astype(float)
        return pa.table({
            "doc_id": left["doc_id"], "held_out": left["held_out"], "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array(np.full(len(texts), total, np.int64)),
            "base_score": pa.array(base_score, pa.float64()), "score": pa.array(natural / math.log(10)), "bits_per_byte": pa.array(-natural / math.log(2) / n),
        })

    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)
