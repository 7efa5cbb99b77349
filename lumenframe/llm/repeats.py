"""Repeated windows of a sequence over the whole corpus: what byte and word deduplication share.

Texts are dealt to blocks of bounded size; one longer than a block is cut into
overlapping pieces. A piece is cut into super-windows: runs of consecutive
windows of ``width`` units that share a minimiser, the position of the smallest
hash of ``core`` consecutive units. Equal windows have equal minimisers, so they
meet under the minimiser's hash, the key. Super-windows that are equal as a
whole, by a 128-bit BLAKE2 digest of their bytes, are counted within a block
first and over all blocks then; one of each travels, packed, with its count to
the key's bucket, where a kernel decides on every window.

A key with more than ``most`` different super-windows is split by longer
context until no bucket is larger: of ``s`` spare units, a window has half on
one side of the core, so that half joins the core and its digest the key. After
log2(s) such splits a bucket holds one string.

Hashes only bring strings together; equality is decided on the units, or by a
128-bit digest of them. Nothing is dropped at any step: a key that occurs once
cannot repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from typing import Protocol

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import base, deleted, many_to_one, stored, stored_at

#: Units of a block at most; positions in a block take LOW bits beside the hash.
BLOCK, LOW = 1 << 18, np.uint64(18)
#: Texts of a block at most: empty ones have no units.
TEXTS = 1 << 12
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Different strings of a bucket at most, before it is split.
MOST = 1024
#: Bytes of strings that a kernel sees at a time.
BATCH_BYTES = 1 << 19


class Alphabet(Protocol):
    """What a unit is. A packed text is bytes; ``spans`` gives the bytes of each unit, ``numbers`` a number a unit for the minimisers."""

    def pack(self, text: str) -> bytes: ...

    def spans(self, packed: bytes) -> tuple[np.ndarray, np.ndarray]: ...

    def numbers(self, packed: bytes) -> np.ndarray: ...


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers over all others."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for every position of a block."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK, b, np.uint64)])) for b in (BASE, inverse))


def rolling(units: np.ndarray, length: int) -> np.ndarray:
    """Hashes of every stretch of a length, by prefix sums of unit * BASE**position."""
    up, down = powers()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * up[: len(units)], dtype=np.uint64)])
    n = len(sums) - length
    return mixed((sums[length:] - sums[:n]) * down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive numbers, from running minima of blocks in both directions."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def super_windows(units: np.ndarray, bounds: np.ndarray, width: int, core: int) -> tuple[np.ndarray, ...]:
    """(piece, key, start, n, offset) of the super-windows of a block of pieces, cut at ``bounds``.

    ``start``: of the first window, in the block; ``n``: windows; ``offset``: of the core in the first window.
    """
    hashes = rolling(units, core)
    tagged = ((hashes >> LOW) << LOW) | np.arange(len(hashes), dtype=np.uint64)
    at = (sliding_min(tagged, width - core + 1) & np.uint64(BLOCK - 1)).astype(np.int64)  # minimiser of each window
    piece = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = piece[: len(at)] == piece[width - 1 :]
    fresh = np.empty(len(at), bool)
    fresh[:1] = True
    fresh[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    fresh &= inside
    start = np.nonzero(fresh)[0]
    # A run ends before the next fresh or outside window.
    stops = np.nonzero(fresh | ~inside)[0]
    n = np.append(stops, len(at))[np.searchsorted(stops, start, side="right")] - start
    return piece[start], hashes[at[start]].view(np.int64), start, n, at[start] - start


def pieces(docs: DataFrame, letters: Alphabet, width: int) -> DataFrame:
    """(home, block, k, row, first, doc_id, z) of each text's pieces.

    ``home``: the block of the text's first piece, where its result is put
    together; ``k``: place in the block; ``first``: unit at which the piece
    starts; ``z``: the packed piece as a zstandard frame.
    """
    step = BLOCK - width
    names = ["home", "block", "k", "row", "first", "doc_id", "z"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, write_checksum=False, write_dict_id=False).compress
        task = TaskContext.get().partitionId() << 33
        block, k, held, row = task, 0, 0, task
        for batch in batches:
            out: dict[str, list] = {c: [] for c in names}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                packed = letters.pack(text.as_py())
                start, end = letters.spans(packed)
                n = len(start)
                if held and held + n > BLOCK or k >= TEXTS:
                    block, k, held = block + 1, 0, 0
                home = block
                for i in range(0, max(1, n - width + 1), step) if n > BLOCK else (0,):
                    if i:
                        block, k = block + 1, 0
                    part = packed[start[i] : end[min(i + step + width - 1, n) - 1]] if n > BLOCK else packed
                    for c, x in zip(names, (home, block, k, row, i, doc_id, pack(part)), strict=True):
                        out[c].append(x)
                held, k, row = held + n, k + 1, row + 1
            types = {c: pa.int64() for c in names} | {"doc_id": batch.schema.field("doc_id").type, "z": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(out[c], types[c]) for c in names], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"home long, block long, k long, row long, first long, doc_id {kind}, z binary")


#: A place is the piece's number in the block and a position in the piece.
PLACE = 1 << 20


def halves(digests: bytes, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joined 128-bit digests as two numbers each, with the core's offset worked in."""
    w = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return w[:, 0] ^ offset, w[:, 1]


def occurrences(table: DataFrame, letters: Alphabet, width: int, core: int) -> DataFrame:
    """(home, block, key, w1, w2, n, offset, count, places) of each block's different super-windows."""

    def solve(home: int, block: int, number: list[int], packed: list[bytes]) -> pa.RecordBatch:
        spans = [letters.spans(p) for p in packed]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s, _ in spans])])
        piece, key, start, n, offset = super_windows(np.concatenate([letters.numbers(p) for p in packed]), bounds, width, core)
        first = np.concatenate([s for s, _ in spans])[start]
        last = np.concatenate([e for _, e in spans])[start + n + width - 2]
        w1, w2 = halves(b"".join([blake2b(packed[i][a:b], digest_size=16).digest() for i, a, b in zip(piece.tolist(), first.tolist(), last.tolist(), strict=True)]), offset)
        place = np.array(number)[piece] * PLACE + start - bounds[piece]
        order = np.lexsort((w2, w1, key))
        key, w1, w2 = key[order], w1[order], w2[order]
        new = np.nonzero(np.append(True, (key[1:] != key[:-1]) | (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])))[0] if len(key) else np.zeros(0, np.int64)
        ends = np.append(new, len(key))
        columns = [np.full(len(new), home), np.full(len(new), block), key[new], w1[new], w2[new], n[order][new].astype(np.int32), offset[order][new].astype(np.int32), np.diff(ends)]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[order], pa.int64()))
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], ["home", "block", "key", "w1", "w2", "n", "offset", "count", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        now, number, held = None, [], []
        for batch in batches:
            for home, block, k, z in zip(*(batch.column(c).to_pylist() for c in ("home", "block", "k")), batch.column("z"), strict=True):
                if (home, block) != now and sum(map(len, held)) >= width:
                    yield from result(now, number, held)
                if (home, block) != now:
                    now, number, held = (home, block), [], []
                number.append(k), held.append(unpack(z.as_py()))
        if held:
            yield from result(now, number, held)

    def result(now: tuple[int, int], number: list[int], held: list[bytes]) -> Iterator[pa.RecordBatch]:
        if sum(len(letters.spans(p)[0]) for p in held) >= width:
            yield solve(*now, number, held)

    return table.select("home", "block", "k", "z").mapInArrow(run, "home long, block long, key long, w1 long, w2 long, n int, offset int, count long, places array<long>")


STRING = "key long, w1 long, w2 long, count long, kinds long, n int, offset int, core int, units binary"


def cut_out(table: DataFrame, wanted: DataFrame, letters: Alphabet, width: int, core: int) -> DataFrame:
    """The strings (see STRING) of super-windows ``wanted`` (block, place, key, w1, w2, count, kinds, n, offset), cut from their blocks."""
    names = [f.split()[0] for f in STRING.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        place = right["place"].to_numpy()
        order = np.argsort(place // PLACE, kind="stable")
        texts = dict(zip(left["k"].to_pylist(), left["z"], strict=True))
        out, now, packed, start, end = [], -1, b"", None, None
        for k, pos, n in zip((place[order] // PLACE).tolist(), (place[order] % PLACE).tolist(), right["n"].to_numpy()[order].tolist(), strict=True):
            if k != now:
                now, packed = k, unpack(texts[k].as_py())
                start, end = letters.spans(packed)
            out.append(packed[start[pos] : end[pos + n + width - 2]])
        right = right.take(pa.array(order))
        columns = {c: right[c] for c in names if c in right.column_names}
        return pa.table(columns | {"core": pa.array([core] * len(out), pa.int32()), "units": pa.array(out, pa.binary())}).select(names)

    return table.select("block", "k", "z").groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(run, STRING)


#: From a batch of whole buckets (n, offset, core, count, units) to a mask over their windows, in order: whether each occurs more than once.
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]], np.ndarray]


def in_buckets(strings: DataFrame, kernel: Kernel) -> DataFrame:
    """(key, w1, w2, start, n): runs of repeated windows in each string; ``kernel`` sees whole buckets."""
    names = ("n", "offset", "core", "count")

    def solve(table: pa.Table) -> pa.RecordBatch:
        n = table["n"].to_numpy()
        mask = kernel(*(table[c].to_numpy() for c in names), table["units"].to_pylist())
        ends = np.cumsum(n)
        row = np.repeat(np.arange(len(n)), n)
        first = mask & np.append(True, ~mask[:-1] | (row[1:] != row[:-1]))
        last = mask & np.append(~mask[1:] | (row[1:] != row[:-1]), True)
        start, stop = np.nonzero(first)[0], np.nonzero(last)[0] + 1
        at = row[start]
        keys = [table[c].combine_chunks().take(pa.array(at)) for c in ("key", "w1", "w2")]
        return pa.RecordBatch.from_arrays([*keys, pa.array((start - ends[at] + n[at]).astype(np.int32)), pa.array((stop - start).astype(np.int32))], ["key", "w1", "w2", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                held.append(whole.slice(i, 256))
                size += held[-1].nbytes
                if size < BATCH_BYTES:
                    continue
                table = pa.Table.from_batches(held)
                key = table["key"].to_numpy()
                done = int(np.searchsorted(key, key[-1], side="left"))
                if done:
                    yield solve(table.slice(0, done))
                    held = table.slice(done).combine_chunks().to_batches()
                    size = sum(b.nbytes for b in held)
        if held:
            yield solve(pa.Table.from_batches(held))

    rows = strings.select("key", "w1", "w2", *names, "units")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, w1 long, w2 long, start int, n int")


def split(strings: DataFrame, letters: Alphabet, width: int) -> DataFrame:
    """Strings (pk, p1, p2, at and STRING) of hot buckets under longer cores: their windows with half of the spare units left of the core, and the others."""
    names = ["pk", "p1", "p2", "at", "key", "w1", "w2", "count", "n", "offset", "core", "units"]
    types = [*[pa.int64()] * 3, pa.int32(), *[pa.int64()] * 4, *[pa.int32()] * 3, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for r in batch.to_pylist():
                u, a, n, core = r["units"], r["offset"], r["n"], r["core"]
                start, end = letters.spans(u)
                spare = width - core
                half = (spare + 1) // 2
                left = min(n, max(0, a - half + 1))
                for side, i, j, more, context in ((0, 0, left, half, (a - half, a + core)), (1, left, n, spare - half + 1, (a, a + core + spare - half + 1))):
                    if i == j:
                        continue
                    part = u[start[i] : end[j + width - 2]]
                    offset = a - half if side == 0 else a - i
                    shared = u[start[context[0]] : end[context[1] - 1]]
                    key = int.from_bytes(blake2b(bytes([side]) + r["key"].to_bytes(8, signed=True) + shared, digest_size=8).digest(), signed=True)
                    d1, d2 = (int(x[0]) for x in halves(blake2b(part, digest_size=16).digest(), np.array([offset])))
                    for column, x in zip(out, (r["pk"], r["p1"], r["p2"], r["at"] + i, key, d1, d2, r["count"], j - i, offset, core + more, part), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)

    return strings.mapInArrow(run, "pk long, p1 long, p2 long, at int, key long, w1 long, w2 long, count long, n int, offset int, core int, units binary")


def verdicts(spark: SparkSession, strings: DataFrame, letters: Alphabet, kernel: Kernel, width: int, most: int) -> DataFrame:
    """(key, w1, w2, start, n): runs of repeated windows of each of ``strings``, from buckets of at most ``most`` different strings."""
    found = in_buckets(strings.where(F.col("kinds") <= most), kernel)
    hot = strings.where(F.col("kinds") > most).select(F.col("key").alias("pk"), F.col("w1").alias("p1"), F.col("w2").alias("p2"), F.lit(0).alias("at"), "key", "count", "n", "offset", "core", "units")
    while not hot.isEmpty():
        parts = stored(spark, split(hot, letters, width), "repeats-split")
        each = parts.groupBy("key", "w1", "w2").agg(F.sum("count").alias("count"), *(F.first(c).alias(c) for c in ("n", "offset", "core", "units")))
        each = stored(spark, each, "repeats-split-strings")
        kinds = each.groupBy("key").agg(F.count("*").alias("kinds"))
        ready = (F.col("kinds") <= most) | (F.col("core") == width)
        bucketed = stored(spark, each.join(kinds, "key"), "repeats-split-buckets")
        runs = in_buckets(bucketed.where(ready), kernel)
        back = parts.select("pk", "p1", "p2", "at", "key", "w1", "w2").join(runs, ["key", "w1", "w2"])
        found = found.unionByName(back.select(F.col("pk").alias("key"), F.col("p1").alias("w1"), F.col("p2").alias("w2"), (F.col("at") + F.col("start")).cast("int").alias("start"), "n"))
        again = bucketed.where(~ready).select("key").distinct()
        hot = parts.join(again, "key", "left_semi").select("pk", "p1", "p2", "at", "key", "count", "n", "offset", "core", "units")
    return found


#: From a packed text and the maximal stretches of its removed units to the operator's columns.
Finish = Callable[[bytes, list[tuple[int, int]]], tuple]
ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def removed(spark: SparkSession, documents: DataFrame, letters: Alphabet, kernel: Kernel, finish: Finish, columns: str, width: int, core: int, most: int = MOST) -> DataFrame:
    """(doc_id, ``columns``) of each row of ``documents``: what ``finish`` makes of its text and the units under windows that occur elsewhere."""
    docs = base(documents)
    table = stored(spark, pieces(docs, letters, width), "repeats-pieces")
    all_rows, at = stored_at(spark, occurrences(table, letters, width, core), "repeats-windows")
    keys, at_keys = stored_at(spark, all_rows.groupBy("key").agg(F.sum("count").alias("c"), F.count("*").alias("n_rows")).where("c > 1").select("key", "n_rows"), "repeats-keys")
    # A passage that every block has brings a row a block: hot keys and strings are joined by broadcast.
    rows = stored(spark, many_to_one(all_rows, keys, "key", how="inner"), "repeats-rows")
    deleted(spark, at, at_keys)
    one = F.min(F.struct("block", F.col("places")[0].alias("place")))
    wholes = stored(spark, rows.groupBy("key", "w1", "w2").agg(F.sum("count").alias("count"), F.max("n").alias("n"), F.max("offset").alias("offset"), one.alias("x"), F.count("*").alias("n_rows")), "repeats-wholes")
    kinds = wholes.groupBy("key").agg(F.count("*").alias("kinds"))
    wanted = wholes.join(kinds, "key").select("x.block", "x.place", "key", "w1", "w2", "count", "kinds", "n", "offset")
    strings = stored(spark, cut_out(table, wanted, letters, width, core), "repeats-strings")
    runs = verdicts(spark, strings, letters, kernel, width, most).groupBy("key", "w1", "w2").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    string = ["key", "w1", "w2"]
    runs = stored(spark, runs.join(wholes.select(*string, "n_rows"), string), "repeats-runs")
    found = stored(spark, many_to_one(rows, runs, string, how="inner").select("home", "block", "places", "runs"), "repeats-found")
    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        spans: dict[tuple[int, int], list] = {}
        for block, places, found_runs in zip(right["block"].to_pylist(), right["places"].to_pylist(), right["runs"].to_pylist(), strict=True):
            for p in places:
                spans.setdefault((block, p // PLACE), []).extend((p % PLACE + r["start"], r["n"]) for r in found_runs)
        texts: dict[int, list] = {}
        for row, block, k, first, doc_id, z in zip(*(left[c].to_pylist() for c in ("row", "block", "k", "first", "doc_id", "z")), strict=True):
            texts.setdefault(row, []).append((first, block, k, doc_id, z))
        out: list[tuple] = []
        for parts in texts.values():
            parts.sort(key=lambda p: p[0])
            cover = [(first + a, first + a + n - 1 + width) for first, block, k, _, _ in parts for a, n in spans.get((block, k), ())]
            out.append((parts[0][3], *finish(joined([(p[0], unpack(p[4])) for p in parts], letters), merged(cover))))
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(zip(names, [left.schema.field("doc_id").type, *types], strict=True))})

    types = [ARROW[c.split()[1]] for c in columns.split(", ")]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {columns}"
    return table.groupBy("home").cogroup(found.groupBy("home")).applyInArrow(run, schema)


def joined(parts: list[tuple[int, bytes]], letters: Alphabet) -> bytes:
    """A packed text from its overlapping pieces (first unit, packed)."""
    out = parts[0][1]
    for first, packed in parts[1:]:
        start = letters.spans(out)[0]
        out = (out[: start[first]] if first < len(start) else out) + packed
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal stretches of some."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
