"""Suffix-array deduplication over bytes, by backward extension on a Burrows-Wheeler transform.

A bucket (see :mod:`repeats`) holds the different super-windows of its keys. All
windows of a bucket share a core, so one symbol stands for its bytes, the same
for equal bytes only: a window of 400 bytes becomes 201 symbols. The bucket's
strings, each ended by a symbol of its own, get a suffix array and from it their
transform. Intervals of suffixes with a common prefix are then extended
backward, breadth first: each level of the search yields the positions where
neighbouring suffixes share exactly that many symbols, by increasing number.
The search stops at 201, the minimum length: positions that are still open
share at least as much, and suffixes without a settled position between them
are equal windows.

Results in odd cases: null and empty texts have no bytes; texts under 400 bytes
lose none; repeated rows are documents of their own; very long texts are cut
into overlapping pieces; removal may split a character, as bytes are judged.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import repeats

WIDTH = 400
#: Bytes in a minimiser.
CORE = 200


class Bytes:
    """A unit is a byte of the text's UTF-8."""

    def pack(self, text: str) -> bytes:
        return text.encode()

    def spans(self, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(len(packed) + 1)
        return at[:-1], at[1:]

    def numbers(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, np.uint8).astype(np.uint64) + np.uint64(1)


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of each suffix) of a text of small numbers whose last symbols make all suffixes distinct.

    Prefix doubling from as many symbols as a number holds; only suffixes that
    are still tied are sorted again. A rank is the first place of its tie.
    """
    n = len(text)
    symbols, small = np.unique(text, return_inverse=True)
    bits = int(len(symbols)).bit_length()
    length = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(length):
        key <<= bits
        key[: max(0, n - i)] |= small[i:] + 1
    order = np.argsort(key)
    place, tied = np.arange(n), key[order]
    rank = np.empty(n, np.int64)
    suffixes = order
    while True:
        fresh = np.ones(len(tied), bool)
        fresh[1:] = tied[1:] != tied[:-1]
        starts = np.nonzero(fresh)[0]
        rank[suffixes] = place[starts][np.cumsum(fresh) - 1]
        alone = np.diff(np.append(starts, len(tied))) == 1
        left = ~np.repeat(alone, np.diff(np.append(starts, len(tied))))
        if not left.any():
            return order, rank
        place, suffixes = place[left], suffixes[left]
        after = suffixes + length
        key = rank[suffixes] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        suffixes, tied = suffixes[by], key[by]
        order[place] = suffixes
        length *= 2


def settled(text: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common): common[j] is how many symbols suffixes j - 1 and j share, -1 if at least ``limit``."""
    order, rank = suffix_order(text)
    n = len(text)
    before = order - 1  # the last symbol stands before the first, as in a rotation
    symbol = text[before]
    to = rank[before]  # where a suffix goes if its preceding symbol is put in front
    common = np.full(n + 1, -1, np.int32)
    common[0] = common[n] = 0
    left, right = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    table = np.full(n, -1, np.int64)
    for length in range(limit):
        if not len(left):
            break
        sizes = right - left + 1
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(left)), sizes)
        at = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + left[owner]
        target = to[at]
        if 8 * len(target) > n:  # many: through a table of all places
            table[target] = np.arange(len(target))
            by = table[np.nonzero(table >= 0)[0]]
            table[target] = -1
        else:
            by = np.argsort(target)
        target, owner, front = target[by], owner[by], symbol[at[by]]
        # An interval and a symbol give one run of targets: the interval of that symbol and the interval's prefix.
        last = np.ones(len(target), bool)
        last[:-1] = (owner[1:] != owner[:-1]) | (front[1:] != front[:-1])
        stop = np.nonzero(last)[0]
        start = np.concatenate([[0], stop[:-1] + 1])
        lo, hi = target[start], target[stop]
        fresh = common[hi + 1] < 0
        common[hi[fresh] + 1] = length
        left, right = lo[fresh], hi[fresh]
    return order, common[:n]


def kernel(width: int = WIDTH) -> repeats.Kernel:
    def of_core(n: np.ndarray, offset: np.ndarray, core: int, count: np.ndarray, units: list[bytes]) -> np.ndarray:
        """For strings whose cores have one length."""
        reduced = n + width - core  # symbols of each string, without its end
        first = np.concatenate([[0], np.cumsum(reduced + 1)[:-1]])
        text = np.zeros(int((reduced + 1).sum()), np.int64)
        cores: dict[bytes, int] = {}
        for u, a, f, r in zip(units, offset.tolist(), first.tolist(), reduced.tolist(), strict=True):
            x = np.frombuffer(u, np.uint8)
            text[f : f + a] = x[:a]
            text[f + a] = 256 + cores.setdefault(u[a : a + core], len(cores))
            text[f + a + 1 : f + r] = x[a + core :]
        text[first + reduced] = 256 + len(cores) + np.arange(len(n))
        order, common = settled(text, width - core + 1)
        group = np.empty(len(text), np.int64)
        group[order] = np.cumsum(common >= 0)
        at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        groups = group[at]
        return np.bincount(groups, np.repeat(count, n))[groups] > 1

    def solve(n: np.ndarray, offset: np.ndarray, core: np.ndarray, count: np.ndarray, units: list[bytes]) -> np.ndarray:
        mask = np.zeros(int(n.sum()), bool)
        for c in np.unique(core).tolist():
            own = np.nonzero(core == c)[0]
            mask[np.repeat(core == c, n)] = of_core(n[own].astype(np.int64), offset[own], c, count[own], [units[i] for i in own])
        return mask

    return solve


def finish(packed: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str, bytes]:
    end, parts = 0, []
    for a, b in spans:
        parts.append(packed[end:a])
        end = b
    rest = b"".join([*parts, packed[end:]])
    return len(packed), len(packed) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest


def deduplicate(spark: SparkSession, documents: DataFrame, width: int = WIDTH, core: int = CORE, most: int = repeats.MOST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row: ``kept`` is the remaining bytes."""
    return repeats.removed(spark, documents, Bytes(), kernel(width), finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", width, core, most)
