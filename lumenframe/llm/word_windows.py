"""Substring deduplication over words, by super-k-mers.

Consecutive windows of 35 words that share a minimiser travel as one packed
string to the minimiser's bucket. There the words are numbered, and ranks of 1,
2, 4, ... words, each from sorting pairs of the ranks before, number the windows
themselves: equal numbers are equal word sequences, counted exactly. See
:mod:`repeats` for what precedes a bucket.

Results in odd cases: null and empty texts have no words; texts under 35 words
lose none; repeated rows are documents of their own, so each of them loses what
the other holds; very long texts are cut into overlapping pieces.
"""

from __future__ import annotations

import hashlib
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import repeats

WIDTH = 35
#: Words in a minimiser.
CORE = 7


class Words:
    """A unit is a word; packed, words stand one space apart."""

    def pack(self, text: str) -> bytes:
        return b" ".join(text.encode().split())

    def spans(self, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
        if not packed:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        space = np.nonzero(np.frombuffer(packed, np.uint8) == 32)[0]
        return np.append(0, space + 1), np.append(space, len(packed))

    def numbers(self, packed: bytes) -> np.ndarray:
        """For minimisers only: words with one checksum merely share buckets."""
        return repeats.mixed(np.array([crc32(w) for w in packed.split()], np.uint64))


def kernel(width: int = WIDTH) -> repeats.Kernel:
    def solve(n: np.ndarray, offset: np.ndarray, core: np.ndarray, count: np.ndarray, units: list[bytes]) -> np.ndarray:
        words = [w for u in units for w in u.split(b" ")]
        number: dict[bytes, int] = {}
        rank = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        length, rank_of = 1, rank
        while length < width:
            step = min(length, width - length)
            pairs = rank_of[: len(rank_of) - step] * (len(words) + 1) + rank_of[step:]
            rank_of = np.unique(pairs, return_inverse=True)[1]
            length += step
        n = n.astype(np.int64)
        first = np.cumsum(n + width - 1) - (n + width - 1)
        at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ranks = rank_of[at]
        return np.bincount(ranks, np.repeat(count, n))[ranks] > 1

    return solve


def finish(packed: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str, str]:
    words = packed.split()
    end, left = 0, []
    for a, b in spans:
        left += words[end:a]
        end = b
    rest = b" ".join(left + words[end:]) if spans else packed
    return len(words), sum(b - a for a, b in spans), hashlib.sha256(rest).hexdigest(), rest.decode()


def deduplicate(spark: SparkSession, documents: DataFrame, width: int = WIDTH, core: int = CORE, most: int = repeats.MOST) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of each row: ``kept`` is the remaining text."""
    return repeats.removed(spark, documents, Words(), kernel(width), finish, "n_words long, n_removed long, kept_sha256 string, kept string", width, core, most)
