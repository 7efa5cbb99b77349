"""Run-length masks: COCO's compressed and uncompressed counts to the engine's runs (y, x0, x1), and back.

Counts go down the columns, zeros first. In compressed ones each count, from the
fourth on less the one two before it, is a little-endian number of five bits a
character, the sixth tells that more follow, and the last one's fifth is its sign.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.polygons import expanded

RUNS = "array<struct<y:int,x0:int,x1:int>>"
#: Fixed values of the format.
FIRST_CHARACTER, BITS, SIGN, MORE = 48, 5, 0x10, 0x20
#: Longest side of a mask, whose runs are ints.
LONGEST = (1 << 31) - 1


def counts_of(text: str) -> np.ndarray:
    """Counts that a compressed string holds; ValueError if it breaks off or goes below zero."""
    counts, _, problem = all_counts([text.encode("latin-1")])
    if problem[0]:
        raise ValueError("not a compressed mask")
    return counts


def _within(owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Number of each element among those of its owner."""
    return np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]


def all_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts of all, how many are each one's, whether it is broken: it breaks off, goes below zero or has a count that no long holds) of many compressed strings."""
    return _unpacked(np.frombuffer(b"".join(texts), np.uint8), np.array([len(x) for x in texts], np.int64))


def _unpacked(characters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`all_counts` of strings that lie behind each other, ``sizes`` characters of each."""
    n, code = len(sizes), characters - np.uint8(FIRST_CHARACTER)  # below the first one: wraps to more than two sets
    bad, some = np.zeros(n, bool), np.flatnonzero(sizes)
    ends = np.cumsum(sizes)
    if len(code) and code.max() >= 2 * MORE:
        bad[np.searchsorted(ends, np.flatnonzero(code >= 2 * MORE), "right")] = True
    bad[some] |= code[ends[some] - 1] & MORE != 0
    if bad.any():
        code = code[np.repeat(~bad, sizes)]
        sizes = np.where(bad, 0, sizes)
        ends = np.cumsum(sizes)
    last = np.flatnonzero(code < MORE)
    counted = np.diff(np.searchsorted(last, ends), prepend=0)
    length = np.diff(last, prepend=-1)
    # Most numbers are one character.
    value = ((code[last] ^ SIGN).astype(np.int64)) - SIGN
    long = np.flatnonzero(length > 1)
    if len(long):
        size, at = length[long], last[long]
        if size.max() > 12:
            bad[np.searchsorted(np.cumsum(counted), long[size > 12], "right")] = True
        made = np.zeros(len(long), np.int64)
        for k in range(min(int(size.max()), 12)):
            i = np.flatnonzero(size > k)
            made[i] += (code[at[i] - size[i] + 1 + k].astype(np.int64) & (MORE - 1)) << (BITS * k)
        value[long] = made - np.where(code[at] & SIGN, np.int64(1) << np.minimum(BITS * size, 60), 0)
    value = _second_sums(value, counted)
    if len(value) and value.min() < 0:
        bad[np.searchsorted(np.cumsum(counted), np.flatnonzero(value < 0), "right")] = True
    if bad.any():
        return value[~np.repeat(bad, counted)], np.where(bad, 0, counted), bad
    return value, counted, bad


def _second_sums(value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each count from the fourth on is a step from the one two before: sums along every second place of a string, the first left out."""
    first = (np.cumsum(sizes) - sizes)[:, None] + np.arange(3)
    fresh = first[np.arange(3) < sizes[:, None]]  # places where a sum starts anew
    total, out = np.empty_like(value), value.copy()
    for parity in (0, 1):
        np.cumsum(value[parity::2], out=total[parity::2])
        at = fresh[fresh % 2 == parity]
        before = np.where(at < 2, 0, total[np.maximum(at - 2, 0)])
        out[at] -= np.diff(before, prepend=0)
        out[parity::2] = np.cumsum(out[parity::2])
    return out


def text_of(counts: np.ndarray) -> str:
    """The compressed string of counts."""
    return all_texts(np.asarray(counts, np.int64), np.array([len(counts)]))[0]


def all_texts(counts: np.ndarray, sizes: np.ndarray) -> list[str]:
    """The compressed strings of many masks' counts, ``sizes`` of each."""
    ends = np.cumsum(sizes)
    first = (ends - sizes)[:, None] + np.arange(3)
    first = first[np.arange(3) < np.asarray(sizes)[:, None]]
    left = np.array(counts, np.int64)
    left[2:] -= counts[:-2]
    left[first] = counts[first]
    # Most numbers are one character.
    lengths = np.ones(len(left), np.int64)
    long = np.flatnonzero((left + SIGN).view(np.uint64) >= MORE)
    rest, open_ = left[long] >> BITS, np.arange(len(long))
    parts = []
    while len(open_):
        lengths[long[open_]] += 1
        digit = rest[open_] & (MORE - 1)
        rest[open_] >>= BITS
        more = rest[open_] != np.where(digit & SIGN, -1, 0)
        parts.append((open_, digit + FIRST_CHARACTER + np.where(more, MORE, 0)))
        open_ = open_[more]
    characters = ((left & (MORE - 1)) + FIRST_CHARACTER).astype(np.uint8)
    until = np.cumsum(lengths)
    if len(long):
        characters[long] += MORE
        characters = np.repeat(characters, lengths)
        at = until[long] - lengths[long]
        for k, (i, digit) in enumerate(parts, 1):
            characters[at[i] + k] = digit
    text, ends = characters.tobytes().decode("latin-1"), np.append(0, until)[ends].tolist()
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _ordered(*keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equally long arrays sorted by the first, then the second and so on; plain masks come sorted."""
    later, open_ = np.zeros(max(len(keys[0]) - 1, 0), bool), np.ones(max(len(keys[0]) - 1, 0), bool)
    for key in keys:
        step = np.diff(key)
        later |= open_ & (step < 0)
        open_ &= step == 0
        if not open_.any():
            break
    if not later.any():
        return keys
    order = np.lexsort(keys[::-1])
    return tuple(key[order] for key in keys)


def _turned(owner: np.ndarray, start: np.ndarray, end: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, across, first line, last line, exclusive) of the stretches across the lines of masks that lie along them as start to end, ``line`` positions a line.

    Where a mask is and was not a line earlier, a stretch across starts; where it was
    and is not, one ends. Both are differences of the mask and itself moved on by
    a line, so only the ends of stretches are touched; those that continue
    straight on cancel out. No pixel inside is looked at.
    """
    if not len(owner):
        return (np.zeros(0, np.int64),) * 4
    fresh = np.flatnonzero(np.diff(owner, prepend=-1))
    low = np.minimum.reduceat(start, fresh)
    # Two lines between owners: none of them meets the next one's, moved on or not.
    span = np.maximum.reduceat(end, fresh) - low + 2 * line[fresh]
    base = np.repeat(np.cumsum(span) - span - low, np.diff(np.append(fresh, len(owner))))
    a, b = start + base, end + base
    next_a, next_b = a + line, b + line
    on_a, on_b = np.append(a[1:] == next_a[:-1], False), np.append(b[1:] == next_b[:-1], False)
    own_a, own_b = np.flatnonzero(~np.append(False, on_a[:-1])), np.flatnonzero(~np.append(False, on_b[:-1]))
    out_a, out_b = np.flatnonzero(~on_a), np.flatnonzero(~on_b)
    k = np.concatenate([own_a, own_b, out_a, out_b])
    at = np.concatenate([a[own_a], b[own_b], next_a[out_a], next_b[out_b]])
    turn = np.repeat([1, -1, -1, 1], [len(own_a), len(own_b), len(out_a), len(out_b)])
    order = np.argsort(at, kind="stable")
    k, at, level = k[order], at[order], np.cumsum(turn[order])
    width = np.diff(at, append=at[-1])

    def places(sign: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i = np.flatnonzero((level == sign) & (width > 0))
        of = k[i]
        n, across = np.divmod(at[i] - base[of], line[of])
        e, number = expanded(width[i])
        o, across, n = owner[of][e], across[e] + number, n[e]
        over = np.flatnonzero(across >= line[of][e])
        if len(over):  # goes on in the next lines
            more, across[over] = np.divmod(across[over], line[of][e[over]])
            n[over] += more
        return _ordered(o, across, n)

    o, across, first = places(1)
    return o, across, first, places(-1)[2]


def decode(counts: np.ndarray, width: int, height: int) -> np.ndarray:
    """(n, 3) runs y, x0, x1 of counts."""
    counts = np.asarray(counts, np.int64)
    runs, _, problem = decode_all(counts, np.array([len(counts)]), np.array([width]), np.array([height]))
    if problem[0]:
        raise ValueError("counts leave the image")
    return runs


def decode_all(counts: np.ndarray, sizes: np.ndarray, width: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """((n, 3) runs y, x0, x1 of all, how many are each one's, whether its counts leave its image) of many masks, ``sizes`` counts of each."""
    o, *runs, bad = _decoded(counts, sizes, width, height)
    return np.column_stack(runs), np.bincount(o, minlength=len(sizes)), bad


def _decoded(counts: np.ndarray, sizes: np.ndarray, width: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`decode_all` as columns: (owner, y, x0, x1) of the runs, and whether a mask's counts leave its image."""
    n, sizes = len(sizes), np.asarray(sizes, np.int64)
    ends, some = np.cumsum(sizes), np.flatnonzero(sizes)
    starts, bad = ends - sizes, np.zeros(n, bool)
    if len(counts):
        bad[some] = np.minimum.reduceat(counts, starts[some]) < 0
        # As doubles first: counts of a broken mask may add up to more than a long.
        bad[some] |= np.add.reduceat(counts.astype(float), starts[some]) > 1.5 * width[some].astype(float) * height[some]
    total = np.append(0, np.cumsum(counts))
    # None is below zero, so that the last count is the one to leave the image.
    bad |= total[ends] - total[starts] > width.astype(np.int64) * height
    o, number = expanded(np.where(bad, 0, sizes // 2))
    i = starts[o] + 2 * number + 1  # every second count is of ones
    here = total[starts][o]
    start, end = total[i] - here, total[i + 1] - here
    if (thin := start == end).any():
        o, start, end = o[~thin], start[~thin], end[~thin]
    return *_turned(o, start, end, height.astype(np.int64)[o]), bad


def encode(runs: np.ndarray, width: int, height: int) -> np.ndarray:
    """Counts of runs y, x0, x1."""
    runs = np.asarray(runs, np.int64).reshape(-1, 3)
    return encode_all(runs, np.array([len(runs)]), np.array([width]), np.array([height]))[0]


def encode_all(runs: np.ndarray, sizes: np.ndarray, width: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts of all, how many are each one's) of many masks' runs y, x0, x1, ``sizes`` of each; runs may overlap and touch."""
    return _encoded(np.repeat(np.arange(len(sizes)), sizes), *runs.astype(np.int64).T, width, height)


def _encoded(owner: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, width: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`encode_all` of columns."""
    n, height = len(width), height.astype(np.int64)
    end = width.astype(np.int64) * height
    line = int(max(width.max(initial=0), x1.max(initial=0))) + 1
    if (none := x0 >= x1).any():
        owner, y, x0, x1 = owner[~none], y[~none], x0[~none], x1[~none]
    at = y * line
    o, a, b = _joined(*_ordered(owner, at + x0, at + x1))
    o, x, y0, y1 = _turned(o, a, b, np.full(len(o), line))
    # Down the columns; what reaches a column's foot goes on at the head of the next.
    top = x * height[o]
    o, a, b = _joined(o, top + y0, top + y1)
    last = end[o]
    if (b > last).any():
        inside = a < last
        o, a, b, last = o[inside], a[inside], np.minimum(b, last)[inside], last[inside]
    edges, counted = np.column_stack([a, b]).ravel(), 2 * np.bincount(o, minlength=n)
    if (foot := b == last).any():  # an edge at the end is the end
        edges = edges[np.column_stack([np.ones(len(foot), bool), ~foot]).ravel()]
        counted -= np.bincount(o[foot], minlength=n)
    until = np.cumsum(counted + 2)
    marks, inner = np.zeros(len(edges) + 2 * n, np.int64), np.ones(len(edges) + 2 * n, bool)
    marks[until - 1] = end
    inner[until - 1] = inner[until - counted - 2] = False
    marks[inner] = edges
    between = np.ones(max(len(marks) - 1, 0), bool)
    between[until[:-1] - 1] = False
    return np.diff(marks)[between], counted + 1


def _joined(owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches, sorted by owner and start, with those that overlap or touch as one."""
    if not len(owner):
        return owner, a, b
    if not ((a[1:] <= b[:-1]) & (owner[1:] == owner[:-1])).any():
        return owner, a, b
    # Owners lie so far apart that one's reach ends before the next one's first.
    far = owner * (int(b.max()) - int(a.min()) + 2)
    reach = np.maximum.accumulate(b + far)
    fresh = np.flatnonzero(np.append(True, (a + far)[1:] > reach[:-1]))
    last = np.append(fresh[1:], len(a)) - 1
    return owner[fresh], a[fresh], reach[last] - far[last]


def parsed(segmentation: str) -> tuple[np.ndarray | bytes, int, int]:
    """(counts, or their compressed string, width, height) of an RLE object's JSON."""
    found = json.loads(segmentation)
    height, width = (int(x) for x in found["size"])
    counts = found["counts"]
    if isinstance(counts, str):
        return counts.encode("latin-1"), width, height
    counts = np.array(counts, np.int64)
    if counts.ndim != 1:
        raise ValueError("counts are no list")
    return counts, width, height


#: JSON as it is mostly written, which is read without a parser; what looks otherwise goes through :func:`parsed`.
_SIZE = r'^\{"size": ?\[(0|[1-9][0-9]{0,8}), ?(0|[1-9][0-9]{0,8})\], ?"counts": ?'
PLAIN = _SIZE + r"\[(0|[1-9][0-9]{0,17})(, ?(0|[1-9][0-9]{0,17}))*\]\}$"
PACKED = _SIZE + r'"([0-\[\]-o]|\\\\)*"\}$'
#: Masks that a kernel takes at once: their arrays stay in a core's cache.
AT_ONCE = 1000


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts behind each other, where each ends) of strings without nulls."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data, ends[1:] - ends[0]


def _numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of at most 18 digits in ASCII text that neither begins nor ends with one, where each ends)."""
    digit = data - np.uint8(48)
    is_digit = digit < 10
    edge = np.flatnonzero(is_digit[1:] != is_digit[:-1])
    last, length = edge[1::2], edge[1::2] - edge[::2]
    value = digit[last].astype(np.int64)
    for k in range(1, int(length.max(initial=0))):
        # Most numbers are short: all are taken twice, then only those that go on.
        i = np.flatnonzero(length > k) if k > 2 else slice(None)
        at = last[i] - k
        value[i] += np.where(length[i] > k, digit[at], 0) * np.int64(10**k)
    return value, last


def _read(texts: pa.Array, width: pa.Array, height: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(counts of all, how many are each one's, widths, heights, what is wrong: a place in PROBLEMS) of many masks' JSON; null: no counts."""
    n = len(texts)
    size, wide, tall, wrong, torn = np.zeros(n, np.int64), np.ones(n, np.int64), np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    parts: list[tuple[np.ndarray, np.ndarray]] = []  # (masks, their counts in that order)

    def take(at: np.ndarray, counts: np.ndarray, sizes: np.ndarray, broken: np.ndarray | None = None) -> None:
        size[at] = sizes
        parts.append((at, counts))
        if broken is not None:
            torn[at] = broken

    there = texts.is_valid().to_numpy(zero_copy_only=False)
    plain = pc.match_substring_regex(texts, PLAIN).fill_null(False).to_numpy(zero_copy_only=False)
    packed = there & ~plain
    if packed.any():
        packed = pc.match_substring_regex(texts, PACKED).fill_null(False).to_numpy(zero_copy_only=False)
    if plain.any():
        at = np.flatnonzero(plain)
        data, ends = _bytes(texts if plain.all() else texts.filter(pa.array(plain)))
        value, last = _numbers(data)
        until = np.searchsorted(last, ends)
        first = np.append(0, until[:-1])
        tall[at], wide[at] = value[first], value[first + 1]
        counts = np.ones(len(value), bool)
        counts[first] = counts[first + 1] = False
        take(at, value[counts], until - first - 2)
    if packed.any():
        at = np.flatnonzero(packed)
        data, ends = _bytes(texts if packed.all() else texts.filter(pa.array(packed)))
        start, stop = np.flatnonzero(data == ord('"')).reshape(-1, 6)[:, 4:].T
        turn = np.zeros(len(data), np.int8)
        turn[start + 1] += 1
        turn[stop] -= 1
        inside = np.cumsum(turn, dtype=np.int8).astype(bool)
        value, _ = _numbers(np.where(inside, np.uint8(32), data))
        tall[at], wide[at] = value[::2], value[1::2]
        escapes = np.flatnonzero(data == ord("\\"))[1::2]  # they stand in pairs
        inside[escapes] = False
        length = stop - start - 1 - np.bincount(np.searchsorted(ends, escapes, "right"), minlength=len(at))
        take(at, *_unpacked(data[inside], length))
    rest = np.flatnonzero(there & ~plain & ~packed)
    strings: list[tuple[int, bytes]] = []
    for i, text in zip(rest.tolist(), texts.take(pa.array(rest)).to_pylist(), strict=True):
        try:
            counts, w, h = parsed(text)
            # Sides that no int holds are wrong, whatever the image's.
            wide[i], tall[i] = (w, h) if 0 < w <= LONGEST and 0 < h <= LONGEST else (0, 0)
            if isinstance(counts, bytes):
                strings.append((i, counts))
            else:
                take(np.array([i]), counts, np.array([len(counts)]))
        except (ValueError, KeyError, TypeError, OverflowError):
            wrong[i] = 2
    if strings:
        take(np.array([i for i, _ in strings]), *all_counts([t for _, t in strings]))
    given = there & (wrong < 2) & (width.is_valid().to_numpy(zero_copy_only=False) & height.is_valid().to_numpy(zero_copy_only=False))
    sides = [c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (width, height)]
    other = given & ((wide != sides[0]) | (tall != sides[1])) | (wide < 1) | (tall < 1)
    wrong[other], wide[other], tall[other] = 1, 1, 1
    wrong[torn & (wrong == 0)] = 2
    if len(parts) == 1 and len(parts[0][0]) == n:
        return parts[0][1], size, wide, tall, wrong
    # In the order of the rows.
    at, counts = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
    lies = np.zeros(n, np.int64)
    lies[at] = np.cumsum(size[at]) - size[at]
    owner, number = expanded(size)
    return counts[lies[owner] + number], size, wide, tall, wrong


#: What can be wrong with a mask.
PROBLEMS = (None, "mask size", "mask")


def _drawn(texts: pa.Array, width: pa.Array, height: pa.Array) -> Iterator[tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """Some masks' JSON after the other: ((mask, y, x0, x1) of the runs of those without a problem, widths, heights, problems)."""
    for a in range(0, len(texts), AT_ONCE):
        counts, sizes, w, h, wrong = _read(*(c.slice(a, AT_ONCE) for c in (texts, width, height)))
        o, y, x0, x1, out = _decoded(counts, sizes, w, h)
        wrong[out & (wrong == 0)] = 2
        if wrong.any():
            shown = wrong[o] == 0
            o, y, x0, x1 = o[shown], y[shown], x0[shown], x1[shown]
        yield (o, y, x0, x1), w, h, wrong


def _added(rows: DataFrame, *types: str) -> str:
    """The schema of ``rows``, all of it nullable, with more columns."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *types])


def decoded(rows: DataFrame, text: str = "rle", width: str = "width", height: str = "height", runs: str = "runs", problem: str = "problem") -> DataFrame:
    """``rows`` with the ``runs`` of the JSON in the column ``text`` (null: null), and ``problem``, null or what is wrong: not a mask, counts outside it, or not the image's size."""
    at = rows.columns.index
    columns = (at(text), at(width), at(height))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths, parts, wrong = [], [], []
            for (o, *places), w, _, bad in _drawn(*(batch.column(c) for c in columns)):
                lengths.append(np.bincount(o, minlength=len(w)))
                parts.append(pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in places], ["y", "x0", "x1"]))
                wrong.append(bad)
            problem = pa.array(PROBLEMS, pa.string()).take(pa.array(np.concatenate(wrong)))
            none = pc.or_(batch.column(columns[0]).is_null(), problem.is_valid())
            ends = np.append(0, np.cumsum(np.concatenate(lengths))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(parts), mask=none)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, problem], names)

    names = [*rows.columns, runs, problem]
    # With a number: a few bytes of counts can be large masks, and must not end in one task.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n).mapInArrow(run, _added(rows, f"`{runs}` {RUNS}", f"`{problem}` string"))


#: What :func:`measured` adds.
MEASURES = {"n_runs": "long", "pixels": "long", "first_y": "int", "last_y": "int", "first_x": "int", "after_x": "int"}


def measured(rows: DataFrame, text: str = "rle", width: str = "width", height: str = "height") -> DataFrame:
    """``rows``, those without runs left out, with the number of runs of the JSON in the column ``text``, their pixels and their sides.

    A mask is decoded as by :func:`decoded`, but its runs live in the kernel only:
    rows stay where they lie, and a task holds those of some masks at a time.
    """
    at = rows.columns.index
    columns = (at(text), at(width), at(height))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, base = [], 0
            for (o, y, x0, x1), w, _, _ in _drawn(*(batch.column(c) for c in columns)):
                fresh = np.flatnonzero(np.diff(o, prepend=-1))
                last = np.append(fresh[1:], len(o)) - 1
                sums = [f.reduceat(x, fresh) if len(o) else x for f, x in ((np.add, x1 - x0), (np.minimum, x0), (np.maximum, x1))]
                found.append([o[fresh] + base, last - fresh + 1, sums[0], y[fresh], y[last], *sums[1:]] if len(o) else [o] * 7)
                base += len(w)
            if found:
                some, *made = (np.concatenate(x) for x in zip(*found, strict=True))
                made = [pa.array(x).cast(pa.int64() if t == "long" else pa.int32()) for x, t in zip(made, MEASURES.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(some)).columns, *made], [*batch.schema.names, *MEASURES])

    return rows.mapInArrow(run, _added(rows, *(f"{c} {t}" for c, t in MEASURES.items())))


def _json(counts: np.ndarray, sizes: np.ndarray, width: np.ndarray, height: np.ndarray, compressed: bool) -> list[str]:
    """The JSON of many masks' counts, as ``json.dumps`` writes it."""
    sides = zip(height.tolist(), width.tolist(), strict=True)
    if not compressed:
        cut = np.split(counts, np.cumsum(sizes)[:-1])
        return [json.dumps({"size": [h, w], "counts": c.tolist()}) for (h, w), c in zip(sides, cut, strict=True)]
    texts = all_texts(counts, sizes)
    # Of the characters of counts JSON escapes the backslash only.
    return [f'{{"size": [{h}, {w}], "counts": "{c if escape not in c else c.replace(escape, escape * 2)}"}}' for (h, w), c, escape in zip(sides, texts, repeat("\\"))]


def encoded(rows: DataFrame, compressed: bool = True, runs: str = "runs", width: str = "width", height: str = "height", text: str = "rle") -> DataFrame:
    """``rows`` with the JSON of their ``runs`` in the column ``text`` (null: null)."""
    at = rows.columns.index
    columns = (at(runs), at(width), at(height))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, *given = (batch.column(c) for c in columns)
            if pc.any(pc.and_(lists.is_valid(), pc.or_(*(c.is_null() for c in given)))).as_py():
                raise ValueError("a mask needs the sides of its image")
            sides = [c.fill_null(1).to_numpy(zero_copy_only=False).astype(np.int64) for c in given]
            flat = lists.flatten()
            places = [np.asarray(flat.field(c)).astype(np.int64) for c in ("y", "x0", "x1")]
            ends = np.append(0, np.cumsum(np.asarray(lists.value_lengths().fill_null(0))))
            texts = []
            for a in range(0, batch.num_rows, AT_ONCE):
                part, (w, h) = ends[a : a + AT_ONCE + 1], (x[a : a + AT_ONCE] for x in sides)
                owner = np.repeat(np.arange(len(w)), np.diff(part))
                texts += _json(*_encoded(owner, *(x[part[0] : part[-1]] for x in places), w, h), w, h, compressed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))], [*batch.schema.names, text])

    return rows.mapInArrow(run, _added(rows, f"`{text}` string"))


def recoded(rows: DataFrame, compressed: bool = True, text: str = "rle", width: str = "width", height: str = "height") -> DataFrame:
    """``rows`` with the masks of the JSON in the column ``text`` written anew, compressed or plain, by way of their runs; null where it is null or has a problem.

    What :func:`encoded` makes of :func:`decoded`, but runs live in the kernel only, and rows stay where they lie.
    """
    at = rows.columns.index
    columns = (at(text), at(width), at(height))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, texts, wrong = batch.column(columns[0]), [], []
            for (o, *places), w, h, bad in _drawn(old, *(batch.column(c) for c in columns[1:])):
                texts += _json(*_encoded(o, *places, w, h), w, h, compressed)
                wrong.append(bad > 0)
            none = old.is_null().to_numpy(zero_copy_only=False) | (np.concatenate(wrong) if wrong else False)
            yield batch.set_column(columns[0], text, pa.array(texts, pa.string(), mask=none))

    return rows.mapInArrow(run, _added(rows))


def of_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Counts of a filled box of whole pixels inside its image: a stretch a column."""
    tall, wide = (y2 - y1).cast("long"), (x2 - x1).cast("int")
    between = F.transform(F.sequence(F.lit(2), 2 * wide), lambda i: F.when(i % 2 == 0, height.cast("long") - tall).otherwise(tall))
    first = F.array((x1 * height + y1).cast("long"), tall)
    rest = F.array(((width - x2) * height + (height - y2)).cast("long"))
    body = F.when(wide > 1, F.concat(first, F.slice(between, 1, 2 * wide - 2))).otherwise(first)
    return F.concat(body, rest)


def text_of_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """JSON of :func:`of_box`: its columns but the first are one piece of text, repeated."""
    tall, number = (y2 - y1).cast("long"), lambda c: c.cast("long").cast("string")
    piece = F.concat(F.lit(","), number(height.cast("long") - tall), F.lit(","), number(tall))
    ends = number(x1 * height + y1), number((width - x2) * height + (height - y2))
    return F.concat(F.lit('{"size":['), number(height), F.lit(","), number(width), F.lit('],"counts":['), ends[0], F.lit(","), number(tall), F.repeat(piece, (x2 - x1).cast("int") - 1), F.lit(","), ends[1], F.lit("]}"))


def exploded(rows: DataFrame, *keep: str, runs: str = "runs") -> DataFrame:
    """A row (``keep``, y, x0, x1) for each run."""
    return rows.select(*keep, F.inline(runs))
