"""Packing documents into token sequences by bounded-space online best-fit.

Each task encodes its documents as they stream by, ends each with an id, cuts
those that are longer than a sequence into pieces, and places every piece at
once: no shuffle, and no task knows of another. A fixed number of sequences are
open. A bitset has a bit for each free space that an open one has; its lowest
set bit from a piece's length on is the best fit. Where nothing fits a sequence
is opened, and if too many are open then, the fullest closes. Pieces wait in a
window of bounded size and are placed by falling length within it.

Results in odd cases: a null text is an empty one, and has its end id alone;
repeated rows and ids each keep their pieces; a very long text is cut, and only
its last piece waits; other columns take no part; an empty table gives no rows.
A task that runs again over the same rows in the same order, as of files, makes
the same sequences; their ids hold its partition's number.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import base
from lumenframe.llm.token_counts import spans_no_space, tokenizer_digest

SEQUENCE = 2048
END_ID = 0
#: Sequences that a task has open, and pieces that wait to be placed by falling length.
OPEN, WINDOW = 4096, 1000
#: A worker keeps the ids of so many parts of chunks met lately, and of as many before those.
CHUNKS_KEPT = 500_000
#: Words that go to the library in one string.
TOGETHER = 256
#: Numbers of a task's sequences, below the partition's.
TASK_BITS = 40
#: Bytes of pieces that a task holds before it hands rows on.
HELD_BYTES = 4 << 20
#: After an ASCII letter or digit and before white space, a run of these is a text of its own to the vocabulary's rules.
TRAILING = "[.,;:!?$%&#*]+"

Encode = Callable[[pa.Array], list[bytes]]


class ChunkIds:
    """Ids of texts, as little-endian unsigned 32-bit numbers, for a vocabulary whose rules drop white space.

    Ids of a text are those of its chunks between white space, one after the
    other. Each different chunk of a batch is looked at once: it loses its
    capitals, where the vocabulary does so too, and its trailing punctuation is
    set apart. The different parts that then remain are kept with their ids; of
    those not met lately, parts of letters are encoded many in one string,
    where each ends at a token that ends a word.
    """

    def __init__(self, model: bytes, lower: bool) -> None:
        self.tok, self.lower = library(model), lower
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def each(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]

    def words(self, chunks: list[str]) -> list[bytes]:
        """Of chunks of letters: many in one string, one by one where a chunk is not one word to the library."""
        groups = [chunks[i : i + TOGETHER] for i in range(0, len(chunks), TOGETHER)]
        out: list[bytes] = []
        for group, e in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(stops) != len(group) or (stops and stops[-1] != 4 * len(ids)):
                out += self.each(group)
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        return out

    def ids(self, parts: list[str]) -> list[bytes]:
        if len(self.new) > CHUNKS_KEPT:
            self.old, self.new = self.new, {}
        known, old = self.new, self.old
        missing = [p for p in parts if p not in known]
        if missing:
            known.update([(p, old[p]) for p in missing if p in old])
            missing = [p for p in missing if p not in old]
            plain, other = [p for p in missing if p.isalpha()], [p for p in missing if not p.isalpha()]
            known.update(zip(plain, self.words(plain), strict=True))
            known.update(zip(other, self.each(other), strict=True))
        return [known[p] for p in parts]

    def set_apart(self, chunks: pa.Array) -> pa.Array:
        """Lists of the parts of chunks. Special tokens' strings keep their case; so do letters before marks, with which they may compose."""
        if self.lower:
            chunks = pc.if_else(pc.match_substring_regex(chunks, "<|[\\x{300}-\\x{36f}]"), chunks, pc.ascii_lower(chunks))
        return pc.ascii_split_whitespace(pc.replace_substring_regex(chunks, f"([A-Za-z0-9])({TRAILING})$", "\\1 \\2"))

    def __call__(self, texts: pa.Array) -> list[bytes]:
        in_text = pc.ascii_split_whitespace(texts)
        chunks = in_text.flatten().dictionary_encode()
        in_chunk = self.set_apart(chunks.dictionary)
        parts = in_chunk.flatten().dictionary_encode()
        found = self.ids(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        ends = np.cumsum([0, *map(len, found)]) // 4
        of_part = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<u4"))).take(parts.indices)
        of_chunk = pa.ListArray.from_arrays(of_part.offsets.take(in_chunk.offsets), of_part.flatten()).take(chunks.indices)
        at = (np.asarray(of_chunk.offsets)[np.asarray(in_text.offsets)] * 4).tolist()
        raw = np.asarray(of_chunk.flatten()).tobytes()
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def library(model: bytes):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_buffer(model)
    tok.no_truncation()
    tok.no_padding()
    return tok


def splits_punctuation(path: str) -> bool:
    """Whether letters, digits and all else are told apart by the vocabulary's own rules, white space is dropped and words have ends: what :class:`ChunkIds` needs."""
    if path.endswith(".model") or not spans_no_space(path):
        return False
    text = Path(path).read_text()
    return "[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in text and re.search(r'"end_of_word_suffix":\s*"</w>"', text) is not None


def encoder(path: str, model: bytes) -> Encode:
    """Ids of texts as bytes, four each, as the vocabulary's library gives them without added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_proto=model).encode
        return lambda texts: [np.array(encode(t, add_bos=False, add_eos=False), "<u4").tobytes() for t in texts.to_pylist()]
    if splits_punctuation(path):
        return ChunkIds(model, '"Lowercase"' in json.dumps(json.loads(model).get("normalizer")))
    tok = library(model)
    return lambda texts: [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]


#: A worker's encoders by version of the vocabulary: pure functions, so tasks may share what they have met.
_encoders: dict[str, Encode] = {}


class OpenSequences:
    """Open sequences by free space: a bit for each space that at least one of them has."""

    def __init__(self, size: int = SEQUENCE, most: int = OPEN, first: int = 0) -> None:
        self.size, self.most, self.next = size, most, first
        self.bits, self.count = 0, 0
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def take(self, space: int) -> int:
        """One of the sequences with this free space, no longer open."""
        found = self.at[space].pop()
        self.count -= 1
        if not self.at[space]:
            self.bits ^= 1 << space
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of 1 to ``size`` tokens."""
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            found = self.take(space)
        else:
            space, found = self.size, self.next
            self.next += 1
        left = space - length
        if left:
            if self.count == self.most:
                self.take((self.bits & -self.bits).bit_length() - 1)
            self.at[left].append(found)
            self.bits |= 1 << left
            self.count += 1
        return found, self.size - space


def pack(spark: SparkSession, documents: DataFrame, tokenizer_path: str, size: int = SEQUENCE, end_id: int = END_ID, most: int = OPEN, window: int = WINDOW) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every piece; ``ids`` are little-endian unsigned 32-bit numbers."""
    if size < 1 or most < 1 or window < 1:
        raise ValueError("size, most and window are at least 1")
    docs = base(documents)
    kind = docs.schema["doc_id"].dataType
    model, version = Path(tokenizer_path).read_bytes(), tokenizer_digest(tokenizer_path)
    end, width = np.array([end_id], "<u4").tobytes(), 4 * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if version not in _encoders:
            _encoders.clear()
            _encoders[version] = encoder(tokenizer_path, model)
        encode = _encoders[version]
        bins = OpenSequences(size, most, TaskContext.get().partitionId() << TASK_BITS)
        waiting: list[tuple] = []
        ready: list[tuple] = []
        held, id_type = 0, None

        def rows() -> pa.RecordBatch:
            doc, piece, start, ids, seq, offset = zip(*ready, strict=True)
            columns = [pa.array(doc, id_type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())]
            ready.clear()
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

        def settle() -> None:
            waiting.sort(key=lambda p: -len(p[3]))
            ready.extend((*p, *bins.place(len(p[3]) // 4)) for p in waiting)
            waiting.clear()

        for batch in batches:
            id_type = batch.column("doc_id").type
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), width)):
                    cut = ids[at : at + width]
                    row = (doc, piece, at // 4, cut)
                    held += len(cut) + 64
                    if len(cut) == width:
                        ready.append((*row, *bins.place(size)))
                    else:
                        waiting.append(row)
                        if len(waiting) >= window:
                            settle()
                    if held > HELD_BYTES and ready:
                        yield rows()
                        held = sum(len(p[3]) + 64 for p in waiting)
        settle()
        if ready:
            yield rows()

    return docs.mapInArrow(run, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids binary, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, doc_ids, ids): the sequences themselves, pieces in place; a sequence's pieces are as many as its size at most."""
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return parts.select("sequence_id", "length", F.col("p.doc_id").alias("doc_ids"), F.aggregate("p", F.lit(b""), lambda ids, q: F.concat(ids, q["ids"])).alias("ids"))
