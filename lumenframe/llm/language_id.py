"""Language identification by compression.

One raw-content zstandard dictionary per language is filled from a bounded
sample of labelled rows; a text belongs to the language whose dictionary lets
it shrink most. Whole texts are compressed, in lower case and without ASCII
signs, digits and line ends, which tell no language apart, in pieces that each
start from the dictionary alone: what it saves grows with the text, so the
margin does not fall with length. The call is rejected if the two best sums of
sizes lie too close together.

Results in odd cases: a null text, or one without a letter, is ``und`` with
score 0 and rejected; with no learned language at all every text is; ties go
to the language with more training rows, then by name; rows keep their number, repeated ids and
extra columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import small_batches

UNKNOWN = "und"
#: Most bytes of whole sampled texts that fill a language's dictionary; one text alone may be larger.
DICT_BYTES = 64 << 10
#: Bytes of a text that are compressed at a time.
PIECE_BYTES = 16 << 10
#: Most labelled rows of a language that are looked at: the bound of the training sample.
SAMPLE_ROWS = 96
#: (second best - best) / second best below which a call is rejected.
MIN_MARGIN = 0.004
LEVEL = 5
SIGNS = bytes(i for i in range(128) if i != 32 and not chr(i).isalpha())


def letters(text: str) -> bytes:
    """What is compressed of a text."""
    return text.replace("\n", " ").lower().encode().translate(None, SIGNS)


def fit(train: DataFrame, sample_rows: int = SAMPLE_ROWS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionary content by language, the most frequent first, from rows (doc_id, text, lang) with text and lang.

    Of a language's rows, ``sample_rows`` are drawn by hash, shorter than a
    dictionary before longer ones; their texts fill it whole, in that order, as
    long as they fit.

    A first aggregation counts each language; then only rows whose hash falls
    under a language's share of ``sample_rows`` are moved, so no language is
    ever sorted or gathered as a whole.
    """
    rows = train.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    count = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not count:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in count.items() for x in (lang, min(1.0, 3 * sample_rows / n))])
    unit = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = rows.where(unit < share[F.col("lang")]).groupBy("lang", "text").agg(F.min("h").alias("h"))
    # Whole texts only: those that a dictionary can hold come first.
    size = F.octet_length("text")
    order = Window.partitionBy("lang").orderBy(F.greatest(size, F.lit(dict_bytes)), "h", "text")
    near = near.select("lang", "text", F.row_number().over(order).alias("k"))
    picked: dict[str, list[tuple[int, bytes]]] = {}
    for r in near.where(F.col("k") <= sample_rows).collect():
        picked.setdefault(r["lang"], []).append((r["k"], letters(r["text"])))
    out = {}
    for lang, texts in sorted(picked.items(), key=lambda x: (-count[x[0]], x[0])):
        content = b""
        for _, t in sorted(texts):
            if not content or len(content) + 1 + len(t) <= dict_bytes:
                content = content + b" " + t if content else t
        if len(content) >= 8:  # the least that zstandard takes
            out[lang] = content
    return out


class Coders:
    """One compressor a language."""

    def __init__(self, model: dict[str, bytes]) -> None:
        self.langs, self.coders = list(model), []
        for content in model.values():
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=params)
            self.coders.append(zstandard.ZstdCompressor(compression_params=params, dict_data=data).compress)

    def classify(self, text: str | None) -> tuple[str, float]:
        """(language, margin)."""
        if not self.coders or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        raw = letters(text)
        pieces = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
        sizes = [sum(len(c(x)) for x in pieces) for c in self.coders]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        second = sizes[order[1]] if len(order) > 1 else max(best, len(raw) + 12 * len(pieces))
        return self.langs[order[0]], (second - best) / second


def predict(docs: DataFrame, model: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = Coders(model)
        for batch in batches:
            found = [coders.classify(text.as_py()) for text in batch.column("text")]
            margins = [m for _, m in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([p for p, _ in found], pa.string()), pa.array(margins, pa.float64()), pa.array([m < min_margin for m in margins], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs``, all columns, whose call is not rejected."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = Coders(model)
        for batch in batches:
            yield batch.filter(pa.array([coders.classify(text.as_py())[1] >= min_margin for text in batch.column(place)], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def held_out(folds: int, fold: int) -> F.Column:
    """Whether crc32 of the id as text falls in the fold that nothing is learned from. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold


def identify(docs: DataFrame, labelled: DataFrame | None = None, folds: int = 3, fold: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): learns from ``labelled`` (default: docs) outside the held-out fold."""
    train = (docs if labelled is None else labelled).where(~held_out(folds, fold))
    model = fit(train)
    return predict(docs, model).select("doc_id", held_out(folds, fold).alias("held_out"), "lang_pred", "score", "rejected")
