"""Token counts through a digest cache.

Each text is normalised and digested with SHA-256; so is the vocabulary file.
The pair is joined to a stored table of counts. Only distinct digests that the
table lacks are encoded, and appended to it. Digests that should be stored by
then and are not raise.

Where a vocabulary's own rules drop white space, no token spans it: runs of it
are normalised to one space, a text's count is the sum over its chunks, and each
worker keeps the counts of chunks that it has met. For other vocabularies, and
for sentencepiece models, texts are digested and encoded as they are.

Results in odd cases: null and empty texts have 0 tokens and 0 bytes; repeated
rows and ids each keep a row; a very long text is encoded chunk by chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import base, many_to_one, stored, work_dir

#: A worker forgets its chunks' counts at this many, which bounds its memory.
CHUNKS_KEPT = 400_000
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Version of a vocabulary: the digest of its file."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def piece_counter(model: bytes) -> Callable[[list[str]], list[int]]:
    """As :func:`chunk_counter`, for a sentencepiece model."""
    import sentencepiece

    encode = sentencepiece.SentencePieceProcessor(model_proto=model).encode
    return lambda texts: [len(encode(t, add_bos=False, add_eos=False)) for t in texts]


def chunk_counter(model: bytes, splits: bool) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, without special tokens added. ``splits``: no token spans white space."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_buffer(model)
    tok.no_truncation()
    tok.no_padding()
    known: dict[bytes, int] = {}

    def encode(parts: list[str]) -> list[int]:
        return [len(e.ids) for e in tok.encode_batch_fast(parts, add_special_tokens=False)]

    def count(texts: list[str]) -> list[int]:
        if not splits:
            return encode(texts)
        out = []
        for text in texts:
            chunks = text.encode().split()
            try:
                out.append(sum([known[c] for c in chunks]))
                continue
            except KeyError:
                pass
            fresh = list({c for c in chunks if c not in known})
            if len(known) + len(fresh) > CHUNKS_KEPT:
                known.clear()
                fresh = list(set(chunks))
            for i in range(0, len(fresh), 4096):
                part = fresh[i : i + 4096]
                known.update(zip(part, encode([c.decode() for c in part]), strict=True))
            out.append(sum([known[c] for c in chunks]))
            if len(known) > CHUNKS_KEPT:
                known.clear()
        return out

    return count


def spans_no_space(path: str) -> bool:
    """Whether the vocabulary's own pre-tokenizer drops white space, so that counts add up over chunks."""
    import json

    if path.endswith(".model"):
        return False
    pre = json.loads(Path(path).read_text()).get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers", [pre])
    return any(p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert") and "\\s" in p["pattern"].get("Regex", "") for p in parts)


def encode_missing(misses: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) for rows (digest, text) of distinct digests."""
    model, splits = Path(path).read_bytes(), spans_no_space(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = piece_counter(model) if path.endswith(".model") else chunk_counter(model, splits)
        for batch in batches:
            counts = [n for i in range(0, batch.num_rows, 64) for n in count(batch.column("text").slice(i, 64).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return misses.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; none yet: an empty table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def count_tokens(spark: SparkSession, docs: DataFrame, tokenizer_path: str, cache: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row of ``docs``.

    ``cache``: folder of the stored counts, appended to; by default one in the
    shared folder. A retried append may store a digest twice; reads take it once.
    """
    version = tokenizer_digest(tokenizer_path)
    cache = cache or f"{work_dir(spark)}/token-counts"
    # Only white space that the vocabulary drops itself is folded.
    normal = F.regexp_replace("text", "[ \\t\\n\\r]+", " ") if spans_no_space(tokenizer_path) else F.col("text")
    texts = base(docs).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2(normal, 256)).alias("digest"))
    rows = stored(spark, texts.select("doc_id", "n_bytes", "digest"), "token-digests")
    sizes = rows.groupBy("digest").agg(F.count("*").alias("n_rows"))
    before = read_cache(spark, cache).where(F.col("tokenizer") == version)
    known = before.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # The first text of each digest stands for its copies; groups shrink before the shuffle.
    distinct = texts.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(known, "digest", "left_anti")
    new = encode_missing(misses, tokenizer_path).select("digest", F.lit(version).alias("tokenizer"), "n_tokens")
    new.write.mode("append").parquet(cache)
    after = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counted = many_to_one(rows, stored(spark, sizes.join(after, "digest"), "token-sizes"), "digest")
    lost = F.raise_error(F.lit("a text's count is not in the cache")).cast("long")
    return counted.select("doc_id", "n_bytes", F.coalesce("n_tokens", lost).alias("n_tokens"))
