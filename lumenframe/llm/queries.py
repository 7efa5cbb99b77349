"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import work_dir
from lumenframe.llm import context_tree, decontaminate, filter_audit, language_id, mixing, packing, pii, simhash, suffix_dedup, token_counts, topk_search, whitening, word_windows

TOKEN_LIMIT = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # spark.lumenframe.tokenCounts may name a lasting cache; else each call has its own, and its figures are a cold start's.
    cache = spark.conf.get("spark.lumenframe.tokenCounts", None) or f"{work_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    counts = token_counts.count_tokens(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(mixing.DOMAINS)), "rate")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(spark, table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_windows.deduplicate(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark, table(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), TOKEN_LIMIT)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_decontaminate, op3_mixing, op4_suffix_dedup, op5_simhash, op6_context_tree, op7_pii, op8_word_windows, op9_language_id, op10_topk_search, op11_filter_audit, op12_whitening, op13_packing)}


#: DuckDB has no byte-pair encoder, XXH64 with a seed, CRF or zstandard: those are tested against brute force.
SQL = {
    "op2_decontaminate": """
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS k
          FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
        n AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS k
          FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, n WHERE len(w) >= n)),
        m AS (SELECT r, s, n, k FROM dw WHERE (n, k) IN (SELECT (n, k) FROM bw)),
        h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
        i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM m JOIN bw USING (n, k)) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
          sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)""",
    "op8_word_windows": """
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT r, s, array_to_string(w[s : s + 34], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
        m AS (SELECT r, s FROM g WHERE k IN (SELECT k FROM g GROUP BY k HAVING count(*) > 1)),
        p AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS p FROM m),
        c AS (SELECT r, list(p) AS ps FROM p GROUP BY r),
        k AS (SELECT doc_id, w, CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i)), lambda i: w[i]) END AS kept FROM d LEFT JOIN c USING (r))
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
    "op10_topk_search": """
        WITH x AS (
          SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM (SELECT * FROM x WHERE vec_id % 50 = 0) q JOIN x c ON c.r <> q.r AND len(c.v) = len(q.v)
        ), r AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT * FROM r WHERE rank <= 5""",
    "op11_filter_audit": """
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
        l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
            'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
            'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
            'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)} AS f
          FROM w LEFT JOIN l USING (doc_id)),
        one AS (SELECT part, good, toxic, [[f.A, f.B, f.C, f.D, f.E][i] FOR i IN range(1, 6)] AS f FROM f),
        n(i) AS (SELECT unnest(range(1, 6))),
        o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM n a, n b, n c, n d, n e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        s AS (SELECT part, o, i AS step, o[i] AS k, good, toxic, f[o[i]] AS hit, len(list_filter(o[1 : i - 1], lambda x: f[x])) > 0 AS gone,
            f[o[i]] AND len(list_filter(f, lambda x: x)) = 1 AS alone FROM one, o, n),
        c AS (SELECT part, o, step, k, count_if(NOT hit AND NOT gone) AS kept, count_if(hit AND NOT gone) AS removed, count_if(hit AND gone) AS redundant,
            count_if(alone) AS unique_fails, count_if(hit AND NOT gone AND good) AS good_lost, count_if(hit AND NOT gone AND toxic) AS toxic_lost
          FROM s GROUP BY part, o, step, k)
        SELECT part, array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, CAST(step AS INTEGER) AS step,
          CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
          CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
        FROM c""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
