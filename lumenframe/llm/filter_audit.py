"""How document filters interact: what each removes under every order of them.

A relational word pipeline. Texts are numbered, stored once and dealt to tasks by
row, so that words are exploded, counted by (row, word) and then by row without
another shuffle. Flags that need no words, and the flag of copies, are outer-
joined to those totals, since a text without words has none. Each part's rows
are then counted under each of the 32 sets of failed filters; all orders, steps
and Shapley sums follow from these counts alone.

Filters (a document fails): A few words; B few different words for its length;
C many ASCII capitals; D a symbol of ``#$%&*|``; E its text is that of a
document with a smaller id, anywhere in the table.

Results in odd cases: a null or empty text has no words, fails A alone, and E
as any other text; a null ``lang`` is the part of the empty string; rows with a
null id never fail E and make no other fail it; rows that repeat an id and its
text do not fail E for each other; label rows with a null id are not used, and
of several labels of an id any that is 1 counts; other columns take no part; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import many_to_one, shuffle_partitions, stored

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: Fixed values of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SYMBOLS = "[#$%&*|]"
SPACE = "[\\x20\\x09-\\x0D]+"


def texts_of(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """(row, doc_id, part, text, digest, c, d), stored: row numbers, and flags that one text alone tells."""
    text = F.coalesce(documents["text"], F.lit(""))
    rows = documents.select(documents["doc_id"].alias("doc_id"), F.coalesce(documents["lang"], F.lit("")).alias("part"), text.alias("text"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    flagged = rows.withColumns({"row": F.monotonically_increasing_id(), "digest": F.unhex(F.sha2("text", 256)), "c": 100 * capitals > MOST_CAPITALS * F.length("text"), "d": F.rlike("text", F.lit(SYMBOLS))})
    return stored(spark, flagged, "audit-texts")


def word_totals(texts: DataFrame) -> DataFrame:
    """(row, n_words, n_distinct) of texts that have words."""
    dealt = texts.select("row", "text").repartition(shuffle_partitions(texts.sparkSession), "row")
    words = dealt.select("row", F.explode(F.split("text", SPACE)).alias("word")).where("word <> ''")
    return words.groupBy("row", "word").agg(F.count("*").alias("n")).groupBy("row").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def failures(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """(doc_id, part, n_words, n_distinct, a, b, c, d, e) of every document: which filters it fails."""
    texts = texts_of(spark, documents)
    few = texts.drop("text")
    first = few.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows"))
    copies = many_to_one(few, stored(spark, first.where("n_rows > 1"), "audit-copies"), "digest")
    both = copies.join(word_totals(texts), "row", "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("n_words", "n_distinct")})
    return both.select(
        "doc_id", "part", "n_words", "n_distinct",
        (F.col("n_words") < LEAST_WORDS).alias("a"), (100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words")).alias("b"),
        "c", "d", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).alias("e"),
    )


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, n0 to n31, good0 to good31, toxic0 to toxic31): documents under each set of failed filters, bit i for the i-th."""
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    mask = sum(F.col(f.lower()).cast("int") * (1 << i) for i, f in enumerate(FILTERS))
    rows = failed.select("doc_id", "part", mask.alias("mask"))
    # Rows without an id have no label; they need not meet in one task to learn that.
    rows = rows.where("doc_id is not null").join(marks, "doc_id", "left").unionByName(rows.where("doc_id is null"), allowMissingColumns=True)
    kinds = {"n": F.lit(True), "good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))}
    return rows.groupBy("part").agg(*(F.count_if((F.col("mask") == m) & c).alias(f"{k}{m}") for k, c in kinds.items() for m in range(MASKS)))


def interactions(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from :func:`mask_counts`."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    lists = counts.select("part", *(F.array(*(f"{k}{m}" for m in range(MASKS))).alias(k) for k in ("n", "good", "toxic")))
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    before = {(o, s): sum(bit[f] for f in o[:s]) for o in orders for s in range(len(o))}
    steps = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s + 1).alias("step"), F.lit(before[o, s]).alias("before"), F.lit(bit[o[s]]).alias("bit")) for o in orders for s in range(len(o))))
    rows = lists.select("*", F.inline(steps))

    def total(kind: str, wanted: Callable[[Column], Column]) -> Column:
        """Documents of the sets that are wanted; the sets are numbered by place."""
        return F.aggregate(F.filter(kind, lambda n, m: wanted(m)), F.lit(0).cast("long"), lambda t, n: t + n)

    hit = lambda m: m.bitwiseAND(F.col("bit")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: hit(m) & ~gone(m)
    made = rows.select(
        "part", "filter_order", "step", "bit",
        total("n", lambda m: ~hit(m) & ~gone(m)).alias("kept"), total("n", here).alias("removed"), total("n", lambda m: hit(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == F.col("bit")).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
    )
    shapley = made.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return made.join(shapley, ["part", "bit"]).drop("bit")


def audit(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    return interactions(stored(spark, mask_counts(failures(spark, documents), labels), "audit-counts"))
