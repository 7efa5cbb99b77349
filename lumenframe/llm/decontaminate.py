"""Benchmark decontamination with a distributed positional inverted index.

Only DataFrame functions. One pass over the texts stores the postings
(document, position) of every term of the benchmark as the index, with a
sentinel posting that holds each document's length; all that follows reads the
index. Each window of an item picks its two rarest terms. Postings of the
rarest, shifted by its offset in the window, are intersected with those of the
next rarest; where both agree, the remaining terms' postings of that document
must agree too. What is left is exact: every window occurrence, and nothing else.

Results in odd cases: null texts have no words; items without words have no
windows; a null item_id marks words but is not listed or counted; repeated
items are one; repeated documents each keep a row; windows with a term that
occurs nowhere are dropped before any list is intersected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import fresh, if_small, numbered, stored

WINDOW = 10

#: What lies between words, in lower-cased text, and the letters that are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters beyond ASCII that lower() might change too.
OTHER_CASED = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^\x00-\x7F]]"
#: The sentinel posting's term, which no word equals, and its number.
LENGTH, LENGTH_ID = "", -1


def words(text: F.Column) -> F.Column:
    """Words of a text whose A-Z are lower-cased; lower() where it does the same, as it is much faster."""
    low = F.when(text.rlike(OTHER_CASED), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, SEPARATORS), "")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, terms) of each item's windows, distinct."""
    rows = items.select("item_id", words(F.coalesce("text", F.lit(""))).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    rows = rows.select("item_id", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("s"))
    return rows.select("item_id", F.slice("w", F.col("s"), F.col("n")).alias("terms")).distinct()


class Index:
    """Stored tables: ``by_item`` (item_id, terms), ``wins`` (wid, terms), ``places`` (wid, n, o, tid), ``postings`` (tid, row, pos, doc_id)."""

    def __init__(self, spark: SparkSession, documents: DataFrame, items: DataFrame, size: int, row: str | None) -> None:
        self.spark = spark
        self.by_item = stored(spark, windows(items, size), "decontam-windows")
        self.wins, _ = numbered(spark, self.by_item.select("terms").distinct(), "decontam-wins", "wid")
        each = self.wins.select("wid", F.size("terms").alias("n"), F.posexplode("terms").alias("o", "term"))
        terms, _ = numbered(spark, each.select("term").distinct(), "decontam-terms", "tid")
        self.places = stored(spark, each.join(terms, "term").select("wid", "n", "o", "tid"), "decontam-places")
        if row is None:
            row = fresh(documents)
            documents = documents.withColumn(row, F.monotonically_increasing_id())
        docs = documents.select(documents[row].alias("row"), documents["doc_id"].alias("doc_id"), F.coalesce(documents["text"], F.lit("")).alias("text"))
        tokens = docs.select("row", "doc_id", F.posexplode(F.concat(words(F.col("text")), F.array(F.lit(LENGTH)))).alias("pos", "term"))
        known = terms.unionByName(spark.createDataFrame([(LENGTH, LENGTH_ID)], "term string, tid long"))
        postings = tokens.join(if_small(known, 64), "term").select("tid", "row", "pos", F.when(F.col("tid") == LENGTH_ID, F.col("doc_id")).alias("doc_id"))
        self.postings = stored(spark, postings, "decontam-index")

    def lengths(self) -> DataFrame:
        """(row, doc_id, n_words) of each document."""
        return self.postings.where(F.col("tid") == LENGTH_ID).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))

    def anchors(self) -> DataFrame:
        """(wid, n, t1, o1, t2, o2, tids): each window's two rarest terms and their offsets, and all terms in order; windows with a term that never occurs are left out."""
        freq = self.postings.where(F.col("tid") != LENGTH_ID).groupBy("tid").agg(F.count("*").alias("freq"))
        ranked = self.places.join(freq, "tid").withColumn("k", F.row_number().over(Window.partitionBy("wid").orderBy("freq", "tid", "o")))
        both = ranked.groupBy("wid", "n").agg(F.count("*").alias("seen"), F.array_sort(F.collect_list(F.struct("k", "tid", "o"))).alias("all"), F.array_sort(F.collect_list(F.struct("o", "tid"))).alias("line"))
        # The second list is that of another term, if the window has one.
        second = F.expr("get(filter(all, x -> x.tid != all[0].tid), 0)")
        rows = both.where("seen = n").select("wid", "n", F.expr("all[0].tid").alias("t1"), F.expr("all[0].o").alias("o1"), second["tid"].alias("t2"), second["o"].alias("o2"), F.expr("line.tid").alias("tids"))
        return stored(self.spark, rows, "decontam-anchors")

    def matches(self) -> DataFrame:
        """(row, wid, start, n) of every exact occurrence of a window."""
        anchors = self.anchors()
        shifted = self.postings.select("tid", "row", "pos").join(if_small(anchors.select("wid", "n", F.col("t1").alias("tid"), "o1", "t2", "o2"), 64), "tid")
        first = shifted.select("row", "wid", "n", (F.col("pos") - F.col("o1")).alias("start"), "t2", "o2").where("start >= 0")
        lone = first.where("t2 is null").select("row", "wid", "n", "start")
        asked = first.where("t2 is not null").withColumn("pos", F.col("start") + F.col("o2"))
        seconds = if_small(anchors.where("t2 is not null").select(F.col("t2").alias("tid")).distinct(), 16)
        other = self.postings.join(seconds, "tid", "left_semi").select(F.col("tid").alias("t2"), "row", "pos")
        pairs = asked.join(other, ["row", "pos", "t2"], "left_semi").select("row", "wid", "n", "start")
        held = stored(self.spark, pairs.unionByName(lone), "decontam-pairs")
        # The other terms' postings, of the documents that are left.
        near = self.postings.select("tid", "row", "pos").join(if_small(held.select("row").distinct(), 16), "row", "left_semi")
        line = held.join(if_small(anchors.select("wid", "tids"), 160), "wid").select("row", "wid", "n", "start", F.posexplode("tids").alias("o", "tid"))
        agreed = line.withColumn("pos", F.col("start") + F.col("o")).join(near, ["row", "pos", "tid"], "left_semi")
        full = agreed.groupBy("row", "wid", "start", "n").agg(F.bit_or(F.expr("shiftleft(1L, o)")).alias("seen"))
        return full.where(F.expr("seen = shiftleft(1L, n) - 1")).select("row", "wid", "start", "n")


def contamination(spark: SparkSession, documents: DataFrame, items: DataFrame, size: int = WINDOW, row: str | None = None) -> DataFrame:
    """(row, doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of ``documents``; ``row``: a column that numbers them."""
    if not 1 <= size <= 62:
        raise ValueError("a window has 1 to 62 words")
    index = Index(spark, documents, items, size, row)
    found = stored(spark, index.matches(), "decontam-found")
    hits = found.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("p")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    of_item = index.by_item.join(index.wins, "terms").select("wid", "item_id")
    listed = found.select("row", "wid").distinct().join(if_small(of_item, 48), "wid").where("item_id is not null").select("row", F.col("item_id").cast("string").alias("item")).distinct()
    listed = listed.groupBy("row").agg(F.count("*").alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item"))).alias("items"))
    out = index.lengths().join(hits.join(listed, "row", "left"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("row", "doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def uncontaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of an item."""
    docs, row = numbered(spark, docs, "decontam-docs")
    gone = stored(spark, contamination(spark, docs, items, size, row).where("contaminated").select("row"), "decontam-gone")
    side = if_small(gone, 16)
    return docs.join(side, docs[row] == side["row"], "left_anti").drop(row)


def proximity(spark: SparkSession, documents: DataFrame, items: DataFrame, distance: int, size: int = WINDOW) -> DataFrame:
    """(row, doc_id, terms, pos): occurrences of a window's rarest term with every other term of the window at most ``distance`` words away, in any order."""
    index = Index(spark, documents, items, size, None)
    anchors = index.anchors()
    cell = F.floor(F.col("pos") / F.lit(distance + 1))
    terms = F.array_distinct("tids")
    centre = index.postings.select("tid", "row", "pos").join(if_small(anchors.select("wid", F.col("t1").alias("tid"), terms.alias("all")), 160), "tid")
    centre = centre.select("row", "wid", F.col("pos").alias("at"), F.size("all").alias("need"), F.explode("all").alias("tid"), cell.alias("c0")).withColumn("cell", F.explode(F.array(F.col("c0") - 1, F.col("c0"), F.col("c0") + 1)))
    near = centre.join(index.postings.select("tid", "row", "pos", cell.alias("cell")), ["row", "tid", "cell"]).where(F.abs(F.col("pos") - F.col("at")) <= distance)
    seen = near.select("row", "wid", "at", "need", "tid").distinct().groupBy("row", "wid", "at", "need").agg(F.count("*").alias("n")).where("n = need")
    return seen.join(index.lengths(), "row").join(if_small(index.wins, 400), "wid").select("row", "doc_id", "terms", F.col("at").alias("pos"))
