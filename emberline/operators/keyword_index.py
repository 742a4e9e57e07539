"""Keyword search by an inverted index whose blocks are ordered by impact.

A record's score is topic evidence (query words in its name or tags, or at a lower weight in its
content) plus a static part that no query changes. Records are dealt to blocks by falling static part,
so a block's postings share close impacts. The index is three tables:

* ``docs``: a record's block, static part and what filters need;
* ``postings``: for a word and a block, which records hold it, and where; a row is at most a block of ids;
* ``summary``: for a word and a block, in how many records' names or contents it stands. Its rows are the postings'
  without the ids, so bounds are found without opening any.

A query's bound for a block assumes one record that holds, field by field, every query word the block
holds anywhere, at the block's largest static part. The best few blocks are opened first; then those
whose bound reaches the k-th score so far. The texts are not read after the index is written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder

#: Records of a block and blocks of a range partition; blocks that a query opens before it has a k-th score.
BLOCK, RANGE, FIRST = 1024, 64, 2
#: Distinct query words that the plan names at most; more are joined alone.
NAMED = 1000
#: Weight of a word in the content beside one in the name or tags.
CONTENT = 0.8


def words(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits; none for null."""
    return F.coalesce(F.array_distinct(F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")), F.array().cast("array<string>"))


@dataclass(frozen=True)
class Index:
    """Folders of the tables; ``open`` on any session reads them again."""

    folder: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}")


def build(records: DataFrame, static: Column, keep: list[str], block: int = BLOCK) -> Index:
    """Write the index of ``records`` (id, name, tags, content and the columns in ``keep``).

    ``static`` is the part of the score that queries don't change; null counts as 0. Rows without id
    are left out; ids are unique. Null names, tags or contents hold no words.
    """
    spark = records.sparkSession
    folder = shared_folder(spark, "keyword-index")
    cols = [c for c in keep if c not in ("id", "static", "block")]
    rows = records.filter("id is not null").select("id", F.coalesce(static, F.lit(0.0)).cast("double").alias("static"), *cols, words(F.concat_ws(" ", "name", "tags")).alias("in_name"), words(F.col("content")).alias("in_content"))
    n = max(1, -(-records.count() // (block * RANGE)))
    dealt = rows.repartitionByRange(n, F.desc("static"), "id").withColumn("part", F.spark_partition_id())
    # a range holds some RANGE blocks, so no window sees more
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("static"), "id")) - 1
    blocked = dealt.withColumn("block", F.col("part").cast("long") * (1 << 20) + F.floor(place / block)).drop("part")
    blocked.write.parquet(f"{folder}/forward")
    forward = spark.read.parquet(f"{folder}/forward")
    forward.select("id", "block", "static", *cols).repartitionByRange(n, "block").write.parquet(f"{folder}/docs")
    # a name's words are few; those of a content are never looked up in their own list
    at = lambda words, name, content: F.transform(words, lambda w: F.struct(w.alias("word"), name(w).alias("name"), F.lit(content).alias("content")))
    where = F.concat(at(F.col("in_content"), lambda w: F.array_contains("in_name", w), True), at(F.array_except("in_name", "in_content"), lambda w: F.lit(True), False))
    each = forward.select("id", "block", F.explode(where).alias("w")).select("id", "block", "w.*")
    posted = each.groupBy("word", "block").agg(F.count_if("name").alias("n_name"), F.count_if("content").alias("n_content"), F.collect_list(F.struct("id", "name", "content")).alias("ids"))  # at most a block
    posted.repartitionByRange(max(n, 8), "word", "block").sortWithinPartitions("word", "block").write.parquet(f"{folder}/postings")
    posted = spark.read.parquet(f"{folder}/postings")
    posted.select("word", "block", "n_name", "n_content").write.parquet(f"{folder}/summary")
    return Index(folder)


def topic(names: Column, contents: Column, n_words: Column) -> Column:
    return F.when(n_words > 0, F.greatest(names / n_words, CONTENT * contents / n_words)).otherwise(0.0)


def score(topic_share: Column, static: Column, weight: float, total: float) -> Column:
    """Hundredths of the greatest possible score."""
    return 100 * (weight * topic_share + static) / total


def search(spark: SparkSession, index: Index, queries: DataFrame, k: int, weight: float, total: float, keep: Column | None = None, floor: float | None = None, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """(qid, id, score, static) of each query's k best, and (qid, opened, blocks).

    ``queries`` is (qid, query): any number, all at once. ``keep`` is a predicate on the index's
    columns; ``floor`` the least score that counts. Ties go to the smaller id. Equal to scoring every record: a block without any
    of a query's words has a bound too, and is opened if that reaches the k-th score.
    """
    asked = queries.select("qid", words(F.col("query")).alias("words")).withColumn("n_words", F.size("words"))
    docs, postings, summary = (index.table(spark, t) for t in ("docs", "postings", "summary"))
    # few words are named in the plan, so that of the tables sorted by word only their parts are read
    named = [r.word for r in asked.select(F.explode("words").alias("word")).distinct().limit(NAMED + 1).collect()]
    if len(named) <= NAMED:
        postings, summary = postings.filter(F.col("word").isin(named)), summary.filter(F.col("word").isin(named))
    kept = docs if keep is None else docs.filter(keep)
    # of the block the largest static part among rows that the filter keeps: blocks without one are never opened
    blocks = kept.groupBy("block").agg(F.max("static").alias("most"))
    each = asked.select("qid", F.explode("words").alias("word"))
    held = each.join(summary, "word").groupBy("qid", "block").agg(F.count_if(F.col("n_name") > 0).alias("names"), F.count_if(F.col("n_content") > 0).alias("contents"))
    met = asked.select("qid", "n_words").crossJoin(blocks).join(held, ["qid", "block"], "left").na.fill(0, ["names", "contents"])  # a row of numbers for a query and a block
    bound = score(topic(F.col("names"), F.col("contents"), F.col("n_words")), F.col("most"), weight, total)
    bounds = met.select("qid", "n_words", "block", bound.alias("bound"))
    bounds = bounds if floor is None else bounds.filter(F.col("bound") >= floor)
    folder = shared_folder(spark, "keyword-search")
    order = Window.partitionBy("qid").orderBy(F.desc("bound"), "block")
    bounds.withColumn("place", F.row_number().over(order)).write.parquet(f"{folder}/bounds")
    bounds = spark.read.parquet(f"{folder}/bounds")

    def opened(some: DataFrame) -> DataFrame:
        """Scores of all kept records of (qid, n_words, block)."""
        ids = some.select("qid", "block").join(each, "qid").join(postings.select("word", "block", "ids"), ["word", "block"]).select("qid", F.explode("ids").alias("p")).select("qid", "p.*")
        hits = ids.groupBy("qid", "id").agg(F.count_if("name").alias("names"), F.count_if("content").alias("contents"))
        rows = some.join(kept, "block").join(hits, ["qid", "id"], "left").na.fill(0, ["names", "contents"])
        out = rows.withColumn("score", F.round(score(topic(F.col("names"), F.col("contents"), F.col("n_words")), F.col("static"), weight, total), 6))
        return out.select("qid", "id", "score", "static") if floor is None else out.filter(F.col("score") >= floor).select("qid", "id", "score", "static")

    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    top = lambda rows: rows.withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= k)
    top(opened(bounds.filter(F.col("place") <= first))).write.parquet(f"{folder}/first")
    seen = spark.read.parquet(f"{folder}/first")
    kth = seen.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k).drop("n")
    left = bounds.filter(F.col("place") > first).join(kth, "qid", "left").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - 1e-6))
    left.select("qid", "n_words", "block").write.parquet(f"{folder}/second")
    left = spark.read.parquet(f"{folder}/second")
    found = top(seen.drop("pos").unionByName(opened(left)))
    counts = left.groupBy("qid").agg(F.count(F.lit(1)).alias("later"))
    n_blocks = blocks.agg(F.count(F.lit(1)).alias("blocks"))
    early = bounds.groupBy("qid").agg(F.count_if(F.col("place") <= first).alias("early"))
    report = asked.select("qid").join(early, "qid", "left").join(counts, "qid", "left").na.fill(0).crossJoin(n_blocks)  # one row of counts
    return found.select("qid", "pos", "id", "score"), report.select("qid", (F.col("early") + F.col("later")).alias("opened"), "blocks")
