"""The append-only event ledger: idempotent writes, coverage, backlog, checks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append_once(stored: DataFrame, incoming: DataFrame, key: list[str], digest: str) -> DataFrame:
    """``incoming`` with ``outcome``: inserted, replayed or conflict.

    The first row of a key wins, stored rows before incoming ones; an equal digest (null equals null)
    is a replay, another one a conflict. Incoming rows carry a unique ``seq``. Null keys are keys too; a stored key
    with several digests counts with the least. First rows are found by an aggregate, so a key of many rows is
    combined before it is shuffled.
    """
    side = lambda df, x: df.groupBy(*[F.col(k).alias(f"_{x}{n}") for n, k in enumerate(key)])
    same = lambda x: reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{x}{n}")) for n, k in enumerate(key)])
    known = side(stored, "s").agg(F.min(F.struct(digest)).alias("_stored"))
    first = side(incoming, "f").agg(F.min(F.struct("seq", digest)).alias("_first"))
    met = incoming.join(known, same("s"), "left").join(first, same("f"), "left")
    base = F.when(F.col("_stored").isNotNull(), F.col(f"_stored.{digest}")).otherwise(F.col(f"_first.{digest}"))
    new = F.col("_stored").isNull() & F.col("seq").eqNullSafe(F.col("_first.seq"))
    return met.withColumn("outcome", F.when(new, "inserted").when(F.col(digest).eqNullSafe(base), "replayed").otherwise("conflict")).select(*incoming.columns, "outcome")


def upsert(log: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """Last write wins per key; ``revision`` counts the writes."""
    return log.groupBy(key).agg(F.max_by(F.struct(*columns), seq).alias("x"), F.count(F.lit(1)).alias("revision")).select(key, "x.*", "revision")


def uncovered(events: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    return events.join(covered, key, "left_anti")


def conflict_union(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows of both per key with ``conflict`` where their values differ."""
    both = left.select(*key, value).unionByName(right.select(*key, value))
    return both.groupBy(*key).agg(F.min(value).alias(value), (F.count_distinct(value) > 1).alias("conflict"), F.count(F.lit(1)).alias("n"))


def legal_history(stages: DataFrame, allowed: DataFrame) -> DataFrame:
    """(run, seq, stage, problem) of rows that break contiguity or transitions."""
    w = Window.partitionBy("run").orderBy("seq")
    rows = stages.withColumn("before", F.lag("stage").over(w)).withColumn("place", F.row_number().over(w))
    met = rows.join(allowed.select(F.col("from").alias("before"), F.col("to").alias("stage"), F.lit(True).alias("ok")), ["before", "stage"], "left")
    problem = F.when(F.col("place") != F.col("seq"), "gap").when(F.col("before").isNotNull() & F.col("ok").isNull(), "transition")
    return met.withColumn("problem", problem).filter("problem is not null").select("run", "seq", "stage", "problem")
