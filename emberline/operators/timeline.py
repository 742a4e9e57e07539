"""Sequences: neighbours, gaps, streaks, succession, sessions, ripples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbours(rows: DataFrame, seeds: DataFrame, window: int) -> DataFrame:
    """(seed, id, distance): rows of a seed's thread within ``window`` places."""
    w = Window.partitionBy("thread").orderBy("ts", "id")
    found = rows
    offsets = [d for d in range(-window, window + 1) if d]
    for d in offsets:
        found = found.withColumn(f"n{d}", F.lead("id", d).over(w) if d > 0 else F.lag("id", -d).over(w))
    near = found.join(seeds.select(F.col("id").alias("seed")).distinct(), F.col("id") == F.col("seed"), "left_semi")
    return near.select(F.col("id").alias("seed"), F.explode(F.array(*[F.struct(F.col(f"n{d}").alias("id"), F.lit(d).alias("distance")) for d in offsets])).alias("x")).select("seed", "x.id", "x.distance").filter("id is not null")


def largest_gap(rows: DataFrame, least_s: int) -> DataFrame:
    """(user, before, after, gap_s): each user's largest gap of at least ``least_s``."""
    w = Window.partitionBy("user").orderBy("ts", "id")
    gaps = rows.withColumn("next", F.lead("ts").over(w)).withColumn("gap_s", F.unix_seconds(F.col("next").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp")))
    top = gaps.filter(F.col("gap_s") >= least_s).groupBy("user").agg(F.max(F.struct("gap_s", (-F.col("id")).alias("m"))).alias("x"))
    return top.select("user", (-F.col("x.m")).alias("before_id"), F.col("x.gap_s").alias("gap_s"))


def streaks(days: DataFrame) -> DataFrame:
    """``days`` (key, day, silent) with ``streak``: silent days so far in the run."""
    w = Window.partitionBy("key").orderBy("day")
    marked = days.withColumn("island", F.sum((~F.col("silent")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("key", "island").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("streak", F.sum(F.col("silent").cast("int")).over(within)).drop("island")


def succession(rows: DataFrame) -> DataFrame:
    """Bitemporal succession of (key, id, valid_at): the newest is current, every
    other ends where the next begins, whatever order they arrived in."""
    w = Window.partitionBy("key").orderBy("valid_at", "id")
    return rows.withColumn("invalid_at", F.lead("valid_at").over(w)).withColumn("state", F.when(F.col("invalid_at").isNull(), "current").otherwise("historical"))


def sessions(rows: DataFrame, gap_s: int) -> DataFrame:
    """``rows`` (user, ts, id) with ``session``, counted from 1, by gaps over ``gap_s``."""
    w = Window.partitionBy("user").orderBy("ts", "id")
    since = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(w).cast("timestamp"))
    return rows.withColumn("new", F.coalesce((since > gap_s).cast("int"), F.lit(1))).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def ripple(rows: DataFrame, centres: DataFrame, hours: int, most: int) -> DataFrame:
    """(centre, id, n): the first ``most`` rows, by time then id, within ``hours``.

    Rows are ranked inside buckets of the window's width, and each centre's place in
    the bucket where its window begins is a running count there. So a centre asks for
    ``most`` + 1 ranks of three buckets, an equi join, however many rows the window holds.
    """
    width = hours * 3600
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    left = rows.select("id", at.alias("s")).filter("s is not null").withColumn("bucket", F.floor(F.col("s") / width))
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("s", "id")))
    right = centres.select(F.col("id").alias("centre"), at.alias("c")).filter("c is not null")
    marks = right.select(F.floor((F.col("c") - width) / width).alias("bucket"), (F.col("c") - width).alias("s"), "centre", "c", F.lit(0).alias("one"))
    line = left.select("bucket", "s", F.lit(None).cast(centres.schema["id"].dataType).alias("centre"), F.lit(None).cast("long").alias("c"), F.lit(1).alias("one")).unionByName(marks)
    before = F.sum("one").over(Window.partitionBy("bucket").orderBy("s", "one").rowsBetween(Window.unboundedPreceding, 0))  # a mark stands before rows of its second
    firsts = line.withColumn("before", before).filter("c is not null")
    starts = F.array(*[F.struct((F.col("bucket") + d).alias("bucket"), (F.col("before") if d == 0 else F.lit(0)).cast("long").alias("before")) for d in range(3)])
    asked = firsts.select("centre", "c", F.explode(starts).alias("x")).select("centre", "c", "x.bucket", F.explode(F.sequence(F.col("x.before").cast("int") + 1, F.col("x.before").cast("int") + most + 1)).alias("rank"))
    met = asked.join(ranked, ["bucket", "rank"]).filter((F.abs(F.col("s") - F.col("c")) <= width) & (F.col("id") != F.col("centre")))
    w = Window.partitionBy("centre").orderBy("s", "id")
    return met.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).select("centre", "id", "n")


def spine(first: str, last: str, spark) -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}', INTERVAL 1 DAY)) AS day")


def folded_state(rows: DataFrame, key: str, tau_s: float) -> DataFrame:
    """(key, state): exponentially decaying state with additive stimuli in 0..1 after all rows of a
    key, (key, x: struct<ts, event_id, at, amount>) folded in order of time.

    The clamp makes the fold sequential, so a key's stimuli are one array; of a key with
    very many, those before its last day have decayed below any digit kept and can be cut
    by the caller. The stream form keeps one number a key instead.
    """
    ordered = rows.groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("l"))
    start = F.struct(F.lit(0.0).alias("v"), F.col("l")[0]["at"].alias("at"))

    def step(s, x):
        v = s["v"] * F.exp(-(x["at"] - s["at"]) / F.lit(tau_s)) + x["amount"]
        return F.struct(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)).alias("v"), x["at"].alias("at"))

    return ordered.select(key, F.round(F.aggregate("l", start, step)["v"], 6).alias("state"))
