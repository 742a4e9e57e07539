"""Data-quality checks of the record store as one frame, and the suggestions made of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import facts as R
from ..functions import text as X

OVERSIZED, SHORT, STALE_IMPORTANCE, STALE_DAYS = 1500, 20, 7, 90
#: Severity and suggested action of each check.
CHECKS = {
    "dangling": ("critical", "mark_review"), "self_loop": ("critical", "mark_review"), "protected_resolved": ("critical", "mark_review"),
    "duplicate_edge": ("warning", "mark_review"), "reciprocal_kin": ("warning", "mark_review"), "invalid_type": ("warning", "mark_review"), "invalid_strength": ("warning", "mark_review"),
    "duplicate_name": ("warning", "mark_review"), "oversized": ("info", "split_thread"), "stale_important": ("info", "review_stale"),
}


def report(records: DataFrame, edges: DataFrame, types: list[str], now) -> DataFrame:
    """(check, id, detail): one row for each finding.

    ``records``: id, name, content, domain, resolved, importance, last_active; ``edges``:
    source, target, type, strength. Names and edges are grouped with partial sums; a
    name of very many records gives a row for each of them through a join.
    """
    row = lambda check, df, key, detail: df.select(F.lit(check).alias("check"), F.col(key).alias("id"), detail.cast("string").alias("detail"))
    ids = records.select(F.col("id").alias("target"))
    names = records.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    doubled = edges.groupBy("source", "target", "type").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    kin = edges.filter("type = 'kin' and source <> target").select("source", "target").distinct()
    back = kin.select(F.col("target").alias("source"), F.col("source").alias("target"))
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_active").cast("timestamp"))) / 86_400_000_000
    found = [
        row("dangling", edges.join(ids, "target", "left_anti"), "source", F.col("target")),
        row("self_loop", edges.filter("source = target"), "source", F.col("type")),
        row("duplicate_edge", doubled, "source", F.col("target")),
        row("reciprocal_kin", kin.join(back, ["source", "target"], "left_semi").filter("source < target"), "source", F.col("target")),
        row("invalid_type", edges.filter(~F.col("type").isin(types)), "source", F.col("type")),
        row("invalid_strength", edges.filter(F.col("strength").isNull() | ~F.col("strength").between(0.0, 1.0)), "source", F.col("target")),
        row("oversized", records.filter(F.length("content") > OVERSIZED), "id", F.length("content")),
        row("duplicate_name", records.join(names, "name"), "id", F.col("name")),
        row("protected_resolved", records.filter(F.col("resolved") & R.protected_domain(F.col("domain"))), "id", F.lit("resolved")),
        row("stale_important", records.filter((F.col("importance") >= STALE_IMPORTANCE) & (days > STALE_DAYS)), "id", F.floor(days)),
    ]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def more(records: DataFrame, edges: DataFrame, vectors: DataFrame, judged: DataFrame, now) -> DataFrame:
    """(check, id, detail) of further checks: kin without return, records without vector and vectors without
    record, repeated contents (detail: the least id that has them), records without time or active after ``now``,
    permanent ones that no edge reaches, short ones, and pinned ones that nobody judged.

    ``vectors`` and ``judged`` are (id). Repeats are found by an aggregate over fingerprints and met in a join.
    """
    row = lambda check, df, key, detail: df.select(F.lit(check).alias("check"), F.col(key).alias("id"), detail.cast("string").alias("detail"))
    none = F.lit("none")
    kin = edges.filter("type = 'kin' and source <> target").select("source", "target").distinct()
    back = kin.select(F.col("target").alias("source"), F.col("source").alias("target"))
    prints = records.select("id", X.fingerprint(F.col("content")).alias("fp")).filter("fp is not null")
    first = prints.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    reached = edges.filter("source <> target").select(F.col("target").alias("id"))
    found = [
        row("non_reciprocal", kin.join(back, ["source", "target"], "left_anti"), "source", F.col("target")),
        row("missing_vector", records.join(vectors, "id", "left_anti"), "id", none),
        row("orphan_vector", vectors.join(records.select("id"), "id", "left_anti"), "id", none),
        row("duplicate_content", prints.join(first, "fp").filter("id <> first"), "id", F.col("first")),
        row("untimed", records.filter("event_at is null"), "id", none),
        row("late", records.filter(F.col("last_active") > now), "id", F.date_format("last_active", "yyyy-MM-dd")),
        row("isolated", records.filter("type = 'permanent'").join(reached, "id", "left_anti"), "id", F.col("type")),
        row("short", records.filter(F.length("content") < SHORT), "id", F.length("content")),
        row("unlabelled_core", records.filter("pinned").join(judged, "id", "left_anti"), "id", F.lit("pinned")),
    ]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def suggestions(findings: DataFrame, sample: int = 3) -> DataFrame:
    """(check, action, severity, n, ids): a suggestion for each check with findings, and its least ids."""
    table = F.create_map(*[F.lit(x) for k, v in CHECKS.items() for x in (k, "|".join(v))])
    kind = F.split(F.try_element_at(table, F.col("check")), r"\|")
    # the least ids of each check come from its distinct ids by rank, not from a gathered list
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("check").orderBy("id"))
    some = findings.select("check", "id").distinct().withColumn("k", rank).filter(F.col("k") <= sample)
    ids = some.groupBy("check").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))
    counts = findings.groupBy("check").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(ids, "check").select("check", kind[1].alias("action"), kind[0].alias("severity"), "n", "ids")
