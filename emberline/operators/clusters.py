"""Greedy leader clusters in rounds, and the roll-up of clusters into episodes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from .vectors import met, near_blocks, plain_rows, unit_blocks

#: Rows at the head of the order that a round decides by the plain loop.
HEAD = 2048


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _loop(ids: list[int], vectors: list[list[float]], threshold: float) -> list[int]:
    """Leaders among rows in order: one that no earlier leader takes."""
    leads: list[int] = []
    by_size: dict[int, list[np.ndarray]] = {}
    for i, v in zip(ids, vectors):
        u = np.asarray(v, float)
        u = u / np.sqrt((u * u).sum())
        held = by_size.setdefault(len(u), [])
        if held and (np.round(np.stack(held) @ u, 9) > threshold).any():
            continue
        held.append(u)
        leads.append(i)
    return leads


def covered(rows: DataFrame, leaders: DataFrame, threshold: float, block: int) -> DataFrame:
    """(id, lead): rows that some earlier leader takes, with the earliest such leader."""
    out = pa.schema([("id", pa.int64()), ("lead", pa.int64())])
    none = np.iinfo(np.int64).max

    def score(ids, unit, others, with_, same):
        near = (np.round(unit @ with_.T, 9) > threshold) & (others[None, :] < ids[:, None])
        lead = np.where(near, others[None, :], none).min(axis=1, initial=none)
        own = lead < none
        return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(lead[own])], schema=out)

    pairs = near_blocks(unit_blocks(rows, block), unit_blocks(leaders, block), threshold)
    return met(pairs, score, "id long, lead long").groupBy("id").agg(F.min("lead").alias("lead"))


def blocked(rows: DataFrame, threshold: float, block: int) -> DataFrame:
    """Ids of rows that have an earlier row near them; no pair is emitted."""
    out = pa.schema([("id", pa.int64())])

    def score(ids, unit, others, with_, same):
        near = np.round(unit @ with_.T, 9) > threshold
        later = near & (others[None, :] < ids[:, None])
        found = [ids[later.any(axis=1)]]
        if not same:
            found.append(others[(near & (others[None, :] > ids[:, None])).any(axis=0)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], schema=out)

    blocks = unit_blocks(rows, block)
    return met(near_blocks(blocks, blocks, threshold).filter("name_a <= name_b"), score, "id long").distinct()


def leader_clusters(vectors: DataFrame, threshold: float, head: int = HEAD, block: int = 4096) -> DataFrame:
    """(lead, id): in the order of ids, a row that no earlier leader took leads and takes all later
    free rows with a cosine over ``threshold`` (0 or more); a leader is its own member.

    The result is that of the sequential loop, found in rounds. A row is a leader if and only if no earlier
    row near it is one. A round first decides the first ``head`` open rows by the loop itself, so a large
    group of near rows is taken by its leader at a cost linear in its size; then every open row
    without an earlier open row near it becomes a leader, wherever it stands in the order. What leaders
    take is closed, and the rest goes to the next round. Last, every taken row finds its earliest
    leader. No task holds more than two blocks, and pairs of rows are never emitted. Ids are
    unique; rows without id or vector and zero vectors are left out.
    """
    spark = vectors.sparkSession
    some = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x) > 0
    rows = _kept(plain_rows(vectors).filter(some), "leader-rows")
    leaders: list[DataFrame] = []
    schema, open_ = rows.schema, rows
    while True:
        first = open_.orderBy("id").limit(head).collect()  # at most ``head`` rows
        if not first:
            break
        leads = set(_loop([r.id for r in first], [r.vec for r in first], threshold))
        new = spark.createDataFrame([r for r in first if r.id in leads], schema)
        leaders.append(new)
        open_ = open_.filter(F.col("id") > first[-1].id)
        if open_.isEmpty():
            break
        open_ = _kept(open_.join(covered(open_, new, threshold, block), "id", "left_anti"), "leader-open")
        held = blocked(open_, threshold, block)
        new = _kept(open_.join(held, "id", "left_anti"), "leader-new")
        leaders.append(new)
        open_ = open_.join(new.select("id"), "id", "left_anti")
        open_ = _kept(open_.join(covered(open_, new, threshold, block), "id", "left_anti"), "leader-open")
    every = _kept(reduce(DataFrame.unionByName, leaders) if leaders else rows.limit(0), "leaders")
    taken = covered(rows.join(every.select("id"), "id", "left_anti"), every, threshold, block).select("lead", "id")
    return every.select(F.col("id").alias("lead"), "id").unionByName(taken)


def patterns(clusters: DataFrame, least: int = 3, most: int = 20, pin: int = 5) -> DataFrame:
    """(lead, n, action): the ``most`` largest clusters of ``least`` or more, equal sizes by their order."""
    size = clusters.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return size.orderBy(F.desc("n"), "lead").limit(most).withColumn("action", F.when(F.col("n") >= pin, "pin").otherwise("review"))


def episodes(clusters: DataFrame, records: DataFrame) -> DataFrame:
    """One episode for each cluster (seed, id) of ``records`` (id, event_at, importance, valence, arousal, domain).

    n, importance (the largest, 10 at most), mean valence and arousal, the dominant domain (the most
    frequent; of equals the one first seen in time order), span_start, span_end and ``sources``, the
    members in time order. Clusters have a size bound, so their arrays do too.
    """
    rows = clusters.join(records, "id")
    ordered = F.sort_array(F.collect_list(F.struct("event_at", "id")))
    body = rows.groupBy("seed").agg(
        F.count(F.lit(1)).alias("n"), F.least(F.max("importance"), F.lit(10)).cast("long").alias("importance"), F.avg("valence").alias("valence"), F.avg("arousal").alias("arousal"),
        F.min("event_at").alias("span_start"), F.max("event_at").alias("span_end"), F.transform(ordered, lambda x: x["id"]).alias("sources"),
    )
    told = rows.select("seed", "event_at", "id", F.posexplode("domain").alias("at", "domain"))
    votes = told.groupBy("seed", "domain").agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("event_at", "id", "at")).alias("seen"))
    first = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("votes"), "seen"))
    best = votes.withColumn("rn", first).filter("rn = 1").select("seed", "domain")
    return body.join(best, "seed", "left")
