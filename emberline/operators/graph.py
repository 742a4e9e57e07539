"""Typed relation graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..session import ensure_checkpoint_dir

#: Weight of an edge type on a path; others count OTHER.
WEIGHTS, OTHER = {"kin": 1.0, "explains": 0.85}, 0.5


def valid(edges: DataFrame, types: list[str]) -> DataFrame:
    return edges.filter(F.col("type").isin(types) & F.col("strength").between(0.0, 1.0) & (F.col("source") != F.col("target")))


def both_ways(edges: DataFrame) -> DataFrame:
    out = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "type", "strength", F.lit("out").alias("direction"))
    back = edges.select(F.col("target").alias("a"), F.col("source").alias("b"), "type", "strength", F.lit("in").alias("direction"))
    return out.unionByName(back)


def expand(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, types: list[str], most: int, p: Params = DEFAULTS, depth: int = 2) -> DataFrame:
    """(id, via, type, depth, strength, score): best paths of at most ``depth`` (one or two) hops.

    Seeds never come back; a node reached in one hop isn't reached again in two;
    the best score of a depth wins. Two equi joins over the edges.
    """
    ids = nodes.select("id")
    live = valid(edges, types).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    step = both_ways(live)
    weight = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in WEIGHTS.items()], F.lit(OTHER))
    start = seeds.select("id").distinct()

    def hop(front: DataFrame, least: float, factor: float, depth: int) -> DataFrame:
        met = front.join(step, F.col("id") == F.col("a")).filter(F.col("strength") >= least).drop("id")
        score = F.round(F.col("strength") * weight * factor, 6)
        rows = met.join(start, F.col("b") == F.col("id"), "left_anti").select(F.col("b").alias("id"), F.col("a").alias("via"), "type", F.lit(depth).alias("depth"), "strength", score.alias("score"))
        w = Window.partitionBy("id").orderBy(F.desc("score"), "via", "type")
        return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")

    one = hop(start, p.hop1, 1.0, 1)
    if depth == 1:
        return one.orderBy(F.desc("score"), "id").limit(most)
    two = hop(one.select("id"), p.hop2, p.hop2_factor, 2).join(one.select("id"), "id", "left_anti")
    return one.unionByName(two).orderBy(F.desc("score"), "depth", "id").limit(most)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, comp): least id of each component, by spreading and jumping labels.

    Rounds go on until no label changes; each is checkpointed to the shared folder, so
    plans stay short.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    pairs = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    pairs = pairs.union(pairs.select("b", "a")).filter("a <> b").distinct().checkpoint()
    labels = nodes.select("id", F.col("id").alias("comp")).checkpoint()
    while True:
        near = pairs.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.col("comp").alias("old"), F.least("comp", F.coalesce("m", "comp")).alias("comp"))
        up = labels.select(F.col("id").alias("head"), F.col("comp").alias("up"))
        new = step.join(up, F.col("comp") == F.col("head"), "left").select("id", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")).checkpoint()
        labels = new.select("id", "comp")
        if not new.filter("comp <> old").limit(1).count():
            return labels


def edge_quality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, source, target): dangling targets, edges without a reverse edge, and
    reciprocal pairs once."""
    ids = nodes.select(F.col("id").alias("target"))
    pairs = edges.select("source", "target").distinct()
    back = pairs.select(F.col("target").alias("source"), F.col("source").alias("target"))
    one = lambda kind, df: df.select(F.lit(kind).alias("kind"), "source", "target")
    return one("dangling", pairs.join(ids, "target", "left_anti")).unionByName(one("one_way", pairs.join(back, ["source", "target"], "left_anti"))).unionByName(one("mutual", pairs.join(back, ["source", "target"], "left_semi").filter("source < target")))


def spread_labels(comp: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, comp, label, how): the label of components (id, comp) whose labelled ids (id, label) name exactly one.

    ``how`` is ``own`` for ids with a label, ``spread`` for the others. Components without a label, or with two,
    give no rows; null labels don't count.
    """
    named = labels.filter("label is not null").groupBy("id").agg(F.min("label").alias("own"), F.max("label").alias("last"))
    one = named.join(comp, "id").groupBy("comp").agg(F.min("own").alias("label"), F.max("last").alias("last")).filter("label = last").drop("last")
    met = comp.join(one, "comp").join(named.select("id", "own"), "id", "left")
    return met.select("id", "comp", "label", F.when(F.col("own").isNull(), "spread").otherwise("own").alias("how"))
