"""Fusion, bands, budgets and top-k."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder


def rrf(channels: DataFrame, k: int = 60, merge_duplicates: bool = True) -> DataFrame:
    """(id, score, first_seen) from (channel, weight, rank, id).

    Each channel votes weight / (k + rank). With ``merge_duplicates`` only the
    first occurrence of an id in a channel votes, though later ones keep their
    rank; otherwise all occurrences add up. ``first_seen`` orders equal scores.
    """
    seen = channels.groupBy("channel", "id").agg(F.min(F.struct("rank", "weight")).alias("x")).select("channel", "id", "x.rank", "x.weight") if merge_duplicates else channels
    vote = F.col("weight") / (k + F.col("rank"))
    return seen.groupBy("id").agg(F.sum(vote).alias("score"), F.min(F.struct("channel", "rank")).alias("first_seen"))


def band_rank(rows: DataFrame, width: float, most: int | None = None) -> DataFrame:
    """``rows`` (id, rel, tie) with ``pos``: order by relevance, reordered by ``tie``
    inside bands that reach ``width`` below their leader (not chained).

    Leaders follow one another, so one task reads the distinct relevances; rows meet
    their band in a join and are numbered inside it, after the rows of earlier bands. With
    ``most`` only so many first rows are returned, and no band sorts more of its rows than that.
    """

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rel", ascending=False).reset_index(drop=True)
        band, leader, bands = -1, None, []
        for rel in pdf["rel"]:
            if leader is None or leader - rel > width:
                band, leader = band + 1, rel
            bands.append(band)
        return pdf.assign(band=bands)[["rel", "n", "band"]]

    keyed = rows.select("id", "rel", "tie", F.coalesce("rel", F.lit(float("nan"))).alias("key"))  # a null is joined as NaN, and last
    counts = keyed.groupBy(F.col("key").alias("rel")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("page"))
    bands = counts.groupBy("page").applyInPandas(lead, "rel double, n long, band int")
    w = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)  # one row for each band
    before = bands.groupBy("band").agg(F.sum("n").alias("n"), F.collect_list("rel").alias("keys")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    met = keyed.join(before.select("band", "before", F.explode("keys").alias("key")), "key")
    inside = F.row_number().over(Window.partitionBy("band").orderBy(F.desc("tie"), F.desc_nulls_last(F.nanvl("rel", F.lit(None))), "id"))
    if most is None:
        return met.select("id", "rel", "tie", "band", (F.col("before") + inside).cast("int").alias("pos"))
    cut = met.filter(F.col("before") < most).withColumn("inside", inside).filter(F.col("inside") <= most)
    return cut.select("id", "rel", "tie", "band", (F.col("before") + F.col("inside")).cast("int").alias("pos")).filter(F.col("pos") <= most)


def token_budget(rows: DataFrame, tokens: str | Column, budget: int, order: list[str | Column], page: int = 64) -> DataFrame:
    """The longest prefix of the order whose tokens fit, with ``used``; the first overflow stops.

    ``order`` has names of columns, falling ones with a minus before them, or rising expressions; together they are unique.
    Nulls stand first in rising and last in falling columns. ``tokens`` is a column
    or an expression, which is only evaluated on pages of the order's first rows, each eight times the last, until one
    overflows or holds all rows. Of rows with tokens at most ``budget`` fit, so only so many are summed in order; rows
    without tokens are compared with the place of the overflow. Null tokens count as none.
    """
    spark = rows.sparkSession
    falling = [isinstance(c, str) and c.startswith("-") for c in order]
    columns = rows.columns
    rows = rows.withColumns({f"_o{k}": F.col(c.lstrip("-")) if isinstance(c, str) else c for k, c in enumerate(order)})
    by = [F.desc(f"_o{k}") if f else F.asc(f"_o{k}") for k, f in enumerate(falling)]
    each = F.coalesce(F.col(tokens) if isinstance(tokens, str) else tokens, F.lit(0))
    while True:
        path = shared_folder(spark, "budget-page")
        rows.orderBy(*by).limit(page).withColumn("_t", each).write.parquet(path)
        held = spark.read.parquet(path)
        n, sum_ = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("_t"), F.lit(0))).first()
        if n < page or sum_ > budget:
            break
        page *= 8
    w = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    some = held.filter("_t > 0").orderBy(*by).limit(budget + 1).withColumn("used", F.sum("_t").over(w))
    over = some.filter(F.col("used") > budget).orderBy("used").limit(1).collect()  # a row
    fits = some.filter(F.col("used") <= budget)
    free = held.filter("_t <= 0").withColumn("used", F.lit(None).cast("long"))
    if over:
        before, equal = F.lit(False), F.lit(True)
        for k, falls in enumerate(falling):
            x, at = F.col(f"_o{k}"), F.lit(over[0][f"_o{k}"])
            first = ((x > at) | (x.isNotNull() & at.isNull())) if falls else ((x < at) | (x.isNull() & at.isNotNull()))
            before = before | (equal & F.coalesce(first, F.lit(False)))
            equal = equal & x.eqNullSafe(at)
        free = free.filter(before)
    return fits.unionByName(free).select(*columns, "used")


def forced_cap(rows: DataFrame, forced: Column, most: int, order: list[Column]) -> DataFrame:
    """Forced rows always stay and use up the budget; others fill it in order.

    Only the first ``most`` of the others can stay, so no window sees more.
    """
    marked = rows.withColumn("forced", F.coalesce(forced, F.lit(False)))
    n = F.broadcast(marked.agg(F.count_if("forced").alias("n_forced")))  # one row
    page = marked.filter(~F.col("forced")).orderBy(*order).limit(most).withColumn("free", F.row_number().over(Window.orderBy(*order)))
    free = page.crossJoin(n).filter(F.col("free") <= F.lit(most) - F.col("n_forced")).drop("free", "n_forced")
    return marked.filter("forced").unionByName(free)


def first_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def keyset_page(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    return rows.filter(F.col(key) > after).orderBy(key).limit(size)


def stratified(rows: DataFrame, stratum: Column, quotas: dict[str, int], seed: int) -> DataFrame:
    """Quota rows of each stratum by a seeded hash, without replacement."""
    w = Window.partitionBy("stratum").orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id")
    quota = F.coalesce(*[F.when(F.col("stratum") == k, F.lit(v)) for k, v in quotas.items()], F.lit(0))
    return rows.withColumn("stratum", stratum).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= quota).drop("_rn")


def prioritised(channels: list[tuple[str, DataFrame]]) -> DataFrame:
    """(id, channel): ids of all channels, each under the first channel that has it."""
    every = None
    for k, (name, rows) in enumerate(channels):
        one = rows.select("id", F.struct(F.lit(k).alias("k"), F.lit(name).alias("name")).alias("c"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("id").agg(F.min("c").alias("c")).select("id", F.col("c.name").alias("channel"))


def percentiles(rows: DataFrame, key: str, value: str, points: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """(key, one column for each point): exact percentiles, interpolated at (n - 1) * p.

    A sketch bounds each point from both sides; rows below are only counted, and the values in
    between, some parts in ``accuracy``, are counted by value and ranked. So no task holds all
    values of a key, whatever its share of the rows. Null values are left out.
    """
    held = rows.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")).filter("_v is not null")
    slack = 3 / accuracy
    edge = lambda p: F.percentile_approx("_v", F.lit(min(1.0, max(0.0, p))), accuracy)
    bounds = held.groupBy(F.col("_k").alias("_kb")).agg(F.count(F.lit(1)).alias("_n"), *[edge(p + d * slack).alias(f"_{side}{k}") for k, p in enumerate(points.values()) for d, side in ((-1, "lo"), (1, "hi"))])
    # of few rows all are ranked: the sketch's slack would be less than a rank
    few = F.col("_n") <= 4 * accuracy
    wide = [F.when(few, x).otherwise(F.col(f"_{side}{k}")).alias(f"_{side}{k}") for k in range(len(points)) for side, x in (("lo", float("-inf")), ("hi", float("inf")))]
    met = held.join(bounds.select("_kb", "_n", *wide), F.col("_k").eqNullSafe(F.col("_kb"))).drop("_kb")
    below = met.groupBy(F.col("_k").alias("_kb")).agg(F.first("_n").alias("_n"), *[F.count_if(F.col("_v") < F.col(f"_lo{k}")).alias(f"_b{k}") for k in range(len(points))])
    inside = F.lit(False)
    for k in range(len(points)):
        inside = inside | F.col("_v").between(F.col(f"_lo{k}"), F.col(f"_hi{k}"))
    counted = met.filter(inside).groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_c"), *[F.first(f"_{side}{k}").alias(f"_{side}{k}") for k in range(len(points)) for side in ("lo", "hi")])
    ranked = counted.join(below, F.col("_k").eqNullSafe(F.col("_kb"))).drop("_kb")
    out = []
    for k, (name, p) in enumerate(points.items()):
        mine = F.col("_v").between(F.col(f"_lo{k}"), F.col(f"_hi{k}"))
        w = Window.partitionBy("_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        ranked = ranked.withColumn(f"_r{k}", F.col(f"_b{k}") + F.sum(F.when(mine, F.col("_c")).otherwise(0)).over(w))  # rows up to this value
        at = (F.col("_n") - 1) * p
        least = lambda pos: F.min(F.when(mine & (F.col(f"_r{k}") > pos), F.col("_v")))  # noqa: E731, B023
        low, high = least(F.floor(at)), least(F.ceil(at))
        out.append((low + (high - low) * F.first(at - F.floor(at))).alias(name))
    return ranked.groupBy("_k").agg(*out).withColumnRenamed("_k", key)


#: Pairs of one task of ``spread_join``, and the most rows of a block.
PAIRS, BLOCK = 20_000_000, 1 << 16


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, most: int = PAIRS) -> DataFrame:
    """The inner join on ``keys`` where few keys hold nearly all rows: a key's left rows are dealt by the column ``by``, its
    right ones by all theirs, to blocks of near equal sides, so that two blocks have some ``most`` pairs. A block is
    one row; each pair of blocks is a row of a task, which unpacks it. So what is copied grows with the pairs by a side's rows,
    not with the pairs by ``most`` times a key's right rows."""
    spark, own = left.sparkSession, lambda df: [c for c in df.columns if c not in keys]
    count = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    side = lambda mine, other: F.least(F.col(mine), F.lit(BLOCK), F.greatest(F.lit(most**0.5), F.lit(float(most)) / F.col(other)))
    parts = lambda mine, other: F.ceil(F.col(mine) / side(mine, other)).cast("int")
    path = shared_folder(spark, "spread-join")
    count(left, "_n").join(count(right, "_k"), keys).select(*keys, parts("_n", "_k").alias("_p"), parts("_k", "_n").alias("_q")).write.parquet(path)
    sizes = spark.read.parquet(path)
    tasks = max(1, min(10_000, sizes.agg(F.sum(F.col("_p").cast("long") * F.col("_q"))).first()[0] or 0))
    on = [*keys, "_p", "_q"]

    def blocks(df: DataFrame, dealt_by: list[str], mine: str, other: str, name: str) -> DataFrame:
        dealt = df.join(sizes, keys).withColumn(mine, F.pmod(F.xxhash64(*dealt_by), F.col(mine)).cast("int"))
        held = dealt.groupBy(*on).agg(F.collect_list(F.struct(*own(df))).alias(name))
        return held.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).repartition(tasks, *on)

    met = blocks(left, [by], "_p", "_q", "_l").join(blocks(right, own(right), "_q", "_p", "_r"), on)
    return met.select(*keys, F.inline("_l"), "_r").select(*keys, *own(left), F.inline("_r"))
