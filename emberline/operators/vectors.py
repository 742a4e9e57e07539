"""Vector search and similar pairs."""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import cosine
from ..session import shared_folder


def top_k(vectors: DataFrame, query: list[float], k: int, floor: float | None = None) -> DataFrame:
    """(id, sim): the k most similar; a bounded heap per task, no full sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select("id", F.round(cosine(F.col("vec"), q), 6).alias("sim"))
    return (scored if floor is None else scored.filter(F.col("sim") > floor)).orderBy(F.desc("sim"), "id").limit(k)


#: Rows that a pivot has in the mean, the fewest and most pivots, and rows of a slice.
NEAR, PIVOTS, MOST_PIVOTS, SLICE = 512, 64, 4096, 1024
UNIT_BLOCK = "name string, dim int, centre array<double>, radius double, least double"
#: Scores that are held at once, blocks whose scores give a query its first bound, and pairs of blocks a task when they are many.
TILE, FIRST, PAIRS = 1 << 18, 4, 32


def plain_rows(vectors: DataFrame) -> DataFrame:
    """id, vec in doubles; rows without id or vector, and empty vectors, are left out."""
    return vectors.select(F.col("id").cast("long").alias("id"), F.transform("vec", lambda x: x.cast("double")).alias("vec")).filter("id is not null and vec is not null and size(vec) > 0")


def unit_blocks(rows: DataFrame, block: int = 4096) -> DataFrame:
    """The list of stored blocks of ``plain_rows``: at most ``block`` near ones (by their nearest
    of some pivots) of equal length, as unit vectors; zero vectors stay zero.

    Pivots grow with the rows up to MOST_PIVOTS. Rows of a pivot are a cell: a run of a block, with its direction and greatest angle.
    A column ``bound`` is stored beside the vectors, its least value in the list.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, "unit-blocks")
    count, bound = rows.count(), F.col("bound").cast("double") if "bound" in rows.columns else F.lit(-2.0)
    pivots = unit_rows(rows.withColumn("o", F.xxhash64("id")).orderBy("o").limit(min(MOST_PIVOTS, max(PIVOTS, count // NEAR))).collect())  # MOST_PIVOTS rows
    if len(pivots):  # near pivots stand side by side
        of = pivots @ pivots[: math.isqrt(len(pivots))].T
        pivots = pivots[np.lexsort((of.max(1), of.argmax(1)))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            near = np.zeros(len(size), np.int32)
            mine = np.flatnonzero(size == pivots.shape[1]) if len(pivots) else near[:0]
            for at in range(0, len(mine), SLICE):
                some = mine[at : at + SLICE]
                v = pc.list_flatten(batch.column(1).take(pa.array(some))).to_numpy(zero_copy_only=False).reshape(len(some), -1)
                near[some] = (v @ pivots.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], names=["id", "vec", "bound", "near"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(size: int) -> pa.RecordBatch:
            ids, v, bounds, near = zip(*held.pop(size))
            v = np.array(v)
            norm = np.sqrt((v * v).sum(1))
            unit = v / np.where(norm == 0, 1, norm)[:, None]
            centre = unit.mean(0)
            cells = np.append(np.flatnonzero(np.diff(near, prepend=-1)), len(v))
            ways = np.array([x / (np.sqrt(x @ x) or 1) for x in (unit[i:j].mean(0) for i, j in zip(cells[:-1], cells[1:]))])
            wide = np.array([np.arccos(np.clip((unit[i:j] @ w).min(), -1, 1)) for i, j, w in zip(cells[:-1], cells[1:], ways)])
            out = io.BytesIO()
            np.savez(out, ids=np.array(ids, np.int64), unit=unit, bound=np.array(bounds), cells=cells, ways=ways, wide=wide)
            name = f"{folder}/blocks/{uuid.uuid4().hex}.npz"
            fs, path = pafs.FileSystem.from_uri(name)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path) as f:
                f.write(out.getvalue())
            radius = float(np.sqrt(((unit - centre) ** 2).sum(1)).max())
            row = {"name": name, "dim": size, "centre": centre.tolist(), "radius": radius, "least": min(bounds)}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("name", pa.string()), ("dim", pa.int32()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("least", pa.float64())]))

        for batch in batches:
            for i, v, low, near in zip(*(x.to_pylist() for x in batch.columns)):
                held.setdefault(len(v), []).append((i, v, low, near))
                if len(held[len(v)]) >= block:
                    yield flush(len(v))
        for size in list(held):
            yield flush(size)

    n = max(1, -(-count * 5 // (block * 4)))  # ranges are of about equal rows, so most are one block
    placed = rows.select("id", "vec", bound.alias("bound")).mapInArrow(place, "id long, vec array<double>, bound double, near int")
    dealt = placed.repartitionByRange(n, F.size("vec"), "near", F.xxhash64("id")).sortWithinPartitions(F.size("vec"), "near")
    dealt.mapInArrow(write, UNIT_BLOCK).write.parquet(f"{folder}/list")
    return spark.read.schema(UNIT_BLOCK).parquet(f"{folder}/list")


def unit_rows(rows: list) -> np.ndarray:
    """Unit vectors of those rows whose ``vec`` is as long as the first one's."""
    v = np.array([r.vec for r in rows if len(r.vec) == len(rows[0].vec)], float) if rows else np.zeros((0, 1))
    return v / np.maximum(np.sqrt((v * v).sum(1)), 1e-300)[:, None]


def near_blocks(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(name_a, name_b, apart) of blocks whose balls are near enough for a cosine of ``threshold``, or of the left one's least bound if that is more."""
    side = lambda blocks, x: blocks.select("dim", *[F.col(c).alias(f"{c}_{x}") for c in ("name", "centre", "radius", "least")])
    apart = F.sqrt(F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    least = F.greatest(F.lit(float(threshold)), "least_a")
    reach = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (least - 1e-6)))
    close = (least <= 0) | (apart <= F.col("radius_a") + F.col("radius_b") + reach + 1e-9)
    return side(left, "a").join(side(right, "b"), "dim").filter(close).select("name_a", "name_b", apart.alias("apart"))


def met(pairs: DataFrame, score, ddl: str) -> DataFrame:
    """``score(ids, unit, others, with_, same)`` of slices of each pair of blocks; it gives record batches."""

    def slices(one, other, same):
        for at in range(0, len(one["ids"]), SLICE):
            yield score(one["ids"][at : at + SLICE], one["unit"][at : at + SLICE], other["ids"], other["unit"], same)

    return whole(pairs, slices, ddl)


def whole(pairs: DataFrame, score, ddl: str) -> DataFrame:
    """The record batches that ``score(one, other, same)`` yields for each pair of stored blocks."""

    def read(name: str) -> dict[str, np.ndarray]:
        fs, path = pafs.FileSystem.from_uri(name)
        with fs.open_input_file(path) as f:
            return dict(np.load(io.BytesIO(f.read())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a = None, None
        for batch in batches:
            for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if one != last:
                    last, a = one, read(one)
                yield from score(a, a if one == two else read(two), one == two)

    count = pairs.count()
    n = max(1, min(count, max(256, count // PAIRS), 10_000))
    return pairs.select("name_a", "name_b").repartitionByRange(n, "name_a", "name_b").sortWithinPartitions("name_a", "name_b").mapInArrow(run, ddl)


def similar_pairs(vectors: DataFrame, threshold: float, block: int = 4096) -> DataFrame:
    """(a, b, sim) with a < b and cosine of at least ``threshold``, exact.

    Vectors are dealt to stored blocks of near ones. Only names, centres and radii are paired: a pair of
    blocks whose balls are farther apart than the threshold allows is dropped, each of the
    others is one task's work that reads two blocks and scores them by a matrix product.
    So no vector is copied and no pair is made that doesn't qualify; the work grows
    with the pairs of near blocks. Vectors of other lengths than a partner's don't meet it.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float64())])

    def score(ids, unit, others, with_, same):
        sim = np.round(unit @ with_.T, 6)
        keep = sim >= threshold
        if same:
            keep &= ids[:, None] < others[None, :]
        i, j = np.nonzero(keep)
        x, y = ids[i], others[j]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(sim[i, j])], schema=schema)

    blocks = unit_blocks(plain_rows(vectors), block)
    pairs = near_blocks(blocks, blocks, threshold).filter("name_a <= name_b")
    return met(pairs, score, "a long, b long, sim double").filter("a < b")


def best_of(q: np.ndarray, x: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's ``k`` best records by their best score, ties to the smaller id."""
    o = np.lexsort((-sim, x, q))
    q, x, sim = q[o], x[o], sim[o]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (x[1:] != x[:-1])
    q, x, sim = q[new], x[new], sim[new]
    o = np.lexsort((x, -sim, q))
    q, x, sim = q[o], x[o], sim[o]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], x[keep], sim[keep]


def segment_neighbours(records: DataFrame, queries: DataFrame, k: int, floor: float, block: int = 4096) -> DataFrame:
    """(query, rank, id, sim): each query record's ``k`` best other records by their best pair of segments.

    Records and queries are (id, segments: array of vectors); a pair's score is the greatest cosine of a segment of one
    with a segment of the other, over ``floor`` (0 or more). All queries ask at once, over stored blocks of near segments.
    First each block of queries meets the FIRST blocks nearest to it; the k-th best score found there is a bound that the
    query's results reach. Then all pairs of blocks meet that aren't too far apart for their queries' bounds; in a pair a query's segment
    meets the cells that its bound leaves, in single precision with a margin, and what may reach the bound is scored
    in double precision. Each query keeps its ``k`` best records of a pair of blocks. Equal scores go to the smaller id;
    segments of unequal lengths, zero segments and those that aren't finite don't meet.
    """
    schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("sim", pa.float64())])
    ddl = "query long, id long, sim double"
    rows = lambda df: plain_rows(df.select("id", F.explode("segments").alias("vec")))

    def scored(first: bool):
        def score(one, other, same):
            ids, unit, others, with_, cells = one["ids"], one["unit"], other["ids"], other["unit"], other["cells"]
            if not first:
                held = one.setdefault("angle", np.arccos(np.clip(np.maximum(one["bound"], floor) - 1e-9, -1, 1)))
                near = ~(np.arccos(np.clip(unit @ other["ways"].T, -1, 1)) > held[:, None] + other["wide"] + 1e-6)
            dim = unit.shape[1]
            low = (np.maximum(one["bound"], floor) - 1e-6 - (dim + 4) * 2.0**-23).astype(np.float32)
            for x in (one, other):
                if "single" not in x:
                    x["single"] = np.where(np.isfinite(x["unit"]).all(1)[:, None], x["unit"], 0).astype(np.float32)
            parts, size = [(ids[:0], ids[:0], np.zeros(0))], 0
            for c in range(1 if first else len(cells) - 1):
                start, end = (0, len(others)) if first else cells[c : c + 2]
                mine = np.arange(len(ids)) if first else np.flatnonzero(near[:, c])
                right, step = other["single"][start:end].T, max(1, TILE // (end - start))
                for at in range(0, len(mine), step):
                    some = mine[at : at + step]
                    sim, t = one["single"][some] @ right, low[some]
                    if first and end - start > 2 * k:  # any records give a bound
                        t = np.maximum(t, np.partition(sim, end - start - 2 * k, axis=1)[:, end - start - 2 * k])
                    hit = np.flatnonzero(sim.max(axis=1) >= t)
                    i, j = np.nonzero(sim[hit] >= t[hit, None])
                    i, j = some[hit[i]], j + start
                    exact = np.empty(len(i))
                    for of in range(0, len(i), max(1, TILE // dim)):
                        cut = slice(of, of + max(1, TILE // dim))
                        exact[cut] = np.round(np.einsum("ij,ij->i", unit[i[cut]], with_[j[cut]]), 9)
                    ok = (exact > floor) & (exact >= one["bound"][i]) & (ids[i] != others[j])
                    parts.append((ids[i[ok]], others[j[ok]], exact[ok]))
                    size += len(parts[-1][0])
                    if size > TILE:
                        parts, size = [best_of(*map(np.concatenate, zip(*parts)), k)], 0
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best_of(*map(np.concatenate, zip(*parts)), k)], schema=schema)

        return score

    def ranked(pairs: DataFrame, first: bool) -> DataFrame:
        found = whole(pairs, scored(first), ddl).groupBy("query", "id").agg(F.max("sim").alias("sim"))
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "id"))).filter(F.col("rank") <= k)

    def kept(df: DataFrame) -> DataFrame:
        folder = shared_folder(df.sparkSession, "segments")
        df.write.parquet(folder)
        return df.sparkSession.read.schema(df.schema).parquet(folder)

    stored, asked = unit_blocks(rows(records), block), kept(rows(queries))
    nearest = Window.partitionBy("name_a").orderBy("apart", "name_b")
    few = near_blocks(unit_blocks(asked, block), stored, floor).withColumn("o", F.row_number().over(nearest)).filter(F.col("o") <= FIRST)
    bounds = ranked(few, True).filter(F.col("rank") == k).select("query", F.col("sim").alias("bound"))
    bounded = kept(asked.join(bounds, F.col("id") == F.col("query"), "left").select("id", "vec", F.coalesce("bound", F.lit(-2.0)).alias("bound")))
    pairs = near_blocks(unit_blocks(bounded, 4 * block), stored, floor)  # fewer pairs, each reads a block
    return ranked(pairs, False).select("query", "rank", "id", F.round("sim", 6).alias("sim"))


def _by_length(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """Ids, lengths (-1: no vector) and places of a block's rows; by length their vectors, norms as ``cosine`` has them,
    unit vectors, rows with a null element, and rows whose norm is too odd for a product to stand for their cosine."""
    vec = table["vec"].combine_chunks()
    length, place, held = pc.fill_null(pc.list_value_length(vec), -1).to_numpy(zero_copy_only=False), np.zeros(len(vec), int), {}
    for size in np.unique(length[length >= 0]).tolist():
        mine = np.flatnonzero(length == size)
        place[mine] = np.arange(len(mine))
        flat = pc.list_flatten(vec.take(pa.array(mine)))
        gap = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(mine), size).any(1)
        v = np.where(gap[:, None], 0.0, flat.to_numpy(zero_copy_only=False).reshape(len(mine), size))
        norm = np.zeros(len(mine))
        for x in v.T:  # one after another, as there
            norm = norm + x * x
        norm = np.sqrt(norm)
        odd = ~((norm == 0) | ((norm > 1e-100) & (norm < 1e100)))
        unit = np.where(odd[:, None], 0.0, v) / np.where(odd | (norm == 0), 1, norm)[:, None]
        held[size] = (mine, v, norm, unit, gap, odd)
    return table["id"].to_numpy(), length, place, held


def _cosines(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``cosine`` of rows ``i`` of a block and ``j`` of another, in its order of additions, and which are null."""
    sim, null = np.zeros(len(i)), (a[1][i] < 0) | (b[1][j] < 0)
    for size, (_, v, norm, _, gap, _) in a[3].items():
        mine = np.flatnonzero((a[1][i] == size) & (b[1][j] == size))
        for at in range(0, len(mine), max(1, TILE // max(1, size))):
            some = mine[at : at + max(1, TILE // max(1, size))]
            x, y = a[2][i[some]], b[2][j[some]]
            _, w, other, _, hole, _ = b[3][size]
            dot, product = np.zeros(len(some)), norm[x] * other[y]
            for p, q in zip(v[x].T, w[y].T):
                dot = dot + p * q
            sim[some] = np.where(product == 0, 0.0, dot / np.where(product == 0, 1, product))
            null[some] = gap[x] | hole[y]
    return sim, null


def cluster_neighbours(rows: DataFrame, seeds: DataFrame, k: int, block: int = 8192) -> DataFrame:
    """(source, target, sim, rn): the ``k`` other rows of its cluster that are most like each seed, by ``cosine`` rounded at six digits.

    Rows and seeds are (id, vec, cluster). A cluster's rows are dealt to blocks, its seeds to blocks of half the size; a pair of blocks is one
    matrix product. In it a seed's ``k`` best, with a margin for the rounding, are scored again as ``cosine`` does, so equal ones
    are found and go to the smaller id. A pair of blocks hands on ``k`` rows a seed; NaN comes first and null last.
    """
    schema = pa.schema([("source", pa.int64()), ("target", pa.int64()), ("sim", pa.float64())])
    key, count = ["cluster", "_p", "_q"], lambda df, n: df.groupBy("cluster").agg(F.count(F.lit(1)).alias(n))
    folder = shared_folder(rows.sparkSession, "cluster-blocks")
    parts = [F.ceil(F.col(n) / size).cast("int").alias(x) for n, size, x in (("_n", block, "_p"), ("_k", max(1, block // 2), "_q"))]
    count(rows, "_n").join(count(seeds, "_k"), "cluster").select("cluster", *parts).write.parquet(folder)
    sizes = rows.sparkSession.read.parquet(folder)
    tasks = max(1, min(10_000, sizes.agg(F.sum(F.col("_p").cast("long") * F.col("_q"))).first()[0] or 0))

    def dealt(df: DataFrame, mine: str, other: str) -> DataFrame:
        at = {mine: F.pmod(F.xxhash64("id"), F.col(mine)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))}
        met = df.select(F.col("id").cast("long").alias("id"), F.col("vec").alias("vec"), F.col("cluster").alias("cluster")).join(sizes, "cluster")
        return met.withColumn(mine, at[mine]).withColumn(other, at[other]).repartition(tasks, *key).groupBy(*key)

    def half_up(x: np.ndarray) -> np.ndarray:
        some, back = np.unique(x, return_inverse=True)
        return np.array([float(Decimal(repr(y)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) if math.isfinite(y) else y for y in some.tolist()])[back]

    def score(asked: pa.Table, stored: pa.Table) -> pa.Table:
        if not len(asked) or not len(stored):
            return schema.empty_table()
        parts = []
        with np.errstate(all="ignore"):
            b = _by_length(stored)
            for at in range(0, len(asked), max(1, 4 * TILE // len(stored))):
                a = _by_length(asked.slice(at, max(1, 4 * TILE // len(stored))))
                near, odd = np.zeros((len(a[0]), len(b[0]))), np.zeros((len(a[0]), len(b[0])), bool)  # unequal lengths: 0
                near[a[1] < 0] = near[:, b[1] < 0] = -np.inf
                for size in a[3].keys() & b[3].keys():
                    (x, _, _, u, gap, strange), (y, _, _, w, hole, weird) = a[3][size], b[3][size]
                    lost, product = gap[:, None] | hole, u @ w.T
                    near[np.ix_(x, y)] = np.where(lost, -np.inf, product)
                    odd[np.ix_(x, y)] = ~lost & (strange[:, None] | weird)
                near[(a[0][:, None] == b[0]) | odd] = -np.inf
                low = np.partition(near, len(b[0]) - k, axis=1)[:, len(b[0]) - k] if len(b[0]) > k else np.full(len(a[0]), -np.inf)
                i, j = np.nonzero((near >= low[:, None] - 1.001e-6) | odd)
                other = a[0][i] != b[0][j]
                i, j = i[other], j[other]
                sim, null = _cosines(a, b, i, j)
                told = half_up(np.where(null, 0, sim))
                o = np.lexsort((b[0][j], -told, ~np.isnan(told), null, i))
                o = o[np.arange(len(o)) - np.searchsorted(i[o], i[o]) < k]
                parts.append(pa.table([pa.array(a[0][i[o]]), pa.array(b[0][j[o]]), pa.array(sim[o], mask=null[o])], schema=schema))
        return pa.concat_tables(parts)

    found = dealt(seeds, "_q", "_p").cogroup(dealt(rows, "_p", "_q")).applyInArrow(score, "source long, target long, sim double")
    best = Window.partitionBy("source").orderBy(F.desc("sim"), "target")
    return found.withColumn("sim", F.round("sim", 6)).withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k)
