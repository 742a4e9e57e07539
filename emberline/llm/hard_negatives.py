"""Hard negatives by a Voronoi-partitioned nearest-neighbour join.

The largest inner products become smallest distances: with M the largest norm, a row x is
augmented to x' = (x, sqrt(M^2 - |x|^2)) and an anchor q to q' = (q, 0), so that

    |q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>.

Every row belongs to the cell of its nearest pivot. Rows are dealt by range of (length, label, cell,
distance to the pivot) into stored blocks; a segment (the rows of a block that share label and
cell) is known by the least and largest distance to its pivot. Queries, too, are stored in
groups, and a group knows its least and largest distance to every pivot. A query wants
its k best scores between two limits, so by the triangle inequality a segment with distances near
to far can serve a group with lo to hi only if

    max(0, lo - far, near - hi) <= outer   and   hi + far >= inner,

where outer is the distance of the worst score that the group still takes and inner that
of the best it may take. These bounds are compared per cell first, then per segment; only names of
blocks are replicated to the groups that they might serve, vectors never. A first round
meets each group with its nearest block alone, to raise the scores that count; the second
round meets it with all that is left. A task walks a group through some blocks, nearest first, checks the bounds
again per query with the k-th scores so far, cuts each segment to the distances that can matter,
and scores what is left by matrix products in the narrowest type that is exact.
"""

from __future__ import annotations

import io
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import AtomicFile, claim, open_fs, persist, prepare, read_table, shared_dir

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
#: A negative's score in hundredths of the positive's; relabelled are ids that RELABEL divides.
LOW, HIGH, RELABEL, LABELS = 50, 95, 7, 10
#: Rows of a block, queries of a group, blocks of a task, rows scored at once.
BLOCK, GROUP, FILES, SLICE = 4096, 512, 8, 1024
#: Pivots at most, and their bytes (every task holds them); below that they grow with the root of the rows.
PIVOTS, PIVOT_BYTES = 1024, 4 << 20
NONE, ANY = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass
class Space:
    """The largest squared norm, and the augmented pivots by vector length."""

    most: int
    pivots: dict[int, np.ndarray] = field(default_factory=dict)

    def rows(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))])

    def place(self, points: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot); cell -1 for lengths without pivots."""
        p = self.pivots.get(dim)
        if p is None:
            return np.full(len(points), -1, np.int32), np.zeros(len(points))
        cell = ((p * p).sum(axis=1)[None] - 2 * (points @ p.T)).argmin(axis=1)
        return cell.astype(np.int32), np.sqrt(((points - p[cell]) ** 2).sum(axis=1))

    def reach(self, square: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which a query of squared norm ``square`` has ``score``."""
        return np.where(score == NONE, np.inf, np.sqrt(np.maximum(square + self.most - 2.0 * score, 0)))

    def slack(self, square: np.ndarray) -> np.ndarray:
        """More than the rounding of any distance at hand."""
        return 1e-6 * (np.sqrt(square) + np.sqrt(self.most)) + 1e-6


def by_length(column: pa.Array):
    """(rows, matrix) of each length in a list column."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    at, values = np.cumsum(size) - size, column.flatten().to_numpy(zero_copy_only=False)
    for dim in np.unique(size).tolist():
        own = np.flatnonzero(size == dim)
        yield own, values[at[own][:, None] + np.arange(dim)].astype(np.int64, copy=False)


def narrow(x: np.ndarray) -> np.ndarray:
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def store(name: str, **arrays) -> None:
    out = io.BytesIO()
    np.savez(out, **arrays)
    file = AtomicFile(name)
    file.write(out.getvalue())
    file.close()


def load(name: str) -> dict[str, np.ndarray]:
    fs, path = open_fs(name)
    with fs.open_input_file(path) as f:
        data = np.load(io.BytesIO(f.read()))
    return {k: data[k] for k in data.files}


def runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches over which all columns stay the same."""
    n = len(columns[0])
    change = np.zeros(max(0, n - 1), bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    edge = [0, *(np.flatnonzero(change) + 1).tolist(), n]
    return [(a, b) for a, b in zip(edge, edge[1:]) if b > a]


def whole_rows(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """uid, vec_id, label, q: floor(scale * component) as long; rows without id, label
    or vector, or with a null or non-finite component, are left out."""
    x = F.col("embedding")
    ok = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(ok, F.lit(False))).select(
        F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("q"),
    )


def space_of(rows: DataFrame, pivots: int = PIVOTS) -> Space:
    """Bounds and pivots: rows of least hash, about half the root of the row count, at most ``pivots``."""
    square = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x * x)
    n, most, longest = rows.agg(F.count(F.lit(1)), F.max(square), F.max(F.size("q"))).first()
    room = min(pivots, int(np.sqrt(n) / 2) + 1, PIVOT_BYTES // (8 * ((longest or 0) + 1)) + 1)
    some = rows.orderBy(F.xxhash64("uid"), "uid").limit(room).select("q").collect()  # at most PIVOTS rows
    out = Space(most or 0)
    for dim in {len(r.q) for r in some}:
        own = [r.q for r in some if len(r.q) == dim]
        out.pivots[dim] = np.unique(out.rows(np.array(own, np.int64).reshape(len(own), dim)), axis=0)
    return out


PLACED = [("dim", pa.int32()), ("cell", pa.int32()), ("dist", pa.float64())]
SEGMENT = pa.schema([("file", pa.string()), ("dim", pa.int32()), ("label", pa.int64()), ("cell", pa.int32()), ("near", pa.float64()), ("far", pa.float64())])
REACH = pa.schema([("group", pa.string()), ("dim", pa.int32()), ("label", pa.int64()), ("cell", pa.int32()), *[(n, pa.float64()) for n in ("lo", "hi", "outer", "inner")]])


def ddl(schema: pa.Schema) -> str:
    kind = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.float64(): "double"}
    return ", ".join(f"`{f.name}` {kind.get(f.type, 'array<long>')}" for f in schema)


def placed(rows: DataFrame, space: Space, asks: bool) -> DataFrame:
    """Rows with dim, cell and dist; ``q`` is the last column. Queries have no augmented component."""
    fields = [f for f in rows.columns if f != "q"]
    schema = pa.schema([*[(f, pa.int64()) for f in fields], ("q", pa.list_(pa.int64())), *PLACED])

    def run(batches):
        claim()
        for batch in batches:
            n = batch.num_rows
            dim, cell, dist = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n)
            for own, x in by_length(batch.column(len(fields))):
                points = np.column_stack([x.astype(np.float64), np.zeros(len(x))]) if asks else space.rows(x)
                dim[own] = x.shape[1]
                cell[own], dist[own] = space.place(points, x.shape[1])
            yield pa.RecordBatch.from_arrays([*[c.cast(t) for c, t in zip(batch.columns, schema.types)], pa.array(dim), pa.array(cell), pa.array(dist)], schema=schema)

    return rows.select(*fields, "q").mapInArrow(run, ddl(schema))


def in_files(rows: DataFrame, size: int, folder: str, order: list[str], schema: pa.Schema, write) -> DataFrame:
    """Deal rows by range of ``order`` into stretches of at most ``size`` rows of one length;
    ``write(name, dim, columns, x)`` stores each and gives the rows that describe it."""
    dealt = rows.repartitionByRange(max(1, -(-rows.count() // size)), *order).sortWithinPartitions(*order)
    where = {c: k for k, c in enumerate(rows.columns)}
    names = [c for c in where if c != "q"]

    def run(batches):
        claim()
        held, n, part = [], 0, TaskContext.get()

        def flush():
            nonlocal held, n
            columns = {c: np.concatenate([h[0][c] for h in held]) for c in names}
            x = np.concatenate([h[1] for h in held])
            name = f"{folder}/{part.partitionId():06d}-{n:05d}-{part.taskAttemptId()}.npz"
            held, n = [], n + 1
            return pa.RecordBatch.from_pylist(write(name, x.shape[1], columns, x), schema=schema)

        for batch in batches:
            for own, x in by_length(batch.column(where["q"])):  # ascending lengths, as the rows are
                columns = {c: batch.column(where[c]).to_numpy(zero_copy_only=False)[own] for c in names}
                if held and held[0][1].shape[1] != x.shape[1]:
                    yield flush()
                start = 0
                while start < len(x):
                    end = min(len(x), start + size - sum(len(h[1]) for h in held))
                    held.append(({c: v[start:end] for c, v in columns.items()}, narrow(x[start:end])))
                    start = end
                    if sum(len(h[1]) for h in held) >= size:
                        yield flush()
        if held:
            yield flush()

    return persist(dealt.mapInArrow(run, ddl(schema)), "voronoi-list")


def write_blocks(rows: DataFrame, space: Space, folder: str, size: int = BLOCK) -> DataFrame:
    """The segments of the stored blocks."""

    def write(name, dim, c, x):
        store(name, vec_id=c["vec_id"], uid=c["uid"], label=c["label"], cell=c["cell"], dist=c["dist"], x=x)
        far = lambda a, b: float(c["dist"][b - 1]) if c["cell"][a] >= 0 else float("inf")
        return [{"file": name, "dim": dim, "label": int(c["label"][a]), "cell": int(c["cell"][a]), "near": float(c["dist"][a]), "far": far(a, b)} for a, b in runs(c["label"], c["cell"])]

    return in_files(placed(rows.select("vec_id", "uid", "label", "q"), space, False), size, folder, ["dim", "label", "cell", "dist", "uid"], SEGMENT, write)


def write_groups(queries: DataFrame, space: Space, folder: str, same: bool, size: int = GROUP) -> DataFrame:
    """What each group of queries can be served by: a row per cell, and per label where partners share it."""

    def write(name, dim, c, x):
        store(name, **{k: c[k] for k in ("uid", "part", "label", "low", "high")}, x=x)
        points = np.column_stack([x.astype(np.float64), np.zeros(len(x))])
        square = (points * points).sum(axis=1)
        outer, inner = space.reach(square, c["low"]) + space.slack(square), space.reach(square, c["high"]) - space.slack(square)
        pivots = space.pivots.get(dim)
        d = np.zeros((len(x), 1)) if pivots is None else np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in pivots], axis=1)
        cells = [-1] if pivots is None else range(len(pivots))
        out = []
        for label in np.unique(c["label"]).tolist() if same else [None]:
            own = c["label"] == label if same else np.ones(len(x), bool)
            lo, hi, far, near = d[own].min(axis=0), d[own].max(axis=0), float(outer[own].max()), float(inner[own].min())
            # of partners with other labels, a group of one label names it
            tag = label if same else int(c["label"][0]) if (c["label"] == c["label"][0]).all() else None
            out += [{"group": name, "dim": dim, "label": tag, "cell": cell, "lo": float(a), "hi": float(b), "outer": far, "inner": near} for cell, a, b in zip(cells, lo, hi)]
        return out

    first = ["dim", "label", "cell"] if same else ["dim", "cell", "label"]
    return in_files(placed(queries.select("uid", "part", "label", "low", "high", "q"), space, True), size, folder, [*first, "dist", "uid", "part"], REACH, write)


def might_serve(groups: DataFrame, segments: DataFrame, same: bool) -> DataFrame:
    """group, label, file, bound, lo: blocks with a segment that the bounds leave to a group."""
    keys = ["dim", "label", "cell"] if same else ["dim", "cell"]
    s = segments if same else segments.withColumnRenamed("label", "other")
    bound = F.greatest(F.lit(0.0), F.col("lo") - F.col("far"), F.col("near") - F.col("hi"))
    ok = (bound <= F.col("outer")) & (F.col("hi") + F.col("far") >= F.col("inner"))
    cells = s.groupBy(*keys).agg(F.min("near").alias("near"), F.max("far").alias("far"))
    left = groups.join(cells, keys).filter(ok).drop("near", "far")
    pairs = left.join(s, keys).filter(ok)
    if not same:
        pairs = pairs.filter(F.col("label").isNull() | (F.col("label") != F.col("other")))
    return pairs.groupBy("group", "label", "file").agg(F.min(bound).alias("bound"), F.min("lo").alias("lo"))


class Best:
    """The k best of each query, ties to the smaller vec_id; ``floor`` is what a score must reach."""

    def __init__(self, low: np.ndarray, k: int):
        self.k, self.low, self.floor = k, low, low.copy()
        self.score = np.full((len(low), k), NONE)
        self.id = np.zeros((len(low), k), np.int64)

    def offer(self, who: np.ndarray, s: np.ndarray, ok: np.ndarray, ids: np.ndarray) -> None:
        """Scores ``s`` of queries ``who`` with candidates ``ids``, where ``ok``."""
        crowded = ok.sum(axis=1) > self.k
        if crowded.any():  # what is below a row's own k-th best can't be among its k best
            masked = np.where(ok[crowded], s[crowded], -np.inf if s.dtype.kind == "f" else NONE)
            kth = np.partition(masked, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
            ok[crowded] &= s[crowded] >= kth[:, None]
        row, col = np.nonzero(ok)
        if not len(row):
            return
        rows = np.unique(row)
        at = np.concatenate([np.repeat(rows, self.k), row])
        score = np.concatenate([self.score[who[rows]].ravel(), s[row, col].astype(np.int64)])
        ids = np.concatenate([self.id[who[rows]].ravel(), ids[col]])
        order = np.lexsort((ids, ~score, at))
        at, score, ids = at[order], score[order], ids[order]
        first = np.arange(len(at)) - np.searchsorted(at, at) < self.k
        self.score[who[rows]], self.id[who[rows]] = score[first].reshape(-1, self.k), ids[first].reshape(-1, self.k)
        self.floor[who[rows]] = np.maximum(self.low[who[rows]], self.score[who[rows], -1])


def distances(group: dict, space: Space) -> np.ndarray:
    """Of each query to each pivot of its length; queries of one anchor stand together and share theirs."""
    if "d" not in group:
        x, pivots = group["x"], space.pivots.get(group["x"].shape[1])
        first = np.concatenate([[True], group["uid"][1:] != group["uid"][:-1]])
        points = np.column_stack([x[first].astype(np.float64), np.zeros(int(first.sum()))])
        d = np.zeros((len(points), 1)) if pivots is None else np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in pivots], axis=1)
        group["d"], group["square"] = d[np.cumsum(first) - 1], (x.astype(np.float64) ** 2).sum(axis=1)
    return group["d"]


def meet(group: dict, block: dict, best: Best, space: Space, same: bool) -> int:
    """Walk a group through a block; the number of scores that were computed."""
    x, y = group["x"], block["x"]
    most = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * max(1, x.shape[1])
    if most >= 1 << 63:
        raise ValueError("scores are beyond 64 bits")
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    d = distances(group, space)
    slack = space.slack(group["square"])
    inner = space.reach(group["square"], group["high"]) - slack
    outer = space.reach(group["square"], best.floor) + slack
    # all segments of the block at once: which queries might one serve?
    edge = np.array(runs(block["label"], block["cell"])).reshape(-1, 2)
    label, cell = block["label"][edge[:, 0]], block["cell"][edge[:, 0]]
    near, far = block["dist"][edge[:, 0]], np.where(cell >= 0, block["dist"][edge[:, 1] - 1], np.inf)
    at = d[:, np.maximum(cell, 0)]
    serves = ((group["label"][:, None] == label[None]) == same) & (at - far <= outer[:, None]) & (near - at <= outer[:, None]) & (at + far >= inner[:, None])
    rows = np.flatnonzero(np.repeat(serves.any(axis=0), edge[:, 1] - edge[:, 0]))
    segment = np.repeat(np.arange(len(edge)), edge[:, 1] - edge[:, 0])
    scored = 0
    for i in range(0, len(rows), SLICE):
        own = rows[i : i + SLICE]
        outer = space.reach(group["square"], best.floor) + slack  # lower with each slice
        alive = serves[:, segment[own]]
        bounded = block["cell"][own] >= 0
        alive &= (np.abs(d[:, np.maximum(block["cell"][own], 0)] - block["dist"][own]) <= outer[:, None]) | ~bounded
        own, alive = own[alive.any(axis=0)], alive[:, alive.any(axis=0)]
        who = np.flatnonzero(alive.any(axis=1))
        if not len(own):
            continue
        anchor = np.concatenate([[True], group["uid"][who][1:] != group["uid"][who][:-1]])
        s = (x[who[anchor]].astype(kind) @ y[own].astype(kind).T)[np.cumsum(anchor) - 1]
        scored += s.size
        ok = alive[who] & (s >= best.floor[who].astype(kind)[:, None]) & (s <= group["high"][who].astype(kind)[:, None])
        ok &= group["uid"][who][:, None] != block["uid"][None, own]
        best.offer(who, s, ok, block["vec_id"][own])
    return scored


def met(pairs: DataFrame, space: Space, k: int, same: bool, files: int = FILES) -> DataFrame:
    """uid, part, vec_id, score: per task, each query's k best of the task's blocks."""
    once = pairs.groupBy("group", "file").agg(F.min("bound").alias("bound"), F.min("lo").alias("lo"))
    place = F.row_number().over(Window.partitionBy("group").orderBy("bound", "lo", "file")) - 1
    work = once.withColumn("chunk", F.floor(place / files)).groupBy("group", "chunk").agg(F.sort_array(F.collect_list(F.struct("bound", "lo", "file"))).alias("files"))
    work = persist(work.select("group", "chunk", F.transform("files", lambda f: f["file"]).alias("files")), "voronoi-pairs")
    out = pa.schema([("uid", pa.int64()), ("part", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        claim()
        for batch in batches:
            for name, names in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                group = load(name)
                best = Best(group["low"], k)
                for file in names:
                    meet(group, load(file), best, space, same)
                row, col = np.nonzero(best.score != NONE)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (group["uid"][row], group["part"][row], best.id[row, col], best.score[row, col])], schema=out)

    return work.repartition(max(1, min(work.count(), 100_000)), "group", "chunk").mapInArrow(run, ddl(out))


def nearest(queries: DataFrame, segments: DataFrame, space: Space, folder: str, k: int, same: bool, group: int = GROUP) -> DataFrame:
    """uid, part, rank, vec_id, score: each query's k best scores from low to high among the
    rows of its label (``same``) or of all others, itself left out."""
    first = might_serve(write_groups(queries, space, f"{folder}/first", same, group), segments, same)
    home = first.groupBy("group", "label").agg(F.min_by(F.struct("file", "bound", "lo"), F.struct("bound", "lo", "file")).alias("f")).select("group", "label", "f.*")
    kth = met(home, space, k, same).groupBy("uid", "part").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k).drop("n")
    raised = persist(queries.join(kth, ["uid", "part"], "left").withColumn("low", F.greatest("low", "kth")).drop("kth"), "voronoi-queries")
    pairs = might_serve(write_groups(raised, space, f"{folder}/second", same, group), segments, same)
    order = Window.partitionBy("uid", "part").orderBy(F.desc("score"), "vec_id")
    return met(pairs, space, k, same).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("uid", "part", "rank", "vec_id", "score")


def hard_negatives(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, pivots: int = PIVOTS, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` is (uid, vec_id, label, q) as of ``whole_rows``, stored or otherwise stable. Anchors are
    rows whose vec_id ``every`` divides; positives the best other rows of the label; negatives the best
    rows of other labels with low% to high% of the positive's score, so none where that is
    negative. Ties go to the smaller vec_id, rows of a repeated vec_id are rows of their own, vectors of
    another length than the anchor's (empty ones too) never meet it. An anchor without positives, a positive without
    negatives and an empty table give no rows. Products or norms beyond 64 bits raise an error.
    """
    spark = rows.sparkSession
    prepare(spark)
    folder = shared_dir(spark, "voronoi")
    space = space_of(rows, pivots)
    segments = write_blocks(rows, space, f"{folder}/blocks", block)
    anchors = rows.filter(F.col("vec_id") % every == 0)
    asked = anchors.select("uid", F.lit(0).cast("long").alias("part"), "label", "q", F.lit(NONE).cast("long").alias("low"), F.lit(ANY).cast("long").alias("high"))
    best = persist(nearest(asked, segments, space, f"{folder}/positives", positives, True, group), "voronoi-positives")
    best = best.select("uid", F.col("rank").cast("long").alias("part"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # hundredths of a score, rounded up or down, without leaving 64 bits
    share = lambda part, up: F.expr(f"{part} * (positive_score div 100) + ({part} * (positive_score % 100) + {up}) div 100")
    limits = best.filter("positive_score >= 0").select("uid", "part", share(low, 99).alias("low"), share(high, 0).alias("high"))
    wanted = persist(limits.filter("low <= high").join(anchors.select("uid", "label", "q"), "uid").select("uid", "part", "label", "q", "low", "high"), "voronoi-wanted")
    worst = nearest(wanted, segments, space, f"{folder}/negatives", negatives, False, group)
    named = anchors.select("uid", F.col("vec_id").alias("anchor_id")).join(best, "uid")
    return named.join(worst, ["uid", "part"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of all anchors of ``embeddings``; every seventh row has the next label."""
    rows = whole_rows(read_table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % RELABEL == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return hard_negatives(persist(rows.withColumn("label", moved), "voronoi-rows"))


OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % {RELABEL} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.uid, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    coalesce(CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT), 0) AS score
  FROM v a JOIN v b ON a.uid <> b.uid AND len(a.q) = len(b.q)
  WHERE a.vec_id % {EVERY} = 0
), p AS (
  SELECT uid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS place
  FROM s WHERE same QUALIFY place <= {POSITIVES}
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.uid, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.uid = p.uid AND NOT s.same AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
QUALIFY rank <= {NEGATIVES}
"""
