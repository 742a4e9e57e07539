"""Exact top-k inner-product search with two cover trees.

Vectors and queries are dealt to blocks of near ones (by their nearest of some
pivots) and each block is stored once with its cover tree. The tree comes from a
farthest-first traversal of the block: the net of level l are the centres that
were farther than 2**l from all before them, so centres of a level are separated,
every centre is within 2**(l + 1) of its parent, and a centre is its own child
one level below. Nodes keep the exact covering radius of their points.

Bounds of the roots come first: a query block meets its best data block alone, and then
only those whose bound reaches its worst k-th score. A task takes a query block and some
data blocks, best bound first, and walks each pair of trees together: for query node Q and data node X,

    max <q, x>  <=  <cq, cx> + |cq| rx + |cx| rq + rq rx,

and a pair of nodes is dropped when that is below the worst k-th score of the
queries in Q; the k-th scores are carried from block to block. Whichever node has
the larger radius is opened next. Leaves are scored by matrix products in the
narrowest type that is exact for the magnitudes at hand.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import AtomicFile, claim, open_fs, persist, prepare, read_table, shared_dir

#: Vectors of a data block and of a query block; points of a leaf in the mean; data blocks of a task.
DATA_BLOCK, QUERY_BLOCK, LEAF, CHUNK = 8192, 1024, 96, 4
#: Points scored at once; pivots that place vectors in blocks.
SLICE, PIVOTS = 1024, 64
SCALE, K, EVERY = 64, 20, 20
NONE = np.iinfo(np.int64).min


class Tree:
    """Points in tree order, and nodes as arrays: node 0 is the root, the children
    of node i are first[i] to first[i] + count[i], its points start[i] to end[i]."""

    FIELDS = ("ids", "uids", "x", "centre", "radius", "start", "end", "first", "count")

    def __init__(self, **fields):
        for name in self.FIELDS:
            setattr(self, name, fields[name])
        self.point = self.x.astype(np.float64)
        self.c = self.point[self.centre]
        self.norm = np.sqrt((self.c * self.c).sum(axis=1))
        self.most = float(np.abs(self.point).max(initial=0.0))

    def __len__(self) -> int:
        return len(self.ids)

    def stored(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.FIELDS})
        return out.getvalue()

    def children(self, i: int) -> np.ndarray:
        return np.arange(self.first[i], self.first[i] + self.count[i])


def build(ids: np.ndarray, uids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> Tree:
    """The cover tree of integer vectors ``x``; equal vectors share a leaf."""
    p = x.astype(np.float64)
    most = max(1, len(p) // leaf)
    centres, inserted = [0], [np.inf]
    near, which = np.sqrt(((p - p[0]) ** 2).sum(axis=1)), np.zeros(len(p), np.int64)
    while len(centres) < most and near.max() > 0:
        far = int(near.argmax())
        inserted.append(float(near[far]))
        d = np.sqrt(((p - p[far]) ** 2).sum(axis=1))
        closer = d < near
        near[closer], which[closer] = d[closer], len(centres)
        centres.append(far)
    # levels, highest first: centres that come in at each, and their parents among those before
    level = np.array([1 << 30, *np.floor(np.log2(inserted[1:])).astype(int)]) if len(centres) > 1 else np.array([1 << 30])
    parent = np.zeros(len(centres), np.int64)
    cp = p[centres]
    steps = sorted(set(level[1:].tolist()), reverse=True)
    for at in steps:
        new = np.flatnonzero(level == at)
        held = cp[: new[0]]
        far = ((cp[new][:, None, :] - held[None]) ** 2).sum(axis=2) if len(new) * len(held) * cp.shape[1] < 1 << 22 else np.stack([((c - held) ** 2).sum(axis=1) for c in cp[new]])
        parent[new] = far.argmin(axis=1)
    cell = np.argsort(which, kind="stable")
    cells = np.split(cell, np.cumsum(np.bincount(which, minlength=len(centres)))[:-1])
    order, nodes = [], {"centre": [0], "radius": [0.0], "start": [0], "end": [0], "first": [0], "count": [0]}
    placed = 0
    position = np.empty(len(p), np.int64)

    def fill(node: int, c: int, depth: int) -> None:
        """Node of centre ``c`` over the levels from ``steps[depth]`` down."""
        nonlocal placed
        start = placed
        kids: list[int] = []
        while depth < len(steps) and not kids:
            kids = np.flatnonzero((level == steps[depth]) & (parent == c)).tolist()
            depth += 1
        if kids:
            kids = [c, *[k for k in kids if k != c]]
            first = len(nodes["centre"])
            nodes["first"][node], nodes["count"][node] = first, len(kids)
            for name in nodes:
                nodes[name] += [0] * len(kids)
            for n, kid in enumerate(kids):
                fill(first + n, kid, depth)
        else:
            own = cells[c]
            order.append(own)
            position[own] = np.arange(placed, placed + len(own))
            placed += len(own)
        inside = np.concatenate(order)[start:placed] if kids else cells[c]
        nodes["centre"][node], nodes["start"][node], nodes["end"][node] = centres[c], start, placed
        nodes["radius"][node] = float(np.sqrt(((p[inside] - cp[c]) ** 2).sum(axis=1).max()))

    fill(0, 0, 0)
    by = np.concatenate(order)
    return Tree(
        ids=ids[by], uids=uids[by], x=x[by], centre=position[np.array(nodes["centre"])], radius=np.array(nodes["radius"]),
        start=np.array(nodes["start"]), end=np.array(nodes["end"]), first=np.array(nodes["first"]), count=np.array(nodes["count"]),
    )


class Search:
    """The k best of a query block over the data blocks that it is walked with.

    A point with the query's own uid is left out; equal scores go to the smaller
    vec_id. Scores below ``floor`` are known not to count. ``pruned`` counts dropped pairs of nodes, by (query inner, data inner).
    """

    def __init__(self, queries: Tree, k: int = K, floor: int = NONE):
        self.q, self.k, self.floor = queries, k, floor
        self.score = np.full((len(queries), k), NONE)
        self.id = np.zeros((len(queries), k), np.int64)
        self.pruned: dict[tuple[bool, bool], int] = {}

    def bounds(self, a: int, t: Tree, nodes) -> np.ndarray:
        """Upper bounds of the products of query node ``a`` with data nodes, rounding included."""
        q = self.q
        size = (q.norm[a] + q.radius[a]) * (t.norm[nodes] + t.radius[nodes])
        return t.c[nodes] @ q.c[a] + q.norm[a] * t.radius[nodes] + t.norm[nodes] * q.radius[a] + q.radius[a] * t.radius[nodes] + 1e-9 * size + 0.5

    def worst(self, a: int) -> int:
        return max(self.floor, int(self.score[self.q.start[a] : self.q.end[a], -1].min()))

    def with_block(self, t: Tree) -> None:
        most = self.q.most * t.most * max(1, t.x.shape[1])
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        if most >= 1 << 63:
            raise ValueError("scores are beyond 64 bits")
        left, right = self.q.x.astype(kind), t.x.astype(kind)

        def walk(a: int, b: int, bound: float) -> None:
            inner = bool(self.q.count[a]), bool(t.count[b])
            if bound < self.worst(a):
                self.pruned[inner] = self.pruned.get(inner, 0) + 1
            elif inner[0] and (not inner[1] or self.q.radius[a] >= t.radius[b]):
                for child in self.q.children(a).tolist():
                    walk(child, b, float(self.bounds(child, t, [b])[0]))
            elif inner[1]:
                kids = t.children(b)
                found = self.bounds(a, t, kids)
                for n in np.argsort(-found, kind="stable").tolist():
                    walk(a, int(kids[n]), float(found[n]))
            else:
                for i in range(self.q.start[a], self.q.end[a], SLICE):
                    for j in range(t.start[b], t.end[b], SLICE):  # a leaf of equal points may be long
                        self._score(left, right, t, i, min(i + SLICE, self.q.end[a]), j, min(j + SLICE, t.end[b]))

        walk(0, 0, float(self.bounds(0, t, [0])[0]))

    def _score(self, left, right, t: Tree, i: int, end: int, j: int, stop: int) -> None:
        s = left[i:end] @ right[j:stop].T
        ok = s >= np.maximum(self.score[i:end, -1], self.floor).astype(s.dtype)[:, None]
        ok &= self.q.uids[i:end, None] != t.uids[None, j:stop]
        row, col = np.nonzero(ok)
        if not len(row):
            return
        rows = np.unique(row)
        at = np.concatenate([np.repeat(rows, self.k), row])
        score = np.concatenate([self.score[i + rows].ravel(), s[row, col].astype(np.int64)])
        ids = np.concatenate([self.id[i + rows].ravel(), t.ids[j + col]])
        order = np.lexsort((ids, ~score, at))  # ~score falls as the score rises, and can't overflow
        at, score, ids = at[order], score[order], ids[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        first = place < self.k
        self.score[i + rows], self.id[i + rows] = score[first].reshape(-1, self.k), ids[first].reshape(-1, self.k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place in its tree, vec_id, score) of what was found."""
        row, col = np.nonzero(self.score != NONE)
        return row, self.id[row, col], self.score[row, col]


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, q: floor(scale * component) as long; vectors that are null, empty or
    hold a null or non-finite component, and rows without id, are left out."""
    x = F.col("embedding")
    ok = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("q")
    )


BLOCK = pa.schema([("name", pa.string()), ("dim", pa.int32()), ("n", pa.int64()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64())])


def write_blocks(rows: DataFrame, folder: str, size: int, pivots: np.ndarray) -> DataFrame:
    """Rows (vec_id, uid, q) in files of at most ``size`` vectors of equal length, each
    with its tree; the list of files, with each root, as Parquet.

    Rows are dealt by range of (length, nearest pivot, uid), so near vectors share
    blocks and a crowded pivot spreads over many tasks. A file's name is unique to the
    attempt that wrote it, and only names of attempts that ended are in the list.
    """
    spark = rows.sparkSession
    near = pa.schema([("vec_id", pa.int64()), ("uid", pa.int64()), ("q", pa.list_(pa.int64())), ("pivot", pa.int32())])

    def place(batches):
        claim()
        for batch in batches:
            pivot = np.zeros(batch.num_rows, np.int32)
            for k, q in enumerate(batch.column(2)):
                v = np.asarray(q.values, np.float64)
                if len(pivots) and len(v) == pivots.shape[1]:
                    pivot[k] = ((pivots - v) ** 2).sum(axis=1).argmin()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot)], schema=near)

    def write(batches):
        claim()
        held: dict[int, list] = {}
        names, part = 0, TaskContext.get()

        def flush(dim: int) -> pa.RecordBatch:
            nonlocal names
            ids, uids, vectors = zip(*held.pop(dim))
            tree = build(np.array(ids, np.int64), np.array(uids, np.int64), np.array(vectors, np.int64))
            name = f"{folder}/{dim}-{part.partitionId():06d}-{names:05d}-{part.taskAttemptId()}.npz"
            names += 1
            file = AtomicFile(name)
            file.write(tree.stored())
            file.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([dim], pa.int32()), pa.array([len(tree)], pa.int64()), pa.array([tree.c[0]], BLOCK.field("centre").type), pa.array([tree.radius[0]])], schema=BLOCK)

        last: dict[int, int] = {}
        for batch in batches:
            for vec_id, uid, q, pivot in zip(*(c.to_pylist() for c in batch.columns)):
                # a block that is filled by a quarter ends with its pivot's rows, so it stays compact
                if len(held.get(len(q), ())) * 4 >= size and last[len(q)] != pivot:
                    yield flush(len(q))
                last[len(q)] = pivot
                held.setdefault(len(q), []).append((vec_id, uid, q))
                if len(held[len(q)]) >= size:
                    yield flush(len(q))
        for dim in list(held):
            yield flush(dim)

    placed = rows.select("vec_id", "uid", "q").mapInArrow(place, "vec_id long, uid long, q array<long>, pivot int")
    n = max(1, -(-rows.count() // size))
    dealt = placed.repartitionByRange(n, F.size("q"), "pivot", F.xxhash64("uid")).sortWithinPartitions(F.size("q"), "pivot")
    return persist(dealt.mapInArrow(write, "name string, dim int, n long, centre array<double>, radius double"), "vector-lists")


def read_block(name: str) -> Tree:
    fs, path = open_fs(name)
    with fs.open_input_file(path) as f:
        data = np.load(io.BytesIO(f.read()))
    return Tree(**{k: data[k] for k in Tree.FIELDS})


#: Parts of the pairs of blocks of one length: no task makes more than a share of them.
SALTS = 64


def root_bounds(asked: DataFrame, data: DataFrame) -> DataFrame:
    """(query, data, bound): names of blocks of one length, and the bound of their roots' products.

    The stated queries against all rows, in blocks: only names leave the join, whose key is the length and a
    salt of the data block.
    """
    sq = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    q = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("name").alias("query"), F.col("centre").alias("cq"), F.col("radius").alias("rq"), sq("centre").alias("nq"))
    x = data.select("dim", F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int").alias("salt"), F.col("name").alias("data"), F.col("centre").alias("cx"), F.col("radius").alias("rx"), sq("centre").alias("nx"))
    dot = F.aggregate(F.zip_with("cq", "cx", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    bound = dot + F.col("nq") * F.col("rx") + F.col("nx") * F.col("rq") + F.col("rq") * F.col("rx")
    slack = 1e-9 * (F.col("nq") + F.col("rq")) * (F.col("nx") + F.col("rx")) + 0.5
    return q.join(x, ["dim", "salt"]).select("query", "data", (bound + slack).alias("bound"))


def chained(pivots: np.ndarray) -> np.ndarray:
    """Pivots in an order in which each is followed by the nearest that is left, so that a block
    of vectors of neighbouring pivots is compact."""
    left, out = list(range(len(pivots))), []
    while left:
        at = min(left, key=lambda i: float(((pivots[i] - pivots[out[-1]]) ** 2).sum())) if out else left[0]
        out.append(at)
        left.remove(at)
    return pivots[out]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k best vectors of its length.

    Inputs are ``quantised`` frames (vec_id, q). A row's own vector is left out by
    ``uid`` where both frames have that column, else by vec_id; rows of a repeated vec_id
    are queries of their own, each with its k best. Fewer than k vectors give fewer
    rows, no vectors none. A query block first meets the data block of best root bound, then
    those whose bound reaches its worst k-th score, CHUNK in a task, which holds
    two blocks at once; the k best per task are merged by rank per query. Products of 64
    bits or more raise ValueError. Other columns are ignored.
    """
    spark = vectors.sparkSession
    prepare(spark)
    own = "uid" if "uid" in vectors.columns and "uid" in queries.columns else "vec_id"
    row_of = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(own).cast("long").alias("uid"), "q")
    vectors, queries = row_of(vectors), row_of(queries)
    folder = shared_dir(spark, "vector-blocks")
    some = vectors.withColumn("o", F.xxhash64("uid")).orderBy("o").limit(PIVOTS).collect()  # PIVOTS rows
    dim = len(some[0].q) if some else 0
    pivots = chained(np.array([r.q for r in some if len(r.q) == dim], np.float64))
    data = write_blocks(vectors, f"{folder}/data", data_block, pivots)
    asked = write_blocks(queries, f"{folder}/queries", query_block, pivots)
    out = pa.schema([("query", pa.string()), ("query_uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        claim()
        for batch in batches:
            for pair in batch.to_pylist():
                search = Search(read_block(pair["query"]), k, pair["floor"])
                for name in pair["blocks"]:  # best bound first
                    search.with_block(read_block(name))
                row, vec_id, score = search.found()
                q = search.q
                yield pa.RecordBatch.from_arrays([pa.array([pair["query"]] * len(row), pa.string()), pa.array(q.uids[row]), pa.array(q.ids[row]), pa.array(vec_id), pa.array(score)], schema=out)

    def met(pairs: DataFrame) -> DataFrame:
        """(query, query_uid, query_id, vec_id, score) of (query, data, bound, floor), CHUNK data blocks a task."""
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "data")) - 1
        chunks = pairs.withColumn("at", place).groupBy("query", "floor", F.floor(F.col("at") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("at", "data"))).alias("b"))
        work = persist(chunks.select("query", "floor", F.transform("b", lambda x: x["data"]).alias("blocks")), "vector-pairs")
        tasks = max(1, min(work.count(), 100_000))
        return work.repartition(tasks, "query", F.col("blocks")[0]).mapInArrow(run, "query string, query_uid long, query_id long, vec_id long, score long")

    # a query block's best data block first, alone; then those whose bound reaches the worst k-th score so far
    bounds = persist(root_bounds(asked, data), "vector-bounds")
    home = bounds.groupBy("query").agg(F.max_by("data", F.struct("bound", "data")).alias("data"), F.max("bound").alias("bound"))
    first = persist(met(home.withColumn("floor", F.lit(NONE).cast("long"))), "vector-first")
    kth = first.groupBy("query", "query_uid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    size = asked.select(F.col("name").alias("query"), "n")
    floors = kth.filter(F.col("n") >= k).groupBy("query").agg(F.count(F.lit(1)).alias("full"), F.min("kth").alias("kth")).join(size, "query").filter("full = n")
    rest = bounds.join(home.select("query", "data"), ["query", "data"], "left_anti").join(floors.select("query", "kth"), "query", "left")
    left = rest.filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))).withColumn("floor", F.coalesce("kth", F.lit(NONE).cast("long")))
    found = first.unionByName(met(left.select("query", "data", "bound", "floor")))
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every vec_id divisible by 20."""
    rows = persist(quantised(read_table(spark, sf_dir, "embeddings")).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    return top_k(rows, rows.filter(F.col("vec_id") % EVERY == 0))


OP9_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.uid, a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.uid <> b.uid AND len(a.q) = len(b.q)
  WHERE a.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
