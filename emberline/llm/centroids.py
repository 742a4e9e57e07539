"""Exact centroid clustering of quantised vectors, on distinct vectors with weights.

Equal vectors are grouped first (partial sums before the shuffle), so Lloyd's rounds
read each distinct vector once with its multiplicity. A round is one scan: tasks hold
the centroids, add up integer sums and counts per cluster, and hand on one row per
cluster; only those k rows reach the driver. The assignment is then joined back to
the rows: the few vectors that may be hot (each more than 1 / HEAVY of all rows, so fewer
than HEAVY of them) by broadcast, all others by a shuffle in which no key is hot.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, persist, prepare, read_table

DIM, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: A vector of more than 1 / HEAVY of all rows is sent to every task of the last join: fewer than HEAVY are.
HEAVY = 1000
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def kept_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, q: floor(scale * component) as long, of vectors with exactly ``dim`` components, all finite."""
    x = F.col("embedding")
    ok = x.isNotNull() & (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(F.coalesce(ok, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("q")
    )


def starts(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors of least sha256 of ``seed:vec_id``, in that order; rows without id last, equal ids by the vector."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(order.alias("o"), "q").orderBy(F.asc_nulls_last("o"), "q").limit(clusters).collect()  # k rows
    return np.array([r.q for r in first], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of the nearest centroid, exact; ties go to the smaller number."""
    most = int(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 1 << 53:  # every sum is a whole number below 2**53
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None]
    elif 4 * most * most * max(1, x.shape[1]) < 1 << 63:
        d = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    else:
        raise ValueError("distances are beyond 64 bits")
    cluster = d.argmin(axis=1)
    return cluster, d[np.arange(len(x)), cluster].astype(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every non-empty centroid becomes its vectors' componentwise floor(sum / count)."""
    k, dim = centroids.shape
    part = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def add(batches):
        claim()
        sums, n, most = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            x, weight = _matrix(batch.column(0), dim), batch.column(1).to_numpy()
            most += int(np.abs(x).max(initial=0)) * int(weight.sum())
            if most >= 1 << 63:
                raise ValueError("sums are beyond 64 bits")
            cluster, _ = nearest(x, centroids)
            for c in np.unique(cluster):
                own = cluster == c
                sums[c] += weight[own] @ x[own]
                n[c] += weight[own].sum()
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(sums[some]), part.field("sums").type)], schema=part)

    parts = distinct.select("q", "weight").mapInArrow(add, "cluster int, n long, sums array<long>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dim)]).alias("sums"))
    out = centroids.copy()
    for row in added.collect():  # a row per cluster
        out[row.cluster] = [s // row.n for s in row.sums]
    return out


def cluster_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Vectors that are null, have another length than ``dim`` or hold a null or non-finite
    component are left out; a row without vec_id is kept but never a start unless too few
    others are there. Fewer vectors than ``clusters`` give that many centroids, none give
    no rows. Rows of a repeated vec_id are rows of their own. Distances, sums or inertias
    beyond 64 bits raise an error. Other columns are ignored.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = kept_vectors(vectors, dim, scale)
    centroids = starts(rows, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], OUT)
    distinct = persist(rows.groupBy("q").agg(F.count(F.lit(1)).alias("weight")), "distinct-vectors")
    for _ in range(rounds):
        centroids = moved(distinct, centroids)
    placed = pa.schema([("q", pa.list_(pa.int64())), ("weight", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def assign(batches):
        claim()
        for batch in batches:
            cluster, distance = nearest(_matrix(batch.column(0), dim), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(placed.field(0).type), batch.column(1), pa.array(cluster, pa.int32()), pa.array(distance)], schema=placed)

    assigned = persist(distinct.select("q", "weight").mapInArrow(assign, "q array<long>, weight long, cluster int, distance long"), "assigned-vectors")
    sums = assigned.groupBy("cluster").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("distance")).alias("inertia")).collect()  # a row per cluster
    n, inertia = sum(r.n for r in sums), {r.cluster: r.inertia for r in sums}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    hot = F.col("weight") * HEAVY > n
    heavy = assigned.filter(hot).select("q", "cluster", "distance")  # fewer than HEAVY rows, whatever the input
    met = rows.join(F.broadcast(heavy), "q", "left")
    rest = met.filter("cluster is null").select("vec_id", "q").join(assigned.filter(~hot).select("q", "cluster", "distance"), "q")
    every = met.filter("cluster is not null").select("vec_id", "cluster", "distance").unionByName(rest.select("vec_id", "cluster", "distance"))
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    return every.select(
        "vec_id", "cluster", "distance", of([inertia.get(c, 0) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"),
    )


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    """Eight clusters of all of ``embeddings`` after ten rounds."""
    return cluster_vectors(read_table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds written out, over all rows."""
    distance = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, q) - 1 AS INTEGER) AS cluster, q FROM v
  ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, q LIMIT {CLUSTERS}
)""",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT uid, cluster, d FROM (
    SELECT v.uid, c.cluster, {distance} AS d FROM v CROSS JOIN c{r} c
  ) QUALIFY row_number() OVER (PARTITION BY uid ORDER BY d, cluster) = 1
)""")
        if r < ROUNDS:
            parts.append(f"""s{r} AS MATERIALIZED (
  SELECT cluster, i, (s - ((s % n) + n) % n) // n AS m FROM (
    SELECT a.cluster, p.i, sum(v.q[p.i]) AS s, count(*) AS n
    FROM a{r} a JOIN v USING (uid) CROSS JOIN (SELECT CAST(unnest(range(1, {DIM} + 1)) AS INTEGER) AS i) p GROUP BY a.cluster, p.i
  )
),
c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(x.q, c.q) AS q FROM c{r} c
  LEFT JOIN (SELECT cluster, list(CAST(m AS BIGINT) ORDER BY i) AS q FROM s{r} GROUP BY cluster) x USING (cluster)
)""")
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT v.vec_id, a.cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (uid) JOIN c{ROUNDS} c USING (cluster)
"""
    )


OP12_SQL = _sql()
