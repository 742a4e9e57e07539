import math

import numpy as np
import pytest

from emberline.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, cell string, score double"


def plain(rows, every=5, positives=5, negatives=3):
    kept = [(k, i, lab, [math.floor(256 * float(np.float32(x))) for x in e]) for k, (i, e, lab) in enumerate(rows) if i is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for k, i, lab, q in kept:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, p)), j, m) for n, j, m, p in kept if n != k and len(p) == len(q))
        for s, j, _ in [x for x in scored if x[2] == lab][:positives]:
            fit = [x for x in scored if x[2] != lab and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit[:negatives])]
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "clash", "c", 0.5) for r in rows], SCHEMA).repartition(3)
    stored = hn.persist(hn.whole_rows(df), "test-rows")
    return sorted(tuple(r) for r in hn.hard_negatives(stored, **({"every": 5, "block": 40, "group": 9} | how)).collect())


def near_copies(rng, n, labels, centres, spread):
    c = rng.normal(size=(centres, 6))
    return [[float(x) for x in c[rng.integers(centres)] + rng.normal(size=6) * spread] for _ in range(n)], [int(x) for x in rng.integers(0, labels, n)]


@pytest.mark.parametrize("spread,pivots", [(0.02, 16), (1.0, 5), (0.3, 1)])
def test_against_all_pairs(spark, spread, pivots):
    rng = np.random.default_rng(int(spread * 100))
    vectors, labels = near_copies(rng, 260, 3, 6, spread)
    rows = list(zip(range(260), vectors, labels))
    rows += [(400 + k, vectors[3], k % 2) for k in range(90)]  # a hot vector, all ties
    rows += [(5, vectors[9], 1), (10, [-x for x in vectors[2]], 0), (10, [-x for x in vectors[2]], 0)]  # repeated ids
    want = plain(rows)
    assert len(want) > 200
    assert run(spark, rows, pivots=pivots) == want


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.6, 0.0], 2), (3, [0.55, 0.3], 0), (5, [0.0, 0.0], 1), (7, [-1.0, -1.0], 2), (10, [], 1), (11, [], 1), (12, [], 3), (15, [1.0, 2.0, 3.0], 1), (16, [1.0, 2.0, 3.0], 1),
            (17, [1.0, 2.0, 1.0], 2), (20, None, 1), (25, [1.0, None], 1), (30, [float("nan"), 1.0], 1), (35, [float("-inf"), 1.0], 1), (40, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    want = plain(rows)
    assert (0, 1, 1, 2, 58880, 39168) in want and (10, 11, 1, 12, 0, 0) in want
    assert run(spark, rows) == want
    assert run(spark, [(5, None, 1)]) == [] and run(spark, [(5, [1.0], 1)]) == [] and run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_large_products(spark):
    rows = [(k, [float(2**21 + k), float(k), 1.0], k % 3) for k in range(40)]
    assert run(spark, rows) == plain(rows)
    with pytest.raises(Exception, match="64 bits|overflow|OVERFLOW"):
        run(spark, [(0, [2.0**30, 1.0], 1), (1, [2.0**30, 1.0], 1)])


def test_bounds_leave_few_blocks(spark):
    """Of clustered vectors most pairs of group and block are dropped before a block is read, and no pair that matters."""
    rng = np.random.default_rng(4)
    vectors, labels = near_copies(rng, 1500, 2, 12, 0.02)
    df = spark.createDataFrame([(k, v, lab, "", "", 0.0) for k, (v, lab) in enumerate(zip(vectors, labels))], SCHEMA)
    rows = hn.persist(hn.whole_rows(df), "test-rows")
    space = hn.space_of(rows, 24)
    folder = hn.shared_dir(spark, "test-voronoi")
    segments = hn.write_blocks(rows, space, f"{folder}/blocks", 25)
    asked = rows.filter("vec_id % 10 = 0").select("uid", hn.F.lit(0).cast("long").alias("part"), "label", "q", hn.F.lit(1).cast("long").alias("low"), hn.F.lit(hn.ANY).cast("long").alias("high"))
    best = hn.nearest(asked.withColumn("low", hn.F.lit(hn.NONE).cast("long")), segments, space, f"{folder}/a", 5, True, 6)
    kth = best.groupBy("uid").agg(hn.F.min("score").alias("kth"))
    raised = asked.join(kth, "uid").withColumn("low", hn.F.col("kth")).drop("kth")
    groups = hn.write_groups(raised, space, f"{folder}/b", True, 6)
    left = hn.might_serve(groups, segments, True).count()
    every = groups.select("group", "label").distinct().join(segments.select("file", "label").distinct(), "label").count()
    assert left < 0.5 * every, (left, every)


def test_same_as_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, hn.op11_hard_negatives(spark, sf).collect())) == sorted(con.sql(hn.OP11_SQL).fetchall())
