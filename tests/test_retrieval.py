import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import clusters, keyword_index


def loop(rows, threshold):
    """The sequential loop over rows in order."""
    out, free = [], [(i, np.asarray(v, float)) for i, v in sorted(rows, key=lambda r: r[0]) if v is not None and len(v) and np.any(v)]
    while free:
        lead, u = free.pop(0)
        near = [(i, v) for i, v in free if len(v) == len(u) and round(float(u @ v / np.sqrt((u @ u) * (v @ v))), 9) > threshold]
        out += [(lead, lead), *((lead, i) for i, _ in near)]
        taken = {i for i, _ in near}
        free = [x for x in free if x[0] not in taken]
    return sorted(out)


@pytest.mark.parametrize("head,block,threshold", [(3, 16, 0.7), (1, 1000, 0.4), (5000, 50, 0.7)])
def test_leaders_equal_the_sequential_loop(spark, head, block, threshold):
    rng = np.random.default_rng(head)
    centre = rng.normal(size=(9, 4))
    rows = [(int(k), [float(x) for x in centre[k % 9] + rng.normal(size=4) * (0.1 + 0.1 * (k % 7))]) for k in rng.permutation(150)]
    rows += [(900 + k, rows[4][1]) for k in range(60)]  # copies
    rows += [(2000, [0.0] * 4), (2001, []), (2002, None), (2003, [1.0, 2.0]), (2004, [1.0, 2.1])]
    df = spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)
    got = sorted(tuple(r) for r in clusters.leader_clusters(df, threshold, head, block).collect())
    assert got == loop(rows, threshold)
    assert clusters.leader_clusters(df.limit(0), threshold, head, block).count() == 0


def test_episodes(spark):
    c = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (7, 7)], "seed long, id long")
    r = spark.createDataFrame([(1, "2024-01-03", 12, 0.2, 0.1, ["a", "b"]), (2, "2024-01-01", 3, 0.4, None, ["b"]), (3, "2024-01-02", 5, 0.6, 0.3, ["a"]), (7, "2024-01-02", 2, None, 0.5, [])], "id long, event_at string, importance int, valence double, arousal double, domain array<string>")
    got = {x.seed: x for x in clusters.episodes(c, r).collect()}
    one = got[1]
    assert (one.n, one.importance, round(one.valence, 6), one.arousal, one.domain, one.sources, one.span_start, one.span_end) == (3, 10, 0.4, 0.2, "b", [2, 3, 1], "2024-01-01", "2024-01-03")
    assert got[7].domain is None and got[7].valence is None and got[7].sources == [7]


RECORDS = "id long, name string, tags array<string>, content string, w double, kind string"


def scan(rows, query, k, weight, total, keep=lambda r: True, floor=None):
    """Every record's score, by reading all texts."""
    import re

    words = lambda t: {w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w}
    asked, out = words(query), []
    for i, name, tags, content, w, kind in rows:
        if i is None or not keep(kind):
            continue
        names, body = words(" ".join([name or "", *(tags or [])])), words(content)
        share = max(len(names & asked) / len(asked), keyword_index.CONTENT * len(body & asked) / len(asked)) if asked else 0.0
        out.append((round(100 * (weight * share + (w or 0.0)) / total, 6), i))
    out = [x for x in out if floor is None or x[0] >= floor]
    return [(i, s) for s, i in sorted(out, key=lambda x: (-x[0], x[1]))[:k]]


@pytest.fixture(scope="module")
def records():
    rng = np.random.default_rng(2)
    common, rare = [f"w{k}" for k in range(30)], [f"rare{k}" for k in range(200)]
    rows = []
    for i in range(400):
        text = " ".join([*rng.choice(common, 12), *(rng.choice(rare, 1) if i % 5 == 0 else [])])
        rows.append((i, f"Name {rng.choice(common)}" if i % 7 else None, [str(rng.choice(common))] if i % 3 else None, text if i % 11 else None, float(rng.exponential()) if i % 13 else None, "ab"[i % 2]))
    return [*rows, (None, "w1", ["w2"], "w3", 9.0, "a")]


def test_search_equals_the_full_scan(spark, records):
    df = spark.createDataFrame(records, RECORDS).repartition(4)
    index = keyword_index.build(df, F.col("w"), ["kind"], block=16)
    queries = ["rare7", "w1 w2 rare40", "W3, w4! w5 w6", "nothing known", "", "name", "rare1 rare2 rare3 rare4"]
    asked = spark.createDataFrame(list(enumerate(queries)), "qid long, query string")
    for keep, kind, floor in ((None, lambda k: True, None), (F.col("kind") == "a", lambda k: k == "a", None), (None, lambda k: True, 55.0)):
        found, report = keyword_index.search(spark, index, asked, 5, 4.0, 9.5, keep, floor)
        got = {}
        for r in found.orderBy("qid", "pos").collect():
            got.setdefault(r.qid, []).append((r.id, r.score))
        for q, text in enumerate(queries):
            assert got.get(q, []) == scan(records, text, 5, 4.0, 9.5, kind, floor), text
    opened = {r.qid: r.opened / r.blocks for r in keyword_index.search(spark, index, asked, 5, 4.0, 9.5)[1].collect()}
    assert opened[0] < 0.7 and opened[3] <= 0.3 and opened[4] <= 0.3, opened  # blocks whose bound is below the fifth score stay closed


def test_empty_index(spark, records):
    df = spark.createDataFrame(records, RECORDS)
    index = keyword_index.build(df.limit(0), F.col("w"), ["kind"])
    asked = spark.createDataFrame([(1, "w1")], "qid long, query string")
    assert keyword_index.search(spark, index, asked, 5, 4.0, 9.5)[0].count() == 0


def test_budget_against_a_plain_loop(spark):
    from emberline.operators import ranking

    rng = np.random.default_rng(6)
    rows = [(k, float(rng.integers(0, 9)) if k % 17 else None, int(rng.choice([0, 0, 0, 2, 5])) if k % 5 else None) for k in range(700)]
    df = spark.createDataFrame(rows, "id long, score double, tokens int")
    ordered = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for budget in (0, 7, 300, 10_000):
        used, want = 0, []
        for r in ordered:
            used += r[2] or 0
            if used > budget:
                break
            want.append(r[0])
        assert sorted(r.id for r in ranking.token_budget(df, "tokens", budget, ["-score", "id"], page=16).collect()) == sorted(want), budget


def test_conflict_pairs_in_order(spark):
    from emberline.operators import facts

    texts = ["size = 4 kg", "size = 5 kg", "size = 4 kg", "not yet", "on 2024-01-02", "on 2024-02-03 no", "plain", None]
    rows = [(k if k != 40 else None, f"Name {k % 9}" if k % 4 else None, [f"d{k % 3}", None] if k % 6 else None, texts[k % 8]) for k in range(90)]
    df = spark.createDataFrame(rows, "id long, name string, domain array<string>, content string").repartition(3)
    sig = {"size = 4 kg": ({"size": "4 kg"}, (), ("4 kg",), 0), "size = 5 kg": ({"size": "5 kg"}, (), ("5 kg",), 0), "not yet": ({}, (), (), 1), "on 2024-01-02": ({}, ("2024-01-02",), (), 0), "on 2024-02-03 no": ({}, ("2024-02-03",), (), 1)}
    of = lambda t: sig.get(t, ({}, (), (), 0))
    want = []
    for i, n, d, t in rows:
        for j, m, e, u in rows:
            if i is None or j is None or i >= j or not ((n and n == m) or set(d or []) & set(e or []) - {None}):
                continue
            a, b = of(t), of(u)
            fields = [k for k in a[0] if k in b[0] and a[0][k] != b[0][k]] + [f for f, x, y in (("date", a[1], b[1]), ("number", a[2], b[2])) if x and y and x != y] + (["negation"] if a[3] != b[3] else [])
            if fields:
                want.append((i, j, ",".join(sorted(fields))))
    assert len(want) > 300
    for most in (1, 50, 100_000):
        assert [tuple(r) for r in facts.conflict_pairs(df, most, page=4).orderBy("a", "b").collect()] == sorted(want)[:most]


@pytest.mark.parametrize("block,floor", [(7, 0.6), (1000, 0.0)])
def test_segment_neighbours(spark, block, floor):
    from emberline.operators import vectors

    rng = np.random.default_rng(block)
    rows = [(k, [[float(x) for x in rng.normal(size=3)] for _ in range(k % 4)]) for k in range(60)]
    rows += [(100 + k, rows[7][1]) for k in range(12)] + [(200, None), (201, [[0.0, 0.0, 0.0]]), (202, [[1.0, 2.0]])]
    df = spark.createDataFrame(rows, "id long, segments array<array<double>>").repartition(3)
    cos = lambda a, b: round(float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))), 9)
    want = []
    for i, a in rows:
        if i % 3 or not a:
            continue
        met = [(-max(cos(x, y) for x in a for y in b), j) for j, b in rows if j != i and b and len(b[0]) == len(a[0]) and any(b[0])]
        want += [(i, r + 1, j, round(-s, 6)) for r, (s, j) in enumerate(sorted(x for x in met if -x[0] > floor)[:5])]
    got = [tuple(r) for r in vectors.segment_neighbours(df, df.filter("id % 3 = 0"), 5, floor, block).collect()]
    assert sorted(got) == sorted(want)


def test_segment_neighbours_hand_on_few_candidates(spark, monkeypatch):
    from emberline.operators import vectors

    made, plain = [], vectors.whole
    monkeypatch.setattr(vectors, "whole", lambda pairs, score, ddl: made.append(plain(pairs, score, ddl)) or made[-1])
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=(2, 4)).tolist()) for k in range(600)]
    rows += [(1000 + k, [[1.0, 2.0, 3.0, 4.0]]) for k in range(90)]  # equal scores
    rows += [(2000, [[float("nan")] * 4, rows[8][1][0]]), (2001, [[float("inf"), 1.0, 0.0, 0.0]])]  # the finite segment meets
    df = spark.createDataFrame(rows, "id long, segments array<array<double>>").repartition(4)
    got = [tuple(r) for r in vectors.segment_neighbours(df, df.filter("id % 4 = 0"), 3, 0.5, 64).collect()]
    units = [(i, u / np.linalg.norm(u, axis=1)[:, None]) for i, s in rows for u in [np.array([x for x in s if np.isfinite(x).all()])] if len(u)]
    want = []
    for i, a in units:
        if i % 4 == 0:
            best = sorted((-round(float((a @ b.T).max()), 9), j) for j, b in units if j != i)[:3]
            want += [(i, r + 1, j, round(-x, 6)) for r, (x, j) in enumerate(best) if -x > 0.5]
    assert sorted(got) == sorted(want)
    # three a pair of blocks would be some 33 times 160 queries' three: bounds leave a few of them
    assert made[-1].count() < 6 * len(want)


def test_labels_spread_over_a_component_with_one_name(spark):
    from emberline.operators import graph

    comp = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)], "id long, comp long")
    labels = spark.createDataFrame([(2, "a"), (3, "a"), (3, None), (4, "a"), (5, "b"), (9, "z")], "id long, label string")
    assert sorted(tuple(r) for r in graph.spread_labels(comp, labels).collect()) == [(1, 1, "a", "spread"), (2, 1, "a", "own"), (3, 1, "a", "own")]


def test_append_once_with_nulls_and_several_stored_digests(spark):
    from emberline.operators import ledger

    stored = spark.createDataFrame([("a", "1"), ("a", "2"), ("n", None)], "k string, d string")
    rows = [(1, "a", "1"), (2, "a", "2"), (3, "b", None), (4, "b", None), (5, "b", "x"), (6, None, "y"), (7, None, "y"), (8, "n", None), (9, "n", "z")]
    got = {r.seq: r.outcome for r in ledger.append_once(stored, spark.createDataFrame(rows, "seq long, k string, d string"), ["k"], "d").collect()}
    assert got == {1: "replayed", 2: "conflict", 3: "inserted", 4: "replayed", 5: "conflict", 6: "inserted", 7: "replayed", 8: "replayed", 9: "conflict"}


def test_slot_pairs_in_order(spark):
    import re

    from emberline.operators import facts

    texts = ["size: 1", "size: 2 size: 3", "size: 3 size: 2", "nothing", "color: red size: 1", None, "SIZE: 9"]
    rows = [(k, f"2024-01-{1 + k * 7 % 20:02d}" if k % 11 else None, "historical" if k % 13 == 5 else None, texts[k % 7]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, at string, status string, content string").repartition(3)
    links = spark.createDataFrame([(8, 0), (1, 7), (14, 1)], "newer long, older long")
    slots = {"size": r"(?i)size: (\d)", "color": r"color: (\w+)"}
    held = []
    for i, at, status, t in rows:
        for slot, p in slots.items():
            values = sorted({x.lower() for x in re.findall(p, t or "")})
            if values and at and not status:
                held.append((slot, at, i, values))
    held.sort(key=lambda x: (x[1], x[2]), reverse=True)
    held.sort(key=lambda x: x[0])
    want = [(s, i, j, v[0], w[0]) for k, (s, _, i, v) in enumerate(held) for z, _, j, w in held[k + 1 :] if z == s and v != w and v[0] != w[0] and (i, j) not in {(8, 0), (1, 7), (14, 1)}]
    assert len(want) > 100
    for most in (1, 40, 10_000):
        got = [tuple(r) for r in facts.slot_pairs(df, slots, links, most, page=3).collect()]
        assert sorted(got) == sorted(want[:most])


def test_conflict_pairs_read_texts_as_sql_does(spark):
    import duckdb
    import pyarrow as pa

    from emberline.operators import facts
    from emberline.plans import retrieval  # noqa: F401  its plans
    from emberline.plans.catalog import SQL

    texts = ["noñra", "año not", "plain", "3月4日", "3月4号", "on 3月5日x", "3%4kg", "3% 5kg", "7Kg", "7kg", "size = 1　", "size = 1", "ſize = 2", "ſize = 3",
             "a size = 4", "a\nsize = 4", "size\x0b= 6", "negation: x\nno", "negation: y", "1kg2kg 3kg"]
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(k, "n", ["d"], t) for k, t in rows], "id long, name string, domain array<string>, content string")
    c = duckdb.connect()
    c.register("rows", pa.table({"id": [k for k, _ in rows], "content": texts}))
    own = "WITH memories AS (SELECT id, content, 'n' AS name, ['d'] AS domain, false AS resolved, false AS pinned, false AS protected, 'dynamic' AS type FROM rows), "
    sql = SQL["j04_conflict_pairs"]
    want = c.sql(own + sql[sql.index("p AS MATERIALIZED") :]).fetchall()
    assert len(want) > 60
    assert sorted(tuple(r) for r in facts.conflict_pairs(df, 500, page=4).collect()) == sorted(want)


@pytest.mark.parametrize("block", [5, 1000])
def test_cluster_neighbours(spark, block):
    from pyspark.sql import Window

    from emberline.functions.scoring import cosine
    from emberline.operators import vectors

    r = np.random.default_rng(4)
    odd = [None, [], [0.0] * 3, [1.0, None, 2.0], [float("nan"), 1.0, 0.0], [1e200, 1.0, 1e-200], [1e-180, 0.0, 1e-180], [1.0, 2.0], [float("inf"), 0.0, 1.0], [None, 1.0]]
    rows = [(k, [float(x) for x in r.integers(-1, 2, 3)] if k % 3 else odd[k // 3 % len(odd)] if k % 2 else r.normal(size=3).tolist(), k % 4 if k % 11 else None) for k in range(230)]
    rows += [(1000, [1.0, 0.0, 0.0], 9), (1001, [1.0, 1e-4, 0.0], 9), (1005, [1.0, 0.0, 0.0], 9), (2000, [1.0], 10)]
    v = spark.createDataFrame(rows, "id long, vec array<double>, cluster int").repartition(3)
    seeds = v.filter("id % 5 = 0")
    pairs = seeds.selectExpr("id source", "vec q", "cluster").join(v.withColumnRenamed("id", "target"), "cluster").filter("source <> target")
    scored = pairs.select("source", "target", F.round(cosine(F.col("q"), F.col("vec")), 6).alias("sim"))
    best = scored.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("sim"), "target")))
    want = best.filter("rn <= 4")
    got = vectors.cluster_neighbours(v, seeds, 4, block)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_edge_candidates_are_not_scored_pair_by_pair(spark):
    import __spark_entry__  # noqa: F401  all plans
    from emberline.plans.catalog import QUERIES

    plan = QUERIES["g07_edge_candidates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "FlatMapCoGroupsInArrow" in plan
