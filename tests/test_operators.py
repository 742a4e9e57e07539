"""Operators on literal rows: ties, nulls, budgets and late rows."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from emberline.functions import scoring, text
from emberline.operators import graph, ledger, ranking, timeline, vectors
from emberline.streaming import stateful


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"]).select(column.alias("x")).first().x


def test_band_leader_is_not_chained(spark):
    rows = spark.createDataFrame([(1, 90.0, 0.0), (2, 88.0, 5.0), (3, 86.0, 9.0), (4, 86.0, 9.0)], "id long, rel double, tie double")
    got = [(r.id, r.band) for r in ranking.band_rank(rows, 3.0).orderBy("pos").collect()]
    assert got == [(2, 0), (1, 0), (3, 1), (4, 1)]


def test_rrf_duplicates(spark):
    rows = spark.createDataFrame([(0, 1.0, 1, "a"), (0, 1.0, 2, "a"), (0, 1.0, 3, "b"), (1, 0.5, 1, "b")], "channel int, weight double, rank int, id string")
    first = {r.id: r.score for r in ranking.rrf(rows).collect()}
    assert math.isclose(first["a"], 1 / 61) and math.isclose(first["b"], 1 / 63 + 0.5 / 61)
    every = {r.id: r.score for r in ranking.rrf(rows, merge_duplicates=False).collect()}
    assert math.isclose(every["a"], 1 / 61 + 1 / 62)


def test_budget_stops_at_first_overflow(spark):
    rows = spark.createDataFrame([(1, 5), (2, 9), (3, 1)], "id long, tokens int")
    assert [r.id for r in ranking.token_budget(rows, "tokens", 10, [F.col("id")]).collect()] == [1]


def test_forced_rows_use_the_budget(spark):
    rows = spark.createDataFrame([(i,) for i in range(6)], "id long")
    got = [r.id for r in ranking.forced_cap(rows, F.col("id") >= 4, 3, [F.col("id")]).orderBy("id").collect()]
    assert got == [0, 4, 5]


def test_budget_is_filled_by_small_rows(spark, monkeypatch):
    from emberline.plans import catalog

    rows = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(3).alias("tokens"))
    got = sorted(r.id for r in ranking.token_budget(rows, "tokens", 1200, [F.col("id")]).collect())
    assert got == list(range(801))  # 400 rows of three tokens, those without any between, and one behind
    memories = catalog.V.memories
    monkeypatch.setattr(catalog.V, "memories", lambda s, d: memories(s, d).withColumn("content", F.lit("one two three four")))
    assert catalog.QUERIES["k06_token_budget"](spark, "/root/testdata/sf0.01").count() > 200


def test_bands_and_caps_take_all_rows(spark):
    from emberline.plans.catalog import QUERIES

    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    assert sorted(r.pos for r in QUERIES["w01_band_rank_all"](spark, d).collect()) == list(range(1, n + 1))
    # no window without partitions takes all rows: pages and bands are cut or summed first
    rows = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("rel"), F.lit(0.0).alias("tie"))
    got = [r.id for r in ranking.forced_cap(rows, F.col("id") == 2999, 3, [F.col("id")]).orderBy("id").collect()]
    assert got == [0, 1, 2999]
    assert [r.pos for r in ranking.band_rank(rows, 3.0).orderBy(F.desc("rel"), "id").limit(2).collect()] == [1, 2]


def test_every_row_is_a_seed(spark):
    from emberline.plans import catalog, records  # noqa: F401  records adds to the catalogue

    d = "/root/testdata/sf0.001"
    seeds = {r.seed for r in catalog.QUERIES["w02_timeline_neighbors_all"](spark, d).select("seed").collect()}
    incoming = {r.incoming for r in catalog.QUERIES["f15_merge_chain_all"](spark, d).select("incoming").collect()}
    assert any(i % 20 for i in seeds) and any(i % 40 for i in incoming)


def test_activity_flags_and_missing_age(spark):
    no, yes = F.lit(False), F.lit(True)
    score = lambda **k: one(spark, scoring.activity_score(F.lit(5), F.lit(1), F.lit(0.3), k.get("days", F.lit(None).cast("double")), k.get("resolved", no), k.get("digested", no), k.get("pinned", no), no, F.lit(k.get("kind", "dynamic"))))
    assert score(pinned=yes) == 999.0 and score(kind="feel") == 50.0
    assert score() == score(days=F.lit(30.0))
    assert math.isclose(score(days=F.lit(40.0), resolved=yes), score(days=F.lit(40.0)) * 0.05, rel_tol=0.01)


def test_cosine_edges(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, scoring.cosine(a(1, 0), a(0, 0))) == 0.0
    assert one(spark, scoring.cosine(a(1, 0), a(1, 0, 0))) == 0.0
    assert math.isclose(one(spark, scoring.cosine(a(1, 1), a(1, 0))), 2**-0.5)


@pytest.mark.parametrize(
    "given, masked",
    [
        ("Authorization: Bearer abc.def", "Authorization: Bearer [REDACTED]"),
        ("password = hunter2, next", "password=[REDACTED], next"),
        ("at 10.0.0.1:5432 now", "at [REDACTED_DB_ENDPOINT] now"),
        ("at 10.0.0.1:80 now", "at [REDACTED_IP] now"),
        ("sk-abcdefghijkl", "sk-[REDACTED]"),
        ("nothing here", "nothing here"),
    ],
)
def test_redaction(spark, given, masked):
    assert one(spark, text.redact(F.lit(given))) == masked


def test_links_names_and_keys(spark):
    assert one(spark, text.strip_aliased_links(F.lit("see [[a|b]] and [[c]]"))) == "see b and c"
    assert one(spark, text.sanitize_name(F.lit("a/b*c"))) == "abc" and one(spark, text.sanitize_name(F.lit("//"))) == "unnamed"
    assert one(spark, text.key_values(F.lit("a: 1\nb: 2\na: 3"))) == {"a": "3", "b": "2"}
    assert one(spark, text.fingerprint(F.lit("short"))) is None
    assert one(spark, text.normalise_date(F.lit("2024-05"))) == "2024-05-01T00:00:00"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_late_older_row_is_historical(spark):
    rows = spark.createDataFrame([("k", 1, at(1)), ("k", 2, at(5)), ("k", 3, at(3))], "key string, id long, valid_at timestamp_ntz")
    got = {r.id: (r.state, r.invalid_at) for r in timeline.succession(rows).collect()}
    assert got == {1: ("historical", at(3)), 3: ("historical", at(5)), 2: ("current", None)}


def test_ripple_is_the_plain_range_join(spark):
    r = random.Random(1)
    rows = [(i, at(1) + dt.timedelta(minutes=r.randrange(20_000))) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz")
    got = {(x.centre, x.id) for x in timeline.ripple(df, df.filter("id < 10"), 48, 1000).collect()}
    assert got == {(c, i) for c, a in rows[:10] for i, b in rows if i != c and abs((a - b).total_seconds()) <= 48 * 3600}


def test_append_outcomes(spark):
    stored = spark.createDataFrame([("a", "x")], "k string, digest string")
    incoming = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "p"), ("b", 4, "p"), ("b", 5, "q")], "k string, seq int, digest string")
    got = [r.outcome for r in ledger.append_once(stored, incoming, ["k"], "digest").orderBy("seq").collect()]
    assert got == ["replayed", "conflict", "inserted", "replayed", "conflict"]


def test_stage_history(spark):
    allowed = spark.createDataFrame([("a", "b"), ("b", "c")], "from string, to string")
    stages = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "a"), (2, 2, "c"), (3, 1, "a"), (3, 3, "b")], "run int, seq int, stage string")
    got = {(r.run, r.problem) for r in ledger.legal_history(stages, allowed).collect()}
    assert got == {(2, "transition"), (3, "gap")}


def test_similar_pairs_over_several_blocks(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 6)
    want = {(i, j) for i, a in rows for j, b in rows if i < j and cos(a, b) >= 0.8}
    assert {(x.a, x.b) for x in vectors.similar_pairs(df, 0.8, block=16).collect()} == want


def test_graph_hops_and_cycles(spark):
    edges = spark.createDataFrame([(1, 2, "kin", 0.9), (2, 3, "kin", 0.8), (3, 1, "kin", 0.3), (2, 9, "kin", 1.0), (3, 4, "causes", 1.0), (5, 6, "kin", 2.0)], "source long, target long, type string, strength double")
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    got = {(r.id, r.depth) for r in graph.expand(edges, nodes, nodes.filter("id = 1"), ["kin"], 10).collect()}
    assert got == {(2, 1), (3, 2)}
    comp = {r.id: r.comp for r in graph.components(edges.filter("target < 9"), nodes).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}


def test_streams_equal_batches(spark, tmp_path):
    rows = [("a", at(1, 1), 0.5), ("a", at(1, 2), 0.25), ("b", at(1, 1), 0.9), ("b", at(1, 1), 0.9)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "k string, ts timestamp, amount double").coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema("k string, ts timestamp, amount double").parquet(src)
    run = lambda df, name, mode: df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(90)
    run(stateful.deduplicated(stream(), ["k"]), "first", "append")
    assert spark.sql("SELECT count(*) n FROM first").first().n == 2
    run(stateful.decayed_state(stream(), "k"), "state", "update")
    got = {r.k: r.value for r in spark.sql("SELECT * FROM state").collect()}
    assert math.isclose(got["a"], 0.5 * math.exp(-4) + 0.25, abs_tol=1e-6) and got["b"] == 1.0
    out = str(tmp_path / "log")
    q = stream().writeStream.foreachBatch(stateful.append_batch(out, ["k"])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert spark.read.parquet(out).count() == 2


def test_redaction_is_not_lost_to_its_first_pass(spark):
    from emberline.functions import text as X

    said = ["Authorization : Bearer abc", "api key = z", "API-KEY: x", "auth_token=q", "my Secret = s", "cookie: a=b", "use sk-abcdefghijk now", "POSTGRESQL://u@h", "dbname=d host=h", "port=5432", "user=me", "at 10.0.0.1:5432 or 1.2.3.4", "plain words", ""]
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    whole = F.col("t")
    for pattern, replacement in X.MASKS:
        whole = F.regexp_replace(whole, pattern, replacement)
    got = rows.select(X.redact(F.col("t")).alias("a"), whole.alias("b"), "t").collect()
    assert all(r.a == r.b for r in got) and [r.a == r.t for r in got] == [False] * 12 + [True] * 2


def test_similar_pairs_of_clustered_and_odd_vectors(spark):
    import numpy as np

    from emberline.operators import vectors

    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 6))
    v = centres[rng.integers(0, 12, 300)] + 0.05 * rng.standard_normal((300, 6))
    v[5] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, [1.0, 2.0]), (1001, [2.0, 4.0]), (1002, None), (1003, [])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    unit = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if round(float(unit[i] @ unit[j]), 6) >= 0.95} | {(1000, 1001)}
    for block in (4096, 40):
        assert {(r.a, r.b) for r in vectors.similar_pairs(df, 0.95, block).collect()} == want


def test_components_of_a_long_chain(spark):
    from emberline.operators import graph

    n = 150
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "source long, target long")
    nodes = spark.createDataFrame([(i,) for i in range(n + 5)], "id long")
    got = {r.id: r.comp for r in graph.components(edges, nodes).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and all(got[i] == i for i in range(n + 1, n + 5))


def test_markdown_files(spark, tmp_path):
    from emberline.sources import markdown

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.md").write_text("---\nid: x1\nname: 'N'\ndomain: [en, 'fr']\nimportance: 12\npinned: True\ncontent: clash\n---\nbody\nmore")
    (tmp_path / "a" / "b" / "two.md").write_text("no front matter")
    (tmp_path / "a" / "b" / "three.txt").write_text("---\nid: no\n---\n")
    (tmp_path / "a" / "empty.md").write_text("---\n---\n")
    got = {r.path.rsplit("/", 1)[1]: r for r in markdown.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"one.md", "two.md", "empty.md"}
    one = got["one.md"]
    assert (one.id, one.name, one.domain, one.importance, one.pinned, one.body, one.corrupt, one.type) == ("x1", "N", ["en", "fr"], 12, True, "body\nmore", False, "dynamic")
    assert got["two.md"].corrupt and got["two.md"].body == "no front matter" and got["two.md"].type is None
    assert not got["empty.md"].corrupt and got["empty.md"].id is None
    assert {r.path.rsplit("/", 1)[1]: r.size > 0 for r in markdown.listing(spark, str(tmp_path)).collect()} == {"one.md": True, "two.md": True, "empty.md": True}


def test_json_lines(spark):
    from emberline.sources import jsonl

    lines = spark.createDataFrame([('{"k": 1, "v": "a"}',), ("{broken",), ('{"v": "no key"}',), ("  ",), ("[1]",), ('{"k": 2}',)], "line string")
    assert sorted((r.k, r.v) for r in jsonl.lenient(lines, "k long, v string", "k").collect()) == [(1, "a"), (2, None)]
    good = lines.filter("line like '%\"k\"%'")
    assert jsonl.strict(good, "k long, v string", "k").count() == 2
    for bad in (lines, good.union(good.limit(1))):
        try:
            jsonl.strict(bad, "k long, v string", "k").collect()
            raise AssertionError("a bad read passed")
        except Exception as e:
            assert "malformed" in str(e) or "repeated key" in str(e)


def test_entity_mentions_respect_words_and_scripts():
    from emberline.operators import entities

    f = entities.Finder(["new york", "york", "ann", "上海", "c++"])
    say = lambda t: [a for _, _, a in f.find(entities.normal(t))]
    assert say("New  YORK and Yorkshire, Ann's annex") == ["new york", "ann"]
    assert say("我在上海见ann了 c++!") == ["上海", "ann", "c++"]
    assert say("") == [] and entities.Finder([]).find("x") == []


def test_hooks_are_asked_once_for_equal_texts(spark):
    from emberline.operators import hooks

    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "c")], "id long, text string")
    cache = rows.filter("id = 4").select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.lit("held").alias("value"))
    got = {r.id: (r.s, r.from_cache) for r in hooks.cached(rows, cache, "summary", "text", "s").collect()}
    assert got == {1: ("a b", False), 2: ("a b", False), 3: (None, False), 4: ("held", True)}


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_percentiles_are_exact_with_ties_and_one_row(spark, accuracy):
    import numpy as np

    r = random.Random(2)
    values = {"a": [r.random() for _ in range(997)], "b": [5.0] * 300 + [r.randrange(9) for _ in range(200)], "c": [7.0], None: [1.0, 2.0]}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("d", None)], "k string, v double")
    got = {r.k: (r.low, r.mid, r.high) for r in ranking.percentiles(rows, "k", "v", {"low": 0.05, "mid": 0.5, "high": 0.95}, accuracy).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        assert np.allclose(got[k], np.quantile(vs, [0.05, 0.5, 0.95]))
