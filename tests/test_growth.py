"""Work that a table's growth must not multiply."""


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_best_pairs_are_cut_before_they_are_broadcast(spark):
    import __spark_entry__  # noqa: F401  all plans
    from emberline.plans.catalog import QUERIES

    df = QUERIES["q20_consolidation"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().executedPlan().toString().count("TakeOrderedAndProject") >= 2


def test_a_session_is_read_and_written_once_a_batch():
    import pandas as pd

    from emberline.streaming.sessions import NewestKeys

    class State:
        calls, value = 0, None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            State.calls += 1
            self.value = value

        def clear(self):
            State.calls += 1
            self.value = None

        def iterator(self):
            return iter([])

        updateValue = removeKey = lambda self, *x: self.update(x)

    class Handle:
        getValueState = getMapState = lambda self, *x: State()
        listTimers, deleteTimer, registerTimer = lambda self: [], lambda self, at: None, lambda self, at: None

    p = NewestKeys(100, 1000)
    p.init(Handle())
    rows = pd.DataFrame({"key": range(500), "at": pd.to_datetime(range(500), unit="s")})
    told = list(p.handleInputRows((1,), iter([rows]), None))[0]
    assert State.calls <= 2
    assert len(told) == 900 and set(told[told.op == "drop"]["key"]) == set(range(400))
    again = list(p.handleInputRows((1,), iter([rows.tail(100)]), None))[0]
    assert len(again) == 0


def test_chunks_of_texts_come_in_bounded_batches(spark):
    import __spark_entry__  # noqa: F401  all plans
    from emberline.plans.catalog import QUERIES

    for name in ("w08_line_chunks", "x31_utf8_parts"):
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        QUERIES[name](spark, "/root/testdata/sf0.001")
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "256"


def test_windows_are_scored_only_where_they_can_be_best(monkeypatch):
    import random

    from emberline.functions import similarity as X

    real, asked = X.ratio, []
    monkeypatch.setattr(X, "ratio", lambda a, b: asked.append(b) or real(a, b))
    r = random.Random(3)
    for n in (1, 2, 7, 9, 40, 400):
        for query in ("src3 the", "aab", "x"):
            text = "".join(r.choice("aberst hxyzc3") for _ in range(n))
            short, long = sorted((query, text), key=len)
            windows = [long[max(0, s) : s + len(short)] for s in range(1 - len(short), len(long))]
            assert X.partial_ratio(query, text) == max(real(short, w) for w in windows)
    asked.clear()
    X.partial_ratio("src3 the", "".join(r.choice("aberst hxyzc3") for _ in range(1000)))
    assert len(asked) < 300


def test_front_matter_is_matched_once_a_use(spark):
    from pyspark.sql import functions as F

    from emberline.sources import markdown

    df = spark.createDataFrame([("---\nid: 1\nid: 2\n---\nbody",)], "text string")
    parsed = df.select(markdown.parse(F.col("text")).alias("p"))
    assert parsed.first().p.fields == {"id": "2"}
    assert plan(parsed).count("regexp_extract_all") == 2


def test_signatures_are_found_once(spark):
    import __spark_entry__  # noqa: F401  all plans
    from emberline.plans.catalog import QUERIES


    assert plan(QUERIES["x10_supersedes_audit"](spark, "/root/testdata/sf0.001")).count("regexp_extract_all") <= 60  # 306 where each use finds them again


def test_long_contents_are_indexed_in_linear_time(spark):
    import time

    from pyspark.sql import functions as F

    from emberline.operators import keyword_index as KI

    rows = [(k, "name", ["tag w7"], " ".join(f"w{i}" for i in range(60_000))) for k in range(2)]
    df = spark.createDataFrame(rows, "id long, name string, tags array<string>, content string")
    start = time.time()
    index = KI.build(df, F.lit(1.0), [])
    assert time.time() - start < 30  # minutes where each word is looked up in the content's list
    got = {r.word: (r.n_name, r.n_content) for r in index.table(spark, "summary").filter("word in ('name', 'tag', 'w7', 'w8')").collect()}
    assert got == {"name": (2, 0), "tag": (2, 0), "w7": (2, 2), "w8": (0, 2)}


def test_pairs_of_a_large_key_are_dealt_to_parts(spark):
    from pyspark.sql import functions as F

    from emberline.operators import ranking

    a = spark.createDataFrame([(k, None if k % 9 == 8 else "x" if k % 9 else "y") for k in range(300)], "a long, key string")
    b = spark.createDataFrame([(k, None if k % 7 == 6 else "x" if k % 7 else "z") for k in range(200)], "b long, key string")
    got = ranking.spread_join(a, b, ["key"], "a", 2_000)
    want = a.join(b, "key")
    assert sorted((r.a, r.b, r.key) for r in got.collect()) == sorted((r.a, r.b, r.key) for r in want.collect())
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 5 and max(r["count"] for r in tasks) < want.count() / 3


def test_topic_score_reads_whole_contents(spark):
    from pyspark.sql import functions as F

    from emberline.functions import similarity as X

    rows = [(0, "z" * 5000 + " src3 the"), (1, "z" * 200_000 + "src3 th"), (2, "z" * 5000), (3, "é漢" * 40_000 + "src3 xthe" + "é" * 70_000)]
    df = spark.createDataFrame([(k, "n", ["z"], ["d"], t) for k, t in rows], "id long, name string, tags array<string>, domain array<string>, content string")
    got = dict(df.select("id", F.round(X.topic_score("src3 the", F.col("name"), F.col("tags"), F.col("domain"), F.col("content")), 6)).collect())
    assert got == {0: 0.8, 1: round(0.8 * 14 / 15, 6), 2: 0.0, 3: 0.7}
    long = "".join(chr(97 + k * k % 23) for k in range(300))
    for n in (8, 9, 33, 64, 65):
        short = long[150 : 150 + n : 2] + "!" * (n // 2)
        windows = [long[max(0, s) : s + len(short)] for s in range(1 - len(short), len(long))]
        assert X.partial_ratio(short, long) == max(X.ratio(short, w) for w in windows)


def test_pairs_of_a_large_key_are_unpacked_from_few_rows(spark):
    from pyspark.sql import functions as F

    from emberline.operators import ranking

    def written() -> int:
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        jvm = sc._gateway.jvm
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    a = spark.range(3000).select(F.col("id").alias("a"), F.lit("x").alias("key"), (F.col("id") % 7).alias("m"))
    b = spark.range(600).select(F.col("id").alias("b"), F.lit("x").alias("key"))
    before = written()
    got = ranking.spread_join(a, b, ["key"], "a", 2_000)
    assert got.columns == ["key", "a", "m", "b"]
    assert got.agg(F.count(F.lit(1)), F.countDistinct("a", "b"), F.sum("m")).first()[:] == (1_800_000, 1_800_000, 600 * sum(k % 7 for k in range(3000)))
    assert written() - before < 1_800_000 + 30_000  # the distinct pairs; 540,000 copies more where only one side is dealt
    for n, k in ((1, 500), (500, 1), (3, 3), (0, 4), (90, 2)):
        one, two = spark.range(n).selectExpr("id a", "id % 2 key"), spark.range(k).selectExpr("id b", "id % 2 key", "array(id) v")
        assert sorted(map(tuple, ranking.spread_join(one, two, ["key"], "a", 50).collect())) == sorted(map(tuple, one.join(two, "key").collect()))
