"""Record files, the message log and the segment store; session keys and pages in streams."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberline.sources import datasources as D
from emberline.streaming import sessions


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/store"


def test_record_files(spark, folder, monkeypatch):
    D.register(spark)
    texts = {"a/1.md": "---\nid: 1\n---\nbody é\n---\nmore", "a/2.md": "no front matter", "b/3.md": "", "b/c/4.md": "---\nid: 4\nname: " + "n" * 9000 + "\n---\n" + "x" * 20_000}
    spark.createDataFrame(list(texts.items()), "path string, text string").repartition(3).write.format("record_files").mode("append").option("path", folder).save()
    assert {r.path: r.text for r in D.record_files(spark, folder, "path string, text string").collect()} == texts
    assert not [f for f in os.listdir(folder[7:] + "/a") if not f.endswith(".md")]
    heads = {r.path: r.head for r in D.record_files(spark, folder, "path string, head string").collect()}
    assert heads["a/1.md"] == "---\nid: 1\n---\n" and heads["a/2.md"] == "no front matter" and heads["b/3.md"] == "" and heads["b/c/4.md"].endswith("n\n---\n")
    sizes = D.record_files(spark, folder, "path string, root string, size long, modified_ns long").filter("root = 'b'")
    assert {r.path: r.size for r in sizes.collect()} == {"b/3.md": 0, "b/c/4.md": len(texts["b/c/4.md"])}
    reader = D.RecordReader(folder, ["path"], "")
    assert list(reader.pushFilters([D.In(("root",), ("a", "z")), D.EqualTo(("path",), "x")])) == [D.EqualTo(("path",), "x")]
    assert [n for p in reader.partitions() for n, _, _ in p.names] == [f"{folder[7:]}/a/1.md", f"{folder[7:]}/a/2.md"]  # the other folder isn't listed
    monkeypatch.setattr(D, "PART_FILES", 1)
    assert len(D.RecordReader(folder, ["path"], "").partitions()) == 4
    assert D.record_files(spark, folder + "/none", "path string").count() == 0


def test_a_torn_record_is_never_seen(folder):
    fs, base = D.open_folder(folder)
    D.write_atomic(fs, f"{base}/a/1.md", b"old")

    with pytest.raises(TypeError):
        D.write_atomic(fs, f"{base}/a/1.md", None)
    assert [(f.path.rpartition("/")[2], f.size) for f in D.files_below(folder, ".md")] == [("1.md", 3)]


def test_log_offsets_and_ranges(folder):
    w = D.LogWriter(folder)
    w.MOST = 3
    row = lambda i: type("R", (), {"id": i, "body": json.dumps({"i": i})})()
    w.write(iter([row(i) for i in (1, 2, 3, 5, 8)]))
    s = D.LogStream(folder, -1)
    assert s.initialOffset() == {"id": -1} and s.latestOffset() == {"id": 8}
    read = lambda a, b: sorted(i for p in s.partitions({"id": a}, {"id": b}) for i, _ in s.read(p))
    assert read(-1, 8) == [1, 2, 3, 5, 8] and read(2, 5) == [3, 5] and read(8, 8) == [] and len(s.partitions({"id": -1}, {"id": 8})) == 2
    w.write(iter([row(9)]))
    assert s.latestOffset() == {"id": 9} and read(8, 9) == [9]
    assert D.LogStream(folder + "/none", 4).latestOffset() == {"id": 4}


def test_segments_are_replaced_whole(spark, folder):
    rows = lambda data: spark.createDataFrame(data, "id long, segment int, vec array<double>, body string").repartition(3)
    got = lambda: sorted((r.id, r.segment, r.vec, r.body) for r in D.segments(spark, folder).collect())
    D.replace_segments(rows([(1, 0, [1.0], "a"), (1, 1, [2.0], "a"), (2, 0, [3.0], None)]), folder)
    first = got()
    assert len(first) == 3
    bad = rows([(1, 0, [9.0], "b"), (2, 0, [9.0], "boom"), (3, 0, [9.0], "b")]).withColumn("body", F.when(F.col("body") == "boom", F.raise_error(F.lit("boom"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="boom"):
        D.replace_segments(bad, folder)
    assert got() == first and len(D.manifests(folder)) == 1
    D.replace_segments(rows([(1, 0, [4.0, 5.0], "c"), (2, D.GONE, [], None)]), folder)
    assert got() == [(1, 0, [4.0, 5.0], "c")]
    D.replace_segments(rows([]), folder)
    assert got() == [(1, 0, [4.0, 5.0], "c")] and [n for n, _ in D.manifests(folder)] == [1, 2, 3]


def test_session_keys_in_a_stream(spark, tmp_path):
    """Eviction beyond the newest keys, expiry by time, keys marked again, over several micro-batches."""
    days = lambda x: (pd.Timestamp("2024-01-01") + pd.Timedelta(days=x)).to_pydatetime()
    batches = [[(1, 10, 0.0), (1, 11, 0.5), (2, 20, 0.1)], [(1, 12, 1.0), (1, 13, 1.1), (1, 10, 1.2), (None, 7, 1.2)], [(2, 21, 2.5), (2, 20, 2.4)], [(3, 30, 3.2)]]
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.ROCKS)
    try:
        for rows in batches:
            spark.createDataFrame([(s, k, days(t)) for s, k, t in rows], "session long, key long, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            marks = spark.readStream.schema("session long, key long, at timestamp").parquet(f"{tmp_path}/in").filter("session is not null")
            sessions.newest_keys(marks, 3, 2).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    finally:
        if old is not None:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    changes = spark.read.schema(sessions.CHANGES).parquet(f"{tmp_path}/out")
    assert sorted((r.session, r.key) for r in sessions.live_keys(changes).collect()) == [(2, 20), (2, 21), (3, 30)]
    told = {(r.session, r.key, r.op) for r in changes.collect()}
    assert (1, 11, "drop") in told and (1, 13, "drop") in told and (1, 10, "drop") in told


def test_a_replayed_page_neither_loses_nor_repeats(spark, tmp_path):
    cursor: dict[str, bytes] = {}
    step = sessions.persist_pages(lambda p: p.select(F.explode(F.sequence(F.lit(1), F.col("id"))).alias("n")), f"{tmp_path}/out", "cursor", cursor.__setitem__, [1])
    page = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    step(page(1, 2), 0)
    with pytest.raises(RuntimeError):
        step(page(3), 1)
    assert cursor == {"cursor": b"0"}
    step(page(3), 1)
    assert cursor == {"cursor": b"1"} and sorted(r.n for r in spark.read.schema("n int").parquet(f"{tmp_path}/out").collect()) == [1, 1, 1, 2, 2, 3]
