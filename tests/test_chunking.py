"""Chunking, parsing and string similarity against plain models."""

import json
import random

import pytest

from emberline.functions.similarity import lcs, partial_ratio, ratio
from emberline.operators import chunking
from emberline.sources import exports


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_ratio():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abcé") for _ in range(r.randrange(12))) for _ in range(2))
        assert lcs(a, b) == plain_lcs(a, b)
        assert ratio(a, b) == (200 * plain_lcs(a, b) / (len(a) + len(b)) if a or b else 100)
    assert partial_ratio("abc", "xxabcxx") == 100 and partial_ratio("", "a") == 0 and partial_ratio("abd", "xxabcxx") < 100


def test_line_chunks():
    text = "\n".join(["a" * 10, "b" * 10, "", "c" * 45, "d" * 5, "e" * 14])
    assert chunking.line_chunks_of(text, 20, 10) == ["a" * 10, "b" * 10, "c" * 20, "c" * 20, "c" * 5, "d" * 5 + "\n" + "e" * 14]
    assert chunking.line_chunks_of("  ") == [] and chunking.line_chunks_of(" x ") == ["x"]
    assert len(chunking.line_chunks_of("x\n" * 5000, 20, 10)) == 10


def test_utf8_parts():
    data = "aé漢😀" * 9
    parts = chunking.utf8_parts_of(data.encode(), 5)
    assert b"".join(parts) == data.encode() and all(len(p) <= 5 and p.decode() for p in parts)
    with pytest.raises(ValueError):
        chunking.utf8_parts_of("漢".encode(), 2)


def test_turn_chunks(spark):
    turns = [(1, t, "user", "word " * n) for t, n in enumerate([10, 10, 100, 10, 10, 10, 10])] + [(2, 0, "assistant", "x"), (2, 1, "user", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = [(r.conv_id, r.chunk, r.first_turn, r.last_turn) for r in chunking.turn_chunks(df, 60).orderBy("conv_id", "chunk").collect()]
    assert got == [(1, 0, 0, 1), (1, 1, 2, 2), (1, 2, 3, 5), (1, 3, 6, 6), (2, 0, 0, 1)]


def test_exports(spark):
    flat = {"chat_messages": [{"sender": "human", "text": " hi ", "created_at": "t1"}, {"sender": "assistant", "text": "  "}, {"role": "assistant", "content": "yes"}]}
    tree = {"mapping": {"b": {"message": {"create_time": 20.0, "author": {"role": "assistant"}, "content": {"parts": ["two", "", "parts"]}}}, "a": {"message": {"create_time": 10.0, "author": {"role": "user"}, "content": {"parts": ["one"]}}}, "r": {"message": None}}}
    frame = lambda *rows, name: spark.createDataFrame(list(enumerate(rows)), f"conv long, {name} string")
    got = [(r.role, r.content, r.ts) for r in exports.message_lists(frame(json.dumps(flat), name="json")).orderBy("pos").collect()]
    assert got == [("human", "hi", "t1"), ("assistant", "yes", "")]
    got = [(r.pos, r.role, r.content) for r in exports.message_trees(frame(json.dumps(tree), name="json")).orderBy("pos").collect()]
    assert got == [(0, "user", "one"), (1, "assistant", "two parts")]
    text = "before\nUser: hello\nmore\nAssistant: there\nHuman:\nlast"
    got = [(r.conv, r.role, r.content) for r in exports.plain_text(frame(text, "no prefix at all", name="text")).orderBy("conv", "pos").collect()]
    assert got == [(0, "user", "before"), (0, "user", "hello\nmore"), (0, "assistant", "there"), (0, "user", "last"), (1, "user", "no prefix at all")]


def test_greedy_clusters(spark):
    rows = [(1, "2024-01-10", [1.0, 0.0]), (2, "2024-01-09", [1.0, 0.1]), (3, "2024-01-01", [1.0, 0.0]), (4, "2024-01-08", [0.0, 1.0]), (5, "2024-01-08", [0.9, 0.1])]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "id long, ts string, vec array<double>").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [(r.seed, r.id) for r in chunking.greedy_clusters(df, 0.9, 3.0, 2, 12).collect()]
    assert got == [(1, 1), (1, 2), (1, 5)]


def test_greedy_clusters_of_stretches_and_old_rows(spark):
    from pyspark.sql import functions as F

    from emberline.plans.catalog import QUERIES

    days = [0.0, 2.0, 4.0, 20.0, 22.9, 26.0]
    df = spark.createDataFrame([(k, float(d), [1.0, 0.0]) for k, d in enumerate(days)], "id long, day double, vec array<double>")
    df = df.select("id", F.timestamp_micros((F.col("day") * 86_400_000_000).cast("long")).alias("ts"), "vec")
    got = sorted((r.seed, r.id) for r in chunking.greedy_clusters(df, 0.9, 3.0, 2, 12).collect())
    assert got == [(2, 1), (2, 2), (4, 3), (4, 4)]
    d = "/root/testdata/sf0.1"
    newest = spark.read.parquet(f"{d}/embeddings.parquet").selectExpr("vec_id as id").orderBy(F.desc(F.col("id") % 720), "id").limit(500)
    assert QUERIES["w05_greedy_clusters"](spark, d).join(newest, "id", "left_anti").count() > 0


def test_line_chunks_hold_the_whole_text(spark):
    from pyspark.sql import functions as F

    lines = [f"{k} " + "w" * (k * 7 % 90) for k in range(400)] + ["x" * 3000]
    text = "\n".join(lines)
    got = chunking.line_chunks_of(text, 100)
    assert len(got) > 100 and all(len(c) <= 100 for c in got) and "".join(got).replace("\n", "") == "".join(x.strip() for x in lines)
    df = spark.createDataFrame([(text,), (None,)], "text string")
    assert [r.c for r in df.select(chunking.line_chunks(F.col("text")).alias("c")).collect()] == [chunking.line_chunks_of(text, 1200), None]
    assert len(chunking.line_chunks_of(text)) > 10
