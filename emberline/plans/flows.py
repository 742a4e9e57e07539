"""Queries that write and read real files and run streams to their end."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import datasources as D
from ..sources import markdown
from ..sources import views as V
from ..streaming import sessions
from .catalog import query

# --- record files (S01 to S04, S23) ------------------------------------------------

SQL_FILE = "'---' || chr(10) || 'id: ' || id || chr(10) || 'name: ' || name || chr(10) || 'type: ' || type || chr(10) || 'world: ' || world || chr(10) || 'domain: [' || domain[1] || ']' || chr(10) || 'importance: ' || importance || chr(10) || 'pinned: ' || pinned || chr(10) || '---' || chr(10) || coalesce(content, '')"


def _store(spark, d) -> str:
    """All records as Markdown files in a folder for each type."""
    D.register(spark)
    path = shared_folder(spark, "record-files")
    m = V.memories(spark, d)
    rows = m.select(F.concat("type", F.lit("/"), F.col("id").cast("string"), F.lit(".md")).alias("path"), markdown.render(m.withColumn("content", F.coalesce("content", F.lit("")))).alias("text"))
    rows.write.format("record_files").mode("append").option("path", path).save()
    return path


@query("s01_record_files", "SELECT id, name, type, world, array_to_string(domain, ',') AS domain, CAST(importance AS INTEGER) AS importance, pinned, md5(ltrim(coalesce(content, ''))) AS body FROM memories WHERE type IN ('permanent', 'dynamic')", ("memories",))
def s01_files(spark, d):
    """Two of the three roots, read back from the files; the third folder isn't listed."""
    files = D.record_files(spark, _store(spark, d), "path string, root string, text string").filter(F.col("root").isin("permanent", "dynamic"))
    r = markdown.records(files.select("path", "text"))
    return r.select(F.col("id").cast("long").alias("id"), "name", "type", F.coalesce("world", F.lit("")).alias("world"), F.array_join("domain", ",").alias("domain"), "importance", "pinned", F.md5(F.col("body").cast("binary")).alias("body"))


@query("s02_file_tokens", f"SELECT type || '/' || id || '.md' AS path, type AS root, CAST(octet_length(encode({SQL_FILE})) AS BIGINT) AS size FROM memories", ("memories",))
def s02_files(spark, d):
    """The listing that a cache is validated by: no file is opened."""
    return D.record_files(spark, _store(spark, d), "path string, root string, size long, modified_ns long").filter("modified_ns > 0").select("path", "root", "size")


@query("s03_file_heads", "SELECT id, name, type, pinned FROM memories", ("memories",))
def s03_files(spark, d):
    """Front matter alone: each file is read up to its closing line."""
    files = D.record_files(spark, _store(spark, d), "path string, head string")
    r = markdown.records(files.select("path", F.col("head").alias("text")))
    return r.filter("not corrupt").select(F.col("id").cast("long").alias("id"), "name", "type", "pinned")


# --- polled messages (S21, R27, R28) ------------------------------------------------


@query("s21_polled_messages", "SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS size FROM conversations")
def s21(spark, d):
    """All turns through a log that is polled: half is there, the stream runs to its end, the rest is
    appended, and a new query takes up the cursor from the checkpoint."""
    D.register(spark)
    c = V.read(spark, d, "conversations")
    folder = shared_folder(spark, "message-log")
    body = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    rows = c.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"), body.alias("body"))
    half = rows.agg((F.max("id") / 2).alias("half")).first()[0] or 0
    for part in (rows.filter(F.col("id") <= half), rows.filter(F.col("id") > half)):
        part.write.format("message_log").mode("append").option("path", f"{folder}/log").save()
        polled = spark.readStream.format("message_log").option("path", f"{folder}/log").load()
        polled.writeStream.format("parquet").option("path", f"{folder}/read").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    read = spark.read.schema("id long, body string").parquet(f"{folder}/read")
    x = F.from_json("body", "conv_id long, turn long, role string, text string")
    return read.select(x.alias("x")).select("x.conv_id", "x.turn", "x.role", F.length("x.text").alias("size"))


# --- replaced segments (S22) -----------------------------------------------------------


@query("s22_replaced_segments", """SELECT vec_id AS id, CAST(k AS INTEGER) AS segment, CAST(CASE WHEN vec_id % 3 = 0 THEN 32 ELSE 16 END AS INTEGER) AS size,
  round(list_sum(list_transform(embedding[k * CASE WHEN vec_id % 3 = 0 THEN 32 ELSE 16 END + 1 : (k + 1) * CASE WHEN vec_id % 3 = 0 THEN 32 ELSE 16 END], lambda x: x::DOUBLE)), 6) AS total
FROM embeddings, range(4) r(k) WHERE NOT (vec_id % 3 = 0 AND k >= 2) AND NOT (vec_id % 3 <> 0 AND vec_id % 7 = 0)""")
def s22_replaced(spark, d):
    """Four segments for each vector; a write that fails in one task; then thirds are replaced by two longer segments
    and some ids lose theirs. What is read is the last commit of each id, nothing of the failed one."""
    path = shared_folder(spark, "segment-store")
    v = V.vectors(spark, d)

    def cut(size: int):
        parts = F.expr(f"transform(sequence(0, cast(size(vec) / {size} as int) - 1), i -> struct(cast(i as int) as segment, slice(vec, i * {size} + 1, {size}) as vec))")
        return v.select("id", F.explode(parts).alias("p")).select("id", "p.*", F.lit("").alias("body"))

    D.replace_segments(cut(16), path)
    broken = cut(8).withColumn("body", F.when(F.col("id") % 97 == 1, F.raise_error(F.lit("made to fail"))).otherwise(F.lit("x")))
    try:
        D.replace_segments(broken, path)
    except Exception as e:
        if "made to fail" not in str(e):
            raise
    gone = v.filter("id % 3 <> 0 and id % 7 = 0").select("id", F.lit(D.GONE).alias("segment"), F.array().cast("array<double>").alias("vec"), F.lit(None).cast("string").alias("body"))
    D.replace_segments(cut(32).filter("id % 3 = 0").unionByName(gone), path)
    return D.segments(spark, path).select("id", "segment", F.size("vec").alias("size"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


# --- pages until exhausted (T14), session keys (T06) --------------------------------------

PIECE = 200


@query("t14_persisted_pages", f"SELECT conv_id, turn, CAST(k AS INTEGER) AS piece, CAST(length(substr(text, CAST(k * {PIECE} + 1 AS BIGINT), {PIECE})) AS INTEGER) AS size FROM conversations, range(100000) r(k) WHERE k * {PIECE} < length(text)")
def t14_persisted(spark, d):
    """Turns page by page: a page is exploded to pieces and stored, then the cursor moves, until nothing is left.
    The second page's first attempt fails between the two steps; the restarted query replays it."""
    folder = shared_folder(spark, "pages")
    c = V.read(spark, d, "conversations").select("conv_id", "turn", "text")
    c.repartitionByRange(4, "conv_id", "turn").write.parquet(f"{folder}/in")

    def pieces(page):
        starts = F.expr(f"sequence(0, cast((length(text) - 1) div {PIECE} as int))")
        one = page.filter(F.length("text") > 0).select("conv_id", "turn", "text", F.explode(starts).alias("piece"))
        return one.select("conv_id", "turn", "piece", F.expr(f"length(substring(text, piece * {PIECE} + 1, {PIECE}))").alias("size"))

    def put(uri: str, data: bytes) -> None:
        fs, path = D.open_folder(uri)
        D.write_atomic(fs, path, data)

    step = sessions.persist_pages(pieces, f"{folder}/out", f"{folder}/cursor", put, [1])
    pages = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for _ in range(2):
        run = pages.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        try:
            run.awaitTermination()
            break
        except StreamingQueryException as e:
            if "made to fail" not in str(e):
                raise
    return spark.read.schema("conv_id long, turn long, piece int, size int").parquet(*[f"{folder}/out/batch={b}" for b in range(_stored(f"{folder}/cursor") + 1)])


def _stored(uri: str) -> int:
    fs, path = D.open_folder(uri)
    with fs.open_input_stream(path) as f:
        return int(f.read())


@query("t06_session_stream", "SELECT user_id AS session, event_id AS key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 2 DAY) WHERE rn <= 1024")
def t06_stream(spark, d):
    """Each user's newest events as session state: three slices of time arrive in turn, each taken up from the
    checkpoint; then what is live."""
    folder = shared_folder(spark, "session-keys")
    e = V.read(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    low, high = e.agg(F.min(F.unix_micros("at")), F.max(F.unix_micros("at"))).first()
    slice_ = F.least(F.floor((F.unix_micros("at") - (low or 0)) * 3 / max(1, (high or 0) - (low or 0))), F.lit(2))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, sessions.ROCKS)
    try:
        for k in range(3):
            e.filter(slice_ == k).write.mode("append").parquet(f"{folder}/in")
            marks = spark.readStream.schema(e.schema).parquet(f"{folder}/in")
            keys = sessions.newest_keys(marks).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
            keys.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)
    changes = spark.read.schema(sessions.CHANGES).parquet(f"{folder}/out")
    return sessions.live_keys(changes).select("session", "key", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))
