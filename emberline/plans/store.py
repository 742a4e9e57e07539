"""Queries of the store: its sources, writes, state machines, entities and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import scoring as S
from ..operators import entities as E
from ..operators import ledger, patrol, ranking, timeline, writes
from ..sources import jsonl, markdown
from ..sources import views as V
from .catalog import QUERY_VECTOR, SQL_QUERY, SQL_REF, _age, _sql_age, case, query

i = lambda: F.col("id")
N = lambda: F.count(F.lit(1))

# --- sources ----------------------------------------------------------------


def _files(spark, d):
    """Records as files; every 40th lost its front matter, every 41st holds an illegal key."""
    m = V.memories(spark, d)
    whole = markdown.render(m)
    text = F.when(i() % 40 == 7, F.col("content")).when(i() % 41 == 3, F.regexp_replace(whole, "^---\n", "---\ncontent: broken\nname: 'first'\n")).otherwise(whole)
    return m.select(F.concat(F.col("type"), F.lit("/"), i().cast("string"), F.lit(".md")).alias("path"), text.alias("text"))


SQL_LIVE = "SELECT CAST(id AS VARCHAR) AS id, name, type, nullif(world, '') AS world, domain, CAST(importance AS INTEGER) AS importance, pinned, md5(ltrim(content, ' ')) AS digest FROM memories WHERE id % 40 <> 7"


@query("s01_markdown_scan", SQL_LIVE, ("memories",), lists=("domain",))
def s01(spark, d):
    r = markdown.records(_files(spark, d)).filter(~F.col("corrupt"))
    return r.select("id", "name", "type", "world", "domain", "importance", "pinned", F.md5(F.col("body").cast("binary")).alias("digest"))


@query("s03_front_matter", "SELECT type || '/' || id || '.md' AS path, id % 40 = 7 AS corrupt, CASE WHEN id % 40 <> 7 THEN name END AS name FROM memories", ("memories",))
def s03(spark, d):
    return markdown.records(_files(spark, d)).select("path", "corrupt", "name")


@query("s04_parsed_rows", "SELECT type, count(*) AS n FROM memories WHERE id % 40 <> 7 GROUP BY 1", ("memories",))
def s04(spark, d):
    return markdown.records(_files(spark, d)).filter(~F.col("corrupt") & F.col("id").isNotNull()).groupBy("type").agg(N().alias("n"))


@query("s05_point_lookup", "SELECT id, name FROM memories WHERE id = 17", ("memories",))
def s05(spark, d):
    return V.memories(spark, d).filter(i() == 17).select("id", "name")


@query("s06_two_sources", "SELECT CASE WHEN id % 40 = 7 THEN 'broken' ELSE 'md' END AS source, count(*) AS n FROM memories GROUP BY 1 UNION ALL SELECT 'json', count(*) FROM events", ("memories",))
def s06(spark, d):
    md = markdown.records(_files(spark, d)).select("id", "name", F.when(F.col("corrupt"), "broken").otherwise("md").alias("source"))
    js = V.read(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.lit("json").alias("source"))
    return md.unionByName(js, allowMissingColumns=True).groupBy("source").agg(N().alias("n"))


@query("u01_roots", "SELECT type AS root, count(*) AS n FROM memories WHERE type IN ('dynamic', 'feel') GROUP BY 1", ("memories",))
def u01(spark, d):
    m = V.memories(spark, d).select("id", "type")
    return m.filter("type = 'dynamic'").unionByName(m.filter("type = 'feel'")).groupBy(F.col("type").alias("root")).agg(N().alias("n"))


def _lines(spark, d):
    """Events as JSON lines; every 50th is cut short, every 77th lacks its key."""
    e = V.read(spark, d, "events")
    whole = F.to_json(F.struct("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.when(F.col("event_id") % 2 == 0, "user").otherwise("assistant").alias("role")))
    k = F.col("event_id")
    return e.select(F.when(k % 50 == 9, F.substring(whole, 1, 12)).when(k % 77 == 5, '{"event_type": "view"}').otherwise(whole).alias("line"))


LINE = "event_id long, event_type string, ts string, role string"


@query("s14_log_days", "SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE event_id % 50 <> 9 AND event_id % 77 <> 5 AND event_id % 2 = 0 AND ts + INTERVAL 8 HOUR >= TIMESTAMP '2024-01-05' GROUP BY 1")
def s14(spark, d):
    local = F.convert_timezone(F.lit("UTC"), F.lit(DEFAULTS.zone), F.col("ts").cast("timestamp_ntz"))
    rows = jsonl.lenient(_lines(spark, d), LINE, "event_id").filter("role = 'user'").withColumn("local", local)
    return rows.filter(F.col("local") >= F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")).groupBy(F.date_format("local", "yyyy-MM-dd").alias("day")).agg(N().alias("n"))


@query("s14_malformed", "SELECT count(*) FILTER (event_id % 50 = 9 OR event_id % 77 = 5) AS malformed, count(*) AS lines FROM events")
def s14_bad(spark, d):
    return jsonl.parsed(_lines(spark, d), LINE, "event_id").agg(F.count_if("_bad").alias("malformed"), N().alias("lines"))


@query("s15_strict_lines", "SELECT event_id, event_type FROM events")
def s15(spark, d):
    e = V.read(spark, d, "events").select(F.to_json(F.struct("event_id", "event_type")).alias("line"))
    return jsonl.strict(e, "event_id long, event_type string", "event_id")


@query("s16_pending", "SELECT event_id FROM events WHERE event_id % 50 <> 9 AND event_id % 77 <> 5 AND event_type = 'error' AND event_id % 2 = 0")
def s16(spark, d):
    return jsonl.lenient(_lines(spark, d), LINE, "event_id").filter("event_type = 'error' and role = 'user'").select("event_id")


@query("s17_lenient_lines", "SELECT event_type, count(*) AS n FROM events WHERE event_id % 50 <> 9 AND event_id % 77 <> 5 GROUP BY 1")
def s17(spark, d):
    return jsonl.lenient(_lines(spark, d), LINE, "event_id").groupBy("event_type").agg(N().alias("n"))


@query("s27_inbox", "SELECT event_id FROM events WHERE event_id % 50 <> 9 AND event_id % 77 <> 5 AND event_id > 150 ORDER BY event_id LIMIT 25")
def s27(spark, d):
    return jsonl.lenient(_lines(spark, d), LINE, "event_id").filter("event_id > 150").orderBy("event_id").limit(25).select("event_id")


@query("k14_last_unread", "SELECT event_id FROM events WHERE event_id % 50 <> 9 AND event_id % 77 <> 5 AND event_id % 2 = 1 ORDER BY event_id DESC LIMIT 20")
def k14(spark, d):
    return jsonl.lenient(_lines(spark, d), LINE, "event_id").filter("role = 'assistant'").orderBy(F.desc("event_id")).limit(20).select("event_id")


@query("r28_cursor_read", "SELECT event_id FROM events WHERE event_id > coalesce((SELECT max(event_id) FROM events WHERE event_id = 42), -1)")
def r28(spark, d):
    e = V.read(spark, d, "events").select("event_id")
    cursor = e.filter("event_id = 42").agg(F.coalesce(F.max("event_id"), F.lit(-1)).alias("c"))  # one row
    return e.join(F.broadcast(cursor), F.col("event_id") > F.col("c")).select("event_id")


@query("s10_export_format", "SELECT id, CASE id % 6 WHEN 0 THEN 'chat_messages' WHEN 1 THEN 'mapping' WHEN 2 THEN 'messages' WHEN 3 THEN 'turns' WHEN 4 THEN 'markdown' ELSE 'text' END AS format FROM memories", ("memories",))
def s10(spark, d):
    k = i() % 6
    raw = F.when(k == 0, '[{"chat_messages": []}]').when(k == 1, '{"mapping": {"a": 1}}').when(k == 2, '{"messages": [1]}').when(k == 3, '[{"role": "user"}]').when(k == 4, "# Title\ntext").otherwise("user: hello")
    return V.memories(spark, d).select("id", jsonl.export_format(raw).alias("format"))


@query("s18_curated_scan", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN type = 'feel' THEN 'type' WHEN length(content) < 200 THEN 'short' WHEN id % 3 = 0 THEN 'timezone_missing' ELSE 'kept' END AS reason FROM memories) GROUP BY 1", ("memories",))
def s18(spark, d):
    from ..functions.dates import canonical_utc

    said = F.concat(F.date_format("event_at", "yyyy-MM-dd'T'HH:mm:ss"), F.when(i() % 3 == 0, "").otherwise("Z"))
    reason = F.when(F.col("type") == "feel", "type").when(F.length("content") < 200, "short").otherwise(F.coalesce(canonical_utc(said)["error"], F.lit("kept")))
    return V.memories(spark, d).groupBy(reason.alias("reason")).agg(N().alias("n"))


@query("s19_candidates_by_digest", "SELECT user_id, count(DISTINCT event_type) > 1 AS conflict, min(event_id) AS first FROM events WHERE value > 50 GROUP BY 1")
def s19(spark, d):
    e = V.read(spark, d, "events").filter("value > 50")
    return e.groupBy("user_id").agg((F.min("event_type") != F.max("event_type")).alias("conflict"), F.min("event_id").alias("first"))


@query("s20_candidate_page", "SELECT event_id, event_type FROM events WHERE event_type = 'view' AND event_id > 100 ORDER BY event_id LIMIT 60")
def s20(spark, d):
    return V.read(spark, d, "events").filter("event_type = 'view' and event_id > 100").orderBy("event_id").limit(60).select("event_id", "event_type")


@query("s28_thread_hints", "SELECT o_orderkey, min(l_linestatus) AS hint FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING min(l_linestatus) = max(l_linestatus)")
def s28(spark, d):
    li = V.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linestatus").alias("hint"), F.max("l_linestatus").alias("b")).filter("hint = b")
    return li.join(V.read(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi").select("o_orderkey", "hint")


@query("s22_segment_rows", "SELECT vec_id AS id, CAST(k AS INTEGER) AS segment, round(embedding[16 * k + 1]::DOUBLE, 6) AS first FROM embeddings, range(4) r(k)")
def s22(spark, d):
    v = V.read(spark, d, "embeddings")
    cut = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("embedding", k * 16 + 1, 16))
    return v.select(F.col("vec_id").alias("id"), F.posexplode(cut).alias("segment", "part")).select("id", "segment", F.round(F.col("part")[0].cast("double"), 6).alias("first"))


@query("m19_segment_similarity", "SELECT id, round(greatest(0.0, max(list_cosine_similarity(v.vec[16 * a + 1 : 16 * a + 16], q.vec[16 * b + 1 : 16 * b + 16]))), 6) AS sim FROM vectors v, range(4) x(a), range(2) y(b), (SELECT vec FROM vectors WHERE id = 3) q GROUP BY id", ("vectors",))
def m19(spark, d):
    from ..functions.scoring import segment_similarity

    v = V.vectors(spark, d)
    one = v.filter("id = 3").select(F.col("vec").alias("q")).limit(1)  # one row
    cut = lambda c, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.slice(c, k * 16 + 1, 16))
    return v.crossJoin(F.broadcast(one)).select("id", F.round(segment_similarity(cut("vec", 4), cut("q", 2)), 6).alias("sim"))


# --- writes -----------------------------------------------------------------


@query("s24_create", "SELECT id, CASE WHEN type = 'feel' OR id % 4 = 0 THEN nm ELSE nm || '_2024-02-01' END AS name, CASE WHEN type = 'feel' THEN [thread] ELSE [thread, '2024-02-01'] END AS tags, CASE WHEN id % 7 = 0 THEN ['unsorted'] ELSE domain END AS domain, CASE WHEN pinned OR protected THEN 10 WHEN id % 5 = 0 THEN 5 ELSE CAST(least(10, importance + 4) AS INTEGER) END AS importance, CASE WHEN pinned THEN 'permanent' ELSE type END AS type, CASE WHEN id % 5 = 0 THEN 0.5 ELSE least(1.0, valence * 2) END AS valence FROM (SELECT *, CASE WHEN id % 4 = 0 THEN name || ' 2024-01-01' ELSE name END AS nm FROM memories)", ("memories",), lists=("tags", "domain"))
def s24(spark, d):
    m = V.memories(spark, d)
    given = m.select(
        "id", F.when(i() % 4 == 0, F.concat("name", F.lit(" 2024-01-01"))).otherwise(F.col("name")).alias("name"), F.array("thread").alias("tags"), F.when(i() % 7 == 0, F.array().cast("array<string>")).otherwise(F.col("domain")).alias("domain"),
        F.when(i() % 5 != 0, F.col("valence") * 2).alias("valence"), "arousal", F.when(i() % 5 != 0, F.col("importance") + 4).alias("importance"), "type", "pinned", "protected", "content",
    )
    return writes.created(given, V.ref()).select("id", "name", "tags", "domain", "importance", "type", "valence")


@query("q04_merge", "SELECT id, CASE WHEN id % 3 = 0 THEN list_distinct(list_concat(tags, ['new', tags[1]])) ELSE tags END = tags AS same_tags, CASE WHEN id % 3 = 0 THEN greatest(importance, 6) ELSE importance END AS importance, CASE WHEN id % 3 = 0 THEN round_even((valence + 0.5137) / 2, 2) ELSE valence END AS valence, id % 3 = 0 AS merged FROM memories", ("memories",))
def q04(spark, d):
    m = V.memories(spark, d).select("id", "tags", "domain", "importance", "valence", "arousal")
    new = m.filter("id % 3 = 0").select("id", F.array(F.lit("new"), F.element_at("tags", 1)).alias("tags"), "domain", F.lit(6).cast("long").alias("importance"), F.lit(0.5137).alias("valence"), F.lit(0.5).alias("arousal"))
    done = writes.merged(m, new).join(m.select("id", F.col("tags").alias("old")), "id")
    return done.select("id", (F.col("tags") == F.col("old")).alias("same_tags"), "importance", F.round("valence", 2).alias("valence"), "merged")


@query("q05_merge_target", "WITH c AS (SELECT a.id AS incoming, b.id, (b.id * 37 % 101)::DOUBLE AS keyword, (b.id * 53 % 101) / 100.0::DOUBLE AS vector, b.pinned OR b.protected AS held FROM memories a JOIN edges e ON e.source = a.id JOIN memories b ON b.id = e.target), o AS (SELECT *, row_number() OVER (PARTITION BY incoming ORDER BY keyword DESC, vector DESC, id) AS rn FROM c WHERE NOT held AND (keyword > 85 OR vector >= 0.78)) SELECT m.id AS incoming, o.id AS target FROM memories m LEFT JOIN o ON o.incoming = m.id AND rn = 1 WHERE m.id IN (SELECT source FROM edges)", ("memories", "edges"))
def q05(spark, d):
    m = V.memories(spark, d).select(i().alias("target"), (F.col("pinned") | F.col("protected")).alias("held"))
    pairs = V.edges(spark, d).select(F.col("source").alias("incoming"), "target").join(m, "target")
    c = pairs.select("incoming", F.col("target").alias("id"), (F.col("target") * 37 % 101).cast("double").alias("keyword"), ((F.col("target") * 53 % 101) / F.lit(100.0)).alias("vector"), "held")
    return writes.merge_targets(V.edges(spark, d).select(F.col("source").alias("incoming")).distinct(), c, DEFAULTS.merge_keyword, DEFAULTS.merge_vector)


@query("r03_edit", "SELECT id, CASE WHEN id % 6 = 0 THEN 'edited' WHEN id % 6 = 3 THEN 'stale' ELSE 'none' END AS outcome, CASE WHEN id % 6 = 0 THEN 'renamed' ELSE name END AS name, importance FROM memories", ("memories",))
def r03(spark, d):
    m = V.memories(spark, d).select("id", "name", "importance", "domain", "resolved", F.md5(F.col("name").cast("binary")).alias("rev"))
    edits = m.filter("id % 3 = 0").select("id", F.when(i() % 6 == 0, F.col("rev")).otherwise("other").alias("expected"), F.lit("renamed").alias("name"), F.lit(None).cast("long").alias("importance"), F.lit(None).cast("boolean").alias("resolved"))
    return writes.edited(m, edits, ["name", "importance", "resolved"], "rev").select("id", "outcome", "name", "importance")


@query("r04_set_thread", "SELECT id, CASE WHEN id % 4 = 0 THEN 'moved' ELSE thread END AS thread FROM memories", ("memories",))
def r04(spark, d):
    m = V.memories(spark, d).select("id", "thread", "domain", F.lit("r1").alias("rev"))
    edits = m.filter("id % 4 = 0").select("id", F.lit("r1").alias("expected"), F.lit("moved").alias("thread"))
    return writes.edited(m, edits, ["thread"], "rev").select("id", "thread")


@query("r05_archive", "SELECT CASE WHEN id % 9 = 0 THEN 'archive/' || domain[1] WHEN type = 'feel' THEN 'feel/sediment' ELSE type || '/' || domain[1] END AS root, count(*) AS n FROM memories GROUP BY 1", ("memories",))
def r05(spark, d):
    kind = F.when(i() % 9 == 0, "archived").otherwise(F.col("type"))
    return V.memories(spark, d).groupBy(writes.rooted(kind, F.col("domain")).alias("root")).agg(N().alias("n"))


@query("r06_delete", "SELECT id FROM memories WHERE id NOT IN (SELECT target FROM edges WHERE type = 'causes')", ("memories", "edges"))
def r06(spark, d):
    return V.memories(spark, d).select("id").join(V.edges(spark, d).filter("type = 'causes'").select(F.col("target").alias("id")), "id", "left_anti")


@query("r08_cached_summaries", "SELECT id, CASE WHEN id % 4 = 0 THEN 'cached' WHEN id % 4 = 1 THEN 'stale' ELSE 'missing' END AS source FROM memories", ("memories",))
def r08(spark, d):
    m = V.memories(spark, d).select("id", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    cache = m.filter("id % 4 < 2").select("id", F.when(i() % 4 == 0, F.col("digest")).otherwise("old").alias("held"))
    met = m.join(cache, "id", "left")
    return met.select("id", F.when(F.col("held") == F.col("digest"), "cached").when(F.col("held").isNotNull(), "stale").otherwise("missing").alias("source"))


@query("r19_summary_or_lead", "SELECT id, CASE WHEN id % 4 = 0 THEN 'summary' ELSE md5(substr(content, 1, 300)) END AS shown FROM memories", ("memories",))
def r19(spark, d):
    valid = i() % 4 == 0
    return V.memories(spark, d).select("id", F.when(valid, "summary").otherwise(F.md5(F.substring("content", 1, 300).cast("binary"))).alias("shown"))


ALLOWED = [("pending", "ready"), ("pending", "rejected"), ("ready", "applied"), ("ready", "rejected")]
SQL_ALLOWED = "(VALUES ('pending', 'ready'), ('pending', 'rejected'), ('ready', 'applied'), ('ready', 'rejected')) a(f, t)"


@query("t08_transition", f"WITH s AS (SELECT id AS key, CASE id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'ready' ELSE 'applied' END AS status, CASE WHEN id % 5 = 0 THEN 'pending' END AS expected, CASE WHEN id % 2 = 0 THEN 'applied' ELSE 'rejected' END AS wanted FROM memories) SELECT key, CASE WHEN expected <> status THEN 'stale' WHEN status = wanted THEN 'replayed' WHEN NOT EXISTS (SELECT 1 FROM {SQL_ALLOWED} WHERE f = status AND t = wanted) THEN 'refused' ELSE 'moved' END AS outcome, CASE WHEN (expected IS NULL OR expected = status) AND status <> wanted AND EXISTS (SELECT 1 FROM {SQL_ALLOWED} WHERE f = status AND t = wanted) THEN wanted ELSE status END AS status FROM s", ("memories",))
def t08(spark, d):
    m = V.memories(spark, d).select(i().alias("key"))
    k = F.col("key")
    state = m.select("key", F.when(k % 3 == 0, "pending").when(k % 3 == 1, "ready").otherwise("applied").alias("status"))
    asked = m.select("key", F.when(k % 5 == 0, "pending").alias("expected"), F.when(k % 2 == 0, "applied").otherwise("rejected").alias("to"))
    return writes.transition(state, asked, spark.createDataFrame(ALLOWED, "from string, to string"))


@query("t10_run_history", "WITH s AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 + CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END AS seq, o_orderstatus AS stage FROM orders), l AS (SELECT *, lag(stage) OVER w AS before, row_number() OVER w - 1 AS place FROM s WINDOW w AS (PARTITION BY run ORDER BY seq)), p AS (SELECT run, seq, CASE WHEN place <> seq THEN 'gap' WHEN place = 0 AND stage <> 'O' THEN 'start' WHEN place > 0 AND before || stage NOT IN ('OO', 'OF', 'OP', 'FF', 'PF') THEN 'transition' END AS problem FROM l) SELECT run, min_by(problem, seq) AS problem FROM p WHERE problem IS NOT NULL GROUP BY run")
def t10(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    seq = F.row_number().over(w) - 1 + F.when(F.col("o_custkey") % 7 == 0, 1).otherwise(0)
    stages = V.read(spark, d, "orders").select(F.col("o_custkey").alias("run"), seq.alias("seq"), F.col("o_orderstatus").alias("stage"))
    allowed = spark.createDataFrame([("O", "O"), ("O", "F"), ("O", "P"), ("F", "F"), ("P", "F")], "from string, to string")
    return writes.history_problems(stages, allowed, "O")


@query("r48_chunk_insert", "WITH r AS (SELECT l_orderkey AS parent, l_partkey % 50 AS key, md5((l_suppkey % 2)::VARCHAR) AS digest, l_orderkey * 10 + l_linenumber AS seq FROM lineitem), p AS (SELECT r.*, l.o_orderkey IS NOT NULL AS ok FROM r LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) l ON o_orderkey = parent), f AS (SELECT key, min_by(digest, seq) AS d, min(seq) AS s FROM p WHERE ok GROUP BY key) SELECT seq, CASE WHEN NOT ok THEN 'orphan' WHEN seq = s THEN 'inserted' WHEN digest = d THEN 'replayed' ELSE 'conflict' END AS outcome FROM p LEFT JOIN f USING (key)")
def r48(spark, d):
    li = V.read(spark, d, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("parent"), (F.col("l_partkey") % 50).alias("key"), F.md5((F.col("l_suppkey") % 2).cast("string").cast("binary")).alias("digest"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    parents = V.read(spark, d, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("parent"))
    return writes.insert_checked(rows.select("key", "digest").limit(0), rows, ["key"], "digest", parents, "parent").select("seq", "outcome")


@query("q33_candidate_insert", "SELECT event_id AS seq, CASE WHEN c_custkey IS NULL THEN 'orphan' WHEN user_id % 2 = 0 THEN CASE WHEN event_type = 'view' THEN 'replayed' ELSE 'conflict' END ELSE CASE WHEN event_id = f.s THEN 'inserted' WHEN event_type = f.d THEN 'replayed' ELSE 'conflict' END END AS outcome FROM events LEFT JOIN customer ON c_custkey = user_id LEFT JOIN (SELECT user_id, min(event_id) AS s, min_by(event_type, event_id) AS d FROM events GROUP BY 1) f USING (user_id)")
def q33(spark, d):
    e = V.read(spark, d, "events").select(F.col("event_id").alias("seq"), "user_id", F.col("event_type").alias("digest"))
    stored = e.filter("user_id % 2 = 0").select("user_id", F.lit("view").alias("digest")).distinct()
    parents = V.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return writes.insert_checked(stored, e, ["user_id"], "digest", parents, "user_id").select("seq", "outcome")


@query("q34_terminal_outcomes", "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS terminals, count(*) FILTER (event_type = 'purchase') > 1 AS violated FROM events GROUP BY 1")
def q34(spark, d):
    t = F.count_if(F.col("event_type") == "purchase")
    return V.read(spark, d, "events").groupBy("user_id").agg(t.alias("terminals"), (t > 1).alias("violated"))


@query("j11_coverage_trigger", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def j11(spark, d):
    ok = V.read(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return V.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(ok, "l_orderkey", "left_anti")


@query("q25_lifecycle_pair", "SELECT id, status, other FROM (SELECT source AS id, 'current' AS status, target AS other FROM edges WHERE type = 'updates' AND source <> target UNION ALL SELECT target, 'historical', source FROM edges WHERE type = 'updates' AND source <> target)", ("edges",))
def q25(spark, d):
    pairs = V.edges(spark, d).filter("type = 'updates' and source <> target").select(F.col("source").alias("newer"), F.col("target").alias("older"), V.ref().alias("at"))
    return writes.lifecycle_updates(pairs).select("id", "status", "other")


@query("q26_reviewed_edges", "SELECT source, target, type FROM edges WHERE type IN ('kin', 'explains') UNION SELECT source, target, 'reviewed' FROM edges WHERE type = 'updates' AND strength >= 0.5", ("edges",))
def q26(spark, d):
    e = V.edges(spark, d)
    new = e.filter("type = 'updates' and strength >= 0.5").select("source", "target", F.lit("reviewed").alias("type"))
    return e.filter(F.col("type").isin("kin", "explains")).select("source", "target", "type").unionByName(new).distinct()


@query("g04_add_edges", "SELECT source, target, type, max(strength) AS strength FROM (SELECT source, target, type, strength FROM edges UNION ALL SELECT id, id + 1, 'kin', 0.5 FROM memories) GROUP BY 1, 2, 3", ("memories", "edges"))
def g04(spark, d):
    new = V.memories(spark, d).select(i().alias("source"), (i() + 1).alias("target"), F.lit("kin").alias("type"), F.lit(0.5).alias("strength"))
    return V.edges(spark, d).unionByName(new).groupBy("source", "target", "type").agg(F.max("strength").alias("strength"))


@query("g05_remove_edges", "SELECT source, target, type FROM edges WHERE NOT (target % 2 = 0 AND type = 'kin')", ("edges",))
def g05(spark, d):
    gone = V.edges(spark, d).filter("target % 2 = 0 and type = 'kin'").select("source", "target", "type")
    return V.edges(spark, d).select("source", "target", "type").join(gone, ["source", "target", "type"], "left_anti")


@query("r54_split_relations", "SELECT source, target, CASE WHEN type IN ('kin', 'explains') THEN 'applied' ELSE 'queued' END AS outcome FROM edges", ("edges",))
def r54(spark, d):
    return V.edges(spark, d).select("source", "target", F.when(F.col("type").isin("kin", "explains"), "applied").otherwise("queued").alias("outcome"))


@query("r55_same_slot_pair", "WITH f AS (SELECT id, id % 42 AS slot, event_at FROM memories), l AS (SELECT slot, max_by(id, (event_at, id)) AS other, max(event_at) AS at FROM f WHERE id % 5 <> 0 GROUP BY slot) SELECT f.id, l.other, CASE WHEN f.event_at >= l.at THEN 'newer' ELSE 'older' END AS side FROM f JOIN l USING (slot) WHERE f.id % 5 = 0", ("memories",))
def r55(spark, d):
    f = V.memories(spark, d).select("id", (i() % 42).alias("slot"), "event_at")
    last = f.filter("id % 5 <> 0").groupBy("slot").agg(F.max(F.struct("event_at", "id")).alias("x"))
    return f.filter("id % 5 = 0").join(last, "slot").select("id", F.col("x.id").alias("other"), F.when(F.col("event_at") >= F.col("x.event_at"), "newer").otherwise("older").alias("side"))


@query("r56_axis_rows", "SELECT id, axis, md5(id || ':' || axis) AS key FROM memories, (VALUES ('M'), ('X'), ('Y')) a(axis) WHERE NOT (axis = 'Y' AND id % 2 = 0)", ("memories",))
def r56(spark, d):
    axes = F.when(i() % 2 == 0, F.array(F.lit("M"), F.lit("X"))).otherwise(F.array(F.lit("M"), F.lit("X"), F.lit("Y")))
    return V.memories(spark, d).select("id", F.explode(axes).alias("axis")).select("id", "axis", F.md5(F.concat_ws(":", i().cast("string"), "axis").cast("binary")).alias("key"))


@query("r57_counter_identities", """WITH l AS (SELECT l_orderkey, bool_or(l_returnflag = 'N') AS open FROM lineitem GROUP BY 1)
SELECT o_custkey AS run, count(*) AS attempted, count(*) FILTER (NOT open) AS succeeded, count(*) FILTER (open) AS failed, count(*) = count(*) FILTER (NOT open) + count(*) FILTER (open) AS ok FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1""")
def r57(spark, d):
    """Attempts are orders, their outcomes are found from the lines: an order without lines has none."""
    lines = V.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.count_if(F.col("l_returnflag") == "N") > 0).alias("open"))
    met = V.read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("run")).join(lines, "o_orderkey", "left")
    c = met.groupBy("run").agg(N().alias("attempted"), F.count_if(~F.col("open")).alias("succeeded"), F.count_if("open").alias("failed"))
    return c.withColumn("ok", F.col("attempted") == F.col("succeeded") + F.col("failed"))


@query("r60_enqueue", "SELECT count(*) AS added FROM (SELECT DISTINCT source, target FROM edges WHERE type = 'causes' EXCEPT SELECT source, target FROM edges WHERE strength > 0.5)", ("edges",))
def r60(spark, d):
    e = V.edges(spark, d)
    new = e.filter("type = 'causes'").select("source", "target").distinct()
    return new.join(e.filter("strength > 0.5").select("source", "target"), ["source", "target"], "left_anti").agg(N().alias("added"))


@query("r65_event_complete", "SELECT o_orderkey, bool_and(l_returnflag <> 'N') AS complete FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def r65(spark, d):
    done = V.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.count_if(F.col("l_returnflag") == "N") == 0).alias("complete"))
    return done.join(V.read(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi")


@query("r68_queue_keys", "SELECT source, substr(sha1(source || chr(31) || target || chr(31) || type), 1, 12) AS key FROM edges", ("edges",))
def r68(spark, d):
    from ..functions.text import short_hash

    c = F.col
    return V.edges(spark, d).select("source", short_hash(c("source").cast("string"), c("target").cast("string"), c("type")).alias("key"))


@query("r69_enrich_queue", "SELECT source, coalesce(name, 'unnamed') AS name FROM edges LEFT JOIN memories ON id = target", ("memories", "edges"))
def r69(spark, d):
    names = V.memories(spark, d).select(i().alias("target"), "name")
    return V.edges(spark, d).join(names, "target", "left").select("source", F.coalesce("name", F.lit("unnamed")).alias("name"))


@query("r76_lookup_many", "SELECT e.source, m.type AS kind FROM edges e LEFT JOIN memories m ON m.id = e.target", ("memories", "edges"))
def r76(spark, d):
    m = V.memories(spark, d).select(i().alias("target"), F.col("type").alias("kind"))
    return V.edges(spark, d).select("source", "target").join(m, "target", "left").select("source", "kind")


@query("r77_validity_upsert", "SELECT o_custkey AS key, max_by(o_orderstatus, o_orderkey) AS state, count(*) AS revision FROM orders GROUP BY 1")
def r77(spark, d):
    o = V.read(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", F.col("o_orderstatus").alias("state"))
    return ledger.upsert(o, "key", "o_orderkey", ["state"])


@query("r78_changed_labels", "SELECT id, 'short' AS label FROM memories WHERE length(content) < 500 AND thread <> 'short'", ("memories",))
def r78(spark, d):
    label = F.when(F.length("content") < 500, "short").otherwise(F.col("thread"))
    return V.memories(spark, d).select("id", "thread", label.alias("label")).filter("label <> thread").select("id", "label")


@query("r80_reviewed_assignments", "SELECT CAST(floor(event_id / 3) AS BIGINT) AS slot, min(event_type) AS thread FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = 1")
def r80(spark, d):
    return V.read(spark, d, "events").groupBy(F.floor(F.col("event_id") / 3).alias("slot")).agg(F.min("event_type").alias("thread"), F.max("event_type").alias("b")).filter("thread = b").drop("b")


@query("r83_identity_recovery", "SELECT name, CASE WHEN count(*) = 1 THEN 'found' ELSE 'duplicate' END AS outcome FROM memories GROUP BY 1", ("memories",))
def r83(spark, d):
    return V.memories(spark, d).groupBy("name").agg(F.when(N() == 1, "found").otherwise("duplicate").alias("outcome"))


@query("r92_invalidate", "SELECT id FROM memories WHERE md5(name) NOT IN (SELECT md5(name) FROM memories WHERE id % 20 = 0)", ("memories",))
def r92(spark, d):
    m = V.memories(spark, d).select("id", F.md5(F.col("name").cast("binary")).alias("h"))
    return m.join(m.filter("id % 20 = 0").select("h"), "h", "left_anti").select("id")


# --- ledger reads -----------------------------------------------------------


@query("t03_incremental", "SELECT event_id FROM events WHERE event_id > 100 AND ts < TIMESTAMP '2024-01-20 00:00:00' ORDER BY event_id LIMIT 100")
def t03(spark, d):
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return V.read(spark, d, "events").filter((F.col("event_id") > 100) & (F.col("ts") < cut)).orderBy("event_id").limit(100).select("event_id")


@query("t04_frozen_work", "SELECT event_id FROM events WHERE event_id <= (SELECT max(event_id) FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00') AND event_type = 'error'")
def t04(spark, d):
    e = V.read(spark, d, "events")
    mark = e.filter(F.col("ts") < F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).agg(F.max("event_id").alias("m"))  # one row
    return e.filter("event_type = 'error'").join(F.broadcast(mark), F.col("event_id") <= F.col("m")).select("event_id")


@query("t07_seen", "SELECT e.event_id, EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type = e.event_type AND s.event_id < 100) AS seen FROM events e WHERE e.event_id >= 100")
def t07(spark, d):
    e = V.read(spark, d, "events").select("event_id", "user_id", "event_type")
    held = e.filter("event_id < 100").select("user_id", "event_type").distinct().withColumn("s", F.lit(True))
    return e.filter("event_id >= 100").join(held, ["user_id", "event_type"], "left").select("event_id", F.coalesce("s", F.lit(False)).alias("seen"))


@query("t13_pending_sets", "SELECT user_id, count(DISTINCT event_type) AS items, count(DISTINCT CASE WHEN event_type <> 'error' THEN event_type END) AS applied FROM events GROUP BY 1")
def t13(spark, d):
    one = V.read(spark, d, "events").select("user_id", "event_type").distinct()
    return one.groupBy("user_id").agg(N().alias("items"), F.count_if(F.col("event_type") != "error").alias("applied"))


@query("t16_change_log", "SELECT o_orderkey, o_orderstatus AS after, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders")
def t16(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return V.read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("after"), F.lag("o_orderstatus").over(w).alias("before"))


@query("t17_resumable_chunks", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F') ORDER BY o_orderkey LIMIT 200")
def t17(spark, d):
    done = V.read(spark, d, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return V.read(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti").orderBy("o_orderkey").limit(200)


@query("a15_status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM orders")
def a15(spark, d):
    o = V.read(spark, d, "orders")
    return o.rollup("o_orderstatus").agg(N().alias("n")).select(F.coalesce("o_orderstatus", F.lit("total")).alias("status"), "n")


@query("a20_sync_summary", "SELECT count(*) AS outputs, count(*) FILTER (l_linestatus = 'F') AS done, count(DISTINCT l_orderkey) AS chunks FROM lineitem")
def a20(spark, d):
    by = V.read(spark, d, "lineitem").groupBy("l_orderkey").agg(N().alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("f"))
    return by.agg(F.sum("n").alias("outputs"), F.sum("f").alias("done"), N().alias("chunks"))


@query("r46_open_runs", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F') AND o_orderkey > 200 ORDER BY o_orderkey LIMIT 50")
def r46(spark, d):
    return V.read(spark, d, "orders").filter("o_orderstatus <> 'F' and o_orderkey > 200").orderBy("o_orderkey").limit(50).select("o_orderkey")


@query("r52_audit_rows", "SELECT event_id, event_type FROM events WHERE user_id = 7 ORDER BY event_id")
def r52(spark, d):
    return V.read(spark, d, "events").filter("user_id = 7").orderBy("event_id").select("event_id", "event_type")


@query("r36_identity_join", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN (SELECT DISTINCT l_orderkey AS k, l_linestatus AS m, l_returnflag AS f FROM lineitem WHERE l_linenumber = 1) ON k = l_orderkey AND m = l_linestatus AND f = l_returnflag WHERE l_linenumber > 1")
def r36(spark, d):
    li = V.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag")
    one = li.filter("l_linenumber = 1").select("l_orderkey", "l_linestatus", "l_returnflag").distinct()
    return li.filter("l_linenumber > 1").join(one, ["l_orderkey", "l_linestatus", "l_returnflag"]).select("l_orderkey", "l_linenumber")


@query("r34_success_key", "SELECT event_id, sha256(concat_ws(chr(31), user_id::VARCHAR, event_type, strftime(ts, '%Y-%m-%d'))) AS key FROM events")
def r34(spark, d):
    key = F.concat_ws("\x1f", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd"))
    return V.read(spark, d, "events").select("event_id", F.sha2(key.cast("binary"), 256).alias("key"))


@query("r29_annotation_groups", "SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts DESC, event_id DESC) AS rows FROM events WHERE event_type <> 'error' AND value BETWEEN 5 AND 95 GROUP BY 1")
def r29(spark, d):
    e = V.read(spark, d, "events").filter((F.col("event_type") != "error") & F.col("value").between(5, 95))
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id")), asc=False), lambda x: x["event_id"].cast("string")), ",").alias("rows"))


@query("r31_current_annotation", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type = 'view') WHERE rn = 1")
def r31(spark, d):
    e = V.read(spark, d, "events").filter("event_type = 'view'")
    return e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("x")).select("user_id", "x.event_id")


@query("r21_ingest_counts", "SELECT event_type, count(*) AS acknowledged, count(DISTINCT (user_id, ts::DATE)) AS inserted FROM events GROUP BY 1")
def r21(spark, d):
    e = V.read(spark, d, "events").groupBy("event_type", "user_id", F.to_date("ts").alias("day")).agg(N().alias("n"))
    return e.groupBy("event_type").agg(F.sum("n").alias("acknowledged"), N().alias("inserted"))


@query("r23_activate_used", "SELECT id, activation + coalesce(n, 0) AS activation FROM memories LEFT JOIN (SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1) ON user_id = id", ("memories",))
def r23(spark, d):
    used = V.read(spark, d, "events").select(F.col("user_id").alias("id"), "event_type").distinct().groupBy("id").agg(N().alias("n"))
    return V.memories(spark, d).select("id", "activation").join(used, "id", "left").select("id", (F.col("activation") + F.coalesce("n", F.lit(0))).alias("activation"))


# --- entities ---------------------------------------------------------------


def _catalogue(spark, d):
    ents = V.memories(spark, d).select(F.col("thread").alias("name"), F.lit("place").alias("kind")).distinct()
    more = ents.select("name", "kind", F.explode(F.array(F.concat(F.lit("Alias "), "name"), F.lit("shared name"), F.col("name"))).alias("alias"))
    return E.upserted(ents, more)


SQL_CATALOGUE = "cat AS (SELECT DISTINCT 'ent_' || substr(sha256('place' || chr(31) || thread), 1, 24) AS entity, unnest([lower(thread), 'alias ' || lower(thread), 'shared name']) AS alias FROM memories)"


@query("r11_entities", f"WITH {SQL_CATALOGUE} SELECT entity, 'place' AS kind, alias FROM cat", ("memories",))
def r11(spark, d):
    return _catalogue(spark, d)


@query("r13_alias_catalogue", f"WITH {SQL_CATALOGUE} SELECT alias, CASE WHEN count(*) = 1 THEN min(entity) END AS entity, count(*) > 1 AS ambiguous FROM cat GROUP BY 1", ("memories",))
def r13(spark, d):
    return E.catalogue(_catalogue(spark, d))


def _texts(spark, d):
    return V.memories(spark, d).select("id", F.concat(F.lit("At "), F.upper("thread"), F.lit(", not x"), "thread", F.lit("; shared  NAME ".upper()), F.when(i() % 2 == 0, F.concat(F.lit("Alias "), "thread")).otherwise("none")).alias("text"))


@query("x23_mentions", "SELECT id, lower(thread) AS alias, CAST(3 AS INTEGER) AS start FROM memories UNION ALL SELECT id, 'shared name', CAST(3 + 2 * length(thread) + 9 AS INTEGER) FROM memories UNION ALL SELECT id, 'alias ' || lower(thread), CAST(3 + 2 * length(thread) + 9 + 12 AS INTEGER) FROM memories WHERE id % 2 = 0", ("memories",))
def x23(spark, d):
    return E.mentions(_texts(spark, d), _catalogue(spark, d)).select("id", "alias", "start")


@query("r10_links", "SELECT id, 'ent_' || substr(sha256('place' || chr(31) || thread), 1, 24) AS entity FROM memories", ("memories",))
def r10(spark, d):
    known = _catalogue(spark, d)
    return E.links(E.mentions(_texts(spark, d), known), E.catalogue(known))


@query("r15_entity_recall", "SELECT id FROM memories WHERE thread = (SELECT min(thread) FROM memories)", ("memories",))
def r15(spark, d):
    known = _catalogue(spark, d)
    first = V.memories(spark, d).agg(F.min("thread").alias("t"))  # one row
    asked = E.links(E.mentions(first.select(F.lit(0).alias("id"), F.concat(F.lit("what of "), "t", F.lit("?")).alias("text")), known), E.catalogue(known)).select("entity")
    return E.links(E.mentions(_texts(spark, d), known), E.catalogue(known)).join(asked, "entity", "left_semi").select("id")


@query("r12_unlink", "SELECT id FROM memories WHERE id % 6 <> 0", ("memories",))
def r12(spark, d):
    stored = V.memories(spark, d).select("id", F.col("thread").alias("entity"), F.lit("a").alias("digest"))
    return stored.join(stored.filter("id % 6 = 0").select("id"), "id", "left_anti").select("id")


@query("x21_normal_terms", "SELECT id, lower(thread) || ' ab 1' AS term FROM memories", ("memories",))
def x21(spark, d):
    return V.memories(spark, d).select("id", E.normalised(F.concat(F.upper("thread"), F.lit("  \tＡＢ ①"))).alias("term"))


# --- checks and reports -----------------------------------------------------

SQL_PATROL = f"""WITH e AS (SELECT source, CASE WHEN source % 29 = 0 THEN source WHEN source % 31 = 0 THEN -1 ELSE target END AS target, CASE WHEN source % 37 = 0 THEN 'odd' ELSE type END AS type, CASE WHEN source % 43 = 0 THEN 1.5 ELSE strength END AS strength FROM edges),
f AS (SELECT 'dangling' AS "check", source AS id, target::VARCHAR AS detail FROM e WHERE target NOT IN (SELECT id FROM memories)
UNION ALL SELECT 'self_loop', source, type FROM e WHERE source = target
UNION ALL SELECT 'duplicate_edge', source, target::VARCHAR FROM e GROUP BY source, target, type HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'reciprocal_kin', a.source, a.target::VARCHAR FROM e a JOIN e b ON a.source = b.target AND a.target = b.source WHERE a.type = 'kin' AND b.type = 'kin' AND a.source < a.target
UNION ALL SELECT 'invalid_type', source, type FROM e WHERE type = 'odd'
UNION ALL SELECT 'invalid_strength', source, target::VARCHAR FROM e WHERE strength > 1
UNION ALL SELECT 'oversized', id, length(content)::VARCHAR FROM memories WHERE length(content) > 1500
UNION ALL SELECT 'duplicate_name', id, name FROM memories WHERE name IN (SELECT name FROM memories GROUP BY name HAVING count(*) > 1)
UNION ALL SELECT 'protected_resolved', id, 'resolved' FROM memories WHERE resolved AND id % 2 = 0
UNION ALL SELECT 'stale_important', id, CAST(floor((epoch_us(TIMESTAMP '2024-05-01 00:00:00') - epoch_us(last_active)) / 86400000000.0) AS BIGINT)::VARCHAR FROM memories WHERE importance >= 7 AND (epoch_us(TIMESTAMP '2024-05-01 00:00:00') - epoch_us(last_active)) / 86400000000.0 > 90)"""


def _findings(spark, d):
    s = F.col("source")
    e = V.edges(spark, d)
    e = e.select("source", F.when(s % 29 == 0, s).when(s % 31 == 0, -1).otherwise(F.col("target")).alias("target"), F.when(s % 37 == 0, "odd").otherwise(F.col("type")).alias("type"), F.when(s % 43 == 0, 1.5).otherwise(F.col("strength")).alias("strength"))
    m = V.memories(spark, d).withColumn("domain", F.when(i() % 2 == 0, F.array(F.lit("家庭"))).otherwise(F.col("domain")))
    return patrol.report(m, e, list(V.EDGE_TYPES), F.lit("2024-05-01 00:00:00").cast("timestamp_ntz"))


@query("q18_patrol", f"{SQL_PATROL} SELECT * FROM f", ("memories", "edges"))
def q18(spark, d):
    return _findings(spark, d)


@query("q19_suggestions", f"""{SQL_PATROL}, c AS (SELECT "check", count(*) AS n FROM f GROUP BY 1), s AS (SELECT "check", string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM (SELECT "check", id, row_number() OVER (PARTITION BY "check" ORDER BY id) AS rn FROM (SELECT DISTINCT "check", id FROM f)) WHERE rn <= 3 GROUP BY 1) SELECT "check", CASE "check" WHEN 'oversized' THEN 'split_thread' WHEN 'stale_important' THEN 'review_stale' ELSE 'mark_review' END AS action, CASE WHEN "check" IN ('dangling', 'self_loop', 'protected_resolved') THEN 'critical' WHEN "check" IN ('oversized', 'stale_important') THEN 'info' ELSE 'warning' END AS severity, n, ids FROM c JOIN s USING ("check")""", ("memories", "edges"))
def q19(spark, d):
    return patrol.suggestions(_findings(spark, d))


@query("r59_pair_entries", "SELECT source, target FROM edges WHERE type = 'updates' AND source <> target AND strength IS NOT NULL AND target IN (SELECT id FROM memories)", ("memories", "edges"))
def r59(spark, d):
    e = V.edges(spark, d).filter("type = 'updates' and source <> target and strength is not null")
    return e.join(V.memories(spark, d).select(i().alias("target")), "target", "left_semi").select("source", "target")


@query("r09_snapshot_token", "SELECT type, count(*) AS n, strftime(max(last_active), '%Y-%m-%d %H:%M:%S') AS newest FROM memories GROUP BY 1", ("memories",))
def r09(spark, d):
    return V.memories(spark, d).groupBy("type").agg(N().alias("n"), F.date_format(F.max("last_active"), "yyyy-MM-dd HH:mm:ss").alias("newest"))


@query("q10_eligible_page", "SELECT id FROM memories WHERE NOT pinned AND type = 'dynamic' ORDER BY id LIMIT 50 OFFSET 25", ("memories",))
def q10(spark, d):
    return V.memories(spark, d).filter("not pinned and type = 'dynamic'").orderBy("id").offset(25).limit(50).select("id")


@query("q11_review_list", "SELECT source, target FROM edges WHERE type = 'updates' AND strength < 0.5", ("edges",))
def q11(spark, d):
    return V.edges(spark, d).filter("type = 'updates' and strength < 0.5").select("source", "target")


@query("q13_inspect", "SELECT id, name, type, world FROM memories WHERE id = 42", ("memories",))
def q13(spark, d):
    return V.memories(spark, d).filter("id = 42").select("id", "name", "type", "world")


@query("q09_briefing", "WITH p AS (SELECT id, 'pinned' AS pool, 0 AS k FROM memories WHERE pinned), o AS (SELECT id, 'open' AS pool, row_number() OVER (ORDER BY importance DESC, last_active DESC, id) AS k FROM memories WHERE NOT resolved AND NOT pinned AND type = 'dynamic' QUALIFY k <= 10), f AS (SELECT id, 'feel' AS pool, row_number() OVER (ORDER BY event_at DESC, id) AS k FROM memories WHERE type = 'feel' AND NOT pinned QUALIFY k <= 3) SELECT id, pool FROM p UNION ALL SELECT id, pool FROM o UNION ALL SELECT id, pool FROM f", ("memories",))
def q09(spark, d):
    m = V.memories(spark, d)
    pool = lambda name, rows: rows.select("id", F.lit(name).alias("pool"))
    pinned = m.filter("pinned")
    open_ = m.filter("not resolved and not pinned and type = 'dynamic'").orderBy(F.desc("importance"), F.desc("last_active"), "id").limit(10)
    feel = m.filter("type = 'feel' and not pinned").orderBy(F.desc("event_at"), "id").limit(3)
    return pool("pinned", pinned).unionByName(pool("open", open_)).unionByName(pool("feel", feel))


@query("j20_unclaimed_episodes", "SELECT id FROM memories WHERE type = 'feel' AND id NOT IN (SELECT unnest([source, target]) FROM edges WHERE type = 'improves')", ("memories", "edges"))
def j20(spark, d):
    claimed = V.edges(spark, d).filter("type = 'improves'").select(F.explode(F.array("source", "target")).alias("id"))
    return V.memories(spark, d).filter("type = 'feel'").select("id").join(claimed, "id", "left_anti")


@query("w09_pair_order", "SELECT a.id AS a, b.id AS b FROM vectors a JOIN vectors b ON a.id < b.id WHERE round(list_cosine_similarity(a.vec, b.vec), 6) >= 0.35 ORDER BY round(list_cosine_similarity(a.vec, b.vec), 6) DESC, a.id, b.id LIMIT 50", ("vectors",))
def w09(spark, d):
    from ..operators import vectors

    return vectors.similar_pairs(V.vectors(spark, d), 0.35).orderBy(F.desc("sim"), "a", "b").limit(50).select("a", "b")


@query("q15_score_breakdown", f"SELECT id, round(greatest(0, 1 - sqrt(pow(valence - 0.7, 2) + pow(arousal - 0.4, 2)) / 1.414), 4) AS emotion, round(exp(-0.1 * (epoch_us({SQL_REF}) - epoch_us(last_active)) / 86400000000.0), 4) AS recency, round(importance / 10.0, 4) AS importance FROM memories ORDER BY emotion DESC, id LIMIT 50", ("memories",))
def q15(spark, d):
    rows = V.memories(spark, d).select("id", F.round(S.emotion_score(F.col("valence"), F.col("arousal"), 0.7, 0.4), 4).alias("emotion"), F.round(S.time_score(_age("last_active")), 4).alias("recency"), F.round(F.col("importance") / 10, 4).alias("importance"))
    return rows.orderBy(F.desc("emotion"), "id").limit(50)


@query("q14_keyword_search", "SELECT id, CAST((contains(lower(content), 'the'))::INT + (contains(lower(content), 'and'))::INT + (contains(lower(name), 'src3'))::INT AS INTEGER) AS hits FROM memories WHERE NOT pinned ORDER BY hits DESC, id LIMIT 10", ("memories",))
def q14(spark, d):
    from ..functions import text as X

    m = V.memories(spark, d).filter("not pinned")
    return m.select("id", (X.hits(F.col("content"), ["the", "and"]) + X.hits(F.col("name"), ["src3"])).alias("hits")).orderBy(F.desc("hits"), "id").limit(10)


@case("m02_query_parts", "SELECT * FROM (VALUES ('where is the Trip to Rome', ['trip', 'rome']), ('the and', ['the and']), ('Rome rome', ['rome'])) t(question, parts)", lists=("parts",))
def m02(spark, d):
    from ..functions import text as X

    q = spark.createDataFrame([("where is the Trip to Rome",), ("the and",), ("Rome rome",)], "question string")
    return q.select("question", X.query_parts(F.col("question")).alias("parts"))


@query("g06_timeline_neighbours", "WITH w AS (SELECT id, thread, world, lag(id) OVER t AS p, lead(id) OVER t AS n FROM memories WINDOW t AS (PARTITION BY thread ORDER BY event_at, id)), f AS (SELECT p AS id FROM w JOIN memories USING (id) WHERE memories.pinned AND p IS NOT NULL UNION SELECT n FROM w JOIN memories USING (id) WHERE memories.pinned AND n IS NOT NULL) SELECT id FROM f JOIN memories USING (id) WHERE world IN ('shared', 'north') AND NOT pinned", ("memories",))
def g06(spark, d):
    m = V.memories(spark, d)
    rows = m.select("id", "thread", F.col("event_at").alias("ts"))
    near = timeline.neighbours(rows, m.filter("pinned").select("id"), 1).select("id").distinct()
    return near.join(m.filter(F.col("world").isin("shared", "north") & ~F.col("pinned")).select("id"), "id", "left_semi")


@query("u04_channels", "WITH k AS (SELECT id FROM memories ORDER BY valence DESC, id LIMIT 20), v AS (SELECT id FROM memories ORDER BY arousal DESC, id LIMIT 20), g AS (SELECT DISTINCT target AS id FROM edges WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM memories)) SELECT id, 'keyword' AS channel FROM k UNION ALL SELECT id, 'vector' FROM v WHERE id NOT IN (SELECT id FROM k) UNION ALL SELECT id, 'relation' FROM g WHERE id NOT IN (SELECT id FROM k) AND id NOT IN (SELECT id FROM v)", ("memories", "edges"))
def u04(spark, d):
    m = V.memories(spark, d)
    keyword = m.orderBy(F.desc("valence"), "id").limit(20).select("id")
    vector = m.orderBy(F.desc("arousal"), "id").limit(20).select("id")
    relation = V.edges(spark, d).join(keyword.select(i().alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct().join(m.select("id"), "id", "left_semi")
    return ranking.prioritised([("keyword", keyword), ("vector", vector), ("relation", relation)])


# --- more of the ledger, the files and the guards ---------------------------


@query("s02_change_tokens", "SELECT type || '/' || id || '.md' AS path, octet_length(encode(content)) AS size, md5(content) AS token FROM memories WHERE id % 40 = 7", ("memories",))
def s02(spark, d):
    plain = _files(spark, d).join(V.memories(spark, d).filter("id % 40 = 7").select(F.concat("type", F.lit("/"), i().cast("string"), F.lit(".md")).alias("path")), "path", "left_semi")
    return plain.select("path", F.octet_length("text").cast("long").alias("size"), F.md5(F.col("text").cast("binary")).alias("token"))


@query("s07_tolerant_parse", "SELECT CAST(id AS VARCHAR) AS id, name, false AS has_content FROM memories WHERE id % 41 = 3 AND id % 40 <> 7", ("memories",))
def s07(spark, d):
    f = _files(spark, d).filter(F.contains("text", F.lit("content: broken"))).select(markdown.parse(F.col("text")).alias("p"))
    return f.select(F.col("p.fields")["id"].alias("id"), F.col("p.fields")["name"].alias("name"), F.map_contains_key("p.fields", "content").alias("has_content"))


@query("t02_atomic_batches", "SELECT CAST(floor(event_id / 100) AS BIGINT) AS batch, count(*) AS inserted FROM events GROUP BY 1")
def t02(spark, d):
    e = V.read(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 100).alias("batch"))
    replayed = e.unionByName(e.filter("batch % 2 = 0"))  # half of the batches come twice
    return replayed.dropDuplicates(["event_id"]).groupBy("batch").agg(N().alias("inserted"))


SQL_BREAKER = "WITH e AS (SELECT user_id, event_id, event_type = 'error' AS bad, lag(event_type = 'error', 1) OVER w AS p, lag(event_type = 'error', 2) OVER w AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), b AS (SELECT user_id, min(event_id) AS stop FROM e WHERE bad AND p AND q GROUP BY 1)"


@query("t15_circuit_breaker", f"{SQL_BREAKER} SELECT user_id, count(*) AS worked FROM e LEFT JOIN b USING (user_id) WHERE stop IS NULL OR event_id <= stop GROUP BY 1")
def t15(spark, d):
    e = V.read(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("bad"))
    return writes.until_broken(e, "user_id", "event_id", "bad", 3).groupBy("user_id").agg(N().alias("worked"))


@query("r53_dispatch", f"{SQL_BREAKER} SELECT event_id FROM e LEFT JOIN b USING (user_id) JOIN events USING (event_id) WHERE (stop IS NULL OR event_id <= stop) AND events.event_type <> 'view'")
def r53(spark, d):
    e = V.read(spark, d, "events").select("user_id", "event_id", "event_type", (F.col("event_type") == "error").alias("bad"))
    return writes.until_broken(e, "user_id", "event_id", "bad", 3).filter("event_type <> 'view'").select("event_id")


@query("r51_constraints", "SELECT 'order key' AS rule, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS broken UNION ALL SELECT 'line parent', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'event value', (SELECT count(*) FROM events WHERE value IS NULL OR value < 0)")
def r51(spark, d):
    o, li, e = V.read(spark, d, "orders"), V.read(spark, d, "lineitem"), V.read(spark, d, "events")
    rule = lambda name, df: df.agg(N().alias("broken")).select(F.lit(name).alias("rule"), "broken")
    doubled = o.groupBy("o_orderkey").agg(N().alias("n")).filter("n > 1")
    orphans = li.select(F.col("l_orderkey").alias("o_orderkey")).join(o.select("o_orderkey"), "o_orderkey", "left_anti")
    return rule("order key", doubled).unionByName(rule("line parent", orphans)).unionByName(rule("event value", e.filter("value is null or value < 0")))


@query("r70_resolve_queue", "SELECT id AS key, CASE WHEN id % 3 = 2 THEN 'refused' WHEN id % 3 = 1 THEN 'replayed' ELSE 'moved' END AS outcome FROM memories", ("memories",))
def r70(spark, d):
    m = V.memories(spark, d).select(i().alias("key"))
    k = F.col("key")
    state = m.select("key", F.when(k % 3 == 0, "pending").when(k % 3 == 1, "applied").otherwise("rejected").alias("status"))
    asked = m.select("key", F.lit(None).cast("string").alias("expected"), F.lit("applied").alias("to"))
    allowed = spark.createDataFrame([("pending", "reviewed"), ("pending", "applied"), ("pending", "rejected"), ("reviewed", "applied")], "from string, to string")
    return writes.transition(state, asked, allowed).select("key", "outcome")


@query("r24_probe", "WITH k AS (SELECT id, row_number() OVER (ORDER BY valence DESC, id) AS rank FROM memories WHERE type = 'dynamic' ORDER BY valence DESC, id LIMIT 50) SELECT id, CAST(rank AS INTEGER) AS rank FROM k WHERE id % 7 = 0", ("memories",))
def r24(spark, d):
    page = V.memories(spark, d).filter("type = 'dynamic'").orderBy(F.desc("valence"), "id").limit(50)
    return page.select("id", F.row_number().over(Window.orderBy(F.desc("valence"), "id")).alias("rank")).filter("id % 7 = 0")


@query("r27_append", "SELECT role, count(*) + 1 AS n FROM conversations GROUP BY 1")
def r27(spark, d):
    c = V.read(spark, d, "conversations").select("role", "text")
    new = c.select("role").distinct().select("role", F.lit("hello").alias("text"))
    return c.unionByName(new).groupBy("role").agg(N().alias("n"))


@query("r94_state_appended", "SELECT id, md5(content || chr(10) || '[state ' || round(valence, 2) || ']') AS digest FROM memories", ("memories",))
def r94(spark, d):
    block = F.concat(F.lit("[state "), F.round("valence", 2).cast("string"), F.lit("]"))
    return V.memories(spark, d).select("id", F.md5(F.concat_ws("\n", "content", block).cast("binary")).alias("digest"))


@case("r81_layered_config", "SELECT * FROM (VALUES ('topic', '5.0', 'env'), ('emotion', '3.0', 'file'), ('time', '2.5', 'default')) t(name, value, source)")
def r81(spark, d):
    from ..config import layered

    found = layered({"EMBERLINE_TOPIC": "5"}, {"topic": 9, "emotion": 3})
    return spark.createDataFrame([(k, str(v), s) for k, (v, s) in found.items() if k in ("topic", "emotion", "time")], "name string, value string, source string")


@query("x22_alias_spans", "SELECT id, 2 AS n FROM memories", ("memories",))
def x22(spark, d):
    text = F.concat("thread", F.lit(" x"), "thread", F.lit(" ("), F.upper("thread"), F.lit(")"))
    m = V.memories(spark, d).select("id", text.alias("text"), F.col("thread").alias("alias"))
    return m.select("id", E.occurrences(F.col("text"), F.col("alias")).alias("n"))


@query("x26_redacted_maps", "SELECT id, CASE WHEN id % 2 = 0 THEN '[REDACTED]' ELSE thread END AS held, 'user=[REDACTED_USER]' AS said FROM memories", ("memories",))
def x26(spark, d):
    from ..functions.text import redact_map

    key = F.when(i() % 2 == 0, "api_key").otherwise("place")
    m = V.memories(spark, d).select("id", redact_map(F.create_map(key, F.col("thread"), F.lit("note"), F.concat(F.lit("user="), "thread"))).alias("m"))
    return m.select("id", F.coalesce(F.col("m")["api_key"], F.col("m")["place"]).alias("held"), F.col("m")["note"].alias("said"))


@query("x32_event_parts", "SELECT id, CAST(k AS INTEGER) AS part, sha256(substr(repeat(name, 8), CAST(32 * k + 1 AS BIGINT), 32)) AS digest FROM memories, range(20) r(k) WHERE 32 * k < length(repeat(name, 8))", ("memories",))
def x32(spark, d):
    from ..operators import chunking

    m = V.memories(spark, d).select("id", F.posexplode(chunking.utf8_parts(F.repeat("name", F.lit(8)), 32)).alias("part", "data"))
    return m.select("id", "part", F.sha2("data", 256).alias("digest"))


@query("r22_recall_depth2", "WITH live AS (SELECT source, target, type, strength FROM edges WHERE type IN ('kin', 'explains') AND strength BETWEEN 0 AND 1 AND source <> target), adj AS (SELECT source AS a, target AS b, type, strength FROM live UNION ALL SELECT target, source, type, strength FROM live), seeds AS (SELECT id FROM memories ORDER BY valence DESC, id LIMIT 20), one AS (SELECT b AS id, max(round(strength * CASE type WHEN 'kin' THEN 1.0 ELSE 0.85 END, 6)) AS score FROM adj JOIN seeds ON a = id WHERE strength >= 0.4 AND b NOT IN (SELECT id FROM seeds) GROUP BY 1), two AS (SELECT b AS id, max(round(adj.strength * CASE adj.type WHEN 'kin' THEN 1.0 ELSE 0.85 END * 0.6, 6)) AS score FROM adj JOIN one ON a = one.id WHERE adj.strength >= 0.7 AND b NOT IN (SELECT id FROM seeds) AND b NOT IN (SELECT id FROM one) GROUP BY 1) SELECT id, 1 AS depth, score FROM one UNION ALL SELECT id, 2, score FROM two", ("memories", "edges"))
def r22(spark, d):
    from ..operators import graph

    m = V.memories(spark, d)
    seeds = m.orderBy(F.desc("valence"), "id").limit(20).select("id")
    return graph.expand(V.edges(spark, d), m.select("id"), seeds, ["kin", "explains"], 100_000).select("id", "depth", "score")


# --- single functions as queries --------------------------------------------


@query("a05_percentiles", "SELECT thread, round(quantile_cont(valence, 0.25), 6) AS p25, round(quantile_cont(valence, 0.9), 6) AS p90 FROM memories GROUP BY 1", ("memories",))
def a05(spark, d):
    found = ranking.percentiles(V.memories(spark, d), "thread", "valence", {"p25": 0.25, "p90": 0.9})
    return found.select("thread", F.round("p25", 6).alias("p25"), F.round("p90", 6).alias("p90"))


@query("m05_time_weight", f"SELECT id, round(1 + exp(-{_sql_age('last_active')} * 24 / 36), 6) AS weight FROM memories", ("memories",))
def m05(spark, d):
    return V.memories(spark, d).select("id", F.round(S.time_weight(_age("last_active")), 6).alias("weight"))


@query("m08_blend", "SELECT id, round(importance * (0.6 + 0.4 * valence), 6) AS score FROM memories", ("memories",))
def m08(spark, d):
    return V.memories(spark, d).select("id", F.round(S.blend_decay(F.col("importance").cast("double"), F.col("valence")), 6).alias("score"))


@query("m18_cosine", f"SELECT id, CASE WHEN id % 5 = 0 OR id % 5 = 1 THEN 0.0 ELSE round(list_cosine_similarity(vec, {SQL_QUERY}), 6) END AS sim FROM vectors", ("vectors",))
def m18(spark, d):
    q = F.array(*[F.lit(x) for x in QUERY_VECTOR])
    zero = F.transform("vec", lambda x: x * 0)
    v = F.when(i() % 5 == 0, zero).when(i() % 5 == 1, F.slice("vec", 1, 63)).otherwise(F.col("vec"))
    return V.vectors(spark, d).select("id", F.round(S.cosine(v, q), 6).alias("sim"))


@query("m22_normal_dates", "SELECT id, CASE id % 4 WHEN 0 THEN '2024-01-01T00:00:00' WHEN 1 THEN strftime(event_at, '%Y-%m-01T00:00:00') WHEN 2 THEN strftime(event_at, '%Y-%m-%dT00:00:00') END AS at FROM memories", ("memories",))
def m22(spark, d):
    from ..functions.text import normalise_date

    said = F.when(i() % 4 == 0, F.date_format("event_at", "yyyy")).when(i() % 4 == 1, F.date_format("event_at", "yyyy-MM")).when(i() % 4 == 2, F.date_format("event_at", "yyyy-MM-dd")).otherwise("soon")
    return V.memories(spark, d).select("id", normalise_date(said).alias("at"))


@query("m28_state_decay", "SELECT event_id, round(least(1.0, greatest(0.0, value / 100 * exp(-(event_id % 1800) / 900.0))), 6) AS state FROM events")
def m28(spark, d):
    return V.read(spark, d, "events").select("event_id", F.round(S.clamp(F.col("value") / 100 * F.exp(-(F.col("event_id") % 1800) / F.lit(DEFAULTS.tau_s)), 0.0, 1.0), 6).alias("state"))


@query("x02_aliased_links", "SELECT id, name || ' and ' || thread AS text FROM memories", ("memories",))
def x02(spark, d):
    from ..functions.text import strip_aliased_links

    linked = F.concat(F.lit("[[x|"), "name", F.lit("]] and [["), "thread", F.lit("]]"))
    return V.memories(spark, d).select("id", strip_aliased_links(linked).alias("text"))


@query("g03_valid_edges", "SELECT source, target, type FROM edges WHERE type IN ('kin', 'causes') AND strength BETWEEN 0 AND 1 AND source <> target", ("edges",))
def g03(spark, d):
    from ..operators import graph

    return graph.valid(V.edges(spark, d), ["kin", "causes"]).select("source", "target", "type")


@case("r14_boundaries", "SELECT * FROM (VALUES ('york', 'New York', 1), ('york', 'Yorkshire', 0), ('上海', '在上海见', 1), ('ann', '见ann了', 1), ('ann', 'annex', 0)) t(alias, said, n)")
def r14(spark, d):
    rows = spark.createDataFrame([("york", "New York"), ("york", "Yorkshire"), ("上海", "在上海见"), ("ann", "见ann了"), ("ann", "annex")], "alias string, said string")
    return rows.select("alias", "said", E.occurrences(F.col("said"), F.col("alias")).alias("n"))


@query("r67_update_structs", "SELECT id, status FROM (SELECT source AS id, 'current' AS status FROM edges WHERE type = 'causes' UNION ALL SELECT target, 'historical' FROM edges WHERE type = 'causes')", ("edges",))
def r67(spark, d):
    pairs = V.edges(spark, d).filter("type = 'causes'").select(F.col("source").alias("newer"), F.col("target").alias("older"), V.ref().alias("at"))
    return writes.lifecycle_updates(pairs).select("id", "status")


@query("s08_empty_vectors", "SELECT vec_id AS id FROM embeddings WHERE vec_id % 40 = 0")
def s08(spark, d):
    v = V.read(spark, d, "embeddings")
    held = F.when(F.col("vec_id") % 40 == 0, F.array().cast("array<float>")).otherwise(F.col("embedding"))
    return v.select(F.col("vec_id").alias("id"), held.alias("v")).filter(F.coalesce(F.size("v"), F.lit(0)) == 0).select("id")


@query("s09_changed_vectors", "SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 7 = 0")
def s09(spark, d):
    v = V.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 5).alias("updated"))
    manifest = v.filter("id % 3 <> 0").select("id", F.when(i() % 7 == 0, -1).otherwise(F.col("updated")).alias("updated"))
    return v.join(manifest, ["id", "updated"], "left_anti").select("id")


@query("s12_message_trees", "SELECT conv_id AS conv, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, role, trim(text, ' ') AS content FROM conversations WHERE trim(text, ' ') <> ''")
def s12(spark, d):
    from ..sources import exports

    c = V.read(spark, d, "conversations")
    node = F.struct(F.struct(F.col("turn").cast("double").alias("create_time"), F.struct("role").alias("author"), F.struct(F.array("text").alias("parts")).alias("content")).alias("message"))
    tree = c.groupBy(F.col("conv_id").alias("conv")).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.lpad(F.col("turn").cast("string"), 6, "0").alias("k"), node.alias("v")))).alias("mapping"))).alias("json"))
    return exports.message_trees(tree).select("conv", "pos", "role", "content")


@query("s23_committed_output", "SELECT type, count(*) AS n FROM memories GROUP BY 1", ("memories",))
def s23(spark, d):
    from ..session import shared_folder

    path = shared_folder(spark, "output")
    V.memories(spark, d).select("id", "type").write.mode("errorifexists").parquet(path)  # staged, then renamed by the commit
    return spark.read.parquet(path).groupBy("type").agg(N().alias("n"))


@query("x19_slot_values", "SELECT id, CASE WHEN id % 3 = 2 THEN [] WHEN id % 3 = 1 THEN ['tea'] ELSE ['green tea', 'tea'] END AS found FROM memories", ("memories",), lists=("found",))
def x19(spark, d):
    from ..operators.facts import slot_values

    said = F.when(i() % 3 == 0, "I like Green TEA. likes tea; LIKES Tea").when(i() % 3 == 1, "likes tea.").otherwise("hates tea")
    return V.memories(spark, d).select("id", slot_values(said, r"(?i)likes? ([a-z ]+)").alias("found"))


@query("x20_slot_membership", "SELECT id, CASE WHEN id % 4 = 0 THEN 'structured' WHEN id % 4 = 1 THEN 'metadata' WHEN id % 4 = 2 THEN 'value' ELSE 'context' END AS match FROM memories", ("memories",))
def x20(spark, d):
    from ..operators.facts import membership

    said = F.when(i() % 4 == 0, "drink: tea").when(i() % 4 == 2, "likes tea").otherwise(F.concat(F.repeat(F.lit("x "), F.lit(150)), F.lit("likes tea")))
    labelled, meta = said.rlike("(?im)^drink[:=]"), i() % 4 == 1
    return V.memories(spark, d).select("id", membership(labelled, meta, F.lit("n"), said, r"(?i)likes? ([a-z ]+)").alias("match"))


@case("x24_resolved_questions", "SELECT * FROM (VALUES (1::BIGINT, 'where is san francisco now', ['sf'], []), (2, 'ny or york', ['york'], ['ny']), (3, 'nothing', [], [])) t(id, canonical, found, ambiguous)", lists=("found", "ambiguous"))
def x24(spark, d):
    known = spark.createDataFrame([("sf", "e1", "san francisco"), ("ny", "e2", "new york"), ("ny", "e3", "normandy"), ("york", "e4", "york")], "alias string, entity string, name string")
    asked = spark.createDataFrame([(1, "where is SF now"), (2, "NY or York"), (3, "nothing")], "id long, text string")
    return E.resolved(asked, known)


@query("t01_append_events", "SELECT event_id AS seq, CASE WHEN row_number() OVER w = 1 THEN 'inserted' WHEN value::INT % 2 = first_value(value::INT % 2) OVER w THEN 'replayed' ELSE 'conflict' END AS outcome FROM (SELECT event_id, user_id, event_type, floor(value) AS value FROM events) WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)")
def t01(spark, d):
    e = V.read(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("seq"), (F.floor("value") % 2).cast("string").alias("digest"))
    return ledger.append_once(e.select("user_id", "event_type", "digest").limit(0), e, ["user_id", "event_type"], "digest").select("seq", "outcome")


@query("t05_decaying_state", "WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, epoch_us(ts) / 1000000.0::DOUBLE AS tm, (value % 1)::DOUBLE AS amount FROM events), s AS (SELECT user_id, n, tm, least(1.0, greatest(0.0, amount)) AS value FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, e.tm, least(1.0, greatest(0.0, s.value * exp(-(e.tm - s.tm) / 900.0::DOUBLE) + e.amount)) FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1) SELECT user_id, round(max_by(value, n), 6) AS state FROM s GROUP BY user_id")
def t05(spark, d):
    e = V.read(spark, d, "events").select("user_id", F.struct("ts", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0).alias("at"), (F.col("value") % 1).alias("amount")).alias("x"))
    return timeline.folded_state(e, "user_id", DEFAULTS.tau_s)


@query("t14_pages", "SELECT conv_id, CAST(floor((rn - 1) / 3) AS BIGINT) AS page, count(*) AS n FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY 1, 2")
def t14(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = V.read(spark, d, "conversations").select("conv_id", F.floor((F.row_number().over(w) - 1) / 3).alias("page"))
    return c.groupBy("conv_id", "page").agg(N().alias("n"))
