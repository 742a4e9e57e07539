"""Queries of intents, status facts, hooks' answers, and the entry points made of other operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import intents as I
from ..functions import scoring as S
from ..functions import text as X
from ..operators import graph, hooks, ledger, vectors, writes
from ..sources import views as V
from .catalog import _age, _sql_age, case, query

i = lambda: F.col("id")
N = lambda: F.count(F.lit(1))

# --- intents and states -----------------------------------------------------

QUESTIONS = [("生日是哪天", 1), ("我们之间最近怎么样", 0), ("什么时候搬到上海", 0), ("recap of the timeline", 0), ("hello", 0), ("", 0), (None, 0)]


@case("m14_intent", "SELECT * FROM (VALUES ('生日是哪天', 'fact', 0.95::DOUBLE), ('我们之间最近怎么样', 'relation', 0.95), ('什么时候搬到上海', 'temporal', 0.9), ('recap of the timeline', 'temporal', 0.775), ('hello', 'default', 0.0), ('', 'default', 0.0), (NULL, 'default', 0.0)) t(question, intent, confidence)")
def m14(spark, d):
    q = spark.createDataFrame(QUESTIONS, "question string, slots int")
    return q.select("question", I.intent(F.col("question"), F.col("slots")).alias("x")).select("question", "x.intent", "x.confidence")


@query("m15_policy", "SELECT id, CAST(CASE id % 4 WHEN 0 THEN 27 WHEN 3 THEN 26 ELSE 20 END AS INTEGER) AS pool FROM memories", ("memories",))
def m15(spark, d):
    intent = F.element_at(F.array(F.lit("fact"), F.lit("recall"), F.lit("relation"), F.lit("temporal")), (i() % 4 + 1).cast("int"))
    return V.memories(spark, d).select("id", S.scaled_pool(intent, 20).alias("pool"))


@case("x49_status_view", "SELECT * FROM (VALUES ('部署完成了吗', 'current'), ('之前部署失败', 'historical'), ('部署完成', 'neutral'), ('what is up?', 'neutral')) t(question, view)")
def x49(spark, d):
    q = spark.createDataFrame([("部署完成了吗",), ("之前部署失败",), ("部署完成",), ("what is up?",)], "question string")
    return q.select("question", I.status_view(F.col("question")).alias("view"))


SQL_STATUS = "NOT pinned AND NOT protected AND type NOT IN ('permanent', 'feel') AND id % 4 <> 3 AND id % 5 <> 0"


def _status(spark, d):
    body = F.when(i() % 4 == 0, "server 已部署").when(i() % 4 == 1, "接口 全绿").when(i() % 4 == 2, "commit 回滚").otherwise("a quiet day")
    dom = F.when(i() % 5 == 0, F.array(F.lit("家庭"))).otherwise(F.array(F.lit("software"), F.col("domain")[0]))
    m = V.memories(spark, d)
    return m.withColumn("status", I.is_status(body, dom, F.col("type"), F.col("pinned"), F.col("protected")))


@query("x50_status_facts", f"SELECT id, {SQL_STATUS} AS status FROM memories", ("memories",))
def x50(spark, d):
    return _status(spark, d).select("id", "status")


@query("r75_status_rows", f"SELECT type, count(*) AS n FROM memories WHERE {SQL_STATUS} GROUP BY 1", ("memories",))
def r75(spark, d):
    return _status(spark, d).filter("status").groupBy("type").agg(N().alias("n"))


@query("x51_validity_label", f"SELECT id, CASE WHEN NOT ({SQL_STATUS}) THEN NULL WHEN id % 3 = 0 THEN 'unknown' WHEN id % 3 = 1 THEN 'current' ELSE 'historical' END AS state FROM memories", ("memories",))
def x51(spark, d):
    state = F.when(i() % 3 == 1, "current").when(i() % 3 == 2, "historical").otherwise("?")
    return _status(spark, d).select("id", F.when(F.col("status"), F.when(state.isin("current", "historical", "contested"), state).otherwise("unknown")).alias("state"))


@case("r93_state_profile", "SELECT * FROM (VALUES ('现在部署完成了吗', 'current', 'current'), ('以前住哪', 'historical', 'neutral'), ('之前部署失败', 'neutral', 'historical')) t(question, fact_view, status_view)")
def r93(spark, d):
    from ..operators.facts import state_view

    q = spark.createDataFrame([("现在部署完成了吗",), ("以前住哪",), ("之前部署失败",)], "question string")
    return q.select("question", state_view(F.col("question")).alias("fact_view"), I.status_view(F.col("question")).alias("status_view"))


@case("m13_query_emotion", "SELECT * FROM (VALUES ('so happy and calm', 0.5::DOUBLE), ('not happy', -0.5), ('sad', -0.5), ('plain', 0.0)) t(question, valence)")
def m13(spark, d):
    q = spark.createDataFrame([("so happy and calm",), ("not happy",), ("sad",), ("plain",)], "question string")
    return q.select("question", S.lexicon_valence(F.col("question"), {"happy": 0.5, "sad": -0.5}).alias("valence"))


@case("r32_negation", "SELECT * FROM (VALUES ('i am not very happy', true), ('i am happy, not sad', false), ('isn''t happy', true), ('no, really happy', false)) t(said, negated)")
def r32(spark, d):
    q = spark.createDataFrame([("i am not very happy",), ("i am happy, not sad",), ("isn't happy",), ("no, really happy",)], "said string")
    return q.select("said", I.negated(F.col("said"), "happy").alias("negated"))


SQL_SPICY = "CASE id % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 0.25 WHEN 2 THEN 0.85 WHEN 3 THEN 0.75 WHEN 4 THEN 0.6 ELSE 0.0 END"


def _tasted():
    k = i() % 6
    return F.when(k == 0, "NOT spicy pepper").when(k == 1, "微辣 pepper").when(k == 2, "some hot sauce").when(k == 3, "burning chili").when(k == 4, "辣").otherwise("sweet")


@query("r71_spicy", f"SELECT id, {SQL_SPICY}::DOUBLE AS spicy FROM memories", ("memories",))
def r71(spark, d):
    return V.memories(spark, d).select("id", I.spicy(_tasted()).alias("spicy"))


@query("x44_spicy_sources", f"SELECT id, CASE WHEN id % 7 = 0 THEN 0.5 ELSE {SQL_SPICY} END::DOUBLE AS spicy FROM memories", ("memories",))
def x44(spark, d):
    meta = F.when(i() % 7 == 0, '{"body": {"spicy": 0.5}}').when(i() % 7 == 1, '{"spicy": 0.1}')
    given = F.coalesce(F.get_json_object(meta, "$.body.spicy"), F.get_json_object(meta, "$.spicy")).try_cast("double")
    return V.memories(spark, d).select("id", F.when(given >= 0.15, given).otherwise(I.spicy(_tasted())).alias("spicy"))


@query("r73_nested_intensity", "SELECT id, CASE id % 3 WHEN 0 THEN 0.4 WHEN 1 THEN 0.2 END::DOUBLE AS spicy FROM memories", ("memories",))
def r73(spark, d):
    meta = F.when(i() % 3 == 0, '{"a": {"spicy": 0.4}}').when(i() % 3 == 1, '{"spicy": 0.2}').otherwise("{}")
    paths = ("$.spicy", "$.a.spicy", "$.body.spicy")
    return V.memories(spark, d).select("id", F.coalesce(*[F.get_json_object(meta, p).try_cast("double") for p in paths]).alias("spicy"))


SQL_TOUCH = "CASE WHEN id % 4 = 0 THEN 0.65 WHEN id % 4 = 3 THEN 0.4 ELSE 0.0 END::DOUBLE AS rebound, CASE WHEN id % 4 = 1 THEN 0.55 ELSE 0.0 END::DOUBLE AS sting, CASE WHEN id % 4 < 2 THEN 0.45 ELSE 0.0 END::DOUBLE AS cool"


def _felt():
    k = i() % 4
    return F.when(k == 0, "cool rebound").when(k == 1, "COLD edge pressure").when(k == 2, "warm").otherwise("键帽 smooth")


@query("r72_touch", f"SELECT id, {SQL_TOUCH} FROM memories", ("memories",))
def r72(spark, d):
    t = V.memories(spark, d).select("id", I.touch(_felt()).alias("t"))
    return t.select("id", F.col("t.touch_rebound").alias("rebound"), F.col("t.edge_sting").alias("sting"), F.col("t.cool_surface").alias("cool"))


@query("x45_touch_sources", f"SELECT id, greatest(rebound, CASE WHEN id % 5 = 0 THEN 0.9 ELSE 0.0 END)::DOUBLE AS rebound FROM (SELECT id, {SQL_TOUCH} FROM memories)", ("memories",))
def x45(spark, d):
    given = F.when(i() % 5 == 0, 0.9).otherwise(0.0)
    return V.memories(spark, d).select("id", F.greatest(I.touch(_felt())["touch_rebound"], given).alias("rebound"))


@query("x46_senses_of_intensity", "SELECT id, CASE WHEN id % 6 BETWEEN 1 AND 4 THEN ['taste'] ELSE [] END || CASE WHEN id % 4 <> 2 THEN ['touch'] ELSE [] END AS senses FROM memories", ("memories",), lists=("senses",))
def x46(spark, d):
    t = I.touch(_felt())
    most = F.greatest(t["touch_rebound"], t["edge_sting"], t["cool_surface"])
    senses = F.array_compact(F.array(F.when(I.spicy(_tasted()) >= 0.15, "taste"), F.when(most >= 0.15, "touch")))
    return V.memories(spark, d).select("id", senses.alias("senses"))


@query("r88_sense_backfill", "SELECT id FROM memories WHERE id % 3 = 0 AND (id % 6 BETWEEN 1 AND 4 OR id % 4 <> 2)", ("memories",))
def r88(spark, d):
    t = I.touch(_felt())
    some = (I.spicy(_tasted()) >= 0.15) | (F.greatest(t["touch_rebound"], t["edge_sting"], t["cool_surface"]) >= 0.15)
    return V.memories(spark, d).filter((i() % 3 == 0) & some).select("id")


@query("x38_anchored_times", "SELECT id, CASE id % 3 WHEN 0 THEN '2024-01-31说“昨天”' WHEN 1 THEN '2024-02-01稍早 2024-01-30前后' ELSE '这段时间' END AS said FROM memories", ("memories",))
def x38(spark, d):
    said = F.when(i() % 3 == 0, "昨天说“昨天”").when(i() % 3 == 1, "刚才 前几天").otherwise("最近")
    return V.memories(spark, d).select("id", I.anchored(said, V.ref().cast("date")).alias("said"))


@query("x37_loose_references", "SELECT id, CASE id % 3 WHEN 0 THEN ['he', 'there'] WHEN 1 THEN ['it'] ELSE [] END AS tokens FROM memories", ("memories",), lists=("tokens",))
def x37(spark, d):
    said = F.when(i() % 3 == 0, "He went there, he said").when(i() % 3 == 1, "it").otherwise("Ada met the team")
    found = F.regexp_extract_all(F.lower(said), F.lit(r"\b(he|she|it|they|this|that|there)\b"), F.lit(1))
    return V.memories(spark, d).select("id", F.array_distinct(found).alias("tokens"))


# --- parsers of answers -----------------------------------------------------


@query("x33_strict_object", "SELECT id, CASE id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'malformed' ELSE 'not_object' END AS code FROM memories", ("memories",))
def x33(spark, d):
    raw = F.when(i() % 4 == 0, '{"a": 1, "b": "x"}').when(i() % 4 == 1, '{"a": 1, "a": 2}').when(i() % 4 == 2, '{"a": NaN').otherwise("[1]")
    return V.memories(spark, d).select("id", X.json_object_code(raw).alias("code"))


@query("x39_analysis", "SELECT id, CASE WHEN id % 3 = 2 THEN 0.5 ELSE least(1.0, (id % 13) / 10.0) END::DOUBLE AS valence, CAST(CASE WHEN id % 3 = 2 THEN 5 ELSE least(10, 1 + id % 13) END AS INTEGER) AS importance FROM memories", ("memories",))
def x39(spark, d):
    raw = F.when(i() % 3 == 2, "sorry").otherwise(F.concat(F.lit('{"valence": '), ((i() % 13) / F.lit(10.0)).cast("string"), F.lit(', "importance": '), (1 + i() % 13).cast("string"), F.lit("}")))
    x = F.from_json(raw, "valence double, importance int")
    return V.memories(spark, d).select("id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(x["valence"], F.lit(0.5)))).alias("valence"), F.least(F.lit(10), F.greatest(F.lit(1), F.coalesce(x["importance"], F.lit(5)))).alias("importance"))


@query("x40_digest_rows", "SELECT id, content FROM (SELECT id, 'first' AS content FROM memories WHERE id % 3 < 2 UNION ALL SELECT id, 'third' FROM memories WHERE id % 3 = 0)", ("memories",))
def x40(spark, d):
    raw = F.when(i() % 3 == 0, '[{"content": "first"}, {"content": " "}, {"content": "third"}]').when(i() % 3 == 1, 'noise [{"content": "first"}] tail').otherwise("none")
    array = F.regexp_extract(raw, r"(?s)\[.*\]", 0)
    rows = V.memories(spark, d).select("id", F.explode(F.from_json(array, "array<struct<content:string>>")).alias("x"))
    return rows.select("id", "x.content").filter(F.trim("content") != "")


@query("r43_extraction", "SELECT id, CASE id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'too_many' WHEN 2 THEN 'no_content' ELSE 'invalid' END AS code FROM memories", ("memories",))
def r43(spark, d):
    raw = F.when(i() % 4 == 0, '```json\n[{"content": "a", "importance": 99}]\n```').when(i() % 4 == 1, "[" + ", ".join(['{"content": "a"}'] * 6) + "]").when(i() % 4 == 2, '[{"name": "x"}]').otherwise("?")
    return V.memories(spark, d).select("id", X.extraction_code(raw, 5).alias("code"))


@query("x34_provenance", "SELECT id, CASE id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'unknown_kind' WHEN 2 THEN 'disallowed' ELSE 'unknown_field' END AS code FROM memories", ("memories",))
def x34(spark, d):
    fields = F.when(i() % 4 == 0, F.array(F.lit("chunk_id"))).when(i() % 4 == 1, F.array().cast("array<string>")).when(i() % 4 == 2, F.array(F.lit("episode_ids"))).otherwise(F.array(F.lit("colour")))
    kind = F.when(i() % 4 == 1, "rumour").otherwise("import")
    allowed = {"import": ("chunk_id", "ordinal"), "saga": ("episode_ids",)}
    return V.memories(spark, d).select("id", X.provenance_code(kind, fields, allowed).alias("code"))


@query("r44_chunk_provenance", "SELECT conv_id, count(*) AS turns, min(turn) AS first_turn, max(turn) - min(turn) + 1 = count(*) AS ordered FROM conversations GROUP BY 1")
def r44(spark, d):
    c = V.read(spark, d, "conversations").groupBy("conv_id").agg(N().alias("turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last"))
    return c.select("conv_id", "turns", "first_turn", (F.col("last") - F.col("first_turn") + 1 == F.col("turns")).alias("ordered"))


@query("r45_output_id", """SELECT conv_id, turn, sha256('{"chunk":"' || conv_id || '","index":' || turn || ',"role":"' || role || '"}') AS output FROM conversations""")
def r45(spark, d):
    key = F.to_json(F.struct(F.col("conv_id").cast("string").alias("chunk"), F.col("turn").alias("index"), "role"))
    return V.read(spark, d, "conversations").select("conv_id", "turn", F.sha2(key.cast("binary"), 256).alias("output"))


@query("r42_stored_output", "SELECT id, CASE WHEN id % 3 = 0 THEN 'merged' END AS action FROM memories", ("memories",))
def r42(spark, d):
    tags = F.when(i() % 3 == 0, F.array(F.lit("x"), F.lit("out:7:merged"))).otherwise(F.array(F.lit("out:8:raw")))
    mark = F.try_element_at(F.filter(tags, lambda t: t.startswith("out:7:")), F.lit(1))
    return V.memories(spark, d).select("id", F.substring(mark, 7, 20).alias("action"))


# --- entry points made of other operators -----------------------------------


@query("r01_duplicates", "SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.vec, b.vec), 6) AS sim FROM vectors a JOIN vectors b ON a.id < b.id WHERE a.id IN (SELECT id FROM memories WHERE NOT pinned) AND b.id IN (SELECT id FROM memories WHERE NOT pinned) AND round(list_cosine_similarity(a.vec, b.vec), 6) >= 0.35 ORDER BY sim DESC, a.id, b.id LIMIT 50", ("memories", "vectors"))
def r01(spark, d):
    free = V.memories(spark, d).filter("not pinned").select("id")
    return vectors.similar_pairs(V.vectors(spark, d).join(free, "id", "left_semi"), 0.35).orderBy(F.desc("sim"), "a", "b").limit(50)


@query("j24_relation_neighbours", "SELECT DISTINCT target AS id FROM edges JOIN memories m ON m.id = target WHERE source IN (SELECT id FROM memories WHERE pinned) AND edges.type IN ('kin', 'explains') AND strength >= 0.4 AND source <> target AND m.world IN ('shared', '') AND target NOT IN (SELECT id FROM memories WHERE pinned)", ("memories", "edges"))
def j24(spark, d):
    m = V.memories(spark, d)
    seeds = m.filter("pinned").select(i().alias("source"))
    e = graph.valid(V.edges(spark, d), ["kin", "explains"]).filter("strength >= 0.4").join(seeds, "source", "left_semi").select(F.col("target").alias("id")).distinct()
    return e.join(m.filter(F.col("world").isin("shared", "")).select("id"), "id", "left_semi").join(seeds.withColumnRenamed("source", "id"), "id", "left_anti")


@query("g07_edge_candidates", "WITH s AS (SELECT id, cluster FROM vectors WHERE id % 50 = 0), c AS (SELECT s.id AS source, v.id AS target, round(list_cosine_similarity(q.vec, v.vec), 6) AS sim FROM s JOIN vectors q ON q.id = s.id JOIN vectors v ON v.cluster = s.cluster AND v.id <> s.id) SELECT source, target, sim, CASE WHEN sim >= 0.3 THEN 'apply' ELSE 'queue' END AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sim DESC, target) AS rn FROM c) WHERE rn <= 8", ("vectors",))
def g07(spark, d):
    v = V.vectors(spark, d)
    top = vectors.cluster_neighbours(v, v.filter("id % 50 = 0"), 8)
    return top.select("source", "target", "sim", F.when(F.col("sim") >= 0.3, "apply").otherwise("queue").alias("outcome"))


@query("g09_saga_routes", "WITH u AS (SELECT id, thread FROM memories WHERE type = 'feel' AND NOT resolved), s AS (SELECT DISTINCT thread FROM memories WHERE type = 'permanent') SELECT u.thread, CASE WHEN s.thread IS NULL THEN 'create' ELSE 'append' END AS route, string_agg(id::VARCHAR, ',' ORDER BY id) AS episodes FROM u LEFT JOIN s USING (thread) GROUP BY 1, 2", ("memories",))
def g09(spark, d):
    m = V.memories(spark, d)
    sagas = m.filter("type = 'permanent'").select("thread").distinct().withColumn("_s", F.lit(True))
    free = m.filter("type = 'feel' and not resolved").groupBy("thread").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("episodes"))
    return free.join(sagas, "thread", "left").select("thread", F.when(F.col("_s"), "append").otherwise("create").alias("route"), "episodes")


@query("q02_hold", "SELECT id, CASE WHEN type = 'feel' THEN 'feel' WHEN pinned THEN 'pinned' WHEN id % 3 = 0 THEN 'merged' ELSE 'created' END AS outcome FROM memories", ("memories",))
def q02(spark, d):
    m = V.memories(spark, d)
    candidates = m.filter("id % 3 = 0").select(i().alias("incoming"), (i() + 1).alias("id"), F.lit(90.0).alias("keyword"), F.lit(0.1).alias("vector"), F.lit(False).alias("held"))
    target = writes.merge_targets(m.select(i().alias("incoming")), candidates.unionByName(m.select(i().alias("incoming"), i().alias("id"), F.lit(10.0).alias("keyword"), F.lit(0.2).alias("vector"), F.lit(False).alias("held"))), DEFAULTS.merge_keyword, DEFAULTS.merge_vector)
    met = m.join(target.withColumnRenamed("incoming", "id"), "id", "left")
    return met.select("id", F.when(F.col("type") == "feel", "feel").when(F.col("pinned"), "pinned").when(F.col("target").isNotNull(), "merged").otherwise("created").alias("outcome"))


@query("q03_grow", "SELECT conv_id, CAST(turn AS BIGINT) AS part, md5(text) AS digest FROM conversations WHERE length(trim(text)) > 0")
def q03(spark, d):
    c = V.read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("parts"))
    return c.select("conv_id", F.explode("parts").alias("p")).select("conv_id", F.col("p.turn").cast("long").alias("part"), "p.text").filter(F.length(F.trim("text")) > 0).select("conv_id", "part", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("q06_write_decision", "WITH t AS (SELECT source, target, strength, row_number() OVER (PARTITION BY source ORDER BY strength DESC, target) AS rn FROM edges WHERE source <> target) SELECT source, CASE WHEN strength >= 0.8 THEN 'merge' WHEN strength >= 0.5 THEN 'supersede' ELSE 'new' END AS decision FROM t WHERE rn = 1", ("edges",))
def q06(spark, d):
    best = V.edges(spark, d).filter("source <> target").groupBy("source").agg(F.max("strength").alias("s"))
    return best.select("source", F.when(F.col("s") >= 0.8, "merge").when(F.col("s") >= 0.5, "supersede").otherwise("new").alias("decision"))


@query("q07_trace", "SELECT id, CASE WHEN id % 5 = 0 THEN true ELSE resolved END AS resolved FROM memories WHERE id % 7 <> 0", ("memories",))
def q07(spark, d):
    m = V.memories(spark, d).select("id", "domain", "resolved", F.lit("r").alias("rev"))
    edits = m.filter("id % 5 = 0").select("id", F.lit(None).cast("string").alias("expected"), F.lit(True).alias("resolved"))
    gone = m.filter("id % 7 = 0").select("id")
    return writes.edited(m, edits, ["resolved"], "rev").join(gone, "id", "left_anti").select("id", "resolved")


@query("q08_experience", "SELECT event_id, CASE WHEN value < 0 OR value > 100 THEN 'rejected' WHEN event_type = 'error' THEN 'rejected' ELSE 'appended' END AS outcome FROM events")
def q08(spark, d):
    ok = F.col("value").between(0, 100) & (F.col("event_type") != "error")
    return V.read(spark, d, "events").select("event_id", F.when(ok, "appended").otherwise("rejected").alias("outcome"))


@query("q12_worlds", "SELECT world, count(*) AS n FROM memories WHERE world IN ('shared', 'south') GROUP BY 1", ("memories",))
def q12(spark, d):
    from ..operators.facts import world_filter

    return V.memories(spark, d).filter(world_filter("", "south")).groupBy("world").agg(N().alias("n"))


@query("q17_annotations", "SELECT count(*) FILTER (value BETWEEN 0 AND 100) AS appended, count(*) FILTER (NOT value BETWEEN 0 AND 100) AS refused FROM events")
def q17(spark, d):
    ok = F.col("value").between(0, 100)
    return V.read(spark, d, "events").agg(F.count_if(ok).alias("appended"), F.count_if(~ok).alias("refused"))


@query("q21_night_stages", "SELECT stage, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'O' THEN 'chunked' WHEN 'P' THEN 'proposed' ELSE 'done' END AS stage FROM orders) GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM orders")
def q21(spark, d):
    s = F.col("o_orderstatus")
    stage = F.when(s == "O", "chunked").when(s == "P", "proposed").otherwise("done")
    return V.read(spark, d, "orders").select(stage.alias("stage")).rollup("stage").agg(N().alias("n")).select(F.coalesce("stage", F.lit("total")).alias("stage"), "n")


@query("q22_cohort", "SELECT count(*) AS cohort, round(avg(valence), 4) AS valence, round(avg(arousal), 4) AS arousal FROM memories WHERE type = 'dynamic' AND id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')", ("memories",))
def q22(spark, d):
    done = V.read(spark, d, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("id"))
    return V.memories(spark, d).filter("type = 'dynamic'").join(done, "id", "left_anti").agg(N().alias("cohort"), F.round(F.avg("valence"), 4).alias("valence"), F.round(F.avg("arousal"), 4).alias("arousal"))


@query("q32_two_phase", "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 THEN 'promoted' ELSE 'replayed' END AS outcome FROM events) GROUP BY 1")
def q32(spark, d):
    e = V.read(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("seq"), F.lit("same").alias("digest"))
    done = ledger.append_once(e.select("user_id", "event_type", "digest").limit(0), e, ["user_id", "event_type"], "digest")
    return done.groupBy(F.when(F.col("outcome") == "inserted", "promoted").otherwise(F.col("outcome")).alias("outcome")).agg(N().alias("n"))


@query("r49_receipts", "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER w = 1 THEN 'inserted' WHEN event_type = first_value(event_type) OVER w THEN 'replayed' ELSE 'conflict' END AS outcome FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY 1")
def r49(spark, d):
    e = V.read(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("digest"))
    return ledger.append_once(e.select("user_id", "digest").limit(0), e, ["user_id"], "digest").groupBy("outcome").agg(N().alias("n"))


@query("r50_run_replay", "SELECT o_custkey AS run, count(*) = count(DISTINCT o_orderkey) AND count(DISTINCT o_orderpriority) = 1 AS same FROM orders GROUP BY 1")
def r50(spark, d):
    o = V.read(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("run")).agg((F.min("o_orderpriority") == F.max("o_orderpriority")).alias("same"))


@query("r58_metabolism", "SELECT 'archive' AS step, count(*) AS n FROM memories WHERE NOT pinned AND importance <= 2 UNION ALL SELECT 'receipts', count(*) FROM edges WHERE type = 'contributes'", ("memories", "edges"))
def r58(spark, d):
    item = lambda name, df: df.agg(N().alias("n")).select(F.lit(name).alias("step"), "n")
    return item("archive", V.memories(spark, d).filter("not pinned and importance <= 2")).unionByName(item("receipts", V.edges(spark, d).filter("type = 'contributes'")))


@query("r16_evidence_labels", "SELECT id, CASE WHEN pinned THEN 'core' ELSE 'support' END || '|' || type || '|' || CASE WHEN resolved THEN 'resolved' ELSE 'open' END AS label FROM memories", ("memories",))
def r16(spark, d):
    label = F.concat_ws("|", F.when(F.col("pinned"), "core").otherwise("support"), "type", F.when(F.col("resolved"), "resolved").otherwise("open"))
    return V.memories(spark, d).select("id", label.alias("label"))


@query("r18_excerpts", "SELECT id, least(length(content), 800) AS size FROM memories ORDER BY importance DESC, id LIMIT 8", ("memories",))
def r18(spark, d):
    page = V.memories(spark, d).orderBy(F.desc("importance"), "id").limit(8)
    return page.select("id", F.length(F.substring("content", 1, 800)).cast("long").alias("size"))


@query("r20_surfacing", "SELECT id, pool FROM (SELECT id, 'pinned' AS pool FROM memories WHERE pinned UNION ALL SELECT id, 'feel' FROM (SELECT id FROM memories WHERE type = 'feel' AND NOT pinned ORDER BY event_at DESC, id LIMIT 3) UNION ALL SELECT id, 'top' FROM (SELECT id FROM memories WHERE NOT pinned AND type = 'dynamic' ORDER BY importance DESC, valence DESC, id LIMIT 20))", ("memories",))
def r20(spark, d):
    m = V.memories(spark, d)
    pool = lambda name, rows: rows.select("id", F.lit(name).alias("pool"))
    feel = m.filter("type = 'feel' and not pinned").orderBy(F.desc("event_at"), "id").limit(3)
    top = m.filter("type = 'dynamic' and not pinned").orderBy(F.desc("importance"), F.desc("valence"), "id").limit(20)
    return pool("pinned", m.filter("pinned")).unionByName(pool("feel", feel)).unionByName(pool("top", top))


@query("r30_authored_groups", "SELECT thread, string_agg(id::VARCHAR, ',' ORDER BY importance DESC, event_at DESC, id DESC) AS rows FROM memories WHERE type = 'feel' AND valence BETWEEN 0.1 AND 0.9 GROUP BY 1", ("memories",))
def r30(spark, d):
    m = V.memories(spark, d).filter((F.col("type") == "feel") & F.col("valence").between(0.1, 0.9))
    return m.groupBy("thread").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("importance", "event_at", "id")), asc=False), lambda x: x["id"].cast("string")), ",").alias("rows"))


@query("r33_contract_rows", "SELECT id, sha256(concat_ws(chr(31), id::VARCHAR, md5(content), 'rubric-1')) AS key, round(valence * 2 - 1, 4) AS valence FROM memories WHERE type = 'feel'", ("memories",))
def r33(spark, d):
    key = F.concat_ws("\x1f", i().cast("string"), F.md5(F.col("content").cast("binary")), F.lit("rubric-1"))
    return V.memories(spark, d).filter("type = 'feel'").select("id", F.sha2(key.cast("binary"), 256).alias("key"), F.round(F.col("valence") * 2 - 1, 4).alias("valence"))


@query("r35_shadow_append", "SELECT event_id AS seq, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 THEN 'inserted' ELSE 'replayed' END AS outcome FROM events")
def r35(spark, d):
    e = V.read(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("seq"), F.lit("d").alias("digest"))
    return ledger.append_once(e.select("user_id", "event_type", "digest").limit(0), e, ["user_id", "event_type"], "digest").select("seq", "outcome")


@query("r39_source_binding", """SELECT id, CASE WHEN importance >= 5 THEN sha256('{"content":"' || md5(content) || '","id":' || id || ',"type":"' || type || '"}') END AS digest FROM memories""", ("memories",))
def r39(spark, d):
    body = F.to_json(F.struct(F.md5(F.col("content").cast("binary")).alias("content"), "id", "type"))
    return V.memories(spark, d).select("id", F.when(F.col("importance") >= 5, F.sha2(body.cast("binary"), 256)).alias("digest"))


@query("r87_time_backfill", "SELECT id, CASE WHEN id % 5 = 0 THEN '2024-01-02' END AS day, id % 5 = 0 AS changed FROM memories", ("memories",))
def r87(spark, d):
    from ..functions.dates import inferred_date

    name = F.when(i() % 5 == 0, "x 2024-01-02").otherwise("none")
    day = inferred_date(name, F.array().cast("array<string>"), None, V.ref().cast("date"))["day"]
    return V.memories(spark, d).select("id", day.cast("string").alias("day"), day.isNotNull().alias("changed"))


@query("r89_relabel", "SELECT id, 'home' AS label FROM memories WHERE id % 3 = 1 AND domain[1] <> 'home'", ("memories",))
def r89(spark, d):
    from ..operators.facts import classified

    body = F.when(i() % 3 == 1, "kitchen and garden").otherwise("nothing")
    new = classified(body, {"home": ["kitchen", "garden"]}, F.col("domain"))
    return V.memories(spark, d).select("id", "domain", new.alias("new")).filter("new <> domain").select("id", F.col("new")[0].alias("label"))


@query("r07_relocate", "SELECT id, CASE WHEN type = 'feel' THEN 'feel/sediment' ELSE type || '/' || domain[1] END AS root FROM memories WHERE id % 2 = 0", ("memories",))
def r07(spark, d):
    m = V.memories(spark, d).withColumn("held", F.when(i() % 2 == 0, "old/place").otherwise(writes.rooted(F.col("type"), F.col("domain"))))
    return m.select("id", "held", writes.rooted(F.col("type"), F.col("domain")).alias("root")).filter("held <> root").select("id", "root")


# --- hooks ------------------------------------------------------------------


@query("q27_summaries", "SELECT id, substr(array_to_string(regexp_split_to_array(trim('  ' || name || chr(10) || thread), '\\s+'), ' '), 1, 80) AS summary, id % 4 = 0 AS from_cache FROM memories WHERE id % 4 <> 0 UNION ALL SELECT id, 'held', true FROM memories WHERE id % 4 = 0", ("memories",))
def q27(spark, d):
    m = V.memories(spark, d).select("id", F.concat(F.lit("  "), "name", F.lit("\n"), "thread", F.when(i() % 4 == 0, " x").otherwise("")).alias("text"))
    cache = m.filter("id % 4 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.lit("held").alias("value")).distinct()
    return hooks.cached(m, cache, "summary", "text", "summary").select("id", "summary", "from_cache")


@case("q28_angles", "SELECT * FROM (VALUES ('where is the lighthouse', ['where is the lighthouse', 'lighthouse', 'where']), ('go', ['go', 'go'])) t(question, angles)", lists=("angles",))
def q28(spark, d):
    q = spark.createDataFrame([("where is the lighthouse",), ("go",)], "question string")
    return hooks.apply(q, "angles", "question", "angles")


@query("q29_vectors", "SELECT id, CAST(len(regexp_split_to_array(name || ' ' || thread, ' ')) AS DOUBLE) AS total FROM memories", ("memories",))
def q29(spark, d):
    m = V.memories(spark, d).select("id", F.concat_ws(" ", "name", "thread").alias("text"))
    return hooks.apply(m, "vector", "text", "v").select("id", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("q30_scores", "SELECT id, len(regexp_split_to_array(CASE WHEN id % 2 = 0 THEN 'one two three four' ELSE 'one' END, ' ')) > 3 AS keep FROM memories", ("memories",))
def q30(spark, d):
    m = V.memories(spark, d).select("id", F.when(i() % 2 == 0, "one two three four").otherwise("one").alias("text"))
    return hooks.apply(m, "keep", "text", "keep").select("id", "keep")


@query("f27_relevance_hook", "WITH p AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'short' ELSE 'a text of many words' END AS t FROM memories ORDER BY valence DESC, id LIMIT 20) SELECT id FROM p WHERE t <> 'short' OR id % 6 = 0", ("memories",))
def f27(spark, d):
    m = V.memories(spark, d).select("id", "valence", F.when(i() % 3 == 0, "short").otherwise("a text of many words").alias("text"))
    return hooks.filtered(m, "text", i() % 6 == 0, 20, [F.desc("valence"), i()]).select("id")


@query("r25_keep_memo", "SELECT text, count(*) AS n, true AS kept FROM (SELECT 'a prompt number ' || (id % 5) AS text FROM memories) GROUP BY 1", ("memories",))
def r25(spark, d):
    m = V.memories(spark, d).select("id", F.concat(F.lit("a prompt number "), (i() % 5).cast("string")).alias("text"))
    none = m.select(F.lit("").alias("digest"), F.lit(True).alias("value")).limit(0)
    return hooks.cached(m, none, "keep", "text", "kept").groupBy("text").agg(N().alias("n"), F.bool_and("kept").alias("kept"))


@query("r91_inferred_edges", "SELECT source, target FROM (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) AS rn FROM (SELECT id AS source, unnest([id + 1, id + 2, id + 3, id + 100000]) AS target FROM memories) WHERE target IN (SELECT id FROM memories)) WHERE rn <= 3", ("memories",))
def r91(spark, d):
    m = V.memories(spark, d).select("id")
    told = m.select(i().alias("source"), F.explode(F.array(i() + 1, i() + 2, i() + 3, i() + 100000)).alias("target"))
    real = told.join(m.select(i().alias("target")), "target", "left_semi")
    return real.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("target"))).filter("rn <= 3").select("source", "target")


@query("k09_seen_lists", "SELECT user_id AS session, count(DISTINCT event_type) AS seen FROM events GROUP BY 1")
def k09(spark, d):
    e = V.read(spark, d, "events").groupBy(F.col("user_id").alias("session")).agg(F.to_json(F.struct(F.collect_set("event_type").alias("seen"))).alias("line"))
    return e.select("session", F.size(F.from_json("line", "seen array<string>")["seen"]).cast("long").alias("seen"))


@query("s25_snapshot_manifest", f"SELECT type AS part, count(*) AS n, md5(string_agg(md5(content), '' ORDER BY id)) AS digest FROM memories GROUP BY 1", ("memories",))
def s25(spark, d):
    m = V.memories(spark, d)
    # a digest for each part from its rows' digests, in order of id
    rows = F.transform(F.sort_array(F.collect_list(F.struct("id", F.md5(F.col("content").cast("binary")).alias("h")))), lambda x: x["h"])
    return m.groupBy(F.col("type").alias("part")).agg(N().alias("n"), F.md5(F.array_join(rows, "").cast("binary")).alias("digest"))


@query("r74_state_block", "SELECT id, 'spicy=' || round(valence, 2) || '; touch=' || round(arousal, 2) AS block FROM memories", ("memories",))
def r74(spark, d):
    return V.memories(spark, d).select("id", F.concat(F.lit("spicy="), F.round("valence", 2).cast("string"), F.lit("; touch="), F.round("arousal", 2).cast("string")).alias("block"))


@query("q31_decayed_state", f"SELECT id, round(valence * exp(-{_sql_age('last_active')}), 6) AS now FROM memories", ("memories",))
def q31(spark, d):
    return V.memories(spark, d).select("id", F.round(F.col("valence") * F.exp(-_age("last_active")), 6).alias("now"))


@query("x43_image_links", "SELECT id, CASE id % 3 WHEN 0 THEN ['u1', 'u2'] WHEN 1 THEN ['u3'] ELSE [] END AS images FROM memories", ("memories",), lists=("images",))
def x43(spark, d):
    body = F.when(i() % 3 == 0, "![a](u1) and ![](u2) [no](u9)").when(i() % 3 == 1, '![t](u3)').otherwise("none")
    return V.memories(spark, d).select("id", X.image_links(body).alias("images"))


@query("a21_noisy_or_clamped", "SELECT thread, round(1 - product(1 - greatest(0.0, least(1.0, valence * 1.2 - 0.1))), 3) AS intensity FROM memories WHERE id % 10 = 0 GROUP BY thread", ("memories",))
def a21(spark, d):
    v = S.clamp(F.col("valence") * 1.2 - 0.1, 0.0, 1.0)
    return V.memories(spark, d).filter("id % 10 = 0").groupBy("thread").agg(F.round(1 - F.product(1 - v), 3).alias("intensity"))


@query("u07_distinct_in_order", "SELECT id, [tags[2], tags[1]] AS tags FROM memories", ("memories",), lists=("tags",))
def u07(spark, d):
    t = F.col("tags")
    return V.memories(spark, d).select("id", F.array_distinct(F.array(t[1], t[0], t[1], t[0])).alias("tags"))


@query("r66_ordered_ids", "SELECT l_orderkey, string_agg(k::VARCHAR, ',' ORDER BY first, k) AS ids FROM (SELECT l_orderkey, l_partkey % 5 AS k, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def r66(spark, d):
    li = V.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 5).alias("k")))).alias("l"))
    ids = F.array_distinct(F.transform("l", lambda x: F.trim(x["k"].cast("string"))))
    return li.select("l_orderkey", F.array_join(F.slice(F.filter(ids, lambda x: x != ""), 1, 32), ",").alias("ids"))


@query("x07_letters_fingerprint", "SELECT count(DISTINCT fp) AS distinct_texts, count(fp) AS fingerprinted FROM (SELECT CASE WHEN length(p) >= 8 THEN sha256(p) END AS fp FROM (SELECT regexp_replace(regexp_replace(lower('[pgvector] FTS: ' || content), '^(\\s*(\\[(knowledge[_\\s-]?base|pgvector|pg[_\\s-]?fts|vector|fts|imprint|sqlite)\\]|(knowledge[_\\s-]?base|pgvector|pg[_\\s-]?fts|vector|fts|imprint|sqlite)(\\s*[:：|/]\\s*|\\s+)))+', ''), '[^\\p{L}\\p{N}]+', '', 'g') AS p FROM memories))", ("memories",))
def x07(spark, d):
    fp = X.letters_fingerprint(F.concat(F.lit("[pgvector] FTS: "), "content"))
    return V.memories(spark, d).select(fp.alias("fp")).agg(F.count_distinct("fp").alias("distinct_texts"), F.count("fp").alias("fingerprinted"))


@query("j23_letters_dedupe", "WITH f AS (SELECT id, regexp_replace(lower(content), '[^\\p{L}\\p{N}]+', '', 'g') AS p FROM memories) SELECT sha256(p) AS fp, min(id) AS id, count(*) AS merged FROM f WHERE length(p) >= 8 GROUP BY 1", ("memories",))
def j23(spark, d):
    m = V.memories(spark, d).select("id", X.letters_fingerprint(F.col("content")).alias("fp"))
    return m.groupBy("fp").agg(F.min("id").alias("id"), N().alias("merged")).filter("fp is not null")


@query("x25_redaction_flags", "SELECT id, " + " OR ".join("regexp_matches(content, '" + p.replace("'", "''") + "')" for p, _ in X.MASKS) + " AS secret FROM memories", ("memories",))
def x25(spark, d):
    from ..functions.facts import has_secret

    return V.memories(spark, d).select("id", has_secret(F.col("content")).alias("secret"))


@query("x05_body_lead", "SELECT id, CASE id % 3 WHEN 0 THEN ['first sentence here'] WHEN 1 THEN ['a line of more than four'] ELSE [] END AS lead FROM memories", ("memories",), lists=("lead",))
def x05(spark, d):
    body = F.when(i() % 3 == 0, "---\n[x]\nfirst sentence here; second").when(i() % 3 == 1, "\n## \na line of more than four and twenty").otherwise("---\n")
    return V.memories(spark, d).select("id", X.body_lead(body).alias("lead"))


@query("x04_literal_keys", "SELECT id, ['alpha key', 'Second'] AS keys FROM memories", ("memories",), lists=("keys",))
def x04(spark, d):
    body = F.lit("[检索钥匙: alpha key / 12]\nSecond and second things, Today")
    given = F.array(*[F.lit(x) for x in ("[[Second]]", "second", "absent", "x", "Today", "---")])
    return V.memories(spark, d).select("id", X.literal_keys(body, given, ("today",)).alias("keys"))


# --- rules of records, candidates and scores --------------------------------


@query("m16_intent_boosts", f"SELECT id, round(CASE WHEN id % 3 = 0 THEN (CASE WHEN EXISTS (SELECT 1 FROM edges WHERE source = id AND type = 'kin') THEN 1.05 ELSE 1.0 END) * (CASE WHEN type = 'feel' THEN 1.05 ELSE 1.0 END) WHEN id % 3 = 1 AND {_sql_age('event_at')} <= 14 THEN 1.15 ELSE 1.0 END::DOUBLE, 6) AS boost FROM memories", ("memories", "edges"))
def m16(spark, d):
    related = V.edges(spark, d).filter("type = 'kin'").groupBy(F.col("source").alias("id")).agg(N().alias("n"))
    intent = F.when(i() % 3 == 0, "relation").when(i() % 3 == 1, "temporal").otherwise("fact")
    m = V.memories(spark, d).join(related, "id", "left")
    return m.select("id", F.round(S.intent_boost(intent, F.coalesce("n", F.lit(0)), F.concat("domain", "tags", F.array("type")), _age("event_at")), 6).alias("boost"))


@query("f24_superseded_facts", "SELECT id FROM memories WHERE id % 4 = 0 AND id % 3 = 0 AND id % 5 <> 0", ("memories",))
def f24(spark, d):
    from ..functions.facts import suppressed

    status, key, next_ = F.when(i() % 4 == 0, " Historical").otherwise("current"), F.when(i() % 3 == 0, "a.b").otherwise(" "), F.when(i() % 5 != 0, i() + 1)
    return V.memories(spark, d).filter(suppressed(status, key, next_)).select("id")


@query("m23_resolved_time", "SELECT id, epoch_us(CASE id % 5 WHEN 0 THEN last_active WHEN 1 THEN event_at WHEN 2 THEN last_active WHEN 3 THEN event_at END) AS us FROM memories", ("memories",))
def m23(spark, d):
    from ..functions.facts import event_time

    k, event, active = i() % 5, F.col("event_at"), F.col("last_active")
    own, created = F.when(k.isin(0, 1, 3), event), F.when(k.isin(0, 1), active)
    source = F.when(k == 0, "recorded_at_default").otherwise("explicit")
    return V.memories(spark, d).select("id", F.unix_micros(event_time(own, created, source, F.when(k == 2, active)).cast("timestamp")).alias("us"))


@query("x35_candidate_axes", "SELECT id, CASE id % 4 WHEN 0 THEN ['M', 'X'] WHEN 1 THEN ['M', 'X', 'Y', 'Z'] WHEN 2 THEN ['M'] END AS axes FROM memories", ("memories",), lists=("axes",))
def x35(spark, d):
    from ..functions.facts import axes

    kind = F.when(i() % 4 == 0, "event").when(i() % 4 == 1, "fact").when(i() % 4 == 2, "engineering_decision").otherwise("rumour")
    return V.memories(spark, d).select("id", axes(kind, F.when(i() % 4 == 0, 0).otherwise(2)).alias("axes"))


@query("x36_cited_evidence", "SELECT conv_id, turn, turn % 3 = 0 AS literal FROM conversations WHERE length(text) > 3")
def x36(spark, d):
    c = V.read(spark, d, "conversations").filter(F.length("text") > 3)
    quote = F.when(F.col("turn") % 3 == 0, F.substring("text", 2, 3)).otherwise(F.concat("text", F.lit("?")))
    cited = c.select("conv_id", "turn", "text", quote.alias("evidence"))
    return cited.select("conv_id", "turn", ((F.length("evidence") > 0) & F.contains("text", F.col("evidence"))).alias("literal"))


@query("f26_score_contract", "SELECT id, CASE id % 8 WHEN 0 THEN 'schema.valence' WHEN 1 THEN 'range.valence' WHEN 2 THEN 'range.tension' WHEN 3 THEN 'confidence.low' WHEN 4 THEN 'enum.response_tendency' WHEN 5 THEN 'enum.growth_delta' END AS error FROM memories", ("memories",))
def f26(spark, d):
    from ..functions.facts import score_error

    k = i() % 8
    valence, tension, sure = F.when(k == 1, -1.5).when(k != 0, F.col("valence")), F.when(k == 2, 1.2).otherwise(0.5), F.when(k == 3, 0.1).otherwise(0.9)
    got = score_error(valence, F.col("arousal"), tension, sure, F.when(k == 4, "sulk").otherwise("engage"), F.when(k == 5, "leap").otherwise("stable"))
    return V.memories(spark, d).select("id", got.alias("error"))


@query("q24_ledger_integrity", """SELECT 'turns' AS part, count(*) AS rows, count(*) FILTER (prior IS NOT NULL AND turn <> prior + 1) AS broken FROM (SELECT turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM conversations)
UNION ALL SELECT 'lines', count(*), count(*) FILTER (o_orderkey IS NULL) FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
UNION ALL SELECT 'orders', count(*), count(*) FILTER (c_custkey IS NULL OR o_orderstatus NOT IN ('O', 'F', 'P')) FROM orders LEFT JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT 'texts', count(*), count(*) FILTER (n_chars <> length(text)) FROM documents""")
def q24(spark, d):
    """Sequence, reference, state and stored length of each part of the store."""
    read = lambda t: V.read(spark, d, t)
    prior = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = read("conversations").select("turn", prior.alias("prior")).select((F.col("prior").isNotNull() & (F.col("turn") != F.col("prior") + 1)).alias("bad"))
    orders = read("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    lines = read("lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(orders.select("o_orderkey", F.lit(False).alias("bad")), "o_orderkey", "left")
    kept = orders.withColumnRenamed("o_custkey", "c_custkey").join(read("customer").select("c_custkey", F.lit(True).alias("known")), "c_custkey", "left")
    texts = read("documents").select((F.col("n_chars") != F.length("text")).alias("bad"))
    part = lambda name, df: df.agg(N().alias("rows"), F.count_if(F.coalesce("bad", F.lit(name != "texts"))).alias("broken")).select(F.lit(name).alias("part"), "rows", "broken")
    states = kept.select((F.col("known").isNull() | ~F.col("o_orderstatus").isin("O", "F", "P")).alias("bad"))
    return part("turns", turns).unionByName(part("lines", lines)).unionByName(part("orders", states)).unionByName(part("texts", texts))


