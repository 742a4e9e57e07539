"""Queries of rules: worlds, slots, merging, dates in text, conflicts, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import dates as D
from ..functions import facts as R
from ..functions import scoring as S
from ..functions import text as X
from ..operators import facts as O
from ..sources import views as V
from .catalog import SQL_REF, case, query

i = lambda: F.col("id")
N = lambda: F.count(F.lit(1))
SQL_PROTECTED = "['恋爱', '纪念日', '约定', '家庭', '自省', 'feel']"

# --- worlds, eligibility, merging -------------------------------------------


@query("f03_world_param", "SELECT 'all' AS param, count(*) AS n FROM memories UNION ALL SELECT ' north, south', count(*) FROM memories WHERE world IN ('shared', 'north', 'south') UNION ALL SELECT '', count(*) FROM memories WHERE world IN ('shared', 'north')", ("memories",))
def f03(spark, d):
    m = V.memories(spark, d)
    one = lambda p: m.filter(O.world_filter(p, "north")).agg(N().alias("n")).select(F.lit(p).alias("param"), "n")
    return one("all").unionByName(one(" north, south")).unionByName(one(""))


@query("f08_slot_exempt", f"SELECT id, pinned OR protected OR lower(kind) IN ('permanent', 'feel', 'episode', 'saga') OR list_has_any(dom, {SQL_PROTECTED}) AS exempt FROM (SELECT *, CASE WHEN id % 11 = 0 THEN 'Episode' ELSE type END AS kind, CASE WHEN id % 13 = 0 THEN ['家庭', 'en'] ELSE domain END AS dom FROM memories)", ("memories",))
def f08(spark, d):
    kind, dom = F.when(i() % 11 == 0, "Episode").otherwise(F.col("type")), F.when(i() % 13 == 0, F.array(F.lit("家庭"), F.lit("en"))).otherwise(F.col("domain"))
    return V.memories(spark, d).select("id", R.slot_exempt(F.col("pinned"), F.col("protected"), kind, dom).alias("exempt"))


@query("f12_episode_exempt", f"SELECT id, pinned OR protected OR type IN ('permanent', 'feel') OR id % 17 = 0 OR list_has_any(domain, {SQL_PROTECTED}) AS exempt FROM memories", ("memories",))
def f12(spark, d):
    chord = F.when(i() % 17 == 0, "c").otherwise("")
    return V.memories(spark, d).select("id", (F.col("pinned") | F.col("protected") | F.col("type").isin("permanent", "feel") | (chord != "") | R.protected_domain(F.col("domain"))).alias("exempt"))


@query("f13_eligible", "SELECT id FROM (SELECT id, CASE id % 23 WHEN 0 THEN 'archived' WHEN 1 THEN 'nsfw' ELSE type END AS kind FROM memories) WHERE id IS NOT NULL AND kind NOT IN ('archived', 'nsfw')", ("memories",))
def f13(spark, d):
    kind = F.when(i() % 23 == 0, "archived").when(i() % 23 == 1, "nsfw").otherwise(F.col("type"))
    return V.memories(spark, d).filter(i().isNotNull() & ~kind.isin("archived", "nsfw")).select("id")


SQL_SECRET = " OR ".join("regexp_matches(content, '" + p.replace("'", "''") + "')" for p, _ in X.MASKS)


@query("f14_merge_protected", f"SELECT id, pinned OR protected OR type IN ('permanent', 'feel') OR ({SQL_SECRET}) OR id % 19 = 0 AS held FROM memories", ("memories",))
def f14(spark, d):
    chord = F.when(i() % 19 == 0, " a ").otherwise(" ")
    c = F.col
    return V.memories(spark, d).select("id", R.merge_protected(c("pinned"), c("protected"), c("type"), c("content"), c("domain"), F.array(F.lit("en")), chord).alias("held"))


@query("f16_merge_threshold", "SELECT id FROM memories WHERE id * 37 % 101 > 85 OR (id * 53 % 101) / 100.0 >= 0.78", ("memories",))
def f16(spark, d):
    return V.memories(spark, d).filter(O.passes_merge((i() * 37 % 101).cast("double"), (i() * 53 % 101) / F.lit(100.0))).select("id")


@query("f23_overlay", "SELECT id FROM memories WHERE id NOT IN (SELECT source FROM edges WHERE type = 'updates' AND target IS NOT NULL)", ("memories", "edges"))
def f23(spark, d):
    overlay = V.edges(spark, d).select(F.col("source").alias("historical"), F.col("target").alias("current"), F.when(F.col("type") == "updates", "active").otherwise("closed").alias("status"))
    return O.without_suppressed(V.memories(spark, d).select("id"), overlay, "what is it now")


SQL_FACTS = """facts AS (SELECT id, content, name, domain, tags, type, pinned, protected, event_at, thread, 'pref.k' || (id % 9) AS fact_key,
  CASE id % 4 WHEN 0 THEN 'historical' WHEN 1 THEN 'contested' ELSE 'current' END AS fact_status, name AS fact_value FROM memories)"""


def facts(spark, d):
    status = F.when(i() % 4 == 0, "historical").when(i() % 4 == 1, "contested").otherwise("current")
    return V.memories(spark, d).select("id", "content", "name", "domain", "tags", "type", "pinned", "protected", "event_at", "thread", F.concat(F.lit("pref.k"), (i() % 9).cast("string")).alias("fact_key"), status.alias("fact_status"), F.col("name").alias("fact_value"))


def registry(spark):
    """Slots k0 to k6 with constraints on k1, k2 and k3."""
    rows = [("pref.k0", ["zero"], [], [], [], []), ("pref.k1", ["one", "uno"], ["EN", "fr"], [], [], []), ("pref.k2", ["two"], [], ["dynamic"], [], ["src1"]), ("pref.k3", ["three"], [], [], ["src3", "src4"], [])] + [(f"pref.k{k}", [f"label {k}"], [], [], [], []) for k in (4, 5, 6)]
    return spark.createDataFrame(rows, "fact_key string, aliases array<string>, domains array<string>, types array<string>, tags_any array<string>, name_contains array<string>")


SQL_REGISTRY = """registry AS (SELECT * FROM (VALUES ('pref.k0', ['zero']), ('pref.k1', ['one', 'uno']), ('pref.k2', ['two']), ('pref.k3', ['three']), ('pref.k4', ['label 4']), ('pref.k5', ['label 5']), ('pref.k6', ['label 6'])) t(fact_key, aliases)),
applied AS (SELECT f.*, r.fact_key IS NOT NULL AND CASE f.fact_key WHEN 'pref.k1' THEN domain[1] IN ('en', 'fr') WHEN 'pref.k2' THEN type = 'dynamic' AND contains(lower(name), 'src1') WHEN 'pref.k3' THEN list_has_any(tags, ['src3', 'src4']) ELSE true END AS applies FROM facts f LEFT JOIN registry r USING (fact_key))"""


@query("f09_slot_context", f"WITH {SQL_FACTS}, {SQL_REGISTRY} SELECT id, fact_key FROM applied WHERE applies", ("memories",))
def f09(spark, d):
    return O.applying(facts(spark, d), registry(spark)).filter("applies").select("id", "fact_key")


SQL_HIDDEN = f"applies AND fact_status = 'historical' AND NOT (pinned OR protected OR type IN ('permanent', 'feel'))"


@query("f07_slot_filter", f"WITH {SQL_FACTS}, {SQL_REGISTRY} SELECT id FROM applied WHERE NOT ({SQL_HIDDEN} AND fact_key IN ('pref.k1', 'pref.k4'))", ("memories",))
def f07(spark, d):
    return O.filter_slots(facts(spark, d), registry(spark), "fact", ["pref.k1", "pref.k4"]).select("id")


@query("f06_state_filter", f"WITH {SQL_FACTS}, {SQL_REGISTRY}, q AS (SELECT * FROM (VALUES ('what is one now'), ('label 4 before the move'), ('unrelated')) t(question)) SELECT question, count(*) AS kept FROM q, applied WHERE NOT ({SQL_HIDDEN} AND CASE question WHEN 'what is one now' THEN fact_key = 'pref.k1' ELSE false END) GROUP BY 1", ("memories",))
def f06(spark, d):
    out = None
    for question in ("what is one now", "label 4 before the move", "unrelated"):
        one = O.for_question(facts(spark, d), registry(spark), question).agg(N().alias("kept")).select(F.lit(question).alias("question"), "kept")
        out = one if out is None else out.unionByName(one)
    return out


@case("x12_alias_expansion", f"WITH {SQL_FACTS}, {SQL_REGISTRY} SELECT fact_key, unnest(aliases) AS alias FROM registry", ("memories",))
def x12(spark, d):
    return O.aliases(registry(spark))


@query("x13_label_lines", "SELECT id, 'pref.k' || slot AS fact_key, value FROM (SELECT id, id % 3 AS slot, name AS value FROM memories UNION ALL SELECT id, 4, thread FROM memories WHERE id % 5 <> 0)", ("memories",))
def x13(spark, d):
    label = F.when(i() % 3 == 0, "Zero").when(i() % 3 == 1, "uno").otherwise("two")
    body = F.concat(label, F.lit(": "), F.col("name"), F.lit("\nlabel 4： "), F.col("thread"), F.lit("\nunknown: x"), F.when(i() % 5 == 0, "\nlabel 4: other").otherwise(""))
    return O.labelled(V.memories(spark, d).select("id", body.alias("content")), registry(spark))


@case("x14_question_slots", "SELECT * FROM (VALUES ('what is one now', 'pref.k1'), ('is LABEL 5 the same as two?', 'pref.k5'), ('is LABEL 5 the same as two?', 'pref.k2')) t(question, fact_key)")
def x14(spark, d):
    return O.mentioned_slots(spark.createDataFrame([("what is one now",), ("is LABEL 5 the same as two?",), ("nobody knows",)], "question string"), registry(spark))


@case("r84_slot_mentions", "SELECT 'one and uno, label 6' AS question, 'label 6' AS alias, 'pref.k6' AS fact_key UNION ALL SELECT 'one and uno, label 6', 'one', 'pref.k1' UNION ALL SELECT 'one and uno, label 6', 'uno', 'pref.k1'")
def r84(spark, d):
    return O.mentions(spark.createDataFrame([("one and uno, label 6",), ("twofold",)], "question string"), registry(spark))


@query("x16_state_label", f"WITH {SQL_FACTS}, {SQL_REGISTRY} SELECT id, CASE WHEN NOT applies THEN 'none' ELSE fact_status END AS state FROM applied", ("memories",))
def x16(spark, d):
    return O.applying(facts(spark, d), registry(spark)).select("id", O.state_label().alias("state"))


@query("x17_aligned", f"WITH {SQL_FACTS} SELECT id, CAST(row_number() OVER (ORDER BY CASE fact_status WHEN 'historical' THEN 1 ELSE 0 END, pos) AS INTEGER) AS place FROM (SELECT *, row_number() OVER (ORDER BY event_at DESC, id) AS pos FROM facts ORDER BY event_at DESC, id LIMIT 50)", ("memories",))
def x17(spark, d):
    page = facts(spark, d).orderBy(F.desc("event_at"), "id").limit(50)
    return O.aligned(page, "current", [F.desc("event_at"), i()]).select("id", "place")


@query("x18_link_targets", "SELECT id, CASE id % 3 WHEN 0 THEN [id + 1] WHEN 1 THEN [id - 1] ELSE [] END AS targets FROM memories", ("memories",), lists=("targets",))
def x18(spark, d):
    status = F.when(i() % 3 == 0, "historical").when(i() % 3 == 1, "current").otherwise("contested")
    return V.memories(spark, d).select("id", O.link_targets(status, i() + 1, F.array(i() - 1)).alias("targets"))


@case("x15_state_view", "SELECT * FROM (VALUES ('以前住哪', 'historical'), ('现在住哪', 'current'), ('从北京到上海的变化', 'transition'), ('住哪', 'neutral'), ('以前和现在', 'transition')) t(question, view)")
def x15(spark, d):
    q = spark.createDataFrame([("以前住哪",), ("现在住哪",), ("从北京到上海的变化",), ("住哪",), ("以前和现在",)], "question string")
    return q.select("question", O.state_view(F.col("question")).alias("view"))


# --- dates ------------------------------------------------------------------


@query("m24_relative_time", f"SELECT id, CAST(epoch_us(CASE id % 7 WHEN 0 THEN {SQL_REF} WHEN 1 THEN {SQL_REF} WHEN 2 THEN {SQL_REF} - INTERVAL 1 DAY WHEN 3 THEN {SQL_REF} - to_days(CAST(id % 100 AS INTEGER)) WHEN 4 THEN {SQL_REF} + to_hours(CAST(id % 100 AS BIGINT)) WHEN 5 THEN TIMESTAMP '2024-03-05 10:20:30' END) AS BIGINT) AS at FROM memories", ("memories",))
def m24(spark, d):
    n = (i() % 100).cast("string")
    said = F.when(i() % 7 == 0, " Now ").when(i() % 7 == 1, "today").when(i() % 7 == 2, "YESTERDAY").when(i() % 7 == 3, F.concat(F.lit("-"), n, F.lit("d"))).when(i() % 7 == 4, F.concat(n, F.lit("H"))).when(i() % 7 == 5, "2024-03-05T10:20:30").otherwise("soon")
    return V.memories(spark, d).select("id", F.unix_micros(D.relative_time(said, V.ref()).cast("timestamp")).alias("at"))


@query("m26_recorded_at", "SELECT event_id, strftime(CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) + INTERVAL 8 HOUR WHEN 1 THEN date_trunc('second', ts) + INTERVAL 8 HOUR WHEN 2 THEN date_trunc('second', ts) + INTERVAL 6 HOUR END, '%Y-%m-%d %H:%M:%S') AS local FROM events")
def m26(spark, d):
    e, k = V.read(spark, d, "events"), F.col("event_id") % 4
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    said = F.when(k == 0, s.cast("string")).when(k == 1, (s * 1000).cast("string")).when(k == 2, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).otherwise(F.date_format("ts", "HH:mm"))
    return e.select("event_id", F.date_format(D.recorded_at(said), "yyyy-MM-dd HH:mm:ss").alias("local"))


@query("m27_local_day", "SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def m27(spark, d):
    local = F.convert_timezone(F.lit("UTC"), F.lit(DEFAULTS.zone), F.col("ts"))
    return V.read(spark, d, "events").groupBy(F.date_format(local, "yyyy-MM-dd").alias("day")).agg(N().alias("n"))


SQL_DATED = "SELECT *, CASE id % 6 WHEN 0 THEN 'on 2024-01-' || (1 + id % 28) || ' and 2024/02/30' WHEN 1 THEN '12024-01-05 then 2024.1.7' WHEN 2 THEN '2023-05-05, 2024-13-01, 2024/1/9' WHEN 3 THEN '2031-01-01' WHEN 4 THEN '2024-01.05' ELSE 'none' END AS said FROM memories"


def _said():
    day = (1 + i() % 28).cast("string")
    return F.when(i() % 6 == 0, F.concat(F.lit("on 2024-01-"), day, F.lit(" and 2024/02/30"))).when(i() % 6 == 1, "12024-01-05 then 2024.1.7").when(i() % 6 == 2, "2023-05-05, 2024-13-01, 2024/1/9").when(i() % 6 == 3, "2031-01-01").when(i() % 6 == 4, "2024-01.05").otherwise("none")


SQL_FIRST = "CASE id % 6 WHEN 0 THEN '2024-01-' || lpad((1 + id % 28)::VARCHAR, 2, '0') WHEN 1 THEN '2024-01-07' WHEN 2 THEN '2024-01-09' END"


@query("m29_first_date", f"SELECT id, {SQL_FIRST} AS day FROM ({SQL_DATED})", ("memories",))
def m29(spark, d):
    return V.memories(spark, d).select("id", D.first_date(_said(), V.ref().cast("date")).cast("string").alias("day"))


@query("m30_inferred_date", f"SELECT id, CASE WHEN id % 5 = 0 THEN '2024-01-02' WHEN id % 5 = 1 THEN '2024-01-03' ELSE {SQL_FIRST} END AS day, CASE WHEN id % 5 = 0 THEN 'name' WHEN id % 5 = 1 THEN 'tag' WHEN {SQL_FIRST} IS NOT NULL THEN 'content' ELSE 'no-date-found' END AS source FROM memories", ("memories",))
def m30(spark, d):
    name, tags = F.when(i() % 5 == 0, "x 2024-01-02").otherwise(F.col("name")), F.when(i() % 5 == 1, F.array(F.lit("a"), F.lit("2024/1/3"), F.lit("2024-01-04"))).otherwise(F.col("tags"))
    got = D.inferred_date(name, tags, _said(), V.ref().cast("date"))
    return V.memories(spark, d).select("id", got.alias("x")).select("id", F.col("x.day").cast("string").alias("day"), "x.source")


@query("m31_time_metadata", f"SELECT source, count(*) AS n, round(sum(conf::DOUBLE), 4) AS conf FROM (SELECT CASE WHEN id % 5 = 0 THEN 'existing_event_at' WHEN {SQL_FIRST} IS NOT NULL THEN 'content' ELSE 'legacy_created' END AS source, CASE WHEN id % 5 = 0 THEN 1.0 WHEN {SQL_FIRST} IS NOT NULL THEN 0.5 ELSE 0.3 END AS conf FROM memories) GROUP BY 1", ("memories",))
def m31(spark, d):
    event = F.when(i() % 5 == 0, F.col("event_at"))
    found = D.inferred_date(F.col("name"), F.col("tags"), _said(), V.ref().cast("date"))
    source = F.when(event.isNotNull(), "existing_event_at").when(found["day"].isNotNull(), found["source"]).otherwise("legacy_created")
    table = F.create_map(*[F.lit(x) for kv in D.CONFIDENCE.items() for x in kv])
    return V.memories(spark, d).select(source.alias("source")).groupBy("source").agg(N().alias("n"), F.round(F.sum(F.try_element_at(table, F.col("source"))), 4).alias("conf"))


@query("r38_canonical_utc", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.000000+00:00') WHEN 1 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.000000+00:00') END AS at, CASE event_id % 4 WHEN 2 THEN 'timezone_missing' WHEN 3 THEN 'invalid' END AS error FROM events")
def r38(spark, d):
    k, iso = F.col("event_id") % 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    said = F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, F.concat(iso, F.lit("+02:00"))).when(k == 2, iso).otherwise(F.date_format("ts", "yyyy/MM/dd"))
    return V.read(spark, d, "events").select("event_id", D.canonical_utc(said).alias("x")).select("event_id", "x.at", "x.error")


@query("r85_parse_created", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d 00:00:00') END AS at FROM events")
def r85(spark, d):
    k = F.col("event_id") % 3
    said = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise("soon")
    naive = F.regexp_replace(F.trim(said), "Z|[+-]\\d{2}:\\d{2}$", "").try_cast("timestamp_ntz")
    return V.read(spark, d, "events").select("event_id", F.date_format(naive, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("r79_event_time", "SELECT event_id, strftime(CASE WHEN event_id % 2 = 0 THEN ts ELSE ts - INTERVAL 2 HOUR END, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def r79(spark, d):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    said = F.when(F.col("event_id") % 2 == 0, iso).otherwise(F.concat(iso, F.lit("+02:00")))
    return V.read(spark, d, "events").select("event_id", F.date_format(said.try_cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("at"))


# --- conflicts and text -----------------------------------------------------

SQL_PAIR = """SELECT id, 'Plan: alpha' || chr(10) || 'size = ' || (id % 4) || 'kg' || chr(10) || 'on 2024-01-0' || (1 + id % 3) || CASE WHEN id % 5 = 0 THEN ' is not ready' ELSE ' is ready' END AS old,
  'plan: ' || CASE WHEN id % 2 = 0 THEN 'alpha' ELSE '[[x|beta]]' END || chr(10) || 'now ' || (id % 6) || 'kg on 2024-01-0' || (1 + id % 2) || ' is ready' AS new FROM memories"""
SQL_CONFLICTS = f"""WITH p AS ({SQL_PAIR}), c AS (
  SELECT id, 0 AS k, 'plan' AS field, 'alpha' AS old, 'beta' AS new FROM p WHERE id % 2 = 1
  UNION ALL SELECT id, 1, 'date', '2024-01-0' || (1 + id % 3), '2024-01-0' || (1 + id % 2) FROM p WHERE id % 3 <> id % 2
  UNION ALL SELECT id, 2, 'number', (id % 4) || 'kg', (id % 6) || 'kg' FROM p WHERE id % 4 <> id % 6
  UNION ALL SELECT id, 3, 'negation', 'negated', 'affirmed' FROM p WHERE id % 5 = 0)"""


def _pair(spark, d):
    s = lambda x: x.cast("string")
    old = F.concat(F.lit("Plan: alpha\nsize = "), s(i() % 4), F.lit("kg\non 2024-01-0"), s(1 + i() % 3), F.when(i() % 5 == 0, " is not ready").otherwise(" is ready"))
    new = F.concat(F.lit("plan: "), F.when(i() % 2 == 0, "alpha").otherwise("[[x|beta]]"), F.lit("\nnow "), s(i() % 6), F.lit("kg on 2024-01-0"), s(1 + i() % 2), F.lit(" is ready"))
    return V.memories(spark, d).select("id", old.alias("old"), new.alias("new"))


@query("x09_conflicts", f"{SQL_CONFLICTS} SELECT id, field, old, new FROM c", ("memories",))
def x09(spark, d):
    return _pair(spark, d).select("id", F.inline(R.conflicts(F.col("old"), F.col("new"))))


@query("x10_supersedes_audit", f"{SQL_CONFLICTS} SELECT id, count(*) AS n, string_agg(field || '@2024-02-01T00:00:00', ',' ORDER BY k) AS audit FROM c GROUP BY id", ("memories",))
def x10(spark, d):
    signed = _pair(spark, d).select("id", R.signature(F.col("old")).alias("old"), R.signature(F.col("new")).alias("new"))
    found = signed.select("id", R.conflicting(F.col("old"), F.col("new")).alias("entries"))
    entries = F.col("entries")
    stamped = F.transform(entries, lambda c: F.concat(c["field"], F.lit("@"), F.date_format(V.ref(), "yyyy-MM-dd'T'HH:mm:ss")))
    return found.select("id", F.size(entries).cast("long").alias("n"), F.array_join(stamped, ",").alias("audit")).filter("n > 0")


@case("x52_asks_history", "SELECT * FROM (VALUES ('Where did I live BEFORE?', true), ('上次说了什么', true), ('where now', false), (NULL, false)) t(question, history)")
def x52(spark, d):
    q = spark.createDataFrame([("Where did I live BEFORE?",), ("上次说了什么",), ("where now",), (None,)], "question string")
    return q.select("question", F.coalesce(R.asks_history(F.col("question")), F.lit(False)).alias("history"))


@query("m32_anchor_relevance", "SELECT id, CASE WHEN id % 4 = 3 THEN NULL ELSE round(0.45 * greatest(CASE WHEN id % 4 IN (0, 1) THEN least(1.0, (id * 37 % 130) / 100.0) END, CASE WHEN id % 4 IN (1, 2) THEN (id * 53 % 101) / 100.0 END), 6) END AS score FROM memories", ("memories",))
def m32(spark, d):
    literal, vector = F.when(i() % 4 < 2, (i() * 37 % 130).cast("double")), F.when((i() % 4 == 1) | (i() % 4 == 2), (i() * 53 % 101) / F.lit(100.0))
    return V.memories(spark, d).select("id", S.anchor_relevance(literal, vector, F.lit(False)).alias("score"))


@query("m33_anchor_priority", "SELECT id, CASE WHEN pinned OR protected THEN 0 WHEN valence >= 0.8 THEN 1 WHEN id % 7 = 0 THEN 2 ELSE 3 END AS priority FROM memories", ("memories",))
def m33(spark, d):
    tags = F.when(i() % 7 == 0, F.array(F.lit("核心事"))).otherwise(F.col("tags"))
    hay = F.concat_ws(" ", "name", F.col("domain"), tags)
    priority = F.when(F.col("pinned") | F.col("protected"), 0).when(F.col("valence") >= 0.8, 1).when(F.contains(hay, F.lit("核心")), 2).otherwise(3)
    return V.memories(spark, d).select("id", priority.alias("priority"))


@query("m17_scaled_limit", "SELECT id, CAST(CASE WHEN id % 3 = 0 THEN id % 11 ELSE ceil((id % 11) * 1.5) END AS INTEGER) AS n FROM memories", ("memories",))
def m17(spark, d):
    base, explicit = i() % 11, i() % 3 == 0
    return V.memories(spark, d).select("id", F.when(explicit, base).otherwise(F.ceil(base * 1.5)).cast("int").alias("n"))


@query("r02_pair_fingerprint", "SELECT id, sha256(CASE WHEN id % 50 = 0 THEN 'true' ELSE 'false' END || '|' || length(content) || '|' || name || '|' || type || '|' || array_to_string(domain, ',')) AS digest FROM memories", ("memories",))
def r02(spark, d):
    key = F.concat_ws("|", F.col("pinned").cast("string"), F.length("content").cast("string"), "name", "type", F.array_join("domain", ","))
    return V.memories(spark, d).select("id", F.sha2(key.cast("binary"), 256).alias("digest"))


@query("x29_canonical_json", """SELECT id, sha256('{"domain":["' || domain[1] || '"],"id":' || id || ',"name":"' || name || '"}') AS digest FROM memories""", ("memories",))
def x29(spark, d):
    return V.memories(spark, d).select("id", F.sha2(F.to_json(F.struct("domain", "id", "name")).cast("binary"), 256).alias("digest"))


@query("r26_keep_indices", "SELECT id, CASE id % 5 WHEN 0 THEN [0, 2] WHEN 1 THEN [1] WHEN 2 THEN [] END AS keep FROM memories", ("memories",), lists=("keep",))
def r26(spark, d):
    raw = F.when(i() % 5 == 0, "[0, 2, 9]").when(i() % 5 == 1, '```json\n{"keep": [1]}\n```').when(i() % 5 == 2, "[]").when(i() % 5 == 3, "[7, 8]").otherwise("keep all")
    return V.memories(spark, d).select("id", O.keep_indices(raw, 5).alias("keep"))


@query("r63_vector_segments", "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 1 THEN 'dimension' WHEN vec_id % 3 = 2 THEN 'non-finite' END AS error FROM embeddings")
def r63(spark, d):
    v = V.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    bad = F.transform("v", lambda x: F.when(x == F.element_at("v", 1), F.lit(float("nan"))).otherwise(x.cast("double")))
    seg = F.when(F.col("id") % 3 == 0, F.col("v").cast("array<double>")).when(F.col("id") % 3 == 1, F.slice("v", 1, 63).cast("array<double>")).otherwise(bad)
    return v.select("id", O.segment_error(seg, 64).alias("error"))


@query("r82_strict_extension", "SELECT id, id % 3 = 0 AS ok FROM memories", ("memories",))
def r82(spark, d):
    old = F.array(i(), i() + 1)
    new = F.when(i() % 3 == 0, F.array(i(), i() + 1, i() + 2)).when(i() % 3 == 1, old).otherwise(F.array(i() + 1, i(), i() + 2))
    return V.memories(spark, d).select("id", O.extends(old, new).alias("ok"))


@query("r86_metadata_terms", "SELECT id, array_to_string(list_sort(list_distinct([domain[1], tags[1], tags[2], type])), ',') AS terms FROM memories", ("memories",))
def r86(spark, d):
    terms = F.array_distinct(F.filter(F.transform(F.concat("domain", "tags", F.array("type")), lambda x: F.trim(x)), lambda x: x != ""))
    return V.memories(spark, d).select("id", F.array_join(F.array_sort(terms), ",").alias("terms"))


@query("r41_append_if_absent", "SELECT id, CASE WHEN id % 2 = 0 THEN [1, 2] ELSE [1, 2, 3] END AS members FROM memories", ("memories",), lists=("members",))
def r41(spark, d):
    have, new = F.array(F.lit(1), F.lit(2)), F.when(i() % 2 == 0, 2).otherwise(3)
    return V.memories(spark, d).select("id", F.when(F.array_contains(have, new), have).otherwise(F.array_append(have, new)).alias("members"))


@query("x41_angles", "SELECT id, CASE id % 3 WHEN 0 THEN ['a', 'b c'] WHEN 1 THEN ['x', 'y'] ELSE ['7'] END AS angles FROM memories", ("memories",), lists=("angles",))
def x41(spark, d):
    raw = F.when(i() % 3 == 0, '```json\n["a", "b c", " "]\n```').when(i() % 3 == 1, "- x，y,\n").otherwise("[7]")
    return V.memories(spark, d).select("id", O.angles(raw).alias("angles"))


@query("x42_navigator_summary", "SELECT id, CASE id % 4 WHEN 0 THEN 'short' WHEN 1 THEN 'fact ' || id WHEN 2 THEN 'first line' ELSE 'none' END AS summary FROM memories", ("memories",))
def x42(spark, d):
    raw = F.when(i() % 4 == 0, '{"summary": " short "}').when(i() % 4 == 1, F.concat(F.lit('{"summary": "", "core_facts": ["fact '), i().cast("string"), F.lit('", "b"]}'))).when(i() % 4 == 2, "\n ![i](u)\n [[first]] line\nsecond").otherwise("  ")
    return V.memories(spark, d).select("id", O.navigator_summary(raw, 80, "none").alias("summary"))


@query("x54_memory_type", "SELECT id, CASE id % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'event' ELSE type END AS kind FROM memories", ("memories",))
def x54(spark, d):
    semantic, tags = F.when(i() % 3 == 0, "FACT "), F.when(i() % 3 == 1, F.array(F.lit("Event"), F.lit("x"))).otherwise(F.col("tags"))
    return V.memories(spark, d).select("id", O.memory_type(semantic, tags, F.col("type"), ["fact", "event", "preference"]).alias("kind"))


@query("x48_thread_hint", "SELECT id, CASE id % 4 WHEN 0 THEN 'other' WHEN 1 THEN 'other' WHEN 2 THEN 'Trip to Rome' ELSE 'other' END AS thread FROM memories", ("memories",))
def x48(spark, d):
    raw = F.when(i() % 4 == 0, "route:abc").when(i() % 4 == 1, "0123456789abcdef0123").when(i() % 4 == 2, " Trip to Rome ").otherwise("  ")
    return V.memories(spark, d).select("id", O.thread_hint(raw).alias("thread"))


@query("u05_as_list", "SELECT id, CASE id % 3 WHEN 0 THEN ['a'] WHEN 1 THEN ['a', 'b'] ELSE [] END AS items FROM memories", ("memories",), lists=("items",))
def u05(spark, d):
    raw = F.when(i() % 3 == 0, "a").when(i() % 3 == 1, '["a", "b"]')
    return V.memories(spark, d).select("id", O.as_list(raw).alias("items"))


@query("r90_entity_mentions", "SELECT id, array_to_string(['p:' || thread], ',') AS kept FROM memories", ("memories",))
def r90(spark, d):
    given = F.array(*[F.struct(m.alias("mention"), F.lit(t).alias("type")) for m, t in ((F.col("thread"), "Person"), (F.upper("thread"), "person"), (F.lit("某人"), "person"), (F.lit("zzz"), "place"), (F.col("thread"), "animal"))])
    body = F.concat(F.col("thread"), F.lit(" "), F.upper("thread"), F.lit(" 某人"))
    kept = O.entity_mentions(given, body)
    return V.memories(spark, d).select("id", F.array_join(F.transform(kept, lambda x: F.concat(F.substring(x["type"], 1, 1), F.lit(":"), x["mention"])), ",").alias("kept"))


@query("x28_classify", "SELECT id, CASE WHEN id % 3 = 0 THEN ['work', 'home'] WHEN id % 3 = 1 THEN ['home'] ELSE domain END AS domains FROM memories", ("memories",), lists=("domains",))
def x28(spark, d):
    body = F.when(i() % 3 == 0, "CODE review with the team; kitchen and garden").when(i() % 3 == 1, "kitchen, garden, one team").otherwise("nothing")
    table = {"home": ["kitchen", "garden"], "work": ["code", "review", "team"]}
    return V.memories(spark, d).select("id", O.classified(body, table, F.col("domain")).alias("domains"))


@query("r64_expansion", "SELECT id, ['q', 'a', 'b'] AS angles FROM memories", ("memories",), lists=("angles",))
def r64(spark, d):
    return V.memories(spark, d).select("id", F.slice(F.array_distinct(F.concat(F.array(F.lit("q")), F.split(F.lit("a,q,b,c"), ","))), 1, 3).alias("angles"))


@query("r62_failure", "SELECT event_id, event_id % 12 + 1 AS attempts, CAST(epoch_us(ts) AS BIGINT) + CAST(least(60 * pow(2, least(event_id % 12 + 1, 8)), 3600) AS BIGINT) * 1000000 AS due_us FROM events")
def r62(spark, d):
    n = F.col("event_id") % 12 + 1
    return V.read(spark, d, "events").select("event_id", n.alias("attempts"), (F.unix_micros(F.col("ts").cast("timestamp")) + S.backoff_s(n).cast("long") * 1_000_000).alias("due_us"))
