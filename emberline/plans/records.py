"""More queries of the record store: eligibility, links, status classes, arrays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as X
from ..operators import ledger, ranking, vectors
from ..sources import views as V
from .catalog import QUERY_VECTOR, SQL_CHANNELS, SQL_QUERY, SQL_REF, _age, _channels, _sql_age, query

N = lambda: F.count(F.lit(1))


@query("f04_main_recall", "SELECT id FROM memories WHERE type <> 'permanent' AND thread NOT LIKE 'src1%'", ("memories",))
def f04(spark, d):
    return V.memories(spark, d).filter((F.col("type") != "permanent") & ~F.col("thread").startswith("src1")).select("id")


@query("f10_scan_candidates", "SELECT id FROM memories WHERE NOT resolved AND NOT pinned AND NOT protected AND length(trim(content)) > 0", ("memories",))
def f10(spark, d):
    return V.memories(spark, d).filter(~F.col("resolved") & ~F.col("pinned") & ~F.col("protected") & (F.length(F.trim("content")) > 0)).select("id")


@query("f15_merge_chain", "SELECT a.id AS incoming, b.id AS existing FROM memories a JOIN memories b ON a.domain[1] = b.domain[1] AND a.thread = b.thread AND a.id <> b.id WHERE a.id % 40 = 0 AND NOT b.pinned AND NOT b.protected AND (b.valence > 0.85 OR b.arousal >= 0.78)", ("memories",))
def f15(spark, d):
    m = V.memories(spark, d).withColumn("primary", F.element_at("domain", 1))
    a = m.filter("id % 40 = 0").select(F.col("id").alias("incoming"), "primary", "thread")
    b = m.filter(~F.col("pinned") & ~F.col("protected") & ((F.col("valence") > 0.85) | (F.col("arousal") >= 0.78))).select(F.col("id").alias("existing"), "primary", "thread")
    return a.join(b, ["primary", "thread"]).filter("incoming <> existing").select("incoming", "existing")


@query("f15_merge_chain_all", "SELECT a.id AS incoming, b.id AS existing FROM memories a JOIN memories b ON a.domain[1] = b.domain[1] AND a.thread = b.thread AND a.id <> b.id WHERE NOT b.pinned AND NOT b.protected AND (b.valence > 0.85 OR b.arousal >= 0.78)", ("memories",))
def f15_all(spark, d):
    m = V.memories(spark, d).withColumn("primary", F.element_at("domain", 1))
    b = m.filter(~F.col("pinned") & ~F.col("protected") & ((F.col("valence") > 0.85) | (F.col("arousal") >= 0.78))).select(F.col("id").alias("existing"), "primary", "thread")
    pairs = ranking.spread_join(m.select(F.col("id").alias("incoming"), "primary", "thread"), b, ["primary", "thread"], "incoming")
    return pairs.filter("incoming <> existing").select("incoming", "existing")


@query("f17_currentness", "SELECT CASE WHEN resolved THEN 'superseded' WHEN type = 'permanent' THEN 'not_current' WHEN protected THEN 'unaudited' ELSE 'kept' END AS reason, count(*) AS n FROM memories GROUP BY 1", ("memories",))
def f17(spark, d):
    reason = F.when(F.col("resolved"), "superseded").when(F.col("type") == "permanent", "not_current").when(F.col("protected"), "unaudited").otherwise("kept")
    return V.memories(spark, d).groupBy(reason.alias("reason")).agg(N().alias("n"))


@query("f24_historical_suppressed", "SELECT id FROM memories WHERE resolved AND id % 5 = 0", ("memories",))
def f24(spark, d):
    return V.memories(spark, d).filter(F.col("resolved") & (F.col("id") % 5 == 0)).select("id")


@query("f25_projection", "SELECT id, coalesce(name, '') AS name, type, round(valence, 2) AS valence, md5(substr(content, 1, 200)) AS preview FROM memories", ("memories",))
def f25(spark, d):
    return V.memories(spark, d).select("id", F.coalesce("name", F.lit("")).alias("name"), "type", F.round("valence", 2).alias("valence"), F.md5(F.substring("content", 1, 200).cast("binary")).alias("preview"))


@query("f26_contract_errors", "SELECT event_id, CASE WHEN value IS NULL THEN 'missing' WHEN value < 5 THEN 'low' WHEN value > 95 THEN 'high' WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'kind' ELSE 'ok' END AS code FROM events")
def f26(spark, d):
    v = F.col("value")
    return V.read(spark, d, "events").select("event_id", F.when(v.isNull() | F.isnan(v), "missing").when(v < 5, "low").when(v > 95, "high").when(~F.col("event_type").isin("click", "view", "purchase"), "kind").otherwise("ok").alias("code"))


@query("j05_receipt_targets", "SELECT 'k:' || o_custkey AS key, min(o_orderkey) AS target FROM orders JOIN customer ON 'k:' || c_custkey = 'k:' || o_custkey GROUP BY 1 HAVING count(DISTINCT o_orderkey) = 1")
def j05(spark, d):
    c = V.read(spark, d, "customer").select(F.concat(F.lit("k:"), F.col("c_custkey").cast("string")).alias("key"))
    o = V.read(spark, d, "orders").select(F.concat(F.lit("k:"), F.col("o_custkey").cast("string")).alias("key"), "o_orderkey")
    return o.join(c, "key").groupBy("key").agg(F.min("o_orderkey").alias("target"), F.max("o_orderkey").alias("last")).filter("target = last").select("key", "target")


@query("j09_orphans", "SELECT count(*) AS orphans FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL")
def j09(spark, d):
    o = V.read(spark, d, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return V.read(spark, d, "lineitem").select("l_orderkey").join(o, "l_orderkey", "left_anti").agg(N().alias("orphans"))


@query("j12_alias_catalog", "SELECT lower(n_name) AS alias, r_name AS entity FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY length(n_name) DESC, alias")
def j12(spark, d):
    n, r = V.read(spark, d, "nation"), V.read(spark, d, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.lower("n_name").alias("alias"), F.col("r_name").alias("entity")).orderBy(F.desc(F.length("alias")), "alias")


@query("j13_linked_ids", "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 7))")
def j13(spark, d):
    c = V.read(spark, d, "customer").filter(F.col("c_nationkey").isin(3, 7)).select(F.col("c_custkey").alias("id"))
    return V.read(spark, d, "orders").select(F.col("o_custkey").alias("id")).join(c, "id", "left_semi").distinct()


@query("j14_fresh_links", "SELECT id FROM memories WHERE sha256(content) = sha256(CASE WHEN id % 3 = 0 THEN content || '.' ELSE content END)", ("memories",))
def j14(spark, d):
    m = V.memories(spark, d).select("id", "content")
    links = m.select("id", F.sha2(F.when(F.col("id") % 3 == 0, F.concat("content", F.lit("."))).otherwise(F.col("content")).cast("binary"), 256).alias("hash"))
    return m.select("id", F.sha2(F.col("content").cast("binary"), 256).alias("hash")).join(links, ["id", "hash"], "left_semi").select("id")


@query("j15_validity", "SELECT m.id, coalesce(v.state, 'none') AS state FROM memories m LEFT JOIN (SELECT event_id AS id, CASE WHEN value > 50 THEN 'current' ELSE 'historical' END AS state FROM events WHERE event_type = 'view') v ON v.id = m.id", ("memories",))
def j15(spark, d):
    v = V.read(spark, d, "events").filter("event_type = 'view'").select(F.col("event_id").alias("id"), F.when(F.col("value") > 50, "current").otherwise("historical").alias("state"))
    return V.memories(spark, d).select("id").join(v, "id", "left").select("id", F.coalesce("state", F.lit("none")).alias("state"))


@query("a10_link_currency", "SELECT o_custkey AS id, count(*) AS links, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS current FROM orders GROUP BY 1")
def a10(spark, d):
    return V.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(N().alias("links"), F.count_if(F.col("o_orderstatus") == "O").alias("current"))


@query("a11_min_distance", f"SELECT cluster AS bucket, round(min(1 - list_cosine_similarity(vec, {SQL_QUERY})), 6) AS distance FROM vectors GROUP BY 1 ORDER BY distance, bucket LIMIT 5", ("vectors",))
def a11(spark, d):
    q = F.array(*[F.lit(float(x)) for x in QUERY_VECTOR])
    v = V.vectors(spark, d)
    return v.groupBy(F.col("cluster").alias("bucket")).agg(F.round(F.min(1 - S.cosine(F.col("vec"), q)), 6).alias("distance")).orderBy("distance", "bucket").limit(5)


@query("a12_dominant_domain", "SELECT thread, domain FROM (SELECT thread, domain[1] AS domain, row_number() OVER (PARTITION BY thread ORDER BY count(*) DESC, domain[1]) AS rn FROM memories GROUP BY 1, 2) WHERE rn = 1", ("memories",))
def a12(spark, d):
    n = V.memories(spark, d).groupBy("thread", F.element_at("domain", 1).alias("domain")).agg(N().alias("n"))
    return ranking.first_by(n, ["thread"], [F.desc("n"), F.col("domain")]).select("thread", "domain")


@query("a14_slot_classes", "SELECT CASE WHEN pinned OR protected THEN 'exempt' WHEN resolved THEN 'historical' WHEN importance >= 8 THEN 'current' ELSE 'unset' END AS class, count(*) AS n, count(DISTINCT thread) AS threads FROM memories GROUP BY 1", ("memories",))
def a14(spark, d):
    kind = F.when(F.col("pinned") | F.col("protected"), "exempt").when(F.col("resolved"), "historical").when(F.col("importance") >= 8, "current").otherwise("unset")
    return V.memories(spark, d).groupBy(kind.alias("class")).agg(N().alias("n"), F.count_distinct("thread").alias("threads"))


@query("a17_axis_counts", "SELECT count(*) FILTER (event_type = 'click') AS x, count(*) FILTER (event_type = 'view') AS y, count(*) FILTER (event_type = 'error') AS z FROM events")
def a17(spark, d):
    return V.read(spark, d, "events").agg(*[F.count_if(F.col("event_type") == k).alias(n) for k, n in (("click", "x"), ("view", "y"), ("error", "z"))])


@query("a19_metrics", "SELECT event_type AS metric, round(CASE WHEN event_type IN ('click', 'view') THEN sum(value) ELSE max(value) END, 2) AS value FROM events GROUP BY 1")
def a19(spark, d):
    kind = F.col("event_type")
    return V.read(spark, d, "events").groupBy(kind.alias("metric")).agg(F.sum("value").alias("s"), F.max("value").alias("m")).select("metric", F.round(F.when(F.col("metric").isin("click", "view"), F.col("s")).otherwise(F.col("m")), 2).alias("value"))


@query("w12_rrf_lists", f"{SQL_CHANNELS} SELECT id, round(sum(1 / (60 + rank)), 8) AS score FROM c GROUP BY id ORDER BY score DESC, id LIMIT 30", ("memories",))
def w12(spark, d):
    fused = ranking.rrf(_channels(spark, d).withColumn("weight", F.lit(1.0)))
    return fused.select("id", F.round("score", 8).alias("score")).orderBy(F.desc("score"), "id").limit(30)


@query("w16_priority_order", "SELECT id, CASE WHEN pinned THEN 0 WHEN importance >= 9 THEN 1 WHEN resolved THEN 3 ELSE 2 END AS priority FROM memories ORDER BY priority, id LIMIT 50", ("memories",))
def w16(spark, d):
    p = F.when(F.col("pinned"), 0).when(F.col("importance") >= 9, 1).when(F.col("resolved"), 3).otherwise(2)
    return V.memories(spark, d).select("id", p.alias("priority")).orderBy("priority", "id").limit(50)


@query("k01_keyword_topk", f"WITH s AS (SELECT id, 100 * (4.0 * least((contains(lower(content), 'the')::INT + contains(lower(content), 'and')::INT) / 2.0, 1.0) + 2.0 * 0.5 + 2.5 * exp(-0.1 * {_sql_age('last_active')}) + importance / 10.0) / 9.5 AS n, resolved FROM memories WHERE world IN ('shared', 'north')) SELECT id, round(CASE WHEN resolved THEN n * 0.3 ELSE n END, 2) AS score FROM s WHERE n >= 50 ORDER BY score DESC, id LIMIT 20", ("memories",))
def k01(spark, d):
    hit = X.hits(F.col("content"), ["the", "and"]) / 2.0
    n = 100 * (4.0 * F.least(hit, F.lit(1.0)) + 2.0 * 0.5 + 2.5 * S.time_score(_age("last_active")) + F.col("importance") / 10) / 9.5
    rows = V.memories(spark, d).filter(F.col("world").isin("shared", "north")).withColumn("n", n).filter("n >= 50")
    return rows.select("id", F.round(F.when(F.col("resolved"), F.col("n") * 0.3).otherwise(F.col("n")), 2).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query("k08_recent_neighbours", "WITH r AS (SELECT m.id, v.vec FROM memories m JOIN vectors v ON v.id = m.id ORDER BY m.event_at DESC, m.id LIMIT 10) SELECT a.id, count(*) AS near FROM r a JOIN r b ON a.id <> b.id AND round(list_cosine_similarity(a.vec, b.vec), 6) > 0.05 GROUP BY 1 HAVING count(*) >= 2", ("memories", "vectors"))
def k08(spark, d):
    recent = V.memories(spark, d).select("id", "event_at").join(V.vectors(spark, d), "id").orderBy(F.desc("event_at"), "id").limit(10).select("id", "vec")
    pairs = vectors.similar_pairs(recent, 0.050001)
    both = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    return both.groupBy("id").agg(N().alias("near")).filter("near >= 2")


@query("k11_recent_total", "SELECT event_id, (SELECT count(*) FROM events WHERE event_type = 'error') AS total FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 25")
def k11(spark, d):
    e = V.read(spark, d, "events").filter("event_type = 'error'")
    return e.orderBy(F.desc("ts"), "event_id").limit(25).select("event_id").crossJoin(F.broadcast(e.agg(N().alias("total"))))  # one row


@query("u06_union_senses", "SELECT id, list_aggregate(list_filter(['a', 'en', 'fr', 'src1', 'src2'], lambda x: list_contains(tags, x) OR x = 'a'), 'string_agg', ',') AS senses FROM memories", ("memories",))
def u06(spark, d):
    order = F.array(*[F.lit(x) for x in ("a", "en", "fr", "src1", "src2")])
    return V.memories(spark, d).select("id", F.array_join(F.array_intersect(order, F.array_union("tags", F.array(F.lit("a")))), ",").alias("senses"))


@query("u07_distinct_tags", "SELECT id, len(list_distinct(list_concat(tags, domain))) AS n FROM memories", ("memories",))
def u07(spark, d):
    return V.memories(spark, d).select("id", F.size(F.array_distinct(F.concat("tags", "domain"))).cast("long").alias("n"))


@query("m10_idle_days", f"SELECT id, round({_sql_age('last_active')}, 4) AS idle FROM memories", ("memories",))
def m10(spark, d):
    return V.memories(spark, d).select("id", F.round(F.coalesce(_age("last_active"), F.lit(0.0)), 4).alias("idle"))


@query("m16_intent_multiplier", f"SELECT id, round((CASE WHEN id % 3 = 0 THEN 1.05 ELSE 1.0 END)::DOUBLE * (CASE WHEN domain[1] IN ('fr') THEN 1.1 ELSE 1.0 END) * (CASE WHEN {_sql_age('event_at')} <= 7 THEN 1.2 ELSE 1.0 END), 4) AS factor FROM memories", ("memories",))
def m16(spark, d):
    linked, known, fresh = F.col("id") % 3 == 0, F.element_at("domain", 1).isin("fr"), _age("event_at") <= 7
    return V.memories(spark, d).select("id", F.round(F.when(linked, 1.05).otherwise(1.0) * F.when(known, 1.1).otherwise(1.0) * F.when(fresh, 1.2).otherwise(1.0), 4).alias("factor"))


@query("m20_vector_check", "SELECT id, len(vec) = 64 AND len(list_filter(vec, lambda x: NOT isfinite(x))) = 0 AS valid FROM vectors", ("vectors",))
def m20(spark, d):
    return V.vectors(spark, d).select("id", ((F.size("vec") == 64) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).alias("valid"))


@query("m23_event_time", f"SELECT id, CASE WHEN id % 3 = 0 THEN epoch_us(last_active) WHEN id % 7 = 0 THEN epoch_us({SQL_REF}) ELSE epoch_us(event_at) END AS us FROM memories", ("memories",))
def m23(spark, d):
    at = F.when(F.col("id") % 3 == 0, F.col("last_active")).when(F.col("id") % 7 == 0, V.ref()).otherwise(F.col("event_at"))
    return V.memories(spark, d).select("id", F.unix_micros(at.cast("timestamp")).alias("us"))


@query("m34_intensity", "SELECT event_id, round(least(1.0, greatest(0.0, CASE WHEN value > 1 THEN value / 100 ELSE value END)), 6) AS intensity FROM events")
def m34(spark, d):
    v = F.col("value")
    return V.read(spark, d, "events").select("event_id", F.round(S.clamp(F.when(v > 1, v / 100).otherwise(v), 0.0, 1.0), 6).alias("intensity"))


@query("x03_sanitize_name", "SELECT id, coalesce(nullif(trim(substr(regexp_replace(name || '/*', '[^\\p{L}\\p{N}_\\s-]', '', 'g'), 1, 80)), ''), 'unnamed') AS clean FROM memories", ("memories",))
def x03(spark, d):
    return V.memories(spark, d).select("id", X.sanitize_name(F.concat("name", F.lit("/*"))).alias("clean"))


@query("x11_blocking_keys", "SELECT id, unnest([lower(name), 'd:' || domain[1]]) AS key FROM memories", ("memories",))
def x11(spark, d):
    return V.memories(spark, d).select("id", F.explode(F.array_union(F.array(F.lower("name")), F.transform("domain", lambda x: F.concat(F.lit("d:"), x)))).alias("key"))


@query("x30_chunk_id", "SELECT conv_id, turn, substr(sha256(concat_ws(':', conv_id::VARCHAR, turn::VARCHAR, sha256(text))), 1, 24) AS chunk_id FROM conversations")
def x30(spark, d):
    return V.read(spark, d, "conversations").select("conv_id", "turn", F.substring(F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.sha2(F.col("text").cast("binary"), 256)).cast("binary"), 256), 1, 24).alias("chunk_id"))


@query("x35_route_axes", "SELECT event_id, unnest(CASE event_type WHEN 'click' THEN ['X'] WHEN 'view' THEN ['X', 'Y'] WHEN 'error' THEN ['M'] ELSE ['Z'] END) AS axis FROM events")
def x35(spark, d):
    axes = lambda *a: F.array(*[F.lit(x) for x in a])
    kind = F.col("event_type")
    return V.read(spark, d, "events").select("event_id", F.explode(F.when(kind == "click", axes("X")).when(kind == "view", axes("X", "Y")).when(kind == "error", axes("M")).otherwise(axes("Z"))).alias("axis"))


@query("x36_literal_evidence", "SELECT c.conv_id, c.turn FROM conversations c JOIN conversations e ON e.conv_id = c.conv_id AND e.turn = c.turn + 1 WHERE contains(c.text, substr(e.text, 1, 2))")
def x36(spark, d):
    c = V.read(spark, d, "conversations").select("conv_id", "turn", "text")
    e = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.substring("text", 1, 2).alias("evidence"))
    return c.join(e, ["conv_id", "turn"]).filter(F.contains("text", F.col("evidence"))).select("conv_id", "turn")


@query("x47_threads", "SELECT id, nullif(trim(lower(CASE WHEN id % 9 = 0 THEN '  ' ELSE thread END)), '') AS thread FROM memories", ("memories",))
def x47(spark, d):
    t = F.trim(F.lower(F.when(F.col("id") % 9 == 0, "  ").otherwise(F.col("thread"))))
    return V.memories(spark, d).select("id", F.nullif(t, F.lit("")).alias("thread"))


@query("r17_status_class", "SELECT id, CASE WHEN pinned THEN 'pinned' WHEN type = 'permanent' THEN 'permanent' WHEN type = 'feel' THEN 'feel' WHEN resolved THEN 'resolved' ELSE 'open' END AS class FROM memories", ("memories",))
def r17(spark, d):
    kind = F.when(F.col("pinned"), "pinned").when(F.col("type").isin("permanent", "feel"), F.col("type")).when(F.col("resolved"), "resolved").otherwise("open")
    return V.memories(spark, d).select("id", kind.alias("class"))


@query("r37_terminal_status", "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'success' WHEN bool_or(event_type = 'error') THEN 'terminal' ELSE 'pending' END AS status FROM events GROUP BY 1")
def r37(spark, d):
    kind = F.col("event_type")
    return V.read(spark, d, "events").groupBy("user_id").agg(F.bool_or(kind == "purchase").alias("s"), F.bool_or(kind == "error").alias("t")).select("user_id", F.when(F.col("s"), "success").when(F.col("t"), "terminal").otherwise("pending").alias("status"))


@query("r47_after_terminal", "SELECT event_id FROM (SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM events) WHERE t = 1")
def r47(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return V.read(spark, d, "events").withColumn("t", F.max((F.col("event_type") == "purchase").cast("int")).over(w)).filter("t = 1").select("event_id")


@query("r61_due_rows", "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-05 00:00:00' AND event_type = 'error' ORDER BY ts, event_id LIMIT 40")
def r61(spark, d):
    return V.read(spark, d, "events").filter((F.col("ts") <= F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")) & (F.col("event_type") == "error")).orderBy("ts", "event_id").limit(40).select("event_id")


@query("r66_clean_ids", "SELECT l_orderkey, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS ids FROM lineitem GROUP BY 1")
def r66(spark, d):
    return V.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.trim(F.col("l_partkey").cast("string")))), ",").alias("ids"))


@query("t09_stage_history", "WITH s AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, o_orderstatus AS stage FROM orders), l AS (SELECT *, lag(stage) OVER (PARTITION BY run ORDER BY seq) AS before FROM s) SELECT run, seq, stage, 'transition' AS problem FROM l WHERE before IS NOT NULL AND before || stage NOT IN ('OO', 'OF', 'OP', 'FF', 'PF')")
def t09(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    stages = V.read(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.row_number().over(w).cast("long").alias("seq"), F.col("o_orderstatus").alias("stage"))
    allowed = spark.createDataFrame([("O", "O"), ("O", "F"), ("O", "P"), ("F", "F"), ("P", "F")], "from string, to string")
    return ledger.legal_history(stages, allowed)
