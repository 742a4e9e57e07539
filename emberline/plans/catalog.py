"""Queries of the reference's operators on the provided tables, with their SQL.

``QUERIES[name]`` takes (spark, sf_dir); ``SQL[name]`` says the same for DuckDB.
Names start with the operator's id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, REF
from ..functions import scoring as S
from ..functions import text as X
from ..functions import similarity
from ..operators import chunking, graph, ledger, ranking, timeline, vectors
from ..session import bounded_batches
from ..sources import exports, views as V

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
#: Rules on fixed inputs, which read no table: tests hold them against SQL, they are no queries.
CASES: dict[str, Callable] = {}
CASES_SQL: dict[str, str] = {}
SQL_REF = f"TIMESTAMP '{REF}'"


def query(name: str, sql: str | None = None, use: tuple[str, ...] = (), lists: tuple[str, ...] = (), into=(QUERIES, SQL)):
    """Register a query; ``use`` names the views that its SQL reads, ``lists`` the list columns,
    which both sides return as text (items parted by bars; null stays null)."""

    def register(f):
        def run(spark, sf_dir):
            df = f(spark, sf_dir)
            return df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|") for c in lists}) if lists else df

        into[0][name] = run
        if sql is not None:
            with_ = "WITH RECURSIVE " + ", ".join(V.SQL[u] for u in use) if use else ""
            body = sql.strip()
            whole = f"{with_}, {body[5:]}" if use and body.upper().startswith("WITH ") else f"{with_} {body}"
            into[1][name] = f"SELECT * REPLACE ({', '.join(f"array_to_string({c}, '|') AS {c}" for c in lists)}) FROM ({whole})" if lists else whole
        return f

    return register


def case(name: str, sql: str | None = None, use: tuple[str, ...] = (), lists: tuple[str, ...] = ()):
    """As ``query``, among the cases."""
    return query(name, sql, use, lists, (CASES, CASES_SQL))


def _age(column: str):
    return S.days_between(V.ref(), F.col(column))


SQL_AGE = "greatest(0.0, epoch_us({ref}) / 86400000000.0 - epoch_us({c}) / 86400000000.0)"


def _sql_age(column: str) -> str:
    return f"greatest(0.0::DOUBLE, (epoch_us({SQL_REF}) - epoch_us({column}))::DOUBLE / 86400000000.0::DOUBLE)"


# --- filters and projections ------------------------------------------------


@query("f01_time_range", "SELECT id FROM memories WHERE event_at IS NULL OR event_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'", ("memories",))
def f01(spark, d):
    m = V.memories(spark, d)
    ts = F.col("event_at")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return m.filter(ts.isNull() | ts.between(at("2024-01-10 00:00:00"), at("2024-01-20 00:00:00"))).select("id")


@query("f02_world_filter", "SELECT id, world FROM memories WHERE world = 'shared' OR world IN ('north')", ("memories",))
def f02(spark, d):
    return V.memories(spark, d).filter((F.col("world") == DEFAULTS.universal_world) | F.col("world").isin("north")).select("id", "world")


def recall_filter(domains: list[str], worlds: list[str]):
    low = [x.lower() for x in domains]
    return ~F.col("pinned") & ~F.col("protected") & ((F.col("world") == DEFAULTS.universal_world) | F.col("world").isin(worlds)) & F.exists("domain", lambda x: F.lower(x).isin(low))


@query("f05_recall_filters", "SELECT id FROM memories WHERE NOT pinned AND NOT protected AND world IN ('shared', 'north') AND lower(domain[1]) IN ('en', 'fr')", ("memories",))
def f05(spark, d):
    return V.memories(spark, d).filter(recall_filter(["EN", "fr"], ["north"])).select("id")


@query("f11_exempt", "SELECT id, (pinned OR protected OR type IN ('permanent', 'feel') OR resolved) AS exempt FROM memories", ("memories",))
def f11(spark, d):
    return V.memories(spark, d).select("id", (F.col("pinned") | F.col("protected") | F.col("type").isin("permanent", "feel") | F.col("resolved")).alias("exempt"))


@query("f18_within_days", f"SELECT id FROM memories WHERE event_at IS NOT NULL AND event_at >= {SQL_REF} - INTERVAL 7 DAY", ("memories",))
def f18(spark, d):
    return V.memories(spark, d).filter(F.col("event_at") >= V.ref() - F.expr("INTERVAL 7 DAYS")).select("id")


@query("f19_policy_gate", "SELECT id, round(0.45 * greatest(valence, arousal), 4) AS anchored FROM memories WHERE 0.45 * greatest(valence, arousal) >= 0.25", ("memories",))
def f19(spark, d):
    anchored = 0.45 * F.greatest("valence", "arousal")
    return V.memories(spark, d).filter(anchored.isNull() | (anchored >= 0.25)).select("id", F.round(anchored, 4).alias("anchored"))


@query("f20_original_support", "SELECT id FROM memories WHERE valence * 100 >= 40 OR (arousal - 0.9) > 0", ("memories",))
def f20(spark, d):
    return V.memories(spark, d).filter((F.col("valence") * 100 >= DEFAULTS.relevance_floor) | (F.col("arousal") - 0.9 > 0)).select("id")


@query("f21_session_seen", "SELECT id FROM memories WHERE id NOT IN (SELECT user_id FROM events WHERE event_type = 'view')", ("memories",))
def f21(spark, d):
    seen = V.read(spark, d, "events").filter("event_type = 'view'").select(F.col("user_id").alias("id")).distinct()
    return V.memories(spark, d).select("id").join(seen, "id", "left_anti")


@query("f22_exact_key", "SELECT id FROM memories WHERE contains('what did src3 say in en', lower(tags[1]))", ("memories",))
def f22(spark, d):
    return V.memories(spark, d).filter(F.contains(F.lit("what did src3 say in en"), F.lower(F.element_at("tags", 1)))).select("id")


@query("f28_trigger_rules", "SELECT id, CASE WHEN type = 'feel' THEN 'type' WHEN contains(lower(content), 'the ') THEN 'keyword' WHEN importance >= 9 THEN 'importance' ELSE 'none' END AS reason FROM memories", ("memories",))
def f28(spark, d):
    reason = F.when(F.col("type") == "feel", "type").when(F.contains(F.lower("content"), F.lit("the ")), "keyword").when(F.col("importance") >= 9, "importance").otherwise("none")
    return V.memories(spark, d).select("id", reason.alias("reason"))


# --- scores -----------------------------------------------------------------

SQL_ACTIVITY = f"""
SELECT id, CASE WHEN pinned OR protected OR type = 'permanent' THEN 999.0 WHEN type = 'feel' THEN 50.0 ELSE
  round(imp * pow(act, 0.3) * exp(-0.05 * d) * (CASE WHEN d <= 3 THEN tw * 0.7 + ew * 0.3 ELSE ew * 0.7 + tw * 0.3 END)
    * (CASE WHEN resolved AND digested THEN 0.02 WHEN resolved THEN 0.05 ELSE 1.0 END)
    * (CASE WHEN arousal > 0.7 AND NOT resolved THEN 1.5 ELSE 1.0 END), 4) END AS score
FROM (SELECT *, least(10, greatest(1, importance))::DOUBLE AS imp, greatest(1, activation)::DOUBLE AS act, {_sql_age('last_active')} AS d,
  1 + exp(-{_sql_age('last_active')} * 24 / 36) AS tw, 1.0 + arousal * 0.8 AS ew FROM memories)"""


def _activity(m: DataFrame) -> DataFrame:
    score = S.activity_score(F.col("importance"), F.col("activation"), F.col("arousal"), _age("last_active"), F.col("resolved"), F.col("digested"), F.col("pinned"), F.col("protected"), F.col("type"))
    return m.withColumn("score", score)


@query("m06_activity_score", SQL_ACTIVITY, ("memories",))
def m06(spark, d):
    return _activity(V.memories(spark, d)).select("id", "score")


@query("m03_emotion_score", "SELECT id, round(greatest(0, 1 - sqrt(pow(valence - 0.7, 2) + pow(arousal - 0.4, 2)) / 1.414), 4) AS score FROM memories", ("memories",))
def m03(spark, d):
    return V.memories(spark, d).select("id", F.round(S.emotion_score(F.col("valence"), F.col("arousal"), 0.7, 0.4), 4).alias("score"))


@query("m04_time_score", f"SELECT id, round(exp(-0.1 * {_sql_age('last_active')}), 4) AS score FROM memories", ("memories",))
def m04(spark, d):
    return V.memories(spark, d).select("id", F.round(S.time_score(_age("last_active")), 4).alias("score"))


SQL_DECAY = f"""
SELECT id, round(CASE WHEN pinned OR protected OR type IN ('permanent', 'feel') THEN 1.0 WHEN resolved THEN raw ELSE greatest(raw, 0.25) END, 6) AS decay,
  round(50 * (0.6 + 0.4 * CASE WHEN pinned OR protected OR type IN ('permanent', 'feel') THEN 1.0 WHEN resolved THEN raw ELSE greatest(raw, 0.25) END), 4) AS blended
FROM (SELECT *, exp(-0.693 * {_sql_age('event_at')} / greatest(0.001, 14.0 * (1 + 0.5 * log2((1 + activation)::DOUBLE)))) AS raw FROM memories)"""


@query("m07_retrieval_decay", SQL_DECAY, ("memories",))
def m07(spark, d):
    exempt = F.col("pinned") | F.col("protected") | F.col("type").isin("permanent", "feel")
    decay = S.retrieval_decay(_age("event_at"), F.col("activation"), F.col("resolved"), exempt)
    return V.memories(spark, d).select("id", F.round(decay, 6).alias("decay"), F.round(S.blend_decay(F.lit(50.0), decay), 4).alias("blended"))


@query("m09_decay_report", f"WITH s AS ({SQL_ACTIVITY}) SELECT count(*) FILTER (s.score < 0.3) AS to_archive, count(*) FILTER (m.importance <= 4 AND NOT m.resolved AND {_sql_age('m.last_active')} > 30) AS to_resolve, round(min(s.score), 4) AS least FROM s JOIN memories m USING (id)", ("memories",))
def m09(spark, d):
    rows = _activity(V.memories(spark, d))
    return rows.agg(F.count_if(F.col("score") < DEFAULTS.decay_threshold).alias("to_archive"), F.count_if((F.col("importance") <= 4) & ~F.col("resolved") & (_age("last_active") > 30)).alias("to_resolve"), F.round(F.min("score"), 4).alias("least"))


@query("m11_resonance", "SELECT id, round((0.8 * greatest(0, 1 - sqrt(pow((0.3 - valence) / 2, 2) + pow(0.6 - arousal, 2)) / sqrt(2.0)) + 0.2 * greatest(0, 1 - abs(0.5 - valence))) * 0.9, 6) AS score FROM memories", ("memories",))
def m11(spark, d):
    return V.memories(spark, d).select("id", S.resonance(F.col("valence"), F.col("arousal"), F.col("valence"), F.lit(0.9), 0.3, 0.6, 0.5).alias("score"))


@query("m12_tie_break", "SELECT id, round(importance * (1 + 0.25 * least(1.0, greatest(0.0, arousal))), 6) AS score FROM memories", ("memories",))
def m12(spark, d):
    return V.memories(spark, d).select("id", F.round(S.tie_break(F.col("importance").cast("double"), F.col("arousal"), 0.4), 6).alias("score"))


@query("m21_date_precision", "SELECT id, CASE WHEN regexp_matches(s, '^\\d{4}$') THEN 'year' WHEN regexp_matches(s, '^\\d{4}-\\d{2}$') THEN 'month' WHEN regexp_matches(s, '^\\d{4}-\\d{2}-\\d{2}$') THEN 'day' WHEN regexp_matches(s, '^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}') THEN 'time' ELSE 'unknown' END AS p FROM (SELECT id, CASE id % 4 WHEN 0 THEN strftime(event_at, '%Y') WHEN 1 THEN strftime(event_at, '%Y-%m') WHEN 2 THEN strftime(event_at, '%Y-%m-%d') ELSE name END AS s FROM memories)", ("memories",))
def m21(spark, d):
    i, at = F.col("id") % 4, F.col("event_at")
    s = F.when(i == 0, F.date_format(at, "yyyy")).when(i == 1, F.date_format(at, "yyyy-MM")).when(i == 2, F.date_format(at, "yyyy-MM-dd")).otherwise(F.col("name"))
    return V.memories(spark, d).select("id", X.date_precision(s).alias("p"))


@query("m25_age_label", f"SELECT id, CASE WHEN n = 0 THEN 'today' WHEN n = 1 THEN 'yesterday' WHEN n < 30 THEN n || ' days ago' ELSE 'long ago' END AS label FROM (SELECT id, date_diff('day', event_at::DATE, {SQL_REF}::DATE) AS n FROM memories)", ("memories",))
def m25(spark, d):
    n = F.datediff(V.ref().cast("date"), F.col("event_at").cast("date"))
    return V.memories(spark, d).select("id", F.when(n == 0, "today").when(n == 1, "yesterday").when(n < 30, F.concat(n.cast("string"), F.lit(" days ago"))).otherwise("long ago").alias("label"))


@query("m35_token_estimate", "SELECT id, CAST(trunc(1.3::DOUBLE * len(regexp_extract_all(content, '[a-zA-Z]+')) + 0.05::DOUBLE * length(content)) AS INTEGER) AS tokens FROM memories", ("memories",))
def m35(spark, d):
    return V.memories(spark, d).select("id", S.token_estimate(F.col("content")).alias("tokens"))


# --- aggregation ------------------------------------------------------------


@query("a01_store_stats", "SELECT type, CASE WHEN grouping(type) = 1 THEN domain[1] END AS domain, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM memories GROUP BY GROUPING SETS ((type), (domain))", ("memories",))
def a01(spark, d):
    m = V.memories(spark, d).withColumn("domain", F.element_at("domain", 1))
    return m.groupingSets([["type"], ["domain"]], "type", "domain").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("a02_daily_activity", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def a02(spark, d):
    e = V.read(spark, d, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct("user_id").alias("users"))


@query("a03_name_groups", "SELECT name, count(*) AS n, min(id) AS least FROM memories GROUP BY name HAVING count(*) > 1", ("memories",))
def a03(spark, d):
    return V.memories(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).filter("n > 1")


@query("a04_distribution", "SELECT event_type, count(*) AS n, round(min(value), 4) AS low, round(max(value), 4) AS high, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.05), 4) AS p05, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, count(DISTINCT ts::DATE) AS days FROM events GROUP BY ROLLUP (event_type)")
def a04(spark, d):
    e = V.read(spark, d, "events")
    v = F.col("value")
    plain = e.rollup("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.min(v), 4).alias("low"), F.round(F.max(v), 4).alias("high"), F.round(F.avg(v), 4).alias("mean"))
    days = e.select("event_type", F.to_date("ts").alias("day")).distinct()  # then both levels count rows
    days = days.groupBy("event_type").agg(F.count(F.lit(1)).alias("days")).unionByName(days.select("day").distinct().agg(F.count(F.lit(1)).alias("days")).select(F.lit(None).cast("string").alias("event_type"), "days"))
    both = e.select(F.explode(F.array("event_type", F.lit(None).cast("string"))).alias("event_type"), "value")
    points = ranking.percentiles(both, "event_type", "value", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    same = lambda other: F.col("event_type").eqNullSafe(F.col(other))
    met = plain.join(points.withColumnRenamed("event_type", "_p"), same("_p"), "left").join(days.withColumnRenamed("event_type", "_d"), same("_d"))
    return met.select("event_type", "n", "low", "high", "mean", *[F.round(p, 4).alias(p) for p in ("p05", "p50", "p95")], "days")


@query("a06_weighted_vote", "WITH v AS (SELECT thread, domain[1] AS vote, sum(importance) AS w FROM memories GROUP BY 1, 2), a AS (SELECT thread, round(sum(valence * importance) / sum(importance), 4) AS valence FROM memories GROUP BY 1) SELECT a.thread, a.valence, x.vote FROM a JOIN (SELECT thread, vote, row_number() OVER (PARTITION BY thread ORDER BY w DESC, vote DESC) AS rn FROM v) x ON a.thread = x.thread AND x.rn = 1", ("memories",))
def a06(spark, d):
    m = V.memories(spark, d).withColumn("vote", F.element_at("domain", 1))
    mean = F.round(F.sum(F.col("vw")) / F.sum("w"), 4)
    votes = m.groupBy("thread", "vote").agg(F.sum("importance").alias("w"), F.sum(F.col("valence") * F.col("importance")).alias("vw"))
    return votes.groupBy("thread").agg(mean.alias("valence"), F.max(F.struct("w", "vote")).alias("top")).select("thread", "valence", "top.vote")


@query("a07_status_histogram", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def a07(spark, d):
    return V.read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("a08_backlog_stats", "SELECT count(*) AS chunks, count(*) FILTER (n = 0) AS untouched, count(*) FILTER (n > 0 AND n < 3) AS retrying, count(*) FILTER (n >= 3) AS settled FROM (SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS n FROM orders)")
def a08(spark, d):
    tries = V.read(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("t"))
    n = F.coalesce("t", F.lit(0))
    return V.read(spark, d, "orders").select("o_orderkey").join(tries, "o_orderkey", "left").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(n == 0).alias("untouched"), F.count_if((n > 0) & (n < 3)).alias("retrying"), F.count_if(n >= 3).alias("settled"))


@query("a09_watermark", "SELECT coalesce(max(event_id), 0) AS watermark FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'")
def a09(spark, d):
    return V.read(spark, d, "events").filter(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("watermark"))


@query("a13_episode_metadata", "SELECT thread, least(10, max(importance)) AS importance, round(avg(valence), 4) AS valence, round(avg(arousal), 4) AS arousal, CAST(min(event_at) AS VARCHAR) AS first_at, CAST(max(event_at) AS VARCHAR) AS last_at FROM memories GROUP BY thread", ("memories",))
def a13(spark, d):
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return V.memories(spark, d).groupBy("thread").agg(F.least(F.lit(10), F.max("importance")).alias("importance"), F.round(F.avg("valence"), 4).alias("valence"), F.round(F.avg("arousal"), 4).alias("arousal"), at(F.min("event_at")).alias("first_at"), at(F.max("event_at")).alias("last_at"))


@query("a16_thread_sizes", "SELECT thread, count(*) AS n, count(*) FILTER (resolved) AS resolved, count(*) FILTER (NOT resolved) AS open FROM memories GROUP BY thread", ("memories",))
def a16(spark, d):
    return V.memories(spark, d).groupBy("thread").agg(F.count(F.lit(1)).alias("n"), F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("open"))


@query("a18_coverage_rates", "SELECT type, world, count(*) AS n, round(count(*) FILTER (resolved) / nullif(count(*) FILTER (NOT pinned), 0)::DOUBLE, 4) AS rate FROM memories GROUP BY GROUPING SETS ((type), (world), ())", ("memories",))
def a18(spark, d):
    rate = F.round(F.try_divide(F.count_if("resolved").cast("double"), F.count_if(~F.col("pinned")).cast("double")), 4)
    return V.memories(spark, d).groupingSets([["type"], ["world"], []], "type", "world").agg(F.count(F.lit(1)).alias("n"), rate.alias("rate"))


@query("a21_noisy_or", "SELECT thread, round(1 - product(1 - valence * 0.02), 3) AS intensity FROM memories GROUP BY thread", ("memories",))
def a21(spark, d):
    return V.memories(spark, d).groupBy("thread").agg(F.round(1 - F.product(1 - F.col("valence") * 0.02), 3).alias("intensity"))


# --- joins ------------------------------------------------------------------


@query("j01_state_links", "WITH l AS (SELECT id, id + 1 AS successor FROM memories WHERE id % 5 = 0) SELECT a.id, b.id AS linked, 'newer' AS side FROM l JOIN memories a ON a.id = l.id JOIN memories b ON b.id = l.successor AND b.type <> 'permanent' UNION ALL SELECT b.id, a.id, 'older' FROM l JOIN memories a ON a.id = l.id AND a.type <> 'permanent' JOIN memories b ON b.id = l.successor", ("memories",))
def j01(spark, d):
    m = V.memories(spark, d).select("id", "type")
    links = m.filter("id % 5 = 0").select("id", (F.col("id") + 1).alias("linked"), F.col("type").alias("own"))
    met = links.join(m.select(F.col("id").alias("linked"), F.col("type").alias("other")), "linked")
    newer = met.filter("other <> 'permanent'").select("id", "linked", F.lit("newer").alias("side"))
    return newer.unionByName(met.filter("own <> 'permanent'").select(F.col("linked").alias("id"), F.col("id").alias("linked"), F.lit("older").alias("side")))


@query("j02_network_edges", "SELECT e.source, e.target, e.type FROM edges e JOIN memories a ON a.id = e.source JOIN memories b ON b.id = e.target WHERE NOT b.pinned", ("memories", "edges"))
def j02(spark, d):
    m = V.memories(spark, d)
    e = V.edges(spark, d).join(m.select(F.col("id").alias("source")), "source", "left_semi")
    return e.join(m.filter(~F.col("pinned")).select(F.col("id").alias("target")), "target", "left_semi").select("source", "target", "type")


@query("j03_duplicate_pairs", "SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.vec, b.vec), 6) AS sim FROM vectors a JOIN vectors b ON a.id < b.id WHERE round(list_cosine_similarity(a.vec, b.vec), 6) >= 0.35", ("vectors",))
def j03(spark, d):
    return vectors.similar_pairs(V.vectors(spark, d), 0.35)


@query("j06_uncovered_events", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def j06(spark, d):
    covered = V.read(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return ledger.uncovered(V.read(spark, d, "orders").select("o_orderkey"), covered, "o_orderkey")


@query("j07_pending_with_retries", "SELECT o_orderkey, coalesce(n, 0) AS retries FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j07(spark, d):
    li = V.read(spark, d, "lineitem")
    done = li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    tries = li.filter("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return V.read(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti").join(tries, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("retries"))


@query("j08_coverage", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS covered FROM customer")
def j08(spark, d):
    have = V.read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("c", F.lit(True))
    return V.read(spark, d, "customer").select("c_custkey").join(have, "c_custkey", "left").select("c_custkey", F.coalesce("c", F.lit(False)).alias("covered"))


@query("j10_chunk_sources", "SELECT o_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%' GROUP BY 1")
def j10(spark, d):
    o = V.read(spark, d, "orders").filter(F.col("o_orderpriority").startswith("1")).select("o_orderkey")
    met = o.join(V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), "o_orderkey")
    return met.groupBy("o_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l_linenumber")), lambda x: x.cast("string")), ",").alias("lines"))


@query("j16_without_vector", "SELECT m.id, CASE WHEN v.id IS NULL THEN 'missing' ELSE 'empty' END AS reason FROM memories m LEFT JOIN vectors v ON v.id = m.id WHERE v.id IS NULL OR len(v.vec) = 0", ("memories", "vectors"))
def j16(spark, d):
    v = V.vectors(spark, d).select("id", F.size("vec").alias("n"))
    return V.memories(spark, d).select("id").join(v, "id", "left").filter("n is null or n = 0").select("id", F.when(F.col("n").isNull(), "missing").otherwise("empty").alias("reason"))


@query("j17_edge_quality", "WITH p AS (SELECT DISTINCT source, target FROM edges) SELECT 'dangling' AS kind, source, target FROM p WHERE target NOT IN (SELECT id FROM memories) UNION ALL SELECT 'one_way', source, target FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.source = p.target AND q.target = p.source) UNION ALL SELECT 'mutual', source, target FROM p WHERE source < target AND EXISTS (SELECT 1 FROM p q WHERE q.source = p.target AND q.target = p.source)", ("memories", "edges"))
def j17(spark, d):
    return graph.edge_quality(V.edges(spark, d), V.memories(spark, d))


@query("j18_time_ripple", "SELECT centre, id, CAST(n AS INTEGER) AS n FROM (SELECT c.id AS centre, m.id, row_number() OVER (PARTITION BY c.id ORDER BY m.event_at, m.id) AS n FROM memories c JOIN memories m ON m.id <> c.id AND abs(epoch_us(m.event_at) - epoch_us(c.event_at)) <= 48 * 3600000000 WHERE c.id % 100 = 0) WHERE n <= 5", ("memories",))
def j18(spark, d):
    m = V.memories(spark, d).select("id", F.col("event_at").alias("ts"))
    return timeline.ripple(m, m.filter("id % 100 = 0"), DEFAULTS.ripple_hours, 5)


@query("j19_unclaimed", "SELECT id FROM memories WHERE id NOT IN (SELECT unnest([source, target]) FROM edges WHERE type = 'kin')", ("memories", "edges"))
def j19(spark, d):
    claimed = V.edges(spark, d).filter("type = 'kin'").select(F.explode(F.array("source", "target")).alias("id"))
    return V.memories(spark, d).select("id").join(claimed, "id", "left_anti")


@query("j21_zero_deposition", "SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(e.n, 0) AS messages, coalesce(m.n, 0) AS records, coalesce(e.n, 0) > 0 AND coalesce(m.n, 0) = 0 AS silent FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 1 DAY))::DATE AS day) LEFT JOIN (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1) e USING (day) LEFT JOIN (SELECT event_at::DATE AS day, count(*) AS n FROM memories GROUP BY 1) m USING (day)", ("memories",))
def j21(spark, d):
    e = V.read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("messages"))
    m = V.memories(spark, d).groupBy(F.to_date("event_at").alias("day")).agg(F.count(F.lit(1)).alias("records"))
    days = timeline.spine("2024-01-01", "2024-02-05", spark).join(e, "day", "left").join(m, "day", "left").select("day", F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("records", F.lit(0)).alias("records"))
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "messages", "records", ((F.col("messages") > 0) & (F.col("records") == 0)).alias("silent"))


@query("j22_latest_vs_older", "WITH c AS (SELECT thread, max(event_at) AS at, max_by(id, (event_at, id)) AS id FROM memories WHERE NOT pinned GROUP BY thread) SELECT c.id AS newest, m.id AS older FROM c JOIN memories m ON m.thread = c.thread AND m.event_at < c.at AND m.importance >= 9 AND NOT m.pinned", ("memories",))
def j22(spark, d):
    m = V.memories(spark, d).filter(~F.col("pinned"))
    newest = m.groupBy("thread").agg(F.max(F.struct("event_at", "id")).alias("x")).select("thread", F.col("x.event_at").alias("at"), F.col("x.id").alias("newest"))
    return m.filter("importance >= 9").join(newest, "thread").filter(F.col("event_at") < F.col("at")).select("newest", F.col("id").alias("older"))


@query("j23_content_dedupe", "WITH f AS (SELECT id, sha256(regexp_replace(lower(content), '[^a-z0-9]+', '', 'g')) AS fp FROM memories WHERE length(regexp_replace(lower(content), '[^a-z0-9]+', '', 'g')) >= 8) SELECT fp, min(id) AS id, count(*) AS merged FROM f GROUP BY fp", ("memories",))
def j23(spark, d):
    m = V.memories(spark, d).select("id", X.fingerprint(F.col("content")).alias("fp"))
    return m.groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("merged")).filter("fp is not null")


# --- windows ----------------------------------------------------------------


@query("w01_band_rank", """WITH base AS (SELECT id, (id * 37 % 101)::DOUBLE AS rel, (id * 53 % 101)::DOUBLE AS tie FROM memories WHERE id < 40),
o AS (SELECT *, row_number() OVER (ORDER BY rel DESC, id) AS rn FROM base),
b AS (SELECT rn, rel AS leader, 0 AS band FROM o WHERE rn = 1 UNION ALL SELECT o.rn, CASE WHEN b.leader - o.rel <= 3 THEN b.leader ELSE o.rel END, CASE WHEN b.leader - o.rel <= 3 THEN b.band ELSE b.band + 1 END FROM b JOIN o ON o.rn = b.rn + 1)
SELECT id, rel, tie, band, CAST(row_number() OVER (ORDER BY band, tie DESC, rel DESC, id) AS INTEGER) AS pos FROM o JOIN b USING (rn)""", ("memories",))
def w01(spark, d):
    i = F.col("id")
    pool = V.memories(spark, d).filter("id < 40").select("id", (i * 37 % 101).cast("double").alias("rel"), (i * 53 % 101).cast("double").alias("tie"))
    return ranking.band_rank(pool, DEFAULTS.tie_band)


@query("w01_band_rank_all", """WITH base AS (SELECT id, (id * 37 % 101)::DOUBLE AS rel, (id * 53 % 101)::DOUBLE AS tie FROM memories),
o AS (SELECT rel, row_number() OVER (ORDER BY rel DESC) AS rn FROM (SELECT DISTINCT rel FROM base)),
b AS (SELECT rn, rel AS leader, 0 AS band FROM o WHERE rn = 1 UNION ALL SELECT o.rn, CASE WHEN b.leader - o.rel <= 3 THEN b.leader ELSE o.rel END, CASE WHEN b.leader - o.rel <= 3 THEN b.band ELSE b.band + 1 END FROM b JOIN o ON o.rn = b.rn + 1)
SELECT id, rel, tie, band, CAST(row_number() OVER (ORDER BY band, tie DESC, rel DESC, id) AS INTEGER) AS pos FROM base JOIN o USING (rel) JOIN b USING (rn)""", ("memories",))
def w01_all(spark, d):
    i = F.col("id")
    return ranking.band_rank(V.memories(spark, d).select("id", (i * 37 % 101).cast("double").alias("rel"), (i * 53 % 101).cast("double").alias("tie")), DEFAULTS.tie_band)


@query("w02_timeline_neighbors", "WITH w AS (SELECT id, lag(id, 1) OVER t AS p1, lead(id, 1) OVER t AS n1 FROM memories WINDOW t AS (PARTITION BY thread ORDER BY event_at, id)) SELECT id AS seed, p1 AS id, -1 AS distance FROM w WHERE id % 20 = 0 AND p1 IS NOT NULL UNION ALL SELECT id, n1, 1 FROM w WHERE id % 20 = 0 AND n1 IS NOT NULL", ("memories",))
def w02(spark, d):
    m = V.memories(spark, d).select("id", "thread", F.col("event_at").alias("ts"))
    return timeline.neighbours(m, m.filter("id % 20 = 0"), 1)


@query("w02_timeline_neighbors_all", "WITH w AS (SELECT id, lag(id, 1) OVER t AS p1, lead(id, 1) OVER t AS n1 FROM memories WINDOW t AS (PARTITION BY thread ORDER BY event_at, id)) SELECT id AS seed, p1 AS id, -1 AS distance FROM w WHERE p1 IS NOT NULL UNION ALL SELECT id, n1, 1 FROM w WHERE n1 IS NOT NULL", ("memories",))
def w02_all(spark, d):
    m = V.memories(spark, d).select("id", "thread", F.col("event_at").alias("ts"))
    return timeline.neighbours(m, m, 1)


@query("w03_gap_split", "SELECT user_id AS user, id AS before_id, gap_s FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap_s DESC, id) AS rn FROM (SELECT user_id, event_id AS id, CAST(epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch(ts) AS BIGINT) AS gap_s FROM (SELECT user_id, event_id, date_trunc('second', ts) AS ts FROM events)) WHERE gap_s >= 3600) WHERE rn = 1")
def w03(spark, d):
    e = V.read(spark, d, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("id"), F.date_trunc("second", "ts").alias("ts"))
    return timeline.largest_gap(e, DEFAULTS.session_gap_s)


@query("w04_silent_streak", "WITH g AS (SELECT event_type AS key, ts::DATE AS day, count(*) < (SELECT count(*) / 150.0 FROM events) AS silent FROM events GROUP BY 1, 2), i AS (SELECT *, sum(CASE WHEN silent THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY day) AS island FROM g) SELECT key, strftime(day, '%Y-%m-%d') AS day, silent, CAST(sum(silent::INT) OVER (PARTITION BY key, island ORDER BY day) AS BIGINT) AS streak FROM i")
def w04(spark, d):
    e = V.read(spark, d, "events")
    mean = F.broadcast(e.agg((F.count(F.lit(1)) / 150.0).alias("mean")))  # one row
    days = e.groupBy(F.col("event_type").alias("key"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).crossJoin(mean)
    return timeline.streaks(days.select("key", "day", (F.col("n") < F.col("mean")).alias("silent"))).select("key", F.date_format("day", "yyyy-MM-dd").alias("day"), "silent", "streak")


def _channels(spark, d):
    m = V.memories(spark, d)
    w = lambda *o: F.row_number().over(Window.orderBy(*o))
    top = lambda c: m.orderBy(F.desc(c), "id").limit(50)
    a = top("valence").select(F.lit(0).alias("channel"), F.lit(1.0).alias("weight"), w(F.desc("valence"), "id").alias("rank"), "id")
    b = top("arousal").select(F.lit(1).alias("channel"), F.lit(0.7).alias("weight"), w(F.desc("arousal"), "id").alias("rank"), "id")
    return a.unionByName(b)


SQL_CHANNELS = "WITH c AS (SELECT 1.0 AS weight, row_number() OVER (ORDER BY valence DESC, id) AS rank, id FROM memories QUALIFY rank <= 50 UNION ALL SELECT 0.7, row_number() OVER (ORDER BY arousal DESC, id) AS rank, id FROM memories QUALIFY rank <= 50)"


@query("w10_rrf_fusion", f"{SQL_CHANNELS} SELECT id, round(sum(weight / (60 + rank)), 8) AS score FROM c GROUP BY id", ("memories",))
def w10(spark, d):
    return ranking.rrf(_channels(spark, d)).select("id", F.round("score", 8).alias("score"))


@query("w11_rrf_accumulate", f"{SQL_CHANNELS} SELECT id % 40 AS id, round(sum(weight / (60 + rank)), 8) AS score FROM c GROUP BY 1", ("memories",))
def w11(spark, d):
    return ranking.rrf(_channels(spark, d).withColumn("id", F.col("id") % 40), merge_duplicates=False).select("id", F.round("score", 8).alias("score"))


@query("w13_rrf_first_occurrence", f"{SQL_CHANNELS} SELECT id, round(sum(weight / (60 + rank)), 8) AS score FROM (SELECT id % 40 AS id, weight, min(rank) AS rank FROM c GROUP BY 1, 2) GROUP BY id", ("memories",))
def w13(spark, d):
    return ranking.rrf(_channels(spark, d).withColumn("id", F.col("id") % 40)).select("id", F.round("score", 8).alias("score"))


@query("w14_supersession", "SELECT user_id * 10 + length(event_type) AS key, event_id AS id, CAST(epoch_us(lead(ts) OVER w) AS BIGINT) AS invalid_us, CASE WHEN lead(ts) OVER w IS NULL THEN 'current' ELSE 'historical' END AS state FROM events WINDOW w AS (PARTITION BY user_id * 10 + length(event_type) ORDER BY ts, event_id)")
def w14(spark, d):
    e = V.read(spark, d, "events").select((F.col("user_id") * 10 + F.length("event_type")).alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("valid_at"))
    return timeline.succession(e).select("key", "id", F.unix_micros(F.col("invalid_at").cast("timestamp")).alias("invalid_us"), "state")


@query("w15_line_samples", "SELECT thread, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY event_at, id) AS members FROM memories GROUP BY thread ORDER BY n DESC, thread LIMIT 3", ("memories",))
def w15(spark, d):
    g = V.memories(spark, d).groupBy("thread").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "thread").limit(3)
    met = V.memories(spark, d).join(F.broadcast(g), "thread")  # three rows
    return met.groupBy("thread", "n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_at", "id"))), lambda x: x["id"].cast("string")), ",").alias("members"))


@query("w17_logical_day", "SELECT strftime(ts - INTERVAL 270 MINUTE, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def w17(spark, d):
    return V.read(spark, d, "events").groupBy(F.date_format(F.col("ts") - F.expr("INTERVAL '04:30' HOUR TO MINUTE"), "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("w03_sessions", "WITH g AS (SELECT user_id AS user, event_id AS id, ts, CASE WHEN CAST(epoch(ts) - epoch(lag(ts) OVER w) AS BIGINT) <= 3600 THEN 0 ELSE 1 END AS new FROM (SELECT user_id, event_id, date_trunc('second', ts) AS ts FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user, id, CAST(sum(new) OVER (PARTITION BY user ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g")
def w03s(spark, d):
    e = V.read(spark, d, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("id"), F.date_trunc("second", "ts").alias("ts"))
    return timeline.sessions(e, DEFAULTS.session_gap_s).select("user", "id", "session")


# --- top-k and budgets ------------------------------------------------------

QUERY_VECTOR = [((7 * k) % 13 - 6) / 10 for k in range(64)]
SQL_QUERY = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR) + "]"


@query("k02_vector_topk", f"SELECT id, round(list_cosine_similarity(vec, {SQL_QUERY}), 6) AS sim FROM vectors ORDER BY sim DESC, id LIMIT 20", ("vectors",))
def k02(spark, d):
    return vectors.top_k(V.vectors(spark, d), QUERY_VECTOR, 20)


@query("k03_forced_cap", "WITH r AS (SELECT id, id % 90 = 0 AS forced, CAST(sum(CASE WHEN id % 90 = 0 THEN 0 ELSE 1 END) OVER (ORDER BY valence DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS free, (SELECT count(*) FROM memories WHERE id < 1000 AND id % 90 = 0) AS n FROM memories WHERE id < 1000) SELECT id, forced FROM r WHERE forced OR free <= greatest(20 - n, 0)", ("memories",))
def k03(spark, d):
    pool = V.memories(spark, d).filter("id < 1000").select("id", "valence")
    return ranking.forced_cap(pool, F.col("id") % 90 == 0, 20, [F.desc("valence"), F.col("id")]).select("id", "forced")


@query("k03_forced_cap_all", "WITH r AS (SELECT id, id % 90 = 0 AS forced, CAST(sum(CASE WHEN id % 90 = 0 THEN 0 ELSE 1 END) OVER (ORDER BY valence DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS free, (SELECT count(*) FROM memories WHERE id % 90 = 0) AS n FROM memories) SELECT id, forced FROM r WHERE forced OR free <= greatest(20 - n, 0)", ("memories",))
def k03_all(spark, d):
    return ranking.forced_cap(V.memories(spark, d).select("id", "valence"), F.col("id") % 90 == 0, 20, [F.desc("valence"), F.col("id")]).select("id", "forced")


@query("k04_pool", "SELECT id FROM memories WHERE type = 'feel' ORDER BY pinned DESC, importance DESC, last_active DESC, id LIMIT 3", ("memories",))
def k04(spark, d):
    return V.memories(spark, d).filter("type = 'feel'").orderBy(F.desc("pinned"), F.desc("importance"), F.desc("last_active"), "id").limit(3).select("id")


@query("k06_token_budget", f"WITH s AS ({SQL_ACTIVITY}), t AS (SELECT s.id, s.score, CAST(trunc(1.3::DOUBLE * len(regexp_extract_all(content, '[a-zA-Z]+')) + 0.05::DOUBLE * length(content)) AS INTEGER) AS tokens FROM s JOIN memories m USING (id) WHERE s.score < 900 ORDER BY s.score DESC, s.id LIMIT 200) SELECT id, score, tokens FROM (SELECT *, sum(tokens) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM t) WHERE used <= 6000", ("memories",))
def k06(spark, d):
    rows = _activity(V.memories(spark, d)).filter("score < 900").select("id", "score", "content")
    kept = ranking.token_budget(rows, S.token_estimate(F.col("content")), 6000, ["-score", "id"])
    return kept.select("id", "score", S.token_estimate(F.col("content")).alias("tokens"))


@query("k07_activity_topn", f"WITH s AS ({SQL_ACTIVITY}) SELECT id, score, (SELECT count(*) FROM s) - 20 AS omitted FROM s ORDER BY score DESC, id LIMIT 20", ("memories",))
def k07(spark, d):
    rows = _activity(V.memories(spark, d)).select("id", "score")
    return rows.orderBy(F.desc("score"), "id").limit(20).crossJoin(F.broadcast(rows.agg((F.count(F.lit(1)) - 20).alias("omitted"))))  # one row


@query("k10_ranked_annotations", "SELECT id, round(valence * 0.9, 4) AS resonance FROM memories ORDER BY resonance DESC, importance DESC, event_at DESC, id LIMIT 15", ("memories",))
def k10(spark, d):
    return V.memories(spark, d).withColumn("resonance", F.round(F.col("valence") * 0.9, 4)).orderBy(F.desc("resonance"), F.desc("importance"), F.desc("event_at"), "id").limit(15).select("id", "resonance")


@query("k12_keyset_page", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def k12(spark, d):
    return ranking.keyset_page(V.read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 500, 100)


@query("k13_stale", f"SELECT id, CAST(floor({_sql_age('last_active')}) AS BIGINT) AS idle_days FROM memories WHERE {_sql_age('last_active')} >= 14 AND NOT pinned AND NOT protected", ("memories",))
def k13(spark, d):
    return V.memories(spark, d).filter((_age("last_active") >= DEFAULTS.stale_days) & ~F.col("pinned") & ~F.col("protected")).select("id", F.floor(_age("last_active")).cast("long").alias("idle_days"))


@query("k05_stratified_sample")
def k05(spark, d):
    strata = F.when(F.col("importance") >= 8, "important").when(~F.col("resolved"), "open").otherwise("rest")
    return ranking.stratified(V.memories(spark, d).select("id", "importance", "resolved"), strata, {"important": 40, "open": 25, "rest": 15}, 7).select("id", "stratum")


# --- sets and writes --------------------------------------------------------


@query("u02_conflict_union", "SELECT user_id, event_type, min(v) AS v, count(DISTINCT v) > 1 AS conflict, count(*) AS n FROM (SELECT user_id, event_type, CAST(floor(value) AS BIGINT) AS v FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_type, CAST(floor(value) AS BIGINT) FROM events WHERE event_id % 2 = 1) GROUP BY 1, 2")
def u02(spark, d):
    e = V.read(spark, d, "events").select("event_id", "user_id", "event_type", F.floor("value").cast("long").alias("v"))
    return ledger.conflict_union(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id", "event_type"], "v")


@query("u03_new_ids", "SELECT id FROM memories EXCEPT SELECT vec_id FROM embeddings", ("memories",))
def u03(spark, d):
    return V.memories(spark, d).select("id").subtract(V.vectors(spark, d).select("id"))


@query("u08_idempotent_insert", "WITH i AS (SELECT user_id, event_type, event_id AS seq, md5(CAST(event_id % 3 AS VARCHAR)) AS digest FROM events WHERE event_id >= 100), s AS (SELECT DISTINCT user_id, event_type, md5('1') AS d FROM events WHERE event_id < 100), r AS (SELECT i.*, s.d, first_value(digest) OVER w AS f, row_number() OVER w AS rn FROM i LEFT JOIN s USING (user_id, event_type) WINDOW w AS (PARTITION BY user_id, event_type ORDER BY seq)) SELECT seq, CASE WHEN d IS NULL AND rn = 1 THEN 'inserted' WHEN digest = coalesce(d, f) THEN 'replayed' ELSE 'conflict' END AS outcome FROM r")
def u08(spark, d):
    e = V.read(spark, d, "events")
    stored = e.filter("event_id < 100").select("user_id", "event_type", F.md5(F.lit("1").cast("binary")).alias("digest"))
    incoming = e.filter("event_id >= 100").select("user_id", "event_type", F.col("event_id").alias("seq"), F.md5((F.col("event_id") % 3).cast("string").cast("binary")).alias("digest"))
    return ledger.append_once(stored, incoming, ["user_id", "event_type"], "digest").select("seq", "outcome")


@query("u09_upsert_revision", "SELECT user_id, max_by(event_type, event_id) AS event_type, round(max_by(value, event_id), 4) AS value, count(*) AS revision FROM events GROUP BY user_id")
def u09(spark, d):
    return ledger.upsert(V.read(spark, d, "events"), "user_id", "event_id", ["event_type", "value"]).withColumn("value", F.round("value", 4))


# --- text -------------------------------------------------------------------

LEXICON = {"touch": ["the ", "and "], "sound": ["tion", "ment"], "sight": ["lich", "schau"], "taste": ["mente", "ción"]}
SQL_LEXICON = ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(content), {chr(39)}{t}{chr(39)})' for t in terms)} THEN '{name}' END" for name, terms in LEXICON.items())


@query("x01_strip_links", "SELECT id, md5(regexp_replace('[[' || name || ']] ' || content, '\\[\\[([^\\]]+)\\]\\]', '\\1', 'g')) AS digest FROM memories", ("memories",))
def x01(spark, d):
    linked = F.concat(F.lit("[["), F.col("name"), F.lit("]] "), F.col("content"))
    return V.memories(spark, d).select("id", F.md5(X.strip_wikilinks(linked).cast("binary")).alias("digest"))


@query("x06_revision_hash", "SELECT id, sha256(concat_ws(chr(31), content, name, type, importance::VARCHAR)) AS digest FROM memories", ("memories",))
def x06(spark, d):
    return V.memories(spark, d).select("id", F.sha2(F.concat_ws("\x1f", "content", "name", "type", F.col("importance").cast("string")).cast("binary"), 256).alias("digest"))


@query("x07_fingerprint", "SELECT count(DISTINCT fp) AS distinct_texts, count(fp) AS fingerprinted FROM (SELECT CASE WHEN length(p) >= 8 THEN sha256(p) END AS fp FROM (SELECT regexp_replace(lower(content), '[^a-z0-9]+', '', 'g') AS p FROM memories))", ("memories",))
def x07(spark, d):
    return V.memories(spark, d).select(X.fingerprint(F.col("content")).alias("fp")).agg(F.count_distinct("fp").alias("distinct_texts"), F.count("fp").alias("fingerprinted"))


@query("x08_key_values", "SELECT id, name AS rank, CAST(n_chars AS VARCHAR) AS size FROM memories", ("memories",))
def x08(spark, d):
    m = V.memories(spark, d)
    body = F.concat(F.lit("rank: first\nsize: "), F.col("n_chars").cast("string"), F.lit("\nrank: "), F.col("name"))
    kv = X.key_values(body)
    return m.select("id", kv["rank"].alias("rank"), kv["size"].alias("size"))


def _sql_redacted(text: str) -> str:
    for pattern, replacement in X.MASKS:
        text = "regexp_replace({}, '{}', '{}', 'g')".format(text, pattern.replace("'", "''"), replacement.replace("$1", "\\1"))
    return text


@query("x25_redaction", f"SELECT id, md5(m) AS digest, m <> content AS changed FROM (SELECT id, content, {_sql_redacted('content')} AS m FROM memories)", ("memories",))
def x25(spark, d):
    masked = V.memories(spark, d).select("id", "content", X.redact(F.col("content")).alias("masked"))
    return masked.select("id", F.md5(F.col("masked").cast("binary")).alias("digest"), (F.col("masked") != F.col("content")).alias("changed"))


@query("x27_senses", f"SELECT id, array_to_string(list_filter([{SQL_LEXICON}], lambda x: x IS NOT NULL), ',') AS senses FROM memories", ("memories",))
def x27(spark, d):
    return V.memories(spark, d).select("id", F.array_join(X.senses(F.col("content"), LEXICON), ",").alias("senses"))


@query("x43_page_links", "SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS links, length(html) AS size FROM pages")
def x43(spark, d):
    return V.read(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).cast("long").alias("links"), F.length("html").cast("long").alias("size"))


@query("x53_short_hash", "SELECT id, substr(sha1(concat_ws(chr(31), name, type)), 1, 12) AS h FROM memories", ("memories",))
def x53(spark, d):
    return V.memories(spark, d).select("id", X.short_hash(F.col("name"), F.col("type")).alias("h"))


# --- graph ------------------------------------------------------------------

SQL_EXPAND = """WITH live AS (SELECT source, target, type, strength FROM edges WHERE type IN ('kin', 'explains') AND strength BETWEEN 0 AND 1 AND source <> target),
adj AS (SELECT source AS a, target AS b, type, strength FROM live UNION ALL SELECT target, source, type, strength FROM live), seeds AS (SELECT id FROM memories WHERE id % 25 = 0),
one AS (SELECT b AS id, a AS via, type, 1 AS depth, strength, round(strength * CASE type WHEN 'kin' THEN 1.0 ELSE 0.85 END, 6) AS score FROM adj JOIN seeds ON a = id WHERE strength >= 0.4 AND b NOT IN (SELECT id FROM seeds) QUALIFY row_number() OVER (PARTITION BY b ORDER BY score DESC, a, type) = 1),
two AS (SELECT b AS id, a AS via, adj.type, 2 AS depth, adj.strength, round(adj.strength * CASE adj.type WHEN 'kin' THEN 1.0 ELSE 0.85 END * 0.6, 6) AS score FROM adj JOIN one ON a = one.id WHERE adj.strength >= 0.7 AND b NOT IN (SELECT id FROM seeds) AND b NOT IN (SELECT id FROM one) QUALIFY row_number() OVER (PARTITION BY b ORDER BY score DESC, a, adj.type) = 1)
SELECT * FROM (SELECT * FROM one UNION ALL SELECT * FROM two) ORDER BY score DESC, depth, id LIMIT 50"""


@query("g01_graph_two_hops", SQL_EXPAND, ("memories", "edges"))
def g01(spark, d):
    m = V.memories(spark, d).select("id")
    return graph.expand(V.edges(spark, d), m, m.filter("id % 25 = 0"), ["kin", "explains"], 50)


@query("g02_components", """WITH e AS (SELECT source AS a, target AS b FROM edges WHERE type = 'kin' UNION SELECT target, source FROM edges WHERE type = 'kin'),
walk AS (SELECT id, id AS reach FROM memories UNION SELECT walk.id, e.b FROM walk JOIN e ON e.a = walk.reach)
SELECT id, min(reach) AS comp FROM walk GROUP BY id""", ("memories", "edges"))
def g02(spark, d):
    return graph.components(V.edges(spark, d).filter("type = 'kin'"), V.memories(spark, d).select("id"))


@query("g02_thread_labels", """WITH e AS (SELECT source AS a, target AS b FROM edges WHERE type = 'kin' UNION SELECT target, source FROM edges WHERE type = 'kin'),
walk AS (SELECT id, id AS reach FROM memories UNION SELECT walk.id, e.b FROM walk JOIN e ON e.a = walk.reach),
c AS (SELECT id, min(reach) AS comp FROM walk GROUP BY id), own AS (SELECT id, thread AS label FROM memories WHERE resolved OR protected),
one AS (SELECT comp, min(label) AS label FROM c JOIN own USING (id) GROUP BY comp HAVING count(DISTINCT label) = 1)
SELECT c.id, c.comp, one.label, CASE WHEN own.label IS NULL THEN 'spread' ELSE 'own' END AS how FROM c JOIN one USING (comp) LEFT JOIN own USING (id)""", ("memories", "edges"))
def g02_labels(spark, d):
    """Labels of judged records spread over their component, if it names one label only."""
    m = V.memories(spark, d)
    comp = graph.components(V.edges(spark, d).filter("type = 'kin'"), m.select("id"))
    return graph.spread_labels(comp, m.filter("resolved or protected").select("id", F.col("thread").alias("label")))


# --- stateful operators, as batches ----------------------------------------


@query("t06_session_ttl", "SELECT user_id AS session, event_id AS key FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts > TIMESTAMP '2024-01-28 00:00:00') WHERE rn <= 1024")
def t06(spark, d):
    e = V.read(spark, d, "events").filter(F.col("ts") > F.lit("2024-01-28 00:00:00").cast("timestamp_ntz"))
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return e.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= DEFAULTS.session_keys).select(F.col("user_id").alias("session"), F.col("event_id").alias("key"))


@query("t11_backoff", "SELECT event_id, least(60.0 * pow(2, least(event_id % 12, 8)), 3600.0) AS wait_s FROM events")
def t11(spark, d):
    return V.read(spark, d, "events").select("event_id", S.backoff_s(F.col("event_id") % 12).alias("wait_s"))


@query("t12_activation", "SELECT user_id, count(*) AS n, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM events GROUP BY user_id")
def t12(spark, d):
    return V.read(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.max("ts").cast("timestamp")).alias("last_us"))


# --- chunking, parsing and string similarity --------------------------------


@query("w07_turn_chunks")
def w07(spark, d):
    return chunking.turn_chunks(V.read(spark, d, "conversations"), 200)


@query("w08_line_chunks")
def w08(spark, d):
    bounded_batches(spark)
    m = V.memories(spark, d).select("id", F.posexplode(chunking.line_chunks(F.col("content"))).alias("segment", "chunk"))
    return m.select("id", "segment", F.length("chunk").alias("size"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query("x31_utf8_parts")
def x31(spark, d):
    bounded_batches(spark)
    m = V.memories(spark, d).select("id", F.posexplode(chunking.utf8_parts(F.col("content"), 4096)).alias("part", "data"))
    return m.select("id", "part", F.length("data").alias("size"), F.sha2("data", 256).alias("digest"))


@query("m01_topic_score")
def m01(spark, d):
    bounded_batches(spark)
    m = V.memories(spark, d)
    score = similarity.topic_score("src3 the", F.col("name"), F.col("tags"), F.col("domain"), F.col("content"))
    return m.select("id", F.round(score, 6).alias("score"))


@query("s11_message_lists", "SELECT conv, pos, role, content, ts FROM (SELECT conv_id AS conv, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, role, trim(text, ' ') AS content, turn::VARCHAR AS ts FROM conversations) WHERE content <> ''")
def s11(spark, d):
    c = V.read(spark, d, "conversations")
    message = F.to_json(F.struct(F.col("role").alias("sender"), "text", F.col("turn").cast("string").alias("created_at")))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]), ",")
    raw = c.groupBy(F.col("conv_id").alias("conv")).agg(F.concat(F.lit('{"chat_messages":['), ordered, F.lit("]}")).alias("json"))
    return exports.message_lists(raw)


@query("s13_plain_text", "SELECT conv, pos, role, content, '' AS ts FROM (SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, role, trim(replace(text, chr(10), ' '), ' ') AS content FROM conversations WHERE role IN ('user', 'assistant')) WHERE content <> ''")
def s13(spark, d):
    c = V.read(spark, d, "conversations").filter("role in ('user', 'assistant')")
    line = F.concat(F.col("role"), F.lit(": "), F.regexp_replace("text", "\n", " "))
    raw = c.groupBy(F.col("conv_id").alias("conv")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return exports.plain_text(raw)


# --- entry points -----------------------------------------------------------


SQL_RECALL = f"""WITH m AS (SELECT * FROM memories WHERE NOT pinned AND NOT protected AND world IN ('shared', 'north', 'south') AND lower(domain[1]) IN ('en', 'fr')),
k AS (SELECT id, 100 * (4.0::DOUBLE * least((contains(lower(content), 'the')::INT + contains(lower(content), 'and')::INT + contains(lower(content), 'with')::INT + contains(lower(content), 'for')::INT) / 4.0::DOUBLE, 1.0) + 1.0 + 2.5::DOUBLE * exp(-0.1 * {_sql_age('last_active')}) + importance / 10.0::DOUBLE) / 9.5 AS s FROM m),
a AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS rank FROM k WHERE s >= 50 QUALIFY rank <= 50),
v AS (SELECT id, row_number() OVER (ORDER BY round(list_cosine_similarity(vec, {SQL_QUERY}), 6) DESC, id) AS rank FROM vectors WHERE id IN (SELECT id FROM m) QUALIFY rank <= 50),
f AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM v) GROUP BY id ORDER BY score DESC, id LIMIT 20),
p AS (SELECT f.id, score * 100 AS rel, score * (0.6::DOUBLE + 0.4::DOUBLE * CASE WHEN type IN ('permanent', 'feel') THEN 1.0 WHEN resolved THEN raw ELSE greatest(raw, 0.25) END) AS tie FROM f JOIN (SELECT *, exp(-0.693 * {_sql_age('event_at')} / greatest(0.001, 14.0 * (1 + 0.5 * log2((1 + activation)::DOUBLE)))) AS raw FROM m) USING (id)),
o AS (SELECT *, row_number() OVER (ORDER BY rel DESC, id) AS rn FROM p),
b AS (SELECT rn, rel AS leader, 0 AS band FROM o WHERE rn = 1 UNION ALL SELECT o.rn, CASE WHEN b.leader - o.rel <= 0.35 THEN b.leader ELSE o.rel END, CASE WHEN b.leader - o.rel <= 0.35 THEN b.band ELSE b.band + 1 END FROM b JOIN o ON o.rn = b.rn + 1)
SELECT id, round(rel, 6) AS rel, round(tie, 6) AS tie, band, CAST(row_number() OVER (ORDER BY band, tie DESC, rel DESC, id) AS INTEGER) AS pos FROM o JOIN b USING (rn)"""


@query("q01_recall", SQL_RECALL, ("memories", "vectors"))
def q01(spark, d):
    """Hybrid recall: a keyword and a vector channel over the same eligible records, fused
    by rank, decayed and reordered inside relevance bands of a page of twenty."""
    m = V.memories(spark, d).filter(recall_filter(["en", "fr"], ["north", "south"]))
    keyword = 100 * (DEFAULTS.topic * F.least(X.hits(F.col("content"), ["the", "and", "with", "for"]) / 4.0, F.lit(1.0)) + DEFAULTS.emotion * 0.5 + DEFAULTS.time * S.time_score(_age("last_active")) + DEFAULTS.importance * F.col("importance") / 10) / 9.5
    by_word = m.withColumn("s", keyword).filter(F.col("s") >= DEFAULTS.keyword_floor).select("id", "s").orderBy(F.desc("s"), "id").limit(50)
    near = vectors.top_k(V.vectors(spark, d).join(m.select("id"), "id", "left_semi"), QUERY_VECTOR, 50).select("id", F.col("sim").alias("s"))
    rank = lambda c, df: df.select(F.lit(c).alias("channel"), F.lit(1.0).alias("weight"), F.row_number().over(Window.orderBy(F.desc("s"), "id")).alias("rank"), "id")
    fused = ranking.rrf(rank(0, by_word).unionByName(rank(1, near)), DEFAULTS.rrf_k).orderBy(F.desc("score"), "id").limit(20)
    decay = S.retrieval_decay(_age("event_at"), F.col("activation"), F.col("resolved"), F.col("type").isin("permanent", "feel"))
    page = fused.join(m.select("id", "event_at", "activation", "resolved", "type"), "id").select("id", (F.col("score") * 100).alias("rel"), S.blend_decay(F.col("score"), decay).alias("tie"))
    return ranking.band_rank(page, 0.35).withColumn("rel", F.round("rel", 6)).withColumn("tie", F.round("tie", 6))


@query("q20_consolidation", "SELECT CASE WHEN length(x.content) <= length(y.content) THEN p.a ELSE p.b END AS loser, p.a, p.b, p.sim FROM (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.vec, b.vec), 6) AS sim FROM vectors a JOIN vectors b ON a.id < b.id WHERE round(list_cosine_similarity(a.vec, b.vec), 6) >= 0.38) p JOIN memories x ON x.id = p.a JOIN memories y ON y.id = p.b ORDER BY sim DESC, a, b LIMIT 50", ("memories", "vectors"))
def q20(spark, d):
    m = V.memories(spark, d).select("id", F.length("content").alias("n"))
    # only vectors of records are paired, so the best pairs are known before they meet the texts' lengths
    pairs = vectors.similar_pairs(V.vectors(spark, d).join(m.select("id"), "id", "left_semi"), 0.38)
    best = F.broadcast(pairs.orderBy(F.desc("sim"), "a", "b").limit(50))  # fifty rows
    met = m.select(F.col("id").alias("a"), F.col("n").alias("na")).join(best, "a")
    met = m.select(F.col("id").alias("b"), F.col("n").alias("nb")).join(F.broadcast(met), "b")
    return met.orderBy(F.desc("sim"), "a", "b").limit(50).select(F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("loser"), "a", "b", "sim")


@query("q23_coverage_report", "SELECT 'uncovered' AS item, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) UNION ALL SELECT 'orphans', count(*) FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL UNION ALL SELECT 'status ' || o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus")
def q23(spark, d):
    o, li = V.read(spark, d, "orders"), V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    item = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "n")
    status = o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("status "), "o_orderstatus").alias("item"), "n")
    return item("uncovered", o.join(li, "o_orderkey", "left_anti")).unionByName(item("orphans", li.join(o.select("o_orderkey"), "o_orderkey", "left_anti"))).unionByName(status)


@query("q24_integrity", "SELECT 'document' AS part, doc_id AS id FROM documents WHERE n_chars <> length(text) OR n_chars IS NULL UNION ALL SELECT 'label', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'turn', conv_id FROM conversations GROUP BY conv_id HAVING count(*) <> max(turn) - min(turn) + 1")
def q24(spark, d):
    """Rows that break a contract: a stored length that isn't the text's, a label without its document, turns with gaps or repeats."""
    docs = V.read(spark, d, "documents")
    wrong = docs.filter(F.col("n_chars").isNull() | (F.col("n_chars") != F.length("text"))).select(F.lit("document").alias("part"), F.col("doc_id").alias("id"))
    lost = V.read(spark, d, "labels").join(docs.select("doc_id"), "doc_id", "left_anti").select(F.lit("label").alias("part"), F.col("doc_id").alias("id"))
    turns = V.read(spark, d, "conversations").groupBy("conv_id").agg((F.count(F.lit(1)) != F.max("turn") - F.min("turn") + 1).alias("bad"))
    return wrong.unionByName(lost).unionByName(turns.filter("bad").select(F.lit("turn").alias("part"), F.col("conv_id").alias("id")))
