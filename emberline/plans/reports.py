"""Reports over all fields: distributions, weighted votes, the other half of the patrol."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import facts as R
from ..operators import facts, graph, patrol, ranking
from ..sources import views as V
from .catalog import SQL_REF, query

FIELDS = ("valence", "arousal", "importance", "activation")
POINTS = {"p05": 0.05, "p50": 0.5, "p95": 0.95}


def _long(name: str) -> str:
    return f"SELECT '{name}' AS field, type AS part, {name}::DOUBLE AS v FROM memories UNION ALL SELECT '{name}', 'all', {name}::DOUBLE FROM memories"


@query("a04_field_distributions", f"WITH l AS ({' UNION ALL '.join(_long(f) for f in FIELDS)}) SELECT field, part, count(*) AS n, round(min(v), 4) AS low, round(max(v), 4) AS high, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.05), 4) AS p05, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.95), 4) AS p95 FROM l GROUP BY 1, 2", ("memories",))
def a04_fields(spark, d):
    """Count, least, greatest, mean and three percentiles of four fields, by type and over all."""
    m = V.memories(spark, d).select("type", *[F.col(f).cast("double").alias(f) for f in FIELDS])
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in FIELDS])
    long = m.select(F.explode(values).alias("x"), F.explode(F.array(F.col("type"), F.lit("all"))).alias("part")).select(F.concat_ws("|", "x.field", "part").alias("key"), "x.v")
    plain = long.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("v"), 4).alias("low"), F.round(F.max("v"), 4).alias("high"), F.round(F.avg("v"), 4).alias("mean"))
    met = plain.join(ranking.percentiles(long, "key", "v", POINTS), "key")
    part = F.split("key", r"\|")
    return met.select(part[0].alias("field"), part[1].alias("part"), "n", "low", "high", "mean", *[F.round(p, 4).alias(p) for p in POINTS])


@query("a04_enum_histograms", "SELECT 'type' AS field, type AS value, count(*) AS n FROM memories GROUP BY 2 UNION ALL SELECT 'world', world, count(*) FROM memories GROUP BY 2 UNION ALL SELECT 'domain', domain[1], count(*) FROM memories GROUP BY 2", ("memories",))
def a04_enums(spark, d):
    m = V.memories(spark, d)
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in (("type", F.col("type")), ("world", F.col("world")), ("domain", F.element_at("domain", 1)))])
    return m.select(F.explode(pairs).alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def _sql_vote(name: str, column: str) -> str:
    return f"{name} AS (SELECT thread, {column} AS vote, row_number() OVER (PARTITION BY thread ORDER BY sum(importance) DESC, {column} DESC) AS rn FROM memories GROUP BY 1, 2)"


@query("a06_weighted_votes", f"WITH {_sql_vote('a', 'domain[1]')}, {_sql_vote('b', 'type')}, w AS (SELECT thread, {', '.join(f'round(sum({f} * importance)::DOUBLE / sum(importance), 4) AS {f}' for f in FIELDS)} FROM memories GROUP BY 1) SELECT w.*, a.vote AS domain, b.vote AS type FROM w JOIN a ON a.thread = w.thread AND a.rn = 1 JOIN b ON b.thread = w.thread AND b.rn = 1", ("memories",))
def a06_votes(spark, d):
    """Four weighted means and two weighted votes of each thread; of equal votes the later name."""
    m = V.memories(spark, d).withColumn("dom", F.element_at("domain", 1))
    parts = m.groupBy("thread", "dom", "type").agg(F.sum("importance").alias("w"), *[F.sum(F.col(f) * F.col("importance")).alias(f) for f in FIELDS])  # few rows for a thread
    means = parts.groupBy("thread").agg(*[F.round(F.sum(f).cast("double") / F.sum("w"), 4).alias(f) for f in FIELDS])
    vote = lambda c: parts.groupBy("thread", c).agg(F.sum("w").alias("w")).groupBy("thread").agg(F.max(F.struct("w", c)).alias("x")).select("thread", f"x.{c}")
    return means.join(vote("dom").withColumnRenamed("dom", "domain"), "thread").join(vote("type"), "thread")


SQL_MORE = f"""WITH kin AS (SELECT DISTINCT source, target FROM edges WHERE type = 'kin' AND source <> target),
fp AS (SELECT id, k FROM (SELECT id, regexp_replace(lower(content), '[^a-z0-9]+', '', 'g') AS k FROM memories) WHERE length(k) >= 8),
f AS (
  SELECT 'non_reciprocal' AS "check", source AS id, target::VARCHAR AS detail FROM kin WHERE NOT EXISTS (SELECT 1 FROM kin b WHERE b.source = kin.target AND b.target = kin.source)
  UNION ALL SELECT 'missing_vector', id, 'none' FROM memories WHERE id NOT IN (SELECT id FROM vectors)
  UNION ALL SELECT 'orphan_vector', id, 'none' FROM vectors WHERE id NOT IN (SELECT id FROM memories)
  UNION ALL SELECT 'duplicate_content', id, least_id::VARCHAR FROM (SELECT id, min(id) OVER (PARTITION BY k) AS least_id, count(*) OVER (PARTITION BY k) AS n FROM fp) WHERE n > 1 AND id <> least_id
  UNION ALL SELECT 'untimed', id, 'none' FROM memories WHERE event_at IS NULL
  UNION ALL SELECT 'late', id, strftime(last_active, '%Y-%m-%d') FROM memories WHERE last_active > {SQL_REF}
  UNION ALL SELECT 'isolated', id, type FROM memories WHERE id NOT IN (SELECT target FROM edges WHERE target <> source) AND type = 'permanent'
  UNION ALL SELECT 'short', id, length(content)::VARCHAR FROM memories WHERE length(content) < 20
  UNION ALL SELECT 'unlabelled_core', id, 'pinned' FROM memories WHERE pinned AND id NOT IN (SELECT doc_id FROM labels)
)"""


@query("q18_patrol_more", f"{SQL_MORE} SELECT * FROM f", ("memories", "edges", "vectors"))
def q18_more(spark, d):
    return patrol.more(V.memories(spark, d), V.edges(spark, d), V.vectors(spark, d).select("id"), V.read(spark, d, "labels").select(F.col("doc_id").alias("id")), V.ref())


#: Slots of the texts' personal data.
SLOTS = {"mail": r"([A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+)", "number": r"\b([0-9]{12,19})\b", "token": r"(?i)token = .([0-9a-f]{40})"}
SQL_SLOT = " UNION ALL ".join(f"SELECT '{k}' AS slot, id, event_at AS at, list_sort(list_distinct(list_transform(regexp_extract_all(content, '{p}', 1), lambda x: lower(trim(x, ' '))))) AS vals FROM m" for k, p in SLOTS.items())


@query("j22_slot_pairs", f"""WITH m AS (SELECT * FROM memories WHERE NOT resolved AND NOT pinned AND NOT protected AND type = 'dynamic'), s AS (SELECT * FROM ({SQL_SLOT}) WHERE len(vals) > 0),
l AS (SELECT source AS a, target AS b FROM edges WHERE type = 'updates' UNION SELECT target, source FROM edges WHERE type = 'updates')
SELECT n.slot, n.id AS current, o.id AS historical, n.vals[1] AS current_value, o.vals[1] AS historical_value FROM s n JOIN s o ON n.slot = o.slot AND (o.at < n.at OR (o.at = n.at AND o.id < n.id))
WHERE n.vals <> o.vals AND n.vals[1] <> o.vals[1] AND NOT EXISTS (SELECT 1 FROM l WHERE l.a = n.id AND l.b = o.id)
ORDER BY n.slot, n.at DESC, n.id DESC, o.at DESC, o.id DESC LIMIT 200""", ("memories", "edges"))
def j22_slots(spark, d):
    """Newer and older records whose values of a slot disagree, but for pairs that an update links."""
    m = V.memories(spark, d)
    live = m.filter(~F.col("resolved") & ~R.slot_exempt(F.col("pinned"), F.col("protected"), F.col("type"), F.col("domain")))
    linked = graph.both_ways(V.edges(spark, d).filter("type = 'updates'")).select(F.col("a").alias("newer"), F.col("b").alias("older"))
    return facts.slot_pairs(live.select("id", F.col("event_at").alias("at"), F.lit("").alias("status"), "content"), SLOTS, linked)
