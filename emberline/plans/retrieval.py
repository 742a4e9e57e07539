"""Queries of search by index, clusters, sources and sinks that write and read real files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULTS, REF
from ..functions import facts as R
from ..functions import scoring as S
from ..functions import text as X
from ..operators import chunking, clusters, facts
from ..operators import keyword_index as KI
from ..operators import recall
from ..operators import vectors as VS
from ..sources import views as V
from .catalog import QUERY_VECTOR, SQL_ACTIVITY, SQL_QUERY, _age, _sql_age, _sql_redacted, query

# --- keyword search by an inverted index (K01, Q14) ---------------------------

TOTAL = DEFAULTS.topic + DEFAULTS.emotion + DEFAULTS.time + DEFAULTS.importance


def keyword_index(spark, d, block: int = KI.BLOCK) -> KI.Index:
    """The store's index; without a query's emotion that part of the score is the same for all."""
    static = DEFAULTS.emotion * S.emotion_score(F.col("valence"), F.col("arousal"), None, None) + DEFAULTS.time * S.time_score(_age("last_active")) + DEFAULTS.importance * S.clamp(F.col("importance"), 1, 10) / 10
    return KI.build(V.memories(spark, d), static, ["world", "domain", "resolved"], block)


def _items(spark, d):
    return V.read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


SQL_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"


def _sql_search(where: str, floor: float | None, k: int) -> str:
    return f"""WITH m AS (
  SELECT id, {SQL_WORDS.format("concat_ws(' ', name, array_to_string(tags, ' '))")} AS in_name, {SQL_WORDS.format("coalesce(content, '')")} AS in_content,
    {DEFAULTS.emotion}::DOUBLE * 0.5 + {DEFAULTS.time}::DOUBLE * exp(-0.1 * {_sql_age('last_active')}) + {DEFAULTS.importance}::DOUBLE * importance / 10.0 AS static
  FROM memories WHERE {where}
), q AS (SELECT item_id AS qid, {SQL_WORDS.format('text')} AS words FROM benchmark),
s AS (
  SELECT qid, id, round(100 * ({DEFAULTS.topic}::DOUBLE * CASE WHEN len(words) > 0 THEN greatest(len(list_intersect(in_name, words))::DOUBLE / len(words), {KI.CONTENT}::DOUBLE * len(list_intersect(in_content, words)) / len(words)) ELSE 0 END + static) / {TOTAL}, 6) AS score
  FROM m CROSS JOIN q
)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS pos, id, score FROM s {f'WHERE score >= {floor}' if floor else ''} QUALIFY pos <= {k}"""


@query("k01_indexed_search", _sql_search("world IN ('shared', 'north', 'south') AND lower(domain[1]) IN ('en', 'fr')", DEFAULTS.keyword_floor, 20), ("memories",))
def k01_indexed(spark, d):
    """Every benchmark item as a query over two languages and two worlds, floor and twenty rows."""
    keep = F.col("world").isin("shared", "north", "south") & F.lower(F.element_at("domain", 1)).isin("en", "fr")
    return KI.search(spark, keyword_index(spark, d), _items(spark, d), 20, DEFAULTS.topic, TOTAL, keep, DEFAULTS.keyword_floor)[0]


@query("q14_indexed_search", _sql_search("true", None, 10), ("memories",))
def q14_indexed(spark, d):
    """The ten best records of all for every benchmark item."""
    return KI.search(spark, keyword_index(spark, d), _items(spark, d), 10, DEFAULTS.topic, TOTAL)[0]


@query("k01_opened_blocks")
def k01_opened(spark, d):
    """Blocks of 16 records that each benchmark item opens for its ten best."""
    return KI.search(spark, keyword_index(spark, d, 16), _items(spark, d), 10, DEFAULTS.topic, TOTAL)[1]


# --- greedy clusters and episodes (W05, W06, G08, R40) --------------------------

SQL_SPAN = "abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 259200000000"
#: The greedy loop over a list of free rows: each step the first of them takes its free neighbours.
SQL_GREEDY = """r(step, taken, free) AS (
  SELECT 0, []::BIGINT[], coalesce((SELECT list(rn ORDER BY rn) FROM p), []::BIGINT[])
  UNION ALL
  SELECT step + 1, m, list_filter(free, lambda x: NOT list_contains(m, x)) FROM (
    SELECT step, free, list_concat([free[1]], list_filter(coalesce(nbrs, []::BIGINT[]), lambda x: list_contains(free, x)){cap}) AS m
    FROM r LEFT JOIN adj ON adj.rn = free[1] WHERE len(free) > 0
  )
)"""


def _sql_seeds(threshold: float) -> str:
    return f"""pool AS (SELECT v.id, m.event_at AS ts, v.vec FROM vectors v JOIN memories m USING (id) WHERE m.event_at >= (SELECT max(event_at) FROM memories) - INTERVAL {DEFAULTS.episode_lookback_days} DAY),
p AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ts DESC, id) AS rn FROM pool),
adj AS MATERIALIZED (SELECT a.rn, list(b.rn ORDER BY b.rn) AS nbrs FROM p a JOIN p b ON a.rn < b.rn AND {SQL_SPAN} AND round(list_cosine_similarity(a.vec, b.vec), 9) >= {threshold} GROUP BY a.rn),
{SQL_GREEDY.format(cap='[1:11]')},
c AS (SELECT p.id AS seed, o.id FROM (SELECT taken[1] AS s, unnest(taken) AS t FROM r WHERE len(taken) >= 2) x JOIN p ON p.rn = x.s JOIN p o ON o.rn = x.t)"""


def seeds(spark, d, threshold: float = 0.3):
    """Clusters of the look-back time: the newest row takes up to eleven near ones within three days."""
    m = V.memories(spark, d).select("id", F.col("event_at").alias("ts"))
    since = F.broadcast(m.agg((F.max("ts") - F.make_dt_interval(F.lit(DEFAULTS.episode_lookback_days))).alias("since")))  # one row
    pool = V.vectors(spark, d).join(m.crossJoin(since).filter("ts >= since").drop("since"), "id")
    return chunking.greedy_clusters(pool, threshold, 3.0, 2, 12)


@query("w05_greedy_clusters", f"WITH {_sql_seeds(0.3)} SELECT seed, id FROM c", ("memories", "vectors"))
def w05(spark, d):
    return seeds(spark, d)


EPISODE_COLUMNS = "seed, n, importance, round(valence, 6) AS valence, round(arousal, 6) AS arousal, domain, strftime(span_start, '%Y-%m-%d %H:%M:%S') AS span_start, strftime(span_end, '%Y-%m-%d %H:%M:%S') AS span_end, sources"
SQL_EPISODES = f"""WITH {_sql_seeds(0.3)},
b AS (
  SELECT seed, count(*) AS n, CAST(least(max(importance), 10) AS BIGINT) AS importance, avg(valence) AS valence, avg(arousal) AS arousal, min(event_at) AS span_start, max(event_at) AS span_end,
    list(id ORDER BY event_at, id) AS sources
  FROM c JOIN memories USING (id) GROUP BY seed
), d AS (SELECT seed, domain[1] AS domain, row_number() OVER (PARTITION BY seed ORDER BY count(*) DESC, min(struct_pack(a := event_at, b := id))) AS rn FROM c JOIN memories USING (id) WHERE domain[1] IS NOT NULL GROUP BY seed, domain[1])
SELECT {EPISODE_COLUMNS} FROM b LEFT JOIN (SELECT seed, domain FROM d WHERE rn = 1) USING (seed)"""


def _episodes(spark, d):
    told = clusters.episodes(seeds(spark, d), V.memories(spark, d).select("id", "event_at", "importance", "valence", "arousal", F.filter("domain", lambda x: x.isNotNull()).alias("domain")))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return told.select("seed", "n", "importance", F.round("valence", 6).alias("valence"), F.round("arousal", 6).alias("arousal"), "domain", at("span_start"), at("span_end"), "sources")


@query("g08_episode_rollup", SQL_EPISODES, ("memories", "vectors"), ("sources",))
def g08(spark, d):
    """Every cluster of the look-back time as an episode with times, weights and lineage."""
    return _episodes(spark, d)


@query("r40_episode_cycle", f"{SQL_EPISODES} ORDER BY seed DESC LIMIT 5", ("memories", "vectors"), ("sources",))
def r40(spark, d):
    """One cycle: clusters become episodes, five at most, newest ids first."""
    return _episodes(spark, d).orderBy(F.desc("seed")).limit(5)


def _sql_patterns(threshold: float) -> str:
    return f"""WITH p AS MATERIALIZED (SELECT v.id, v.vec, v.id AS rn FROM vectors v JOIN memories m USING (id) WHERE m.type = 'dynamic' AND NOT m.pinned AND NOT m.resolved),
adj AS MATERIALIZED (SELECT a.rn, list(b.rn ORDER BY b.rn) AS nbrs FROM p a JOIN p b ON a.rn < b.rn AND round(list_cosine_similarity(a.vec, b.vec), 9) > {threshold} GROUP BY a.rn),
{SQL_GREEDY.format(cap='')}
SELECT taken[1] AS lead, m.name, left({_sql_redacted('m.content')}, 200) AS content, len(taken) AS n, CASE WHEN len(taken) >= 5 THEN 'pin' ELSE 'review' END AS action, taken AS ids
FROM r JOIN memories m ON m.id = taken[1] WHERE len(taken) >= 3 ORDER BY n DESC, lead LIMIT 20"""


def _patterns(spark, d, threshold: float, head: int = clusters.HEAD):
    m = V.memories(spark, d).filter("type = 'dynamic' and not pinned and not resolved")
    found = clusters.leader_clusters(V.vectors(spark, d).join(m.select("id"), "id", "left_semi"), threshold, head)
    top = clusters.patterns(found)
    ids = found.join(F.broadcast(top.select("lead")), "lead").groupBy("lead").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # twenty leads
    told = top.join(ids, "lead").join(m.select(F.col("id").alias("lead"), "name", "content"), "lead")
    return told.select("lead", "name", F.substring(X.redact(F.col("content")), 1, 200).alias("content"), "n", "action", "ids")


@query("w06_patterns", _sql_patterns(0.7), ("memories", "vectors"), ("ids",))
def w06(spark, d):
    """Recurring patterns among dynamic records: greedy leaders with a cosine over 0.7."""
    return _patterns(spark, d, 0.7)


@query("w06_loose_patterns", _sql_patterns(0.3), ("memories", "vectors"), ("ids",))
def w06_loose(spark, d):
    """As ``w06_patterns`` at 0.3, in rounds after the first 64 rows."""
    return _patterns(spark, d, 0.3, 64)


# --- recall in three modes (Q01) -------------------------------------------------

#: The test tables' vectors are near random, so few pass the floor of 0.5.
ASK = recall.Ask(words=("src3", "the", "and", "with"), vector=tuple(QUERY_VECTOR), domains=("en", "fr"), worlds=("north", "south"), intent="relation", emotion=(0.7, 0.4, 0.3), at=REF, vector_floor=0.2, results=14, tokens=16_000)
SQL_TOKENS = "CAST(trunc(1.3::DOUBLE * len(regexp_extract_all(content, '[a-zA-Z]+')) + 0.05::DOUBLE * length(content)) AS INTEGER)"
SQL_SEEN = "SELECT DISTINCT event_id AS id FROM events WHERE user_id = 7"


def _sql_share(text: str) -> str:
    return "(" + " + ".join(f"regexp_matches(lower({text}), '{recall.word_pattern(w)}')::INT" for w in ASK.words) + f") / {float(len(ASK.words))}::DOUBLE"


def _sql_bands(name: str, rows: str, width: float) -> str:
    """CTEs that end in ``name`` (id, band, pos) of ``rows`` (id, rel, tie)."""
    return f"""{name}_o AS (SELECT rel, row_number() OVER (ORDER BY rel DESC) AS rn FROM (SELECT DISTINCT rel FROM {rows})),
{name}_b AS (SELECT rn, rel AS leader, 0 AS band FROM {name}_o WHERE rn = 1 UNION ALL SELECT o.rn, CASE WHEN b.leader - o.rel <= {width} THEN b.leader ELSE o.rel END, CASE WHEN b.leader - o.rel <= {width} THEN b.band ELSE b.band + 1 END FROM {name}_b b JOIN {name}_o o ON o.rn = b.rn + 1),
{name} AS (SELECT id, rel, tie, band, row_number() OVER (ORDER BY band, tie DESC, rel DESC, id) AS pos FROM {rows} JOIN {name}_o USING (rel) JOIN {name}_b USING (rn))"""


def _sql_fill(name: str, rows: str, before: list[str], most: int) -> str:
    """CTE of the rows (id, via, rel, pos) that a channel adds after those ``before``."""
    prior = " UNION ALL ".join(f"SELECT id, fp, tokens FROM {b}" for b in before)
    return f"""{name} AS (
  SELECT * EXCLUDE (total) FROM (
    SELECT *, sum(tokens) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS total FROM (
      SELECT x.*, t.fp, t.tokens FROM {rows} x JOIN t USING (id)
      WHERE x.id NOT IN (SELECT id FROM ({prior})) AND (t.fp IS NULL OR t.fp NOT IN (SELECT fp FROM ({prior}) WHERE fp IS NOT NULL))
      QUALIFY t.fp IS NULL OR row_number() OVER (PARTITION BY t.fp ORDER BY pos) = 1
    )
  ) WHERE total + (SELECT coalesce(sum(tokens), 0) FROM ({prior})) <= {ASK.tokens}
  ORDER BY pos LIMIT (SELECT least({most}, greatest(0, {ASK.results} - count(*))) FROM ({prior}))
)"""


SQL_SEARCH = f"""WITH seen AS ({SQL_SEEN}),
base AS MATERIALIZED (
  SELECT *, round(greatest({_sql_share("concat_ws(' ', name, array_to_string(tags, ' '))")}, {recall.CONTENT}::DOUBLE * {_sql_share('content')}), 6) AS topic,
    round(CASE WHEN resolved THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END * ((2.0::DOUBLE * greatest(0.0, 1 - sqrt(power(valence - 0.7, 2) + power(arousal - 0.4, 2)) / 1.414) + 2.5::DOUBLE * exp(-0.1 * {_sql_age('last_active')}) + importance / 10.0::DOUBLE) / 5.5 * 100), 4) AS sec
  FROM memories WHERE lower(domain[1]) IN ('en', 'fr') AND world IN ('shared', 'north', 'south')
), kw AS (SELECT id, round(topic * 100, 2) AS rel, sec AS tie FROM base),
{_sql_bands('kb', 'kw', DEFAULTS.tie_band)},
ve AS (SELECT id, row_number() OVER (ORDER BY sim DESC, id) AS rank FROM (SELECT id, round(list_cosine_similarity(vec, {SQL_QUERY}), 6) AS sim FROM vectors WHERE id IN (SELECT id FROM base)) WHERE sim > 0.2 QUALIFY rank <= 68),
en AS (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM base WHERE lower(thread) IN ('src3', 'the', 'and', 'with') AND length(content) = n_chars QUALIFY rank <= 20),
ch AS (SELECT 0 AS c, 0.9::DOUBLE AS w, pos AS rank, id FROM kb WHERE pos <= 50 UNION ALL SELECT 1, 1.2::DOUBLE, rank, id FROM ve UNION ALL SELECT 2, 1.0::DOUBLE, rank, id FROM en),
fu AS (SELECT id, round(sum(w / (60 + rank)) * 1000, 6) AS rel, min(rank) FILTER (c = 0) AS keyword, min(rank) FILTER (c = 1) AS vector, min(rank) FILTER (c = 2) AS entity FROM ch GROUP BY id),
po AS MATERIALIZED (SELECT fu.*, b.* EXCLUDE (id) FROM fu JOIN base b USING (id) WHERE topic * 100 >= 40 OR entity IS NOT NULL OR vector IS NOT NULL ORDER BY rel DESC, id LIMIT 20),
de AS (SELECT *, exp(-0.693 * {_sql_age('event_at')} / greatest(0.001, 14.0 * (1 + 0.5 * log2((1 + activation)::DOUBLE)))) AS raw FROM po),
ti AS (SELECT id, rel, round(rel * (0.6::DOUBLE + 0.4::DOUBLE * CASE WHEN type IN ('permanent', 'feel') THEN 1.0 WHEN resolved THEN raw ELSE greatest(raw, 0.25) END) * CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.source = de.id AND e.target <> e.source) THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END, 6) AS tie FROM de),
{_sql_bands('rb', 'ti', ASK.band)},
t AS MATERIALIZED (SELECT id, CASE WHEN length(k) >= 8 THEN k END AS fp, tokens FROM (SELECT id, regexp_replace(lower(content), '[^a-z0-9]+', '', 'g') AS k, {SQL_TOKENS} AS tokens FROM base)),
ma AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY band, tie DESC, rel DESC, id) AS pos FROM (
    SELECT rb.id, rb.rel, rb.tie, rb.band, fp, tokens FROM rb JOIN t USING (id) QUALIFY row_number() OVER (PARTITION BY coalesce(fp, 'id:' || rb.id) ORDER BY rb.pos) = 1
  ) WHERE id NOT IN (SELECT id FROM seen)
),
both_ways AS (SELECT source AS a, target AS b, type, strength FROM edges UNION ALL SELECT target, source, type, strength FROM edges),
st AS MATERIALIZED (SELECT id, s.via AS via, NULL::DOUBLE AS rel, row_number() OVER (ORDER BY s.place, id) AS pos FROM (
  SELECT w.b AS id, min(struct_pack(place := ma.pos, via := ma.id)) AS s FROM both_ways w JOIN ma ON ma.id = w.a
  WHERE w.type = 'updates' AND w.a <> w.b AND w.b IN (SELECT id FROM base) AND w.b NOT IN (SELECT id FROM ma) AND w.b NOT IN (SELECT id FROM seen) GROUP BY w.b) QUALIFY pos <= 2),
le AS (SELECT * FROM ma WHERE pos <= greatest(1, {ASK.results - 1} - (SELECT count(*) FROM st))),
wi AS (SELECT id, lag(id) OVER o AS p, lead(id) OVER o AS n FROM base WINDOW o AS (PARTITION BY thread ORDER BY event_at, id)),
tl AS MATERIALIZED (SELECT s.id, le.id AS via, NULL::DOUBLE AS rel, row_number() OVER (ORDER BY le.pos, s.side, s.id) AS pos FROM le JOIN (SELECT id AS own, 0 AS side, p AS id FROM wi UNION ALL SELECT id, 1, n FROM wi) s ON s.own = le.id
  WHERE s.id IS NOT NULL AND s.id NOT IN (SELECT id FROM le) AND s.id NOT IN (SELECT id FROM st) AND s.id NOT IN (SELECT id FROM seen) QUALIFY pos <= 1),
mi AS (SELECT id, NULL::BIGINT AS via, rel, pos FROM ma WHERE pos <= CASE WHEN EXISTS (SELECT 1 FROM tl) THEN greatest(1, {ASK.results - 1} - (SELECT count(*) FROM st)) ELSE {ASK.results} - (SELECT count(*) FROM st) END),
nothing AS (SELECT NULL::BIGINT AS id, NULL::VARCHAR AS fp, 0 AS tokens WHERE false),
{_sql_fill('f0', 'mi', ['nothing'], ASK.results)},
{_sql_fill('f1', 'tl', ['f0'], 1)},
{_sql_fill('f2', 'st', ['f0', 'f1'], ASK.states)},
ok AS (SELECT id FROM base WHERE id NOT IN (SELECT id FROM seen)),
re AS MATERIALIZED (SELECT id, via, rel, row_number() OVER (ORDER BY rel DESC, id) AS pos FROM (
  SELECT b AS id, a AS via, round(strength * CASE type WHEN 'kin' THEN 1.0::DOUBLE WHEN 'explains' THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END, 6) AS rel FROM both_ways
  WHERE a IN (SELECT id FROM f0) AND b NOT IN (SELECT id FROM f0) AND a IN (SELECT id FROM ok) AND b IN (SELECT id FROM ok) AND a <> b AND strength BETWEEN 0.4 AND 1.0 QUALIFY row_number() OVER (PARTITION BY b ORDER BY rel DESC, via, type) = 1) QUALIFY pos <= 8 + (SELECT count(*) FROM f0)),
{_sql_fill('f3', 're', ['f0', 'f1', 'f2'], 8)},
em AS MATERIALIZED (SELECT id, NULL::BIGINT AS via, rel, row_number() OVER (ORDER BY rel DESC, id) AS pos FROM (
  SELECT id, round((0.8::DOUBLE * greatest(0.0, 1 - sqrt(power((0.4 - (valence * 2 - 1)) / 2, 2) + power(0.4 - arousal, 2)) / sqrt(2.0::DOUBLE)) + 0.2::DOUBLE * greatest(0.0, 1 - abs(0.3 - arousal))) * importance / 10.0::DOUBLE, 6) AS rel FROM ok WHERE id NOT IN (SELECT id FROM ma)
) WHERE rel >= 0.6),
{_sql_fill('f4', 'em', ['f0', 'f1', 'f2', 'f3'], ASK.emotions)},
al AS (SELECT 0 AS c, 'main' AS channel, id, via, rel, pos FROM f0 UNION ALL SELECT 1, 'timeline', id, via, rel, pos FROM f1 UNION ALL SELECT 2, 'state', id, via, rel, pos FROM f2 UNION ALL SELECT 3, 'relation', id, via, rel, pos FROM f3 UNION ALL SELECT 4, 'emotion', id, via, rel, pos FROM f4)
SELECT CAST(row_number() OVER (ORDER BY c, al.pos) AS INTEGER) AS pos, channel, al.id, via, al.rel, CASE WHEN c = 0 THEN CAST(keyword AS INTEGER) END AS keyword, CASE WHEN c = 0 THEN CAST(vector AS INTEGER) END AS vector, CASE WHEN c = 0 THEN CAST(entity AS INTEGER) END AS entity
FROM al LEFT JOIN fu ON fu.id = al.id"""
SQL_SEARCH = SQL_SEARCH.replace("FROM ok WHERE id NOT IN (SELECT id FROM ma)", "FROM base WHERE id IN (SELECT id FROM ok) AND id NOT IN (SELECT id FROM ma)")


def _links(spark, d):
    """Records tied to their thread's name; the digest is current where the stored length is."""
    m = V.memories(spark, d)
    return m.select("id", F.col("thread").alias("entity"), F.when(F.length("content") == F.col("n_chars"), F.md5("content")).alias("digest"))


def _seen(spark, d):
    return V.read(spark, d, "events").filter("user_id = 7").select(F.col("event_id").alias("id")).distinct()


@query("q01_search", SQL_SEARCH, ("memories", "vectors", "edges"))
def q01_search(spark, d):
    """Search with keyword, vector, entity, state, timeline, relation and emotion channels."""
    return recall.search(V.memories(spark, d), V.vectors(spark, d), V.edges(spark, d), _links(spark, d), _seen(spark, d), ASK)


@query("q01_surfacing", f"""WITH seen AS ({SQL_SEEN}), act AS ({SQL_ACTIVITY}),
pin AS (SELECT id, {SQL_TOKENS} AS tokens FROM memories WHERE pinned OR protected),
op AS (SELECT m.id, act.score FROM memories m JOIN act USING (id) WHERE NOT pinned AND NOT protected AND NOT resolved AND type NOT IN ('permanent', 'feel') AND world IN ('shared', 'north', 'south') AND id NOT IN (SELECT id FROM seen) ORDER BY score DESC, id LIMIT 20),
sh AS (SELECT id, score, row_number() OVER (ORDER BY CASE WHEN rn = 1 THEN '' ELSE md5(id::VARCHAR) END) AS pos FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rn FROM op) QUALIFY pos <= 8),
us AS (SELECT sh.*, sum({SQL_TOKENS}) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM sh JOIN memories USING (id))
SELECT 'pinned' AS channel, 0 AS place, id, 999.0::DOUBLE AS score FROM pin UNION ALL SELECT 'dynamic', CAST(pos AS INTEGER), id, score FROM us WHERE used + (SELECT coalesce(sum(tokens), 0) FROM pin) <= 1000000""", ("memories",))
def q01_surfacing(spark, d):
    """Surfacing without a query: core records, then unresolved ones within the tokens that are left."""
    return recall.surfacing(V.memories(spark, d), _seen(spark, d), recall.Ask(worlds=("north", "south"), at=REF, tokens=1_000_000))


@query("q01_feelings", f"SELECT CAST(pos AS INTEGER) AS pos, id, CAST(used AS BIGINT) AS used FROM (SELECT id, row_number() OVER (ORDER BY event_at DESC, id) AS pos, sum(tok) OVER (ORDER BY event_at DESC, id ROWS UNBOUNDED PRECEDING) AS used, tok FROM (SELECT id, event_at, greatest({SQL_TOKENS}, 1) AS tok FROM memories WHERE type = 'feel' AND event_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-28 00:00:00')) WHERE used - tok <= 6000", ("memories",))
def q01_feelings(spark, d):
    """The feel records of some weeks, newest first, up to the token budget."""
    return recall.feelings(V.memories(spark, d), recall.Ask(after="2024-01-05 00:00:00", before="2024-01-28 00:00:00"))


# --- conflict pairs under any shared key (J04, X11) ---------------------------------

SQL_NUMBER = r"(?i)(?:^|[^\w.])(\d+(?:\.\d+)?\s*(?:kg|g|mg|ml|cm|mm|km|斤|克|毫克|毫升|天|次|小时|分钟|分|度|℃|%|元|块|h|m))\b"


def _sql_quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query("j04_conflict_pairs", f"""WITH p AS MATERIALIZED (
  SELECT id, ['name:' || regexp_replace(lower(name), '\\s+', '', 'g'), 'domain:' || domain[1]] AS keys, regexp_replace(regexp_replace(content, '\\[\\[[^\\]|]+\\|([^\\]]+)\\]\\]', '\\1', 'g'), '\\[\\[([^\\]|]+)\\]\\]', '\\1', 'g') AS t
  FROM memories WHERE NOT resolved AND NOT pinned AND NOT protected AND type = 'dynamic' AND content <> ''
), s AS MATERIALIZED (
  SELECT id, keys, list_sort(list_distinct(list_transform(regexp_extract_all(t, {_sql_quoted(R.DATE)}), lambda x: trim(x)))) AS dates, regexp_matches(t, {_sql_quoted(R.NEGATION)}) AS neg,
    list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(t, {_sql_quoted(R.DATE)}, ' ', 'g'), {_sql_quoted(SQL_NUMBER)}, 1), lambda x: trim(x)))) AS numbers,
    regexp_extract_all(t, {_sql_quoted(R.KEY_VALUE)}, 1) AS k, regexp_extract_all(t, {_sql_quoted(R.KEY_VALUE)}, 2) AS v
  FROM p
), kv AS MATERIALIZED (SELECT id, k, v FROM (SELECT id, lower(trim(k[i])) AS k, left(trim(v[i]), 180) AS v, i FROM (SELECT id, k, v, unnest(range(1, len(k) + 1)) AS i FROM s)) QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY i DESC) = 1),
pr AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.dates AS da, b.dates AS db, a.numbers AS na, b.numbers AS nb, a.neg AS ga, b.neg AS gb FROM s a JOIN s b ON a.id < b.id AND len(list_intersect(a.keys, b.keys)) > 0),
f AS (
  SELECT pr.a, pr.b, x.k AS field FROM pr JOIN kv x ON x.id = pr.a JOIN kv y ON y.id = pr.b AND y.k = x.k AND y.v <> x.v
  UNION SELECT a, b, 'date' FROM pr WHERE len(da) > 0 AND len(db) > 0 AND da <> db
  UNION SELECT a, b, 'number' FROM pr WHERE len(na) > 0 AND len(nb) > 0 AND na <> nb
  UNION SELECT a, b, 'negation' FROM pr WHERE ga <> gb
)
SELECT a, b, string_agg(field, ',' ORDER BY field) AS fields FROM f GROUP BY a, b ORDER BY a, b LIMIT 500""", ("memories",))
def j04(spark, d):
    """The first five hundred conflicting pairs of open, unprotected records that share a name or a domain."""
    m = V.memories(spark, d)
    live = m.filter(~F.col("resolved") & ~R.slot_exempt(F.col("pinned"), F.col("protected"), F.col("type"), F.col("domain")) & (F.col("content") != ""))
    return facts.conflict_pairs(live.select("id", "name", "domain", "content"), 500)


# --- nearest records by their best pair of segments (K02, Q05, M19) -------------------

SQL_SEGMENTS = "SELECT id, k, vec[k * 16 + 1 : k * 16 + 16] AS seg FROM vectors, range(4) r(k)"


@query("q05_segment_neighbours", f"""WITH s AS ({SQL_SEGMENTS}), q AS (SELECT s.* FROM s JOIN memories m USING (id) WHERE m.event_at >= TIMESTAMP '2024-01-20 00:00:00'),
x AS (SELECT q.id AS query, s.id AS id, max(round(list_cosine_similarity(q.seg, s.seg), 9)) AS sim FROM q JOIN s ON q.id <> s.id GROUP BY 1, 2)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS INTEGER) AS rank, id, round(sim, 6) AS sim FROM x WHERE sim > 0.5 QUALIFY rank <= 8""", ("memories", "vectors"))
def q05_segments(spark, d):
    """The eight stored records nearest to each record of the newest days, which all ask at once."""
    cut = F.expr("transform(sequence(0, 3), i -> slice(vec, i * 16 + 1, 16))")
    v = V.vectors(spark, d).select("id", cut.alias("segments"))
    new = V.memories(spark, d).filter(F.col("event_at") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("id")
    return VS.segment_neighbours(v, v.join(new, "id", "left_semi"), 8, DEFAULTS.vector_floor)
