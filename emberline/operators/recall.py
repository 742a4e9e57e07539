"""Recall: three modes over one eligible set, with the channel that found each row.

``search`` scans the records' texts once, for the eligible rows' scores, and writes what the channels
need, without texts, to the shared folder. Keyword, vector and entity channels are fused by rank,
gated by evidence, decayed, reordered in bands and freed of repeated contents and of rows that the session saw. Beside
the main rows stand rows of the state, timeline, relation and emotion channels, each
without what is shown already. From the fusion on every frame is a page with a bound; the texts of a
page's rows are looked up by id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..functions import scoring as S
from ..functions import text as X
from ..session import shared_folder
from . import graph, ranking

#: Weight of a query word in the content beside one in name or tags.
CONTENT = 0.8


@dataclass(frozen=True)
class Ask:
    """What is asked for; the defaults are those of a plain search."""

    words: tuple[str, ...] = ()
    vector: tuple[float, ...] = ()
    domains: tuple[str, ...] | None = None
    worlds: tuple[str, ...] | None = None
    after: str | None = None
    before: str | None = None
    intent: str = "default"
    emotion: tuple[float, float, float] | None = None
    at: str = ""
    results: int = 8
    tokens: int = 6000
    pool: int = 20
    base_pool: int = 50
    depth: int = 1
    vector_floor: float = DEFAULTS.vector_floor
    literal_floor: float = DEFAULTS.relevance_floor
    band: float = 0.35
    entities: int = 20
    states: int = 2
    emotions: int = 2
    resonance: float = 0.6
    kinds: tuple[str, ...] = ("kin", "explains", "causes", "contributes", "improves", "updates")


def word_pattern(word: str) -> str:
    """A whole word of letters and digits, for engines with and without look-around."""
    return f"(^|[^\\p{{L}}\\p{{N}}]){word}([^\\p{{L}}\\p{{N}}]|$)"


def topic(words: tuple[str, ...], name: Column, tags: Column, content: Column) -> Column:
    """Share of the words in name or tags, or CONTENT of their share in the content if that is more."""
    if not words:
        return F.lit(0.0)
    in_ = lambda text, w: F.coalesce(F.lower(text).rlike(word_pattern(w)), F.lit(False)).cast("int")
    label = F.concat_ws(" ", name, tags)
    share = lambda text: sum((in_(text, w) for w in words[1:]), in_(text, words[0])) / F.lit(float(len(words)))
    return F.round(F.greatest(share(label), CONTENT * share(content)), 6)


def eligible(records: DataFrame, ask: Ask) -> DataFrame:
    """Live records of the asked worlds, domains and times; records of unknown time stay."""
    ok = ~F.coalesce(F.col("type").isin("archived", "nsfw"), F.lit(False))
    if ask.domains is not None:
        ok &= F.arrays_overlap(F.transform("domain", F.lower), F.array(*[F.lit(x.lower()) for x in ask.domains]))
    if ask.worlds is not None:
        ok &= F.coalesce(F.col("world"), F.lit("")).isin(DEFAULTS.universal_world, *(ask.worlds or ("",)))
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    if ask.after is not None:
        ok &= F.coalesce(F.col("event_at") >= at(ask.after), F.lit(True))
    if ask.before is not None:
        ok &= F.coalesce(F.col("event_at") <= at(ask.before), F.lit(True))
    return records.filter(ok)


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _texts(records: DataFrame, page: DataFrame) -> DataFrame:
    """id, fp, tokens of a page's rows (their ids are a bounded list in the scan's filter)."""
    ids = [r.id for r in page.select("id").distinct().collect()]
    return records.filter(F.col("id").isin(ids)).select("id", X.fingerprint(F.col("content")).alias("fp"), S.token_estimate(F.coalesce("content", F.lit(""))).alias("tokens"))


def _numbered(page: DataFrame, *order) -> DataFrame:
    return page.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def search(records: DataFrame, vectors: DataFrame, edges: DataFrame, links: DataFrame, seen: DataFrame, ask: Ask, p: Params = DEFAULTS) -> DataFrame:
    """(pos, channel, id, via, rel, keyword, vector, entity): the answer in its order.

    ``links`` (id, entity, digest) ties records to entity names; a link counts while its digest is that of the content.
    ``seen`` (id) are rows that the session has shown. ``keyword``, ``vector`` and ``entity`` are the
    ranks by which a main row was found; ``via`` is the main row that a side row hangs on. Of each channel the first row
    that would pass the token budget ends it. Null names, tags, contents and times count as without words, vector or age.
    """
    spark = records.sparkSession
    age = lambda c: S.days_between(F.lit(ask.at).cast("timestamp_ntz"), F.col(c))
    qv, qa, _ = ask.emotion or (None, None, None)
    secondary = (p.emotion * S.emotion_score(F.col("valence"), F.col("arousal"), qv, qa) + p.time * S.time_score(age("last_active")) + p.importance * S.clamp(F.col("importance"), 1, 10) / 10) / (p.emotion + p.time + p.importance) * 100
    current = F.md5(F.coalesce("content", F.lit("")))
    base = _kept(
        eligible(records, ask).select(
            "id", "thread", "type", "resolved", "activation", "event_at", "importance", "valence", "arousal", F.array_union("domain", "tags").alias("terms"), current.alias("digest"),
            topic(ask.words, F.col("name"), F.col("tags"), F.col("content")).alias("topic"), F.round(F.when(F.col("resolved"), 0.3).otherwise(1.0) * secondary, 4).alias("tie"),
        ), "recall-eligible",
    )
    kind = F.lit(ask.intent)
    scaled, weights = [float(x) for x in S.POLICIES.get(ask.intent, S.DEFAULT_POLICY)[:2]], S.POLICIES.get(ask.intent, S.DEFAULT_POLICY)[2:4]
    pools = [-(-round(ask.base_pool * x, 6) // 1) for x in scaled]
    related = int(S.POLICIES.get(ask.intent, S.DEFAULT_POLICY)[4])

    # the three channels, each a page
    by_word = ranking.band_rank(base.select("id", F.round(F.col("topic") * 100, 2).alias("rel"), "tie"), p.tie_band, int(pools[0])).select("id", F.col("pos").alias("rank"))
    target = F.array(*[F.lit(float(x)) for x in ask.vector])
    near = vectors.join(base.select("id"), "id", "left_semi").select("id", F.round(S.cosine(F.col("vec"), target), 6).alias("sim")).filter(F.col("sim") > ask.vector_floor)
    by_vector = _numbered(near.orderBy(F.desc("sim"), "id").limit(int(pools[1])), F.desc("sim"), "id").withColumnRenamed("pos", "rank")
    named = links.filter(F.lower("entity").isin([w.lower() for w in ask.words])).join(base.select("id", "digest"), ["id", "digest"], "left_semi")
    by_entity = _numbered(named.select("id").distinct().orderBy("id").limit(ask.entities), "id").withColumnRenamed("pos", "rank")
    channel = lambda k, w, df: df.select(F.lit(k).alias("channel"), F.lit(float(w)).alias("weight"), "rank", "id")
    found = _kept(channel(0, weights[0], by_word).unionByName(channel(1, weights[1], by_vector)).unionByName(channel(2, 1.0, by_entity)), "recall-channels")
    ranks = found.groupBy("id").agg(*[F.min(F.when(F.col("channel") == k, F.col("rank"))).alias(n) for k, n in enumerate(("keyword", "vector", "entity"))])
    fused = ranking.rrf(found, p.rrf_k).join(ranks, "id").join(base, "id")

    # evidence, then a page in bands
    supported = (F.col("topic") * 100 >= ask.literal_floor) | F.col("entity").isNotNull() | F.col("vector").isNotNull()
    pool = fused.withColumn("rel", F.round(F.col("score") * 1000, 6)).filter(supported).orderBy(F.desc("rel"), "id").limit(ask.pool)
    decay = S.retrieval_decay(age("event_at"), F.col("activation"), F.col("resolved"), F.coalesce(F.col("type").isin("permanent", "feel"), F.lit(False)), p)
    degree = edges.filter(F.col("source") != F.col("target")).select(F.col("source").alias("id"))
    pool = _kept(pool.drop("tie"), "recall-pool")
    n_edges = degree.join(F.broadcast(pool.select("id")), "id").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    boosted = pool.join(n_edges, "id", "left").withColumn("tie", F.round(S.blend_decay(F.col("rel"), decay, p) * S.intent_boost(kind, F.coalesce("n", F.lit(0)), F.col("terms"), age("event_at")), 6))
    ranked = ranking.band_rank(boosted.select("id", "rel", "tie"), ask.band).join(_texts(records, pool), "id").join(ranks, "id")
    kept = ranking.first_by(ranked.withColumn("k", F.coalesce("fp", F.concat(F.lit("id:"), F.col("id").cast("string")))), ["k"], [F.col("pos")]).drop("k")
    matches = _kept(_numbered(kept.join(seen.select("id").distinct(), "id", "left_anti").drop("pos"), "band", F.desc("tie"), F.desc("rel"), "id"), "recall-matches")

    # side channels; each leaves out what is shown or seen
    shown = matches.select("id").unionByName(seen.select("id")).distinct()
    seeds = matches.select(F.col("id").alias("via"), F.col("pos").alias("at"))
    free = lambda df: df.join(shown, "id", "left_anti").join(base.select("id"), "id", "left_semi")
    update = graph.both_ways(edges.filter((F.col("type") == "updates") & (F.col("source") != F.col("target")))).select(F.col("a").alias("via"), F.col("b").alias("id"))
    state = free(update.join(F.broadcast(seeds), "via")).groupBy("id").agg(F.min(F.struct("at", "via")).alias("s")).select("id", "s.*")
    state = _kept(state.orderBy("at", "id").limit(min(ask.states, max(0, ask.results - 1))), "recall-state")
    n_state = state.count()  # a page
    first = max(1, ask.results - n_state - 1)
    lead = matches.filter(F.col("pos") <= first)
    here = lead.select(F.col("id").alias("via"), F.col("pos").alias("at")).join(base.select(F.col("id").alias("via"), "thread", F.struct("event_at", F.col("id")).alias("mine")), "via")
    beside = base.select("thread", F.struct("event_at", "id").alias("other")).filter("other.event_at is not null").join(F.broadcast(here), "thread")
    ends = beside.groupBy("via", "at").agg(F.max(F.when(F.col("other") < F.col("mine"), F.col("other"))).alias("p"), F.min(F.when(F.col("other") > F.col("mine"), F.col("other"))).alias("n"))
    sides = ends.select("via", "at", F.posexplode(F.array("p", "n")).alias("side", "o")).filter("o is not null").select("via", "at", "side", "o.id")
    taken = lead.select("id").unionByName(state.select("id")).unionByName(seen.select("id")).distinct()
    timeline = _kept(sides.join(taken, "id", "left_anti").orderBy("at", "side", "id").limit(1), "recall-timeline")
    main = lead if timeline.count() else matches.filter(F.col("pos") <= ask.results - n_state)  # a row at most

    columns = ("id", "via", "rel", "tokens", "fp", "keyword", "vector", "entity", "pos")
    blank = {"via": "long", "rel": "double", "keyword": "int", "vector": "int", "entity": "int"}
    shape = lambda df: df.withColumns({c: F.lit(None).cast(t) for c, t in blank.items() if c not in df.columns}).select(*columns)
    out: list[DataFrame] = []
    used, n, prints, ids = 0, 0, set(), set()

    def fill(name: str, page: DataFrame, most: int) -> None:
        """Take the rows of a page up to the first that passes the budget; bounded, so on the driver."""
        nonlocal used, n
        rows = []
        for r in page.orderBy("pos").collect():
            if len(rows) >= most or n >= ask.results or used >= ask.tokens:
                break
            if r.id in ids or (name != "main" and r.fp is not None and r.fp in prints):
                continue
            if used + r.tokens > ask.tokens:
                break
            used, n = used + r.tokens, n + 1
            prints.add(r.fp)
            ids.add(r.id)
            rows.append((n, name, r.id, r.via, r.rel, r.keyword, r.vector, r.entity))
        out.append(spark.createDataFrame(rows, "pos int, channel string, id long, via long, rel double, keyword int, vector int, entity int"))

    with_text = lambda df: shape(df.join(_texts(records, df), "id"))
    fill("main", shape(main), ask.results)
    told = spark.createDataFrame([(i,) for i in ids], "id long")
    fill("timeline", with_text(_numbered(timeline, "at", "side")), 1)
    fill("state", with_text(_numbered(state, "at", "id")), ask.states)
    if ask.depth and n < ask.results and not told.isEmpty():
        away = graph.expand(edges, base.join(seen.select("id").distinct(), "id", "left_anti"), told, list(ask.kinds), related + len(ids), p, ask.depth)
        fill("relation", with_text(_numbered(away.select("id", "via", F.col("score").alias("rel")), F.desc("rel"), "id")), related)
    if ask.emotion and n < ask.results:
        v, a, t = ask.emotion
        near = S.resonance(F.col("valence") * 2 - 1, F.col("arousal"), F.col("arousal"), F.col("importance") / 10, v * 2 - 1, a, t)
        felt = base.select("id", near.alias("rel")).filter(F.col("rel") >= ask.resonance).join(shown, "id", "left_anti").filter(~F.col("id").isin(list(ids))).orderBy(F.desc("rel"), "id").limit(ask.emotions + len(ids))
        fill("emotion", with_text(_numbered(felt, F.desc("rel"), "id")), ask.emotions)
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


def surfacing(records: DataFrame, seen: DataFrame, ask: Ask, p: Params = DEFAULTS) -> DataFrame:
    """(pos, channel, id, score): pinned rows first, then unresolved ones by activity within the tokens that are left.

    Pinned and protected rows always come, whatever world or time; the others pass the filters and the session. Of the
    pool the first row stays, the next nineteen are shuffled by a hash; the first row over the budget ends it.
    """
    live = records.filter(~F.coalesce(F.col("type").isin("archived", "nsfw"), F.lit(False)))
    core = F.coalesce(F.col("pinned") | F.col("protected"), F.lit(False))
    days = S.days_between(F.lit(ask.at).cast("timestamp_ntz"), F.col("last_active"))
    score = S.activity_score(F.col("importance"), F.col("activation"), F.col("arousal"), days, F.col("resolved"), F.col("digested"), F.lit(False), F.lit(False), F.col("type"), p)
    tokens = S.token_estimate(F.coalesce("content", F.lit("")))
    pinned = live.filter(core).select("id", tokens.alias("tokens"), F.lit(999.0).alias("score"))
    spent = pinned.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("spent"), F.count(F.lit(1)).alias("n_pinned"))
    open_ = eligible(live, ask).filter(~core & ~F.coalesce(F.col("resolved"), F.lit(False)) & ~F.col("type").isin("permanent", "feel")).join(seen.select("id").distinct(), "id", "left_anti")
    pool = open_.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(ask.pool)
    pool = _numbered(pool, F.desc("score"), "id").withColumn("order", F.when(F.col("pos") == 1, F.lit("")).otherwise(F.md5(F.col("id").cast("string"))))
    page = _kept(_numbered(pool.drop("pos"), "order").filter(F.col("pos") <= ask.results), "recall-surfacing")
    told = page.join(_texts(records, page).select("id", "tokens"), "id")
    run = told.withColumn("used", F.sum("tokens").over(Window.orderBy("pos")))
    shown = run.crossJoin(spent).filter(F.col("used") + F.col("spent") <= ask.tokens)  # one row of sums
    core_rows = pinned.select(F.lit("pinned").alias("channel"), "id", "score", F.lit(0).alias("place"))
    return core_rows.unionByName(shown.select(F.lit("dynamic").alias("channel"), "id", "score", F.col("pos").alias("place"))).select("channel", "place", "id", "score")


def feelings(records: DataFrame, ask: Ask, p: Params = DEFAULTS) -> DataFrame:
    """(pos, id, used): feel records, newest first, up to and with the one that passes the token budget."""
    rows = eligible(records.filter("type = 'feel'"), Ask(after=ask.after, before=ask.before)).select("id", "event_at", F.greatest(S.token_estimate(F.coalesce("content", F.lit(""))), F.lit(1)).alias("tokens"))
    order = (F.desc_nulls_last("event_at"), F.col("id"))
    page = rows.orderBy(*order).limit(ask.tokens + 1)  # every row has a token at least
    w = Window.orderBy(*order)
    run = page.withColumn("pos", F.row_number().over(w)).withColumn("used", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.filter(F.col("used") - F.col("tokens") <= ask.tokens).select("pos", "id", "used")
