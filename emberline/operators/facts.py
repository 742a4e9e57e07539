"""Fact slots, merge rules and parsers of hooks' answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..functions import facts as R
from ..functions import text as X
from ..session import shared_folder

# Words that ask for a state of a fact.
HISTORICAL, CURRENT, TRANSITION = ("以前", "过去", "曾经", "previous", "before"), ("现在", "目前", "now", "current"), ("变化", "改成", "changed", "transition")


def world_filter(param: str | None, current: str, p: Params = DEFAULTS) -> Column:
    """``all`` keeps every world, a comma list its worlds, nothing the current one; the universal world always stays."""
    param = (param or "").strip()
    if param.lower() == "all":
        return F.lit(True)
    worlds = [w.strip() for w in param.split(",") if w.strip()] or [current.strip()]
    return F.col("world").isin(p.universal_world, *worlds)


def passes_merge(keyword: Column, vector: Column, p: Params = DEFAULTS) -> Column:
    return (F.coalesce(keyword, F.lit(0.0)) > p.merge_keyword) | (F.coalesce(vector, F.lit(0.0)) >= p.merge_vector)


def without_suppressed(rows: DataFrame, overlay: DataFrame, question: str) -> DataFrame:
    """``rows`` less those an active review (historical, current, status) hides; a question for history hides none."""
    if any(cue in question.strip().lower() for cue in R.HISTORY_CUES):
        return rows
    active = overlay.filter((F.col("status") == "active") & F.col("current").isNotNull()).select(F.col("historical").alias("id"))
    return rows.join(active, "id", "left_anti")


def applying(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """``facts`` with ``applies``: its key is registered and its record meets the slot's constraints."""
    spec = registry.select("fact_key", F.struct("domains", "types", "tags_any", "name_contains").alias("_spec"))
    met = facts.join(spec, "fact_key", "left")
    ok = R.context_matches(F.col("domain"), F.col("tags"), F.col("type"), F.col("name"), F.col("_spec"))
    return met.withColumn("applies", F.col("_spec").isNotNull() & F.coalesce(ok, F.lit(False))).drop("_spec")


def state_label() -> Column:
    """Status of a fact whose slot applies, else ``none``."""
    return F.when(F.col("applies"), F.lower(F.trim(F.coalesce("fact_status", F.lit("current"))))).otherwise("none")


def filter_slots(facts: DataFrame, registry: DataFrame, intent: str, keys: list[str]) -> DataFrame:
    """Historical facts of the asked slots go; other intents, or no slot, keep all."""
    if intent != "fact" or not keys:
        return facts
    hidden = F.col("applies") & F.col("fact_key").isin(keys) & (state_label() == "historical") & ~R.slot_exempt(F.col("pinned"), F.col("protected"), F.col("type"), F.col("domain"))
    return applying(facts, registry).filter(~F.coalesce(hidden, F.lit(False))).drop("applies")


def aliases(registry: DataFrame) -> DataFrame:
    """(fact_key, alias), the aliases trimmed and in lower case."""
    return registry.select("fact_key", F.explode("aliases").alias("alias")).select("fact_key", F.lower(F.trim("alias")).alias("alias")).filter("alias <> ''").distinct()


def mentions(questions: DataFrame, registry: DataFrame) -> DataFrame:
    """(question, alias, fact_key) of aliases that stand in a question as whole words and name one slot only."""
    known = aliases(registry)
    single = known.groupBy("alias").agg(F.min("fact_key").alias("fact_key"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    words = F.split(F.regexp_replace(F.lower("question"), r"[^\p{L}\p{N}]+", " "), " ")


    def runs_of(k: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, k), " "))

    runs = F.concat(runs_of(1), runs_of(2), runs_of(3))
    return questions.select("question", F.explode(F.array_distinct(runs)).alias("alias")).join(single, "alias").select("question", "alias", "fact_key")


def mentioned_slots(questions: DataFrame, registry: DataFrame) -> DataFrame:
    return mentions(questions, registry).select("question", "fact_key").distinct()


def for_question(facts: DataFrame, registry: DataFrame, question: str) -> DataFrame:
    """``facts`` as a question for the present may see them; one for history sees all.

    The question is one row; its slots come back to the driver, a handful of names.
    """
    if any(cue in question.lower() for cue in R.HISTORY_CUES):
        return facts
    one = facts.sparkSession.createDataFrame([(question,)], "question string")
    keys = [r.fact_key for r in mentioned_slots(one, registry).collect()]
    return filter_slots(facts, registry, "fact", keys)


def labelled(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, fact_key, value) of ``label: value`` lines whose label is registered; a label with two values in one text is dropped."""
    line = r"(?m)^[ \t]*([^:：=\n]{1,40}?)[ \t]*[:：=][ \t]*([^\n]+?)[ \t]*$"
    pairs = F.arrays_zip(F.regexp_extract_all("content", F.lit(line), F.lit(1)).alias("k"), F.regexp_extract_all("content", F.lit(line), F.lit(2)).alias("v"))
    found = rows.select("id", F.explode(pairs).alias("x")).select("id", F.lower("x.k").alias("alias"), F.col("x.v").alias("value")).join(aliases(registry), "alias")
    return found.groupBy("id", "fact_key").agg(F.min("value").alias("value"), F.max("value").alias("other")).filter("value = other").drop("other")


def state_view(question: Column) -> Column:
    """historical, current, transition (also both) or neutral."""
    low = F.lower(question)
    some = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    old, now, moved = some(HISTORICAL), some(CURRENT), some(TRANSITION)
    return F.when(moved | (old & now), "transition").when(old, "historical").when(now, "current").otherwise("neutral")


def aligned(page: DataFrame, view: str, order: list[Column]) -> DataFrame:
    """A page with ``place``: rows of the asked state first, each part in its order. ``page`` is one that a limit has cut."""
    wanted = {"current": F.col("fact_status") == "historical", "historical": F.col("fact_status") != "historical"}.get(view, F.lit(False))
    return page.withColumn("place", F.row_number().over(Window.orderBy(wanted.cast("int"), *order)))


def link_targets(status: Column, newer: Column, older: Column) -> Column:
    """Ids that a fact's state points to: a historical one to its successor, a current one to those it replaced."""
    none = F.array().cast("array<long>")
    return F.when(status == "historical", F.array(newer)).when(status == "current", older).otherwise(none)


def _unfenced(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def keep_indices(raw: Column, n: int) -> Column:
    """Indices below ``n`` of a JSON list or of its ``keep`` field. Null is a failed
    answer (no list, or no usable index in a list that has some); an empty list is an answer."""
    text = _unfenced(raw)
    found = F.coalesce(F.from_json(F.get_json_object(text, "$.keep"), "array<int>"), F.when(text.startswith("["), F.from_json(text, "array<int>")))
    good = F.filter(found, lambda i: i.isNotNull() & (i >= 0) & (i < n))
    return F.when((F.size(found) == 0) | (F.size(good) > 0), good)


def angles(raw: Column) -> Column:
    """A JSON list of words, else what commas and line breaks part."""
    text = _unfenced(raw)
    listed = F.filter(F.when(text.startswith("["), F.from_json(text, "array<string>")), lambda x: F.trim(x) != "")
    split = F.filter(F.transform(F.split(text, "[,，\n]"), lambda x: F.regexp_replace(x, "^[ \\-•\"'。]+|[ \\-•\"'。]+$", "")), lambda x: x != "")
    return F.coalesce(listed, split)


def navigator_summary(raw: Column, most: int, default: str) -> Column:
    """The summary of a JSON text, else its first core fact, else the first line that says something."""
    plain = X.strip_wikilinks(F.regexp_replace(raw, r"!\[[^\]]*\]\([^)]*\)", ""))
    json = raw.rlike(r"^\s*\{")
    field = lambda path: F.when(json, F.nullif(F.trim(F.get_json_object(raw, path)), F.lit("")))
    line = F.try_element_at(F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1))
    return F.substring(F.coalesce(field("$.summary"), field("$.core_facts[0]"), line, F.lit(default)), 1, most)


def memory_type(semantic: Column, tags: Column, kind: Column, known: list[str]) -> Column:
    """The named type, else the one tag that is a type, else the record's kind; null if tags name two."""
    official = F.array_intersect(F.transform(tags, lambda x: F.lower(F.trim(x))), F.array(*[F.lit(x) for x in known]))
    return F.when(semantic.isNotNull(), F.lower(F.trim(semantic))).when(F.size(official) == 1, F.element_at(official, 1)).when(F.size(official) == 0, F.lower(F.trim(kind)))


def thread_hint(raw: Column, prefixes: tuple[str, ...] = ("route:", "auto:", "session:"), most: int = 80) -> Column:
    """A thread's name; ``other`` for routes, opaque ids and slugs of machines."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    low = F.lower(text)
    routed = F.exists(F.array(*[F.lit(x) for x in prefixes]), lambda p: low.startswith(p))
    opaque = text.rlike(r"^[0-9a-fA-F]{16,}$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    slug = low.rlike(r"^[a-z0-9]+(?:[_-][a-z0-9]+){2,}$")
    return F.when((text == "") | routed | opaque | slug, "other").otherwise(F.substring(text, 1, most))


def as_list(raw: Column) -> Column:
    """A scalar as a list of one, a JSON list as it is, null as an empty list."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(raw.rlike(r"^\s*\["), F.from_json(raw, "array<string>")), F.when(raw.isNotNull(), F.array(raw)), none)


def segment_error(segment: Column, dimension: int) -> Column:
    """Why a vector segment is refused, null if it is good."""
    finite = F.forall(segment, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(segment.isNull() | (F.size(segment) != dimension), "dimension").when(~finite, "non-finite")


def extends(old: Column, new: Column) -> Column:
    """Whether ``new`` is ``old`` with more at its end."""
    return (F.size(new) > F.size(old)) & (F.slice(new, 1, F.greatest(F.size(old), F.lit(0))) == old)


def entity_mentions(given: Column, content: Column, most: int = 32) -> Column:
    """Mentions (mention, type) that stand in the text literally, are of a known type and
    name somebody; of equal ones, whatever their case, the first."""
    clean = F.transform(F.slice(given, 1, most), lambda x: F.struct(F.trim(x["mention"]).alias("mention"), F.lower(F.trim(x["type"])).alias("type")))
    vague = "某人|某地|某处|某项目|原文未指明|不详"
    ok = F.filter(clean, lambda x: x["type"].isin("person", "place", "project") & (F.length(x["mention"]).between(1, 80)) & F.contains(content, x["mention"]) & ~x["mention"].rlike(vague) & ~x["mention"].rlike(r"[\x00-\x1f]"))
    same = lambda a, b: (F.lower(a["mention"]) == F.lower(b["mention"])) & (a["type"] == b["type"])
    return F.filter(ok, lambda x, i: ~F.exists(F.slice(ok, 1, i), lambda y: same(x, y)))


def classified(body: Column, table: dict[str, list[str]], old: Column, least: int = 2, most: int = 2) -> Column:
    """The domains with most keyword hits, ``least`` at least, in the order of hits and then
    of the table; the old ones if none has."""
    low = F.lower(body)
    hits = lambda words: sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    scored = F.array(*[F.struct((-hits(words)).alias("n"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, words) in enumerate(table.items())])
    good = F.slice(F.array_sort(F.filter(scored, lambda x: x["n"] <= -least)), 1, most)
    return F.when(F.size(good) > 0, F.transform(good, lambda x: x["name"])).otherwise(old)


def slot_values(content: Column, pattern: str) -> Column:
    """Distinct values of a slot's pattern, trimmed and in lower case, sorted."""
    found = F.transform(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)), lambda x: F.lower(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x != "")))


def membership(labelled: Column, in_metadata: Column, name: Column, content: Column, pattern: str, head: int = 200) -> Column:
    """How a record belongs to a slot: by a label line, by its metadata, by a value in its name or
    the head of its text, or by its context alone."""
    start = F.lower(F.concat_ws("\n", name, F.substring(R.plain_links(content), 1, head)))
    leading = F.exists(slot_values(content, pattern), lambda v: F.contains(start, v))
    return F.when(labelled, "structured").when(in_metadata, "metadata").when(leading, "value").otherwise("context")


def block_keys(name: Column, domain: Column) -> Column:
    """Keys under which records are compared: the name without blanks in small letters, and each domain."""
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", "")
    domains = F.transform(F.filter(F.coalesce(domain, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), lambda x: F.concat(F.lit("domain:"), x))
    return F.array_distinct(F.concat(F.filter(F.array(F.concat(F.lit("name:"), plain)), lambda x: x != "name:"), domains))


def conflict_pairs(records: DataFrame, most: int = 50, page: int = 64) -> DataFrame:
    """(a, b, fields): the first ``most`` pairs a < b in the order of their ids that share a key and conflict.

    ``records`` is (id, name, domain, content). A record's keys and its signature are found once and stored without
    the text. Pairs are made under the least key that both have, so once. The order is walked in pages of left
    records, each eight times the last, against all records after them, until ``most`` pairs are found: a key that a
    third of all records share is only ever met by a page. Rows without id, and without keys, meet nothing.
    """
    spark = records.sparkSession
    folder = shared_folder(spark, "conflict-signatures")
    records.filter("id is not null").select("id", block_keys(F.col("name"), F.col("domain")).alias("keys"), R.signature(F.col("content"), re2=True).alias("sig")).write.parquet(folder)
    every = spark.read.parquet(folder)
    side = lambda df, x: df.select(F.col("id").alias(x), F.col("keys").alias(f"k{x}"), F.col("sig").alias(f"s{x}"), F.explode("keys").alias("key"))
    found, open_ = [], every
    while len(found) < most:
        left = open_.orderBy("id").limit(page)
        last = left.agg(F.max("id")).first()[0]
        if last is None:
            break
        here = open_.filter(F.col("id") <= last)
        met = side(every, "b").join(side(here, "a"), "key").filter((F.col("a") < F.col("b")) & (F.col("key") == F.array_min(F.array_intersect("ka", "kb"))))
        told = met.select("a", "b", R.conflicting(F.col("sa"), F.col("sb")).alias("c")).filter(F.size("c") > 0)
        fields = F.array_join(F.array_sort(F.array_distinct(F.transform("c", lambda x: x["field"]))), ",")
        found += [tuple(r) for r in told.select("a", "b", fields.alias("fields")).orderBy("a", "b").limit(most - len(found)).collect()]  # ``most`` rows
        open_, page = open_.filter(F.col("id") > last), page * 8
    return spark.createDataFrame(found, "a long, b long, fields string")


def slot_pairs(records: DataFrame, slots: dict[str, str], links: DataFrame, most: int = 200, page: int = 64) -> DataFrame:
    """(slot, current, historical, current_value, historical_value): newer and older records of a slot that disagree.

    ``records`` is (id, at, status, content), ``slots`` a pattern by name, ``links`` (newer, older) are pairs that are
    settled. A record is in a slot if its content has values of it; two disagree if neither all their values nor
    their first ones are equal. Historical and contested records, and those without time, make no pairs. The order is by slot, then
    newest first on both sides; it is walked in pages of newer records, each eight times the last, until ``most`` pairs are found.
    """
    spark = records.sparkSession
    folder = shared_folder(spark, "slot-members")
    held = F.array(*[F.struct(F.lit(name).alias("slot"), slot_values(F.col("content"), pattern).alias("values")) for name, pattern in sorted(slots.items())])
    open_ = ~F.lower(F.trim(F.coalesce("status", F.lit("")))).isin("historical", "contested")
    rows = records.filter(F.col("id").isNotNull() & F.col("at").isNotNull() & F.col("content").isNotNull() & open_)
    rows.select("id", "at", F.explode(held).alias("x")).select("x.slot", "id", "at", "x.values").filter(F.size("values") > 0).write.parquet(folder)
    members = spark.read.parquet(folder)
    key = (F.asc("slot"), F.desc("at"), F.desc("id"))
    settled = links.select(F.col("newer").alias("current"), F.col("older").alias("historical")).distinct()
    schema = f"slot string, current {members.schema['id'].dataType.simpleString()}, historical {members.schema['id'].dataType.simpleString()}, current_value string, historical_value string"
    older = members.select("slot", F.struct("at", "id").alias("old"), F.col("values").alias("old_values"))
    found, left = [], members
    while len(found) < most:
        here = left.orderBy(*key).limit(page)
        last = here.orderBy(F.desc("slot"), F.asc("at"), F.asc("id")).select("slot", "at", "id").limit(1).collect()
        if not last:
            break
        met = older.join(here.select("slot", F.struct("at", "id").alias("new"), F.col("values").alias("new_values")), "slot").filter(F.col("old") < F.col("new"))
        differ = met.filter((F.col("old_values") != F.col("new_values")) & (F.col("old_values")[0] != F.col("new_values")[0]))
        pairs = differ.withColumns({"current": F.col("new.id"), "historical": F.col("old.id")}).join(settled, ["current", "historical"], "left_anti")
        first = pairs.orderBy(F.asc("slot"), F.desc("new"), F.desc("old")).limit(most - len(found))
        found += [tuple(r) for r in first.select("slot", "current", "historical", F.col("new_values")[0].alias("a"), F.col("old_values")[0].alias("b")).collect()]  # ``most`` rows
        slot, at, i = last[0]
        after = (F.col("slot") > slot) | ((F.col("slot") == slot) & ((F.col("at") < F.lit(at)) | ((F.col("at") == F.lit(at)) & (F.col("id") < F.lit(i)))))
        left, page = left.filter(after), page * 8
    return spark.createDataFrame(found, schema)
