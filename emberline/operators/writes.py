"""Writes as frames: creating, merging, editing, archiving; state machines and queues.

Tables are immutable: each operator takes the stored rows and what comes in, and
gives the rows after the write or an outcome for each request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts as R


def created(rows: DataFrame, today: Column) -> DataFrame:
    """New records with their defaults: importance 5 (10 if pinned or protected) in 1..10,
    valence and arousal in 0..1, a domain, the day in the name and the tags unless there is one
    (feelings excepted), pinned ones permanent."""
    clamp = lambda c, low, high, default: F.least(F.greatest(F.coalesce(c, F.lit(default)), F.lit(low)), F.lit(high))
    day = F.date_format(today, "yyyy-MM-dd")
    feel = F.col("type") == "feel"
    dated = F.col("name").rlike(r"\d{4}-\d{2}-\d{2}")
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    tagged = F.exists(tags, lambda t: t.rlike(r"^\d{4}-\d{2}-\d{2}$"))
    held = F.col("pinned") | F.col("protected")
    return rows.select(
        "id",
        F.when(feel | dated, F.col("name")).otherwise(F.concat("name", F.lit("_"), day)).alias("name"),
        F.when(feel | tagged, tags).otherwise(F.array_append(tags, day)).alias("tags"),
        F.when(F.size(F.coalesce("domain", F.array().cast("array<string>"))) == 0, F.array(F.lit("unsorted"))).otherwise(F.col("domain")).alias("domain"),
        clamp(F.col("valence"), 0.0, 1.0, 0.5).alias("valence"),
        clamp(F.col("arousal"), 0.0, 1.0, 0.3).alias("arousal"),
        F.when(held, 10).otherwise(clamp(F.col("importance"), 1, 10, 5)).cast("int").alias("importance"),
        F.when(F.col("pinned"), "permanent").otherwise(F.coalesce("type", F.lit("dynamic"))).alias("type"),
        "content",
    )


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records with what was merged into them (id, tags, domain, importance, valence, arousal):
    lists united in their order, the greater importance, the mean of the scores at 2 digits.
    A row of ``new`` per id; records without one stay as they are."""
    n = new.select("id", *[F.col(c).alias(f"_{c}") for c in ("tags", "domain", "importance", "valence", "arousal")])
    met = old.join(n, "id", "left")
    hit = F.col("_importance").isNotNull()
    take = lambda c, x: F.when(hit, x).otherwise(F.col(c)).alias(c)
    return met.select(
        "id", take("tags", F.array_union("tags", "_tags")), take("domain", F.array_union("domain", "_domain")), take("importance", F.greatest("importance", "_importance")),
        take("valence", F.bround((F.col("valence") + F.col("_valence")) / 2, 2)), take("arousal", F.bround((F.col("arousal") + F.col("_arousal")) / 2, 2)), hit.alias("merged"),
    )


def merge_targets(incoming: DataFrame, candidates: DataFrame, keyword_floor: float, vector_floor: float) -> DataFrame:
    """(incoming, target): the best candidate that passes, by keyword score, then vector, then id;
    null where none does and the record is created. ``candidates`` has (incoming, id, keyword, vector, held)."""
    ok = candidates.filter(~F.col("held") & ((F.col("keyword") > keyword_floor) | (F.col("vector") >= vector_floor)))
    best = ok.groupBy("incoming").agg(F.max(F.struct("keyword", "vector", (-F.col("id")).alias("m"))).alias("x")).select("incoming", (-F.col("x.m")).alias("target"))
    return incoming.select("incoming").join(best, "incoming", "left")


def edited(rows: DataFrame, edits: DataFrame, columns: list[str], revision: str) -> DataFrame:
    """``rows`` after partial edits: a null field of an edit keeps the old value. Edits (id,
    columns, expected) of another revision than expected, and resolving a record of a
    protected domain, change nothing. ``outcome``: edited, stale, protected or none."""
    e = edits.select("id", F.col("expected").alias("_expected"), *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_edit"))
    met = rows.join(e, "id", "left")
    stale = F.col("_expected").isNotNull() & (F.col("_expected") != F.col(revision))
    guarded = F.coalesce(F.col("_resolved"), F.lit(False)) & R.protected_domain(F.col("domain")) if "resolved" in columns else F.lit(False)
    outcome = F.when(F.col("_edit").isNull(), "none").when(stale, "stale").when(guarded, "protected").otherwise("edited")
    kept = [c for c in rows.columns if c not in columns]
    return met.withColumn("outcome", outcome).select(*kept, *[F.when(F.col("outcome") == "edited", F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) for c in columns], "outcome")


def rooted(kind: Column, domain: Column) -> Column:
    """The folder that a record's kind and first domain imply."""
    root = F.when(kind == "archived", "archive").when(kind == "permanent", "permanent").when(kind == "feel", "feel").otherwise("dynamic")
    return F.concat(root, F.lit("/"), F.when(kind == "feel", "sediment").otherwise(F.coalesce(F.try_element_at(domain, F.lit(1)), F.lit("unsorted"))))


def transition(state: DataFrame, requests: DataFrame, allowed: DataFrame) -> DataFrame:
    """Compare and set: (key, outcome, status) of requests (key, expected, to) on (key, status).

    Missing keys, another state than expected and transitions that aren't allowed are refused;
    the same state again is a replay. One request per key at a time.
    """
    pairs = allowed.select(F.col("from").alias("status"), F.col("to"), F.lit(True).alias("_ok"))
    met = requests.join(state.select("key", "status"), "key", "left").join(pairs, ["status", "to"], "left")
    outcome = (
        F.when(F.col("status").isNull(), "missing").when(F.col("expected").isNotNull() & (F.col("expected") != F.col("status")), "stale")
        .when(F.col("status") == F.col("to"), "replayed").when(F.col("_ok").isNull(), "refused").otherwise("moved")
    )
    return met.select("key", outcome.alias("outcome"), F.when(outcome == "moved", F.col("to")).otherwise(F.col("status")).alias("status"))


def insert_checked(stored: DataFrame, incoming: DataFrame, key: list[str], digest: str, parents: DataFrame, parent: str) -> DataFrame:
    """``incoming`` with ``outcome``: orphan (its parent isn't there), inserted, replayed or conflict.

    Of several incoming rows of a key the first by ``seq`` is inserted. The first rows are found
    by an aggregate, so a key of many rows is combined before it is shuffled.
    """
    known = stored.groupBy(*key).agg(F.min(digest).alias("_stored"))
    have = parents.select(parent).distinct().withColumn("_parent", F.lit(True))
    rows = incoming.join(have, parent, "left")
    first = rows.filter("_parent").groupBy(*key).agg(F.min_by(F.struct(digest, "seq"), "seq").alias("_first"))
    met = rows.join(known, key, "left").join(first, key, "left")
    base = F.coalesce("_stored", F.col(f"_first.{digest}"))
    outcome = F.when(F.col("_parent").isNull(), "orphan").when(F.col("_stored").isNull() & (F.col("_first.seq") == F.col("seq")), "inserted").when(F.col(digest) == base, "replayed").otherwise("conflict")
    return met.withColumn("outcome", outcome).drop("_stored", "_first", "_parent")


def history_problems(stages: DataFrame, allowed: DataFrame, initial: str) -> DataFrame:
    """(run, problem) of runs whose history isn't contiguous from 0, doesn't begin with ``initial`` or
    holds a transition that isn't allowed. A run's rows are few: its stages."""
    w = Window.partitionBy("run").orderBy("seq")
    rows = stages.withColumn("before", F.lag("stage").over(w)).withColumn("place", F.row_number().over(w) - 1)
    ok = allowed.select(F.col("from").alias("before"), F.col("to").alias("stage"), F.lit(True).alias("_ok"))
    problem = F.when(F.col("place") != F.col("seq"), "gap").when((F.col("place") == 0) & (F.col("stage") != initial), "start").when((F.col("place") > 0) & F.col("_ok").isNull(), "transition")
    return rows.join(ok, ["before", "stage"], "left").withColumn("problem", problem).filter("problem is not null").groupBy("run").agg(F.min(F.struct("seq", "problem")).alias("x")).select("run", "x.problem")


def lifecycle_updates(pairs: DataFrame) -> DataFrame:
    """(id, status, other, at): both updates of a reviewed pair (newer, older, at), in one frame so that both or none are written."""
    return pairs.select(F.explode(F.array(F.struct(F.col("newer").alias("id"), F.lit("current").alias("status"), F.col("older").alias("other"), "at"), F.struct(F.col("older").alias("id"), F.lit("historical").alias("status"), F.col("newer").alias("other"), "at"))).alias("x")).select("x.*")


def until_broken(rows: DataFrame, key: str, seq: str, bad: str, most: int) -> DataFrame:
    """Rows of each key up to its ``most``-th bad one in a row, by which the work of the key stops.

    The window holds ``most`` rows; the place where a key stops is an aggregate.
    """
    w = Window.partitionBy(key).orderBy(seq)
    run = F.col(bad)
    for k in range(1, most):
        run = run & F.coalesce(F.lag(bad, k).over(w), F.lit(False))
    stops = rows.withColumn("_run", run).filter("_run").groupBy(key).agg(F.min(seq).alias("_stop"))
    return rows.join(stops, key, "left").filter(F.col("_stop").isNull() | (F.col(seq) <= F.col("_stop"))).drop("_stop")
