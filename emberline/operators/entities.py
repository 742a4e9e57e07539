"""Entities: aliases, mentions in text, links of records."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_CHARS = 256
_CJK = re.compile(r"[㐀-䶿一-鿿豈-﫿぀-ヿ가-힯]")


def normal(term: str) -> str:
    """NFKC, case folded, runs of blanks as one."""
    return " ".join(unicodedata.normalize("NFKC", term).casefold().split())


def normalised(term: Column) -> Column:
    """``normal`` of a column; null for terms longer than MOST_CHARS."""

    @F.arrow_udf("string")
    def run(terms: pa.Array) -> pa.Array:
        out = [None if t is None else normal(t) for t in terms.to_pylist()]
        return pa.array([None if t is None or len(t) > MOST_CHARS else t for t in out], pa.string())

    return run(term)


def entity_id(name: Column, kind: Column) -> Column:
    return F.concat(F.lit("ent_"), F.substring(F.sha2(F.concat_ws("\x1f", kind, name).cast("binary"), 256), 1, 24))


def upserted(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity, kind, alias) of entities (name, kind) and their aliases (name, kind, alias): the
    entity's own name is an alias too, equal ones count once, whoever gives them."""
    own = entities.select("name", "kind", F.col("name").alias("alias"))
    given = aliases.join(entities.select("name", "kind").distinct(), ["name", "kind"], "left_semi").select("name", "kind", "alias")
    return own.unionByName(given).select(entity_id(F.col("name"), F.col("kind")).alias("entity"), "kind", F.lower(F.trim("alias")).alias("alias")).filter("alias <> ''").distinct()


def catalogue(aliases: DataFrame) -> DataFrame:
    """(alias, entity, ambiguous): the entity of each alias; none where several have it."""
    return aliases.groupBy("alias").agg(F.min("entity").alias("a"), F.max("entity").alias("b")).select("alias", F.when(F.col("a") == F.col("b"), F.col("a")).alias("entity"), (F.col("a") != F.col("b")).alias("ambiguous"))


def _bounded(text: str, start: int, end: int) -> bool:
    """Whether a span isn't part of a longer word; characters of scripts without blanks part words."""
    word = lambda c: bool(c) and (c.isalnum() or c == "_") and not _CJK.match(c)
    before, after = text[start - 1 : start], text[end : end + 1]
    return not (word(text[start]) and word(before)) and not (word(text[end - 1]) and word(after))


def occurrences(text: Column, alias: Column) -> Column:
    """How often an alias stands in a text as a word of its own; overlapping places count each."""

    @F.arrow_udf("int")
    def run(texts: pa.Array, aliases: pa.Array) -> pa.Array:
        out = []
        for t, a in zip(texts.to_pylist(), aliases.to_pylist()):
            if t is None or not a:
                out.append(None if t is None or a is None else 0)
                continue
            t, a, n, at = normal(t), normal(a), 0, -1
            while a and (at := t.find(a, at + 1)) >= 0:
                n += _bounded(t, at, at + len(a))
            out.append(n)
        return pa.array(out, pa.int32())

    return run(text, alias)


class Finder:
    """Mentions of known aliases in a normalised text: the longest from left to right, none overlapping."""

    def __init__(self, aliases: list[str]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for a in aliases:
            if a:
                self.machine.add_word(a, a)
        self.some = len(self.machine) > 0
        if self.some:
            self.machine.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str]]:
        if not self.some:
            return []
        spans = [(end + 1 - len(a), end + 1, a) for end, a in self.machine.iter(text)]
        taken: list[tuple[int, int, str]] = []
        free = 0
        for start, end, a in sorted((s for s in spans if _bounded(text, s[0], s[1])), key=lambda s: (s[0], -s[1])):
            if start >= free:
                taken.append((start, end, a))
                free = end
        return taken


#: Aliases that are sent to every task; a longer catalogue has to be dealt by first letters instead.
MOST_ALIASES = 200_000


def mentions(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(id, alias, start, end) of the aliases of ``known`` (alias) in ``rows`` (id, text).

    Texts are normalised first and places are those of the normal form. The catalogue, of
    MOST_ALIASES at most (more raise), goes to every task; texts are not shuffled.
    """
    held = [r.alias for r in known.select("alias").distinct().limit(MOST_ALIASES + 1).collect()]
    if len(held) > MOST_ALIASES:
        raise ValueError("the catalogue of aliases is too long to be sent to every task")
    schema = pa.schema([("id", pa.int64()), ("alias", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        finder = Finder(held)
        for batch in batches:
            out = []
            for i, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                out += [(i, a, s, e) for s, e, a in finder.find(normal(cell.as_py() or ""))]
            columns = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[2 - 1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], schema=schema)

    return rows.select(F.col("id").cast("long"), "text").mapInArrow(run, "id long, alias string, start int, end int")


def links(found: DataFrame, known: DataFrame) -> DataFrame:
    """(id, entity): records and the one entity of each alias they mention; ambiguous aliases link nothing."""
    return found.join(known.filter(~F.col("ambiguous")).select("alias", "entity"), "alias").select("id", "entity").distinct()


def relinked(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Links (id, entity, digest) after some records were read again: all their old links go."""
    return stored.join(new.select("id").distinct(), "id", "left_anti").unionByName(new)


def resolved(questions: DataFrame, known: DataFrame) -> DataFrame:
    """(id, canonical, found, ambiguous) of questions (id, text): aliases of one entity are replaced by
    its name, those of several are named. ``known`` is (alias, entity, name), of MOST_ALIASES rows at most."""
    one = known.groupBy("alias").agg(F.min("name").alias("name"), F.min("entity").alias("a"), F.max("entity").alias("b"))
    rows = one.select("alias", F.when(F.col("a") == F.col("b"), F.col("name")).alias("name")).limit(MOST_ALIASES + 1).collect()
    if len(rows) > MOST_ALIASES:
        raise ValueError("the catalogue of aliases is too long to be sent to every task")
    names = {r.alias: r.name for r in rows}
    schema = pa.schema([("id", pa.int64()), ("canonical", pa.string()), ("found", pa.list_(pa.string())), ("ambiguous", pa.list_(pa.string()))])

    def run(batches):
        finder = Finder(list(names))
        for batch in batches:
            out = []
            for i, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = normal(cell.as_py() or "")
                spans = finder.find(text)
                good = [s for s in spans if names[s[2]] is not None]
                for start, end, a in reversed(good):
                    text = text[:start] + names[a] + text[end:]
                out.append({"id": i, "canonical": text, "found": list(dict.fromkeys(a for _, _, a in good)), "ambiguous": list(dict.fromkeys(a for _, _, a in spans if names[a] is None))})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return questions.select(F.col("id").cast("long"), "text").mapInArrow(run, "id long, canonical string, found array<string>, ambiguous array<string>")
