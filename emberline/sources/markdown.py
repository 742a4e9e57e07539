"""The record store's text form: Markdown with a front matter of ``key: value`` lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import once

_HEAD = r"(?s)^\x{feff}?---[ \t]*\r?\n(.*?\r?\n)?---[ \t]*(?:\r?\n|$)(.*)$"
_LINE = r"(?m)^([A-Za-z_][A-Za-z0-9_]*):[ \t]*([^\r\n]*)$"


def parse(text: Column) -> Column:
    """struct<fields: map<string, string>, body, corrupt>.

    Values lose their quotes; of equal keys the last holds; a ``content`` key, which
    would clash with the body, is dropped. A text without front matter is corrupt: no
    fields, the whole text as body. Null text is corrupt with a null body.
    """
    good = text.rlike(_HEAD)
    lines = lambda head: F.arrays_zip(F.regexp_extract_all(head, F.lit(_LINE), F.lit(1)).alias("k"), F.regexp_extract_all(head, F.lit(_LINE), F.lit(2)).alias("v"))
    pairs = once(F.regexp_extract(text, _HEAD, 1), lines)
    bare = F.transform(pairs, lambda x: F.struct(x["k"].alias("k"), F.regexp_replace(F.trim(x["v"]), "^(['\"])(.*)\\1$", "$2").alias("v")))
    last = once(bare, lambda b: F.filter(b, lambda x, i: (x["k"] != "content") & ~F.exists(F.slice(b, i + 2, F.greatest(F.size(b), F.lit(1))), lambda y: y["k"] == x["k"])))
    none = F.from_json(F.lit("{}"), "map<string,string>")
    fields = F.when(good, F.map_from_entries(last)).otherwise(none)
    body = F.when(good, F.ltrim(F.regexp_extract(text, _HEAD, 2))).otherwise(text)
    return F.struct(fields.alias("fields"), body.alias("body"), (~F.coalesce(good, F.lit(False))).alias("corrupt"))


def items(value: Column) -> Column:
    """A list field: ``[a, b]``, or one item; nothing for an empty one."""
    inner = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"^\[|\]$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^(['\"])(.*)\\1$", "$2")), lambda x: x != "")


def records(files: DataFrame) -> DataFrame:
    """(path, id, name, type, world, domain, importance, pinned, body, corrupt) of (path, text).

    Corrupt files keep a row, with nulls; readers of live records leave them out.
    """
    p = files.select("path", parse(F.col("text")).alias("p"))
    field = lambda k: F.nullif(F.col("p.fields")[k], F.lit(""))
    return p.select(
        "path", field("id").alias("id"), field("name").alias("name"), F.coalesce(field("type"), F.when(~F.col("p.corrupt"), "dynamic")).alias("type"), field("world").alias("world"),
        items(field("domain")).alias("domain"), F.coalesce(field("importance").try_cast("int"), F.lit(5)).alias("importance"), F.coalesce(F.lower(field("pinned")) == "true", F.lit(False)).alias("pinned"),
        F.col("p.body").alias("body"), F.col("p.corrupt").alias("corrupt"),
    )


def scan(spark: SparkSession, *roots: str) -> DataFrame:
    """``records`` of all ``.md`` files below some roots, read whole by Spark."""
    files = spark.read.text(list(roots), wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return records(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def listing(spark: SparkSession, *roots: str) -> DataFrame:
    """(path, size, modified) of the files, a token by which a cache sees changes."""
    files = spark.read.text(list(roots), wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified")).distinct()


def render(rows: DataFrame) -> Column:
    """The text of a record (id, name, type, world, domain, importance, pinned, content)."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit("")), F.lit("\n"))
    c = F.col
    head = [line("id", c("id")), line("name", c("name")), line("type", c("type")), line("world", c("world")), line("domain", F.concat(F.lit("["), F.array_join("domain", ", "), F.lit("]"))), line("importance", c("importance")), line("pinned", c("pinned"))]
    return F.concat(F.lit("---\n"), *head, F.lit("---\n"), c("content"))
