"""JSON lines: lenient and strict reading, and the formats of conversation exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """(line) of the files below a path."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def parsed(lines: DataFrame, schema: str, key: str) -> DataFrame:
    """The fields of each line with ``_bad``: not an object, or without its key. Blank lines are left out."""
    rows = lines.filter(F.trim("line") != "").select("line", F.from_json("line", schema).alias("x"))
    bad = F.col("x").isNull() | F.col(f"x.{key}").isNull() | ~F.trim("line").startswith("{")
    return rows.select("x.*", F.coalesce(bad, F.lit(True)).alias("_bad"))


def lenient(lines: DataFrame, schema: str, key: str) -> DataFrame:
    """Rows of the good lines; the others are skipped."""
    return parsed(lines, schema, key).filter(~F.col("_bad")).drop("_bad")


def strict(lines: DataFrame, schema: str, key: str) -> DataFrame:
    """Rows of all lines; a bad line or a repeated key fails the whole read."""
    rows = parsed(lines, schema, key)
    checked = rows.withColumn(key, F.when(F.col("_bad"), F.raise_error(F.lit("a line is malformed"))).otherwise(F.col(key))).drop("_bad")
    others = [c for c in checked.columns if c != key]
    one = checked.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in others])
    return one.withColumn(key, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string")))).otherwise(F.col(key))).select(checked.columns)


def export_format(text: Column) -> Column:
    """Which export a text is: by the field that only that format has; Markdown or plain text otherwise."""
    json = text.rlike(r"^\s*[\[{]")
    first = F.when(text.rlike(r"^\s*\["), F.get_json_object(text, "$[0]")).otherwise(text)
    has = lambda k: json & F.get_json_object(first, f"$.{k}").isNotNull()
    return F.when(has("chat_messages"), "chat_messages").when(has("mapping"), "mapping").when(has("messages"), "messages").when(has("role"), "turns").when(text.rlike(r"(?m)^#{1,6}\s|^\*\*[^*]+\*\*\s*[:：]"), "markdown").otherwise("text")
