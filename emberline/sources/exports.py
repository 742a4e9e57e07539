"""Conversation exports as turns (conv, pos, role, content, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Line prefixes that switch the speaker.
USER, ASSISTANT = ("human:", "user:", "你:", "我:"), ("assistant:", "claude:", "ai:", "gpt:", "bot:", "deepseek:")

_MESSAGE = "struct<text:string,content:string,sender:string,role:string,created_at:string,timestamp:string>"
_FLAT = f"struct<chat_messages:array<{_MESSAGE}>,messages:array<{_MESSAGE}>>"
_NODE = "struct<message:struct<create_time:double,author:struct<role:string>,content:struct<parts:array<string>>>>"


def message_lists(raw: DataFrame) -> DataFrame:
    """Exports (conv, json) that list ``chat_messages`` or ``messages``; blank turns go."""
    data = raw.select("conv", F.from_json("json", _FLAT).alias("d"))
    rows = data.select("conv", F.posexplode(F.coalesce("d.chat_messages", "d.messages")).alias("pos", "m"))
    text = F.trim(F.coalesce("m.text", "m.content"))
    out = rows.select("conv", "pos", F.coalesce("m.sender", "m.role", F.lit("user")).alias("role"), text.alias("content"), F.coalesce("m.created_at", "m.timestamp", F.lit("")).alias("ts"))
    return out.filter("content <> ''")


def message_trees(raw: DataFrame) -> DataFrame:
    """Exports (conv, json) with a ``mapping`` of nodes, by creation time."""
    data = raw.select("conv", F.from_json("json", f"struct<mapping:map<string,{_NODE}>>").alias("d"))
    nodes = data.select("conv", F.explode("d.mapping").alias("key", "n")).filter("n.message is not null")
    at = F.coalesce("n.message.create_time", F.lit(0.0))
    parts = F.filter("n.message.content.parts", lambda p: p.isNotNull() & (p != ""))
    rows = nodes.select("conv", "key", at.alias("at"), F.coalesce("n.message.author.role", F.lit("user")).alias("role"), F.trim(F.array_join(parts, " ")).alias("content")).filter("content <> ''")
    w = Window.partitionBy("conv").orderBy("at", "key")
    return rows.select("conv", (F.row_number().over(w) - 1).alias("pos"), "role", "content", F.when(F.col("at") > 0, F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd'T'HH:mm:ss")).otherwise("").alias("ts"))


def _starts(line, prefixes):
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(line, F.lit(p))
    return out


def plain_text(raw: DataFrame) -> DataFrame:
    """Texts (conv, text): a line with a speaker's prefix begins a turn; what stands
    before the first is the user's; a text without prefixes is one turn."""
    lines = raw.select("conv", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    low = F.lower(F.trim("line"))
    role = F.when(_starts(low, USER), "user").when(_starts(low, ASSISTANT), "assistant")
    w = Window.partitionBy("conv").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("switch", role).withColumn("pos", F.sum(F.col("switch").isNotNull().cast("int")).over(w))
    body = F.when(F.col("switch").isNotNull(), F.trim(F.regexp_replace("line", r"^[^:]*:", ""))).otherwise(F.col("line"))
    kept = marked.withColumn("body", body).filter("switch is null or body <> ''")
    turns = kept.groupBy("conv", "pos").agg(F.sort_array(F.collect_list(F.struct("n", "body"))).alias("x"))
    heads = marked.filter("switch is not null").select("conv", "pos", F.col("switch").alias("head"))
    out = turns.join(heads, ["conv", "pos"], "left")
    content = F.trim(F.array_join(F.transform("x", lambda y: y["body"]), "\n"))
    return out.select("conv", "pos", F.coalesce("head", F.lit("user")).alias("role"), content.alias("content"), F.lit("").alias("ts")).filter("content <> ''")
