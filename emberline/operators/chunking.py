"""Greedy chunking of turns, lines and bytes, and greedy clustering of a pool."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import token_estimate

LINE_CHARS = 1200
# Labels of speakers in a chunk.
LABELS = ("用户", "AI")


def turn_chunks(turns: DataFrame, target: int) -> DataFrame:
    """(conv_id, chunk, first_turn, last_turn, n, content) of (conv_id, turn, role, text).

    Turns fill a chunk up to ``target`` tokens; one over 1.5 times that is a chunk of
    its own. The rows of a conversation stream through one task in order with two
    numbers of state, so a conversation of any length is chunked without being
    gathered; only a chunk, which the target bounds, is put together.
    """
    line = F.concat(F.lit("["), F.when(F.col("role").isin("user", "human"), LABELS[0]).otherwise(LABELS[1]), F.lit("] "), F.coalesce("text", F.lit("")))
    rows = turns.select("conv_id", "turn", line.alias("line"), token_estimate(line).alias("tokens")).repartition("conv_id").sortWithinPartitions("conv_id", "turn")

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, chunk, used, fresh = object(), 0, 0, True
        for pdf in batches:
            out = []
            for key, tokens in zip(pdf["conv_id"], pdf["tokens"]):
                if key != conv:
                    conv, chunk, used, fresh = key, 0, 0, True
                if tokens > 1.5 * target:
                    chunk += 0 if fresh else 1
                    out.append(chunk)
                    chunk, used, fresh = chunk + 1, 0, True
                    continue
                if not fresh and used + tokens > target:
                    chunk, used = chunk + 1, 0
                out.append(chunk)
                used, fresh = used + tokens, False
            pdf["chunk"] = out
            yield pdf[["conv_id", "turn", "line", "chunk"]]

    numbered = rows.mapInPandas(number, "conv_id long, turn long, line string, chunk long")
    parts = F.sort_array(F.collect_list(F.struct("turn", "line")))
    return numbered.groupBy("conv_id", "chunk").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("content"))


def line_chunks_of(text: str, size: int = LINE_CHARS, most: int | None = None) -> list[str]:
    """Lines joined up to ``size`` characters; longer lines are cut; all chunks, or the first ``most``."""
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    out: list[str] = []
    open_ = False
    for line in filter(None, (x.strip() for x in text.split("\n"))):
        if len(line) > size:
            out += [line[at : at + size] for at in range(0, len(line), size)]
            open_ = False
        elif open_ and len(out[-1]) + 1 + len(line) <= size:
            out[-1] += "\n" + line
        else:
            out.append(line)
            open_ = True
    return out[:most]


def line_chunks(text: Column, size: int = LINE_CHARS, most: int | None = None) -> Column:
    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([line_chunks_of(t.as_py(), size, most) if t.is_valid else None for t in texts], pa.list_(pa.string()))

    return split(text)


def utf8_parts_of(data: bytes, limit: int) -> list[bytes]:
    """Parts of at most ``limit`` bytes that never cut a character."""
    out, start = [], 0
    while start < len(data):
        end = min(start + limit, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        if end <= start:
            raise ValueError("the limit is below one character")
        out.append(data[start:end])
        start = end
    return out


def utf8_parts(text: Column, limit: int) -> Column:
    @F.arrow_udf("array<binary>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([utf8_parts_of(t.as_py().encode(), limit) if t.is_valid else None for t in texts], pa.list_(pa.binary()))

    return split(text)


def greedy_clusters(pool: DataFrame, threshold: float, span_days: float, least: int, most: int) -> DataFrame:
    """(seed, id) of a pool (id, ts, vec): the newest row takes unclaimed ones
    within ``span_days`` and ``threshold``, up to ``most``; groups under ``least`` go.

    Each seed depends on what earlier seeds took, but not across a pause of over
    ``span_days``: the stretches between pauses are groups of their own, found from the
    occupied buckets of that width. A seed is only compared with rows of its span.
    """

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "id"], ascending=[False, True]).reset_index(drop=True)
        v = np.stack([np.asarray(x, float) for x in pdf["vec"]]) if len(pdf) else np.zeros((0, 1))
        norm = np.sqrt((v * v).sum(1))
        unit = v / np.where(norm == 0, 1, norm)[:, None]
        days = pdf["ts"].astype("int64").to_numpy() / 86_400_000_000
        free, seeds, ids = np.ones(len(pdf), bool), [], []
        last = np.searchsorted(-days, span_days + 1e-6 - days, side="right")  # newest first; the margin is cut below
        for k in range(len(pdf)):
            if not free[k]:
                continue
            free[k] = False
            j = slice(k, int(last[k]))  # rows before a seed are claimed, or seeds
            near = k + np.flatnonzero(free[j] & (np.abs(days[j] - days[k]) <= span_days) & (np.round(unit[j] @ unit[k], 9) >= threshold))[: most - 1]
            free[near] = False
            if len(near) + 1 >= least:
                members = [k, *near.tolist()]
                seeds += [pdf["id"][k]] * len(members)
                ids += pdf["id"][members].tolist()
        return pd.DataFrame({"seed": seeds, "id": ids}, dtype="int64")

    def stretch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket").reset_index(drop=True)
        return pdf.assign(page=(pdf["bucket"].diff() > 1).cumsum())[["bucket", "page"]]

    span = int(span_days * 86_400_000_000)
    rows = pool.select("id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "vec").filter("ts is not null").withColumn("bucket", F.floor(F.col("ts") / span))
    # buckets of a span's width, as many as the time has, not the rows; an empty one is a pause
    pages = rows.groupBy("bucket").agg(F.lit(0).alias("all")).groupBy("all").applyInPandas(stretch, "bucket long, page long")
    return rows.join(pages, "bucket").select("id", "ts", "vec", "page").groupBy("page").applyInPandas(cluster, "seed long, id long")
