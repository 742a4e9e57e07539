"""Extension points for models: batched functions by name, behind caches keyed by content.

A hook is a function of Arrow batches. None ships a model: the defaults are plain rules, and a
deployment registers its own under the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HOOKS: dict[str, tuple[Callable, str, pa.DataType]] = {}


def register(name: str, result: str, kind: pa.DataType):
    """Register ``f(list of texts) -> list of results`` as the hook ``name``."""

    def keep(f):
        _HOOKS[name] = (f, result, kind)
        return f

    return keep


def apply(rows: DataFrame, name: str, text: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the hook's result of each text. A hook that returns another number of results fails."""
    f, result, kind = _HOOKS[name]

    @F.arrow_udf(result)
    def run(texts: pa.Array) -> pa.Array:
        held = texts.to_pylist()
        got = f(held)
        if len(got) != len(held):
            raise ValueError(f"the hook {name} gave {len(got)} results for {len(held)} texts")
        return pa.array(got, kind)

    return rows.withColumn(out, run(F.col(text)))


def cached(rows: DataFrame, cache: DataFrame, name: str, text: str, out: str) -> DataFrame:
    """As ``apply``, but texts whose digest is in ``cache`` (digest, value) take its value; equal
    texts are asked once. ``from_cache`` tells which."""
    keyed = rows.withColumn("_digest", F.sha2(F.col(text).cast("binary"), 256))
    known = cache.select(F.col("digest").alias("_digest"), F.col("value").alias("_value"))
    fresh = keyed.join(known, "_digest", "left_anti").groupBy("_digest").agg(F.first(text).alias(text))
    asked = apply(fresh, name, text, "_new").select("_digest", "_new")
    met = keyed.join(known, "_digest", "left").join(asked, "_digest", "left")
    return met.withColumn(out, F.coalesce("_value", "_new")).withColumn("from_cache", F.col("_value").isNotNull()).drop("_digest", "_value", "_new")


@register("summary", "string", pa.string())
def lead(texts: list) -> list:
    """The first 80 characters."""
    return [None if t is None else " ".join(t.split())[:80] for t in texts]


@register("angles", "array<string>", pa.list_(pa.string()))
def angles(texts: list) -> list:
    """The question, and its two longest words."""
    return [None if t is None else [t, *sorted(dict.fromkeys(t.split()), key=lambda w: (-len(w), w))[:2]] for t in texts]


@register("vector", "array<double>", pa.list_(pa.float64()))
def hashed_vector(texts: list, size: int = 16) -> list:
    """Counts of words by hash: the same text always has the same vector."""
    out = []
    for t in texts:
        v = np.zeros(size)
        for w in (t or "").lower().split():
            v[int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % size] += 1
        out.append(None if t is None else v.tolist())
    return out


@register("keep", "boolean", pa.bool_())
def keep(texts: list) -> list:
    """Texts of more than three words are relevant."""
    return [t is not None and len(t.split()) > 3 for t in texts]


def filtered(rows: DataFrame, text: str, forced, most: int, order: list) -> DataFrame:
    """Rows that the ``keep`` hook wants, forced ones in any case; if it wants none, all stay.
    Only the first ``most`` of the order are asked and come back."""
    page = rows.withColumn("_forced", F.coalesce(forced, F.lit(False))).orderBy(*order).limit(most)
    told = apply(page, "keep", text, "_keep")
    any_ = told.agg(F.coalesce(F.bool_or("_keep"), F.lit(False)).alias("_any"))  # one row
    return told.crossJoin(F.broadcast(any_)).filter(F.col("_keep") | F.col("_forced") | ~F.col("_any")).drop("_keep", "_forced", "_any")
