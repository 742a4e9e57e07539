"""Domain frames over the provided tables, defined once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import REF

#: Edge types by doc_id mod 6.
EDGE_TYPES = ("kin", "explains", "causes", "contributes", "improves", "updates")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ref() -> F.Column:
    return F.lit(REF).cast("timestamp_ntz")


def hours(n) -> F.Column:
    return F.make_dt_interval(F.lit(0), n)


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records: documents with labels as flags and fields derived from the id."""
    d = read(spark, sf_dir, "documents")
    flags = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    i = F.col("doc_id")
    event_at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (i % 720).cast("int"))
    return d.join(flags, "doc_id", "left").select(
        i.alias("id"),
        F.col("text").alias("content"),
        F.concat_ws("-", "lang", "source").alias("name"),
        F.array("lang").alias("domain"),
        F.array("source", "lang").alias("tags"),
        F.when(i % 10 == 0, "permanent").when(i % 10 == 1, "feel").otherwise("dynamic").alias("type"),
        F.when(i % 4 == 0, "shared").when(i % 4 == 1, "").when(i % 4 == 2, "north").otherwise("south").alias("world"),
        F.col("source").alias("thread"),
        (1 + i % 10).alias("importance"),
        ((i * 37 % 101) / F.lit(100.0)).alias("valence"),
        ((i * 53 % 101) / F.lit(100.0)).alias("arousal"),
        (1 + i % 7).alias("activation"),
        F.coalesce(F.col("quality") == 0, F.lit(False)).alias("resolved"),
        (i % 3 == 0).alias("digested"),
        (i % 50 == 0).alias("pinned"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("protected"),
        event_at.alias("event_at"),
        (event_at + F.make_dt_interval(F.lit(0), (i % 48).cast("int"))).alias("last_active"),
        "n_chars",
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed relations: id to id * 7 + 1 modulo the number of documents."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    n = d.agg(F.count(F.lit(1)).alias("n"))
    i = F.col("doc_id")
    kinds = F.array(*[F.lit(t) for t in EDGE_TYPES])
    return d.crossJoin(F.broadcast(n)).select(  # one row of counts
        i.alias("source"), ((i * 7 + 1) % F.col("n")).alias("target"), F.element_at(kinds, (F.pmod(i, F.lit(6)) + 1).cast("int")).alias("type"), ((i % 11) / F.lit(10.0)).alias("strength")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), F.col("label").alias("cluster"))


#: The same frames as SQL, for the independent oracle.
SQL = {
    "memories": """memories AS (
  SELECT doc_id AS id, text AS content, lang || '-' || source AS name, [lang] AS domain, [source, lang] AS tags,
    CASE WHEN doc_id % 10 = 0 THEN 'permanent' WHEN doc_id % 10 = 1 THEN 'feel' ELSE 'dynamic' END AS type,
    CASE doc_id % 4 WHEN 0 THEN 'shared' WHEN 1 THEN '' WHEN 2 THEN 'north' ELSE 'south' END AS world, source AS thread,
    1 + doc_id % 10 AS importance, (doc_id * 37 % 101) / 100.0::DOUBLE AS valence, (doc_id * 53 % 101) / 100.0::DOUBLE AS arousal, 1 + doc_id % 7 AS activation,
    coalesce(quality = 0, false) AS resolved, doc_id % 3 = 0 AS digested, doc_id % 50 = 0 AS pinned, coalesce(toxic = 1, false) AS protected,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 720 AS INTEGER)) AS event_at,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 720 + doc_id % 48 AS INTEGER)) AS last_active, n_chars
  FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id))""",
    "edges": """edges AS (
  SELECT doc_id AS source, (doc_id * 7 + 1) % (SELECT count(*) FROM documents) AS target,
    ['kin', 'explains', 'causes', 'contributes', 'improves', 'updates'][CAST(doc_id % 6 + 1 AS INTEGER)] AS type, (doc_id % 11) / 10.0::DOUBLE AS strength
  FROM documents)""",
    "vectors": """vectors AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec, label AS cluster FROM embeddings)""",
}
