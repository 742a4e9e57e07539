"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.llm.common import persist, read_table
from emberline.llm.jaccard_join import keep_first
from emberline.llm.packing import pack_documents
from emberline.llm.quality import keep_good
from emberline.llm.secret_scan import mask_secrets


def quality(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """Of each group of near duplicates the document of least id stays."""
    return keep_first(docs)


def secrets(spark, docs, sf_dir):
    """Secret spans are masked; n_chars follows the new text."""
    masked = mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def packing(spark, docs, sf_dir):
    """Kept texts as pieces of packed sequences."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]
#: SQL cannot express the stages; tests hold them against plain Python instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on ``documents``, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = persist(docs, f"pipeline-{name}")
    return docs
