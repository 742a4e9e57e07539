"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to a Python worker. Texts may be long, so the
#: engine default of 10,000 rows would let one batch grow past a worker's share.
ARROW_ROWS = 256
#: Bytes of one Arrow batch, where the engine can bound them.
ARROW_BYTES = 16 << 20


def prepare(spark: SparkSession) -> None:
    """Session settings the Arrow operators rely on (bounded batch memory)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


#: What a Python worker keeps from task to task (tables of words, encoders), by the
#: operator that made it. Workers serve every stage of a job in turn.
_kept: dict[str, list] = {}


def kept(owner: str, *tables) -> None:
    """Register tables (with ``clear``) that a worker keeps for ``owner``."""
    _kept.setdefault(owner, []).extend(tables)


def claim(*owners: str) -> None:
    """At the start of a task: empty what the worker keeps for other operators and
    hand freed memory back, so that stages of one job don't add up in a worker."""
    stale = [t for name, tables in _kept.items() if name not in owners for t in tables if len(t)]
    for t in stale:
        t.clear()
    pa.default_memory_pool().release_unused()
    if stale:
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # a C library without it
            pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder URI below the folder that all executors and the driver share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (tests on one machine) a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        base = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="emberline-"))
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + base
    return f"{base.rstrip('/')}/emberline/{name}-{uuid.uuid4().hex}"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (file, hdfs, s3, gs)."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


class AtomicFile:
    """Write ``<uri>`` through a temporary name; it appears only when complete.

    Callers give each attempt a name of its own and hand the name on with their rows, so
    a file is never replaced: a late attempt leaves a file that no row names.
    """

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.size = 0

    def write(self, data: bytes) -> int:
        self.out.write(data)
        self.size += len(data)
        return len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def persist(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder, read it back."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch with the columns in the order and types of ``schema``."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema
    )
