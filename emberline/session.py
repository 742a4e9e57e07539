"""Session defaults for running the engine outside a managed cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(master)
        .appName("emberline")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts for Python: 256 rows and, where the engine can bound them, 16 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); only a local master without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(found)
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
    import tempfile

    made = "file://" + tempfile.mkdtemp(prefix="emberline-checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder URI below the shared one."""
    import uuid

    base = ensure_checkpoint_dir(spark)
    base = base if base.startswith("file:") or "://" in base else "file://" + base
    if base.startswith("file:") and not base.startswith("file://"):
        base = "file://" + base[5:]
    return f"{base.rstrip('/')}/store/{name}-{uuid.uuid4().hex}"
