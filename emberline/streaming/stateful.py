"""Streams over raw events: idempotent append, decaying state, activation counts.

Each function maps a streaming DataFrame to another; sources, sinks and triggers
are the caller's. All state is keyed, and keys are dropped by watermark or time
to live, so it doesn't grow with the stream.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULTS, Params


def deduplicated(events: DataFrame, key: list[str], ts: str = "ts", late: str = "2 days") -> DataFrame:
    """The first event of each key within the watermark (exactly-once append)."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def activation(events: DataFrame, key: str, ts: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(key, start, n, last): touches per key and window; late rows past the
    watermark are dropped by the engine."""
    windowed = events.withWatermark(ts, late).groupBy(F.window(ts, width), key)
    return windowed.agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last")).select(key, F.col("window.start").alias("start"), "n", "last")


def next_state(value: float, seconds: float, stimulus: float, tau: float = DEFAULTS.tau_s) -> float:
    """State after ``seconds`` of decay and a stimulus, held within 0 and 1."""
    return min(1.0, max(0.0, value * math.exp(-max(0.0, seconds) / tau) + stimulus))


def decayed_state(events: DataFrame, key: str, ts: str = "ts", amount: str = "amount", p: Params = DEFAULTS, late: str = "1 day", idle_ms: int = 86_400_000) -> DataFrame:
    """(key, at, value): exponentially decaying state with additive stimuli.

    Events of a batch are taken in time order; one that is older than the state's
    clock adds its stimulus, decayed to that clock, so the result doesn't depend
    on arrival order inside the bounds. A key whose clock is ``idle_ms`` behind the
    watermark is forgotten.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value, clock = state.get if state.exists else (0.0, None)
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        for at, x in zip(rows[ts], rows[amount]):
            now = at.timestamp()
            if clock is None or now >= clock:
                value, clock = next_state(value, 0.0 if clock is None else now - clock, float(x), p.tau_s), now
            else:
                value = min(1.0, max(0.0, value + float(x) * math.exp(-(clock - now) / p.tau_s)))
        state.update((value, clock))
        state.setTimeoutTimestamp(max(int(clock * 1000) + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "at": [pd.Timestamp(clock, unit="s")], "value": [round(value, 6)]})

    kind = events.schema[key].dataType.simpleString()
    return events.withWatermark(ts, late).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at timestamp, value double", "value double, clock double", "update", GroupStateTimeout.EventTimeTimeout)


def append_batch(path: str, key: list[str]):
    """A ``foreachBatch`` function: append rows whose key isn't stored yet.

    Batches are written to a folder of their own by id, so a batch that runs again
    after a failure replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(key)
        try:
            stored = spark.read.option("basePath", path).parquet(path).filter(F.col("batch") != batch_id).select(*key)
            rows = rows.join(stored, key, "left_anti")
        except Exception as e:  # nothing is stored before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
