"""Sessions' newest keys with a time to live, as timed state; pages that are exploded and stored once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULTS

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "session long, key long, at timestamp, op string, seq long"


class NewestKeys(StatefulProcessor):
    """State of a session: its keys with their times, ``most`` at most, each until ``ttl_ms`` after it was marked;
    one value, so that a batch reads and writes a session once, not once a key.

    Every change is a row: ``add`` or ``drop``, numbered in the session. A key that is marked again counts from its
    last time. A timer is set for the oldest key; the watermark's passing drops all that are due.
    """

    def __init__(self, most: int, ttl_ms: int):
        self.most, self.ttl = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.keys = handle.getValueState("keys", "keys array<long>, ats array<long>")
        self.seq = handle.getValueState("seq", "n long")

    def _changes(self, session: int, rows: list[tuple[int, int, str]]) -> pd.DataFrame:
        n = self.seq.get()[0] if self.seq.exists() else 0
        if rows:
            self.seq.update((n + len(rows),))
        return pd.DataFrame({"session": session, "key": [k for k, _, _ in rows], "at": pd.to_datetime([t for _, t, _ in rows], unit="us"), "op": [o for _, _, o in rows], "seq": range(n, n + len(rows))})

    def _held(self) -> dict[int, int]:
        return dict(zip(*self.keys.get())) if self.keys.exists() else {}

    def _hold(self, held: dict[int, int]) -> None:
        """Store the keys and set the timer of the oldest."""
        if held:
            self.keys.update((list(held), list(held.values())))
        else:
            self.keys.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if held:
            self.handle.registerTimer(min(held.values()) // 1000 + self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        told = []
        for pdf in rows:
            for k, at in zip(pdf["key"].tolist(), (pdf["at"].astype("datetime64[us]").astype("int64")).tolist()):
                if k not in held or at > held[k]:
                    held[k] = at
                    told.append((k, at, "add"))
        for k, at in sorted(held.items(), key=lambda x: (-x[1], -x[0]))[self.most :]:
            told.append((k, at, "drop"))
            del held[k]
        self._hold(held)
        yield self._changes(key[0], told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        due = timerValues.getCurrentWatermarkInMs()
        told = [(k, at, "drop") for k, at in held.items() if at // 1000 + self.ttl <= due]
        for k, _, _ in told:
            del held[k]
        self._hold(held)
        yield self._changes(key[0], told)

    def close(self) -> None:
        pass


def newest_keys(marks: DataFrame, most: int = DEFAULTS.session_keys, ttl_days: int = DEFAULTS.session_ttl_days) -> DataFrame:
    """(session, key, at, op, seq) of a stream of (session, key, at): the changes of each session's live keys.

    Rows older than the watermark come too late and are left out. The session must use the RocksDB state
    store, which map state and timers need.
    """
    timed = marks.select(F.col("session").cast("long").alias("session"), F.col("key").cast("long").alias("key"), F.col("at").cast("timestamp").alias("at")).withWatermark("at", "0 seconds")
    return timed.groupBy("session").transformWithStateInPandas(NewestKeys(most, ttl_days * 86_400_000), CHANGES, "Append", "EventTime")


def live_keys(changes: DataFrame) -> DataFrame:
    """(session, key, at) that are live after all changes."""
    last = changes.groupBy("session", "key").agg(F.max_by(F.struct("op", "at"), "seq").alias("c"))
    return last.filter("c.op = 'add'").select("session", "key", "c.at")


def persist_pages(explode: Callable[[DataFrame], DataFrame], path: str, cursor: str, write: Callable[[str, bytes], None], fail_once: list[int] | None = None):
    """A ``foreachBatch`` function: explode a page and store it under the batch's number, then move the cursor.

    A batch that runs again replaces what its first run stored, so an attempt that fails between the
    two steps neither loses nor repeats rows. ``fail_once`` names batches whose first attempt is made to fail there.
    """
    failing = set(fail_once or ())

    def run(page: DataFrame, batch: int) -> None:
        explode(page).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        if batch in failing:
            failing.discard(batch)
            raise RuntimeError(f"batch {batch} is made to fail after its rows are stored")
        write(cursor, str(batch).encode())

    return run
