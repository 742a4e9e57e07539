"""Hierarchical multi-length packing.

A document's ids are cut into full windows of the longest tier; the remainder is
routed to the smallest context tier that holds it. Tiers are packed from long to
short: a window takes the longest remainder that fits, its gap is filled from
the same and shorter tiers (best fit), and the last gap by cutting one remainder
to measure. What is left at the end of a task is cut into powers of two. So no
sequence has padding. Sequences of a task are then dealt to step groups of balanced
cost, some groups' worth at a time; only a task's last groups hold what is left.

A task packs the rows of its own partition, so nothing is shuffled and memory is
bounded by ``pool_tokens``, not by the input.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import claim, prepare, read_table, table, text_or_empty

MAX_LEN = 2048
TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Ids that wait in a task's pools before windows are closed.
POOL_TOKENS = 1 << 20
#: Ids of one step group, and step groups that are balanced together.
STEP_TOKENS, STEPS_TOGETHER = 1 << 16, 8

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    + [("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())]
)
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs pieces (document key, start, length) into windows of the tiers.

    Each tier has a pool of the remainders that are routed to it. ``take()`` yields
    finished windows as (tier, [piece, ...]); every window is exactly full.
    Deterministic for the same order of calls.
    """

    def __init__(self, tiers=TIERS, pool_tokens: int = POOL_TOKENS):
        if any(t & (t - 1) for t in tiers):
            raise ValueError("tiers are powers of two")
        self.tiers, self.top, self.pool_tokens = sorted(tiers), max(tiers), pool_tokens
        self.pools: dict[int, list[tuple[int, int]]] = {t: [] for t in self.tiers}  # (length, serial), sorted
        self.piece: dict[int, tuple] = {}
        self.serial = self.waiting = 0
        self.done: list[tuple[int, list[tuple]]] = []

    def _route(self, key, start: int, length: int) -> None:
        """To the smallest tier that holds it."""
        if length:
            insort(self.pools[self.tiers[bisect_left(self.tiers, length)]], (length, self.serial))
            self.piece[self.serial] = (key, start, length)
            self.serial += 1
            self.waiting += length

    def _pop(self, tier: int, at: int) -> tuple:
        length, serial = self.pools[tier].pop(at)
        self.waiting -= length
        return self.piece.pop(serial)

    def add(self, key, length: int) -> None:
        whole = length // self.top * self.top
        for start in range(0, whole, self.top):
            self.done.append((self.top, [(key, start, self.top)]))
        self._route(key, whole, length - whole)
        if self.waiting >= self.pool_tokens:
            self._pack(self.pool_tokens // 4)

    def _fill(self, size: int) -> None:
        """A window of ``size``: its gap takes the longest remainder that fits, from the tier
        of the gap or shorter ones; where none fits the shortest is cut to measure."""
        window, gap = [], size
        while gap:
            for tier in reversed(self.tiers[: bisect_left(self.tiers, gap) + 1]):
                at = bisect_right(self.pools[tier], (gap, self.serial)) - 1
                if at >= 0:
                    key, start, length = self._pop(tier, at)
                    break
            else:
                key, start, length = self._pop(next(t for t in self.tiers if self.pools[t]), 0)
                self._route(key, start + gap, length - gap)
                length = gap
            window.append((key, start, length))
            gap -= length
        self.done.append((size, window))

    def _pack(self, keep: int) -> None:
        """Close windows of the tiers, longest first, until ``keep`` ids wait."""
        for tier in reversed(self.tiers):
            while self.pools[tier] and self.waiting > keep and self.waiting >= tier:
                self._fill(tier)

    def finish(self) -> None:
        """Close the rest: full tiers first, then powers of two below them."""
        self._pack(0)
        while self.waiting:
            self._fill(1 << (min(self.waiting, self.top).bit_length() - 1))

    def take(self) -> list[tuple[int, list[tuple]]]:
        out, self.done = self.done, []
        return out


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each window, longest first to the group of least cost.

    Cost is length plus a quadratic share for attention, so groups of one step
    take about the same time.
    """
    groups = max(1, round(sum(sizes) / step_tokens))
    heap = [(0.0, g) for g in range(groups)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        cost, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (cost + sizes[i] + sizes[i] ** 2 / 4096, g))
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, tiers=TIERS, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """One row per piece of every document of ``docs`` (doc_id, text).

    Null text is empty (the end id alone); null and repeated ids keep a row for
    each of their pieces; extra columns are ignored; an empty table gives none.
    """
    prepare(docs.sparkSession)
    path = tokenizer or bpe.default_path()

    def pack(batches):
        claim("bpe")
        part = TaskContext.get().partitionId() << 34
        enc, end = bpe.encoder(path), np.array([end_id], "<u2").tobytes()
        packer, held, sequence, group = Packer(tiers, pool_tokens), {}, 0, 0
        key = 0

        ready: list[tuple[int, list[tuple]]] = []

        def emit(last: bool = False):
            """Rows of finished windows once they make up enough steps to balance."""
            nonlocal sequence, group
            ready.extend(packer.take())
            if not ready or not last and sum(t for t, _ in ready) < STEPS_TOGETHER * STEP_TOKENS:
                return None
            steps, rows = step_groups([t for t, _ in ready]), {f.name: [] for f in PIECES}
            for (tier, window), step in zip(ready, steps):
                offset = 0
                for k, start, length in window:
                    doc = held[k]
                    doc[2] -= length
                    ids = np.frombuffer(doc[1], "<u2")
                    rows["ids_crc32"].append(zlib.crc32(ids[start : start + length].astype("<u4").tobytes()))
                    for name, value in (("doc_id", doc[0]), ("start", start), ("length", length), ("doc_tokens", len(ids)), ("sequence_id", part + sequence), ("offset", offset), ("tier", tier), ("step_group", part + group + step)):
                        rows[name].append(value)
                    offset += length
                    if not doc[2]:
                        del held[k]
                sequence += 1
            group += max(steps) + 1
            ready.clear()
            return table(PIECES, **rows)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, doc_id in enumerate(ids):
                data = enc.encode(texts[i].as_py()) + end
                held[key] = [doc_id, data, len(data) // 2]
                packer.add(key, len(data) // 2)
                key += 1
            if (out := emit()) is not None:
                yield out
        packer.finish()
        if (out := emit(last=True)) is not None:
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).mapInArrow(pack, PIECES_DDL)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """Pack all documents into tiers up to 2048 ids."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
