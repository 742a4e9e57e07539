"""Indel similarity of strings, as Arrow functions over whole batches."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a word of bits per row of the table."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (length of both); equal empty strings are 100."""
    total = len(a) + len(b)
    return 200.0 * lcs(a, b) / total if total else 100.0


#: Windows that are scored at once.
WINDOWS = 1 << 16


def _best_window(short: str, long: str) -> float:
    """``partial_ratio`` of a string of at most 64 characters: ``lcs`` of it with all windows at once, a word of bits a window."""
    n, size = len(short), len(long)
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if n <= np.iinfo(t).bits)
    codes = np.frombuffer(long.encode("utf-32-le"), np.uint32)
    where = np.zeros(size + 2 * (n - 1), kind)  # beyond the ends nothing matches
    for c in set(short):
        where[n - 1 : n - 1 + size][codes == ord(c)] = sum(1 << k for k, x in enumerate(short) if x == c)
    full, best = kind((1 << n) - 1), 0.0
    for at in range(0, size + n - 1, WINDOWS):
        count = min(WINDOWS, size + n - 1 - at)
        row = np.full(count, full)
        for k in range(n):
            hit = row & where[at + k : at + k + count]
            row = ((row + hit) | (row - hit)) & full
        start = np.arange(at + 1 - n, at + 1 - n + count)
        width = np.minimum(size, start + n) - np.maximum(0, start)
        best = max(best, float((200.0 * (n - np.bitwise_count(row).astype(int)) / (n + width)).max()))
        if best == 100.0:
            break
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of its length in the longer,
    windows at the ends included."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    if len(short) <= 64:
        return _best_window(short, long)
    n, best, letters = len(short), 0.0, set(short)
    spare, common = Counter(short), 0  # letters of the short string that the window doesn't hold; those that it does
    for start in range(1 - n, len(long)):
        if start + n <= len(long) and (c := long[start + n - 1]) in letters:
            spare[c] -= 1
            common += spare[c] >= 0
        if start > 0 and (c := long[start - 1]) in letters:
            common -= spare[c] >= 0
            spare[c] += 1
        width = min(len(long), start + n) - max(0, start)
        if 200.0 * common / (n + width) <= best:  # a subsequence in common has no more letters
            continue
        window = long[max(0, start) : start + n]
        if window[-1] in letters or window[0] in letters:  # else a window next to it does better
            best = max(best, ratio(short, window))
            if best == 100.0:
                break
    return best


def _batched(f, query: str):
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else f(query, t) for t in texts.to_pylist()], pa.float64())

    return score


def ratio_to(query: str, text: Column) -> Column:
    return _batched(ratio, query)(text)


def partial_ratio_to(query: str, text: Column) -> Column:
    return _batched(partial_ratio, query)(text)


def topic_score(query: str, name: Column, tags: Column, domain: Column, content: Column) -> Column:
    """Greatest of the name, tag, domain and content evidence for a query, 0 to 1.

    A name or tag that holds the whole query is 1; otherwise the share of query
    words in them, their ratios, 0.9 of the domain's and 0.8 of the whole content's.
    """
    low = query.lower()
    parts = [p for p in low.split() if p] or [low]
    names, labels = F.lower(name), F.transform(tags, F.lower)
    whole = F.contains(names, F.lit(low)) | F.exists(labels, lambda t: F.contains(t, F.lit(low)))
    in_any = lambda p: (F.contains(names, F.lit(p)) | F.exists(labels, lambda t: F.contains(t, F.lit(p)))).cast("int")
    share = sum((in_any(p) for p in parts[1:]), in_any(parts[0])) / F.lit(float(len(parts)))
    near = F.greatest(share, ratio_to(query, name) / 100, ratio_to(query, F.element_at(tags, 1)) / 100, 0.9 * ratio_to(query, F.element_at(domain, 1)) / 100, 0.8 * partial_ratio_to(query, content) / 100)
    return F.when(whole, 1.0).otherwise(near)
