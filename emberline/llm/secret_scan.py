"""Secret scans: fixed patterns, and guess costs of values in credential context.

Base kinds are plain patterns. The method adds the kind ``guess``: a value that
stands in credential context is split into words, dates, repeats, keyboard walks
and brute-force spans by dynamic programming, so that the product of the parts'
guess counts is least; it is reported when even the cheapest reading would take
more guesses than GUESSES_LOG10.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, prepare, read_table, table
from .pieces import SPACE, proto_fields

# The three base kinds, in the order in which ties are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS = 12

#: Credential context of the added kind, wider than the base pattern: more names,
#: separators and any value without white space or quotes.
CONTEXT = re.compile(r"""((?:[pP][aA][sS][sS](?:[wW][oO][rR][dD]|[wW][dD]|[pP][hH][rR][aA][sS][eE])?|[pP][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI][_-]?[kK][eE][yY]|[cC][rR][eE][dD][eE][nN][tT][iI][aA][lL][sS]?|[aA][uU][tT][hH]|[pP][rR][iI][vV][aA][tT][eE][_-]?[kK][eE][yY])["']?\s*+(?:=>|:=|[:=])\s*+["']?)([^\s"'<>{}]{8,})""")
#: One linear-time scan decides which texts can hold any context or key at all: the
#: names alone, whatever stands behind them.
MAYBE = r"(?i:pass|pwd|secret|token|api[_-]?key|credential|auth|private[_-]?key)"
MAYBE_KEY = r"AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}"

#: A value is a secret if its cheapest reading takes over 10 ** 10 guesses.
GUESSES_LOG10 = 10.0
#: Longest value whose cost is remembered.
REMEMBERED = 256

# Rows of keyboard neighbours and common words of weak values.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "qazwsxedcrfvtgbyhnujmikolp", "abcdefghijklmnopqrstuvwxyz")
WORDS = (
    "password pass admin root user login welcome hello test guest master dragon monkey letmein secret access "
    "token key api default change changeme please example sample dummy placeholder your insert here none null true false "
    "server client database public private prod production staging dev local host system service account my the for and "
    "love summer winter spring autumn monday friday january december football baseball shadow sunshine princess"
).split()
LEET = str.maketrans("013457@$!", "oleastasi")
DATES = tuple(
    re.compile(p)
    for p in (
        r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])",
        r"(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d",
        r"(?:19|20)\d\d",
    )
)
#: Longest unit of a repeat; shortest pattern span.
UNIT, LEAST = 8, 3
#: Guesses (log10) of a letter without case (scripts that passwords are not drawn from).
CASELESS = 0.5
#: Weight of the shorter context where a longer one was rarely seen.
BACKOFF = 4.0
JOIN = math.log10(2)
_PLACES = [(len(row), step, {c: k * step for k, c in enumerate(row)}) for row in ROWS for step in (1, -1)]


@lru_cache(maxsize=4)
def dictionary(path: str | None = None) -> tuple[dict[str, int], int]:
    """Ranks of words, and the longest one's length: common weak values, then the words of
    a piece vocabulary in its order (by default the public piece file, some 12,000)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    rank = {w: k + 1 for k, w in enumerate(dict.fromkeys(WORDS))}
    with open(path, "rb") as f:
        for field, value in proto_fields(f.read()):
            if field == 1:
                word = dict(proto_fields(value))[1].decode().removeprefix(SPACE).lower()
                if len(word) >= LEAST and word.isalpha():
                    rank.setdefault(word, len(rank) + 1)
    return rank, max(map(len, rank))


@lru_cache(maxsize=4)
def letter_counts(path: str | None = None) -> tuple[dict[str, int], int]:
    """How often one, two and three letters follow each other in the listed words
    (``^`` before the first), and the number of letters; the key is the letters."""
    seen: dict[str, int] = {}
    for word in dictionary(path)[0]:
        told = "^^" + word
        for k in range(2, len(told)):
            for context in (told[k - 2 : k], told[k - 1], ""):  # counts of a context end in a space
                seen[context + told[k]] = seen.get(context + told[k], 0) + 1
                seen[context + " "] = seen.get(context + " ", 0) + 1
    return seen, sum(len(k) == 1 for k in seen) - 1


@lru_cache(maxsize=200_000)
def letter_cost(before: str, letter: str) -> float:
    """Guesses (log10) of a letter after two others, as it follows them in listed words;
    contexts that were rarely seen lean on shorter ones."""
    if not letter.isascii() and letter == letter.upper() == letter.lower():
        return CASELESS
    seen, letters = letter_counts()
    p = (seen.get(letter, 0) + 1) / (seen[" "] + letters + 1)
    for context in (before[1:], before):
        p = (seen.get(context + letter, 0) + BACKOFF * p) / (seen.get(context + " ", 0) + BACKOFF)
    return -math.log10(p)


def _masks(text: str) -> list[int]:
    """Classes of each character as bits: digits, a-z, A-Z, others."""
    return [c.isdecimal() | ("a" <= c <= "z") << 1 | ("A" <= c <= "Z") << 2 | (not (c.isascii() and c.isalnum())) << 3 for c in text]


_SIZES = [math.log10(max(1, 10 * (m & 1) + 26 * (m >> 1 & 1) + 26 * (m >> 2 & 1) + 33 * (m >> 3 & 1))) for m in range(16)]


def words_in(text: str) -> list[tuple[int, int, float]]:
    """Spans of listed words, plain or in leet, and their guesses (log10)."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose small form is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    plain, (rank, longest) = low.translate(LEET), dictionary()
    out = []
    for i in range(len(text)):
        for j in range(i + LEAST, min(len(text), i + longest) + 1):
            for form, extra in ((low, 1), (plain, 4)):
                if form[i:j] in rank:
                    case = 1 if text[i:j] in (low[i:j], text[i:j].upper()) else 2
                    out.append((i, j, math.log10(rank[form[i:j]] * extra * case * 2)))
                    break
    return out


def dates_in(text: str) -> list[tuple[int, int, float]]:
    """Spans of dates and years from any place on, and their guesses (log10)."""
    found = [(i, m.end()) for i, c in enumerate(text) if c.isdecimal() for p in DATES if (m := p.match(text, i))]
    return [(i, j, math.log10(120 * (366 if j - i > 4 else 1) * 4)) for i, j in found]


class _Runs:
    """Starts of a growing run from which a span may end here, at cost best[start] +
    log10(length): one that is dominated stays dominated as the run grows, so few are kept."""

    __slots__ = ("starts",)

    def __init__(self):
        self.starts: list[tuple[int, float]] = []

    def least(self, new: int, best: float, end: int) -> float:
        self.starts.append((new, best))
        costs = [b + math.log10(end - i) for i, b in self.starts]
        low = min(costs)
        if len(costs) > 1:
            kept, held = [], math.inf
            for x, c in zip(self.starts, costs):  # a later start must be cheaper here than all earlier ones
                if c < held:
                    kept.append(x)
                    held = c
            self.starts = kept
        return low


def _case(c: str) -> tuple[bool, bool]:
    return c.islower(), c.isupper()


def guess_cost(text: str) -> float:
    """log10 of the least guesses over all segmentations of ``text``.

    ``best[j]`` is the least over the last part that ends at j: a listed word, a date, a
    repeat (any unit up to UNIT, any number of times), a keyboard walk, a word that
    isn't listed (LEAST or more letters of one case, or with a capital first), whose letters cost what
    they cost in listed words, so that a random run costs nearly brute force, or a brute-force
    span, whose cost is per character so spans of it need no inner loop. All spans of a kind count, also those inside longer ones. Each part
    but those of brute force costs a factor for the order of parts. Time is linear in the
    length, for any value.
    """
    return _remembered(text) if len(text) <= REMEMBERED else _least(text)


def _least(text: str) -> float:
    masks = _masks(text)
    every = 0
    for m in set(masks):
        every |= m
    per_char, n = _SIZES[every], len(text)
    by_end: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in [*words_in(text), *dates_in(text)]:
        by_end.setdefault(j, []).append((i, cost))
    best = [0.0] * (n + 1)
    same, repeats = [0] * (UNIT + 1), [[_Runs() for _ in range(p)] for p in range(UNIT + 1)]
    walk, walks = [0] * len(_PLACES), [_Runs() for _ in _PLACES]
    low = [c.lower() for c in text]
    # of the run of letters: its start; the cost of its letters in turn; the least cost before a word's
    # third letter, over starts in one case (or a capital before small letters); starts yet too near
    start, told, word, ready = 0, [0.0] * (n + 1), math.inf, []
    for j in range(1, n + 1):
        c, cost = text[j - 1], best[j - 1] + per_char
        for i, g in by_end.get(j, ()):
            cost = min(cost, best[i] + g + JOIN)
        for p in range(1, min(UNIT, j - 1) + 1):
            if c != text[j - 1 - p]:
                if same[p]:
                    same[p] = 0
                    repeats[p] = [_Runs() for _ in range(p)]
                continue
            same[p] += 1
            size = p * max(2, -(-LEAST // p))
            if same[p] + p >= size:
                mask = 0
                for m in masks[j - p : j]:
                    mask |= m
                i = j - size
                cost = min(cost, repeats[p][j % p].least(i, best[i], j) - math.log10(p) + p * _SIZES[mask] + JOIN)
        for k, (size, _, place) in enumerate(_PLACES):
            here = place.get(low[j - 1])
            if here is None:
                walk[k] = 0
            elif walk[k] and place[low[j - 2]] == here - 1:
                walk[k] += 1
            else:
                walk[k] = 1
            if walk[k] == 1:
                walks[k].starts = []
            elif walk[k] >= LEAST:
                i = j - LEAST
                cost = min(cost, walks[k].least(i, best[i], j) + math.log10(2 * size) + JOIN)
        if not c.isalpha():
            start = j
        else:
            two = ("^^" + "".join(low[max(start, j - 3) : j - 1]))[-2:]
            told[j] = told[j - 1] + letter_cost(two, low[j - 1])
            if j - start > 1 and _case(c) != _case(text[j - 2]):
                title = j - 2 if c.islower() and text[j - 2].isupper() else None
                word, ready = math.inf, [k for k in (title, j - 1) if k is not None]
            elif j - start == 1:
                word, ready = math.inf, [j - 1]
            else:
                ready.append(j - 1)
            for i in [k for k in ready if j - k >= LEAST]:  # from here on, letters cost the same from any start
                ready.remove(i)
                word = min(word, best[i] + letter_cost("^^", low[i]) + letter_cost("^" + low[i], low[i + 1]) - told[i + 2])
            cost = min(cost, word + told[j] + 2 * JOIN)
        best[j] = cost
    return best[-1]


_remembered = lru_cache(maxsize=50_000)(_least)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def added_spans(text: str, least: float = GUESSES_LOG10) -> list[tuple[int, int]]:
    """Spans of values in credential context that are hard to guess."""
    out = []
    for m in CONTEXT.finditer(text):
        value = m[2].rstrip(".,;:)]")
        if len(value) >= 8 and guess_cost(value) > least:
            out.append((m.start(2), m.start(2) + len(value)))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, each by start and then kind."""
    base = base_spans(text)
    named = [(KINDS[k], s, e) for s, k, e in base]
    every = sorted([(s, k, e) for s, k, e in base] + [(s, 3, e) for s, e in added_spans(text)])
    return named, [((*KINDS, "guess")[k], s, e) for s, k, e in every]


SPANS = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_guess", pa.int64())])


def _candidates(texts: pa.Array) -> list[bool]:
    return pc.or_(pc.match_substring_regex(texts, MAYBE), pc.match_substring_regex(texts, MAYBE_KEY)).to_pylist()


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with counts and spans.

    Null text counts as empty: no spans. Ids may be null or repeated; extra
    columns are ignored. Rows are independent, so nothing is shuffled.
    """
    prepare(docs.sparkSession)
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        claim("secrets")
        for batch in batches:
            texts = batch.column(1)
            rows = []
            for i, maybe in enumerate(_candidates(texts)):
                if not maybe:
                    rows.append((0, 0, 0, empty, "", 0))
                    continue
                base, every = scan(texts[i].as_py())
                count = [sum(k == kind for k, _, _ in every) for kind in (*KINDS, "guess")]
                rows.append((*count[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), count[3]))
            a, b, c, h, s, g = map(list, zip(*rows)) if rows else [[]] * 6
            yield table(SPANS, doc_id=batch.column(0), n_assign=a, n_access=b, n_hex=c, base_sha256=h, spans=s, n_guess=g)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret span of ``text`` replaced by ``[secret]``.

    All columns and rows stay; texts without spans and null texts are unchanged.
    Overlapping spans are masked as one.
    """
    prepare(docs.sparkSession)
    names = docs.columns

    def run(batches):
        claim("secrets")
        at = names.index("text")
        for batch in batches:
            texts = batch.column(at)
            filled = pc.fill_null(texts, "")
            maybe = _candidates(filled)
            if any(maybe):
                out = texts.to_pylist()
                for i, m in enumerate(maybe):
                    if m:
                        out[i] = _masked(out[i])
                batch = pa.RecordBatch.from_arrays([pa.array(out, texts.type) if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def _masked(text: str) -> str:
    out, at = [], 0
    for _, start, end in scan(text)[1]:
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """Scan all documents."""
    return find_secrets(read_table(spark, sf_dir, "documents"))
