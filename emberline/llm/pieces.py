"""SentencePiece encoding and decoding in numpy batches.

A text is cut into words at places that no piece spans. New words of a batch are
grouped by length and advance together: polynomial prefix hashes give the hash
of every substring up to the longest piece, which probes the sorted piece keys
(behind a bit filter, and confirmed by code points); the Viterbi step at each
end position is a maximum over piece lengths whose argument is the backpointer.

Viterbi maximises the sum of piece scores, which is what unigram models ask for.
A model of merge type is read by its library in merge order instead; the same
score table drives ``merges`` then, where the words of a group take their best
merge in lockstep. ``encode`` returns both readings.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, kept, prepare, read_table, table

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Words kept in each of two generations of a worker's table, and words of one
#: numpy group.
WORD_CACHE, GROUP = 300_000, 2048
#: Texts encoded together.
TEXTS = 512
#: Groups of longer words are smaller, so a batch's table stays small; words beyond
#: LONG are read one at a time, STRETCH characters at once.
BATCHED, LONG, STRETCH = 48, 512, 16_384

_models: dict[str, "PieceModel"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def model(path: str | None = None) -> "PieceModel":
    path = path or default_path()
    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = PieceModel(f.read())
    return _models[path]


def proto_fields(data: bytes):
    """(field, value) of a serialised message: integers, or bytes."""

    def varint(at):
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            if kind == 2:
                size, at = varint(at)
            else:
                size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    def __init__(self, data: bytes):
        self.pieces, self.scores, kinds = [], [], []
        self.prefix = True
        for field, value in proto_fields(data):
            if field == 1:
                piece = dict(proto_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0])
                kinds.append(piece.get(3, NORMAL))
            elif field == 3:
                rule = dict(proto_fields(value))
                self.prefix = bool(rule.get(3, 1))
                if rule.get(2) or rule.get(4, 1) or not rule.get(5, 1):
                    raise ValueError("only models that keep characters and white space as they are can be read")
        if len(self.pieces) > 1 << 16:
            raise ValueError("ids are kept as 16-bit integers")
        self.bytes_at = {int(p[1:-1], 16): k for k, (p, t) in enumerate(zip(self.pieces, kinds)) if t == BYTE}
        normal = [k for k, t in enumerate(kinds) if t == NORMAL]
        self.ids = {self.pieces[k]: k for k in normal}
        self.unknown = min(self.scores[k] for k in normal) - 10.0
        self.unknown_id = kinds.index(UNKNOWN)
        self.longest = max(len(self.pieces[k]) for k in normal)
        self.output = [b"" if t in (UNKNOWN, CONTROL) else bytes([int(p[1:-1], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() for p, t in zip(self.pieces, kinds)]
        inner = {c for k in normal if len(self.pieces[k]) > 1 for c in self.pieces[k]}
        cut = "\n" if "\n" not in inner else ""
        if any(SPACE in self.pieces[k].lstrip(SPACE) for k in normal):
            raise ValueError("pieces span words")
        self.words = re.compile(f"{cut or '(?!)'}| *[^ {cut}]+| +").findall
        # keys of normal pieces, sorted by substring hash
        rng = np.random.default_rng(7)
        self.base = np.uint64(rng.integers(1 << 62, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        self.powers = np.array([pow(int(self.base), n, 1 << 64) for n in range(self.longest + 1)], np.uint64)
        codes = np.zeros((len(normal), self.longest), np.uint32)
        lengths = np.array([len(self.pieces[k]) for k in normal])
        for row, k in enumerate(normal):
            codes[row, : lengths[row]] = [ord(c) for c in self.pieces[k]]
        value = np.zeros(len(normal), np.uint64)
        with np.errstate(over="ignore"):
            for at in range(self.longest):
                on = lengths > at
                value[on] = value[on] * self.base + self._mix(codes[on, at])
            value += lengths.astype(np.uint64)
        order = np.argsort(value)
        self.keys, self.codes, self.lengths = value[order], codes[order], lengths[order]
        self.key_ids = np.array(normal, np.int32)[order]
        self.key_scores = np.array([self.scores[k] for k in normal])[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("piece keys collide")
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        # ids of words (with plain spaces) in both readings, and the generation before
        self.cache: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        kept("pieces", self)

    def __len__(self) -> int:
        return len(self.cache[0]) + len(self.old[0])

    def clear(self) -> None:
        """Forget the words of earlier texts."""
        self.cache, self.old = ({}, {}), ({}, {})

    @staticmethod
    def _mix(codes: np.ndarray) -> np.ndarray:
        x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))

    def table(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of every substring [start, length] of equal-length words.

        Length 1 without a piece is the unknown score and id -1; longer substrings
        without one are minus infinity.
        """
        n, size = codes.shape
        most = min(self.longest, size)
        scores = np.full((n, size, most + 1), -np.inf)
        ids = np.full((n, size, most + 1), -1, np.int32)
        with np.errstate(over="ignore"):
            prefix = np.zeros((n, size + 1), np.uint64)
            mixed = self._mix(codes)
            for i in range(size):
                prefix[:, i + 1] = prefix[:, i] * self.base + mixed[:, i]
            for length in range(1, most + 1):
                value = prefix[:, length:] - prefix[:, : size - length + 1] * self.powers[length] + np.uint64(length)
                word, start = np.nonzero(self.filter[(value >> np.uint64(42)).astype(np.int64)])
                sought = value[word, start]
                at = np.minimum(np.searchsorted(self.keys, sought), len(self.keys) - 1)
                hit = self.keys[at] == sought
                word, start, at = word[hit], start[hit], at[hit]
                same = self.lengths[at] == length
                for k in range(length):
                    same &= self.codes[at, k] == codes[word, start + k]
                word, start, at = word[same], start[same], at[same]
                scores[word, start, length] = self.key_scores[at]
                ids[word, start, length] = self.key_ids[at]
        lone = scores[:, :, 1]
        lone[np.isneginf(lone)] = self.unknown
        return scores, ids

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Backpointers [word, end]: the length of the best last piece.

        Equal sums go to the longest last piece.
        """
        n, size, wide = scores.shape
        best = np.zeros((n, size + 1))
        back = np.zeros((n, size + 1), np.int16)
        rows = np.arange(n)
        for end in range(1, size + 1):
            lengths = np.arange(min(end, wide - 1), 0, -1)
            found = best[:, end - lengths] + scores[:, end - lengths, lengths]
            arg = found.argmax(axis=1)
            best[:, end], back[:, end] = found[rows, arg], lengths[arg]
        return back

    def merges(self, scores: np.ndarray) -> np.ndarray:
        """Backpointers of the reading in merge order: in each round every word
        merges its best-scored neighbours, the leftmost of equals."""
        n, size, wide = scores.shape
        follow = np.tile(np.arange(1, size + 2), (n, 1))
        follow[:, size] = size + 1
        alive = np.ones((n, size), bool)
        rows, starts = np.arange(n), np.arange(size)
        active = rows
        while len(active):
            f = follow[active]
            second = np.take_along_axis(f, np.minimum(f[:, :size], size), axis=1)
            length = second - starts
            fits = alive[active] & (second <= size) & (length < wide)
            pair = np.where(fits, scores[active[:, None], starts, np.where(fits, length, 0)], -np.inf)
            arg = pair.argmax(axis=1)
            some = pair[np.arange(len(active)), arg] > -np.inf
            w, at = active[some], arg[some]
            gone = follow[w, at]
            follow[w, at] = follow[w, gone]
            alive[w, gone] = False
            active = w
        back = np.zeros((n, size + 1), np.int16)
        w, at = np.nonzero(alive)
        back[w, follow[w, at]] = follow[w, at] - at
        return back

    def _spell(self, word: str, cuts: list[tuple[int, int, int]]) -> bytes:
        out = []
        for start, length, k in cuts:
            if k >= 0:
                out.append(k)
            elif self.bytes_at:
                out += [self.bytes_at[b] for b in word[start : start + length].encode("utf-8", "replace")]
            else:
                out.append(self.unknown_id)
        return np.array(out, "<u2").tobytes()

    def _walk(self, words: list[str], back: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """Follow the backpointers of all words at once; their ids as bytes."""
        n, size = len(words), back.shape[1] - 1
        at, rows = np.full(n, size), np.arange(n)
        length_at, id_at = np.zeros((n, size), np.int16), np.zeros((n, size), np.int32)
        while len(rows):
            length = back[rows, at[rows]].astype(np.int64)
            start = at[rows] - length
            length_at[rows, start] = length
            id_at[rows, start] = ids[rows, start, length]
            at[rows] = start
            rows = rows[start > 0]
        cut = length_at > 0
        ends = np.concatenate([[0], np.cumsum(cut.sum(axis=1))]) * 2
        flat = id_at[cut]
        data, ends = (flat & 0xFFFF).astype("<u2").tobytes(), ends.tolist()
        out = [data[a:b] for a, b in zip(ends[:-1], ends[1:])]
        for r in np.flatnonzero((id_at < 0).any(axis=1)).tolist():  # words with unknown characters
            starts = np.flatnonzero(cut[r])
            out[r] = self._spell(words[r], list(zip(starts.tolist(), length_at[r, starts].tolist(), id_at[r, starts].tolist())))
        return out

    def _long(self, plain: str) -> tuple[bytes, bytes]:
        """Both readings of one long word, in time and memory near linear in its length.

        The same hash probes run over STRETCH characters at a time and only their hits
        are kept; the merge order comes from a heap of neighbours.
        """
        word, n = plain.replace(" ", SPACE), len(plain)
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        best, back, last = [0.0] * (n + 1), [1] * (n + 1), [-1] * (n + 1)
        done = 0
        for at in range(0, n, STRETCH):
            # ends in (at, at + STRETCH]: their pieces start up to ``longest`` before
            low, high = max(0, at + 1 - self.longest), min(n, at + STRETCH)
            scores, ids = self.table(codes[None, low:high])
            start, length = np.nonzero(ids[0] >= 0)
            end = low + start + length
            order = np.lexsort((-length, end))  # of equal sums the longest last piece holds
            order = order[(end[order] > at) & (end[order] <= high)]
            hits = iter(zip(end[order].tolist(), length[order].tolist(), scores[0][start, length][order].tolist(), ids[0][start, length][order].tolist()))
            hit = next(hits, None)
            for done in range(at + 1, high + 1):
                top, size, k = -np.inf, 1, -1
                while hit is not None and hit[0] == done:
                    total = best[done - hit[1]] + hit[2]
                    if total > top:
                        top, size, k = total, hit[1], hit[3]
                    hit = next(hits, None)
                if best[done - 1] + self.unknown > top and word[done - 1] not in self.ids:
                    top, size, k = best[done - 1] + self.unknown, 1, -1
                best[done], back[done], last[done] = top, size, k
        cuts, at = [], n
        while at:
            cuts.append((at - back[at], back[at], last[at]))
            at -= back[at]
        return self._spell(word, cuts[::-1]), self._spell(word, self._heap_merges(word))

    def _heap_merges(self, word: str) -> list[tuple[int, int, int]]:
        """Pieces (start, length, id) of the merge order, the best pair first, the leftmost of equals."""
        n = len(word)
        size, before, after = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < n:
                both = size[left] + size[right]
                k = self.ids.get(word[left : left + both]) if both <= self.longest else None
                if k is not None:
                    heapq.heappush(heap, (-self.scores[k], left, both))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, left, both = heapq.heappop(heap)
            right = after[left]
            if not size[left] or right >= n or size[left] + size[right] != both:
                continue  # one of the two has been merged since
            size[left], size[right] = both, 0
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [(i, size[i], self.ids.get(word[i : i + size[i]], -1)) for i in range(n) if size[i]]

    def encode_words(self, words: list[str]) -> None:
        """Put new words into the table, equal lengths together."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            if len(w) > LONG:
                self.cache[0][w], self.cache[1][w] = self._long(w)
            else:
                by_length.setdefault(len(w), []).append(w)
        for length, group in by_length.items():
            step = GROUP if length <= BATCHED else max(1, GROUP * BATCHED // length)
            for at in range(0, len(group), step):
                plain = group[at : at + step]
                part = [w.replace(" ", SPACE) for w in plain]
                codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), length)
                scores, ids = self.table(codes)
                first = self._walk(part, self.viterbi(scores), ids)
                second = self._walk(part, self.merges(scores), ids)
                self.cache[0].update(zip(plain, first))
                self.cache[1].update(zip(plain, second))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Viterbi ids and merge-order ids of each text."""
        lead = " " * self.prefix
        split = [self.words(lead + t.replace(SPACE, " ")) if t else [] for t in texts]
        if len(self.cache[0]) > WORD_CACHE:
            self.old, self.cache = self.cache, ({}, {})
        unseen = set().union(*split) - self.cache[0].keys()
        again = unseen & self.old[0].keys()
        for new, old in zip(self.cache, self.old):
            new.update((w, old[w]) for w in again)
        self.encode_words(list(unseen - again))
        first, second = (table.__getitem__ for table in self.cache)
        out = [(np.frombuffer(b"".join(map(first, words)), "<u2"), np.frombuffer(b"".join(map(second, words)), "<u2")) for words in split]
        for w in [w for w in unseen if len(w) > LONG]:  # the table stays bounded in bytes
            del self.cache[0][w], self.cache[1][w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space put before the text is taken off again."""
        text = b"".join([self.output[k] for k in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_viterbi", pa.int64()), ("viterbi_crc32", pa.int64()), ("n_merges", pa.int64()), ("merges_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])
ENCODED_DDL = "doc_id long, n_viterbi long, viterbi_crc32 long, n_merges long, merges_crc32 long, decoded_sha256 string, round_trip boolean"


def encode_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and both id lists (array<int>) of every text.

    Null and empty texts have no ids. Ids of rows may be null or repeated, each row is
    encoded by itself; other columns are ignored; an empty table gives no rows. A
    text may be of any length, with or without spaces.
    """
    prepare(docs.sparkSession)
    path = path or default_path()
    out = pa.schema([("doc_id", pa.int64()), ("viterbi_ids", pa.list_(pa.int32())), ("merge_ids", pa.list_(pa.int32()))])

    def run(batches):
        claim("pieces")
        m = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                found = m.encode(part.column(1).to_pylist())
                yield table(out, doc_id=part.column(0), viterbi_ids=[a.astype(np.int32) for a, _ in found], merge_ids=[b.astype(np.int32) for _, b in found])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, viterbi_ids array<int>, merge_ids array<int>")


def decode_pieces(encoded: DataFrame, ids: str = "viterbi_ids", path: str | None = None) -> DataFrame:
    """doc_id and text of id lists; a null list gives null."""
    prepare(encoded.sparkSession)
    path = path or default_path()
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        claim("pieces")
        m = model(path)
        for batch in batches:
            yield table(out, doc_id=batch.column(0), text=[None if x is None else m.decode(np.array(x)) for x in batch.column(1).to_pylist()])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), ids).mapInArrow(run, "doc_id long, text string")


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``; digests of both.

    ``viterbi_*`` is the reading of greatest score, ``merges_*`` the library's
    reading of a merge model. ``round_trip``: decoding the Viterbi ids gives the
    text (a literal U+2581 comes back as a space). Null text is empty: no ids, and
    the digests of nothing. Null and repeated doc_ids keep their rows; other columns
    are ignored; an empty table gives no rows.
    """
    prepare(spark)
    path = default_path()

    def run(batches):
        claim("pieces")
        m = model(path)
        for batch in batches:
            for part in (batch.slice(at, TEXTS) for at in range(0, batch.num_rows, TEXTS)):
                yield digests(m, part)

    def digests(m, part):
        texts, rows = part.column(1).to_pylist(), {f.name: [] for f in ENCODED}
        for doc_id, text, (a, b) in zip(part.column(0).to_pylist(), texts, m.encode(texts)):
            back = m.decode(a)
            for name, value in zip(rows, (doc_id, len(a), zlib.crc32(a.astype("<u4").tobytes()), len(b), zlib.crc32(b.astype("<u4").tobytes()), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest(), back == text.replace(SPACE, " "))):
                rows[name].append(value)
        return table(ENCODED, **rows)

    docs = read_table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, ENCODED_DDL)
