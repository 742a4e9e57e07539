"""Whole-text encoding with a byte-level vocabulary of the ``tokenizers`` library.

Texts of a corpus repeat their words, so ids are looked up by space-delimited
unit; a unit seen first is split by the vocabulary's own pre-tokenizer pattern
and only its unseen pieces go to the library. The ids equal those of encoding
the whole text: every cut is one that the pre-tokenizer makes too.
"""

from __future__ import annotations

from struct import Struct

import numpy as np

from .common import kept

#: Entries of each of a table's two generations in a worker (a memory bound): when
#: the young one is full it becomes the old one, and what is used again moves back.
UNIT_CACHE = 250_000
PIECE_CACHE = 50_000

#: Longer keys are made each time, so a table is bounded in bytes too.
LONGEST_KEY = 200

MARKS = frozenset(".,;:!?")

#: Packers of so many ids, made once.
PACKERS = [Struct(f"<{n}H").pack for n in range(64)]

_encoders: dict[str, "ByteEncoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str | None = None) -> "ByteEncoder":
    """The worker's encoder of a vocabulary file, kept from task to task."""
    path = path or default_path()
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Table(dict):
    """Results of ``make`` by key, in two generations of ``most`` entries."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def clear(self) -> None:
        super().clear()
        self.old = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if isinstance(key, (str, bytes)) and len(key) > LONGEST_KEY:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            super().clear()
        self[key] = value
        return value


class ByteEncoder:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.letters = _byte_letters()
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids are kept as 16-bit integers")
        self.pieces = _Table(self._piece, PIECE_CACHE)
        self.units = _Table(self._unit, UNIT_CACHE)
        kept("bpe", self.pieces, self.units)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # printable bytes stand for themselves
            letters = piece.replace(" ", self.letters[32])
        else:
            letters = piece.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
        found = [t.id for t in self.model.tokenize(letters)]
        return PACKERS[len(found)](*found) if len(found) < len(PACKERS) else np.array(found, "<u2").tobytes()

    def _unit(self, word: str) -> bytes:
        """Ids of a space and ``word``: letters alone, letters and a mark, or any text.

        Letters after a space are kept here and nowhere else, so a word takes one place.
        """
        if word.isalpha():
            return self._piece(" " + word)
        units, pieces = self.units, self.pieces
        if word[-1] in MARKS and word[:-1].isalpha():
            return units[word[:-1]] + pieces[word[-1]]
        before, line, after = word.rpartition("\n")
        if line and after.isalpha() and before and not before[-1].isspace():  # a line's end is a piece by itself
            return units[before] + pieces[line] + pieces[after]
        return b"".join([units[p[1:]] if p[0] == " " and p[1:].isalpha() else pieces[p] for p in self.split(" " + word)])

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian 16-bit integers."""
        if not text:
            return b""
        if any(s in text for s in self.specials):
            return self._ids(text)
        parts = text.split(" ")
        if "" in parts:  # of a run of spaces, all but the last belong to what stands before
            merged = [parts[0]]
            for p in parts[1:]:
                if p:
                    merged.append(p)
                else:
                    merged[-1] += " "
            if not merged[0].strip(" "):
                return self._ids(text)
            parts = merged
        first = b"".join([self.pieces[p] for p in self.split(parts[0])])
        del parts[0]
        return first + b"".join(map(self.units.__getitem__, parts))
