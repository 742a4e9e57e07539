"""A baseline JPEG decoder: Huffman tables, AC coefficients, any size, sampling and quantiser.

The frames that this package writes are read by array lookups (``media.py``); this
is the way for motion JPEG of other encoders. Progressive, lossless and arithmetic files
raise ValueError.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np


def _zigzag() -> np.ndarray:
    """Place in the block of each coefficient, along the anti-diagonals in turn."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()
_BASIS = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


@lru_cache(maxsize=64)
def _lookup(counts: bytes, symbols: bytes) -> list[tuple[int, int] | None]:
    """(length, symbol) of each 16-bit prefix of a canonical Huffman table."""
    table: list[tuple[int, int] | None] = [None] * (1 << 16)
    code = at = 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            first = code << (16 - length)
            table[first : first + (1 << (16 - length))] = [(length, symbols[at])] * (1 << (16 - length))
            code, at = code + 1, at + 1
        code <<= 1
    return table


class _Bits:
    """Bits of the entropy-coded data of one restart interval."""

    __slots__ = ("data", "at", "held", "n")

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def _fill(self, n: int) -> None:
        while self.n < n:
            byte = self.data[self.at] if self.at < len(self.data) else 255  # padded with ones
            self.held, self.n, self.at = self.held << 8 | byte, self.n + 8, self.at + 1
            if self.at > len(self.data) + 8:
                raise ValueError("a frame is short")

    def symbol(self, table: list) -> int:
        self._fill(16)
        found = table[self.held >> (self.n - 16) & 0xFFFF]
        if found is None:
            raise ValueError("a code that no table has")
        self.n -= found[0]
        self.held &= (1 << self.n) - 1
        return found[1]

    def value(self, size: int) -> int:
        """A signed value of ``size`` bits."""
        if not size:
            return 0
        self._fill(size)
        self.n -= size
        v = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return v if v >> (size - 1) else v - (1 << size) + 1


def decode(jpeg: bytes) -> np.ndarray:
    """Samples of a baseline JPEG: (height, width) of luma, or of the first component."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, quantisers, tables, parts, restart = 2, {}, {}, [], 0
    height = width = 0
    while True:
        while jpeg[at : at + 1] == b"\xff" and jpeg[at + 1 : at + 2] == b"\xff":
            at += 1  # fill bytes
        if at + 4 > len(jpeg) or jpeg[at] != 0xFF:
            raise ValueError("a frame is short")
        marker, length = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + length]
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quantisers[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.int64)
                k += 129 if wide else 65
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = body[k + 1 : k + 17]
                n = sum(counts)
                tables[body[k]] = _lookup(counts, body[k + 17 : k + 17 + n])
                k += 17 + n
        elif marker in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or not height or not width:
                raise ValueError("only samples of 8 bits are read")
            parts = [{"id": body[6 + 3 * k], "h": body[7 + 3 * k] >> 4, "v": body[7 + 3 * k] & 15, "q": body[8 + 3 * k]} for k in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline files are read")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            chosen = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            scan = [p | {"dc": tables[chosen[p["id"]] >> 4], "ac": tables[16 | chosen[p["id"]] & 15]} for p in parts if p["id"] in chosen]
            if not scan or len(scan) != len(parts):
                raise ValueError("only files of one scan are read")
            return _scan(jpeg[at + 2 + length :], scan, quantisers, height, width, restart)
        at += 2 + length


def _intervals(data: bytes) -> list[bytes]:
    """Entropy-coded data up to the next marker, parted at the restart markers."""
    out, start, at = [], 0, 0
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        code = data[at + 1]
        if 0xD0 <= code <= 0xD7:
            out.append(data[start:at])
            start = at + 2
        elif code:
            return [*out, data[start:at]]
        at += 2
    return [*out, data[start:]]


def _scan(data: bytes, scan: list[dict], quantisers: dict, height: int, width: int, restart: int) -> np.ndarray:
    most_h, most_v = max(p["h"] for p in scan), max(p["v"] for p in scan)
    if len(scan) == 1:
        scan[0]["h"] = scan[0]["v"] = most_h = most_v = 1
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    first = scan[0]
    blocks = np.zeros((down * first["v"], across * first["h"], 64), np.int64)
    intervals = iter(_intervals(data))
    bits, before = _Bits(next(intervals)), [0] * len(scan)
    for m in range(across * down):
        if restart and m and m % restart == 0:
            bits, before = _Bits(next(intervals, b"")), [0] * len(scan)
        row, column = divmod(m, across)
        for k, p in enumerate(scan):
            for v in range(p["v"]):
                for h in range(p["h"]):
                    block = [0] * 64
                    before[k] += bits.value(bits.symbol(p["dc"]))
                    block[0] = before[k]
                    at = 1
                    while at < 64:
                        code = bits.symbol(p["ac"])
                        run, size = code >> 4, code & 15
                        if not size:
                            if run != 15:
                                break  # end of block
                            at += 16
                            continue
                        at += run
                        if at > 63:
                            raise ValueError("coefficients run over a block")
                        block[at] = bits.value(size)
                        at += 1
                    if k == 0:
                        blocks[row * p["v"] + v, column * p["h"] + h] = block
    coded = blocks * quantisers[first["q"]]
    plain = np.zeros(coded.shape)
    plain[..., ZIGZAG] = coded
    n, m, _ = plain.shape
    cells = _BASIS.T @ plain.reshape(n, m, 8, 8) @ _BASIS
    image = np.clip(np.rint(cells + 128), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(n * 8, m * 8)
    own_height, own_width = -(-height * first["v"] // most_v), -(-width * first["h"] // most_h)
    return image[:own_height, :own_width]
