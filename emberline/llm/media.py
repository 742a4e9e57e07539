"""Media columns: AVI files of motion JPEG that carry 8-bit samples.

A payload is cut into frames of 24 x 24 samples. Each sample is one flat 8 x 8
block of a baseline grey JPEG: with a quantiser of 8 the DC coefficient is the
sample less 128 and decoding is exact. The DC table gives category c a code of
9 - c bits, so code and value bits are 9 for every difference; with a one-bit
end-of-block each block takes ten bits, and both directions are array lookups.
Frames are found through the RIFF index (idx1); those of other encoders go through
a baseline decoder, one frame at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import prepare, read_table, table

SIDE = 24
SAMPLES = SIDE * SIDE
FPS = 25
PAD = 255
#: Frames coded at once (bounded memory for texts of any length).
CHUNK = 2048
#: Shot rule: a cut where the histogram difference is over the floor and over
#: mean + SPREAD * deviation of the differences in the last WINDOW frames.
BINS, WINDOW, SPREAD, FLOOR = 16, 12, 3.0, 0.12


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head() -> bytes:
    side = SIDE * 8
    dc_counts = bytes([1] * 9 + [0] * 7)  # one code each of 1 to 9 bits: categories 8 to 0
    ac_counts = bytes([1] + [0] * 15)
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\x00" + bytes([8] * 64))
        + _segment(0xC0, struct.pack(">BHHBBBB", 8, side, side, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\x00" + dc_counts + bytes(range(8, -1, -1)))
        + _segment(0xC4, b"\x10" + ac_counts + b"\x00")
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


HEAD, TAIL = _jpeg_head(), b"\xff\xd9"


@lru_cache(maxsize=8)
def _block_codes(categories: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ten-bit code of each difference (index + 255), and its inverse.

    ``categories`` lists the DC table's symbols by code length 1, 2, ...
    """
    codes, values = np.zeros(511, np.uint64), np.full(1024, -(1 << 15), np.int16)
    for k, c in enumerate(categories):
        length = k + 1
        if length + c != 9:
            raise ValueError("only tables with blocks of equal length are read")
        prefix = (1 << length) - 2
        for bits in range(1 << c):
            d = bits if c == 0 or bits >> (c - 1) else bits - (1 << c) + 1
            code = ((prefix << c) | bits) << 1
            codes[d + 255] = code
            values[code] = d
    return codes, values


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of frames, an array of (n, 576) bytes."""
    codes, _ = _block_codes(bytes(range(8, -1, -1)))
    out = []
    for at in range(0, len(samples), CHUNK):
        dc = samples[at : at + CHUNK].astype(np.int16) - 128
        diff = np.empty_like(dc)
        diff[:, 0] = dc[:, 0]
        np.subtract(dc[:, 1:], dc[:, :-1], out=diff[:, 1:])
        c = codes[diff + 255].reshape(len(dc), SAMPLES // 4, 4)
        word = (c[..., 0] << np.uint64(30)) | (c[..., 1] << np.uint64(20)) | (c[..., 2] << np.uint64(10)) | c[..., 3]
        data = np.ascontiguousarray(word.astype(">u8").view(np.uint8).reshape(len(dc), SAMPLES // 4, 8)[..., 3:]).tobytes()
        size = SAMPLES * 10 // 8
        out += [HEAD + data[i * size : (i + 1) * size].replace(b"\xff", b"\xff\x00") + TAIL for i in range(len(dc))]
    return out


def _tables(frame: bytes) -> tuple[int, bytes]:
    """Where the coded data start, and the DC symbols by code length."""
    at, categories, quantiser, side = 2, b"", 0, 0
    while True:
        marker, length = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + length]
        if marker == 0xDB:
            quantiser = body[1]
        elif marker == 0xC0:
            side = struct.unpack_from(">H", body, 1)[0]
        elif marker == 0xC4 and body[0] == 0:
            if body[1:17].rstrip(b"\x00") != bytes([1] * 9):
                raise ValueError("only tables with blocks of equal length are read")
            categories = body[17:]
        elif marker == 0xDA:
            if quantiser != 8 or side != SIDE * 8:
                raise ValueError("not a frame of flat blocks")
            return at + 2 + length, categories
        at += 2 + length


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Samples (n, 576) of JPEG frames that ``encode_frames`` made."""
    out = np.empty((len(frames), SAMPLES), np.uint8)
    size = SAMPLES * 10 // 8
    for at in range(0, len(frames), CHUNK):
        part = frames[at : at + CHUNK]
        start, categories = _tables(part[0])
        head = part[0][:start]
        data = bytearray()
        for f in part:
            if not f.startswith(head):
                raise ValueError("frames of one file share their tables")
            data += f[start:-2].replace(b"\xff\x00", b"\xff")
        if len(data) != size * len(part):
            raise ValueError("a frame is short")
        wide = np.zeros((len(part) * SAMPLES // 4, 8), np.uint8)
        wide[:, 3:] = np.frombuffer(bytes(data), np.uint8).reshape(-1, 5)
        word = wide.view(">u8").astype(np.uint64).ravel()
        code = np.empty((len(word), 4), np.int64)
        for k in range(4):
            code[:, k] = (word >> np.uint64(30 - 10 * k)) & np.uint64(1023)
        diff = _block_codes(categories)[1][code.reshape(len(part), SAMPLES)]
        out[at : at + len(part)] = np.cumsum(diff, axis=1, dtype=np.int16) + 128
    return out


def build_avi(frames: list[bytes]) -> bytes:
    """A RIFF AVI file: headers, movie list and index."""
    side, most = SIDE * 8, max(map(len, frames))
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, side, side, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 8, b"MJPG", side * side, 0, 0, 0, 0)
    hdrl = b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body = chunk(b"00dc", f)
        movi.append(body)
        at += len(body)
    body = b"AVI " + chunk(b"LIST", hdrl) + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def index_of(avi: bytes) -> list[tuple[int, int]]:
    """(offset, length) of each frame, from the RIFF index."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, entries = 12, None, None
    while at + 8 <= len(avi):
        name, length = struct.unpack_from("<4sI", avi, at)
        if name == b"LIST" and avi[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            entries = np.frombuffer(avi, "<u4", length // 4, at + 8).reshape(-1, 4)
        at += 8 + length + length % 2
    if movi is None or entries is None:
        raise ValueError("the file has no index")
    # video chunks alone; places count from the list, or, in some files, from the start
    kind = entries[:, 0].astype("<u4").view("S4")
    video = np.array([k[2:4] in (b"dc", b"db") for k in kind.tolist()], bool) & (entries[:, 3] > 0)
    base = 8 if len(entries) and int(entries[0, 2]) >= movi else movi + 8
    return [(base + int(o), int(n)) for o, n in entries[video, 2:]]


def rate_of(avi: bytes) -> float:
    """Frames a second, by the main header; FPS if it has none."""
    at = avi.find(b"avih", 0, 4096)
    micros = struct.unpack_from("<I", avi, at + 8)[0] if at > 0 else 0
    return 1_000_000 / micros if micros else float(FPS)


def encode_media(payload: bytes) -> bytes:
    """The AVI file of a payload, padded with 255 to a positive multiple of 576."""
    padded = payload + bytes([PAD]) * (-len(payload) % SAMPLES if payload else SAMPLES)
    return build_avi(encode_frames(np.frombuffer(padded, np.uint8).reshape(-1, SAMPLES)))


def decode_media(avi: bytes) -> np.ndarray:
    """Samples (frames, samples of a frame) of an AVI file of motion JPEG.

    Files of this writer take the array way; any other baseline frames, all of one
    size, are decoded one by one to their luma.
    """
    frames = [avi[o : o + n] for o, n in index_of(avi)]
    if frames and frames[0].startswith(HEAD):
        return decode_frames(frames)
    images = [jpeg.decode(f) for f in frames]
    if len({x.shape for x in images}) > 1:
        raise ValueError("frames of one file have one size")
    return np.stack([x.ravel() for x in images]) if images else np.zeros((0, 1), np.uint8)


def shots(frames: np.ndarray) -> list[tuple[int, int]]:
    """Shots as (first frame, end), cut where histograms differ unusually."""
    n = len(frames)
    if not n:
        return []
    place = (frames >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    hist = np.bincount(place.ravel(), minlength=n * BINS).reshape(n, BINS)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * frames.shape[1])
    total, squares = np.concatenate([[0.0], np.cumsum(diff)]), np.concatenate([[0.0], np.cumsum(diff * diff)])
    k = np.arange(len(diff))
    low = np.maximum(0, k - WINDOW)
    count = np.maximum(1, k - low)
    mean = (total[k] - total[low]) / count
    dev = np.sqrt(np.maximum(0.0, (squares[k] - squares[low]) / count - mean * mean))
    cut = np.flatnonzero((diff > FLOOR) & (diff > mean + SPREAD * dev)) + 1
    edges = [0, *cut.tolist(), n]
    return list(zip(edges[:-1], edges[1:]))


MEDIA_DDL = "doc_id long, n_bytes long, media binary"
MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
#: Media bytes handed on in one Arrow batch.
OUT_BYTES = 8 << 20


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media, an AVI file, for each row.

    Null text is empty: one frame of padding. Extra columns are ignored; null and
    repeated ids keep their rows.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids, sizes, files, size = [], [], [], 0
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                payload = batch.column(1)[i].as_py().encode("utf-8", "replace")
                ids.append(doc_id)
                sizes.append(len(payload))
                files.append(encode_media(payload))
                size += len(files[-1])
                if size >= OUT_BYTES:
                    yield table(MEDIA, doc_id=ids, n_bytes=sizes, media=files)
                    ids, sizes, files, size = [], [], [], 0
            if ids:
                yield table(MEDIA, doc_id=ids, n_bytes=sizes, media=files)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, MEDIA_DDL)


CLIPS = pa.schema([("doc_id", pa.int64()), ("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("n_frames", pa.int64()), ("mean", pa.float64())])


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows: one per shot of each media file; null media give none."""
    prepare(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = {f.name: [] for f in CLIPS}
            for doc_id, avi in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not avi.is_valid:
                    continue
                data = avi.as_py()
                frames, fps = decode_media(data), rate_of(data)
                for k, (a, b) in enumerate(shots(frames)):
                    for name, value in zip(rows, (doc_id, k, a / fps, b / fps, b - a, float(frames[a:b].mean()))):
                        rows[name].append(value)
            yield table(CLIPS, **rows)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip int, start_s double, end_s double, n_frames long, mean double")


FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
FEATURES_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """Read each media file back; digests of its samples, and its shots."""
    prepare(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = {f.name: [] for f in FEATURES}
            for doc_id, n_bytes, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                avi = cell.as_py()
                frames = decode_media(avi)
                payload = frames.tobytes()
                found = shots(frames)
                feature = f"frames={len(frames)};shots={len(found)};longest={max(b - a for a, b in found)};cuts={','.join(str(a) for a, _ in found[1:])}"
                for name, value in zip(rows, (doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(avi), hashlib.sha256(avi).hexdigest(), feature)):
                    rows[name].append(value)
            yield table(FEATURES, **rows)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES_DDL)


def op7_media(spark, sf_dir: str) -> DataFrame:
    """Store every text as motion JPEG and read it back."""
    return media_features(to_media(read_table(spark, sf_dir, "documents")))
