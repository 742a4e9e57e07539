"""WARC archives read through their index.

Writing: each task writes its records as gzip members of one archive and yields
an index row per record (file, offset, length, URL, digest, page). The index is
kept as Parquet. Reading: records are selected on the index alone; their byte
ranges are sorted by file and offset, neighbours are joined into one read, and
only those bytes are fetched.

Deduplication: of equal payloads the one with the largest page_id is stored as
``response``; the others are ``revisit`` records that hold headers only.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import AtomicFile, open_fs, persist, prepare, read_table, shared_dir, table

DATE = "2024-01-01T00:00:00Z"
#: Ranges closer than this are fetched in one read, up to MAX_READ bytes.
GAP, MAX_READ = 64 << 10, 8 << 20
#: Bytes after which a task starts another archive.
ARCHIVE_BYTES = 256 << 20

INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())])
INDEX_DDL = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
RECORDS_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]+", lambda m: "".join(f"%{ord(c):02X}" for c in m[0]), value)


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """An uncompressed WARC/1.1 record and the payload's digest."""
    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Page-Refers-To: {refers_to}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def gzip_member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parse_record(data: bytes) -> dict:
    """The fields of a record; length and digest of a response are recomputed."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = warc.get("page-id")
    found = {"page_id": int(page) if page is not None else None, "record_type": warc["warc-type"], "url": warc.get("warc-target-uri")}
    if found["record_type"] == "revisit":
        found |= {"payload_bytes": int(_fields(http)["content-length"]), "payload_digest": warc["warc-payload-digest"].removeprefix("sha1:"), "refers_to": int(warc["page-refers-to"]), "payload": None}
    else:
        found |= {"payload_bytes": len(payload), "payload_digest": digest32(payload), "refers_to": None, "payload": payload}
        if found["payload_digest"] != warc["warc-payload-digest"].removeprefix("sha1:"):
            raise ValueError(f"digest mismatch in record of page {page}")
    return found


def with_keeper(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with ``refers_to``: the page that stores the
    same payload, null where this page stores it.

    Digests are grouped without the payloads (map-side combined, so a payload of a
    third of all pages is one row per task), and meet their group as narrow rows (page,
    digest) in a join whose skewed partitions the engine can split. The payloads are
    shuffled by page and digest, never by the digest alone. A null page_id
    cannot be referred to: such a page always stores its payload. Equal largest ids
    (repeated rows) all store it.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("sha", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    narrow = rows.select("page_id", "sha")
    groups = narrow.groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "keeper")
    revisits = narrow.join(groups, "sha").filter("page_id < keeper").distinct()
    met = rows.join(revisits, ["page_id", "sha"], "left")
    return met.select("page_id", "url", "html", F.col("keeper").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of ``with_keeper`` output; the index as Parquet.

    A null url gives a record without target; line breaks in it are escaped.
    File names are unique to a task attempt, so a task that runs again after a
    lost executor never changes bytes that a kept index row points to.
    """
    prepare(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]):
        file = None
        for batch in batches:
            rows = {f.name: [] for f in INDEX}
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if file is None or file.size >= ARCHIVE_BYTES:
                    if file is not None:
                        file.close()
                    uri = f"{folder}/archives/{uuid.uuid4().hex}.warc.gz"
                    file = AtomicFile(uri)
                data, digest = build_record(page_id, url, html.encode("utf-8", "replace"), refers_to)
                offset = file.size
                length = file.write(gzip_member(data))
                for k, v in (("file", uri), ("offset", offset), ("length", length), ("url", url), ("digest", digest), ("page_id", page_id), ("record_type", "response" if refers_to is None else "revisit")):
                    rows[k].append(v)
            yield table(INDEX, **rows)
        if file is not None:
            file.close()

    index = pages.select("page_id", "url", "html", "refers_to").mapInArrow(write, INDEX_DDL)
    return persist(index, "warc-index")


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP, most: int = MAX_READ) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Coalesce sorted (file, offset, length) into (file, start, end, members)."""
    held: list | None = None
    for file, offset, length in rows:
        if held and held[0] == file and offset - held[2] <= gap and offset + length - held[1] <= most:
            held[2] = max(held[2], offset + length)
            held[3].append((offset, length))
        else:
            if held:
                yield tuple(held)
            held = [file, offset, offset + length, [(offset, length)]]
    if held:
        yield tuple(held)


def read_records(index: DataFrame, where: Column | None = None, payloads: bool = True) -> DataFrame:
    """The records that ``where`` selects on the index, by coalesced range reads.

    The index is range-partitioned by (file, offset), so one archive may be read
    by several tasks, each its own contiguous stretch.
    """
    prepare(index.sparkSession)
    chosen = index if where is None else index.filter(where)
    ordered = chosen.select("file", "offset", "length").repartitionByRange(max(1, chosen.rdd.getNumPartitions()), "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]):
        held, opened = None, None
        for batch in batches:
            out = {f.name: [] for f in RECORDS}
            size = 0
            for uri, start, end, members in ranges(list(zip(*(c.to_pylist() for c in batch.columns)))):
                if uri != opened:
                    fs, path = open_fs(uri)
                    held, opened = fs.open_input_file(path), uri
                data = held.read_at(end - start, start)
                for offset, length in members:
                    record = parse_record(zlib.decompress(data[offset - start : offset - start + length], 31))
                    if not payloads:
                        record["payload"] = None
                    size += len(record["payload"] or b"")
                    for k, v in record.items():
                        out[k].append(v)
                    if size > MAX_READ:
                        yield table(RECORDS, **out)
                        out, size = {f.name: [] for f in RECORDS}, 0
            if out["page_id"]:
                yield table(RECORDS, **out)

    return ordered.mapInArrow(read, RECORDS_DDL)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """Archive all pages, read every record back through the index."""
    index = write_archives(with_keeper(read_table(spark, sf_dir, "pages")), shared_dir(spark, "warc"))
    return read_records(index, payloads=False).drop("payload", "url")
