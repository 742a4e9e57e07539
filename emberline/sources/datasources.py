"""Python data sources: record files, a message log that is polled, and a segment store.

``register(spark)`` makes the formats known:

* ``record_files`` reads Markdown files below a folder in partitions of bounded bytes, opens only what
  the asked columns need, and writes each record by a temporary file, fsync and an atomic rename.
* ``message_log`` is an append-only log of messages with growing ids; as a stream its offset is the last
  id, and a batch's partitions are the log's files in that range.
* ``segment_store`` replaces all rows of an id at once: tasks stage files that no reader sees, and the
  commit names them in a new manifest. A failed write leaves nothing behind but unnamed files.

Folders are URIs that the driver and all executors share.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

#: Bytes and files of a read partition.
PART_BYTES, PART_FILES = 16 << 20, 2_000


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def write_atomic(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """All or nothing: a temporary file in the same folder, synced where the store is local, then renamed."""
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as f:
        f.write(data)
    if isinstance(fs, pafs.LocalFileSystem):
        with open(part, "rb") as f:
            os.fsync(f.fileno())
    fs.move(part, path)


def files_below(uri: str, ending: str) -> list[pafs.FileInfo]:
    fs, path = open_folder(uri)
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((f for f in found if f.is_file and f.path.endswith(ending)), key=lambda f: f.path)


# --- record files ---------------------------------------------------------------


class Files(InputPartition):
    def __init__(self, names: list[tuple[str, int, int]]):
        self.names = names


def head_of(read, size: int = 4096) -> str:
    """The front matter, read in steps up to its closing line; the whole text without one."""
    data = b""
    while block := read(size):
        data += block
        end = data.find(b"\n---", 3)
        if data.startswith(b"---") and end >= 0 and data.find(b"\n", end + 1) >= 0:
            return data[: data.find(b"\n", end + 1) + 1].decode("utf-8", "replace")
    return data.decode("utf-8", "replace")


class RecordReader(DataSourceReader):
    """Partitions of whole files; the folder below the root is the record's ``root``."""

    def __init__(self, uri: str, columns: list[str], whole: str):
        self.uri, self.columns, self.whole, self.roots = uri, columns, whole, None

    def pushFilters(self, filters):
        """A filter on ``root`` leaves the other folders unlisted."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("root",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.roots = asked if self.roots is None else self.roots & asked
            else:
                yield f

    def partitions(self):
        every = self.roots
        infos = files_below(self.uri, ".md") if every is None else [f for r in sorted(every) for f in files_below(f"{self.uri}/{r}", ".md")]
        out, held, size = [], [], 0
        for f in infos:
            held.append((f.path, f.size, f.mtime_ns or 0))
            size += f.size
            if size >= PART_BYTES or len(held) >= PART_FILES:
                out.append(Files(held))
                held, size = [], 0
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, base = open_folder(self.uri)
        for path, size, mtime in partition.names:
            row = {"path": path[len(base) :].lstrip("/"), "size": size, "modified_ns": mtime}
            row["root"] = row["path"].partition("/")[0]
            if "text" in self.columns or "head" in self.columns:
                with fs.open_input_stream(path) as f:
                    if "text" in self.columns:
                        row["text"] = f.read().decode("utf-8", "replace")
                    if "head" in self.columns:
                        row["head"] = head_of(f.read) if "text" not in row else row["text"]
            yield tuple(row.get(c) for c in self.columns)


class RecordWriter(DataSourceWriter):
    def __init__(self, uri: str):
        self.uri = uri

    def write(self, iterator):
        fs, base = open_folder(self.uri)
        for row in iterator:
            write_atomic(fs, f"{base}/{row.path}", row.text.encode())
        return WriterCommitMessage()


class RecordFiles(DataSource):
    @classmethod
    def name(cls):
        return "record_files"

    def schema(self):
        return "path string, root string, size long, modified_ns long, head string, text string"

    def reader(self, schema):
        return RecordReader(self.options["path"], schema.names, self.options.get("whole", ""))

    def writer(self, schema, overwrite):
        return RecordWriter(self.options["path"])


# --- the message log --------------------------------------------------------------


class Range(InputPartition):
    def __init__(self, path: str, after: int, upto: int):
        self.path, self.after, self.upto = path, after, upto


class LogStream(DataSourceStreamReader):
    """Offsets are message ids; what is appended must have larger ids than what is there."""

    def __init__(self, uri: str, after: int):
        self.uri, self.after = uri, after

    def initialOffset(self):
        return {"id": self.after}

    def _files(self) -> list[tuple[int, int, str]]:
        named = [(f.path, f.path.rpartition("/")[2].split("-")) for f in files_below(self.uri, ".jsonl")]
        return [(int(n[0]), int(n[1]), path) for path, n in named]

    def latestOffset(self):
        return {"id": max([self.after, *(last for _, last, _ in self._files())])}

    def partitions(self, start, end):
        return [Range(path, start["id"], end["id"]) for first, last, path in self._files() if last > start["id"] and first <= end["id"]]

    def read(self, partition: Range):
        fs, _ = open_folder(self.uri)
        with fs.open_input_stream(partition.path) as f:
            for line in f.read().decode().splitlines():
                row = json.loads(line)
                if partition.after < row["id"] <= partition.upto:
                    yield row["id"], row["body"]

    def commit(self, end):
        """Nothing is dropped: other readers have cursors of their own."""


class LogWriter(DataSourceWriter):
    """A file for each task, named by its first and last id; files of a few thousand messages."""

    MOST = 5_000

    def __init__(self, uri: str):
        self.uri = uri

    def write(self, iterator):
        fs, base = open_folder(self.uri)
        held: list[tuple[int, str]] = []

        def flush() -> None:
            held.sort()
            lines = "".join(json.dumps({"id": i, "body": b}, ensure_ascii=False) + "\n" for i, b in held)
            write_atomic(fs, f"{base}/{held[0][0]:020d}-{held[-1][0]:020d}-{uuid.uuid4().hex}.jsonl", lines.encode())
            held.clear()

        for row in iterator:
            held.append((row.id, row.body))
            if len(held) >= self.MOST:
                flush()
        if held:
            flush()
        return WriterCommitMessage()


class MessageLog(DataSource):
    @classmethod
    def name(cls):
        return "message_log"

    def schema(self):
        return "id long, body string"

    def streamReader(self, schema):
        return LogStream(self.options["path"], int(self.options.get("after", -1)))

    def writer(self, schema, overwrite):
        return LogWriter(self.options["path"])


# --- the segment store --------------------------------------------------------------

SEGMENT = "id long, segment int, vec array<double>, body string"
ARROW = pa.schema([("id", pa.int64()), ("segment", pa.int32()), ("vec", pa.list_(pa.float64())), ("body", pa.string())])
#: The segment number of a row that only says that its id has none.
GONE = -1


class Staged(WriterCommitMessage):
    def __init__(self, name: str | None, rows: int):
        self.name, self.rows = name, rows


def manifests(uri: str) -> list[tuple[int, list[str]]]:
    """(number, files) of each commit, oldest first."""
    fs, _ = open_folder(uri)
    out = []
    for f in files_below(f"{uri}/manifest", ".json"):
        with fs.open_input_stream(f.path) as s:
            out.append((int(f.path.rpartition("/")[2][:-5]), json.loads(s.read())["files"]))
    return out


class SegmentWriter(DataSourceArrowWriter):
    """Phase one: each task writes one file that no manifest names. Phase two: the driver names
    the files of all tasks in the next manifest, which appears at once. One writer at a time."""

    def __init__(self, uri: str):
        self.uri, self.attempt = uri, uuid.uuid4().hex

    def write(self, iterator):
        fs, base = open_folder(self.uri)
        name, rows, out = f"data/{self.attempt}-{uuid.uuid4().hex}.parquet", 0, None
        fs.create_dir(f"{base}/data", recursive=True)
        for batch in iterator:
            if out is None:
                out = pq.ParquetWriter(f"{base}/{name}", ARROW, filesystem=fs)
            out.write_batch(batch.cast(ARROW))
            rows += batch.num_rows
        if out is None:
            return Staged(None, 0)
        out.close()
        return Staged(name, rows)

    def commit(self, messages):
        fs, base = open_folder(self.uri)
        number = max([0, *(n for n, _ in manifests(self.uri))]) + 1
        files = [m.name for m in messages if m and m.name]
        write_atomic(fs, f"{base}/manifest/{number:010d}.json", json.dumps({"files": files}).encode())

    def abort(self, messages):
        fs, base = open_folder(self.uri)
        for f in files_below(f"{self.uri}/data", ".parquet"):
            if f.path.rpartition("/")[2].startswith(self.attempt):
                fs.delete_file(f.path)


class Committed(InputPartition):
    def __init__(self, number: int, name: str):
        self.number, self.name = number, name


class SegmentReader(DataSourceReader):
    def __init__(self, uri: str, columns: list[str]):
        self.uri, self.columns = uri, columns

    def partitions(self):
        return [Committed(n, f) for n, files in manifests(self.uri) for f in files] or [Committed(0, "")]

    def read(self, partition: Committed):
        fs, base = open_folder(self.uri)
        if not partition.name:
            return
        stored = [c for c in self.columns if c != "commit"]  # of the file only these columns are read
        for batch in pq.ParquetFile(f"{base}/{partition.name}", filesystem=fs).iter_batches(columns=stored or ["id"]):
            number = pa.array([partition.number] * batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([number if c == "commit" else batch.column(batch.schema.names.index(c)) for c in self.columns], names=self.columns)


class SegmentStore(DataSource):
    @classmethod
    def name(cls):
        return "segment_store"

    def schema(self):
        return f"{SEGMENT}, commit long"

    def reader(self, schema):
        return SegmentReader(self.options["path"], schema.names)

    def writer(self, schema, overwrite):
        return SegmentWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # record_files prunes folders by it
    for source in (RecordFiles, MessageLog, SegmentStore):
        spark.dataSource.register(source)


def record_files(spark: SparkSession, uri: str, columns: str = "path string, root string, size long, modified_ns long, head string, text string") -> DataFrame:
    """Files below a folder. Only asked columns are made: without ``text`` no body is read, without
    ``head`` too no file is opened."""
    register(spark)
    return spark.read.format("record_files").schema(columns).option("path", uri).load()


def segments(spark: SparkSession, uri: str) -> DataFrame:
    """(id, segment, vec, body) of the store: the rows of each id's last commit."""
    register(spark)
    every = spark.read.format("segment_store").option("path", uri).load()
    last = spark.read.format("segment_store").schema("id long, commit long").option("path", uri).load().groupBy("id").agg(F.max("commit").alias("commit"))
    return every.join(last, ["id", "commit"]).filter(F.col("segment") != GONE).select("id", "segment", "vec", "body")


def replace_segments(rows: DataFrame, uri: str) -> None:
    """Replace all segments of the ids in ``rows`` (id, segment, vec, body) in one commit."""
    register(rows.sparkSession)
    rows.select(*[F.col(c).cast(t).alias(c) for c, t in (("id", "long"), ("segment", "int"), ("vec", "array<double>"), ("body", "string"))]).write.format("segment_store").mode("append").option("path", uri).save()
