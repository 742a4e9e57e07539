"""Token-ID output: Arrow stream files of fixed-size-list batches.

A shard is three files. ``*.tokens.arrows`` is an Arrow IPC stream whose
rows are equal-length sequences: ``ids`` (fixed-size list of 16-bit ids) and
``mask``, the number of a row of ``*.masks.arrows``. Those rows are the shard's
distinct masks (fixed-size lists of bytes, 1 where an id is real), of which
there are two, so masks cost a byte a sequence. Every batch of sequences but
the last has the same number of rows, so all batches have one byte length and
sequence ``i`` is found by arithmetic in a memory map, without a footer; ids and
mask are views of the files. ``*.docs.arrows`` holds one row per document: its id, its
first id's place in the shard and its length. The manifest, a Parquet table, lists
the shards; ``Corpus`` numbers the sequences of all of them.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import AtomicFile, claim, open_fs, persist, prepare, read_table, shared_dir, table, text_or_empty

SEQ_LEN = 2048
BATCH_SEQUENCES = 32
END_ID = 2

DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "shard long, n_docs long, n_tokens long, n_sequences long, name string"


def sequence_schema(seq_len: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16(), seq_len)), ("mask", pa.uint8())])


def mask_schema(seq_len: int) -> pa.Schema:
    return pa.schema([("mask", pa.list_(pa.uint8(), seq_len))])


def shard_file(folder: str, name: str, kind: str) -> str:
    return f"{folder}/{name}.{kind}.arrows"


class ShardWriter:
    """Appends documents' ids to a shard; memory holds one batch at most."""

    def __init__(self, folder: str, name: str, seq_len: int = SEQ_LEN, batch: int = BATCH_SEQUENCES):
        self.seq_len, self.batch, self.schema = seq_len, batch, sequence_schema(seq_len)
        self.tokens = AtomicFile(shard_file(folder, name, "tokens"))
        self.docs = AtomicFile(shard_file(folder, name, "docs"))
        self.stream = pa.ipc.new_stream(self.tokens.out, self.schema)
        self.doc_stream = pa.ipc.new_stream(self.docs.out, DOCS)
        self.mask_file = AtomicFile(shard_file(folder, name, "masks"))
        self.masks: dict[bytes, int] = {}
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_tokens = self.n_docs = self.n_sequences = 0

    def _put(self, ids: np.ndarray, real: int) -> None:
        rows = len(ids) // self.seq_len
        mask = np.zeros(len(ids), np.uint8)
        mask[:real] = 1
        numbers = [self.masks.setdefault(m.tobytes(), len(self.masks)) for m in mask.reshape(rows, self.seq_len)]
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(ids, pa.uint16()), self.seq_len), pa.array(numbers, pa.uint8())]
        self.stream.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.n_sequences += rows

    def add(self, doc_ids: list, ids: list[np.ndarray]) -> None:
        lengths = [len(x) for x in ids]
        starts = [self.n_tokens, *accumulate(lengths, initial=self.n_tokens)][1:-1] if lengths else []
        self.doc_stream.write_batch(table(DOCS, doc_id=doc_ids, start=starts, n_tokens=lengths))
        self.n_tokens += sum(lengths)
        self.n_docs += len(lengths)
        self.waiting += ids
        self.n_waiting += sum(lengths)
        size = self.seq_len * self.batch
        if self.n_waiting >= size:
            flat = np.concatenate(self.waiting)
            whole = len(flat) // size * size
            for at in range(0, whole, size):
                self._put(flat[at : at + size], size)
            self.waiting, self.n_waiting = [flat[whole:]], len(flat) - whole

    def close(self) -> tuple[int, int, int]:
        if self.n_waiting:
            flat = np.concatenate(self.waiting)
            padded = np.zeros(-(-len(flat) // self.seq_len) * self.seq_len, np.uint16)
            padded[: len(flat)] = flat
            self._put(padded, len(flat))
        masks = pa.ipc.new_stream(self.mask_file.out, mask_schema(self.seq_len))
        masks.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(np.frombuffer(b"".join(self.masks), np.uint8)), self.seq_len)], names=["mask"]))
        for stream, file in ((self.stream, self.tokens), (self.doc_stream, self.docs), (masks, self.mask_file)):
            stream.close()
            file.close()
        return self.n_docs, self.n_tokens, self.n_sequences


class ShardReader:
    """Random access to the sequences of a shard, by arithmetic on batch places."""

    def __init__(self, folder: str, name: str):
        self.folder, self.name = folder, name
        self.file = self._open("tokens")
        self.masks = pa.ipc.open_stream(self._open("masks")).read_next_batch().column(0).values.to_numpy(zero_copy_only=True).view(bool)
        self.size = self.file.size()
        message = pa.ipc.read_message(self.file)
        self.schema = pa.ipc.read_schema(message)
        self.head = self.file.tell()
        self.seq_len = self.schema.field("ids").type.list_size
        self.stride = self.rows = 0
        self.at, self.held = -1, None
        if self.size > self.head + 8:
            first = pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema)
            self.stride, self.rows = self.file.tell() - self.head, first.num_rows

    def _open(self, kind: str):
        fs, path = open_fs(shard_file(self.folder, self.name, kind))
        return pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)

    def _batch(self, k: int) -> pa.RecordBatch:
        if k != self.at:
            self.file.seek(self.head + k * self.stride)
            self.held = pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema)
            self.at = k
        return self.held

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``, both views of the file."""
        batch, row = self._batch(i // self.rows), i % self.rows
        cut = slice(row * self.seq_len, (row + 1) * self.seq_len)
        ids = batch.column(0).values.to_numpy(zero_copy_only=True)[cut]
        mask = batch.column(1)[row].as_py()
        return ids, self.masks[mask * self.seq_len : (mask + 1) * self.seq_len]

    def ids(self, start: int, length: int) -> np.ndarray:
        """Ids ``start`` to ``start + length`` of the shard's token stream."""
        out, size = [], self.rows * self.seq_len
        while length:
            k, at = divmod(start, size)
            part = self._batch(k).column(0).values.to_numpy(zero_copy_only=True)[at : at + length]
            out.append(part)
            start, length = start + len(part), length - len(part)
        return np.concatenate(out) if len(out) != 1 else out[0]

    def documents(self) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(shard_file(self.folder, self.name, "docs"))
        with fs.open_input_stream(path) as f:
            yield from pa.ipc.open_stream(f)


class Corpus:
    """Sequences of all shards by one number, in the order of the documents.

    ``manifest`` has rows of (shard, documents, ids, sequences, name); the last sequence
    of a shard may be padded, as its mask says.
    """

    def __init__(self, folder: str, manifest: list):
        self.folder, self.shards = folder, [m for m in sorted(manifest) if m[3]]
        self.ends = list(accumulate(m[3] for m in self.shards))
        self.reader: ShardReader | None = None

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = bisect_right(self.ends, i)
        name = self.shards[k][4]
        if self.reader is None or self.reader.name != name:
            self.reader = ShardReader(self.folder, name)
        return self.reader.sequence(i - (self.ends[k] - self.shards[k][3]))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, seq_len: int = SEQ_LEN, shards: int | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) to shards in ascending doc_id order.

    Null text counts as empty (its document is the end id alone); a null doc_id
    sorts first; repeated ids keep all their rows, ordered by a hash of the text.
    Extra columns are ignored. The text is shuffled once, by range, before it is
    encoded, so encoding runs once and a repeated id may span shards. Returns the
    manifest (shard, documents, ids, sequences, name), a stored row per shard. Names are
    unique to the attempt that wrote the shard, so an attempt that runs late or again
    never touches files that the manifest names.
    """
    prepare(docs.sparkSession)
    path = tokenizer or bpe.default_path()
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(), F.xxhash64("text").alias("tie"))
    n = shards or max(1, narrow.rdd.getNumPartitions())
    ordered = narrow.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches):
        claim("bpe")
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:07d}-{uuid.uuid4().hex[:12]}"
        writer, enc, end = ShardWriter(folder, name, seq_len), bpe.encoder(path), np.array([end_id], "<u2").tobytes()
        for batch in batches:
            texts = batch.column(1)
            ids = [np.frombuffer(enc.encode(texts[i].as_py()) + end, "<u2") for i in range(batch.num_rows)]
            writer.add(batch.column(0).to_pylist(), ids)
        docs_, tokens, sequences = writer.close()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [docs_], "n_tokens": [tokens], "n_sequences": [sequences], "name": [name]})

    return persist(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32,
    shard, shard_start. ``start`` counts all ids of documents before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    bases = persist(manifest.filter("n_docs > 0").select("shard", "name", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")), "token-bases")
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int64()), ("shard_start", pa.int64())])

    def read(batches):
        claim()
        for batch in batches:
            for shard, name, base in zip(*(c.to_pylist() for c in batch.columns)):
                reader = ShardReader(folder, name)
                for docs in reader.documents():
                    starts, lengths = docs.column(1).to_pylist(), docs.column(2).to_pylist()
                    crcs = [zlib.crc32(reader.ids(s, n).astype("<u4").tobytes()) for s, n in zip(starts, lengths)]
                    yield table(out, doc_id=docs.column(0), start=[s + base for s in starts], n_tokens=docs.column(2), ids_crc32=crcs, shard=[shard] * len(starts), shard_start=docs.column(1))

    tasks = max(1, bases.count())
    return bases.repartition(tasks, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, shard_start long")


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    """Encode all documents, write token files, return what the files hold."""
    folder = shared_dir(spark, "token-files")
    manifest = write_token_files(read_table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder, manifest)
