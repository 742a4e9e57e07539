"""Token counts of whole texts; huge texts are read in overlapping chunks.

A byte-level vocabulary splits a text by one pattern, from left to right, and what it
finds from a place on depends only on the text from there on. So two readings that
both have a boundary of the pattern at place x agree on all that follows, and the
reading of a chunk is proven up to GUARD characters before its end: no alternative of
the pattern looks further ahead than two characters, and a special string that starts
before such a boundary ends inside the chunk.

A huge text becomes chunks that overlap. Each is encoded with offsets, as a row of its own that
any task may take. Chunk k is proven from its splice with the chunk before it on; it and the
next are spliced at the last boundary that both have in their overlap, before the
guard. Where they have none (one run of letters or blanks covers the overlap), the
text is read again in chunks and overlaps that are WIDEN times wider, until it is
spliced throughout or fits one chunk.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import default_path, encoder
from .common import claim, kept, persist, prepare, read_table, text_or_empty

#: Characters of a chunk and of an overlap of the first reading; how much wider each next one is.
CHUNK, OVERLAP, WIDEN = 32_768, 256, 8
#: Characters at a chunk's end whose reading is not proven, beside the longest special string.
GUARD = 3
#: More tokens than this are over the limit.
LIMIT = 512
#: Chunks of a task in the mean.
CHUNKS_A_TASK = 32

_readers: dict[str, "Reader"] = {}


def reader(path: str) -> "Reader":
    """The worker's reader of a vocabulary file, kept from task to task."""
    if path not in _readers:
        _readers[path] = Reader(path)
        kept("token-counts", _readers)
    return _readers[path]


class Reader:
    """Counts as the file's own library gives them, and boundaries of its pattern.

    ``spliced`` says if chunks can be proven: the file is a byte-level vocabulary with
    the library's own pattern and no normaliser. All other files read whole texts.
    """

    def __init__(self, path: str):
        self.spliced = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda text: len(model.encode(text))
            return
        from tokenizers import Tokenizer, processors

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        said = json.loads(self.tokenizer.to_str())
        split, added = said["pre_tokenizer"] or {}, said["added_tokens"]
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in added)
        self.spliced = plain and said["normalizer"] is None and said["model"]["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.count = lambda text: len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.spliced:
            self.guard = GUARD + max((len(t["content"]) for t in added), default=0)
            self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
            if self.tokenizer.get_vocab_size() <= 65536:
                table = encoder(path)  # the same ids, by units that repeat in a corpus
                self.count = lambda text: len(table.encode(text)) // 2

    def boundaries(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """(tokens, places where the pattern starts a piece, tokens before each)."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        words = np.array([-1 if w is None else w for w in found.word_ids], np.int64)
        at = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (words[1:] < 0)]))[: len(words)]
        starts = np.array([a for a, _ in found.offsets], np.int64)
        return len(words), starts[at], at


def cuts(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of a text's chunks: each starts ``overlap`` characters before the end of the one before."""
    out, start = [], 0
    while True:
        end = min(length, start + chunk)
        out.append((start, end))
        if end == length:
            return out
        start = end - overlap


FIRST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("text", pa.string())])
PIECE = pa.schema([("uid", pa.int64()), ("k", pa.int64()), ("last", pa.bool_()), ("start", pa.int64()), ("text", pa.string())])
READ = "uid long, k long, last boolean, tokens long, head_at array<long>, head_n array<long>, tail_at array<long>, tail_n array<long>"


def _spliced(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """uid, n_tokens of each text, read in chunks; null where a splice isn't found."""

    def cut(batches):
        claim()
        for batch in batches:
            for uid, text in zip(*(c.to_pylist() for c in batch.columns)):
                places = cuts(len(text), chunk, overlap)
                for k, (a, b) in enumerate(places):
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((uid, k, k + 1 == len(places), a, text[a:b]), PIECE)], schema=PIECE)

    read = pa.schema([("uid", pa.int64()), ("k", pa.int64()), ("last", pa.bool_()), ("tokens", pa.int64()), *[(n, pa.list_(pa.int64())) for n in ("head_at", "head_n", "tail_at", "tail_n")]])

    def encode(batches):
        claim("token-counts", "bpe")
        how = reader(path)
        for batch in batches:
            rows = []
            for uid, k, last, start, text in zip(*(c.to_pylist() for c in batch.columns)):
                tokens, place, before = how.boundaries(text)
                head = (place < overlap) & (k > 0)
                tail = (place >= len(text) - overlap) & (place <= len(text) - how.guard) & (not last)
                rows.append((uid, k, last, tokens, start + place[head], before[head], start + place[tail], before[tail]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), read)], schema=read)

    pieces = texts.select("uid", "text").mapInArrow(cut, "uid long, k long, last boolean, start long, text string")
    tasks = max(1, -(-int(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // (chunk * CHUNKS_A_TASK)))
    told = pieces.repartition(tasks, "uid", "k").mapInArrow(encode, READ)
    pairs = lambda at, n: F.arrays_zip(F.col(at).alias("place"), F.col(n).alias("before"))
    order = Window.partitionBy("uid").orderBy("k")
    # a row holds a chunk's boundaries in its overlaps; the next chunk's head comes from the next row
    met = told.select("uid", "k", "last", "tokens", F.lead(pairs("head_at", "head_n")).over(order).alias("next"), pairs("tail_at", "tail_n").alias("tail"))
    common = F.array_intersect(F.transform("tail", lambda t: t["place"]), F.transform("next", lambda t: t["place"]))
    found = met.withColumn("at", F.array_max(common))
    tokens_at = lambda side: F.element_at(F.transform(F.filter(side, lambda t: t["place"] == F.col("at")), lambda t: t["before"]), 1)
    # tokens before the splice are the chunk's own, less those of the next chunk before it
    share = F.when(F.col("last"), F.col("tokens")).otherwise(F.when(F.col("at").isNotNull(), tokens_at("tail") - tokens_at("next")))
    counted = found.select("uid", share.alias("share")).groupBy("uid")
    return counted.agg(F.when(F.count("share") == F.count(F.lit(1)), F.sum("share")).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row's whole text.

    Counts are those of the file's library (tokenizers for .json, sentencepiece for
    .model) without begin, end or added special tokens; special strings inside a text
    are read as the library does by default. A null text is empty: no bytes, no tokens.
    Rows without doc_id and of repeated ids are rows of their own; other columns are
    ignored. Texts up to ``chunk`` characters are read at once; longer ones in chunks,
    if the vocabulary allows a proof (see ``Reader``), else whole as well.
    """
    prepare(docs.sparkSession)
    path = path or default_path()
    huge = chunk if Reader(path).spliced else None

    def count(batches):
        claim("token-counts", "bpe")
        how = reader(path)
        for batch in batches:
            text = batch.column(1)
            size = pa.compute.binary_length(text.cast(pa.binary())).cast(pa.int64())
            texts = text.to_pylist()
            long = [huge is not None and len(t) > huge for t in texts]
            tokens = [None if far else how.count(t) for t, far in zip(texts, long)]
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(tokens, pa.int64()), pa.array([t if far else None for t, far in zip(texts, long)], pa.string())], schema=FIRST)

    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, text string")
    first = persist(first.withColumn("uid", F.monotonically_increasing_id()), "token-counts")
    done, waiting = first.filter("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens"), first.filter("n_tokens is null")
    while not waiting.isEmpty():  # ends: chunks grow until a text fits one
        read = _spliced(waiting, path, chunk, overlap)
        waiting = persist(waiting.drop("n_tokens").join(read, "uid").select("doc_id", "n_bytes", "n_tokens", F.when(F.col("n_tokens").isNull(), F.col("text")).alias("text"), "uid"), "token-splices")
        done = done.unionByName(waiting.filter("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens"))
        waiting = waiting.filter("n_tokens is null")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN
    return done.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents``."""
    return token_counts(read_table(spark, sf_dir, "documents"))
