"""Language-model scores of whole texts over a corpus.

Counts of all words are gathered by one aggregation (map-side combined). Words
that make up at least one part in FREQUENT of all tokens, hence at most FREQUENT
words, are known to every task; occurrences of rarer words meet their counts in
a join. The recurrent model reads the commonest words up to COVER of the training
tokens, at most MOST, so its vocabulary and classes grow with the corpus. A word it
doesn't read is the unknown token times the word's smoothed share of such words, so
scores are probabilities of the actual text.

Texts are turned into ids once. Training texts are dealt by a hash of their content
to shards and rounds whose numbers follow from the count of tokens alone, both about the
root of the tokens in units of SHARD_TOKENS. In a round each shard trains on from the common
model, longest text first, and the models are averaged. So more text means more rounds,
one after the other, and scores depend on the rows, not on how the input is cut into partitions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gated_lm as lm
from .common import claim, persist, prepare, read_table, shared_dir, table
from .shingles import word_hashes, words_of

#: Most words that are known to every task (the bound of what is broadcast).
FREQUENT = 1 << 17
#: Share of the training tokens that the model's own words make up, and the most words.
COVER, MOST = 0.65, 60_000
#: Tokens of a training shard in a round.
SHARD_TOKENS = 4_000_000
#: Tokens a task holds before it counts them.
BUFFER = 2_000_000
#: Stands for the end token among word hashes.
END_HASH = np.uint64(0x5E4D5E4D5E4D5E4D)
HELD_OUT, FOLDS = 2, 7

COUNTS = pa.schema([("h", pa.int64()), ("train", pa.int64()), ("every", pa.int64())])


def with_fold(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and held_out: crc32 of the id's digits mod 7 is 2.

    A null doc_id is a training row, as its digits are empty.
    """
    doc_id = F.col("doc_id").cast("long")
    fold = F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    return docs.select(doc_id.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (fold == HELD_OUT).alias("held_out"))


def hashes_of(text: str) -> np.ndarray:
    """Word hashes of a text with the end token."""
    words = words_of(text)
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = word_hashes(words)
    out[-1] = END_HASH
    return out


def word_counts(rows: DataFrame) -> DataFrame:
    """(h, train, every): occurrences of each token in training and in all texts."""

    def run(batches):
        claim()
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def flush():
            parts = [np.unique(np.concatenate(x) if x else np.zeros(0, np.uint64), return_counts=True) for x in held]
            h = np.union1d(parts[0][0], parts[1][0])
            count = np.zeros((2, len(h)), np.int64)
            for k, (values, n) in enumerate(parts):
                count[k, np.searchsorted(h, values)] = n
            for x in held:
                x.clear()
            return table(COUNTS, h=h.view(np.int64), train=count[0], every=count.sum(0))

        for batch in batches:
            for cell, out in zip(batch.column(0), batch.column(1).to_pylist()):
                found = hashes_of(cell.as_py())
                held[out].append(found)
                size += len(found)
                if size >= BUFFER:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    partial = rows.select("text", "held_out").mapInArrow(run, "h long, train long, every long")
    return partial.groupBy("h").agg(F.sum("train").alias("train"), F.sum("every").alias("every"))


class Vocabulary:
    """Hashes and training counts of frequent words, and the model's ids."""

    def __init__(self, found: list[tuple[int, int]], tokens: int, distinct: int):
        h = np.array([x for x, _ in found], np.int64).view(np.uint64)
        order = np.argsort(h)
        self.h, self.train = h[order], np.array([n for _, n in found], np.int64)[order]
        self.tokens, self.distinct = tokens, distinct
        self.ids = np.full(len(h), lm.UNKNOWN, np.uint16)
        words = np.flatnonzero((self.train > 0) & (self.h != END_HASH))
        best = words[np.lexsort((self.h[words], -self.train[words]))]
        best = best[: int(np.searchsorted(np.cumsum(self.train[best]), COVER * tokens)) + 1][:MOST]
        self.ids[best] = np.arange(2, 2 + len(best))
        self.end = int(np.searchsorted(self.h, END_HASH))
        has_end = self.end < len(self.h) and self.h[self.end] == END_HASH
        ends = int(self.train[self.end]) if has_end else 0
        if has_end:
            self.ids[self.end] = lm.END
        read = int(self.train[best].sum()) + ends
        counts = np.zeros(2 + len(best))
        counts[lm.UNKNOWN], counts[lm.END] = tokens - read, ends
        counts[2:] = self.train[best]
        self.layout = lm.Layout(counts)
        self.ends = ends
        self.unread = tokens - read + distinct - len(best) - (ends > 0) + 1
        self.log_count = np.log10(self.train + 1.0)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the frequent, -1 for a rare one."""
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, -1)

    def model_ids(self, places: np.ndarray) -> np.ndarray:
        """Ids the model reads; the last token is always the end."""
        out = np.where(places >= 0, self.ids[places], lm.UNKNOWN).astype(np.uint16) if len(self.h) else np.full(len(places), lm.UNKNOWN, np.uint16)
        out[-1] = lm.END
        return out


TEXTS = pa.schema(
    [("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("unread", pa.int64())]
    + [("unread_sum", pa.float64()), ("rare_h", pa.list_(pa.int64())), ("rare_n", pa.list_(pa.int32())), ("deal", pa.int64()), ("ids", pa.binary())]
)
TEXTS_DDL = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, unread long, unread_sum double, rare_h array<long>, rare_n array<int>, deal long, ids binary"
#: Tokens of one batch that is handed on.
OUT_TOKENS = 1 << 20


def texts_of(rows: DataFrame, vocabulary) -> DataFrame:
    """Per text what its frequent words give, its rare words and the model's ids;
    ``deal`` is a hash of its words and its doc_id. ``vocabulary`` is a broadcast."""

    def run(batches):
        claim()
        v, uid = vocabulary.value, TaskContext.get().partitionId() << 36
        end_known, end_base = bool(v.ends), math.log10(v.ends + 1)
        for batch in batches:
            rows, size = {f.name: [] for f in TEXTS}, 0
            for doc_id, cell, out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                h = hashes_of(cell.as_py())
                places = v.places(h)
                ids = v.model_ids(places)
                rare = places[:-1] < 0
                seen = places[:-1][~rare]
                unread = seen[v.ids[seen] == lm.UNKNOWN]
                rare_h, rare_n = np.unique(h[:-1][rare], return_counts=True)
                deal = xxhash.xxh64_intdigest(h.tobytes(), 0 if doc_id is None else doc_id & 0xFFFFFFFFFFFFFFFF) >> 1
                known, base = int((v.train[seen] > 0).sum()) + end_known, float(v.log_count[seen].sum()) + end_base
                for name, value in zip(rows, (uid, doc_id, out, len(h), known, base, int(rare.sum()) + len(unread), float(v.log_count[unread].sum()), rare_h.view(np.int64), rare_n.astype(np.int32), deal, ids.astype("<u2").tobytes())):
                    rows[name].append(value)
                uid += 1
                size += len(h)
                if size >= OUT_TOKENS:
                    yield table(TEXTS, **rows)
                    rows, size = {f.name: [] for f in TEXTS}, 0
            yield table(TEXTS, **rows)

    return rows.select("doc_id", "text", "held_out").mapInArrow(run, TEXTS_DDL)


def units_of(tokens: int) -> tuple[int, int]:
    """(shards, rounds): about as many rounds as shards, of SHARD_TOKENS tokens a shard and round."""
    units = max(1, -(-tokens // SHARD_TOKENS))
    shards = math.isqrt(units - 1) + 1
    return shards, -(-units // shards)


def train_model(texts: DataFrame, vocabulary) -> dict:
    """The model after all rounds; ``vocabulary`` is a broadcast. Without training texts, the start.

    In a round each shard takes the model and the optimiser's moments that all shards have so far on
    to its texts of the round, and both are averaged by tokens, in a tree of fixed order. So steps that follow
    one another grow with the corpus as the shards do. What a task holds is a bounded table, SHARD_TOKENS
    16-bit ids in the mean. Rows of equal id and text meet in one shard and round.
    """
    spark = texts.sparkSession
    layout, tokens = vocabulary.value.layout, vocabulary.value.tokens
    start = lm.initial(layout)
    size = len(lm.pack(start)) // 4
    shards, rounds = units_of(tokens)
    ddl = "task int, weight double, params binary"
    schema = pa.schema([("task", pa.int32()), ("weight", pa.float64()), ("params", pa.binary())])

    unit = F.pmod("deal", F.lit(shards * rounds))
    seen = texts.filter(~F.col("held_out")).select((unit % shards).cast("int").alias("shard"), F.floor(unit / shards).cast("int").alias("round"), "deal", "n_tokens", "ids")
    folder = shared_dir(spark, "lm-rounds")
    seen.repartition(min(shards * rounds, 10_000), "round", "shard").write.partitionBy("round").parquet(folder)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seen.schema if f.name != "round")
    stored = spark.read.schema(f"{kept}, round int").parquet(folder)

    def merge(part: pa.Table) -> pa.Table:
        """One model for those whose shard is equal modulo the fan-out."""
        part = part.sort_by("task")
        total, weights = np.zeros(3 * size), part["weight"].to_pylist()
        for w, x in zip(weights, part["params"]):
            total += w * np.frombuffer(x.as_py(), np.float32)
        mean = (total / sum(weights)).astype(np.float32).tobytes()
        return pa.table([[part["task"][0].as_py() % fan], [sum(weights)], [mean]], schema=schema)

    def trainer(state, steps: int):
        def train(part: pa.Table) -> pa.Table:
            claim()
            v = vocabulary.value
            order = np.lexsort((part["deal"].to_numpy(), -part["n_tokens"].to_numpy()))
            held = part["ids"].combine_chunks()
            docs = ((None, np.frombuffer(held[i].as_buffer(), "<u2")) for i in order.tolist())
            p, m, s = (lm.unpack(x, v.layout) for x in np.split(np.frombuffer(state.value, np.float32), 3))
            adam = lm.Adam(p)
            adam.m, adam.v, adam.t = m, s, steps
            n = lm.train_on(p, adam, v.layout, docs)
            return pa.table([[part["shard"][0].as_py()], [float(n)], [b"".join(map(lm.pack, (p, adam.m, adam.v)))]], schema=schema)

        return train

    state, steps = lm.pack(start) + bytes(8 * size), 0
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(state)
        rows = stored.filter(F.col("round") == r).drop("round")
        models = persist(rows.groupBy("shard").applyInArrow(trainer(shared, steps), ddl), "lm-models")
        n = models.count()
        while n > 1:  # a tree: each merge reads some sixteen models
            fan = -(-n // 16)
            to = F.pmod("task", F.lit(fan))
            models = persist(models.groupBy(to.alias("to")).applyInArrow(merge, ddl), "lm-models")
            n = models.count()
        last = models.collect()  # one model of MOST words at most
        shared.unpersist()
        if last:
            state = bytes(last[0].params)
            steps += max(1, SHARD_TOKENS // (lm.LANES * lm.STEPS))
    return lm.unpack(state[: 4 * size], layout)


SCORES = pa.schema([("uid", pa.int64()), ("model", pa.float64())])


def score_texts(texts: DataFrame, vocabulary, params: dict) -> DataFrame:
    """(uid, model): log10 likelihood of each text's ids. Longest first inside each
    partition, so that no lane is left with a long text when the others have ended."""
    shared = texts.sparkSession.sparkContext.broadcast(lm.pack(params))

    def run(batches):
        claim()
        v = vocabulary.value

        def docs():
            for batch in batches:
                for uid, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield uid, np.frombuffer(cell.as_buffer(), "<u2")

        uids, found = [], []
        for uid, natural in lm.score(lm.unpack(shared.value, v.layout), v.layout, docs()):
            uids.append(uid)
            found.append(natural / math.log(10))
            if len(uids) >= 8192:
                yield table(SCORES, uid=uids, model=found)
                uids, found = [], []
        yield table(SCORES, uid=uids, model=found)

    return texts.select("uid", "ids").sortWithinPartitions(F.desc(F.length("ids")), "uid").mapInArrow(run, "uid long, model double")


def language_model_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty: the end token alone. Ids may be null or repeated, each row
    is scored; other columns are ignored. Without training rows every count is 0.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = with_fold(docs)
    counts = persist(word_counts(rows), "lm-counts")
    total = counts.agg(F.sum("train").alias("n"), F.sum("every").alias("m"), F.count_if(F.col("train") > 0).alias("v")).first()
    tokens, every, distinct = total.n or 0, total.m or 0, total.v or 0
    least = max(1, -(-every // FREQUENT))
    frequent = counts.filter(F.col("every") >= least).select("h", "train").collect()  # at most FREQUENT rows
    v = Vocabulary([(r.h, r.train) for r in frequent], tokens, distinct)
    shared = spark.sparkContext.broadcast(v)
    texts = persist(texts_of(rows, shared), "lm-texts")
    params = train_model(texts, shared)
    scores = score_texts(texts, shared, params)

    rare = texts.select("uid", F.explode(F.arrays_zip("rare_h", "rare_n")).alias("r")).select("uid", F.col("r.rare_h").alias("h"), F.col("r.rare_n").alias("n"))
    met = rare.join(counts.filter(F.col("every") < least).select("h", "train"), "h", "left")
    c = F.coalesce("train", F.lit(0))
    sums = met.groupBy("uid").agg(F.sum(F.col("n") * F.log10(c + 1.0)).alias("rare_sum"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    out = texts.drop("rare_h", "rare_n", "ids", "deal").join(scores, "uid").join(sums, "uid", "left")
    rare_sum = F.coalesce("rare_sum", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rare_sum - F.col("n_tokens") * math.log10(tokens + distinct + 1)).alias("base_score"),
        (F.col("model") + F.col("unread_sum") + rare_sum - F.col("unread") * math.log10(v.unread)).alias("score"),
    )


def op6_language_model(spark, sf_dir: str) -> DataFrame:
    """Score every document by the recurrent model and by smoothed counts."""
    return language_model_scores(read_table(spark, sf_dir, "documents"))
