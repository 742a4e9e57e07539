"""Quality classifier by hierarchical empirical Bayes.

A logistic model on text statistics gives each document evidence, the log odds
of good quality over the base rate. Hosts and paths get posteriors of their own:
grouped sums of the documents' probabilities, shrunk towards the level above (path
to host, host to global) by variance components that are estimated from the
same sums, so a sparse site stays near the global prior. A document's quality is
its evidence on top of its path's prior. Lists of words that go with toxic labels,
one per language and one of all languages, mark toxic documents. ``keep`` asks for
good quality and no mark.
"""

from __future__ import annotations

import math
import string
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import _Table
from .common import claim, persist, prepare, read_table

#: Labelled documents that a fit reads at most: those of least id hash.
LABELLED = 20_000
#: Lengths of word beginnings that are listed like words (inflected languages).
STEM = range(4, 8)
#: A listed word or beginning is in so many toxic texts at least, and this many times likelier there.
TOXIC_LEAST, TOXIC_LIFT = 3, 10.0
#: Words whose odds a worker keeps, in each of two generations and for each language.
WORD_TABLE = 30_000
#: Words and beginnings that a task holds before it hands on their counts.
HELD_WORDS = 100_000
#: Log odds that a toxic mark needs.
TOXIC_MARGIN = 3.0
#: Farthest that a site's prior moves a document's log odds.
SITE_REACH = 2.0
#: Sites up to this many rows are broadcast; more meet the documents in a shuffle join.
BROADCAST_SITES = 50_000

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:48] = _SYMBOL[58:65] = _SYMBOL[91:97] = _SYMBOL[123:127] = True
_SYMBOL[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = False
FEATURES = 16


#: Odd multipliers that mix the hashes of five words in a row.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _distinct(h: np.ndarray) -> tuple[int, int]:
    """Distinct values, and the count of the commonest."""
    h = np.sort(h)
    firsts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return len(firsts), int(np.diff(firsts, append=len(h)).max())


def features(text: str, words: list[str] | None = None) -> list[float]:
    """Statistics of a whole text; an empty one has all zeros but the first.

    ``words`` are those of the lower-cased text. Words and runs of five are told
    apart by 64-bit hashes in arrays, so a long text costs some bytes a word.
    """
    words = text.lower().split() if words is None else words
    if not words:
        return [1.0] + [0.0] * (FEATURES - 1)
    data = text.encode("utf-8", "replace")
    n, m = len(data), len(words)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = max(1, int(count[_LETTER].sum()))
    h = np.fromiter(map(hash, words), np.int64, m).view(np.uint64)
    seen, top = _distinct(h)
    lines = [x for x in data.split(b"\n") if x.strip()]
    same = int((h[1:] == h[:-1]).sum())
    fives = 0
    if m > 4:
        with np.errstate(over="ignore"):
            mixed = h[: m - 4] * _ODD[0]
            for k in range(1, 5):
                mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD[k] + h[k : m - 4 + k]
        fives = _distinct(mixed)[0]
    return [
        0.0,
        math.log1p(m),
        int(count[_UPPER].sum()) / letters,
        int(count[_DIGIT].sum()) / n,
        int(count[_SYMBOL].sum()) / m,
        int(count[33]) / m,
        int(count[124]) / m,
        int(count[46]) / m,
        n / m / 10,
        seen / m,
        seen / math.sqrt(m) / 10,
        top / m,
        same / m,
        1 - len(set(lines)) / max(1, len(lines)),
        1 - fives / max(1, m - 4) if m > 4 else 0.0,
        letters / n,
    ]


def toxic_words_of(text: str) -> set[str]:
    return {w.strip(string.punctuation) for w in set(text.lower().split())} - {""}


def stems(words: set[str]) -> set[str]:
    """The words, and their beginnings of STEM lengths as ``beginning-``."""
    return words | {w[:k] + "-" for w in words for k in STEM if len(w) >= k}


class Model:
    """Weights of standardised features, and log odds of listed words."""

    def __init__(self, mean, scale, weights, intercept: float, base: float, toxic: dict[str | None, dict[str, float]], toxic_base: dict[str | None, float]):
        self.mean, self.scale, self.weights, self.intercept, self.base = mean, scale, weights, intercept, base
        self.toxic, self.toxic_base = toxic, toxic_base
        self.lists = {lang: self._listed(lang) for lang in {None, *toxic, *toxic_base}}
        self.known: dict[str | None, _Table] = {}

    def __getstate__(self):  # a worker's table of words stays there
        return self.__dict__ | {"known": {}}

    def _listed(self, lang: str | None) -> tuple[dict[str, float], dict[int, dict[str, float]]]:
        """Words, and beginnings by length, of a language's list and that of all languages."""
        every: dict[str, float] = dict(self.toxic.get(None, {}))
        for w, odds in self.toxic.get(lang, {}).items():
            every[w] = max(odds, every.get(w, 0.0))
        begin: dict[int, dict[str, float]] = {}
        for w in [w for w in every if w.endswith("-")]:
            begin.setdefault(len(w) - 1, {})[w[:-1]] = every.pop(w)
        return every, begin

    def evidence(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return z @ self.weights[: x.shape[1]] + (z * z) @ self.weights[x.shape[1] :] + self.intercept - self.base

    def _odds(self, lang: str | None) -> _Table:
        """Raw word to (bare word, log odds) of the strongest listed word or
        beginning that it matches, None for the others; a bounded table."""
        if lang not in self.known:
            whole, begin = self.lists[lang]

            def odds(raw: str):
                w = raw.strip(string.punctuation)
                best = max([whole.get(w, 0.0), *(listed.get(w[:k], 0.0) for k, listed in begin.items())])
                return (w, best) if w and best else None

            self.known[lang] = _Table(odds, WORD_TABLE)
        return self.known[lang]

    def toxicity(self, text: str, lang: str | None = None, words: list[str] | None = None) -> float:
        """Log odds of a toxic text by all its listed words, less a margin.

        A word counts once, by the strongest listed word or beginning that it matches.
        A language without enough labels goes by the list of all languages.
        """
        known = lang if lang in self.lists else None
        total = self.toxic_base.get(known, self.toxic_base.get(None, -10.0)) - TOXIC_MARGIN
        if any(self.lists[known]):
            found = map(self._odds(known).__getitem__, set(text.lower().split() if words is None else words))
            total += math.fsum(dict(filter(None, found)).values())
        return total


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def fit(x: np.ndarray, good: np.ndarray, ridge: float = 2.0) -> tuple:
    """Ridge logistic regression on standardised features and their squares."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.clip((x - mean) / scale, -8, 8)
    a = np.hstack([z, z * z, np.ones((len(z), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 0
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, a.T @ (good - p) - penalty * w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w[:-1], float(w[-1])


def toxic_weight(c: int, f: int, n1: int, n0: int, tried: int) -> float | None:
    """Log lift of a word that is in ``c`` of ``n1`` toxic and ``f`` of ``n0`` other texts.

    None unless the lift is TOXIC_LIFT and chance is excluded: by Chernoff's bound less
    than one of ``tried`` words without a bearing would get such counts.
    """
    p, q = n1 / (n1 + n0), c / (c + f)
    if q <= p:
        return None
    proof = c * math.log(q / p) + (f * math.log((1 - q) / (1 - p)) if f else 0.0)
    odds = math.log(((c + 0.5) / (n1 + 1)) / ((f + 0.5) / (n0 + 1)))
    return odds if proof >= math.log(tried) and odds >= math.log(TOXIC_LIFT) else None


def _stem_counts(sample: DataFrame) -> DataFrame:
    """(word, lang, c, f): toxic and other texts of ``sample`` that hold each word or
    beginning, by language and, with a null lang, over all. Tasks count their own texts first."""

    def rows(held):
        words, langs = zip(*held) if held else ((), ())
        c, f = zip(*held.values()) if held else ((), ())
        return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "lang": pa.array(langs, pa.string()), "c": pa.array(c, pa.int64()), "f": pa.array(f, pa.int64())})

    def run(batches):
        claim("quality")
        held: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            for text, lang, toxic in zip(*(batch.column(k).to_pylist() for k in range(3))):
                at = 0 if toxic > 0 else 1
                for w in stems(toxic_words_of(text)):
                    held.setdefault((w, lang), [0, 0])[at] += 1
                if len(held) >= HELD_WORDS:
                    yield rows(held)
                    held = {}
        yield rows(held)

    found = sample.select("text", "lang", "toxic").mapInArrow(run, "word string, lang string, c long, f long")
    return found.rollup("word", "lang").agg(F.sum("c").alias("c"), F.sum("f").alias("f")).filter("word is not null")


def fit_toxic(sample: DataFrame, totals: dict[str | None, tuple[int, int]]) -> tuple[dict[str | None, dict[str, float]], dict[str | None, float]]:
    """Words that mark toxic texts of ``sample`` (text, lang, toxic), and the base log
    odds, by language and, under None, over all. ``totals`` has the toxic and other texts."""
    totals = {lang: n for lang, n in totals.items() if min(n) >= TOXIC_LEAST}
    if None not in totals:
        return {}, {None: -10.0}
    often = persist(_stem_counts(sample).filter(F.col("c") >= TOXIC_LEAST), "quality-words")
    tried = {r.lang: r.n for r in often.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}

    def run(batches):
        for batch in batches:
            rows = [(r["word"], r["lang"], toxic_weight(r["c"], r["f"], *totals[r["lang"]], tried[r["lang"]])) for r in batch.to_pylist() if r["lang"] in totals]
            kept = [r for r in rows if r[2] is not None]
            yield pa.RecordBatch.from_pylist([dict(zip(("word", "lang", "odds"), r)) for r in kept], schema=pa.schema([("word", pa.string()), ("lang", pa.string()), ("odds", pa.float64())]))

    toxic: dict[str | None, dict[str, float]] = {}
    for r in often.mapInArrow(run, "word string, lang string, odds double").collect():
        toxic.setdefault(r.lang, {})[r.word] = r.odds
    return toxic, {lang: _logit(n1 / (n1 + n0)) for lang, (n1, n0) in totals.items()}


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most LABELLED labelled documents.

    Labels with a null id or quality are left out; of several for one id the
    least quality and the greatest toxicity hold. Without two classes the model
    has no evidence and keeps everything.
    """
    one = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    chosen = one.withColumn("o", F.xxhash64("doc_id")).orderBy("o", "doc_id").limit(LABELLED).drop("o")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("quality", pa.int32()), ("toxic", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            x = pa.array([features(t) for t in batch.column("text").to_pylist()], schema.field("x").type)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang").cast(pa.string()), batch.column("quality").cast(pa.int32()), batch.column("toxic").cast(pa.int32()), x], schema=schema)

    # at most LABELLED rows of two flags are broadcast, a size that is proven
    met = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("t"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic")).select("doc_id", "t.text", "t.lang", "quality", "toxic")
    sample = persist(met, "quality-sample")
    rows = sample.mapInArrow(run, "doc_id long, lang string, quality int, toxic int, x array<double>").toArrow()  # LABELLED rows of numbers
    good = rows["quality"].to_numpy().astype(float) > 0
    zeros = np.zeros(FEATURES)
    mean, scale, weights, intercept, base = zeros, zeros + 1, np.zeros(2 * FEATURES), 0.0, 0.0
    if len(good) >= 10 and 0 < good.sum() < len(good):
        order = np.argsort(rows["doc_id"].to_numpy())
        x = rows["x"].combine_chunks().flatten().to_numpy().reshape(len(good), FEATURES)[order]
        mean, scale, weights, intercept = fit(x, good[order].astype(float))
        base = _logit(float(good.mean()))
    totals: dict[str | None, tuple[int, int]] = {}
    for lang, bad in zip(rows["lang"].to_pylist(), (rows["toxic"].to_numpy() > 0).tolist()):
        for key in (lang, None):
            n1, n0 = totals.get(key, (0, 0))
            totals[key] = (n1 + bad, n0 + (not bad))
    toxic, toxic_base = fit_toxic(sample, totals)
    return Model(mean, scale, weights, intercept, base, toxic, toxic_base)


def evidence(model: Model, text: Column, lang: Column) -> Column:
    """struct<quality, toxic>: evidence of quality and log odds of toxicity."""
    kind = pa.struct([("quality", pa.float64()), ("toxic", pa.float64())])

    @F.arrow_udf("quality double, toxic double")
    def score(texts: pa.Array, langs: pa.Array) -> pa.Array:
        claim("quality")
        x, toxic = np.zeros((len(texts), FEATURES)), np.zeros(len(texts))
        for i, (cell, lang) in enumerate(zip(texts, langs.to_pylist())):
            held = cell.as_py() or ""
            words = held.lower().split()
            x[i], toxic[i] = features(held, words), model.toxicity(held, lang or "", words)
        return pa.StructArray.from_arrays([pa.array(model.evidence(x)), pa.array(toxic)], fields=list(kind))

    return score(text, lang)


def host_of(source: Column) -> Column:
    return F.coalesce(F.substring_index(source, "/", 1), F.lit(""))


def path_of(source: Column, lang: Column) -> Column:
    return F.concat_ws("/", F.coalesce(source, F.lit("")), F.coalesce(lang, F.lit("")))


def site_priors(scored: DataFrame, base: float) -> tuple[DataFrame, float]:
    """(host, path, host_prior, path_prior) and the global mean.

    ``scored`` has host, path and evidence. Sums per path are combined map-side, so
    a site with a third of all rows is one row per task. ``base`` is the log odds
    of good quality among the labels.
    """
    p = 1 / (1 + F.exp(-(F.col("evidence") + base)))
    paths = persist(scored.select("host", "path", p.alias("p")).groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "quality-paths")
    hosts = persist(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count(F.lit(1)).alias("m")), "quality-hosts")
    t = hosts.agg(
        F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.sum("hq").alias("q"), F.count(F.lit(1)).alias("hosts"), F.sum("m").alias("paths"), F.sum("between").alias("ps"),
        F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("hs2"), F.sum(F.col("hn").cast("double") * F.col("hn")).alias("hn2"), F.sum(F.col("squares") / F.col("hn")).alias("pn"),
    ).first()
    if not t.n:
        return paths.select("host", "path", F.lit(0.5).alias("host_prior"), F.lit(0.5).alias("path_prior")), 0.5
    mean = t.s / t.n
    strength = _strengths(t, mean)
    host_prior = (F.col("hs") + strength[0] * mean) / (F.col("hn") + strength[0])
    path_prior = (F.col("s") + strength[1] * F.col("host_prior")) / (F.col("n") + strength[1])
    small = hosts.select("host", host_prior.alias("host_prior"))
    return paths.join(small, "host").select("host", "path", "host_prior", path_prior.alias("path_prior")), mean


def _strengths(t, mean: float) -> tuple[float, float]:
    """Pseudo-counts of the priors of hosts and of paths (variance components)."""

    def strength(between: float, groups: int, within: float, free: float, size: float) -> float:
        if groups < 1 or size <= 0:
            return 1e6
        noise = max(within / max(1.0, free), 1e-9)
        spread = (between / groups - noise) / size
        return float(np.clip(noise / spread if spread > 0 else 1e6, 1.0, 1e6))

    within = t.q - t.ps
    host = strength(t.hs2 - t.s * t.s / t.n, t.hosts - 1, t.q - t.hs2, t.n - t.hosts, (t.n - t.hn2 / t.n) / max(1, t.hosts - 1))
    path = strength(t.ps - t.hs2, t.paths - t.hosts, within, t.n - t.paths, (t.n - t.pn) / max(1, t.paths - t.hosts))
    return host, path


def _decide(scored: DataFrame, sites: DataFrame, mean: float, base: float) -> DataFrame:
    """``scored`` with host_prior, path_prior, quality and keep.

    Sites are broadcast only when their counted rows are within BROADCAST_SITES.
    """
    sites = persist(sites, "quality-sites")
    small = sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES
    met = scored.join(F.broadcast(sites) if small else sites, ["host", "path"], "left")
    prior = F.coalesce("path_prior", F.lit(mean))
    held = F.greatest(F.least(prior, F.lit(1 - 1e-6)), F.lit(1e-6))
    centre = _logit(min(max(mean, 1e-6), 1 - 1e-6))
    shift = F.greatest(F.lit(-SITE_REACH), F.least(F.lit(SITE_REACH), F.log(held / (1 - held)) - centre))
    odds = F.col("evidence") + base + shift
    return met.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("keep", (odds >= 0) & (F.col("toxicity") < 0))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, host, path, evidence, toxicity, host_prior, path_prior, quality, keep
    per row of ``docs`` (doc_id, text, source, lang).

    Null text is empty, null source or lang an empty name; ids may be null or
    repeated; other columns are ignored. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    model = train(docs, labels)
    got = evidence(model, F.col("text"), F.col("lang"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host_of(F.col("source")).alias("host"), path_of(F.col("source"), F.col("lang")).alias("path"), got.alias("e"))
    scored = persist(rows.select("doc_id", "host", "path", F.col("e.quality").alias("evidence"), F.col("e.toxic").alias("toxicity")), "quality-scored")
    sites, mean = site_priors(scored, model.base)
    return _decide(scored, sites, mean, model.base).select("doc_id", "host", "path", "evidence", "toxicity", "host_prior", "path_prior", "quality", "keep")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their own columns.

    Texts are scored once, written beside their scores in the shared folder, and
    read again to be decided; they are never shuffled unless the sites are too
    many to broadcast.
    """
    prepare(docs.sparkSession)
    model = train(docs, labels)
    row = F.struct(*[docs[c] for c in docs.columns])
    whole = docs.select(row.alias("row"), host_of(docs["source"]).alias("host"), path_of(docs["source"], docs["lang"]).alias("path"), evidence(model, docs["text"], docs["lang"]).alias("e"))
    scored = persist(whole.select("row", "host", "path", F.col("e.quality").alias("evidence"), F.col("e.toxic").alias("toxicity")), "quality-scored")
    sites, mean = site_priors(scored, model.base)
    return _decide(scored, sites, mean, model.base).filter("keep").select("row.*")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Score all documents with a classifier fitted on ``labels``."""
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
