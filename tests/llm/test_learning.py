import collections
import math
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import cover_tree, gated_lm as lm, lm_score, pieces, quality


def test_gradients():
    rng = np.random.default_rng(0)
    layout = lm.Layout(rng.integers(1, 50, 1024))
    p = {k: v.astype(np.float64) for k, v in lm.initial(layout).items()}
    p["wc"], p["wo"] = rng.standard_normal(p["wc"].shape) * 0.3, rng.standard_normal(p["wo"].shape) * 0.3
    docs = [(i, rng.integers(0, 1024, rng.integers(1, 40)).astype(np.int32)) for i in range(9)]
    w = next(lm.windows(next(lm.blocks(docs, 4, 20)), 10))
    real = w.real.reshape(-1)

    def loss():
        return -lm.log_probs(p, layout, lm.forward(p, w, np.zeros((16, 4)), False)[0][:, real].astype(float), w.y.reshape(-1)[real]).mean()

    g, _, total = lm.gradients(p, layout, w, np.zeros((16, 4)))
    assert abs(total / real.sum() - loss()) < 1e-4
    for k in p:
        at = tuple(np.unravel_index(np.abs(g[k]).argmax(), g[k].shape))
        old = p[k][at]
        p[k][at] = old + 1e-2
        up = loss()
        p[k][at] = old - 1e-2
        down = loss()
        p[k][at] = old
        assert abs((up - down) / 2e-2 - g[k][at]) < 2e-3


def test_tanh_by_one_exponent():
    v = np.linspace(-30, 30, 4001, dtype=np.float32)
    assert np.abs(lm._tanh(v.copy()) - np.tanh(v)).max() < 5e-7


def test_windows_of_a_room_are_plain_and_ask_for_little_memory():
    """Gradients of windows that take turns in a room are those of windows alone; a window asks for a fraction of what it works on."""
    rng = np.random.default_rng(5)
    layout = lm.Layout(rng.integers(1, 50, 1024))
    p = lm.initial(layout)
    p["wc"], p["wo"] = (rng.standard_normal(p[x].shape).astype(np.float32) for x in ("wc", "wo"))
    docs = [(i, rng.integers(0, 1024, rng.integers(20, 90)).astype(np.uint16)) for i in range(2000)]
    room, state = lm.Room(), np.zeros((16, lm.LANES), np.float32)
    ws = list(lm.windows(next(lm.blocks(docs))))
    assert len(ws[-1].rows) < len(ws[0].rows) and not all(w.real.all() for w in ws)
    for w in ws:
        g, last, loss = lm.gradients(p, layout, w, state[:, w.rows], room)
        alone, last_alone, loss_alone = lm.gradients(p, layout, w, state[:, w.rows])
        assert set(g) == set(p) and all((g[x] == alone[x]).all() for x in g)
        assert (last == last_alone).all() and loss == loss_alone
        state[:, w.rows] = last
    tracemalloc.start()
    lm.gradients(p, layout, ws[0], state[:, ws[0].rows], room)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4e6


def test_longer_windows_score_the_same(monkeypatch):
    """A block of 256 steps is scored in two windows, with the scores of any other length."""
    rng = np.random.default_rng(7)
    layout = lm.Layout(rng.integers(1, 50, 300))
    p = {k: (v + rng.normal(size=v.shape) * 0.1).astype(np.float32) for k, v in lm.initial(layout).items()}
    docs = [(k, np.r_[rng.integers(2, 300, n), lm.END]) for k, n in enumerate([700, 127, 128, 0, 255])]
    made, plain = [], lm.log_probs
    monkeypatch.setattr(lm, "log_probs", lambda *a: made.append(len(a[3])) or plain(*a))
    got = dict(lm.score(p, layout, docs))
    assert len(made) == 6 and sum(made) == sum(len(y) for _, y in docs)
    monkeypatch.setattr(lm, "SCORED", 32, raising=False)
    again = dict(lm.score(p, layout, docs))
    for k, y in docs:
        assert abs(got[k] - plain_score(p, layout, y)) < 2e-4 * abs(got[k])
        assert abs(got[k] - again[k]) < 1e-5 * abs(got[k])


def plain_score(p, layout, y):
    """The document's log-likelihood, token by token, with whole softmaxes."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    h, total = np.zeros(16), 0.0
    for k, target in enumerate(y.tolist()):
        pre = p["emb"][lm.END if k == 0 else y[k - 1]] @ p["wx"] + p["b"]
        hh = h @ p["wh"]
        z, r = sig(pre[:16] + hh[:16]), sig(pre[16:32] + hh[16:32])
        c = np.tanh(pre[32:] + r * hh[32:])
        h = (1 - z) * c + z * h
        cls = next(c for c in range(layout.classes) if target < layout.starts[c + 1])
        part = slice(layout.starts[cls], layout.starts[cls + 1])
        a, b = h @ p["wc"] + p["bc"], p["wo"][part] @ h + p["bo"][part]
        total += a[cls] - np.log(np.exp(a).sum()) + b[target - part.start] - np.log(np.exp(b).sum())
    return total


def test_lanes_score_whole_documents():
    rng = np.random.default_rng(1)
    layout = lm.Layout(rng.integers(1, 50, 1024))
    p = lm.initial(layout)
    p["wc"] = rng.standard_normal(p["wc"].shape).astype(np.float32)
    p["wo"] = rng.standard_normal(p["wo"].shape).astype(np.float32)
    docs = [(i, rng.integers(0, 1024, rng.integers(1, 300)).astype(np.int32)) for i in range(700)] + [(700, rng.integers(0, 1024, 3000).astype(np.int32))]
    got = dict(lm.score(p, layout, docs))
    assert len(got) == 701
    for i, y in [*docs[:12], docs[-1]]:
        assert abs(plain_score(p, layout, y) - got[i]) < 1e-3 * abs(got[i])


def test_scoring_finds_what_is_fixed_once(monkeypatch):
    """Inputs and bounds of fixed parameters are found once for all windows; class logits come in chunks that change nothing."""
    rng = np.random.default_rng(4)
    layout = lm.Layout(rng.integers(1, 50, 300))
    p = {k: (v + rng.normal(size=v.shape) * 0.1).astype(np.float32) for k, v in lm.initial(layout).items()}
    docs = [(k, np.r_[rng.integers(2, 300, 700), lm.END]) for k in range(5)]
    made, plain = collections.Counter(), {name: getattr(lm, name) for name in ("inputs", "_reach")}
    for name in plain:
        monkeypatch.setattr(lm, name, lambda p, name=name: made.update([name]) or plain[name](p))
    got = dict(lm.score(p, layout, docs))
    assert made == {"inputs": 1, "_reach": 1}
    monkeypatch.setattr(lm, "CHUNK", 7)
    again = dict(lm.score(p, layout, docs))
    for k, y in docs:
        assert abs(got[k] - plain_score(p, layout, y)) < 2e-4 * abs(got[k])
        assert abs(got[k] - again[k]) < 1e-5 * abs(got[k])


def test_adam_step_is_the_plain_formula():
    rng = np.random.default_rng(6)
    p = {"a": rng.normal(size=(5, 3)).astype(np.float32), "b": rng.normal(size=4).astype(np.float32)}
    want, m, v = {k: x.astype(float) for k, x in p.items()}, collections.defaultdict(float), collections.defaultdict(float)
    adam = lm.Adam(p)
    for t in range(1, 6):
        g = {k: (rng.normal(size=x.shape) * t).astype(np.float32) for k, x in p.items()}
        norm = math.sqrt(sum(float((x.astype(float) ** 2).sum()) for x in g.values()))
        for k, x in g.items():
            x = x.astype(float) * min(1.0, lm.CLIP / norm)
            m[k], v[k] = m[k] * 0.9 + x * 0.1, v[k] * 0.99 + x * x * 0.01
            want[k] = want[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6 / math.sqrt(1 - 0.99**t))
        adam.step(p, g, 0.01)
    assert all(np.abs(p[k] - want[k]).max() < 1e-5 for k in p)


@pytest.mark.parametrize("words", [0, 1, 2, 1022, 70000 - 10000 - 2])
def test_distribution_sums_to_one(words):
    layout = lm.Layout(np.r_[3, 5, 1000 // np.arange(1, words + 1)])
    p = lm.initial(layout)
    h = np.random.default_rng(2).standard_normal((16, 1)).astype(np.float32)
    total = np.exp(lm.log_probs(p, layout, np.repeat(h, layout.size, 1), np.arange(layout.size))).sum()
    assert abs(total - 1) < 1e-3
    assert layout.starts[0] == 0 and layout.starts[-1] == layout.size and (np.diff(layout.starts) > 0).all()


def texts_and_ids(n):
    """Rows whose words follow one another, so that context helps."""
    rng = np.random.default_rng(8)
    out = []
    for i in range(n):
        w = [int(rng.integers(0, 60))]
        for _ in range(int(rng.integers(5, 60))):
            w.append((w[-1] * 7 + int(rng.integers(0, 2))) % 60)
        out.append((i, " ".join(f"w{x}" for x in w) + f" rare{i % 90}"))
    return out


def test_score_is_the_models_and_does_not_depend_on_partitions(spark):
    rows = texts_and_ids(300)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.doc_id: r for r in lm_score.language_model_scores(frame.repartition(1)).collect()}
    many = {r.doc_id: r for r in lm_score.language_model_scores(frame.repartition(9)).collect()}
    assert all(abs(one[i].score - many[i].score) < 1e-6 * abs(one[i].score) for i in one)
    # the whole of it in plain Python, but for the training itself
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    count = collections.Counter(w for i, t in rows if not out[i] for w in [*t.split(), None])
    n = sum(count.values())
    by_hash = lambda w: int(lm_score.hashes_of(w)[0])
    words = sorted((w for w in count if w is not None), key=lambda w: (-count[w], by_hash(w)))
    share, read = 0, []
    for w in words:
        if share >= lm_score.COVER * n:
            break
        read.append(w)
        share += count[w]
    ids = {w: 2 + k for k, w in enumerate(read)} | {None: lm.END}
    layout = lm.Layout([n - share - count[None], count[None], *(count[w] for w in read)])
    docs = {i: np.array([ids.get(w, lm.UNKNOWN) for w in [*t.split(), None]]) for i, t in rows}
    import xxhash

    deal = {i: xxhash.xxh64_intdigest(lm_score.hashes_of(t).tobytes(), i) >> 1 for i, t in rows}
    order = sorted((i for i in docs if not out[i]), key=lambda i: (-len(docs[i]), deal[i]))
    p, _ = lm.train(lm.initial(layout), layout, [(i, docs[i]) for i in order])
    # the share of an unread word among all unread ones: one more for each, and one for words never seen
    unread = sum(count[w] + 1 for w in words if w not in ids) + 1
    for i, t in rows[:40]:
        want = plain_score(p, layout, docs[i]) / math.log(10) + sum(math.log10((count[w] + 1) / unread) for w in t.split() if w not in ids)
        assert abs(want - one[i].score) < 2e-4 * abs(want)


def test_language_model_scores(docs, rows, none):
    got = lm_score.language_model_scores(docs).collect()
    assert len(got) == len(rows)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + [None]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = collections.Counter()
    for i, t in rows:
        if not out(i):
            count.update(words(t))
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for i, t in rows:
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(t))
        want[(i, out(i), len(words(t)), sum(count[w] > 0 for w in words(t)), n, round(base, 6))] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm_score.language_model_scores(none).count() == 0


def test_training_helps_on_held_out_texts():
    rng = np.random.default_rng(3)
    step = rng.permutation(1022) + 2  # each word is followed by one of two
    docs = []
    for i in range(400):
        y = [int(rng.integers(2, 1024))]
        for _ in range(150):
            y.append(int(step[(y[-1] - 2 + int(rng.integers(0, 2))) % 60]))
        docs.append((i, np.array(y, np.int32)))
    layout = lm.Layout(np.bincount(np.concatenate([y for _, y in docs[:350]]), minlength=1024))
    start = lm.initial(layout)
    p, tokens = lm.train(start, layout, docs[:350] * 4)
    assert tokens == 4 * sum(len(y) for _, y in docs[:350])
    assert sum(s for _, s in lm.score(p, layout, docs[350:])) > sum(s for _, s in lm.score(start, layout, docs[350:]))


def searched(x, ids, q, k, size=400, leaf=cover_tree.LEAF):
    """Search of queries x[q] over blocks of ``size`` vectors; and the counts of dropped pairs."""
    uids = np.arange(len(x))
    search = cover_tree.Search(cover_tree.build(ids[q], uids[q], x[q], leaf), k)
    for at in range(0, len(x), size):
        search.with_block(cover_tree.build(ids[at : at + size], uids[at : at + size], x[at : at + size], leaf))
    row, vec_id, score = search.found()
    got = collections.defaultdict(list)
    for uid, i, s in zip(search.q.uids[row], vec_id, score):
        got[int(uid)].append((int(i), int(s)))
    return got, search.pruned


@pytest.mark.parametrize("kind", ["random", "clustered", "equal", "large", "beyond doubles"])
def test_cover_tree_is_exact(kind):
    rng = np.random.default_rng(5)
    x = rng.integers(-20, 20, (900, 12))
    if kind == "clustered":
        x = rng.integers(-20, 20, (6, 12))[rng.integers(0, 6, 900)] * 10 + rng.integers(-2, 3, (900, 12))
    if kind == "equal":
        x[:700] = x[0]
    if kind == "large":
        x = rng.integers(-(10**6), 10**6, (900, 12))
    if kind == "beyond doubles":
        x = rng.integers(-(1 << 29), 1 << 29, (900, 12))
    ids = rng.permutation(5000)[:900].astype(np.int64)
    ids[5] = ids[6]  # a repeated id
    q = np.flatnonzero(np.arange(900) % 3 == 0)
    got, _ = searched(x, ids, q, 7)
    for r in q[::9].tolist():
        s = [sum(int(a) * int(b) for a, b in zip(x[r], v)) for v in x]
        order = sorted((j for j in range(900) if j != r), key=lambda j: (-s[j], ids[j]))[:7]
        assert got[r] == [(int(ids[j]), s[j]) for j in order]


def test_cover_tree_levels():
    rng = np.random.default_rng(6)
    x = rng.integers(-99, 99, (2000, 3))
    t = cover_tree.build(np.arange(2000), np.arange(2000), x, 8)
    assert sorted(map(tuple, t.x)) == sorted(map(tuple, x)) and (t.start[0], t.end[0]) == (0, 2000)
    for i in range(len(t.count)):
        inside = t.point[t.start[i] : t.end[i]]
        assert np.isclose(np.sqrt(((inside - t.c[i]) ** 2).sum(1)).max(), t.radius[i])
        kids = t.children(i)
        if len(kids):
            assert t.centre[kids[0]] == t.centre[i]  # nesting
            assert t.start[kids[0]] == t.start[i] and t.end[kids[-1]] == t.end[i] and (t.start[kids[1:]] == t.end[kids[:-1]]).all()
            apart = np.sqrt(((t.c[kids][:, None] - t.c[kids][None]) ** 2).sum(2))[np.triu_indices(len(kids), 1)]
            assert 2 * apart.min() > apart[: len(kids) - 1].max()  # separation against covering


def test_both_trees_are_pruned():
    rng = np.random.default_rng(7)
    centres = rng.integers(-400, 400, (40, 6))
    x = centres[rng.integers(0, 40, 8000)] + rng.integers(-3, 4, (8000, 6))
    _, pruned = searched(x, np.arange(8000), np.arange(0, 8000, 4), 5, 4000, 8)
    assert pruned[(True, True)] > 0 and pruned[(False, False)] > 0 and sum(pruned.values()) > 100


def test_repeated_query_ids_keep_their_rows(spark):
    data = [(20, [1.0, 2.0]), (20, [3.0, -1.0]), (7, [2.0, 2.0]), (40, [1.0, 2.0])]
    v = cover_tree.quantised(spark.createDataFrame(data, "vec_id long, embedding array<double>")).withColumn("uid", F.monotonically_increasing_id())
    got = collections.Counter((r.query_id, r["rank"]) for r in cover_tree.top_k(v, v.filter("vec_id % 20 = 0"), 20).collect())
    assert got == {(20, 1): 2, (20, 2): 2, (20, 3): 2, (40, 1): 1, (40, 2): 1, (40, 3): 1}


def test_few_blocks_are_read(spark, monkeypatch):
    """Of clustered vectors under half of the pairs of blocks are read, and the result is that of all pairs."""
    rng = np.random.default_rng(12)
    centres = rng.integers(-300, 300, (5, 5))
    x = centres[rng.integers(0, 5, 3000)] + rng.integers(-3, 4, (3000, 5))
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    kept, persist = {}, cover_tree.persist
    monkeypatch.setattr(cover_tree, "persist", lambda df, name: kept.setdefault(name, []).append(persist(df, name)) or kept[name][-1])
    v = persist(cover_tree.quantised(rows, 1), "test-vectors")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in cover_tree.top_k(v, v.filter("vec_id % 20 = 0"), 5, 60, 5).collect())
    scores = x[::20] @ x.T
    want = []
    for q, s in zip(range(0, 3000, 20), scores):
        best = sorted((-int(c), j) for j, c in enumerate(s) if j != q)[:5]
        want += [(q, k + 1, j, -c) for k, (c, j) in enumerate(best)]
    assert got == sorted(want)
    read = sum(len(r.blocks) for df in kept["vector-pairs"] for r in df.collect())
    every = kept["vector-bounds"][0].count()
    assert every >= 200 and read < 0.5 * every, (read, every)


def test_vector_rows(spark):
    bad = float("nan")
    data = [(0, [1.0, 0.5]), (20, [0.5, 0.5]), (1, None), (2, [bad, 1.0]), (3, [None, 1.0]), (4, []), (None, [1.0, 1.0]), (5, [float("inf"), 0.0]), (6, [1.0, 2.0, 3.0]), (40, [3.0, 2.0, 1.0]), (7, [-0.01, 0.01])]
    rows = spark.createDataFrame([(i, v, 1, "q") for i, v in data], "vec_id long, embedding array<float>, label int, rank string")
    v = cover_tree.quantised(rows)
    got = cover_tree.top_k(v, v.filter("vec_id % 20 = 0"), 20).collect()
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)
    assert found == [(0, 1, 20, 64 * 32 + 32 * 32), (0, 2, 7, -64), (20, 1, 0, 3072), (20, 2, 7, -32), (40, 1, 6, 64 * 64 * 10)]
    empty = v.limit(0)
    assert cover_tree.top_k(empty, empty).count() == 0


def test_pieces_equal_the_library(docs, rows, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    m = pieces.model()
    texts = [t or "" for _, t in rows] + ["Hello, World! naïve 3.14", "▁▁ x", "\u0000ÿ", "aaaa" * 40]
    for text, (viterbi, merged) in zip(texts, m.encode(texts)):
        assert merged.tolist() == library.encode(text)
        assert m.decode(viterbi) == text.replace("▁", " ")
        assert m.decode(viterbi) == library.decode(viterbi.tolist())
    encoded = pieces.encode_pieces(docs)
    back = collections.Counter((r.doc_id, r.text) for r in pieces.decode_pieces(encoded).collect())
    assert back == collections.Counter((i, t or "") for i, t in rows)
    assert pieces.encode_pieces(none).count() == 0


def test_long_words_equal_the_library_in_near_linear_time():
    import random
    import time

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    m = pieces.model()
    r = random.Random(4)
    texts = ["".join(r.choices(["ab", "the", "xyz", "é", "漢", "ing", "--", "😀", "er"], k=k)) for k in (200, 513, 3000, 20_000)] + ["a" * 5000, "\u0001" * 600]
    for text, (viterbi, merged) in zip(texts, m.encode(texts)):
        assert merged.tolist() == library.encode(text) and m.decode(viterbi) == text
    for text in texts[:2]:  # the stretches change nothing
        want = m.encode([text])[0]
        old, pieces.STRETCH, pieces.LONG = (pieces.STRETCH, pieces.LONG), 37, 20
        m.clear()
        got = m.encode([text])[0]
        pieces.STRETCH, pieces.LONG = old
        m.clear()
        assert [x.tolist() for x in got] == [x.tolist() for x in want]
    began = time.perf_counter()
    m.encode(["".join(r.choices("abcdefgh", k=200_000))])
    assert time.perf_counter() - began < 10


def test_viterbi_is_the_best_segmentation():
    m = pieces.model()

    def brute(word):
        best = {0: 0.0}
        for end in range(1, len(word) + 1):
            found = [best[s] + (m.scores[m.ids[word[s:end]]] if word[s:end] in m.ids else m.unknown if end - s == 1 else -math.inf) for s in range(end)]
            best[end] = max(found)
        return best[len(word)]

    for word in ("▁hello", "▁unbelievable", "▁x漢y", "▁zzzzzzzz", "▁internationalisation"):
        codes = np.array([[ord(c) for c in word]], np.uint32)
        scores, _ = m.table(codes)
        back, at, total = m.viterbi(scores)[0], len(word), 0.0
        while at:
            n = int(back[at])
            total += scores[0, at - n, n]
            at -= n
        assert total == brute(word)


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    seen, unseen = labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 3 = 0")
    got = {r.doc_id: r for r in quality.quality_scores(docs, seen).collect()}
    rows = unseen.collect()
    clean = [got[r.doc_id].keep for r in rows if r.quality == 1 and r.toxic == 0]
    junk = [got[r.doc_id].keep for r in rows if r.quality == 0]
    assert sum(clean) >= 0.97 * len(clean) and sum(junk) <= 0.2 * len(junk)


def test_toxic_recall_by_language_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.train(docs, labels.filter("doc_id % 3 <> 0"))
    marks = collections.defaultdict(list)
    for r in labels.filter("doc_id % 3 = 0").join(docs, "doc_id").select("text", "lang", "toxic").collect():
        marks[r.lang, r.toxic].append(model.toxicity(r.text or "", r.lang) >= 0)
    share = {k: sum(v) / len(v) for k, v in marks.items()}
    assert all(share[lang, 1] >= least for lang, least in (("en", 0.9), ("fr", 0.9), ("de", 0.8), ("es", 0.5))), share
    assert all(share[lang, 0] <= 0.05 for lang in ("en", "fr", "de", "es")), share


def test_toxic_weight_needs_proof():
    assert quality.toxic_weight(15, 0, 65, 531, 10_000) > quality.toxic_weight(18, 1, 65, 531, 10_000) > 4
    assert quality.toxic_weight(3, 0, 65, 531, 10_000) is None  # by chance, of so many words
    assert quality.toxic_weight(60, 200, 65, 531, 10_000) is None  # proven, but weak


def plain_features(text):
    """The statistics by plain counting."""
    data = text.encode()
    words = text.lower().split()
    if not words:
        return [1.0] + [0.0] * 15
    n, m = len(data), len(words)
    letters = max(1, sum(65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in data))
    symbols = sum(33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127 for b in data) - sum(chr(b) in "!\"'(),-.:;?" for b in data)
    counts = collections.Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    fives = len({tuple(words[k : k + 5]) for k in range(m - 4)})
    share = lambda c: data.count(c) / m
    return [
        0.0, math.log1p(m), sum(65 <= b < 91 for b in data) / letters, sum(48 <= b < 58 for b in data) / n, symbols / m, share(b"!"), share(b"|"), share(b"."), n / m / 10, len(counts) / m,
        len(counts) / math.sqrt(m) / 10, counts.most_common(1)[0][1] / m, sum(a == b for a, b in zip(words, words[1:])) / m, 1 - len(set(lines)) / max(1, len(lines)), 1 - fives / max(1, m - 4) if m > 4 else 0.0, letters / n,
    ]


def test_quality_against_plain_python(spark):
    """Evidence, marks, shrunken priors and decisions of all documents, by loops."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows, got = docs.collect(), {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == len(rows)
    p, place = {}, {}
    for r in rows:
        x = np.array(plain_features(r.text))
        assert np.allclose(x, quality.features(r.text), atol=1e-12)
        z = np.clip((x - model.mean) / model.scale, -8, 8)
        evidence = float(z @ model.weights[:16] + (z * z) @ model.weights[16:]) + model.intercept - model.base
        assert abs(evidence - got[r.doc_id].evidence) < 1e-9
        lang = r.lang if r.lang in model.lists else None
        odds = dict(model.toxic.get(None, {}))
        for w, v in model.toxic.get(lang, {}).items():
            odds[w] = max(v, odds.get(w, 0.0))
        total = model.toxic_base.get(lang, model.toxic_base.get(None, -10.0)) - quality.TOXIC_MARGIN
        for w in quality.toxic_words_of(r.text):
            total += max([odds.get(w, 0.0)] + [odds.get(w[:k] + "-", 0.0) for k in quality.STEM if len(w) >= k])
        assert abs(total - got[r.doc_id].toxicity) < 1e-9
        p[r.doc_id] = 1 / (1 + math.exp(-(evidence + model.base)))
        place[r.doc_id] = (r.source.split("/")[0], f"{r.source}/{r.lang}")
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for i, v in p.items():
        hosts[place[i][0]].append(v)
        paths[place[i]].append(v)
    mean, n = sum(p.values()) / len(p), len(p)
    ss = lambda groups: sum(sum(g) ** 2 / len(g) for g in groups)
    q = sum(v * v for v in p.values())

    def strength(between, groups, within, free, size):
        if groups < 1 or size <= 0:
            return 1e6
        noise = max(within / max(1.0, free), 1e-9)
        spread = (between / groups - noise) / size
        return min(max(noise / spread if spread > 0 else 1e6, 1.0), 1e6)

    hn2 = sum(len(g) ** 2 for g in hosts.values())
    pn = sum(len(g) ** 2 / len(hosts[h]) for (h, _), g in paths.items())
    a = strength(ss(hosts.values()) - sum(p.values()) ** 2 / n, len(hosts) - 1, q - ss(hosts.values()), n - len(hosts), (n - hn2 / n) / max(1, len(hosts) - 1))
    b = strength(ss(paths.values()) - ss(hosts.values()), len(paths) - len(hosts), q - ss(paths.values()), n - len(paths), (n - pn) / max(1, len(paths) - len(hosts)))
    logit = lambda v: math.log(v / (1 - v))
    for i, r in got.items():
        h, g = hosts[place[i][0]], paths[place[i]]
        host = (sum(h) + a * mean) / (len(h) + a)
        path = (sum(g) + b * host) / (len(g) + b)
        assert abs(r.host_prior - host) < 1e-9 and abs(r.path_prior - path) < 1e-9
        odds = r.evidence + model.base + min(2.0, max(-2.0, logit(min(max(path, 1e-6), 1 - 1e-6)) - logit(mean)))
        assert abs(r.quality - 1 / (1 + math.exp(-odds))) < 1e-9 and r.keep == (odds >= 0 and r.toxicity < 0)


def test_sites_meet_rows_alike_in_both_joins(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    one = sorted(map(tuple, quality.quality_scores(docs, labels).collect()))
    monkeypatch.setattr(quality, "BROADCAST_SITES", 0)
    many = sorted(map(tuple, quality.quality_scores(docs, labels).collect()))
    assert [r[0] for r in one] == [r[0] for r in many] and [r[-1] for r in one] == [r[-1] for r in many] and np.allclose([r[3:8] for r in one], [r[3:8] for r in many])


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([(0, 1, 0), (None, 0, 0), (3, None, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.quality <= 1 for r in got)
    kept = quality.keep_good(docs, labels)  # too few labels: no evidence, all stay
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert quality.keep_good(none, labels.limit(0)).count() == 0


def test_sparse_sites_shrink_to_the_prior(spark):
    rows = [("a", "a/x", 3.0)] * 400 + [("b", "b/x", -3.0)] * 400 + [("c", "c/x", -3.0)] + [("d", "d/x", 3.0)] * 3
    sites, mean = quality.site_priors(spark.createDataFrame(rows, "host string, path string, evidence double"), 0.0)
    prior = {r.host: r.path_prior for r in sites.collect()}
    assert prior["a"] > 0.9 and prior["b"] < 0.1 and prior["b"] < prior["c"] < mean < prior["d"] < prior["a"]


def test_rounds_learn_more_than_one_average(spark, monkeypatch):
    """Nine units in three rounds of three shards learn several times what nine models averaged once do; one
    model over all of them, with more steps one after the other, still learns more (README)."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(1200):
        w = [int(rng.integers(0, 60))]
        for _ in range(int(rng.integers(200, 400))):
            w.append((w[-1] * 7 + int(rng.integers(0, 2))) % 60)
        rows.append((i, " ".join(f"w{x}" for x in w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    gain = {}
    for name, tokens, units in (("one", 1 << 30, None), ("rounds", 36_000, None), ("average", 36_000, lambda n: (9, 1))):
        monkeypatch.setattr(lm_score, "SHARD_TOKENS", tokens)
        if units:
            monkeypatch.setattr(lm_score, "units_of", units)
        elif name == "rounds":
            assert lm_score.units_of(310_000) == (3, 3)
        r = [x for x in lm_score.language_model_scores(frame).collect() if x.held_out]
        gain[name] = sum(x.score - x.base_score for x in r) / sum(x.n_tokens for x in r)
    assert gain["one"] > gain["rounds"] > 3 * gain["average"] > 0, gain
