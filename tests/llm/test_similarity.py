import re

import numpy as np
import pytest

from emberline.llm import jaccard_join as jj
from emberline.llm.shingles import shingle_hashes


@pytest.mark.parametrize("seed", range(8))
def test_blocks_find_all_links(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(rng.integers(1, 8)):
        base = rng.integers(0, 1 << 40, rng.integers(3, 120)).astype(np.uint64)
        for _ in range(rng.integers(1, 40)):
            kept = base[rng.random(len(base)) > rng.choice([0.02, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 40, rng.integers(1, 8)).astype(np.uint64)])))
    i, j = jj.block_links(sets)
    got = {(max(a, b), min(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    assert len(got) == len(i)
    want = set()
    for a in range(len(sets)):
        for b in range(a):
            common = len(np.intersect1d(sets[a], sets[b]))
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                want.add((a, b))
    assert got == want


def plain(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp, links = list(range(len(rows))), [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    least = {c: min((rows[k][0] for k in range(len(rows)) if comp[k] == c and rows[k][0] is not None), default=None) for c in set(comp)}
    return [(i, len(sets[k]), least[comp[k]], links[k]) for k, (i, _) in enumerate(rows)], comp


def test_components(docs, rows, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jj.jaccard_components(docs).collect()), key=str)
    assert got == sorted(plain(rows)[0], key=str)
    assert jj.jaccard_components(none).count() == 0


def test_large_families_are_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(jj, "GROUP_TOKENS", 600)
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        w[int(rng.integers(80))] = f"x{i}"
        w[int(rng.integers(80))] = f"y{int(rng.integers(5))}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jj.jaccard_components(docs.sort("doc_id")).collect())
    assert got == sorted(plain(rows)[0])


def test_fifty_groups_of_one_family(spark, monkeypatch):
    """A family of several kinds of copies over some fifty groups, against brute force."""
    monkeypatch.setattr(jj, "GROUP_TOKENS", 700)
    rng = np.random.default_rng(12)
    base, rows = [f"w{k}" for k in range(120)], []
    for i in range(320):
        w = list(base)
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(120))] = f"x{int(rng.integers(40))}"
        if i % 3 == 0:
            w[int(rng.integers(60)) :] = w[int(rng.integers(60)) :] + [f"z{i}"]
        rows.append((i, " ".join(w)))
    opened = []
    real = jj.score_pairs
    monkeypatch.setattr(jj, "score_pairs", lambda pairs: opened.append(pairs.count()) or real(pairs))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jj.jaccard_components(docs).collect())
    assert got == sorted(plain(rows)[0])
    assert opened[0] > 300


def test_passages_do_not_make_groups_to_pair(spark, monkeypatch):
    """Texts of their own that quote common passages, and a few near copies: no groups are paired, no link is lost."""
    monkeypatch.setattr(jj, "GROUP_TOKENS", 1500)
    rng = np.random.default_rng(5)
    passages = [[f"p{k}x{i}" for i in range(24)] for k in range(3)]
    rows = []
    for i in range(150):
        quoted = [w for k in rng.permutation(3)[: 1 + i % 3] for w in passages[k]]
        rows.append((i, " ".join([f"o{i}x{j}" for j in range(60)] + quoted)))
    rows += [(200 + i, rows[i][1] + " end") for i in range(0, 150, 10)]
    opened = []
    real = jj.score_pairs
    monkeypatch.setattr(jj, "score_pairs", lambda pairs: opened.append(pairs.count()) or real(pairs))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jj.jaccard_components(docs).collect())
    assert got == sorted(plain(rows)[0])
    assert sum(x[3] > 0 for x in got) == 30 and opened == [0]


def test_first_of_each_group_stays(docs, rows, none):
    kept = jj.keep_first(docs)
    assert kept.schema == docs.schema
    got = sorted(r.node for r in kept.collect())  # ``node`` numbers the rows here
    _, comp = plain(rows)
    groups = {}
    for k, c in enumerate(comp):
        groups.setdefault(c, []).append(k)
    want = sorted(min(ks, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)) for ks in groups.values())
    assert got == want
    assert jj.keep_first(none).count() == 0


def test_prefix_length():
    for n in range(1, 300):
        assert jj.prefix_length(n) == n - int(np.ceil(0.8 * n - 1e-9)) + 1


def test_shingles_of_short_texts():
    assert len(shingle_hashes("")) == len(shingle_hashes(" \n")) == 0
    assert (shingle_hashes("A b") == shingle_hashes("a  B")).all() and len(shingle_hashes("a b c d e f")) == 2
