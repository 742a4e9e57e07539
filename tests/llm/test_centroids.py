import hashlib
import math

import numpy as np
import pytest

from emberline.llm import centroids as ce

SCHEMA = "vec_id long, embedding array<float>, label int, q string, cluster string, weight double"


def plain(rows, dim=4, scale=16, clusters=3, rounds=4, seed=3):
    """The same by lists of Python integers."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in e]) for i, e, *_ in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [q for _, q in sorted(kept, key=key)[:clusters]]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    pick = lambda q: min(range(len(centres)), key=lambda c: (d(q, centres[c]), c))
    for _ in range(rounds):
        where = [pick(q) for _, q in kept]
        for c in range(len(centres)):
            own = [q for (_, q), w in zip(kept, where) if w == c]
            if own:
                centres[c] = [sum(col) // len(own) for col in zip(*own)]
    out = [(i, pick(q), d(q, centres[pick(q)])) for i, q in kept]
    per = {c: sum(x[2] for x in out if x[1] == c) for c in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, x, per[c], sum(per.values()), sha[c]) for i, c, x in out), key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r[:2], 1, "clash", "c", 0.5) for r in rows], SCHEMA)
    how = {"dim": 4, "scale": 16, "clusters": 3, "rounds": 4} | how
    return sorted((tuple(r) for r in ce.cluster_vectors(df, **how).collect()), key=str)


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=4)]) for k in range(120)]
    rows += [(200 + k, rows[7][1]) for k in range(90)]  # one hot vector
    rows += [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0]), (303, [float("nan"), 0.0, 0.0, 0.0]), (304, [float("inf"), 0.0, 0.0, 0.0]), (305, [1.0, 2.0]), (None, [0.1, 0.2, 0.3, -0.4]), (5, [9.0, 9.0, 9.0, 9.0]), (5, [9.0, 9.0, 9.0, 9.0])]
    return rows


@pytest.mark.parametrize("heavy", [1000, 3, 1])
def test_against_plain_loops(spark, odd, heavy, monkeypatch):
    monkeypatch.setattr(ce, "HEAVY", heavy)  # all, one or none of the vectors by broadcast
    assert run(spark, odd) == plain(odd)


def test_few_equal_and_no_vectors(spark):
    two = [(1, [0.5, 0.0, 0.0, 0.0]), (2, [-0.5, 0.0, 0.0, 0.0])]
    assert run(spark, two) == plain(two)
    same = [(k, [0.25, -0.25, 0.0, 1.0]) for k in range(9)]  # equal starts: the smaller number takes all
    assert run(spark, same) == plain(same)
    assert run(spark, [(1, None)]) == []
    assert run(spark, [(1, [1.0, 2.0, 3.0, 4.0])], rounds=0) == plain([(1, [1.0, 2.0, 3.0, 4.0])], rounds=0)


def test_large_components(spark):
    """Beyond exact doubles the distances are whole numbers; beyond 64 bits an error."""
    wide = [(k, [float(2**20 + k), float(-(2**20)), 3.5, 0.25 * k]) for k in range(12)]
    assert run(spark, wide) == plain(wide)
    assert ce.nearest(np.array([[1 << 28, 0]]), np.array([[0, 0], [(1 << 28) - 3, 1]]))[1].tolist() == [10]
    with pytest.raises(ValueError):
        ce.nearest(np.array([[1 << 40]]), np.array([[0]]))
