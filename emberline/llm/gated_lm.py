"""A gated recurrent language model in numpy.

One GRU layer with a class-factored softmax, P(w | h) = P(class | h) P(w | class, h),
trained by back-propagation through windows of a fixed length. The state is
carried from window to window, so a document's log-likelihood is that of the
complete document. Many documents advance together, one per lane.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np

HIDDEN = 16
#: Documents that advance together, steps of a window, windows filled at once.
LANES, STEPS, WINDOWS = 512, 32, 8
#: Steps of a window when texts are scored, which changes no score: fewer products, each of more columns.
SCORED = 128
#: Ids of the two special tokens, each a class of its own; words follow from 2 by falling count.
UNKNOWN, END = 0, 1
RATE, CLIP = 0.02, 1.0
#: Logits below this need no shift before their exponents are taken in single precision.
SAFE = 60.0
#: Columns whose class logits are held at once, so that they stay in the cache.
CHUNK = 1024


class Layout:
    """Classes of the ids: class c holds the ids from starts[c] to starts[c + 1].

    Words are dealt to about sqrt(words) classes of equal shares of the square roots
    of their counts, so common words are in small classes and a token's cost is low.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = np.asarray(counts, float)
        self.size = len(self.counts)
        words = self.size - 2
        classes = max(1, min(words, 254, int(round(words**0.5)))) if words else 0
        share = np.cumsum(np.sqrt(self.counts[2:] + 0.5)) if words else np.zeros(0)
        cuts = np.searchsorted(share, share[-1] * np.arange(classes) / classes, side="right") if words else np.zeros(0, int)
        self.starts = np.concatenate([[0, 1], np.unique(cuts) + 2, [self.size]]).astype(np.int64)
        self.classes = len(self.starts) - 1
        self.of = np.repeat(np.arange(self.classes), np.diff(self.starts)).astype(np.uint8)


def shapes(layout: Layout, hidden: int = HIDDEN) -> dict[str, tuple]:
    v, c = layout.size, layout.classes
    return {"emb": (v, hidden), "wx": (hidden, 3 * hidden), "wh": (hidden, 3 * hidden), "b": (3 * hidden,), "wc": (hidden, c), "bc": (c,), "wo": (v, hidden), "bo": (v,)}


def initial(layout: Layout, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters that give the unigram distribution of the counts exactly."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * (0.3 if k == "emb" else 1 / np.sqrt(s[0]))).astype(np.float32) if len(s) == 2 else np.zeros(s, np.float32) for k, s in shapes(layout).items()}
    p["wc"] *= 0
    p["wo"] *= 0
    share = layout.counts + 0.5
    total = np.add.reduceat(share, layout.starts[:-1])
    p["bc"] = np.log(total / total.sum()).astype(np.float32)
    p["bo"] = np.log(share / total[layout.of]).astype(np.float32)
    return p


def pack(p: dict) -> bytes:
    return b"".join(np.ascontiguousarray(x, np.float32).tobytes() for x in p.values())


def unpack(data: bytes, layout: Layout) -> dict[str, np.ndarray]:
    out, at = {}, 0
    flat = np.frombuffer(data, np.float32)
    for k, s in shapes(layout).items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).copy()
        at += n
    return out


class Block:
    """Inputs, targets, resets and the documents' spans of some windows, by lane."""

    __slots__ = ("x", "y", "fresh", "real", "spans", "lanes")

    def __init__(self, x, y, fresh, real, spans, lanes):
        self.x, self.y, self.fresh, self.real, self.spans, self.lanes = x, y, fresh, real, spans, lanes


class Window:
    """One window of a block: tokens (step, lane) of the block's lanes ``rows``."""

    __slots__ = ("x", "y", "fresh", "real", "rows", "at")

    def __init__(self, block: Block, rows: np.ndarray, at: int, end: int):
        cut = lambda v: np.ascontiguousarray((v[:, at:end] if len(rows) == len(v) else v[rows, at:end]).T)
        self.x, self.y, self.fresh, self.real = cut(block.x), cut(block.y), cut(block.fresh), cut(block.real)
        self.rows, self.at = rows, at


def blocks(docs: Iterable[tuple[object, np.ndarray]], lanes: int = LANES, steps: int = STEPS * WINDOWS) -> Iterator[Block]:
    """Blocks over documents (key, target ids), each document in one lane.

    ``Block.lanes`` lists which lanes of the previous block go on: at the end of the
    input, empty lanes are left out. Spans are (key, lane, start, end, last).
    """
    source, held, ended = iter(docs), [None] * lanes, False
    keep = np.arange(lanes)
    while True:
        n = len(held)
        x, y = np.zeros((n, steps), np.int32), np.zeros((n, steps), np.int32)
        fresh, real, spans = np.zeros((n, steps), bool), np.zeros((n, steps), bool), []
        for b in range(n):
            t = 0
            while t < steps:
                doc = held[b]
                if doc is None:
                    if ended:
                        break
                    found = next(source, None)
                    if found is None:
                        ended = True
                        break
                    doc = held[b] = [found[0], found[1], 0]
                key, ids, at = doc
                m = min(steps - t, len(ids) - at)
                y[b, t : t + m] = ids[at : at + m]
                if at:
                    x[b, t : t + m] = ids[at - 1 : at + m - 1]
                else:
                    x[b, t] = END
                    x[b, t + 1 : t + m] = ids[: m - 1]
                    fresh[b, t] = True
                at += m
                doc[2] = at
                spans.append((key, b, t, t + m, at == len(ids)))
                t += m
                if at == len(ids):
                    held[b] = None
            real[b, :t] = True
        if not spans:
            return
        yield Block(x, y, fresh, real, spans, keep)
        if ended:
            keep = np.array([b for b in range(n) if held[b] is not None], np.int64)
            held = [held[b] for b in keep]
            if not held:
                return
        else:
            keep = np.arange(n)


def windows(block: Block, steps: int = STEPS) -> Iterator[Window]:
    """The windows of a block, each over the lanes that still have tokens."""
    length = block.real.sum(axis=1)  # tokens of a lane have no gaps
    for at in range(0, block.real.shape[1], steps):
        rows = np.flatnonzero(length > at)
        if not len(rows):
            return
        yield Window(block, rows, at, at + steps)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    np.negative(v, out=v)
    np.exp(v, out=v)
    v += 1
    return np.reciprocal(v, out=v)


def _tanh(v: np.ndarray) -> np.ndarray:
    """In place, by one exponent, which takes a third of numpy's own hyperbolic tangent."""
    v *= 2
    _sigmoid(v)
    v *= 2
    v -= 1
    return v


class Room:
    """Arrays that windows use in turn, so that no window asks for memory and touches it anew."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)


def inputs(p: dict) -> np.ndarray:
    """What each id gives to the gates (ids, 3 * hidden)."""
    out = p["emb"] @ p["wx"]
    out += p["b"]
    return out


def forward(p: dict, w: Window, state: np.ndarray, keep_trace: bool, given: np.ndarray | None = None, room: Room | None = None) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Hidden outputs (hidden, steps * lanes), the last state, and the trace.

    Features come before lanes in every array, so that each operation runs along lanes, and a step's arrays lie
    together. The trace is, for each step, the state before, the gates with what the state gives to the candidate,
    and the candidate. ``given`` is ``inputs(p)``, if known; what is returned lies in ``room`` until its next use.
    """
    steps, n = w.x.shape
    k = p["wh"].shape[0]
    room = room or Room()
    given = inputs(p) if given is None else given
    out = room("out", k, steps, n)
    kept = steps if keep_trace else 1
    before, gates, candidates = room("before", kept, k, n), room("gates", kept, 3 * k, n), room("candidates", kept, k, n)
    new, wht = room("new", k, n), p["wh"].T.copy()
    new[:] = state
    any_fresh = w.fresh.any(axis=1)
    for t in range(steps):
        h, g, c = before[t % kept], gates[t % kept], candidates[t % kept]
        h[:] = new
        if any_fresh[t]:
            h[:, w.fresh[t]] = 0
        pre = given.take(w.x[t], axis=0, mode="clip").T
        np.matmul(wht, h, out=g)
        g[: 2 * k] += pre[: 2 * k]
        _sigmoid(g[: 2 * k])
        np.multiply(g[k : 2 * k], g[2 * k :], out=c)
        c += pre[2 * k :]
        _tanh(c)
        np.subtract(h, c, out=new)
        new *= g[:k]
        new += c
        out[:, t] = new
    return out.reshape(k, steps * n), new, (before, gates, candidates)


def _exp(logits: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """Exponents in place, their sums over the rows, and what was subtracted first."""
    top = 0.0
    if bound >= SAFE:
        top = logits.max(axis=0)
        logits -= top
    np.exp(logits, out=logits)
    return logits, np.ones(len(logits), np.float32) @ logits, top


def _sorted(layout: Layout, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the targets by class, their classes in it, and each class's end."""
    cls = layout.of[y]
    order = np.argsort(cls, kind="stable")  # by radix
    return order, cls[order].astype(np.int64), np.cumsum(np.bincount(cls, minlength=layout.classes))


def _reach(p: dict) -> tuple[float, np.ndarray]:
    """Bounds of the logits of classes, and of every word: outputs are within 1."""
    return float((np.abs(p["wc"]).sum(0) + np.abs(p["bc"])).max(initial=0)), np.abs(p["wo"]).sum(1) + np.abs(p["bo"])


def _beside(bias: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each row's bias and weights."""
    return np.concatenate([bias[:, None], weights], axis=1)


def _columns(h: np.ndarray, at: np.ndarray, room: Room) -> np.ndarray:
    """Columns ``at`` of ``h`` below a row of ones, which carries the biases."""
    out = room("columns", 1 + len(h), len(at))
    out[0] = 1
    out[1:] = h.take(at, axis=1, mode="clip")
    return out


def _softmax(table: np.ndarray, h: np.ndarray, picks: np.ndarray, bound: float, room: Room) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Exponents for rows of ``table`` and columns of ``h``, the picked rows' flat places, the columns' sums and the picks' logarithms."""
    width = h.shape[1]
    e = np.matmul(table, h, out=room("logits", len(table), width))
    places = picks * width
    places += np.arange(width)
    own = e.reshape(-1).take(places)
    e, total, top = _exp(e, bound)
    own -= np.log(total)
    own -= top
    return e, places, total, own


def log_probs(p: dict, layout: Layout, h: np.ndarray, y: np.ndarray, bounds: tuple[float, np.ndarray] | None = None, room: Room | None = None) -> np.ndarray:
    """Natural log of P(y | h) for columns of h; ``bounds`` are those of ``_reach``, if known."""
    room = room or Room()
    order, cls, ends = _sorted(layout, y)
    h, y = _columns(h, order, room), y[order]
    most, reach = bounds or _reach(p)
    ac, ao, lp = _beside(p["bc"], p["wc"].T), _beside(p["bo"], p["wo"]), np.empty(len(y))
    for at in range(0, len(y), CHUNK):
        near = slice(at, at + CHUNK)
        lp[near] = _softmax(ac, h[:, near], cls[near], most, room)[3]
    at = 0
    for c, end in enumerate(ends.tolist()):
        start, stop = layout.starts[c], layout.starts[c + 1]
        if at < end and stop - start > 1:
            lp[at:end] += _softmax(ao[start:stop], h[:, at:end], y[at:end] - start, float(reach[start:stop].max()), room)[3]
        at = end
    out = np.empty(len(y))
    out[order] = lp
    return out


def gradients(p: dict, layout: Layout, w: Window, state: np.ndarray, room: Room | None = None) -> tuple[dict, np.ndarray, float]:
    """Gradient of the mean loss over the window's tokens; the last state; loss.

    What a column's exponents are to be multiplied by goes to its few outputs, not to its many logits. The last
    state lies in ``room`` until its next use.
    """
    room = room or Room()
    out, last, (before, gates, candidates) = forward(p, w, state, True, None, room)
    steps, n = w.x.shape
    k = len(out)
    real = np.flatnonzero(w.real.reshape(-1))
    y = w.y.reshape(-1)[real]
    order, cls, ends = _sorted(layout, y)
    real, y = real[order], y[order]
    kind = p["wc"].dtype
    h = _columns(out, real, room)
    scale = kind.type(1 / len(y))
    most, reach = _reach(p)
    ac, ao = _beside(p["bc"], p["wc"].T), _beside(p["bo"], p["wo"])
    gc, go, dh = np.zeros_like(ac), np.zeros_like(ao), room("outputs", k, len(y) + 1)
    dh[:] = 0  # and stays so in the last column, that of tokens that aren't real

    def part(table, grad, at: int, end: int, picks, bound: float) -> float:
        """The loss and gradients of a softmax over rows of ``table``, of which the columns' targets are ``picks``."""
        hc = h[:, at:end]
        e, places, total, own = _softmax(table, hc, picks, bound, room)
        flat = e.reshape(-1)
        flat[places] = flat.take(places) - total
        share = scale / total
        grad += e @ (hc * share).T
        back = table[:, 1:].T @ e
        back *= share
        dh[:, at:end] += back
        return -float(own.sum())

    loss = 0.0
    for at in range(0, len(y), CHUNK):
        end = min(at + CHUNK, len(y))
        loss += part(ac, gc, at, end, cls[at:end], most)
    at = 0
    for c, end in enumerate(ends.tolist()):
        start, stop = layout.starts[c], layout.starts[c + 1]
        if at < end and stop - start > 1:
            loss += part(ao[start:stop], go[start:stop], at, end, y[at:end] - start, float(reach[start:stop].max()))
        at = end
    g = {"wc": gc[:, 1:].T.copy(), "bc": gc[:, 0].copy(), "wo": go[:, 1:].copy(), "bo": go[:, 0].copy()}
    place = np.full(steps * n, len(y))
    place[real] = np.arange(len(y))
    place = place.reshape(steps, n)
    read = p["emb"].take(w.x, axis=0, mode="clip")
    # rows of what the state gave to the candidate, of the gates, and of the candidate: the first three quarters go
    # back to the state, the last three to the inputs
    d, dx, carry, keep = room("gate gradients", 4 * k, n), room("input gradients", steps, k, n), np.zeros((k, n), np.float32), room("keep", k, n)
    dhn, dz, dr, dc = d[:k], d[k : 2 * k], d[2 * k : 3 * k], d[3 * k :]
    wh, gwh, gwx, gb = np.roll(p["wh"], k, axis=1), np.zeros((3 * k, k), kind), np.zeros((3 * k, k), kind), np.zeros(3 * k, kind)
    any_fresh, ones = w.fresh.any(axis=1), np.ones(n, np.float32)
    for t in range(steps - 1, -1, -1):
        prev, (z, r, hn), c = before[t], gates[t].reshape(3, k, n), candidates[t]
        carry += dh.take(place[t], axis=1, mode="clip")  # of the new state
        np.subtract(1, z, out=keep)
        np.multiply(c, c, out=dc)
        np.subtract(1, dc, out=dc)
        dc *= carry
        dc *= keep
        carry *= z
        np.subtract(prev, c, out=dz)
        dz *= carry
        dz *= keep
        np.multiply(dc, r, out=dhn)
        np.multiply(dhn, hn, out=dr)
        np.subtract(1, r, out=keep)
        dr *= keep
        gwh += d[: 3 * k] @ prev.T
        gwx += d[k:] @ read[t]
        gb += d[k:] @ ones
        np.matmul(p["wx"], d[k:], out=dx[t])
        carry += wh @ d[: 3 * k]
        if any_fresh[t]:
            carry[:, w.fresh[t]] = 0
    ids = w.x.reshape(-1)
    g["wh"], g["wx"], g["b"], g["emb"] = np.roll(gwh, -k, axis=0).T.copy(), gwx.T.copy(), gb, np.empty_like(p["emb"])
    for f in range(k):
        g["emb"][:, f] = np.bincount(ids, weights=dx[:, f].reshape(-1), minlength=layout.size)
    return g, last, loss


class Adam:
    def __init__(self, p: dict):
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.t = 0

    def step(self, p: dict, g: dict, rate: float = RATE) -> None:
        norm = float(np.sqrt(sum(float(np.vdot(x, x)) for x in g.values())))
        shrink = np.float32(min(1.0, CLIP / (norm + 1e-9)))
        self.t += 1
        fix = np.float32(np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
        for k, x in g.items():
            m, v = self.m[k], self.v[k]
            x *= shrink
            d = x - m
            d *= np.float32(0.1)
            m += d
            np.multiply(x, x, out=d)
            d -= v
            d *= np.float32(0.01)
            v += d
            np.sqrt(v, out=d)
            d += np.float32(1e-6)
            np.divide(m, d, out=d)
            d *= np.float32(rate) * fix
            p[k] -= d


def train_on(p: dict, adam: Adam, layout: Layout, docs: Iterable[tuple[object, np.ndarray]]) -> int:
    """One pass over documents' ids from where ``p`` and ``adam`` stand, which it moves; the tokens seen."""
    tokens = 0
    states, room = np.zeros((HIDDEN, LANES), np.float32), Room()
    for block in blocks(docs):
        states = states[:, block.lanes]
        for w in windows(block):
            g, last, _ = gradients(p, layout, w, states[:, w.rows], room)
            states[:, w.rows] = last
            real = int(w.real.sum())
            # short windows, where few documents are left, move the model less
            adam.step(p, g, RATE * real / (LANES * STEPS))
            tokens += real
    return tokens


def train(p: dict, layout: Layout, docs: Iterable[tuple[object, np.ndarray]]) -> tuple[dict, int]:
    """One pass over documents' ids; the trained parameters and tokens seen."""
    p = {k: v.copy() for k, v in p.items()}
    return p, train_on(p, Adam(p), layout, docs)


def score(p: dict, layout: Layout, docs: Iterable[tuple[object, np.ndarray]]) -> Iterator[tuple[object, float]]:
    """(key, natural log-likelihood of the whole document) as documents end."""
    states = np.zeros((HIDDEN, LANES), np.float32)
    totals: dict[object, float] = {}
    given, bounds, room = inputs(p), _reach(p), Room()
    for block in blocks(docs):
        states = states[:, block.lanes]
        sums = np.zeros((block.y.shape[0], block.y.shape[1] + 1))
        for w in windows(block, SCORED):
            out, states[:, w.rows], _ = forward(p, w, states[:, w.rows], False, given, room)
            real = np.flatnonzero(w.real.reshape(-1))
            lp = np.zeros(w.real.size)
            lp[real] = log_probs(p, layout, out.take(real, axis=1), w.y.reshape(-1)[real], bounds, room)
            sums[w.rows, w.at + 1 : w.at + 1 + len(w.y)] = lp.reshape(w.y.shape).T
        np.cumsum(sums, axis=1, out=sums)
        for key, b, start, end, last in block.spans:
            total = totals.pop(key, 0.0) + sums[b, end] - sums[b, start]
            if last:
                yield key, float(total)
            else:
                totals[key] = total
