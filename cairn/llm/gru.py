"""A gated recurrent language model in numpy: truncated backpropagation and a class-factored softmax.

Tokens are numbers: 0..K-1 are words with an output of their own, M to a class; K..K+R-1 stand for the
rare words of R classes, whose inner distribution is not the network's; K+R is the start of a text. An
input's row of ``x`` is what it adds to the three gates. Documents lie one after the other in lanes that
advance together; the state is set to zero where a document begins and carried from window to window.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

LANES, WINDOW = 512, 32
#: Tokens in a window that make a whole step.
FULL = LANES * WINDOW // 4
#: Steps in a window of few lanes, at most.
LONGEST = 512
#: Rows of a softmax that are worked on at once.
BLOCK = 4096


@dataclass
class Shape:
    classes: int
    members: int
    rare: int
    hidden: int

    @property
    def words(self) -> int:
        return self.classes * self.members

    def sizes(self) -> dict[str, tuple[int, ...]]:
        h, c = self.hidden, self.classes + self.rare
        return {"x": (self.words + self.rare + 1, 3 * h), "u": (h, 3 * h), "wc": (h, c), "bc": (c,), "ww": (self.classes, h, self.members), "bw": (self.classes, self.members)}


@dataclass
class Lanes:
    """Documents' positions in lanes, the longest lane first."""

    order: np.ndarray
    start: np.ndarray
    length: np.ndarray

    @staticmethod
    def pack(sizes: np.ndarray, lanes: int = LANES) -> Lanes:
        begin = np.cumsum(sizes) - sizes
        heap = [(0, k, []) for k in range(max(1, min(lanes, len(sizes))))]
        for d in np.argsort(-sizes, kind="stable").tolist():
            n, k, docs = heap[0]
            docs.append(d)
            heapq.heapreplace(heap, (n + int(sizes[d]), k, docs))
        heap.sort(key=lambda x: (-x[0], x[1]))
        docs = np.array([d for _, _, own in heap for d in own], np.int64)
        n = sizes[docs]
        ends = np.cumsum(n)
        order = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[docs] - (ends - n), n)
        length = np.array([x[0] for x in heap], np.int64)
        return Lanes(order, np.cumsum(length) - length, length)

    def windows(self):
        """For each window, the steps' positions: active lanes are always the first ones. Few lanes: longer windows."""
        top = int(self.length[0]) if len(self.length) else 0
        alive = np.searchsorted(-self.length, -np.arange(top), "left").tolist()
        t = 0
        while t < top:
            end = min(t + max(WINDOW, min(LONGEST, FULL // alive[t])), top)
            yield [self.order[self.start[: alive[s]] + s] for s in range(t, end)]
            t = end


@dataclass
class Trail:
    """A window that has been run: positions, each step's range, where texts begin, states, gates (a step's three after another)."""

    pos: np.ndarray
    edges: list[tuple[int, int]]
    stay: np.ndarray
    starts: np.ndarray
    states: np.ndarray
    gates: np.ndarray | None = None
    before: np.ndarray | None = None
    inner: np.ndarray | None = None

    @property
    def last(self) -> np.ndarray:
        return self.states[self.edges[-1][0] :]


@dataclass
class Gru:
    shape: Shape
    p: dict[str, np.ndarray]
    m: dict[str, np.ndarray] = field(default_factory=dict)
    v: dict[str, np.ndarray] = field(default_factory=dict)
    steps: int = 0

    @staticmethod
    def new(shape: Shape, counts: np.ndarray, seed: int = 1) -> Gru:
        """``counts`` of the K words and R rare classes set the biases, so it starts as a unigram model."""
        rng = np.random.default_rng(seed)
        p = {k: (rng.normal(size=s) * 0.1).astype(np.float32) for k, s in shape.sizes().items()}
        word = counts[: shape.words].reshape(shape.classes, shape.members) + 0.5
        p["bw"] = np.log(word / word.sum(1, keepdims=True)).astype(np.float32)
        whole = np.concatenate([word.sum(1), counts[shape.words :] + 0.5])
        p["bc"] = np.log(whole / whole.sum()).astype(np.float32)
        return Gru(shape, p)

    def vector(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.shape.sizes()])

    @staticmethod
    def of(shape: Shape, vector: np.ndarray) -> Gru:
        p, at = {}, 0
        for k, s in shape.sizes().items():
            n = int(np.prod(s))
            p[k] = vector[at : at + n].reshape(s).astype(np.float32)
            at += n
        return Gru(shape, p)

    def _split(self, name: str) -> np.ndarray:
        """A copy of ``x`` or ``u`` with each gate's columns apart: what steps work on lies together."""
        return self.p[name].reshape(-1, 3, self.shape.hidden).transpose(1, 0, 2).copy()

    def _run(self, window, given, fresh, h, keep) -> Trail:
        """The window's states, step after step in one array, and for backpropagation what made them."""
        x, u, k = self._split("x"), self._split("u"), self.shape.hidden
        x[:2] *= 0.5  # a gate is (1 + tanh(e / 2)) / 2
        u[:2] *= 0.5
        pos = np.concatenate(window)
        ends = np.cumsum([len(p) for p in window])
        edges = list(zip((ends - [len(p) for p in window]).tolist(), ends.tolist(), strict=True))
        stay, of = (1 - fresh[pos])[:, None], given[pos]
        t = Trail(pos, edges, stay, np.minimum.reduceat(stay[:, 0], [a for a, _ in edges]) == 0, np.empty((len(pos), k), u.dtype))
        size = 3 * k
        if keep:
            t.before, t.inner = np.empty_like(t.states), np.empty_like(t.states)
            t.gates = np.empty(size * len(pos), u.dtype)
        scratch, own_scratch = (np.empty(size * len(window[0]), u.dtype) for _ in range(2))  # steps only get narrower
        for (a, b), starts in zip(edges, t.starts, strict=True):
            h = h[: b - a] * stay[a:b] if starts else h[: b - a]
            own = np.matmul(h, u, out=own_scratch[: size * (b - a)].reshape(3, b - a, k))
            whole = (t.gates[size * a : size * b] if keep else scratch[: size * (b - a)]).reshape(3, b - a, k)
            x.take(of[a:b], 1, whole, "clip")
            gate, new, out = whole[:2], whole[2], t.states[a:b]
            gate += own[:2]
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
            inner = own[2]
            if keep:
                t.before[a:b], t.inner[a:b] = h, inner
            inner *= gate[0]
            new += inner
            np.tanh(new, out=new)
            np.subtract(h, new, out=out)
            out *= gate[1]
            out += new
            h = out
        return t

    @staticmethod
    def _part(hs, w, b, pick, want_grads: bool):
        """Log-probability of the picked column of each row, or the gradient of the logits."""
        e = hs @ w
        e += b
        e -= e.max()  # one for all: rows do not lie far apart
        rows = np.arange(len(pick))
        target = None if want_grads else e[rows, pick]
        np.exp(e, out=e)
        total = np.maximum(e @ np.ones(e.shape[1], e.dtype), 1e-30)
        if want_grads:
            e *= (-1 / total)[:, None]
            e[rows, pick] += 1
            return None, e
        return target - np.log(total), e

    def _softmax(self, hs, want, grads=None):
        """Natural log-probability of each wanted token (for rare ones: of their class); or gradients, if asked for."""
        s, p, learn = self.shape, self.p, grads is not None
        cls = np.where(want < s.words, want // s.members, want - s.words + s.classes).astype(np.int16)
        order = np.argsort(cls, kind="stable")  # by radix
        hs, cls, member = hs[order], cls[order], want[order] % s.members
        edges = np.searchsorted(cls, np.arange(s.classes + 1)).tolist()
        lp, dh = np.empty(len(order)), np.empty_like(hs) if learn else None
        if learn:
            grads |= {k: np.zeros_like(p[k]) for k in ("wc", "bc", "ww", "bw")}
        for a in range(0, len(order), BLOCK):  # of rows that stay in the cache
            b = min(a + BLOCK, len(order))
            found, e = self._part(hs[a:b], p["wc"], p["bc"], cls[a:b], learn)
            if learn:
                grads["wc"] += hs[a:b].T @ e
                grads["bc"] += e.sum(0)
                np.matmul(e, p["wc"].T, out=dh[a:b])
            else:
                lp[a:b] = found
        for c, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if a == b:
                continue
            found, e = self._part(hs[a:b], p["ww"][c], p["bw"][c], member[a:b], learn)
            if learn:
                grads["ww"][c], grads["bw"][c] = hs[a:b].T @ e, e.sum(0)
                dh[a:b] += e @ p["ww"][c].T
            else:
                lp[a:b] += found
        made = dh if learn else lp
        back = np.empty_like(made)
        back[order] = made
        return back

    def score(self, given, want, fresh, lanes: Lanes) -> np.ndarray:
        """Log-probability (natural) of every position."""
        lp = np.zeros(len(want))
        h = np.zeros((len(lanes.length), self.shape.hidden), self.p["u"].dtype)
        for window in lanes.windows():
            t = self._run(window, given, fresh, h, False)
            h = t.last
            lp[t.pos] = self._softmax(t.states, want[t.pos])
        return lp

    def train(self, given, want, fresh, lanes: Lanes, rate: float = 0.005) -> int:
        """One pass over all windows, states carried, gradients cut at each window's start. Tokens learned from."""
        h = np.zeros((len(lanes.length), self.shape.hidden), self.p["u"].dtype)
        for window in lanes.windows():
            t = self._run(window, given, fresh, h, True)
            h = t.last
            grads: dict[str, np.ndarray] = {}
            self._back(t, given, self._softmax(t.states, want[t.pos], grads), grads)
            self._step(grads, len(t.pos), rate)
        return len(want)

    def _back(self, t: Trail, given, dhs, grads):
        k, n_all = self.shape.hidden, len(t.pos)
        dx, dnew, down = np.empty((3, n_all, k), t.states.dtype), np.empty_like(t.states), self._split("u").transpose(0, 2, 1).copy()
        carried = dhs[:0]
        for (a, b), starts in zip(reversed(t.edges), t.starts[::-1], strict=True):  # what a step needs stays in the cache
            r, z, n = t.gates[3 * k * a : 3 * k * b].reshape(3, b - a, k)
            dh, d, dn = dhs[a:b], dx[:, a:b], dnew[a:b]
            dh[: len(carried)] += carried
            kept = dh * z
            np.subtract(dh, kept, out=dn)
            to_n = n * n
            np.subtract(1, to_n, out=to_n)
            dn *= to_n
            np.multiply(dn, r, out=d[2])
            np.subtract(1, r, out=to_n)
            to_n *= t.inner[a:b]
            np.multiply(to_n, d[2], out=d[0])
            np.subtract(t.before[a:b], n, out=to_n)
            to_n *= kept
            np.subtract(1, z, out=d[1])
            d[1] *= to_n
            back = np.matmul(d, down)
            carried = back[0]
            carried += back[1]
            carried += back[2]
            carried += kept
            if starts:
                carried *= t.stay[a:b]
        grads["u"] = np.concatenate(np.matmul(t.before.T, dx), axis=1)
        of = given[t.pos].astype(np.int16 if len(self.p["x"]) < 1 << 15 else np.int32)
        order = np.argsort(of, kind="stable")
        of = of[order]
        rows = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        sums = [np.add.reduceat(g.take(order, 0), rows, axis=0) for g in (dx[0], dx[1], dnew)]
        grads["x"] = (of[rows], np.concatenate(sums, axis=1))

    def _step(self, grads, n: int, rate: float):
        """Adam, upwards; rows of ``x`` that were not given are left alone. Windows of few tokens move less."""
        self.steps += 1
        rate *= min(1.0, n / FULL)
        fix = np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        for k, g in grads.items():
            if k not in self.m:
                self.m[k], self.v[k] = np.zeros_like(self.p[k]), np.zeros_like(self.p[k])
            rows, g = g if k == "x" else (slice(None), g)
            g = np.clip(g / n * 100, -5, 5)
            m = self.m[k][rows] = 0.9 * self.m[k][rows] + 0.1 * g
            v = self.v[k][rows] = 0.99 * self.v[k][rows] + 0.01 * g * g
            self.p[k][rows] += rate * fix * m / (np.sqrt(v) + 1e-3)
