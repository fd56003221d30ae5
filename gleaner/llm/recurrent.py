"""A gated recurrent word model with a class-factored output, in numpy.

P(token | past) = P(class | state) * P(token | class, state). Frequent words fall into classes of neighbours in
frequency, small ones (SIZES) where words are most frequent, and have their own output vectors. The other words are spread over
``RARE`` classes by their last bytes (endings tell languages and word kinds apart); within such a class
a word has its smoothed share of the class's training tokens, whatever the state.
"""

from __future__ import annotations

import bisect
import heapq
import zlib

import numpy as np

RARE = 16
FAR = 60  # sums below it, and their exponentials' products, are within single precision
PART = 1024  # columns whose class probabilities are worked out together, so that they stay in a core's cache
SIZES = (16,) * 8 + (32,) * 8 + (64,) * 10  # words of the first classes; later ones have 128


def rare_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % RARE


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In the place of ``x``."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _take(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Columns of a table; ``at`` is within it, which "clip" doesn't check in a pass of its own."""
    return np.take(table, at, 1, mode="clip")


def _far(weights: np.ndarray, reach: float) -> bool:
    """Whether a sum of these weights, the last column being biases, with a state within ``reach`` may be too far from 0 for ``exp``."""
    size = np.abs(weights)
    return not bool((size[:, :-1].sum(1) * reach + size[:, -1]).max(initial=0) < FAR)


def _soft(weights: np.ndarray, state: np.ndarray, own: np.ndarray, far: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logarithm of the share of ``own`` in each column, not yet divided by all; exponentials; their sums)."""
    x = weights @ state
    if far:
        x -= x.max(0)
    found = x[own, np.arange(len(own))]
    np.exp(x, out=x)
    return found, x, np.add.reduce(x, 0)


class Adam:
    def __init__(self, model: Gru):
        self.model, self.turn = model, 0
        self.m, self.v = ({k: np.zeros_like(w) for k, w in model.p.items()} for _ in range(2))

    def step(self, grad: dict[str, np.ndarray], rate: float) -> None:
        """What ``grad`` holds is used up."""
        self.turn += 1
        slow, fast = (1 - 0.99**self.turn) ** -0.5, rate / (1 - 0.9**self.turn)
        for k, g in grad.items():
            m, v = self.m[k], self.v[k]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            g *= g
            g *= 0.01
            v += g
            np.sqrt(v, out=g)
            g *= slow
            g += 1e-7
            np.divide(m, g, out=g)
            g *= fast
            self.model.p[k] -= g


class Gru:
    """Ids 0..n_words-1 are words by falling frequency, n_words..n_words+RARE-1 the rare classes."""

    def __init__(self, n_words: int, hidden: int = 16, seed: int = 5):
        r = np.random.default_rng(seed)
        self.n, self.h = n_words, hidden
        sizes = [*SIZES, *[128] * (max(0, n_words - sum(SIZES)) // 128 + 1)]
        self.edge = np.minimum(np.cumsum([0, *sizes]), n_words)
        self.edge = self.edge[: int(np.searchsorted(self.edge, n_words)) + 1]  # class k has words edge[k] to edge[k + 1] - 1
        self.word_classes = len(self.edge) - 1
        self.classes = np.concatenate([np.repeat(np.arange(self.word_classes), np.diff(self.edge)), self.word_classes + np.arange(RARE)]).astype(np.int16)
        c = self.word_classes + RARE
        shape = {"x": (n_words + RARE, 3 * hidden), "u": (hidden, 3 * hidden), "b": (3 * hidden,), "wc": (hidden, c), "bc": (c,), "ww": (n_words, hidden), "bw": (n_words,)}
        self.p = {k: (r.normal(0, 0.3 if k in "xu" else 0.1, s) if k not in ("b", "bc", "bw") else np.zeros(s)).astype(np.float32) for k, s in shape.items()}

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return self.classes[ids]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """What tokens (steps, lanes) bring to each step: (steps, 3 * hidden, lanes)."""
        brought = _take(np.ascontiguousarray((self.p["x"] + self.p["b"]).T), x.ravel())
        return brought.reshape(-1, *x.shape).transpose(1, 0, 2)

    def step(self, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        """The next state (hidden, lanes) from a step's inputs and the state before; what the way back needs of it.

        Lanes are the columns, so that gates are whole rows and each operation runs over contiguous numbers.
        """
        k = self.h
        s = self.p["u"].T @ h
        zr = _sigmoid(g[: 2 * k] + s[: 2 * k])
        z, r = zr[:k], zr[k:]
        n = r * s[2 * k :]
        n += g[2 * k :]
        np.tanh(n, out=n)
        after = h - n
        after *= z
        after += n
        return after, (h, z, r, n, s[2 * k :])

    def log_probs(self, h: np.ndarray, y: np.ndarray, grad: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each y (rare: of its class) after the state in its column of h; with ``grad``, adds to it and returns dloss/dh."""
        p, c, n, k = self.p, self.class_of(y), len(y), self.h
        states = np.concatenate([h, np.ones((1, n), h.dtype)])  # the last row brings the biases
        wc, ww = np.concatenate([p["wc"].T, p["bc"][:, None]], 1), np.concatenate([p["ww"], p["bw"][:, None]], 1)
        reach = float(np.abs(h).max(initial=0))
        out, total, dh, dwc = np.empty(n, h.dtype), np.empty(n, h.dtype), np.empty_like(h), np.zeros_like(wc)
        far = _far(wc, reach)
        for part in (slice(at, at + PART) for at in range(0, n, PART)):
            state, own = states[:, part], c[part]
            out[part], e, total[part] = _soft(wc, state, own, far)
            if grad is not None:
                e[own, np.arange(len(own))] -= total[part]
                share = 1 / total[part]
                dwc += e @ (state * share).T
                np.multiply(wc[:, :k].T @ e, share, out=dh[:, part])
        out -= np.log(total)
        order = np.argsort(c, kind="stable")
        bounds = np.searchsorted(c[order], np.arange(self.word_classes + 1))
        order = order[: bounds[-1]]  # words with an output vector
        m = len(order)
        states, own = _take(states, order), y[order] - self.edge[c[order]]
        found, total, kept = np.empty(m, h.dtype), np.empty(m, h.dtype), []
        far = _far(ww, reach)
        for a, z, lo, hi in zip(self.edge.tolist(), self.edge[1:].tolist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
            if hi > lo:
                found[lo:hi], e, total[lo:hi] = _soft(ww[a:z], states[:, lo:hi], own[lo:hi], far)
                if grad is not None:
                    kept.append((a, z, lo, hi, e))
        found -= np.log(total)
        out[order] += found
        if grad is None:
            return out, None
        share, dww, back = 1 / total, np.zeros_like(ww), np.zeros((k, m + 1), h.dtype)
        states *= share  # what is divided by the sums are the few rows of the state
        for a, z, lo, hi, e in kept:
            e[own[lo:hi], np.arange(hi - lo)] -= total[lo:hi]
            np.matmul(e, states[:, lo:hi].T, out=dww[a:z])
            np.matmul(ww[a:z, :k].T, e, out=back[:, lo:hi])
        back[:, :m] *= share
        at = np.full(n, m)  # tokens without an output vector take the last column, zeros
        at[order] = np.arange(m)
        dh += _take(back, at)
        grad["wc"] += dwc[:, :k].T
        grad["bc"] += dwc[:, k]
        grad["ww"] += dww[:, :k]
        grad["bw"] += dww[:, k]
        return out, dh

    def learn(self, docs: list[np.ndarray], end: int, adam: Adam, rate: float = 0.02, lanes: int = 512, window: int = 24) -> None:
        """Truncated backpropagation: each lane reads documents one after the other, ``window`` tokens at a time; every token counts once.

        The state goes on into the next window; a document starts from the zero state, its first input being ``end``. Documents may
        come in several calls; the rate rises over the first windows of all and falls with their number.
        """
        x, y, fresh = self.lanes_of(docs, end, min(lanes, max(64, sum(map(len, docs)) // (64 * window))))
        h = np.zeros((self.h, len(y)), np.float32)
        for part in (slice(at, at + window) for at in range(0, y.shape[1], window)):
            grad, h = self._gradients(x[:, part], y[:, part], fresh[:, part], h)
            adam.step(grad, rate * min(1.0, (adam.turn + 1) / 20) / (1 + adam.turn / 100) ** 0.5)

    def lanes_of(self, docs: list[np.ndarray], end: int, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, targets and starts of documents, a lane in each row; what is short of a full matrix has target -1."""
        y = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        fresh = np.zeros(len(y), bool)
        fresh[np.cumsum([0, *map(len, docs[:-1])])[: len(y)]] = True
        x = np.where(fresh, end, np.roll(y, 1))
        length = -(-len(y) // max(1, min(lanes, len(y))))
        lanes = -(-len(y) // max(1, length))
        short = lanes * length - len(y)
        filled = ((x, end), (y, -1), (fresh, False))
        return tuple(np.concatenate([v, np.full(short, fill, v.dtype)]).reshape(lanes, length) for v, fill in filled)

    def _gradients(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        k, p, (lanes, steps) = self.h, self.p, x.shape
        grad = {name: np.zeros_like(w) for name, w in p.items()}
        states, kept, inputs = np.empty((k, steps, lanes), h.dtype), [], self.inputs(x.T)
        stays = ~fresh.T
        for t in range(steps):
            h, s = self.step(inputs[t], h * stays[t])
            states[:, t] = h
            kept.append(s)
        target, states = y.T.ravel(), states.reshape(k, -1)
        live = np.flatnonzero(target >= 0)
        if len(live) == len(target):
            dout = self.log_probs(states, target, grad)[1]
        else:
            dout = np.zeros_like(states)
            dout[:, live] = self.log_probs(states[:, live], target[live], grad)[1]
        dout = dout.reshape(k, steps, lanes)
        back, dg, ds = np.zeros_like(h), np.empty((3 * k, steps, lanes), h.dtype), np.empty((3 * k, lanes), h.dtype)
        for t in range(steps - 1, -1, -1):
            before, z, r, n, s = kept[t]
            d = dout[:, t]
            d += back
            new = d - d * z  # what the new part of the state gets; the rest goes on to the state before
            dz = before - n
            dz *= z
            np.multiply(dz, new, out=ds[:k])
            d -= new
            n *= n
            np.subtract(1, n, out=n)
            n *= new
            np.multiply(n, r, out=ds[2 * k :])
            s *= ds[2 * k :]
            np.subtract(1, r, out=r)
            np.multiply(s, r, out=ds[k : 2 * k])
            dg[: 2 * k, t], dg[2 * k :, t] = ds[: 2 * k], n
            grad["u"] += before @ ds.T
            back = p["u"] @ ds
            back += d
            back *= stays[t]
        dg, own = dg.reshape(3 * k, -1), x.T.ravel()
        grad["b"] += dg.sum(1)
        for row, column in zip(dg, grad["x"].T, strict=True):
            column += np.bincount(own, row, len(column))
        size = h.dtype.type(1 / max(1, len(live)))
        for g in grad.values():
            g *= size
            np.clip(g, -1, 1, out=g)
        return grad, h

    def copy(self) -> Gru:
        other = Gru(self.n, self.h)
        other.p = {k: w.copy() for k, w in self.p.items()}
        return other

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def fill(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            w = self.p[k]
            self.p[k] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size

    def score(self, docs: list[np.ndarray], end: int, lanes: int = 1024, window: int = 16384) -> np.ndarray:
        """Natural log probability of each document's ids.

        Lanes read whole documents one after the other, each from the zero state on. Tokens lie step by step, the lanes with most
        first, so that a step has only the lanes that reach so far; ``window`` is how many tokens' classes are worked out together.
        """
        size = np.fromiter(map(len, docs), np.int64, len(docs))
        out = np.zeros(len(docs))
        if not size.sum():
            return out
        loads = [(0, lane) for lane in range(int(max(1, min(lanes, (size > 0).sum()))))]
        own: list[list[int]] = [[] for _ in loads]
        for i in np.argsort(-size, kind="stable").tolist():  # the next longest document to the lane that has least
            if size[i]:
                load, lane = loads[0]
                own[lane].append(i)
                heapq.heapreplace(loads, (load + int(size[i]), lane))
        own.sort(key=lambda lane: -size[lane].sum())
        load = np.array([size[lane].sum() for lane in own])
        reach = np.searchsorted(-load, -np.arange(load[0]), "left")  # how many lanes have a token in each step
        at = np.concatenate([[0], np.cumsum(reach)])  # the first token of each step
        order = np.concatenate(own)
        first = np.cumsum(size[order]) - size[order]  # of each document, lane by lane
        place = np.concatenate([at[:n] + lane for lane, n in enumerate(load.tolist())])
        read = np.concatenate([docs[i] for i in order.tolist()])
        x, y = np.empty(len(read), np.int32), np.empty(len(read), np.int32)
        y[place] = read
        read = np.roll(read, 1)
        read[first] = end
        x[place] = read
        starts = np.sort(place[first])
        begun, at = np.searchsorted(starts, at).tolist(), at.tolist()
        table, found, h = np.ascontiguousarray((self.p["x"] + self.p["b"]).T), np.empty(len(read), np.float32), np.zeros((self.h, len(own)), np.float32)
        t = 0
        while t < load[0]:
            upto = max(t + 1, bisect.bisect_right(at, at[t] + window) - 1)
            part = slice(at[t], at[upto])
            inputs, states = _take(table, x[part]), np.empty((self.h, at[upto] - at[t]), np.float32)
            for t in range(t, upto):
                a, z = at[t] - part.start, at[t + 1] - part.start
                h = h[:, : z - a]
                if begun[t] < begun[t + 1]:
                    h[:, starts[begun[t] : begun[t + 1]] - at[t]] = 0
                h = states[:, a:z] = self.step(inputs[:, a:z], h)[0]
            found[part] = self.log_probs(states, y[part])[0]
            t = upto
        out[order] = np.add.reduceat(found[place], first, dtype=np.float64)
        return out
