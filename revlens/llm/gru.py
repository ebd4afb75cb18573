"""A small gated recurrent network over word classes, in numpy.

Predicts the class of the next word (or the end of the document) from the classes so
far. Trained by truncated backpropagation: streams of documents run side by side in
windows, gradients stop at a window's edge, the state goes on and is cleared where a
document ends.
"""

from __future__ import annotations

import numpy as np

HIDDEN, STEPS, STREAMS = 16, 16, 512
#: Windows that a sequence gives at least, if it is long enough: short ones run in
#: fewer streams.
WINDOWS = 24


def shapes(classes: int, hidden: int = HIDDEN) -> list[tuple[int, ...]]:
    """Of the parameters: input by class, recurrent, output and its bias. Class
    `classes` is the end of a document, and stands before its first word."""
    return [(classes + 1, 3 * hidden), (hidden, 3 * hidden), (hidden, classes + 1), (classes + 1,)]


def unpack(flat: np.ndarray, classes: int, hidden: int = HIDDEN) -> list[np.ndarray]:
    out, at = [], 0
    for shape in shapes(classes, hidden):
        n = int(np.prod(shape))
        out.append(flat[at : at + n].reshape(shape))
        at += n
    return out


def initial(classes: int, share: np.ndarray, hidden: int = HIDDEN, seed: int = 7) -> np.ndarray:
    """Start weights; the output bias begins at the classes' shares."""
    rng = np.random.default_rng(seed)
    x, u, v, b = (np.zeros(s) for s in shapes(classes, hidden))
    x[:] = rng.normal(0, 0.3, x.shape)
    u[:] = rng.normal(0, 0.2, u.shape)
    v[:] = rng.normal(0, 0.1, v.shape)
    b[:] = np.log(np.maximum(share, 1e-7))
    return np.concatenate([p.ravel() for p in (x, u, v, b)]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def step(x, u, before, h, hidden: int = HIDDEN):
    """One step: gates and the new state."""
    a = x[before]
    r_z = _sigmoid(a[:, : 2 * hidden] + h @ u[:, : 2 * hidden])
    r, z = r_z[:, :hidden], r_z[:, hidden:]
    n = np.tanh(a[:, 2 * hidden :] + (r * h) @ u[:, 2 * hidden :])
    return r, z, n, n + z * (h - n)


def log_likelihood(flat: np.ndarray, classes: int, docs: list[np.ndarray], hidden: int = HIDDEN) -> np.ndarray:
    """Natural log probability of each document's classes and its end, from the
    first word to the last. Documents run side by side, the longest first."""
    x, u, v, b = unpack(flat, classes, hidden)
    size = np.array([len(d) for d in docs], np.int64)
    order = np.argsort(-size, kind="stable")
    out = np.zeros(len(docs))
    first = np.concatenate(([0], np.cumsum(size)))[:-1]
    flat_docs = np.concatenate([*docs, np.zeros(1, np.int16)])
    h = np.zeros((len(docs), hidden), np.float32)
    before = np.full(len(docs), classes, np.int64)
    active = len(docs)
    ordered, starts = size[order], first[order]
    for t in range(int(ordered[0]) + 1 if len(docs) else 0):
        while active and ordered[active - 1] < t:
            active -= 1
        h = step(x, u, before[:active], h[:active], hidden)[3]
        scores = h @ v + b
        ends = ordered[:active] == t
        now = np.where(ends, classes, flat_docs[np.minimum(starts[:active] + t, len(flat_docs) - 1)]).astype(np.int64)
        top = scores.max(1, keepdims=True)
        log_sum = np.log(np.exp(scores - top).sum(1)) + top[:, 0]
        out[order[:active]] += scores[np.arange(active), now] - log_sum
        before = now
    return out


class Trainer:
    """Adam over windows of parallel streams."""

    def __init__(self, flat: np.ndarray, classes: int, rate: float, hidden: int = HIDDEN):
        self.flat, self.classes, self.rate, self.hidden = flat.astype(np.float32).copy(), classes, rate, hidden
        self.m, self.s, self.t, self.tokens = np.zeros_like(self.flat), np.zeros_like(self.flat), 0, 0

    def learn(self, sequence: np.ndarray, streams: int = STREAMS, steps: int = STEPS) -> None:
        """One pass over a sequence of documents, each closed by the end class."""
        streams = max(1, min(streams, len(sequence) // (steps * WINDOWS)))
        length = -(-len(sequence) // streams)
        padded = np.full(streams * length, -1, np.int64)
        padded[: len(sequence)] = sequence
        grid = padded.reshape(streams, length)
        before = np.full(streams, self.classes, np.int64)
        h = np.zeros((streams, self.hidden), np.float32)
        for at in range(0, length, steps):
            h, before = self._window(grid[:, at : at + steps], before, h)
        self.tokens += len(sequence)

    def _window(self, target: np.ndarray, before: np.ndarray, h: np.ndarray):
        x, u, v, b = unpack(self.flat, self.classes, self.hidden)
        k, n_streams = self.hidden, len(target)
        tape, losses = [], []
        for t in range(target.shape[1]):
            h = np.where((before == self.classes)[:, None], np.float32(0), h)
            r, z, n, after = step(x, u, before, h, k)
            tape.append((before, h, r, z, n, after))
            scores = after @ v + b
            e = np.exp(scores - scores.max(1, keepdims=True))
            e /= e.sum(1, keepdims=True)
            real = target[:, t] >= 0
            e[np.flatnonzero(real), target[real, t]] -= 1
            e[~real] = 0
            losses.append(e)
            h = after
            before = np.where(real, target[:, t], self.classes)
        grad = np.zeros_like(self.flat)
        gx, gu, gv, gb = unpack(grad, self.classes, k)
        dh = np.zeros((n_streams, k), np.float32)
        for (prev, h0, r, z, n, after), e in zip(reversed(tape), reversed(losses), strict=True):
            gv += after.T @ e
            gb += e.sum(0)
            dh = dh + e @ v.T
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h0 - n) * z * (1 - z)
            d_rh = dn @ u[:, 2 * k :].T
            dr = d_rh * h0 * r * (1 - r)
            gates = np.concatenate((dr, dz), 1)
            gu[:, : 2 * k] += h0.T @ gates
            gu[:, 2 * k :] += (r * h0).T @ dn
            one_hot = np.zeros((self.classes + 1, n_streams), np.float32)
            one_hot[prev, np.arange(n_streams)] = 1
            gx += one_hot @ np.concatenate((gates, dn), 1)
            dh = dh * z + gates @ u[:, : 2 * k].T + d_rh * r
            dh[prev == self.classes] = 0
        self._update(grad / max(1, n_streams))
        return h, before

    def _update(self, grad: np.ndarray) -> None:
        norm = float(np.sqrt((grad * grad).sum()))
        if norm > 5:
            grad *= 5 / norm
        self.t += 1
        self.m += np.float32(0.1) * (grad - self.m)
        self.s += np.float32(0.01) * (grad * grad - self.s)
        m, s = self.m / (1 - 0.9**self.t), self.s / (1 - 0.99**self.t)
        self.flat -= (self.rate * m / (np.sqrt(s) + 1e-6)).astype(np.float32)
