"""A linear-chain conditional random field over dense clause features, in numpy."""

from __future__ import annotations

import numpy as np


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


class Crf:
    """Weights w (features, labels), transitions t (labels, labels), begin and end scores."""

    def __init__(self, features: int, labels: int) -> None:
        self.w = np.zeros((features, labels))
        self.t = np.zeros((labels, labels))
        self.b = np.zeros(labels)
        self.e = np.zeros(labels)

    def _forward(self, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size, steps, _ = s.shape
        a, z = np.empty_like(s), np.empty_like(s)
        a[:, 0] = self.b + s[:, 0]
        for i in range(1, steps):
            a[:, i] = np.where((i < n)[:, None], _lse(a[:, i - 1][:, :, None] + self.t[None], 1) + s[:, i], a[:, i - 1])
        last = np.arange(steps)[None] == (n - 1)[:, None]
        z[:, -1] = self.e
        for i in range(steps - 2, -1, -1):
            on = _lse(self.t[None] + (s[:, i + 1] + z[:, i + 1])[:, None, :], 2)
            z[:, i] = np.where((i + 1 < n)[:, None], on, self.e)
        del last, size
        return a, z, _lse(a[:, -1] + self.e, 1)

    def fit(self, x: list[np.ndarray], y: list[np.ndarray], epochs: int = 12, batch: int = 256, rate: float = 0.25, l2: float = 1e-4, seed: int = 3) -> "Crf":
        """Adagrad on the conditional log-likelihood of whole label sequences."""
        rng = np.random.default_rng(seed)
        params = [self.w, self.t, self.b, self.e]
        seen = [np.full_like(p, 1e-6) for p in params]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                xs, ys, n = _padded([x[i] for i in order[lo : lo + batch]], [y[i] for i in order[lo : lo + batch]])
                s = xs @ self.w
                a, z, total = self._forward(s, n)
                live = np.arange(xs.shape[1])[None] < n[:, None]
                p = np.exp(a + z - total[:, None, None]) * live[..., None]
                gold = np.eye(s.shape[2])[ys] * live[..., None]
                gap = gold - p
                gw = np.einsum("bif,bil->fl", xs, gap)
                pair = live[:, 1:, None, None]
                both = np.exp(a[:, :-1, :, None] + self.t[None, None] + (s + z)[:, 1:, None, :] - total[:, None, None, None]) * pair
                gt = (gold[:, :-1, :, None] * gold[:, 1:, None, :]).sum((0, 1)) - both.sum((0, 1))
                last = (np.arange(xs.shape[1])[None] == (n - 1)[:, None])[..., None]
                grads = [gw, gt, gap[:, 0].sum(0), (gap * last).sum((0, 1))]
                for q, g, h in zip(params, grads, seen):
                    g = g / len(n) - l2 * q
                    h += g * g
                    q += rate * g / np.sqrt(h)
        return self

    def decode(self, x: list[np.ndarray]) -> list[np.ndarray]:
        """The most probable labels of each sequence."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(x)
        order = sorted(range(len(x)), key=lambda i: len(x[i]))
        for lo in range(0, len(order), 1024):
            at = order[lo : lo + 1024]
            xs, _, n = _padded([x[i] for i in at], None)
            s = xs @ self.w
            best, back = self.b + s[:, 0], []
            for i in range(1, xs.shape[1]):
                step = best[:, :, None] + self.t[None]
                from_ = step.argmax(1)
                live = (i < n)[:, None]
                back.append(np.where(live, from_, np.arange(s.shape[2])[None]))
                best = np.where(live, step.max(1) + s[:, i], best)
            y = (best + self.e).argmax(1)
            path = [y]
            for f in reversed(back):
                y = f[np.arange(len(y)), y]
                path.append(y)
            labels = np.stack(path[::-1], 1)
            for k, i in enumerate(at):
                out[i] = labels[k, : n[k]]
        return out


def _padded(x: list[np.ndarray], y: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(v) for v in x])
    xs = np.zeros((len(x), n.max(), x[0].shape[1]))
    ys = np.zeros((len(x), n.max()), int)
    for i, v in enumerate(x):
        xs[i, : len(v)] = v
        if y is not None:
            ys[i, : len(v)] = y[i]
    return xs, ys, n
