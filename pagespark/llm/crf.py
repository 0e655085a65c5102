"""A small linear-chain conditional random field in numpy: training and Viterbi decoding."""

from __future__ import annotations

import numpy as np


class LinearChain:
    """Labels 0..k-1 over real-valued feature vectors; weights are plain arrays, cheap to send to tasks."""

    def __init__(self, n_labels: int, n_features: int):
        self.emit = np.zeros((n_labels, n_features))
        self.trans = np.zeros((n_labels, n_labels))

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best label sequence for the (n, features) matrix; ties go to the lower label."""
        return self.decode_many(x, np.array([0, len(x)]))

    def decode_many(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Viterbi over many sequences laid end to end; all sequences advance together."""
        n, k = len(x), len(self.trans)
        out = np.zeros(n, np.int64)
        if not n:
            return out
        score = x @ self.emit.T
        starts, lens = bounds[:-1], np.diff(bounds)
        order = np.argsort(-lens, kind="stable")
        starts, lens = starts[order], lens[order]
        live = int((lens > 0).sum())
        starts, lens = starts[:live], lens[:live]
        back = np.zeros((n, k), np.int8)
        best = score[starts]
        steps = int(lens[0]) if live else 0
        final = np.zeros((live, k))
        for t in range(1, steps):
            m = int(np.searchsorted(-lens, -t, side="left"))  # sequences longer than t
            final[m:live] = np.where((lens[m:live] == t)[:, None], best[m:live], final[m:live])
            cand = best[:m, :, None] + self.trans[None]
            back[starts[:m] + t] = cand.argmax(1)
            new = best.copy()
            new[:m] = cand.max(1) + score[starts[:m] + t]
            best = new
        last = lens == steps
        final[last] = best[last]
        lab = final.argmax(1)
        at = starts + lens - 1
        out[at] = lab
        for t in range(steps - 1, 0, -1):
            m = int(np.searchsorted(-lens, -t, side="left"))
            pos = starts[:m] + t
            out[pos - 1] = back[pos, out[pos]]
        return out

    def _forward_backward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = x @ self.emit.T
        n, k = s.shape
        a, b = np.zeros((n, k)), np.zeros((n, k))
        a[0] = s[0]
        for t in range(1, n):
            a[t] = s[t] + np.logaddexp.reduce(a[t - 1][:, None] + self.trans, axis=0)
        for t in range(n - 2, -1, -1):
            b[t] = np.logaddexp.reduce(self.trans + (s[t + 1] + b[t + 1])[None], axis=1)
        z = np.logaddexp.reduce(a[-1])
        pair = np.zeros((k, k))
        for t in range(1, n):
            pair += np.exp(a[t - 1][:, None] + self.trans + (s[t] + b[t])[None] - z)
        return np.exp(a + b - z), pair

    def fit(self, data: list[tuple[np.ndarray, np.ndarray]], rounds: int = 30, rate: float = 0.5, decay: float = 1e-3) -> LinearChain:
        """Gradient ascent on the conditional log-likelihood with AdaGrad steps."""
        ge, gt = np.full_like(self.emit, 1e-6), np.full_like(self.trans, 1e-6)
        k = len(self.trans)
        for _ in range(rounds):
            de, dt = -decay * self.emit, -decay * self.trans
            for x, y in data:
                p, pair = self._forward_backward(x)
                gold = np.eye(k)[y]
                de = de + (gold - p).T @ x / len(data)
                for i, j in zip(y[:-1], y[1:]):
                    dt[i, j] += 1 / len(data)
                dt = dt - pair / len(data)
            ge += de**2
            gt += dt**2
            self.emit = self.emit + rate * de / np.sqrt(ge)
            self.trans = self.trans + rate * dt / np.sqrt(gt)
        return self
