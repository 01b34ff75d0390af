"""A character-level bidirectional LSTM with a CRF on top, in numpy."""

from __future__ import annotations

import io

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    def __init__(self, symbols: int, labels: int, width: int = 8, hidden: int = 24, seed: int = 11):
        rng = np.random.default_rng(seed)

        def init(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.labels, self.hidden = labels, hidden
        self.p = {"embed": init(symbols, width) * np.float32(width**0.5), "out": init(2 * hidden, labels), "out_b": np.zeros(labels, np.float32),
                  "move": np.zeros((labels, labels), np.float32), "first": np.zeros(labels, np.float32)}
        for d in "fb":
            self.p |= {f"x_{d}": init(width, 4 * hidden), f"h_{d}": init(hidden, 4 * hidden), f"b_{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"b_{d}"][hidden:2 * hidden] = 1  # remember at first

    # one direction; time runs forwards in what it gets; what a step back needs is kept only for one
    def _run(self, x: np.ndarray, d: str, keep: bool = True):
        n, steps, _ = x.shape
        h = c = np.zeros((n, self.hidden), np.float32)
        pre = x @ self.p[f"x_{d}"] + self.p[f"b_{d}"]
        outs, kept = np.empty((n, steps, self.hidden), np.float32), []
        k = self.hidden
        for t in range(steps):
            z = pre[:, t] + h @ self.p[f"h_{d}"]
            gates, g = _sigmoid(z[:, :3 * k]), np.tanh(z[:, 3 * k:])
            i, f, o = gates[:, :k], gates[:, k:2 * k], gates[:, 2 * k:]
            last_h, last_c = h, c
            c = f * c + i * g
            th = np.tanh(c)
            h = o * th
            outs[:, t] = h
            if keep:
                kept.append((i, f, o, g, th, last_h, last_c))
        return outs, kept

    def _back(self, x: np.ndarray, d: str, kept, d_out: np.ndarray, grad: dict) -> np.ndarray:
        k, w = self.hidden, self.p[f"h_{d}"]
        dz_all = np.empty((*d_out.shape[:2], 4 * k), np.float32)
        dh, dc, dw = np.zeros_like(d_out[:, 0]), np.zeros_like(d_out[:, 0]), np.zeros_like(w)
        for t in range(d_out.shape[1] - 1, -1, -1):
            i, f, o, g, th, last_h, last_c = kept[t]
            dh = dh + d_out[:, t]
            dc = dc + dh * o * (1 - th * th)
            dz = np.concatenate([dc * g * i * (1 - i), dc * last_c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dz_all[:, t] = dz
            dw += last_h.T @ dz
            dh, dc = dz @ w.T, dc * f
        flat = dz_all.reshape(-1, 4 * k)
        grad[f"h_{d}"], grad[f"b_{d}"] = dw, flat.sum(axis=0)
        grad[f"x_{d}"] = x.reshape(-1, x.shape[2]).T @ flat
        return dz_all @ self.p[f"x_{d}"].T

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """Label scores of every character: (windows, characters, labels)."""
        x = self.p["embed"][codes]
        both = np.concatenate([self._run(x, "f", False)[0], self._run(x[:, ::-1], "b", False)[0][:, ::-1]], axis=2)
        return both @ self.p["out"] + self.p["out_b"]

    def _chain(self, e: np.ndarray, length: np.ndarray | None = None):
        """Scaled forward and backward messages, what the characters weigh, and the log of the sum over all labellings."""
        n, steps, _ = e.shape
        move = np.exp(self.p["move"].astype(float))
        e = e.astype(float)
        e[:, 0] += self.p["first"]
        top = e.max(axis=2)
        own = np.exp(e - top[:, :, None])
        a, b, scale = np.empty(e.shape), np.ones(e.shape), np.empty((n, steps))
        for t in range(steps):
            x = own[:, t] if t == 0 else (a[:, t - 1] @ move) * own[:, t]
            scale[:, t] = x.sum(axis=1)
            a[:, t] = x / scale[:, t, None]
        back = move.T
        for t in range(steps - 2, -1, -1):
            x = (b[:, t + 1] * own[:, t + 1] / scale[:, t + 1, None]) @ back
            b[:, t] = x if length is None else np.where((t + 1 < length)[:, None], x, 1.0)
        return a, b, own / scale[:, :, None], (np.log(scale) + top).sum(axis=1)

    def _marginals(self, e: np.ndarray):
        a, b, own, total = self._chain(e)
        labels = e.shape[2]
        pair = np.exp(self.p["move"].astype(float)) * (a[:, :-1].reshape(-1, labels).T @ (own * b)[:, 1:].reshape(-1, labels))
        return a * b, pair, total

    def _step(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        n, steps = codes.shape
        x = self.p["embed"][codes]
        forward, kept_f = self._run(x, "f")
        backward, kept_b = self._run(x[:, ::-1], "b")
        both = np.concatenate([forward, backward[:, ::-1]], axis=2)
        e = (both @ self.p["out"] + self.p["out_b"]).astype(float)
        single, pair, total = self._marginals(e)
        rows, at = np.arange(n)[:, None], np.arange(steps)
        gold = self.p["first"][tags[:, 0]] + e[rows, at, tags].sum(axis=1) + self.p["move"][tags[:, :-1], tags[:, 1:]].sum(axis=1)
        d_e = single.copy()
        d_e[rows, at, tags] -= 1
        grad = {"first": d_e[:, 0].sum(axis=0), "move": pair}
        np.subtract.at(grad["move"], (tags[:, :-1], tags[:, 1:]), 1)
        d_e = d_e.astype(np.float32)
        flat = d_e.reshape(-1, self.labels)
        grad["out"], grad["out_b"] = both.reshape(len(flat), -1).T @ flat, flat.sum(axis=0)
        d_both = d_e @ self.p["out"].T
        k = self.hidden
        d_x = self._back(x, "f", kept_f, d_both[:, :, :k], grad)
        d_x = d_x + self._back(x[:, ::-1], "b", kept_b, d_both[:, ::-1, k:], grad)[:, ::-1]
        grad["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grad["embed"], codes, d_x)
        return float((total - gold).sum()) / n, {name: g / n for name, g in grad.items()}

    def fit(self, codes: np.ndarray, tags: np.ndarray, steps: int = 400, batch: int = 64, rate: float = 0.02, seed: int = 13) -> list[float]:
        """Adam on the CRF's negative log likelihood, the rate falling to zero; the loss of each step."""
        rng, losses = np.random.default_rng(seed), []
        m, v = ({name: np.zeros(x.shape) for name, x in self.p.items()} for _ in range(2))
        order = np.empty(0, np.int64)
        for t in range(1, steps + 1):
            if len(order) < min(batch, len(codes)):
                order = np.concatenate([order, rng.permutation(len(codes))])
            part, order = order[:batch], order[batch:]
            loss, grad = self._step(codes[part], tags[part])
            losses.append(loss)
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for name, g in grad.items():
                g = g * min(1.0, 5.0 / max(size, 1e-9))
                m[name] += 0.1 * (g - m[name])
                v[name] += 0.01 * (g * g - v[name])
                step = rate * (1 - (t - 1) / steps) * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.99**t)) + 1e-8)
                self.p[name] = (self.p[name] - step).astype(np.float32)
        return losses

    def decode(self, e: np.ndarray, length: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Best labels and the probability of each, for sequences padded to one size."""
        n, steps, labels = e.shape
        move = self.p["move"].astype(float)
        best, came = np.empty(e.shape), np.zeros((n, steps, labels), np.int8)
        best[:, 0] = self.p["first"] + e[:, 0]
        for t in range(1, steps):
            ways = best[:, t - 1, :, None] + move
            came[:, t] = ways.argmax(axis=1)
            best[:, t] = e[:, t] + ways.max(axis=1)
        a, b, _, _ = self._chain(e, length)
        single = a * b
        single /= single.sum(axis=2, keepdims=True)
        out = []
        for i in range(n):
            last = int(length[i])
            tags = np.empty(last, np.int64)
            tags[-1] = best[i, last - 1].argmax()
            for t in range(last - 1, 0, -1):
                tags[t - 1] = came[i, t, tags[t]]
            out.append((tags, single[i, np.arange(last), tags]))
        return out

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tagger:
        with np.load(io.BytesIO(data)) as kept:
            p = {k: kept[k] for k in kept.files}
        tagger = cls(*p["embed"].shape[:1], p["out"].shape[1], p["embed"].shape[1], p["out"].shape[0] // 2)
        tagger.p = p
        return tagger
