"""A small convolutional network over bytes in numpy: embedding, learned filters, max-pooling, one hidden layer."""

from __future__ import annotations

import numpy as np

F32 = np.float32


class Net:
    """Filters of ``kernel`` bytes every ``stride`` bytes; ``pools`` pooled vectors of all filters feed the hidden layer."""

    def __init__(self, seed: int, symbols: int = 256, embed: int = 8, kernel: int = 8, stride: int = 4, filters: int = 32, pools: int = 2, hidden: int = 16):
        rng = np.random.default_rng(seed)
        self.kernel, self.stride, self.embed, self.filters = kernel, stride, embed, filters
        self.p = {
            "emb": rng.normal(0, 0.5, (symbols, embed)).astype(F32),
            "w": rng.normal(0, (2 / (kernel * embed)) ** 0.5, (kernel * embed, filters)).astype(F32),
            "b": np.zeros(filters, F32),
            "w1": rng.normal(0, (2 / (pools * filters)) ** 0.5, (pools * filters, hidden)).astype(F32),
            "b1": np.zeros(hidden, F32),
            "w2": rng.normal(0, hidden**-0.5, hidden).astype(F32),
            "b2": np.zeros(1, F32),
        }
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def activations(self, x: np.ndarray) -> np.ndarray:
        """(rows, places, filters) of byte rows ``x``."""
        e = self.p["emb"][x]
        n, places = len(x), (x.shape[1] - self.kernel) // self.stride + 1
        s0, s1, s2 = e.strides
        patches = np.lib.stride_tricks.as_strided(e, (n, places, self.kernel, self.embed), (s0, s1 * self.stride, s1, s2))
        return (patches.reshape(n * places, -1) @ self.p["w"]).reshape(n, places, -1) + self.p["b"]

    def pool(self, x: np.ndarray, masks: list[np.ndarray | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each mask (rows, places): the largest rectified activation of each filter and its place."""
        a, out = self.activations(x), []
        for mask in masks:
            seen = a if mask is None else np.where(mask[:, :, None], a, F32(-1e9))
            at = seen.argmax(axis=1)
            out.append((np.maximum(np.take_along_axis(seen, at[:, None], 1)[:, 0], 0), at))
        return out

    def head(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(features @ self.p["w1"] + self.p["b1"], 0)
        return h, h @ self.p["w2"] + self.p["b2"]

    def head_gradient(self, features: np.ndarray, h: np.ndarray, d: np.ndarray, g: dict) -> np.ndarray:
        """Adds to ``g``; the gradient of the features for that of the logits ``d``."""
        g["w2"] += h.T @ d
        g["b2"] += d.sum()
        dh = np.outer(d, self.p["w2"]) * (h > 0)
        g["w1"] += features.T @ dh
        g["b1"] += dh.sum(axis=0)
        return dh @ self.p["w1"].T

    def pool_gradient(self, x: np.ndarray, pooled: np.ndarray, at: np.ndarray, d: np.ndarray, g: dict) -> None:
        d = d * (pooled > 0)
        rows, places = np.arange(len(x))[:, None, None], at[:, :, None] * self.stride + np.arange(self.kernel)
        symbols = x[rows, places]  # rows, filters, kernel
        patches = self.p["emb"][symbols].reshape(len(x), self.filters, -1)
        g["w"] += np.einsum("nf,nfk->kf", d, patches, optimize=True)
        g["b"] += d.sum(axis=0)
        back = (d[:, :, None] * self.p["w"].T[None]).reshape(-1, self.embed)
        flat = symbols.ravel()
        for j in range(self.embed):
            g["emb"][:, j] += np.bincount(flat, back[:, j], minlength=len(g["emb"])).astype(F32)

    def zero(self) -> dict:
        return {k: np.zeros_like(v) for k, v in self.p.items()}

    def step(self, g: dict, rate: float) -> None:
        """One step of Adam."""
        self.t += 1
        for k, v in g.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * v
            self.v[k] = 0.999 * self.v[k] + 0.001 * v * v
            self.p[k] -= (rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(F32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))
