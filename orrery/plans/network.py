"""A one-hidden-layer regressor as flat parameters and array kernels (M1-M5), and its forward pass as a column (M4)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F

from ..functions.activations import activation
from ..functions.vectors import dot


@dataclass(frozen=True)
class Network:
    """n_in inputs, hidden units. Flat parameters: output weights, output bias, hidden weights by unit, hidden biases."""

    n_in: int
    hidden: int = 64
    act: str = "leaky_relu"

    @property
    def size(self) -> int:
        return self.hidden * (self.n_in + 2) + 1

    def init(self, seed: int, how: str = "auto", random_bias: bool = False) -> np.ndarray:
        """M2: seeded. 'xavier', 'he', or 'auto': he for the relu family."""
        if how not in ("auto", "xavier", "he"):
            raise ValueError(f"unknown initialisation {how!r}; known: auto, xavier, he")
        rng, he = np.random.default_rng(seed), how == "he" or how == "auto" and self.act.endswith("relu")
        dev = lambda fan_in, fan_out: np.sqrt(2 / (fan_in if he else fan_in + fan_out))
        w2 = rng.normal(0, dev(self.hidden, 1), self.hidden)
        w1 = rng.normal(0, dev(self.n_in, self.hidden), (self.hidden, self.n_in))
        b2, b1 = (rng.normal(0, 0.1, 1), rng.normal(0, 0.1, self.hidden)) if random_bias else (np.zeros(1), np.zeros(self.hidden))
        return self.pack(w2, b2, w1, b1)

    def pack(self, w2, b2, w1, b1) -> np.ndarray:
        """M3."""
        return np.concatenate([np.ravel(x) for x in (w2, b2, w1, b1)]).astype(np.float64)

    def unpack(self, theta: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
        """M3: w2, b2, w1, b1."""
        if len(theta) != self.size:
            raise ValueError(f"{len(theta)} parameters for a network of {self.size}")
        h, m = self.hidden, self.n_in
        return theta[:h], float(theta[h]), theta[h + 1 : h + 1 + h * m].reshape(h, m), theta[h + 1 + h * m :]

    def forward(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
        """M4."""
        w2, b2, w1, b1 = self.unpack(theta)
        return activation(self.act).array(x @ w1.T + b1) @ w2 + b2

    def sums(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float]:
        """Over the rows, the sum of gradients of half the squared error, the squared errors, the share of units at or under 0 (times rows)."""
        w2, b2, w1, b1 = self.unpack(theta)
        f = activation(self.act)
        z = x @ w1.T + b1
        a = f.array(z)
        error = a @ w2 + b2 - y
        back = np.outer(error, w2) * f.slope(z, a)
        return self.pack(a.T @ error, error.sum(keepdims=True), back.T @ x, back.sum(0)), float(error @ error), float((z <= 0).mean(1).sum())

    def penalty(self, theta: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
        """Half decay times the squared weights (not biases), and its gradient."""
        w2, _, w1, _ = self.unpack(theta)
        return 0.5 * decay * float((w2**2).sum() + (w1**2).sum()), decay * self.pack(w2, np.zeros(1), w1, np.zeros(self.hidden))

    def loss_and_gradient(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray, decay: float = 0.0) -> tuple[float, np.ndarray]:
        """M5: mean half squared error plus penalty, and its true gradient."""
        gradient, sse, _ = self.sums(theta, x, y)
        loss, own = self.penalty(theta, decay)
        return 0.5 * sse / len(y) + loss, gradient / len(y) + own

    def column(self, theta: np.ndarray, features: Column) -> Column:
        """M4 as a column expression; for small networks, as the expression grows with hidden * n_in."""
        w2, b2, w1, b1 = self.unpack(theta)
        f = activation(self.act).column
        units = [f(dot(F.array(*map(F.lit, w1[j].tolist())), features) + F.lit(float(b1[j]))) * F.lit(float(w2[j])) for j in range(self.hidden)]
        out = F.lit(b2)
        for u in units:
            out = out + u
        return out


