"""Activations as column expressions and as array kernels (M1), by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F

LEAK = 0.01


@dataclass(frozen=True)
class Activation:
    """column: on a Spark column; array: on an array; slope: derivative at z, given z and its activation."""

    column: Callable[[Column], Column]
    array: Callable[[np.ndarray], np.ndarray]
    slope: Callable[[np.ndarray, np.ndarray], np.ndarray]


#: Slopes at 0 take the side of the identity.
ACTIVATIONS = {
    "sigmoid": Activation(lambda z: 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z)))), lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500))), lambda z, a: a * (1 - a)),
    "tanh": Activation(F.tanh, np.tanh, lambda z, a: 1 - a * a),
    "relu": Activation(lambda z: F.greatest(z, F.lit(0.0)), lambda z: np.maximum(z, 0), lambda z, a: (z >= 0).astype(z.dtype)),
    "leaky_relu": Activation(lambda z: F.when(z >= 0, z).otherwise(z * LEAK), lambda z: np.where(z >= 0, z, LEAK * z), lambda z, a: np.where(z >= 0, 1.0, LEAK).astype(z.dtype)),
}


def activation(name: str) -> Activation:
    """By name; ValueError lists the known ones."""
    if name not in ACTIVATIONS:
        raise ValueError(f"unknown activation {name!r}; known: {', '.join(ACTIVATIONS)}")
    return ACTIVATIONS[name]
