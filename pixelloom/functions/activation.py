"""Activation functions and their derivatives, as column expressions and for numpy blocks.

At the point where a derivative jumps (0) the value is that of the training kernels: 0 for relu, the slope for leakyRelu.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The slope of leakyRelu, and the functions' names below.
SLOPE = 0.01


@dataclass(frozen=True)
class Activation:
    name: str
    column: Callable[[Column], Column]
    column_derivative: Callable[[Column], Column]
    block: Callable[[np.ndarray], np.ndarray]
    block_derivative: Callable[[np.ndarray], np.ndarray]


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _sigmoid_block(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


ACTIVATIONS = {
    a.name: a
    for a in (
        Activation("identity", lambda x: x, lambda x: F.lit(1.0), lambda x: x, np.ones_like),
        Activation("sigmoid", _sigmoid, lambda x: _sigmoid(x) * (1 - _sigmoid(x)), _sigmoid_block, lambda x: _sigmoid_block(x) * (1 - _sigmoid_block(x))),
        Activation("relu", lambda x: F.greatest(x, F.lit(0.0)), lambda x: F.when(x > 0, 1.0).otherwise(0.0), lambda x: np.maximum(x, 0), lambda x: (x > 0).astype(float)),
        Activation("leakyRelu", lambda x: F.when(x > 0, x).otherwise(SLOPE * x), lambda x: F.when(x > 0, 1.0).otherwise(SLOPE), lambda x: np.where(x > 0, x, SLOPE * x), lambda x: np.where(x > 0, 1.0, SLOPE)),
        Activation("square", lambda x: x * x, lambda x: 2 * x, lambda x: x * x, lambda x: 2 * x),
    )
}


def activation(name: str) -> Activation:
    """By name; an unknown one raises ValueError."""
    if name not in ACTIVATIONS:
        raise ValueError(f"unknown activation function: {name}")
    return ACTIVATIONS[name]


def applied(data: Column, name: str) -> Column:
    """The function on each element of an array."""
    return F.transform(data, activation(name).column)


def derived(data: Column, name: str) -> Column:
    return F.transform(data, activation(name).column_derivative)
