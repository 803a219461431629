"""The small fixed models and filters that the queries use; the SQL has the same formulas."""

from __future__ import annotations

import numpy as np

from pixelloom.operators.cnn import CNN
from pixelloom.operators.mlp import MLP

PIXELS, HIDDEN, CLASSES = 64, 8, 10
CONV3 = np.array([[1, 0, -1], [2, 1, -2], [1, 0, -1]], float)


def grid(rows: int, cols: int, a: int, b: int, m: int, s: int) -> np.ndarray:
    """((i * a + j * b) % m - s) / 100."""
    i, j = np.indices((rows, cols))
    return ((i * a + j * b) % m - s) / 100


def bias(n: int, a: int, m: int) -> np.ndarray:
    return ((np.arange(n) * a) % m) / 100


def perceptron(functions: tuple[str, str] = ("sigmoid", "sigmoid")) -> MLP:
    return MLP([PIXELS, HIDDEN, CLASSES], list(functions), [grid(HIDDEN, PIXELS, 7, 3, 19, 9), grid(CLASSES, HIDDEN, 5, 11, 23, 11)], [bias(HIDDEN, 3, 7), bias(CLASSES, 5, 11)])


def network() -> CNN:
    """Two branches of 2 x 2 filters, twice, and a pooling."""
    net = CNN.from_text("8 8 relu convolution 2 2 2 convolution 2 2 2 pooling max 2 2")
    net.layers[0].set_filters(np.array([[[[1, 2], [0, -1]], [[2, -1], [1, 0]]]], float))
    net.layers[1].set_filters(np.array([[[[1, 0], [0, 1]], [[0, 1], [-1, 1]]], [[[1, 1], [-1, 0]], [[2, 0], [0, -1]]]], float))
    return net
