"""Multilayer perceptrons: model, prediction and text form.

A model is small and lives on the driver; samples are distributed. Prediction
has a form of column expressions for narrow layers and one of numpy blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from pixelloom.functions.activation import activation, applied
from pixelloom.operators import linalg
from pixelloom.operators.linalg import add, argmax, argmax_absolute, vector_product


def topology_from(text: str) -> list[int]:
    """Layer widths from "4,3,2"."""
    return [int(x) for x in text.split(",")]


class Topology(list):
    """Layer widths, to be edited and given to MLP; input and output are the first and last, 0 where there is none."""

    @staticmethod
    def from_text(text: str) -> Topology:
        return Topology(topology_from(text))

    @property
    def input_size(self) -> int:
        return self[0] if self else 0

    @input_size.setter
    def input_size(self, width: int) -> None:
        self[:1] = [width]

    @property
    def output_size(self) -> int:
        return self[-1] if self else 0

    @output_size.setter
    def output_size(self, width: int) -> None:
        self[-1:] = [width]

    def push_front(self, width: int) -> None:
        self.insert(0, width)

    push_back = list.append

    def __str__(self) -> str:
        return " ".join(map(str, self))


@dataclass
class MLP:
    """weights[l] is out x in, biases[l] has one number per output."""

    topology: list[int]
    activations: list[str]
    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        if len(self.topology) < 2 or min(self.topology) < 1:
            raise ValueError("a topology has at least two layers, none of them empty")
        if len(self.activations) != len(self.topology) - 1:
            raise ValueError("one activation function for each layer but the first")
        for a in self.activations:
            activation(a)
        shapes = list(zip(self.topology[1:], self.topology, strict=False))
        self.weights = self.weights or [np.zeros(s) for s in shapes]
        self.biases = self.biases or [np.zeros(s[0]) for s in shapes]
        if [w.shape for w in self.weights] != shapes or [b.shape for b in self.biases] != [s[:1] for s in shapes]:
            raise ValueError("weights or biases do not fit the topology")

    @property
    def cells(self) -> int:
        return sum(w.size for w in self.weights) + sum(b.size for b in self.biases)

    def shipped(self) -> MLP:
        """The model itself, if it may go to every task."""
        if self.cells > linalg.BLOCK_CELLS:
            raise ValueError(f"{self.cells} weights are too many to send to each task")
        return self

    @staticmethod
    def random(topology: list[int], function: str = "sigmoid", seed: int = 0) -> MLP:
        """Uniform in +-sqrt(2 / outputs) of the layer."""
        rng = np.random.default_rng(seed)
        out = MLP(list(topology), [function] * (len(topology) - 1))
        for i, w in enumerate(out.weights):
            bound = (2 / w.shape[0]) ** 0.5
            out.weights[i] = rng.uniform(-bound, bound, w.shape)
            out.biases[i] = rng.uniform(-bound, bound, w.shape[0])
        return out

    @staticmethod
    def random_relu_sigmoid(topology: list[int], seed: int = 0) -> MLP:
        """leakyRelu, but sigmoid on even layers and the last."""
        out = MLP.random(topology, "leakyRelu", seed)
        last = len(out.activations) - 1
        out.activations = ["sigmoid" if i % 2 == 0 or i == last else a for i, a in enumerate(out.activations)]
        return out

    def set_activation(self, name: str, layer: int | None = None) -> None:
        activation(name)
        if layer is None:
            self.activations = [name] * len(self.activations)
        else:
            self.activations[layer] = name

    def forward(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Pre-activations and activations by layer, for rows of x."""
        zs, acts = [], [x]
        for w, b, f in zip(self.weights, self.biases, self.activations, strict=True):
            zs.append(acts[-1] @ w.T + b)
            acts.append(activation(f).block(zs[-1]))
        return zs, acts

    def backward(self, x: np.ndarray, target: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Sums over the rows of weight gradients and bias gradients, and the error of the inputs."""
        zs, acts = self.forward(x)
        error = acts[-1] - target
        grads, biases = [], []
        for n in reversed(range(len(self.weights))):
            delta = activation(self.activations[n]).block_derivative(zs[n]) * error
            grads.insert(0, delta.T @ acts[n])
            biases.insert(0, delta.sum(axis=0))
            error = delta @ self.weights[n]
        return grads, biases, error

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.atleast_2d(np.asarray(x, float))
        if x.shape[1] != self.topology[0]:
            raise ValueError(f"inputs have {x.shape[1]} numbers, the model takes {self.topology[0]}")
        return self.forward(x)[1][-1]

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(layer, o, k, w) and (layer, o, b)."""
        w = [(n, int(o), int(k), float(m[o, k])) for n, m in enumerate(self.weights) for o, k in np.ndindex(m.shape)]
        b = [(n, o, float(v)) for n, m in enumerate(self.biases) for o, v in enumerate(m)]
        return spark.createDataFrame(w, "layer int, o int, k int, w double"), spark.createDataFrame(b, "layer int, o int, b double")


def predicted(model: MLP, data: Column) -> Column:
    """The model's outputs for an array, as a column expression; for narrow layers."""
    out = data
    for w, b, f in zip(model.weights, model.biases, model.activations, strict=True):
        out = applied(add(vector_product(w, out), F.array(*(F.lit(float(v)) for v in b))), f)
    return out


def score_columns(samples: DataFrame, model: MLP, data: str = "data", out: str = "output") -> DataFrame:
    """samples with the outputs; each layer is a projection of its own."""
    df = samples.withColumn("__a", F.col(data))
    for w, b, f in zip(model.weights, model.biases, model.activations, strict=True):
        df = df.withColumn("__z", vector_product(w, F.col("__a"))).withColumn("__a", applied(add(F.col("__z"), F.array(*(F.lit(float(v)) for v in b))), f))
    return df.withColumn(out, F.col("__a")).drop("__a", "__z")


def score_blocks(samples: DataFrame, model: MLP, data: str = "data", out: str = "output") -> DataFrame:
    """samples with the outputs, by numpy on Arrow batches; for wide layers."""
    names = [c for c in samples.columns if c != out]
    width = model.shipped().topology[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(data)
        for batch in batches:
            n = batch.num_rows
            if n:
                y = model.forward(np.asarray(batch.column(at).flatten(), float).reshape(n, -1))[1][-1]
                lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, y.ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*names, out])

    rows = samples.select(*names)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, ArrayType(DoubleType()))]))


def classified(scored: DataFrame, output: str = "output", mode: str = "absmax") -> DataFrame:
    """With pred, the place of the output largest without its sign, or with mode "max" of the largest."""
    rule = {"absmax": argmax_absolute, "max": argmax}[mode]
    return scored.withColumn("pred", rule(F.col(output)))


# text form

#: The headings, in their order.
HEADINGS = ("#Topology", "#ActivationFunctions", "#Weights", "#Biases")


def to_text(model: MLP, version: str = "0.1.0") -> str:
    """Numbers are written as float32 with nine digits, which reads back the same float32."""
    lines = ["#MLPModel", f"#Version {version}", HEADINGS[0], " ".join(map(str, model.topology)), HEADINGS[1], " ".join(model.activations), HEADINGS[2]]
    for w in model.weights:
        lines += [*(" ".join(f"{np.float32(v):.9g}" for v in row) for row in w), ""]
    lines.append(HEADINGS[3])
    for b in model.biases:
        lines += [*(f"{np.float32(v):.9g}" for v in b), ""]
    return "\n".join(lines) + "\n"


def from_text(text: str) -> MLP:
    """Reads to_text's form; the first heading and the version may be left out."""
    tokens: dict[str, list[str]] = {}
    heading = ""
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("#"):
            heading = line
            if not (line == "#MLPModel" or line.startswith("#Version")):
                if len(tokens) >= len(HEADINGS) or line != HEADINGS[len(tokens)]:
                    raise ValueError(f"unexpected section {line}")
                tokens[line] = []
        elif line:
            if heading not in tokens:
                raise ValueError(f"no section for: {line[:40]}")
            tokens[heading] += line.split()
    if len(tokens) != len(HEADINGS):
        raise ValueError(f"missing section {HEADINGS[len(tokens)]}")
    topology = [int(x) for x in tokens[HEADINGS[0]]]
    model = MLP(topology, tokens[HEADINGS[1]])
    for kept, name in ((model.weights, HEADINGS[2]), (model.biases, HEADINGS[3])):
        numbers = np.array([float(x) for x in tokens[name]])
        if len(numbers) != sum(m.size for m in kept):
            raise ValueError(f"{name} has {len(numbers)} numbers")
        at = 0
        for i, m in enumerate(kept):
            kept[i] = numbers[at : at + m.size].reshape(m.shape)
            at += m.size
    return model
