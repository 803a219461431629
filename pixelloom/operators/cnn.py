"""Convolutional networks: topology, forward and backward operators.

A map is a flat array of h x w numbers. Layers have two forms: column expressions
over the arrays of one row, with the filters as literals, for small maps and
where every layer's maps are wanted; and numpy blocks on Arrow batches, for
prediction and training. There a convolution is one matrix product a branch over
all windows, and a pooling two runs whose cost does not grow with the window.
Neither shuffles. Gradients of filters are sums over rows. Stride is 1 and there
is no padding, so a k-wide window leaves n - k + 1 places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from pixelloom.functions.activation import activation, applied
from pixelloom.functions.binding import let, spread_out
from pixelloom.operators import linalg
from pixelloom.operators.mlp import MLP
from pixelloom.operators.training import Optimiser, train_epoch


#: Numbers that the windows of a convolution may take at once, and those of a slice of rows with its widest layer.
WINDOW_CELLS, BLOCK_NUMBERS = 1 << 23, 1 << 22


def _at(data: Column, k: Column) -> Column:
    return F.get(data, k.cast("int"))


def _places(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def out_size(size: tuple[int, int], window: tuple[int, int]) -> tuple[int, int]:
    h, w = size[0] - window[0] + 1, size[1] - window[1] + 1
    if h < 1 or w < 1:
        raise ValueError(f"a {window} window does not fit into {size}")
    return h, w


def correlate(data: Column, size: tuple[int, int], taps: np.ndarray) -> Column:
    """Valid cross-correlation of a map with one filter."""
    h, w = out_size(size, taps.shape)

    def one(k: Column, data: Column) -> Column:
        base = F.floor(k / w) * size[1] + k % w
        return reduce(lambda a, b: a + b, (_at(data, base + (i * size[1] + j)) * float(taps[i, j]) for i, j in np.ndindex(taps.shape)))

    return let(data, lambda data: F.transform(_places(h * w), lambda k: one(k, data)))


def correlate_maps(a: Column, size: tuple[int, int], b: Column, window: tuple[int, int]) -> Column:
    """Valid cross-correlation of two maps of a row."""
    h, w = out_size(size, window)

    def one(k: Column, a: Column, b: Column) -> Column:
        base = F.floor(k / w) * size[1] + k % w
        step = lambda acc, t: acc + _at(a, base + F.floor(t / window[1]) * size[1] + t % window[1]) * _at(b, t)
        return F.aggregate(_places(window[0] * window[1]), F.lit(0.0), step)

    return let(a, lambda a: let(b, lambda b: F.transform(_places(h * w), lambda k: one(k, a, b))))


def convolve_full(error: Column, size: tuple[int, int], taps: np.ndarray) -> Column:
    """Full convolution: what an error of `size` sends back through a filter."""
    kh, kw = taps.shape
    h, w = size[0] + kh - 1, size[1] + kw - 1

    def one(k: Column, error: Column) -> Column:
        y, x = F.floor(k / w), k % w
        terms = []
        for i, j in np.ndindex(taps.shape):
            inside = (y - i >= 0) & (y - i < size[0]) & (x - j >= 0) & (x - j < size[1])
            terms.append(F.when(inside, _at(error, F.greatest((y - i) * size[1] + x - j, F.lit(0))) * float(taps[i, j])).otherwise(0.0))
        return reduce(lambda a, b: a + b, terms)

    return let(error, lambda error: F.transform(_places(h * w), lambda k: one(k, error)))


def max_pool(data: Column, size: tuple[int, int], window: tuple[int, int]) -> Column:
    h, w = out_size(size, window)
    return let(data, lambda data: F.transform(_places(h * w), lambda k: F.array_max(F.array(*(_at(data, F.floor(k / w) * size[1] + k % w + (i * size[1] + j)) for i, j in np.ndindex(window))))))


def max_pool_places(data: Column, size: tuple[int, int], window: tuple[int, int]) -> Column:
    """For each output the flat index of its maximum, the first of equals in row order."""
    h, w = out_size(size, window)

    def one(k: Column, data: Column) -> Column:
        base = F.floor(k / w) * size[1] + k % w
        return F.array_max(F.array(*(F.struct(_at(data, base + (i * size[1] + j)).alias("v"), (-(base + (i * size[1] + j))).alias("p")) for i, j in np.ndindex(window))))["p"] * -1

    return let(data, lambda data: F.transform(_places(h * w), lambda k: one(k, data)))


def max_pool_backward(error: Column, places: Column, size: tuple[int, int], window: tuple[int, int]) -> Column:
    """Each output's error added to the place of its maximum: a pixel asks the outputs whose windows hold it."""
    h, w = out_size(size, window)

    def one(k: Column, error: Column, places: Column) -> Column:
        y, x = F.floor(k / size[1]), k % size[1]
        terms = []
        for i, j in np.ndindex(window):
            inside = (y - i >= 0) & (y - i < h) & (x - j >= 0) & (x - j < w)
            at = F.greatest((y - i) * w + x - j, F.lit(0))
            terms.append(F.when(inside & (_at(places, at) == k), _at(error, at)).otherwise(0.0))
        return reduce(lambda a, b: a + b, terms)

    return let(error, lambda error: let(places, lambda places: F.transform(_places(size[0] * size[1]), lambda k: one(k, error, places))))


def avg_pool(data: Column, size: tuple[int, int], window: tuple[int, int]) -> Column:
    return correlate(data, size, np.full(window, 1.0 / (window[0] * window[1])))


def avg_pool_backward(error: Column, size: tuple[int, int], window: tuple[int, int]) -> Column:
    """The adjoint of avg_pool for inputs of `size`: each error spread evenly over its window."""
    return convolve_full(error, out_size(size, window), np.full(window, 1.0 / (window[0] * window[1])))


@dataclass
class Layer:
    """filters: branch x filter x kh x kw for a convolution, None for a pooling."""

    kind: str
    size: tuple[int, int]
    window: tuple[int, int]
    branches: int
    pooling: str = ""
    filters: np.ndarray | None = None

    @property
    def out(self) -> tuple[int, int]:
        return out_size(self.size, self.window)

    @property
    def features(self) -> int:
        return 1 if self.filters is None else self.filters.shape[1]

    def set_filters(self, filters: np.ndarray) -> None:
        if self.filters is None:
            raise ValueError("a pooling layer has no filters")
        if filters.shape != self.filters.shape:
            raise ValueError(f"filters must have the shape {self.filters.shape}")
        self.filters = np.asarray(filters, float)


@dataclass
class CNN:
    size: tuple[int, int]
    function: str
    layers: list[Layer] = field(default_factory=list)

    @property
    def branches(self) -> int:
        return int(np.prod([layer.features for layer in self.layers], dtype=int))

    @property
    def out(self) -> tuple[int, int]:
        return self.layers[-1].out if self.layers else self.size

    @property
    def output_size(self) -> int:
        return self.branches * self.out[0] * self.out[1]

    @staticmethod
    def from_text(text: str) -> CNN:
        """"H W function {convolution F kh kw | pooling max|avg ph pw}*"."""
        words = text.split()
        net = CNN((int(words[0]), int(words[1])), activation(words[2]).name)
        at = 3
        while at < len(words):
            size, branches = net.out, net.branches
            if words[at] == "convolution":
                f, kh, kw = map(int, words[at + 1 : at + 4])
                net.layers.append(Layer("convolution", size, (kh, kw), branches, filters=np.zeros((branches, f, kh, kw))))
            elif words[at] == "pooling":
                if words[at + 1] not in ("max", "avg"):
                    raise ValueError(f"unknown pooling: {words[at + 1]}")
                net.layers.append(Layer("pooling", size, (int(words[at + 2]), int(words[at + 3])), branches, pooling=words[at + 1]))
            else:
                raise ValueError(f"unknown layer: {words[at]}")
            net.layers[-1].out  # raises if the window does not fit
            at += 4
        return net

    def to_text(self) -> str:
        """What from_text reads; filters are not part of it."""
        words = [*map(str, self.size), self.function]
        for layer in self.layers:
            words += ["convolution", str(layer.features)] if layer.filters is not None else ["pooling", layer.pooling]
            words += map(str, layer.window)
        return " ".join(words)

    def table(self, spark: SparkSession) -> DataFrame:
        """(layer, branch, f, i, j, w): all filters, to be written as a table."""
        rows = [(n, *map(int, at), float(w)) for n, layer in enumerate(self.layers) if layer.filters is not None for at, w in np.ndenumerate(layer.filters)]
        return spark.createDataFrame(rows, "layer int, branch int, f int, i int, j int, w double")

    def read(self, filters: DataFrame) -> CNN:
        """Takes the filters of such a table; cells that it lacks stay."""
        for r in filters.collect():
            layer = self.layers[r.layer]
            if layer.filters is None:
                raise ValueError("a pooling layer has no filters")
            layer.filters[r.branch, r.f, r.i, r.j] = r.w
        return self

    def randomise(self, seed: int = 0) -> CNN:
        """Filters uniform in [0, 1)."""
        rng = np.random.default_rng(seed)
        for layer in self.layers:
            if layer.filters is not None:
                layer.filters = rng.random(layer.filters.shape)
        return self


def forward_layer(maps: list[Column], layer: Layer, function: str) -> list[Column]:
    """Output maps of a layer for one input, ordered by branch and then filter."""
    if len(maps) != layer.branches:
        raise ValueError(f"{len(maps)} maps for {layer.branches} branches")
    if layer.filters is not None:
        return [applied(correlate(m, layer.size, layer.filters[b, f]), function) for b, m in enumerate(maps) for f in range(layer.features)]
    pool = max_pool if layer.pooling == "max" else avg_pool
    return [pool(m, layer.size, layer.window) for m in maps]


def forward(samples: DataFrame, net: CNN, data: str = "data", out: str = "features", keep: bool = False) -> DataFrame:
    """samples with `out`, all final maps behind one another by branch; with keep, the maps of each layer too.

    Each layer is a projection of its own, so that no map is computed twice.
    """
    if not net.layers:
        raise ValueError("the network has no layers")
    df, names = samples.withColumn("__l0_0", F.transform(data, lambda v: v.cast("double"))), ["__l0_0"]
    for n, layer in enumerate(net.layers, 1):
        maps = forward_layer([F.col(c) for c in names], layer, net.function)
        made = [f"__l{n}_{i}" for i in range(len(maps))]
        df = df.withColumns(dict(zip(made, maps, strict=True)))
        if not keep:
            df = df.drop(*names)
        names = made
    df = df.withColumn(out, F.concat(*names))
    return df if keep else df.drop(*names)


def split_features(features: Column, net: CNN) -> list[Column]:
    """The final maps out of forward's array: the inverse of laying them behind one another."""
    n = net.out[0] * net.out[1]
    return [F.slice(features, b * n + 1, n) for b in range(net.branches)]


def backward_layer(maps: list[Column], errors: list[Column], layer: Layer) -> tuple[list[Column], list[Column]]:
    """Errors of the input maps, and gradients by branch and filter of a convolution, for one input.

    The activation's derivative is not part of it: multiply the errors by it before, where it is wanted.
    """
    if layer.filters is None:
        if layer.pooling == "avg":
            return [avg_pool_backward(e, layer.size, layer.window) for e in errors], []
        return [max_pool_backward(e, max_pool_places(m, layer.size, layer.window), layer.size, layer.window) for m, e in zip(maps, errors, strict=True)], []
    back, grads = [], []
    for b, m in enumerate(maps):
        own = errors[b * layer.features : (b + 1) * layer.features]
        grads += [correlate_maps(m, layer.size, e, layer.out) for e in own]
        sent = [convolve_full(e, layer.out, layer.filters[b, f]) for f, e in enumerate(own)]
        back.append(reduce(lambda x, y: F.zip_with(x, y, lambda p, q: p + q), sent))
    return back, grads


def summed_maps(df: DataFrame, columns: list[str]) -> DataFrame:
    """(f, p, v): each column's arrays added up over all rows."""
    maps = F.array(*(F.col(c) for c in columns))
    spread = spread_out(spread_out(df.select(maps.alias("a")), "a", "m", "f"), "m", "v")
    return spread.groupBy(F.col("f").cast("long").alias("f"), F.col("p").cast("long").alias("p")).agg(F.sum("v").alias("v"))


def filter_gradients(df: DataFrame, maps: list[str], errors: list[str], layer: Layer) -> np.ndarray:
    """Mean gradient of a layer's filters over the rows; as large as the filters, so it may come to the driver."""
    _, grads = backward_layer([F.col(c) for c in maps], [F.col(c) for c in errors], layer)
    names = [f"__g{i}" for i in range(len(grads))]
    rows = df.select(*(g.alias(n) for g, n in zip(grads, names, strict=True)))
    n = max(rows.count(), 1)
    out = np.zeros((layer.branches * layer.features, layer.window[0] * layer.window[1]))
    for r in summed_maps(rows, names).collect():
        out[r.f, r.p] = r.v / n
    return out.reshape(layer.filters.shape)


def running_max(data: np.ndarray, window: int, axis: int) -> np.ndarray:
    """Maxima of all windows of so many neighbours along an axis, in three comparisons a number whatever the window.

    Numbers are cut into runs of the window's length. Any window covers the end of
    one run and the beginning of the next, whose maxima run inward and outward.
    """
    if window == 1:
        return data
    data = np.moveaxis(data, axis, -1)
    n = data.shape[-1]
    padded = np.full((*data.shape[:-1], -(-n // window) * window), -np.inf)
    padded[..., :n] = data
    runs = padded.reshape(*data.shape[:-1], -1, window)
    outward = np.maximum.accumulate(runs, axis=-1).reshape(padded.shape)
    inward = np.maximum.accumulate(runs[..., ::-1], axis=-1)[..., ::-1].reshape(padded.shape)
    out = np.maximum(inward[..., : n - window + 1], outward[..., window - 1 : n])
    return np.moveaxis(out, -1, axis)


def running_mean(data: np.ndarray, window: int, axis: int) -> np.ndarray:
    """Means of all windows of so many neighbours along an axis."""
    return sliding_window_view(data, window, axis=axis).mean(axis=-1)


def pooled_block(maps: np.ndarray, layer: Layer) -> np.ndarray:
    """A window's maximum or mean is that of its rows' ones, so a pooling runs along one axis and then the other."""
    run = running_max if layer.pooling == "max" else running_mean
    return run(run(maps, layer.window[0], 2), layer.window[1], 3)


def convolved_block(maps: np.ndarray, layer: Layer) -> np.ndarray:
    """All windows of a block as the rows of a matrix, times the filters as columns: one product for each branch."""
    n, b = maps.shape[:2]
    (h, w), (kh, kw) = layer.out, layer.window
    out = np.empty((n, b, layer.features, h, w))
    filters = layer.filters.reshape(b, layer.features, kh * kw).transpose(0, 2, 1)
    # so many rows of the block that their windows take WINDOW_CELLS numbers
    step = max(1, WINDOW_CELLS // (b * h * w * kh * kw))
    for at in range(0, n, step):
        seen = sliding_window_view(maps[at : at + step], layer.window, axis=(2, 3))
        columns = seen.transpose(1, 0, 2, 3, 4, 5).reshape(b, -1, kh * kw)
        product = np.matmul(columns, filters).reshape(b, -1, h, w, layer.features)
        out[at : at + step] = product.transpose(1, 0, 4, 2, 3)
    return out.reshape(n, b * layer.features, h, w)


def layer_block(maps: np.ndarray, layer: Layer, function: str) -> tuple[np.ndarray, np.ndarray]:
    """Output maps of a layer before and after the activation, for a block of inputs (row, map, y, x)."""
    if layer.filters is None:
        pooled = pooled_block(maps, layer)
        return pooled, pooled
    z = convolved_block(maps, layer)
    return z, activation(function).block(z)


def forward_blocks(samples: DataFrame, net: CNN, data: str = "data", out: str = "features", head: MLP | None = None) -> DataFrame:
    """samples with `out`, the features that forward() gives, or with a head its outputs; by numpy on Arrow batches, in slices of bounded size."""
    if not net.layers:
        raise ValueError("the network has no layers")
    if sum(layer.filters.size for layer in net.layers if layer.filters is not None) > linalg.BLOCK_CELLS:
        raise ValueError("the filters are too many to send to each task")
    names = [c for c in samples.columns if c != out]
    last = head.shipped().topology[-1] if head else net.output_size
    # a row's largest maps, in numbers
    widest = max([net.size[0] * net.size[1], *(layer.branches * layer.features * layer.out[0] * layer.out[1] for layer in net.layers)])
    rows_at_once = max(1, BLOCK_NUMBERS // widest)

    def block(x: np.ndarray) -> np.ndarray:
        maps = x.reshape(len(x), 1, *net.size)
        for layer in net.layers:
            _, maps = layer_block(maps, layer, net.function)
        features = maps.reshape(len(x), -1)
        return head.forward(features)[1][-1] if head else features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(data)
        for batch in batches:
            for first in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(first, rows_at_once)
                y = block(np.asarray(part.column(at).flatten(), float).reshape(part.num_rows, -1))
                lists = pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * last, y.ravel())
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*names, out])

    rows = samples.select(*names)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, ArrayType(DoubleType()))]))


def layer_block_backward(maps: np.ndarray, errors: np.ndarray, layer: Layer) -> tuple[np.ndarray, np.ndarray | None]:
    """backward_layer for a block: errors of the input maps, and the filters' gradients summed over the rows."""
    (h, w), back = layer.out, np.zeros(maps.shape)
    seen = sliding_window_view(maps, layer.window, axis=(2, 3))
    if layer.filters is not None:
        errors = errors.reshape(len(maps), layer.branches, layer.features, h, w)
        for i, j in np.ndindex(layer.window):
            back[:, :, i : i + h, j : j + w] += np.einsum("nbfyx,bf->nbyx", errors, layer.filters[:, :, i, j])
        return back, np.einsum("nbyxij,nbfyx->bfij", seen, errors)
    if layer.pooling == "max":
        first = seen.reshape(*seen.shape[:4], -1).argmax(axis=-1)
    for k, (i, j) in enumerate(np.ndindex(layer.window)):
        back[:, :, i : i + h, j : j + w] += np.where(first == k, errors, 0.0) if layer.pooling == "max" else errors / (layer.window[0] * layer.window[1])
    return back, None


def train_step(samples: DataFrame, net: CNN, head: MLP, rate: float, target: str = "target", data: str = "data") -> None:
    """One full-batch descent step of head and filters; rows have data and target. Changes both in place.

    training.train and train_epoch take a CNNModel too, for momentum, decay and mini-batches.
    """
    train_epoch(samples.select(F.col(data).alias("data"), F.col(target).alias("target")), CNNModel(net, head), Optimiser(rate))


@dataclass
class CNNModel:
    """A network and the perceptron that takes its features."""

    net: CNN
    head: MLP

    @staticmethod
    def random(topology: str, hidden: list[int], seed: int = 0) -> CNNModel:
        net = CNN.from_text(topology).randomise(seed)
        return CNNModel(net, MLP.random([net.output_size, *hidden], "relu", seed))

    @property
    def topology(self) -> list[int]:
        return [self.net.size[0] * self.net.size[1], *self.head.topology]

    @property
    def filtering(self) -> list[Layer]:
        return [layer for layer in self.net.layers if layer.filters is not None]

    @property
    def weights(self) -> list[np.ndarray]:
        """The filters by layer, then the head's weights."""
        return [*(layer.filters for layer in self.filtering), *self.head.weights]

    @weights.setter
    def weights(self, arrays: list[np.ndarray]) -> None:
        n = len(self.filtering)
        for layer, filters in zip(self.filtering, arrays, strict=False):
            layer.set_filters(filters)
        self.head.weights = list(arrays[n:])

    @property
    def biases(self) -> list[np.ndarray]:
        return self.head.biases

    @biases.setter
    def biases(self, arrays: list[np.ndarray]) -> None:
        self.head.biases = list(arrays)

    @property
    def cells(self) -> int:
        return sum(a.size for a in (*self.weights, *self.biases))

    def shipped(self) -> CNNModel:
        """The model itself, if it may go to every task."""
        if self.cells > linalg.BLOCK_CELLS:
            raise ValueError(f"{self.cells} weights are too many to send to each task")
        return self

    def layered(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The maps that go into each layer, the last output behind them, and each layer's maps before the activation."""
        maps, zs = [np.asarray(x, float).reshape(len(x), 1, *self.net.size)], []
        for layer in self.net.layers:
            z, out = layer_block(maps[-1], layer, self.net.function)
            zs.append(z)
            maps.append(out)
        return maps, zs

    def forward(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Pre-activations and activations of the head's layers, for rows of x."""
        return self.head.forward(self.layered(x)[0][-1].reshape(len(x), -1))

    def backward(self, x: np.ndarray, target: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Sums over the rows of the gradients of weights and biases, and the error of the inputs."""
        maps, zs = self.layered(x)
        grads, biases, error = self.head.backward(maps[-1].reshape(len(x), -1), target)
        errors = error.reshape(maps[-1].shape)
        for layer, seen, z in zip(reversed(self.net.layers), reversed(maps[:-1]), reversed(zs), strict=True):
            if layer.filters is not None:
                errors = errors * activation(self.net.function).block_derivative(z)
            errors, found = layer_block_backward(seen, errors, layer)
            if found is not None:
                grads.insert(0, found)
        return grads, biases, errors.reshape(len(x), -1)

    def predict(self, samples: DataFrame, data: str = "data", out: str = "output") -> DataFrame:
        return forward_blocks(samples, self.net, data, out, self.head)
