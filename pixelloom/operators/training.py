"""Training: data-parallel gradients and the update rules.

A step sends the weights, of a checked size, to the tasks, each task adds up
the gradients of its rows by numpy, and the partial sums (one row per task, as
large as the model) are added in a tree: each level is a shuffle to a fraction
of the tasks. Only the sum comes to the driver.

Mini-batches run inside the tasks of a barrier stage, so an epoch is one job that
reads the table once. Each batch is spread over all ranks: every one adds up the
gradient of its rows, the sums go around a ring, and all take the same step, so
the weights are those of one rank up to rounding. A lost task repeats the stage
from the epoch's model. Several `workers`, another algorithm, each step through
their own range of places from the epoch's model without talking to one another,
and the models are averaged by their rows at the epoch's end.

A model is anything with topology, weights, biases, cells, shipped(), forward
and backward of numpy blocks: perceptrons, and networks with their head.
"""

from __future__ import annotations

import copy
import logging
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.collective import Ring
from pixelloom.operators.evaluate import metrics
from pixelloom.operators.mlp import MLP, classified, score_blocks

log = logging.getLogger(__name__)
#: Partial sums that a task of the tree adds up.
FAN = 32
#: Rows of a mini-batch that are worth a rank of their own.
RANK_ROWS = 32
SUMS = "part bigint, n bigint, g binary"


def levels(tasks: int) -> list[int]:
    """Tasks in each level of a tree over the partial sums of so many tasks, down to one."""
    out = []
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        out.append(tasks)
    return out if out and out[-1] == 1 else [*out, 1]


def partial(held: np.ndarray, rows: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "n": pa.array([rows], pa.int64()), "g": pa.array([held.tobytes()], pa.binary())})


def merged(parts: DataFrame, cells: int, widths: list[int]) -> DataFrame:
    """Partial sums (part, n, g) added up in levels of so many tasks."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(cells), 0
        for batch in batches:
            for n, g in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                held += np.frombuffer(g.as_buffer())
                rows += n
        if rows:
            yield partial(held, rows)

    for width in widths:
        parts = parts.repartition(width, "part").mapInArrow(merge, SUMS)
    return parts


def total(parts: DataFrame, cells: int) -> tuple[np.ndarray, int]:
    """The sum of all partial sums and the rows behind it."""
    spark = parts.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    found = merged(parts, cells, levels(tasks)).collect()
    return (np.frombuffer(found[0].g), found[0].n) if found else (np.zeros(cells), 0)


def flat(*arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for group in arrays for a in group])


def unflat(numbers: np.ndarray, model: MLP) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Arrays of the shapes of the model's weights and biases."""
    out, at = [], 0
    for shape in (x.shape for x in (*model.weights, *model.biases)):
        size = int(np.prod(shape))
        out.append(numbers[at : at + size].reshape(shape))
        at += size
    return out[: len(model.weights)], out[len(model.weights) :]


def gradient(samples: DataFrame, model: MLP, data: str = "data", target: str = "target") -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Gradient sums over all rows of samples and their number."""
    cells = model.shipped().cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(cells), 0
        for batch in batches:
            if n := batch.num_rows:
                x, t = (np.asarray(batch.column(i).flatten(), float).reshape(n, -1) for i in (0, 1))
                grads, biases, _ = model.backward(x, t)
                held += flat(grads, biases)
                rows += n
        if rows:
            yield partial(held, rows)

    held, rows = total(samples.select(data, target).mapInArrow(run, SUMS), cells)
    return *unflat(held, model), rows


@dataclass
class Optimiser:
    """W -= lr * g; with momentum m, v = lr * g + m * v and W -= v; with decay, lr = lr0 / (1 + decay * epoch).

    Biases stay as they are unless train_biases is set.
    """

    rate: float = 0.08
    momentum: float = 0.0
    decay: float = 0.0
    train_biases: bool = False
    epoch: int = 0
    velocity: dict[tuple[str, int], np.ndarray] = field(default_factory=dict)

    @property
    def current_rate(self) -> float:
        return self.rate / (1 + self.decay * self.epoch)

    def _step(self, key: tuple[str, int], grad: np.ndarray) -> np.ndarray:
        step = self.current_rate * grad
        if self.momentum:
            step = step + self.momentum * self.velocity.get(key, 0.0)
            self.velocity[key] = step
        return step

    def apply(self, model: MLP, grads: list[np.ndarray], biases: list[np.ndarray], rows: int) -> None:
        """Changes the model by the mean gradient."""
        if not rows:
            return
        model.weights = [w - self._step(("w", i), g / rows) for i, (w, g) in enumerate(zip(model.weights, grads, strict=True))]
        if self.train_biases:
            model.biases = [b - self._step(("b", i), g / rows) for i, (b, g) in enumerate(zip(model.biases, biases, strict=True))]

    def end_epoch(self) -> None:
        self.epoch += 1


@dataclass(frozen=True)
class Settings:
    """The defaults of a training run."""

    image_side: int = 32
    tensor_size: int = 256
    batch_size: int = 16
    rate: float = 0.08
    momentum: float = 0.9
    decay: float = 0.001
    epochs: int = 75
    hidden: tuple[int, ...] = (1024, 1024, 1024, 1024, 512, 256)
    function: str = "leakyRelu"


def with_target(samples: DataFrame, classes: int) -> DataFrame:
    from pixelloom.operators.dataset import one_hot

    return samples.withColumn("target", one_hot(F.col("class_id"), classes))


def velocities(optimiser: Optimiser, model: MLP) -> np.ndarray:
    """The optimiser's velocities in the order of flat(weights, biases), 0 where there is none yet."""
    shapes = [(("w", i), w) for i, w in enumerate(model.weights)] + [(("b", i), b) for i, b in enumerate(model.biases)]
    return flat([np.broadcast_to(optimiser.velocity.get(k, 0.0), a.shape) for k, a in shapes])


def restore(model: MLP, optimiser: Optimiser, weights: np.ndarray, speed: np.ndarray) -> None:
    """Sets model and velocities from flat arrays."""
    model.weights, model.biases = unflat(weights, model)
    if optimiser.momentum:
        by_weight, by_bias = unflat(speed, model)
        optimiser.velocity = {("w", i): v for i, v in enumerate(by_weight)} | ({("b", i): v for i, v in enumerate(by_bias)} if optimiser.train_biases else {})


def arrays_of(batch: pa.RecordBatch, at: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets of a batch as float matrices."""
    return tuple(np.asarray(batch.column(i).flatten(), float).reshape(batch.num_rows, -1) for i in (at, at + 1))


def default_ranks(samples: DataFrame, batch_size: int) -> int:
    """As many as have RANK_ROWS rows of a batch each, one at least, and no more than the session has slots."""
    return max(1, min(batch_size // RANK_ROWS, samples.sparkSession.sparkContext.defaultParallelism))


def stepped(samples: DataFrame, model: MLP, optimiser: Optimiser, batch_size: int, ranks: int) -> None:
    """One pass in mini-batches of `batch_size` by pos, each over all ranks; changes model and velocities in place.

    Needs as many free slots as ranks, and pos counting from 0; a batch of which
    no row is left takes no step.
    """
    cells = model.shipped().cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rule, ring = copy.deepcopy(model), copy.deepcopy(optimiser), Ring(BarrierTaskContext.get())
        source = (b for b in batches if b.num_rows)
        pos, x, t = np.zeros(0, np.int64), np.zeros((0, own.topology[0])), np.zeros((0, own.topology[-1]))
        end, more, any_rows = batch_size, True, False
        try:
            while True:
                # all own rows of the batch that ends before `end`
                parts = [(pos, x, t)]
                while more and (not len(parts[-1][0]) or parts[-1][0][-1] < end):
                    batch = next(source, None)
                    more = batch is not None
                    if more:
                        parts.append((batch.column(0).to_numpy(), *arrays_of(batch, 1)))
                pos, x, t = (np.concatenate(c) for c in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]
                n = int(np.searchsorted(pos, end))
                sums = np.zeros(cells + 2)
                if n:
                    grads, biases, _ = own.backward(x[:n], t[:n])
                    sums[:cells] = flat(grads, biases)
                pos, x, t = pos[n:], x[n:], t[n:]
                sums[cells:] = n, more or len(pos) > 0
                sums = ring.total(sums)
                rows = round(sums[cells])
                rule.apply(own, *unflat(sums[:cells], own), rows)
                any_rows, end = any_rows or rows > 0, end + batch_size
                if not sums[cells + 1]:
                    break
        finally:
            ring.close()
        if any_rows and not ring.rank:
            yield partial(np.concatenate([flat(own.weights, own.biases), velocities(rule, own)]), 1)

    dealt = samples.select(F.col("pos").cast("long").alias("pos"), "data", "target").repartition(ranks, "pos").sortWithinPartitions("pos")
    # Spark can repeat a barrier stage only if a shuffle follows it
    for r in dealt.mapInArrow(run, SUMS, barrier=True).repartition(1).collect():
        both = np.frombuffer(r.g)
        restore(model, optimiser, both[:cells], both[cells:])


def averaged(samples: DataFrame, model: MLP, optimiser: Optimiser, batch_size: int, workers: int) -> None:
    """One pass in which each worker steps through its own range of pos; the mean of their models and velocities by rows."""
    cells = model.shipped().cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rule, rows = copy.deepcopy(model), copy.deepcopy(optimiser), 0
        x, t = np.zeros((0, own.topology[0])), np.zeros((0, own.topology[-1]))

        def step(n: int) -> None:
            grads, biases, _ = own.backward(x[:n], t[:n])
            rule.apply(own, grads, biases, n)

        for batch in batches:
            if n := batch.num_rows:
                x, t = (np.concatenate(pair) for pair in zip((x, t), arrays_of(batch), strict=True))
                rows += n
                while len(x) >= batch_size:
                    step(batch_size)
                    x, t = x[batch_size:], t[batch_size:]
        if len(x):
            step(len(x))
        if rows:
            yield partial(rows * np.concatenate([flat(own.weights, own.biases), velocities(rule, own)]), rows)

    dealt = samples.repartitionByRange(workers, "pos").sortWithinPartitions("pos")
    held, rows = total(dealt.select("data", "target").mapInArrow(run, SUMS), 2 * cells)
    if rows:
        restore(model, optimiser, held[:cells] / rows, held[cells:] / rows)


def train_epoch(samples: DataFrame, model: MLP, optimiser: Optimiser, batch_size: int | None = None, workers: int = 1, ranks: int | None = None) -> None:
    """One pass: one step over all rows, or (needs pos) a step per mini-batch of `batch_size`.

    Each mini-batch is shared by `ranks` tasks; or several workers step apart and are averaged.
    """
    if batch_size is None:
        optimiser.apply(model, *gradient(samples, model))
    else:
        if batch_size <= 0 or workers <= 0 or (ranks is not None and ranks <= 0):
            raise ValueError("a batch holds at least one sample, and there is at least one worker")
        if workers > 1:
            if ranks not in (None, 1):
                raise ValueError("workers that step apart do not share a batch")
            averaged(samples, model, optimiser, batch_size, workers)
        else:
            stepped(samples, model, optimiser, batch_size, ranks or default_ranks(samples, batch_size))
    optimiser.end_epoch()


def train(samples: DataFrame, evaluation: DataFrame, model: MLP, optimiser: Optimiser, classes: int, epochs: int, batch_size: int | None = None, workers: int = 1, ranks: int | None = None) -> DataFrame:
    """Trains the model in place; (epoch, class_id, precision, recall, f1) on the evaluation set, class_id null for the mean.

    The samples should be cached or on fast storage: each epoch reads them once.
    """
    spark, history = samples.sparkSession, []
    for epoch in range(epochs):
        began = time.monotonic()
        train_epoch(samples, model, optimiser, batch_size, workers, ranks)
        scored = classified(score_blocks(evaluation, model))
        for r in metrics(scored.select(F.col("pred"), F.col("class_id").alias("truth")), classes).collect():
            history.append((epoch, r.class_id, r.precision, r.recall, r.f1))
        log.info("epoch %d took %.0f ms, macro f1 %.4f", epoch, 1000 * (time.monotonic() - began), history[-1][-1])
    return spark.createDataFrame(history, "epoch int, class_id bigint, precision double, recall double, f1 double")
