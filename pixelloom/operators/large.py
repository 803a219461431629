"""Perceptrons larger than a task or the driver: their weights as tables of tiles.

A layer's weights are tiles (bo, bk, z) of side x side numbers, its biases tiles
(bo, z), and samples tiles (br, bk, z) of as many rows and columns. A layer is
one product on a grid of tiles (`linalg.grid_product`), the backward pass two more:
the transposed errors times the inputs give the gradients by tile, the errors times
the weights what goes to the layer before. Gradients meet their weights in a join
on the tile's place. Neither weights nor gradients pass through the driver, and a
task holds some tiles, however large the model.

Each layer's activations and each step's weights are written to the shared folder,
so a lost executor costs no more than the layer at hand.

Rows: every sample has as many numbers as the first layer takes, else the job
raises; samples are told apart by pos, counted from 0 without gaps; without
samples a step changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.activation import activation
from pixelloom.operators import linalg
from pixelloom.operators.linalg import packed, unpacked
from pixelloom.session import durable

SIDE = 512
#: Bytes of a layer's biases up to which they are broadcast; beyond that the join is salted.
BROADCAST_BYTES = 32 << 20
SALTS = 64
TILE = "bi bigint, bj bigint, z binary"


def mapped(df: DataFrame, function: Callable[..., np.ndarray], *more: str) -> DataFrame:
    """Tiles (bi, bj, z) with function(z, more...) in place of z; a null among `more` is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = [batch.column(c)[i].as_py() for c in range(2, batch.num_columns)]
                z = function(*(None if r is None else unpacked(r) for r in raw))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([packed(z)], pa.binary())], names=["bi", "bj", "z"])

    return df.select("bi", "bj", "z", *more).mapInArrow(run, TILE)


def product(left: DataFrame, right: DataFrame, blocks: tuple[int, int, int], side: int, ta: bool = False, tb: bool = False) -> DataFrame:
    """op(left) * op(right) as tiles; blocks are those of the output's rows and columns and of the inner dimension."""
    grid = linalg.grid_for(*blocks, linalg.tasks_of(left.sparkSession), side)
    row, inner = ("bj", "bi") if ta else ("bi", "bj")
    col, inner_b = ("bi", "bj") if tb else ("bj", "bi")
    a = left.select(F.col(row).alias("r"), F.col(inner).alias("k"), F.col("z").alias("tile"))
    b = right.select(F.col(col).alias("r"), F.col(inner_b).alias("k"), F.col("z").alias("tile"))
    read = lambda flip: (lambda t: unpacked(t.as_py()).T) if flip else (lambda t: unpacked(t.as_py()))
    return linalg.grid_product(a, b, grid, read(ta), read(tb))


def sample_tiles(samples: DataFrame, column: str, width: int, side: int) -> DataFrame:
    """Tiles of the arrays in `column`, rows by pos; a task holds `side` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if rows:
                a = np.stack(rows)
                if a.shape[1] != width:
                    raise ValueError(f"samples have {a.shape[1]} numbers, the model takes {width}")
                for k in range(0, width, side):
                    yield pa.RecordBatch.from_pydict({"bi": pa.array([now], pa.int64()), "bj": pa.array([k // side], pa.int64()), "z": pa.array([packed(a[:, k : k + side])], pa.binary())})

        for batch in batches:
            for br, data in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if br != now:
                    yield from out()
                    now, rows = br, []
                rows.append(np.asarray(data.values, float))
        yield from out()

    read = samples.select(F.floor(F.col("pos") / side).alias("br"), "pos", F.col(column).alias("data"))
    return read.repartition("br").sortWithinPartitions("br", "pos").mapInArrow(run, TILE)


def with_biases(sums: DataFrame, biases: DataFrame, width: int) -> DataFrame:
    """Tiles of sums with the tile b of biases that belongs to their columns, however many rows of tiles there are."""
    named = biases.select(F.col("bi").alias("bj"), F.col("z").alias("b"))
    if 8 * width <= BROADCAST_BYTES:
        return sums.join(F.broadcast(named), "bj")
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return sums.withColumn("salt", (F.col("bi") % SALTS).cast("int")).join(named, ["bj", "salt"]).drop("salt")


def column_sums(tiles: DataFrame) -> DataFrame:
    """Tiles (bj, 0, z) of the sums of all rows, added up in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for bj, z in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                held[bj] = held.get(bj, 0) + unpacked(z.as_py()).sum(axis=0)[:, None]
        for bj, z in held.items():
            yield pa.RecordBatch.from_pydict({"bi": pa.array([bj], pa.int64()), "bj": pa.array([0], pa.int64()), "z": pa.array([packed(z)], pa.binary())})

    return linalg.summed_tiles(tiles.select("bi", "bj", "z").mapInArrow(run, TILE))


@dataclass
class TiledMLP:
    """topology and activations as of an MLP; weights[l] and biases[l] are tables of tiles."""

    topology: list[int]
    activations: list[str]
    weights: list[DataFrame]
    biases: list[DataFrame]
    side: int = SIDE

    def blocks(self, width: int) -> int:
        return -(-width // self.side)

    @staticmethod
    def random(spark: SparkSession, topology: list[int], function: str = "sigmoid", seed: int = 0, side: int = SIDE) -> TiledMLP:
        """Uniform in +-sqrt(2 / outputs) of the layer, made tile by tile where it will lie."""
        out = TiledMLP(list(topology), [function] * (len(topology) - 1), [], [], side)
        for n, (width, height) in enumerate(zip(topology, topology[1:], strict=False)):
            bound, across = (2 / height) ** 0.5, out.blocks(width)

            def made(batches: Iterator[pa.RecordBatch], n: int = n, width: int = width, height: int = height, bound: float = bound, across: int = across) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for at in batch.column(0).to_pylist():
                        o, k = divmod(at, across + 1)
                        rng = np.random.default_rng([seed, n, o, k])
                        # the last column of tiles holds the biases
                        shape = min(side, height - o * side), 1 if k == across else min(side, width - k * side)
                        yield pa.RecordBatch.from_pydict({"bi": pa.array([o], pa.int64()), "bj": pa.array([k], pa.int64()), "z": pa.array([packed(rng.uniform(-bound, bound, shape))], pa.binary())})

            tiles = durable(spark.range(out.blocks(height) * (across + 1)).repartition(linalg.tasks_of(spark)).mapInArrow(made, TILE))
            out.weights.append(tiles.filter(F.col("bj") < across))
            out.biases.append(tiles.filter(F.col("bj") == across).withColumn("bj", F.lit(0).cast("long")))
        return out

    @staticmethod
    def of(spark: SparkSession, weights: list[np.ndarray], biases: list[np.ndarray], activations: list[str], side: int = SIDE) -> TiledMLP:
        """Cuts a model that fits the driver."""
        topology = [weights[0].shape[1], *(w.shape[0] for w in weights)]

        def cut(a: np.ndarray) -> DataFrame:
            rows = [(i // side, j // side, bytearray(packed(a[i : i + side, j : j + side]))) for i in range(0, a.shape[0], side) for j in range(0, a.shape[1], side)]
            return spark.createDataFrame(rows, TILE)

        return TiledMLP(topology, list(activations), [cut(w) for w in weights], [cut(b[:, None]) for b in biases], side)

    def dense(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Weights and biases as matrices on the driver, for models that fit it."""

        def whole(tiles: DataFrame) -> np.ndarray:
            rows: dict[int, dict[int, np.ndarray]] = {}
            for r in tiles.collect():
                rows.setdefault(r.bi, {})[r.bj] = unpacked(bytes(r.z))
            return np.concatenate([np.concatenate([rows[i][j] for j in sorted(rows[i])], axis=1) for i in sorted(rows)])

        return [whole(w) for w in self.weights], [whole(b).ravel() for b in self.biases]

    def save(self, folder: str) -> None:
        for n, tiles in enumerate(zip(self.weights, self.biases, strict=True)):
            for name, df in zip(("weights", "biases"), tiles, strict=True):
                df.write.mode("overwrite").parquet(f"{folder}/{n}/{name}")

    def loaded(self, folder: str) -> TiledMLP:
        """The same shape with the tiles of a folder."""
        spark = self.weights[0].sparkSession
        read = [[spark.read.parquet(f"{folder}/{n}/{name}") for n in range(len(self.weights))] for name in ("weights", "biases")]
        return TiledMLP(self.topology, self.activations, *read, self.side)

    def layered(self, x: DataFrame, rows: int) -> tuple[list[DataFrame], list[DataFrame]]:
        """Tiles of each layer's sums and activations, the inputs first among the latter."""
        zs, acts = [], [x]
        for n, (w, b, name) in enumerate(zip(self.weights, self.biases, self.activations, strict=True)):
            blocks = self.blocks(rows), self.blocks(self.topology[n + 1]), self.blocks(self.topology[n])
            sums = product(acts[-1], w, blocks, self.side, tb=True)
            zs.append(durable(mapped(with_biases(sums, b, self.topology[n + 1]), lambda z, b: z + b.T, "b")))
            acts.append(mapped(zs[-1], activation(name).block))
        return zs, acts

    def predict(self, samples: DataFrame, data: str = "data", out: str = "output") -> DataFrame:
        """(pos, `out`) of samples with pos; an output layer's numbers are in one row."""
        rows = samples.count()
        if not rows:
            return samples.select("pos", F.col(data).alias(out))
        _, acts = self.layered(durable(sample_tiles(samples, data, self.topology[0], self.side)), rows)
        side = self.side

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, parts = None, []

            def lines() -> Iterator[pa.RecordBatch]:
                if parts:
                    a = np.concatenate(parts, axis=1)
                    ends = np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(now * side + np.arange(len(a))), pa.ListArray.from_arrays(ends, a.ravel())], names=["pos", out])

            for batch in batches:
                for bi, z in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                    if bi != now:
                        yield from lines()
                        now, parts = bi, []
                    parts.append(unpacked(z.as_py()))
            yield from lines()

        return acts[-1].repartition("bi").sortWithinPartitions("bi", "bj").mapInArrow(run, f"pos bigint, `{out}` array<double>")

    def step(self, samples: DataFrame, rate: float, data: str = "data", target: str = "target", train_biases: bool = False) -> None:
        """One step of descent on the mean gradient of all samples; the new weights are in the shared folder when it returns."""
        rows = samples.count()
        if not rows:
            return
        side, last = self.side, len(self.weights) - 1
        x, t = (durable(sample_tiles(samples, c, self.topology[n], side)) for c, n in ((data, 0), (target, -1)))
        zs, acts = self.layered(x, rows)
        error = acts[-1].join(t.withColumnRenamed("z", "t"), ["bi", "bj"])
        error = mapped(error, lambda a, t: a - t, "t")
        for n in range(last, -1, -1):
            slope = activation(self.activations[n]).block_derivative
            delta = durable(mapped(error.join(zs[n].withColumnRenamed("z", "s"), ["bi", "bj"]), lambda e, s, f=slope: f(s) * e, "s"))
            high, wide, deep = self.blocks(self.topology[n + 1]), self.blocks(self.topology[n]), self.blocks(rows)
            # the error of the layer before needs this layer's old weights
            if n:
                error = durable(product(delta, self.weights[n], (deep, wide, high), side))
            grads = product(delta, acts[n], (high, wide, deep), side, ta=True).withColumnRenamed("z", "g")
            self.weights[n] = durable(mapped(self.weights[n].join(grads, ["bi", "bj"], "left"), lambda w, g: w if g is None else w - rate * g / rows, "g"))
            if train_biases:
                sums = column_sums(delta).withColumnRenamed("z", "g")
                self.biases[n] = durable(mapped(self.biases[n].join(sums, ["bi", "bj"], "left"), lambda b, g: b if g is None else b - rate * g / rows, "g"))
