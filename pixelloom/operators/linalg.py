"""Matrix operators in three forms.

* Dense: a row holds a matrix as a row-major array; the operators are column
  expressions without a shuffle, for the small matrices of samples.
* Coordinates: a matrix is a table (i, j, v); products are an equi-join on the
  inner index and a sum, for matrices of any size, or, for dense ones, products
  of tiles on a grid over rows, columns and, where needed, the inner index.
* Blocks: rows of a tall matrix against a matrix that fits in memory, by numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.binding import let, spread_out
from pixelloom.operators.ordering import by_partition

#: Numbers up to which a matrix goes to each task in full.
BLOCK_CELLS = 8_000_000
#: Cells of output tiles that a task of a tiled product adds up.
TILES_HELD = 1 << 22
#: Products of one inner index from which its rows and columns are dealt out over several keys, and rows or columns of each.
HOT, HOT_SIDE = 1 << 24, 1 << 10
#: Cells of keyed matrices, with those of a summand, that a task multiplies by a shared matrix and adds up.
CELLS_HELD = 1 << 18


def same_shape(a: tuple, b: tuple) -> None:
    if a != b:
        raise ValueError(f"shapes differ: {a} and {b}")


# dense

def total(data: Column) -> Column:
    """Sum; null for an empty matrix."""
    return F.when(F.size(data) > 0, F.aggregate(data, F.lit(0.0), lambda a, x: a + x))


def absolute_total(data: Column) -> Column:
    return F.when(F.size(data) > 0, F.aggregate(data, F.lit(0.0), lambda a, x: a + F.abs(x)))


def l2_norm(data: Column) -> Column:
    return F.when(F.size(data) > 0, F.sqrt(F.aggregate(data, F.lit(0.0), lambda a, x: a + x * x)))


def argmax(data: Column) -> Column:
    """0-based place of the largest value, the first of equals."""
    return let(data, lambda data: F.array_position(data, F.array_max(data)) - 1)


def argmax_absolute(data: Column) -> Column:
    """0-based place of the value largest without its sign; this is the rule that picks a class."""
    return argmax(F.transform(data, F.abs))


def add(a: Column, b: Column, factor: float = 1.0) -> Column:
    """a + factor * b."""
    return F.zip_with(a, b, lambda x, y: x + y * factor)


def sub(a: Column, b: Column, factor: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y * factor)


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def scale(a: Column, factor: float) -> Column:
    return F.transform(a, lambda x: x * factor)


def filled(rows: int, cols: int, value: float) -> Column:
    return F.array_repeat(F.lit(float(value)), rows * cols)


def random(rows: int, cols: int, low: float, high: float, seed: int, key: Column, padding: int = 0) -> Column:
    """Numbers in [low, high) that depend on seed, key and place; 0 in a border of `padding`."""

    def one(k: Column) -> Column:
        r, c = F.floor(k / cols), k % cols
        inner = (r >= padding) & (r < rows - padding) & (c >= padding) & (c < cols - padding)
        unit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key, k)), 1, 8), 16, 10).cast("long") / float(1 << 32)
        return F.when(inner, unit * (high - low) + low).otherwise(0.0)

    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), one)


def printed(data: Column, cols: int) -> Column:
    """A matrix as text: a line for each row, its numbers apart by a space."""

    def lines(data: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(data), F.lit(cols))
        return F.concat(F.array_join(F.transform(starts, lambda at: F.array_join(F.slice(data, at, cols), " ")), "\n"), F.lit("\n"))

    return F.when(F.size(data) > 0, let(data, lines)).otherwise("")


def transposed(data: Column, rows: int, cols: int) -> Column:
    return let(data, lambda data: F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda k: F.get(data, (k % rows * cols + F.floor(k / rows)).cast("int"))))


def product(a: Column, shape_a: tuple[int, int], b: Column, shape_b: tuple[int, int], ta: bool = False, tb: bool = False, alpha: float = 1.0) -> Column:
    """alpha * op(a) * op(b) for arrays of one row; op transposes if its flag is set."""
    m, inner = shape_a[::-1] if ta else shape_a
    inner_b, n = shape_b[::-1] if tb else shape_b
    if inner != inner_b:
        raise ValueError(f"inner sizes differ: {inner} and {inner_b}")

    def cell(k: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(k / n), k % n

        def step(acc: Column, t: Column) -> Column:
            x = F.get(a, (t * shape_a[1] + i if ta else i * shape_a[1] + t).cast("int"))
            y = F.get(b, (j * shape_b[1] + t if tb else t * shape_b[1] + j).cast("int"))
            return acc + x * y

        return F.aggregate(F.sequence(F.lit(0), F.lit(inner - 1)), F.lit(0.0), step) * alpha

    return let(a, lambda a: let(b, lambda b: F.transform(F.sequence(F.lit(0), F.lit(m * n - 1)), lambda k: cell(k, a, b))))


def vector_product(weights: np.ndarray, x: Column) -> Column:
    """weights (a small matrix of the driver) times the array x."""
    rows = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in weights))
    return let(x, lambda x: F.transform(rows, lambda w: F.aggregate(F.zip_with(w, x, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)))


# coordinates

def cells(df: DataFrame, data: str, cols: int, *keys: str) -> DataFrame:
    """(keys, i, j, v) of dense matrices."""
    spread = spread_out(df.select(*keys, data), data, "v")
    return spread.select(*keys, F.floor(F.col("p") / cols).alias("i"), (F.col("p") % cols).cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def fits_in_blocks(rows: DataFrame) -> bool:
    return rows.limit(BLOCK_CELLS + 1).count() <= BLOCK_CELLS


def dealt_out(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """The two sides of a product and the columns to join on.

    An inner index with p cells on the left and q on the right gives p * q
    products. Where that is HOT or more, its left cells are dealt into parts by i
    and its right ones by j, and each part meets every part of the other side.
    """
    counted = left.groupBy("k").agg(F.count("*").alias("p")).join(right.groupBy("k").agg(F.count("*").alias("q")), "k")
    hot = counted.filter(F.col("p").cast("double") * F.col("q") >= HOT).select("k", F.ceil(F.col("p") / HOT_SIDE).cast("int").alias("ps"), F.ceil(F.col("q") / HOT_SIDE).cast("int").alias("qs"))
    few = hot.limit(HOT_SIDE + 1).count()
    if not few:
        return left, right, ["k"]
    hot = F.broadcast(hot) if few <= HOT_SIDE else hot
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    part = lambda c, n: F.pmod(F.hash(c), F.coalesce(F.col(n), F.lit(1)))
    left = left.join(hot, "k", "left").select("i", "k", "x", part("i", "ps").alias("s"), every("qs").alias("t"))
    right = right.join(hot, "k", "left").select("k", "j", "y", part("j", "qs").alias("t"), every("ps").alias("s"))
    return left, right, ["k", "s", "t"]


def shared_products(left: DataFrame, right: DataFrame, extra: DataFrame, alpha: float, keys: tuple[str, ...], shared: str) -> DataFrame:
    """alpha * left * right + extra by key, where the side named by `shared` has no keys.

    The cells of the side with keys and those of `extra` are dealt out together,
    by key and the index that they have in common, over as many tasks as they
    fill; so a task's memory does not grow with the table, and they move once.
    """
    own, one, mine, other = (right, left, "j", "i") if shared == "a" else (left, right, "i", "j")
    value, factor = ("y", "x") if shared == "a" else ("x", "y")
    index = one.schema[other].dataType
    cells = own.select(*keys, "k", mine, F.col(value).alias("v"), F.lit(None).cast(index).alias("at"))
    cells = cells.unionByName(extra.select(*keys, F.lit(None).cast(own.schema["k"].dataType).alias("k"), mine, "v", F.col(other).alias("at")))
    parts = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cells.count() // CELLS_HELD))
    met = cells.repartition(parts, *keys, mine).join(one, "k", "left")
    v = F.when(F.col(other).isNull(), F.col("v")).otherwise(F.col("v") * F.col(factor) * alpha)
    summands = met.select(*keys, F.coalesce(other, "at").alias(other), mine, v.alias("v")).filter(F.col(other).isNotNull())
    return summands.groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def gemm(a: DataFrame, b: DataFrame, ta: bool = False, tb: bool = False, alpha: float = 1.0, beta: float = 0.0, c: DataFrame | None = None, keys: tuple[str, ...] = (), shared: str | None = None) -> DataFrame:
    """alpha * op(a) * op(b) + beta * c as coordinates; cells without a summand have no row.

    With keys, one product per key. `shared` names a side ("a" or "b") that has
    no keys: the same matrix for all of them. A c without keys is added for every
    key of a or b, also where the product is empty; it or the list of keys must
    fit BLOCK_CELLS.
    """
    left = a.select(*(() if shared == "a" else keys), F.col("j" if ta else "i").alias("i"), F.col("i" if ta else "j").alias("k"), F.col("v").alias("x"))
    right = b.select(*(() if shared == "b" else keys), F.col("j" if tb else "i").alias("k"), F.col("i" if tb else "j").alias("j"), F.col("v").alias("y"))
    on = ["k"] if shared else [*keys, "k"]
    if not keys:
        left, right, on = dealt_out(left, right)
    added = c is not None and bool(beta)
    if not added:
        return left.join(right, on).groupBy(*keys, "i", "j").agg((F.sum(F.col("x") * F.col("y")) * alpha).alias("v"))
    extra = c.select(*(k for k in keys if k in c.columns), "i", "j", (F.col("v") * beta).alias("v"))
    if not set(keys) <= set(c.columns):
        every = reduce(DataFrame.union, (d.select(*keys) for d, side in ((a, "a"), (b, "b")) if side != shared)).distinct()
        if fits_in_blocks(extra):
            extra = every.crossJoin(F.broadcast(extra))
        elif fits_in_blocks(every):
            extra = extra.crossJoin(F.broadcast(every))
        else:
            raise ValueError("c and the keys are both too many to send to each task; give c keys")
    if keys and shared:
        return shared_products(left, right, extra, alpha, keys, shared)
    out = left.join(right, on).groupBy(*keys, "i", "j").agg((F.sum(F.col("x") * F.col("y")) * alpha).alias("v"))
    return out.unionByName(extra).groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def summed(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """alpha * a + beta * b as coordinates."""
    both = a.select(*keys, "i", "j", (F.col("v") * alpha).alias("v")).unionByName(b.select(*keys, "i", "j", (F.col("v") * beta).alias("v")))
    return both.groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def flipped(a: DataFrame) -> DataFrame:
    """Transposed coordinates."""
    return a.select(*(c for c in a.columns if c not in ("i", "j", "v")), F.col("j").alias("i"), F.col("i").alias("j"), "v")


def collapsed(a: DataFrame) -> DataFrame:
    """Sum of all matrices of a tensor, as coordinates."""
    return a.groupBy("i", "j").agg(F.sum("v").alias("v"))


def slice_of(samples: DataFrame, parts: int, n: int, total: int) -> DataFrame:
    """The n-th of `parts` runs of `total` matrices; the first runs are one larger. Needs pos."""
    small, over = divmod(total, parts)
    begin = n * small + min(n, over)
    return sliced(samples, begin, begin + small + (n < over))


def sliced(samples: DataFrame, begin: int, end: int) -> DataFrame:
    """The matrices from begin to before end; needs pos."""
    if not 0 <= begin <= end:
        raise ValueError("not a range")
    return samples.filter((F.col("pos") >= begin) & (F.col("pos") < end)).withColumn("pos", F.col("pos") - begin)


def reshaped(samples: DataFrame, rows: int, cols: int) -> DataFrame:
    """The same numbers as rows x cols; a matrix of another size raises in the job."""
    bad = F.raise_error(F.concat(F.lit("cannot reshape a matrix of size "), F.size("data").cast("string")))
    return samples.withColumns({"n_rows": F.lit(rows), "n_cols": F.lit(cols), "data": F.when(F.size("data") == rows * cols, F.col("data")).otherwise(bad)})


# blocks

def tall_product(df: DataFrame, data: str, weights: np.ndarray, out: str = "product") -> DataFrame:
    """Each row's array times `weights` (inner x n), which goes to every task; by numpy on Arrow batches."""
    if weights.size > BLOCK_CELLS:
        raise ValueError(f"{weights.size} numbers are too many to send to each task; use gemm()")
    names = [c for c in df.columns if c != out]
    w = np.ascontiguousarray(weights, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(data)
        for batch in batches:
            n = batch.num_rows
            x = np.asarray(batch.column(at).flatten(), float).reshape(n, -1) if n else np.zeros((0, w.shape[0]))
            y = x @ w
            offsets = np.arange(n + 1, dtype=np.int32) * w.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, y.ravel())], names=[*names, out])

    rows = df.select(*names)
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", {out} array<double>")


def tiles(a: DataFrame, side: int) -> DataFrame:
    """(bi, bj, cells): the coordinates of each side x side tile, at most that many, with flat places in it."""
    p = ((F.col("i") % side) * side + F.col("j") % side).cast("int")
    key = a.select(F.floor(F.col("i") / side).alias("bi"), F.floor(F.col("j") / side).alias("bj"), F.struct(p.alias("p"), "v").alias("cell"))
    return key.groupBy("bi", "bj").agg(F.collect_list("cell").alias("cells"))


@dataclass(frozen=True)
class Grid:
    """Parts of an output's rows and columns of tiles, and of the inner dimension; a task multiplies one of each."""

    rows: int
    cols: int
    inner: int

    @property
    def tasks(self) -> int:
        return self.rows * self.cols * self.inner

    def moved(self, bi: int, bj: int, k: int) -> int:
        """Tiles that are shuffled when there are bi by k and k by bj tiles, partial sums included."""
        return bi * k * self.cols + k * bj * self.rows + (bi * bj * self.inner if self.inner > 1 else 0)

    def held(self, bi: int, bj: int) -> int:
        """Output tiles that one task adds up."""
        return -(-bi // self.rows) * -(-bj // self.cols)


def grid_for(bi: int, bj: int, k: int, tasks: int, side: int = 64) -> Grid:
    """The grid with the fewest shuffled tiles among those that keep `tasks` tasks busy, as far as there are tiles, and hold at most TILES_HELD cells of output in each."""
    steps = lambda n: sorted({min(n, 1 << e) for e in range(n.bit_length() + 1)})
    wanted = min(tasks, bi * bj * k)
    grids = (Grid(r, c, d) for r in steps(bi) for c in steps(bj) for d in steps(k))
    fitting = [g for g in grids if g.held(bi, bj) <= max(1, TILES_HELD // side**2) and 2 * g.tasks > wanted]
    return min(fitting, key=lambda g: (g.moved(bi, bj, k), abs(g.tasks - wanted), g.inner))


def tasks_of(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def packed(a: np.ndarray) -> bytes:
    """A matrix as its shape and its numbers."""
    return np.array(a.shape, np.int64).tobytes() + np.ascontiguousarray(a, float).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, float, offset=16).reshape(np.frombuffer(raw, np.int64, 2))


def grid_product(left: DataFrame, right: DataFrame, grid: Grid, read_left: Callable[[pa.Scalar], np.ndarray], read_right: Callable[[pa.Scalar], np.ndarray]) -> DataFrame:
    """Tiles (bi, bj, z) of the product of tiles (r, k, tile) and (k, r, tile), r being the output's row or column.

    Tiles of the left are copied along a row of the grid and those of the right along
    a column, so a task meets all it needs for its own output tiles and adds them up
    itself; partial sums are shuffled only where the grid cuts the inner dimension.
    z is packed().
    """
    part = F.pmod("k", F.lit(grid.inner))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("g")
    cell = lambda row, col: ((row * grid.cols + col) * grid.inner + part).cast("int").alias("cell")
    copied = left.select("r", "k", "tile", every(grid.cols)).select(cell(F.pmod("r", F.lit(grid.rows)), F.col("g")), "k", F.lit(0).alias("of"), "r", "tile")
    copied = copied.unionByName(right.select("r", "k", "tile", every(grid.rows)).select(cell(F.col("g"), F.pmod("r", F.lit(grid.cols))), "k", F.lit(1).alias("of"), "r", "tile"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        # the left tiles of the inner index at hand: their rows, themselves, and all on top of one another
        at, rows, held, stack, cuts = None, [], [], np.zeros((0, 0)), []

        def out() -> Iterator[pa.RecordBatch]:
            while sums:
                (i, j), z = sums.popitem()
                yield pa.RecordBatch.from_pydict({"bi": pa.array([i], pa.int64()), "bj": pa.array([j], pa.int64()), "z": pa.array([packed(z)], pa.binary())})

        for batch in batches:
            for here, k, of, r, tile in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                if at is None or at[0] != here:
                    yield from out()
                if at != (here, k):
                    at, rows, held = (here, k), [], []
                if not of:
                    rows.append(r)
                    held.append(read_left(tile))
                elif rows:
                    if held:
                        cuts = np.cumsum([len(x) for x in held])[:-1]
                        stack, held = np.concatenate(held), []
                    for i, z in zip(rows, np.split(stack @ read_right(tile), cuts), strict=True):
                        if (i, r) in sums:
                            sums[i, r] += z
                        else:
                            sums[i, r] = z.copy()
        yield from out()

    tiled = by_partition(copied, "cell", grid.tasks).sortWithinPartitions("cell", "k", "of", "r").mapInArrow(multiply, "bi bigint, bj bigint, z binary")
    return summed_tiles(tiled) if grid.inner > 1 else tiled


def summed_tiles(tiles: DataFrame) -> DataFrame:
    """(bi, bj, z): tiles of one place added up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"bi": pa.array([at[0]], pa.int64()), "bj": pa.array([at[1]], pa.int64()), "z": pa.array([packed(held)], pa.binary())})

        for batch in batches:
            for bi, bj, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if at == (bi, bj):
                    held += unpacked(z.as_py())
                else:
                    if at is not None:
                        yield out()
                    at, held = (bi, bj), unpacked(z.as_py()).copy()
        if at is not None:
            yield out()

    return tiles.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(add, "bi bigint, bj bigint, z binary")


def tiled_gemm(a: DataFrame, b: DataFrame, side: int = 64, grid: Grid | None = None) -> DataFrame:
    """a * b as coordinates without zeros, by numpy on side x side tiles; the grid follows from the numbers of tiles unless one is given."""
    left = tiles(a, side).select(F.col("bi").alias("r"), F.col("bj").alias("k"), F.col("cells").alias("tile"))
    right = tiles(b, side).select(F.col("bj").alias("r"), F.col("bi").alias("k"), F.col("cells").alias("tile"))
    if grid is None:
        far = lambda m, c: F.max(F.floor(F.col(c) / side)).alias(m)
        bi, ka = a.agg(far("x", "i"), far("y", "j")).first()
        kb, bj = b.agg(far("x", "i"), far("y", "j")).first()
        grid = Grid(1, 1, 1) if None in (bi, bj) else grid_for(bi + 1, bj + 1, max(ka, kb) + 1, tasks_of(a.sparkSession), side)

    def dense(cells: pa.ListScalar) -> np.ndarray:
        out = np.zeros(side * side)
        place, value = cells.values.flatten()
        out[np.asarray(place)] = np.asarray(value)
        return out.reshape(side, side)

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                z = unpacked(z.as_py())
                i, j = np.nonzero(z)
                yield pa.RecordBatch.from_arrays([pa.array(bi * side + i), pa.array(bj * side + j), pa.array(z[i, j])], names=["i", "j", "v"])

    return grid_product(left, right, grid, dense, dense).mapInArrow(cells_of, "i bigint, j bigint, v double")


def flops(n: int) -> int:
    """Floating point operations of an n x n product."""
    return 2 * n**3
