"""Barrier mini-batches, products on a grid, networks and filters as numpy blocks, images as tiles."""

from __future__ import annotations

import itertools
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import permutation
from pixelloom.operators import cnn, dataset, linalg, mlp, pixels, rasters, training
from pixelloom.operators.ordering import by_partition


# mini-batches over several tasks


def trained(spark, ranks, size=10, momentum=0.9, biases=True, rows=64, epochs=2, parts=5):
    rng = np.random.default_rng(3)
    x, t = rng.random((rows, 6)), rng.random((rows, 3))
    df = spark.createDataFrame([(int(i), x[i].tolist(), t[i].tolist()) for i in rng.permutation(rows)], "pos long, data array<double>, target array<double>").repartition(parts)
    model, rule = mlp.MLP.random([6, 9, 3], "sigmoid", 2), training.Optimiser(0.4, momentum, 0.1, biases)
    for _ in range(epochs):
        training.train_epoch(df, model, rule, size, ranks=ranks)
    return [*model.weights, *model.biases, *(rule.velocity[k] for k in sorted(rule.velocity))]


@pytest.mark.parametrize(("size", "momentum", "biases"), [(10, 0.9, True), (64, 0.0, False), (7, 0.5, False), (1, 0.0, True)])
def test_ranks_share_each_batch(spark, size, momentum, biases):
    """Whatever the number of tasks, the weights and velocities of one."""
    one = trained(spark, 1, size, momentum, biases, epochs=1 if size == 1 else 2)
    for ranks in (2, 4):
        many = trained(spark, ranks, size, momentum, biases, epochs=1 if size == 1 else 2)
        assert len(one) == len(many)
        assert all(np.allclose(a, b, atol=1e-9, rtol=0) for a, b in zip(one, many, strict=True))


def test_ranks_without_rows(spark):
    """More ranks than rows, an empty table, and places that are missing."""
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(trained(spark, 4, 2, rows=3), trained(spark, 1, 2, rows=3), strict=True))
    schema = "pos long, data array<double>, target array<double>"
    model = mlp.MLP.random([2, 1], "sigmoid", 0)
    before = model.weights[0].copy()
    training.train_epoch(spark.createDataFrame([], schema), model, training.Optimiser(0.5), 4, ranks=4)
    assert np.array_equal(model.weights[0], before)
    far = spark.createDataFrame([(0, [1.0, 2.0], [1.0]), (9, [2.0, 1.0], [0.0])], schema)
    own = mlp.MLP([2, 1], ["sigmoid"], [before.copy()], model.biases)
    training.train_epoch(far, model, training.Optimiser(0.5), 2, ranks=3)
    for x, t in (([[1.0, 2.0]], [[1.0]]), ([[2.0, 1.0]], [[0.0]])):
        training.Optimiser(0.5).apply(own, *own.backward(np.array(x), np.array(t))[:2], 1)
    assert np.allclose(own.weights[0], model.weights[0], atol=1e-12)


LOST = """
import os
import sys
import numpy as np
from pyspark import BarrierTaskContext
from pyspark.sql import SparkSession
from pixelloom.operators import mlp, training

marker = sys.argv[1]


class Fails(training.Optimiser):
    def apply(self, model, grads, biases, rows):
        if self.epoch == 1 and BarrierTaskContext.get().partitionId() == 1 and not os.path.exists(marker):
            open(marker, "w").close()
            raise RuntimeError("lost on purpose")
        super().apply(model, grads, biases, rows)

spark = SparkSession.builder.master("local[4,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
rng = np.random.default_rng(0)
x, t = rng.random((40, 5)), rng.random((40, 2))
df = spark.createDataFrame([(i, x[i].tolist(), t[i].tolist()) for i in range(40)], "pos long, data array<double>, target array<double>")
found = []
for rule, ranks in ((training.Optimiser(0.4, 0.9), 1), (Fails(0.4, 0.9), 3)):
    model = mlp.MLP.random([5, 4, 2], "sigmoid", 1)
    for _ in range(2):
        training.train_epoch(df, model, rule, 8, ranks=ranks)
    found.append(model.weights)
assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(*found, strict=True))
print("equal weights")
"""


def test_a_lost_rank_repeats_the_stage(tmp_path):
    """A task that fails in the middle of an epoch changes nothing; in a session of its own, whose tasks may be tried again."""
    (tmp_path / "lost.py").write_text(LOST)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ran = subprocess.run([sys.executable, str(tmp_path / "lost.py"), str(tmp_path / "marker")], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": top})
    assert "equal weights" in ran.stdout, ran.stderr[-2000:]
    assert (tmp_path / "marker").exists()


def test_ranks_and_workers(spark):
    df = spark.createDataFrame([(0, [1.0], [1.0])], "pos long, data array<double>, target array<double>")
    model = mlp.MLP.random([1, 1], "sigmoid", 0)
    for how in ({"ranks": 0}, {"ranks": 2, "workers": 2}, {"workers": 0}):
        with pytest.raises(ValueError):
            training.train_epoch(df, model, training.Optimiser(), 1, **how)
    assert training.default_ranks(df, 16) == 1
    assert training.default_ranks(df, 4096) == spark.sparkContext.defaultParallelism


def test_networks_train_over_ranks(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.random(36).tolist(), [float(i % 2)]) for i in range(24)]
    df = spark.createDataFrame(rows, "pos long, data array<double>, target array<double>")
    found = []
    for ranks in (1, 3):
        model = cnn.CNNModel.random("6 6 sigmoid convolution 2 3 3 pooling max 2 2", [1], 4)
        training.train_epoch(df, model, training.Optimiser(0.1, 0.5), 8, ranks=ranks)
        found.append(model.weights)
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(*found, strict=True))


# products on a grid


def coordinates(spark, a):
    rows = [(int(i), int(j), float(a[i, j])) for i, j in np.argwhere(a)]
    return spark.createDataFrame(rows, "i long, j long, v double")


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        assert out[r.i, r.j] == 0
        out[r.i, r.j] = r.v
    return out


@pytest.mark.parametrize("grid", [None, *itertools.product((1, 2), (1, 3), (1, 2))])
def test_every_grid_gives_the_product(spark, grid):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-3, 4, (21, 13)), rng.integers(-3, 4, (13, 18))
    a[5:9] = 0
    got = linalg.tiled_gemm(coordinates(spark, a), coordinates(spark, b), 4, linalg.Grid(*grid) if grid else None)
    assert (dense(got, (21, 18)) == a @ b).all()


def test_empty_products(spark):
    one, none = coordinates(spark, np.ones((2, 2))), coordinates(spark, np.zeros((2, 2)))
    for a, b in ((one, none), (none, one), (none, none)):
        assert not linalg.tiled_gemm(a, b, 2).count()
        assert not linalg.gemm(a, b).count()
    apart = spark.createDataFrame([(0, 9, 1.0)], "i long, j long, v double")
    assert not linalg.tiled_gemm(one, apart.select("i", "j", "v").filter("i > 5"), 2).count()


def test_grids():
    """All tasks are busy as far as there are tiles, a task's output is bounded, and the inner dimension is cut only where rows and columns are too few."""
    for bi, bj, k, tasks in ((64, 64, 1, 8), (1000, 1, 1, 200), (1, 1, 5000, 64), (3, 5, 7, 1000), (1, 1, 1, 8), (10_000, 10_000, 100, 64), (2, 2, 300, 16)):
        g = linalg.grid_for(bi, bj, k, tasks)
        assert 2 * g.tasks > min(tasks, bi * bj * k) and g.held(bi, bj) <= linalg.TILES_HELD // 64**2
        if bi * bj >= tasks and bi >= 2 * tasks:
            assert g.inner == 1
    assert linalg.grid_for(1, 1, 5000, 64) == linalg.Grid(1, 1, 64)
    assert linalg.grid_for(64, 64, 1, 8).tasks == 8


def test_a_tall_by_wide_product_uses_all_tasks(spark):
    """An inner size of one tile: the products lie in as many partitions as the grid has, and each tile is copied along its row or column only."""
    n, side = 256, 8
    tall = spark.range(n).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(1.0).alias("v"))
    wide = spark.range(n).select(F.lit(0).cast("long").alias("i"), F.col("id").alias("j"), F.lit(2.0).alias("v"))
    got = linalg.tiled_gemm(tall, wide, side)
    counts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    assert len(counts) >= tasks and sum(counts) == n * n and max(counts) <= n * n // len(counts) * 2
    g = linalg.grid_for(n // side, n // side, 1, tasks)
    assert g.moved(n // side, n // side, 1) == n // side * (g.rows + g.cols)


def test_each_number_has_its_partition(spark):
    for n in (1, 3, 8, 37):
        df = by_partition(spark.range(5 * n).select((F.col("id") % n).alias("k")), "k", n)
        rows = df.select("k", F.spark_partition_id().alias("p")).distinct().collect()
        assert len({r.p for r in rows}) == len({r.k for r in rows}) == len(rows) == n


def test_hot_inner_indices_are_dealt_out(spark, monkeypatch):
    rng = np.random.default_rng(5)
    a, b = (rng.random((40, 6)) < 0.2) * rng.integers(1, 5, (40, 6)), (rng.random((6, 30)) < 0.2) * rng.integers(1, 5, (6, 30))
    a[:, 2], b[2] = 3, 2
    plain = dense(linalg.gemm(coordinates(spark, a), coordinates(spark, b)), (40, 30))
    monkeypatch.setattr(linalg, "HOT", 500)
    monkeypatch.setattr(linalg, "HOT_SIDE", 8)
    left, right, on = linalg.dealt_out(coordinates(spark, a).toDF("i", "k", "x"), coordinates(spark, b).toDF("k", "j", "y"))
    assert on == ["k", "s", "t"]
    worst = left.join(right, on).groupBy(*on).count().agg(F.max("count")).first()[0]
    assert worst < 40 * 30 / 4
    assert (dense(linalg.gemm(coordinates(spark, a), coordinates(spark, b)), (40, 30)) == plain).all() and (plain == a @ b).all()


# networks as blocks


@pytest.mark.parametrize("text", ["9 11 sigmoid convolution 2 3 2 pooling max 2 3 convolution 3 2 2 pooling avg 2 2", "9 11 leakyRelu pooling max 5 1 convolution 1 1 4", "9 11 identity pooling avg 3 4"])
def test_blocks_are_the_expressions(spark, text, monkeypatch):
    net = cnn.CNN.from_text(text).randomise(3)
    rng = np.random.default_rng(0)
    rows = [(i, (rng.random(99) - 0.5).tolist(), "x") for i in range(7)]
    df = spark.createDataFrame(rows, "id int, data array<double>, features string")
    want = {r.id: r.features for r in cnn.forward(df, net).collect()}
    # slices of a row, and windows of one
    for cells, numbers in ((cnn.WINDOW_CELLS, cnn.BLOCK_NUMBERS), (1, 1)):
        monkeypatch.setattr(cnn, "WINDOW_CELLS", cells)
        monkeypatch.setattr(cnn, "BLOCK_NUMBERS", numbers)
        got = cnn.forward_blocks(df, net)
        assert got.columns == ["id", "data", "features"]
        assert all(np.allclose(r.features, want[r.id], atol=1e-12) for r in got.collect())
    assert not cnn.forward_blocks(df.limit(0), net).count()


def test_running_max():
    rng = np.random.default_rng(2)
    for n, window, axis in itertools.product((1, 5, 12, 13), (1, 2, 5, 12), (0, 1)):
        a = rng.integers(-9, 9, (n, n)).astype(float)
        if window <= n:
            want = np.lib.stride_tricks.sliding_window_view(a, window, axis=axis).max(axis=-1)
            assert (cnn.running_max(a, window, axis) == want).all()


def test_many_branches(spark):
    """Three layers of eight filters: 512 branches without as many expressions."""
    net = cnn.CNN.from_text("12 12 relu convolution 8 3 3 convolution 8 3 3 convolution 8 3 3").randomise(0)
    df = spark.createDataFrame([(0, [0.5] * 144)], "id int, data array<double>")
    out = cnn.forward_blocks(df, net)
    assert len(out.first().features) == 512 * 36
    assert len(out._jdf.queryExecution().toString()) < 20_000


# filters as blocks and tiles


def pictures(spark, sizes, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k, (w, h) in enumerate(sizes):
        px = rng.integers(0, 256, w * h)
        px[: w * h // 3] = (0, 255, 128)[k % 3]
        rows.append((k, w, h, px.tolist(), "more"))
    return spark.createDataFrame(rows, "sample_id long, width int, height int, px array<int>, note string")


@pytest.mark.parametrize("name", ["filter", "edges"])
def test_blocks_filter_as_expressions_do(spark, name):
    df = pictures(spark, [(23, 17), (23, 17), (11, 11), (5, 4), (1, 1), (40, 2)])
    got = {r.sample_id: r for r in rasters.filtered(df, name).collect()}
    assert set(rasters.filtered(df, name).columns) == set(df.columns)
    step = pixels.TRANSFORMS[name]
    for r in df.select("sample_id", "width", "height").collect():
        one = df.filter(F.col("sample_id") == r.sample_id)
        assert got[r.sample_id].px == one.select(step(F.col("px"), r.width, r.height)[0]).first()[0]
    with pytest.raises(ValueError):
        rasters.filtered(df, "resize")


@pytest.mark.parametrize("name", ["filter", "edges"])
def test_tiles_give_the_whole_image(spark, name):
    df = pictures(spark, [(53, 37), (16, 16), (7, 61), (3, 3)], 4)
    want = {str(r.sample_id): r.px for r in rasters.filtered(df, name).collect()}
    for side in (2, 3, 5, 16, 64):
        tiles = rasters.cut(df, side)
        assert tiles.agg(F.max(F.size("px"))).first()[0] <= side * side
        got = {r.image: r.px for r in rasters.put_together(rasters.filtered_tiles(tiles, side, name), side).collect()}
        assert got == want
    assert not rasters.filtered_tiles(rasters.cut(df.limit(0), 8), 8, name).count()


def test_large_files_are_read_by_strips(spark, tmp_path):
    rng = np.random.default_rng(1)
    a, deep = rng.integers(0, 256, (70, 45)), rng.integers(0, 1001, (9, 20))
    (tmp_path / "a.pgm").write_bytes(b"P5\n# made here\n45 70\n255\n" + a.astype(np.uint8).tobytes())
    (tmp_path / "b.pgm").write_bytes(b"P5 20 9 1000\n" + deep.astype(">u2").tobytes())
    tiles = rasters.scan_tiles(spark, [str(tmp_path / "a.pgm"), f"file://{tmp_path}/b.pgm"], 16)
    got = {r.image.rsplit("/", 1)[1]: np.array(r.px).reshape(r.height, r.width) for r in rasters.put_together(tiles, 16).collect()}
    assert (got["a.pgm"] == a).all() and (got["b.pgm"] == deep * 255 // 1000).all()
    (tmp_path / "c.pgm").write_bytes(b"P6 1 1 255\nabc")
    with pytest.raises(ValueError):
        rasters.scan_tiles(spark, [str(tmp_path / "c.pgm")], 16)


# shuffles by a bijection


def plain_permutation(place, n, seed):
    a, b = permutation.grid_of(n)
    ks = permutation.keys(seed)
    mix = lambda x, k: (((x + k) ** 2) % permutation.MODULUS * permutation.FACTOR + k) % permutation.MODULUS
    while True:
        left, right = divmod(place, b)
        for i in range(0, len(ks), 2):
            left = (left + mix(right, ks[i])) % a
            right = (right + mix(left, ks[i + 1])) % b
        place = left * b + right
        if place < n:
            return place


def test_permutations(spark):
    """For every n up to 300 and some beyond: a bijection, as the plain loop has it, within the passes that are allowed."""
    sizes = [*range(1, 300, 7), 2, 3, 4, 5, 101, 4096, 5003]
    for n in sizes:
        assert sorted(plain_permutation(p, n, 5) for p in range(n)) == list(range(n))
    for n in (1, 2, 3, 17, 1000, 4099):
        df = spark.range(n).select(F.col("id").alias("pos"), F.lit("x").alias("more"))
        got = {r.old: r.pos for r in dataset.permuted(df.withColumn("old", F.col("pos")), 5).collect()}
        assert got == {p: plain_permutation(p, n, 5) for p in range(n)}
    far = 10**12 + 7
    rows = spark.range(2000).select((F.col("id") * 499_999_937 % far).alias("pos")).select("pos", permutation.permuted(F.col("pos"), far, 1).alias("to")).collect()
    assert all(r.to == plain_permutation(r.pos, far, 1) for r in rows) and len({r.to for r in rows}) == len({r.pos for r in rows})
    assert not dataset.permuted(spark.range(0).select(F.col("id").alias("pos")), 5).count()
    with pytest.raises(Exception, match="not a place"):
        spark.range(3).select(permutation.permuted(F.col("id"), 2, 0)).collect()


def test_permutations_mix(spark):
    """Seeds differ, neighbours part, and no sort or shuffle is in the plan."""
    n = 10_000
    df = spark.range(n).select(F.col("id").alias("pos"))
    one, two = (dataset.permuted(df.withColumn("old", F.col("pos")), s, n, 64) for s in (1, 2))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    a, b = (np.array([r.pos for r in d.orderBy("old").collect()]) for d in (one, two))
    assert (a == b).mean() < 0.01
    for x in (a, b):
        assert np.abs(np.corrcoef(np.arange(n), x)[0, 1]) < 0.05 and np.abs(np.diff(x)).mean() > n / 4
