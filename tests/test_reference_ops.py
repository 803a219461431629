"""Goldens, involutions, errors and round trips of the image, tensor and network operators."""

from __future__ import annotations

import os
import struct
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelloom import program, session
from pixelloom.functions import activation as af
from pixelloom.functions.binding import let
from pixelloom.operators import cnn, dataset, evaluate, linalg, mlp, ordering, pixels, training
from pixelloom.sources import files, images
from pixelloom.streaming import scoring

IN6 = np.array([[1, 2, 1, 1, 4, 1], [2, 1, 1, 2, 2, 1], [4, 3, 2, 1, 2, 1], [1, 5, 1, 1, 2, 1], [2, 1, 1, 4, 1, 1], [2, 1, 4, 2, 4, 1]], float)
IN6B = IN6.copy()
IN6B[0, 0] = 100
F1, F2 = np.array([[2, 1], [0.5, 1.5]]), np.array([[2, 1], [0, 1]])


@pytest.fixture(scope="module")
def six(spark):
    return spark.createDataFrame([(0, IN6.ravel().tolist()), (1, IN6B.ravel().tolist())], "sample_id long, data array<double>").repartition(1).sortWithinPartitions("sample_id")


def one(spark, column, **columns):
    """The value of a column expression over one row of the given values."""
    kinds = {"px": "array<int>", "data": "array<double>", "b": "array<double>", "x": "double"}
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {kinds[k]}" for k in columns))
    return df.select(column.alias("out")).first().out


def seen(df, column, shape):
    return [np.array(r[0]).reshape(shape) for r in df.orderBy("sample_id").select(column).collect()]


# images


def test_histogram(spark):
    df = spark.createDataFrame([([0, 255, 0, 1, 0, 255],)], "px array<int>")
    assert {r.px: r.n for r in pixels.histogram(df).collect()} == {0: 3, 1: 1, 255: 2}
    dense = df.select(pixels.dense_histogram(F.col("px"))).first()[0]
    assert dense[0] == 3 and dense[1] == 1 and dense[255] == 2 and sum(dense) == 6 and len(dense) == 256


PX = st.lists(st.integers(0, 255), min_size=64, max_size=64)


@settings(max_examples=8, deadline=None)
@given(PX)
def test_pixel_laws(spark, px):
    c = F.col("px")
    r = spark.createDataFrame([(px,)], "px array<int>").select(
        pixels.invert(pixels.invert(c)).alias("twice"),
        pixels.binary_scale(c).alias("once"),
        pixels.binary_scale(pixels.binary_scale(c)).alias("again"),
        pixels.equalise(c).alias("eq"),
        pixels.dense_histogram(c).alias("h"),
        pixels.binary_scale_by_median(c).alias("med"),
        pixels.restriction(c, 32).alias("restricted"),
        pixels.edges(c, 8, 8).alias("edges"),
    ).first()
    a = np.array(px)
    assert r.twice == px and r.once == r.again == np.where(a <= 127, 0, 255).tolist()
    share = (a[None, :] <= a[:, None]).mean(axis=1)
    assert r.eq == np.floor(share * 255 + 0.5).astype(int).tolist()
    assert r.h == np.bincount(a, minlength=256).tolist()
    cum = np.cumsum(np.bincount(a, minlength=256)) / 64
    cap = next((i for i in range(255) if cum[i] >= 0.5), 254)
    assert r.med == np.where(a <= cap, 0, 255).tolist()
    assert r.restricted == (a - a % 33).tolist()
    g = a.reshape(8, 8)
    want = np.zeros((8, 8), int)
    for y in range(1, 7):
        for x in range(1, 7):
            w = g[y - 1 : y + 2, x - 1 : x + 2]
            gx = (w * [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]).sum()
            gy = (w * [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]).sum()
            want[y, x] = 255 * (abs(gx) + abs(gy) >= 50)
    assert r.edges == want.ravel().tolist()


@pytest.mark.parametrize("mode", ["bilinear", "distance"])
@pytest.mark.parametrize(("w", "h"), [(10, 10), (10, 25), (1, 1), (60, 3)])
def test_resize(spark, mode, w, h):
    px = np.random.default_rng(0).integers(0, 256, 2500).tolist()
    got = one(spark, pixels.resize(F.col("px"), 50, 50, w, h, mode), px=px)
    assert len(got) == w * h and all(0 <= v <= 255 for v in got)
    assert got[0] == px[0]


@pytest.mark.parametrize(("w", "h"), [(0, 5), (5, 0), (0, 0)])
def test_resize_to_nothing(w, h):
    with pytest.raises(ValueError):
        pixels.resize(F.lit(None), 50, 50, w, h)


def test_crop(spark):
    assert one(spark, pixels.crop(F.col("px"), 4, 3, 2, 2, 1, 1), px=list(range(12))) == [5, 6, 9, 10]
    for bad in ((0, 1, 0, 0), (5, 1, 0, 0), (1, 1, 4, 0), (1, 4, 0, 0), (1, 1, -1, 0)):
        with pytest.raises(ValueError):
            pixels.crop(F.lit(None), 4, 3, *bad)


def test_difference_of_sizes(spark):
    df = spark.createDataFrame([([0, 255, 10, 20], [255, 0, 0, 5, 5, 5])], "a array<int>, b array<int>")
    assert df.select(pixels.difference(F.col("a"), 2, 2, F.col("b"), 3, 2)).first()[0] == pytest.approx((255 + 255 + 5 + 15) / 255)


def test_blur_in_place(spark):
    px = np.random.default_rng(0).integers(0, 256, 15 * 13).tolist()
    df = spark.createDataFrame([(1, 15, 13, px)], "sample_id long, width int, height int, px array<int>")
    got = np.array(pixels.blur_in_place(df).first().px).reshape(13, 15)
    assert (got[:5] == 0).all() and (got[:, :5] == 0).all() and (got[5:8, 5:10] > 0).all()
    first = (np.array(px).reshape(13, 15)[:11, :11] * pixels.blur_kernel()).sum()
    assert got[5, 5] == int(first)
    out = np.array(one(spark, pixels.blur(F.col("px"), 15, 13), px=px)).reshape(13, 15)
    assert out[5, 5] == int(first) and (out[-5:] == 0).all()


def test_engine_and_its_file(spark, tmp_path):
    engine = pixels.TransformEngine("inversion").add(("crop", 4, 4, 1, 1)).insert(0, "binaryscale")
    files.save_transforms(engine, str(tmp_path / "t"))
    assert files.load_transforms(str(tmp_path / "t")).steps == engine.steps == [("binaryscale",), ("inversion",), ("crop", 4, 4, 1, 1)]
    df = spark.createDataFrame([(8, 8, list(range(0, 256, 4)))], "width int, height int, px array<int>")
    r = engine.apply(df, 8, 8).first()
    assert (r.width, r.height, len(r.px), set(r.px)) == (4, 4, 16, {0, 255})
    pipe = pixels.TransformationPipeline(6, 6, pixels.TransformEngine("inversion"), pixels.TransformEngine("binaryscale"))
    assert len(pipe.apply(df, 8, 8).first().px) == 36
    with pytest.raises(ValueError):
        pixels.TransformEngine("blurr")
    (tmp_path / "bad").write_text("nothing\n")
    with pytest.raises(ValueError):
        files.load_transforms(str(tmp_path / "bad"))


def test_png_tree(spark, tmp_path):
    n = images.noise(spark, 6, 12, 9, 3)
    for split in ("train", "eval"):
        for k, name in enumerate(("benign", "malign")):
            assert images.write_png(n.filter(F.col("sample_id") % 2 == k), str(tmp_path / split / name)) == 3
    want = {str(r.sample_id): r.px for r in n.collect()}
    found = images.load_collection(spark, str(tmp_path)).collect()
    assert len(found) == 12 and {r.class_id for r in found} == {0, 1}
    for r in found:
        assert (r.width, r.height, r.px) == (12, 9, want[r.path.rsplit("/", 1)[1][:-4]])
        assert r.class_name == ("benign", "malign")[r.class_id]
    flat = images.load(spark, str(tmp_path / "train"), with_classes=False).collect()
    assert sorted(r.sample_id for r in flat) == list(range(6)) and {r.class_id for r in flat} == {-1}
    assert images.load_directory(spark, str(tmp_path / "train/benign")).count() == 3
    assert images.info(spark, str(tmp_path / "train/benign")).first()[1:] == (12, 9, 1)
    assert images.load_with_classes(spark, str(tmp_path / "train"), cap=2).count() == 4
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match=r"no images|PATH|path"):
        images.load_directory(spark, str(tmp_path / "none"))


def test_pnm_and_tga(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P5\n# c\n3 2\n255\n" + bytes(range(6)))
    (tmp_path / "b.ppm").write_bytes(b"P3 1 1 255 10 20 30\n")
    (tmp_path / "c.tga").write_bytes(bytes([0, 0, 2, *[0] * 9, 1, 0, 2, 0, 24, 0x20, 30, 20, 10, 0, 0, 0]))
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.px) for r in images.scan_other(spark, str(tmp_path)).collect()}
    gray = (77 * 10 + 150 * 20 + 29 * 30) >> 8
    assert got == {"a.pgm": (3, 2, list(range(6))), "b.ppm": (1, 1, [gray]), "c.tga": (1, 2, [gray, 0])}


def test_other_formats():
    gray = (77 * 10 + 150 * 20 + 29 * 30) >> 8
    head = lambda kind, bits: bytes([0, 0, kind, *[0] * 9, 5, 0, 1, 0, bits, 0x20])
    assert images.decode_tga(head(10, 24) + bytes([0x82, 30, 20, 10, 0x01, 0, 0, 0, 30, 20, 10]))[2].tolist() == [gray] * 3 + [0, gray]
    assert images.decode_tga(head(3, 8) + bytes([1, 2, 3, 4, 5]))[2].tolist() == [1, 2, 3, 4, 5]
    top = b"8BPS" + struct.pack(">H6xHIIHH", 1, 3, 2, 3, 8, 3) + struct.pack(">III", 0, 0, 0)
    plain = top + struct.pack(">H", 0) + bytes([10] * 6 + [20] * 6 + [30] * 6)
    packed = top + struct.pack(">H", 1) + struct.pack(">6H", *[2] * 6) + bytes([254, 10] * 2 + [2, 20, 20, 20] * 2 + [128, 254, 30, 254, 30])
    for raw in (plain, packed):
        w, h, px = images.decode_psd(raw)
        assert (w, h, px.tolist()) == (3, 2, [gray] * 6)
    light = b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y 1 +X 8\n"
    flat = light.replace(b"X 8", b"X 2") + bytes([128, 128, 128, 129, 0, 0, 0, 0])
    runs = light + bytes([2, 2, 0, 8] + [136, 128] * 3 + [8, 129, 0, 129, 129, 129, 129, 129, 129])
    assert images.decode_hdr(flat)[2].tolist() == [255, 0]
    assert images.decode_hdr(runs)[2].tolist() == [255, 0] + [255] * 6
    for decode in (images.decode_pnm, images.decode_tga, images.decode_psd, images.decode_hdr):
        with pytest.raises(ValueError):
            decode(b"no image")


def test_rescaled(spark):
    assert one(spark, images.rescaled(F.col("data")), data=[0.0, 0.5, 1.0]) == [0, 127, 255]


# data sets


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 40), st.integers(1, 7))
def test_parts(spark, total, parts):
    got = [r[0] for r in spark.range(total).select(ordering.part_of(F.col("id"), total, parts)).collect()] if total else []
    assert got == [i for i, a in enumerate(np.array_split(np.arange(total), parts)) for _ in a]


def test_positions(spark):
    rows = [(int(v),) for v in np.random.default_rng(0).permutation(1000)]
    got = ordering.with_position(spark.createDataFrame(rows, "k long"), F.col("k").desc()).collect()
    assert all(r.pos == 999 - r.k for r in got)
    assert ordering.with_position(spark.createDataFrame([], "k long"), "k").collect() == []


def test_tensors(spark):
    df = dataset.batched(spark.range(23).withColumnRenamed("id", "sample_id"), 5, "sample_id")
    assert [r["count"] for r in df.groupBy("tensor_id").count().orderBy("tensor_id").collect()] == [5, 5, 5, 5, 3]
    left = dataset.without_tensors(df, 1, 3).orderBy("pos").collect()
    assert [r.sample_id for r in left] == [*range(5), *range(15, 23)] and [r.pos for r in left] == list(range(13))
    assert [r.tensor_id for r in left] == [0] * 5 + [1] * 5 + [2] * 3
    for bad in ((2, 2), (3, 1), (4, 6)):
        with pytest.raises(ValueError):
            dataset.without_tensors(df, *bad)
    a, b = (dataset.shuffled(df, 3, size=4).orderBy("pos").collect() for _ in range(2))
    assert a == b and sorted(r.sample_id for r in a) == list(range(23)) != [r.sample_id for r in a]


def test_collections(spark):
    a = spark.createDataFrame([(0, 0), (1, 1)], "sample_id long, class_id long")
    assert dataset.train_eval(a, a).count() == 4
    with pytest.raises(ValueError):
        dataset.train_eval(a, a.limit(1))
    sized = a.withColumns({"n_rows": F.lit(2), "n_cols": F.lit(2), "pos": F.col("sample_id")})
    assert sorted(r.pos for r in dataset.appended(sized, sized).collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        dataset.appended(sized, sized.withColumn("n_rows", F.lit(3)))
    assert one(spark, dataset.one_hot(F.lit(-1), 3), x=0.0) == [0, 0, 0]


# linear algebra


def test_small_products(spark):
    a = F.col("data")
    assert one(spark, linalg.product(a, (2, 2), a, (2, 2)), data=[1.0, 2.0, 1.0, 2.0]) == [3, 6, 3, 6]
    with pytest.raises(ValueError):
        linalg.product(a, (2, 3), a, (2, 3))
    assert one(spark, linalg.total(a), data=[]) is None
    assert one(spark, linalg.absolute_total(a), data=[-1.0, 2.0]) == 3
    assert one(spark, linalg.argmax_absolute(a), data=[1.0, -5.0, 5.0]) == 1
    assert one(spark, linalg.argmax(a), data=[1.0, -5.0, 5.0]) == 2
    assert one(spark, linalg.filled(2, 2, 3.0), x=0.0) == [3] * 4
    noise = np.array(one(spark, linalg.random(5, 7, -2, 2, 1, F.lit(0), 1), x=0.0)).reshape(5, 7)
    assert (noise[0] == 0).all() and (noise[:, -1] == 0).all() and (np.abs(noise[1:-1, 1:-1]) > 0).all() and np.abs(noise).max() <= 2


@pytest.mark.parametrize("ta", [False, True])
@pytest.mark.parametrize("tb", [False, True])
def test_products(spark, ta, tb):
    rng = np.random.default_rng(1)
    a, b, c = rng.normal(size=(2, 3) if ta else (3, 2)), rng.normal(size=(4, 2) if tb else (2, 4)), rng.normal(size=(3, 4))
    want = 3 * (a.T if ta else a) @ (b.T if tb else b)

    def table(m):
        return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in np.ndindex(m.shape)], "i long, j long, v double")

    def dense(df):
        out = np.zeros((3, 4))
        for r in df.collect():
            out[r.i, r.j] = r.v
        return out

    assert dense(linalg.gemm(table(a), table(b), ta, tb, 3.0)) == pytest.approx(want)
    assert dense(linalg.gemm(table(a), table(b), ta, tb, 3.0, 2.0, table(c))) == pytest.approx(want + 2 * c)
    got = one(spark, linalg.product(F.col("data"), a.shape, F.col("b"), b.shape, ta, tb, 3.0), data=a.ravel().tolist(), b=b.ravel().tolist())
    assert np.array(got).reshape(3, 4) == pytest.approx(want)
    if not ta and not tb:
        assert dense(linalg.tiled_gemm(table(a), table(b), 2)) * 3 == pytest.approx(want)
        rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "i long, x array<double>")
        assert np.array([r.product for r in linalg.tall_product(rows, "x", b).orderBy("i").collect()]) * 3 == pytest.approx(want)


def test_block_bound(spark, monkeypatch):
    monkeypatch.setattr(linalg, "BLOCK_CELLS", 3)
    with pytest.raises(ValueError):
        linalg.tall_product(spark.createDataFrame([([1.0, 2.0],)], "x array<double>"), "x", np.ones((2, 2)))


def test_reshape(spark):
    df = spark.createDataFrame([(1, [1.0] * 6)], "sample_id long, data array<double>")
    assert linalg.reshaped(df, 2, 3).first().n_cols == 3
    with pytest.raises(Exception, match="reshape"):
        linalg.reshaped(df, 4, 3).collect()


# activation functions


@pytest.mark.parametrize("name", list(af.ACTIVATIONS))
def test_forms_agree(spark, name):
    x = [-3.0, -0.2, 0.0, 0.6, 1.1, 7.0]
    f = af.activation(name)
    assert one(spark, af.applied(F.col("data"), name), data=x) == pytest.approx(f.block(np.array(x)).tolist())
    assert one(spark, af.derived(F.col("data"), name), data=x) == pytest.approx(np.broadcast_to(f.block_derivative(np.array(x)), 6).tolist())


def test_unknown_function():
    with pytest.raises(ValueError):
        af.activation("tanh")


def test_let_computes_once(spark):
    assert one(spark, let(F.col("x") + 1, lambda v: v * v), x=2.0) == 9


# perceptrons


def ones(topology, function):
    m = mlp.MLP(topology, [function] * (len(topology) - 1))
    m.weights = [np.ones_like(w) for w in m.weights]
    m.biases = [np.ones_like(b) for b in m.biases]
    return m


def worked():
    return mlp.MLP([2, 2, 2], ["sigmoid"] * 2, [np.array([[0.15, 0.20], [0.25, 0.30]]), np.array([[0.40, 0.45], [0.50, 0.55]])], [np.array([0.35, 0.35]), np.array([0.60, 0.60])])


def test_goldens(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0])], "sample_id long, data array<double>")
    for m, want in ((ones([2, 2, 1], "square"), [361]), (ones([2, 4, 2, 3, 2], "relu"), [82, 82])):
        for score in (mlp.score_columns, mlp.score_blocks):
            assert score(df, m).first().output == want
        assert df.select(mlp.predicted(m, F.col("data"))).first()[0] == want
    m = worked()
    assert m.predict([0.05, 0.10])[0] == pytest.approx([0.751365, 0.772928], abs=1e-6)
    rows = spark.createDataFrame([([0.05, 0.10], [0.01, 0.99])] * 3, "data array<double>, target array<double>")
    training.train_epoch(rows, m, training.Optimiser(rate=0.5))
    assert m.weights[0].ravel() == pytest.approx([0.149781, 0.199561, 0.249751, 0.299502], abs=1e-6)
    assert m.weights[1].ravel() == pytest.approx([0.358916, 0.408666, 0.511301, 0.561370], abs=1e-6)
    assert (m.biases[0] == 0.35).all()
    with pytest.raises(ValueError):
        m.predict([1, 2, 3])


def test_gradient_is_that_of_differences(spark):
    rng = np.random.default_rng(0)
    m = mlp.MLP.random([3, 4, 2], "sigmoid", 5)
    x, t = rng.normal(size=(7, 3)), rng.random((7, 2))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, t, strict=True)], "data array<double>, target array<double>").repartition(3)
    grads, biases, rows = training.gradient(df, m)
    assert rows == 7

    def loss():
        return ((m.predict(x) - t) ** 2).sum() / 2

    for table, found in ((m.weights, grads), (m.biases, biases)):
        for w, g in zip(table, found, strict=True):
            for at in np.ndindex(w.shape):
                w[at] += 1e-6
                up = loss()
                w[at] -= 2e-6
                down = loss()
                w[at] += 1e-6
                assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_update_rules():
    def run(**how):
        m = mlp.MLP([1, 1], ["identity"])
        o = training.Optimiser(rate=0.1, **how)
        for _ in range(3):
            o.apply(m, [np.array([[1.0]])], [np.array([1.0])], 1)
            o.end_epoch()
        return -float(m.weights[0][0, 0]), -float(m.biases[0][0])

    assert run() == pytest.approx((0.3, 0))
    assert run(momentum=0.5) == pytest.approx((0.1 + 0.15 + 0.175, 0))
    assert run(decay=1.0) == pytest.approx((0.1 + 0.05 + 0.1 / 3, 0))
    assert run(momentum=0.5, decay=1.0) == pytest.approx((0.1 + 0.1 + (0.1 / 3 + 0.05), 0))
    assert run(train_biases=True) == pytest.approx((0.3, 0.3))


def test_training_learns(spark):
    rows = [(i, i % 2, [float(i % 2), 1.0 - i % 2]) for i in range(20)]
    df = ordering.with_position(training.with_target(spark.createDataFrame(rows, "sample_id long, class_id long, data array<double>"), 2), "sample_id").cache()
    m = mlp.MLP.random([2, 4, 2], "sigmoid", 1)
    history = training.train(df, df, m, training.Optimiser(rate=4.0, momentum=0.5), 2, 4, batch_size=7).collect()
    assert len(history) == 12 and history[-1].f1 == 1.0


def test_model_text(tmp_path):
    m = mlp.MLP.random_relu_sigmoid([3, 4, 5, 2], 1)
    assert m.activations == ["sigmoid", "leakyRelu", "sigmoid"]
    files.save_model(m, str(tmp_path / "m"))
    back = files.load_model(str(tmp_path / "m"))
    assert (back.topology, back.activations) == (m.topology, m.activations)
    for a, b in zip([*m.weights, *m.biases], [*back.weights, *back.biases], strict=True):
        assert (np.float32(a) == np.float32(b)).all()
    text = mlp.to_text(m)
    assert mlp.from_text(text.split("\n", 2)[2]).topology == m.topology
    for bad in (text.replace("#Biases", "#Other"), text.replace("sigmoid", "sigmoidal", 1), text.replace("#Topology\n3 4 5 2", "#Topology\n3 0 5 2"), text.rsplit("#Biases", 1)[0], text + "1\n", ""):
        with pytest.raises(ValueError):
            mlp.from_text(bad)
    assert mlp.topology_from("4,3,2") == [4, 3, 2]


def test_model_checks():
    for args in (([2], []), ([2, 0], ["relu"]), ([2, 2], []), ([2, 2], ["relux"]), ([2, 2], ["relu"], [np.ones((3, 2))])):
        with pytest.raises(ValueError):
            mlp.MLP(*args)


# convolution


def test_topology():
    net = cnn.CNN.from_text("6 6 relu convolution 2 2 2 convolution 2 2 2 pooling max 2 2")
    assert (len(net.layers), net.branches, net.output_size) == (3, 4, 36)
    for bad in ("6 6 relu conv 2 2 2", "6 6 relu pooling min 2 2", "6 6 relux", "6 6 relu pooling max 7 7"):
        with pytest.raises(ValueError):
            cnn.CNN.from_text(bad)
    with pytest.raises(ValueError):
        net.layers[2].set_filters(np.ones((1, 1, 2, 2)))


def test_filter_table(spark):
    text = "6 6 relu convolution 2 2 2 pooling avg 2 2 convolution 3 2 3"
    net = cnn.CNN.from_text(text).randomise(4)
    back = cnn.CNN.from_text(text).read(net.table(spark))
    assert all((a.filters == b.filters).all() for a, b in zip(net.layers, back.layers, strict=True) if a.filters is not None)


def test_average_pool(spark, six):
    got = seen(six.withColumn("o", cnn.avg_pool(F.col("data"), (6, 6), (3, 3))), "o", (4, 4))[0]
    assert got[0] == pytest.approx([1.89, 1.56, 1.78, 1.67], abs=0.01)
    back = np.array(one(spark, cnn.avg_pool_backward(F.col("data"), (6, 6), (3, 3)), data=[1.0] * 16)).reshape(6, 6)
    assert back[0] == pytest.approx([1 / 9, 2 / 9, 1 / 3, 1 / 3, 2 / 9, 1 / 9])


def test_network_golden(spark, six):
    net = cnn.CNN.from_text("6 6 relu convolution 2 2 2 convolution 2 2 2 pooling avg 2 2")
    net.layers[0].set_filters(np.array([[F1, F2]]))
    net.layers[1].set_filters(np.array([[F1, F2], [F1, F2]]))
    got = [r.features for r in cnn.forward(six, net).orderBy("sample_id").collect()]
    assert got[0][:4] == pytest.approx([41.75, 37.4375, 41.6875, 55.5]) and len(got[0]) == 36
    assert got[1][:2] == pytest.approx([140.75, 37.4375])
    with pytest.raises(ValueError):
        cnn.forward(six, cnn.CNN((6, 6), "relu"))


def test_convolution_goldens(spark, six):
    layer = cnn.Layer("convolution", (6, 6), (2, 2), 2, filters=np.zeros((2, 2, 2, 2)))
    layer.set_filters(np.array([[F1, np.ones((2, 2))], [np.full((2, 2), 2.0), np.full((2, 2), 4.0)]]))
    maps = cnn.forward_layer([F.col("data"), F.col("data")], layer, "identity")
    first = seen(six.withColumn("o", maps[0]), "o", (5, 5))
    assert first[0][0] == pytest.approx([6.5, 7, 6.5, 10, 11.5]) and first[1][0, 0] == pytest.approx(204.5)


def test_convolution_backward_golden(spark, six):
    """Errors of the eight maps are filled with 1 to 8, in the order branch, filter, input."""
    layer = cnn.Layer("convolution", (6, 6), (2, 2), 2, filters=np.array([[F1, np.ones((2, 2))], [np.full((2, 2), 2.0), np.full((2, 2), 4.0)]]))
    fills = [F.array_repeat(F.col("sample_id").cast("double") + 1 + 2 * k, 25) for k in range(4)]
    errors = [f"e{k}" for k in range(4)]
    df = six.withColumns({n: f for n, f in zip(errors, fills, strict=True)})
    grads = cnn.filter_gradients(df, ["data", "data"], errors, layer).reshape(4, 4)
    want = [[171, 64.5, 78, 69], [366, 150.5, 182, 161], [561, 236.5, 286, 253], [756, 322.5, 390, 345]]
    assert grads == pytest.approx(np.array(want), abs=0.01)
    back, _ = cnn.backward_layer([F.col("data")] * 2, [F.col(e) for e in errors], layer)
    got = seen(df.withColumn("o", back[0]), "o", (6, 6))[0] / 2
    assert got[0] == pytest.approx([2.5, 4.5, 4.5, 4.5, 4.5, 2])


def test_max_pool(spark):
    data = [1.0, 1.0, 0.0, 1.0, 5.0, 2.0, 0.0, 3.0, 5.0]
    places = cnn.max_pool_places(F.col("data"), (3, 3), (2, 2))
    assert one(spark, cnn.max_pool(F.col("data"), (3, 3), (2, 2)), data=data) == [5, 5, 5, 5]
    assert one(spark, places, data=data) == [4, 4, 4, 4]
    assert one(spark, cnn.max_pool_places(F.col("data"), (3, 3), (2, 2)), data=[1.0] * 9) == [0, 1, 3, 4]
    assert one(spark, cnn.max_pool_backward(F.col("b"), places, (3, 3), (2, 2)), data=data, b=[1.0, 2.0, 3.0, 4.0])[4] == 10


def test_network_learns(spark):
    rng = np.random.default_rng(0)
    rows = [((np.eye(4) if k % 2 else np.fliplr(np.eye(4))).ravel() + rng.normal(0, 0.05, 16), [float(k % 2), 1.0 - k % 2]) for k in range(8)]
    df = spark.createDataFrame([(i, x.tolist(), t) for i, (x, t) in enumerate(rows)], "sample_id long, data array<double>, target array<double>").coalesce(2).cache()
    model = cnn.CNNModel.random("4 4 relu convolution 2 2 2 pooling max 2 2", [2], 1)
    model.head.set_activation("sigmoid")

    def loss():
        return sum(sum((a - b) ** 2 for a, b in zip(r.output, r.target, strict=True)) for r in model.predict(df).collect())

    before, filters = loss(), model.net.layers[0].filters.copy()
    for _ in range(6):
        cnn.train_step(df, model.net, model.head, 1.0)
    assert loss() < before and not (filters == model.net.layers[0].filters).all()


# evaluation, metrics, streams


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=20))
def test_metrics(spark, pairs):
    df = spark.createDataFrame(pairs, "pred long, truth long")
    got = {r.class_id: r for r in evaluate.per_class(df, 5).collect()}
    f1s = []
    for c in range(5):
        tp, pp, tt = sum(p == t == c for p, t in pairs), sum(p == c for p, _ in pairs), sum(t == c for _, t in pairs)
        p, r = tp / pp if pp else 0, tp / tt if tt else 0
        f1s.append(2 * p * r / (p + r) if p and r else 0)
        assert (got[c].precision, got[c].recall, got[c].f1) == pytest.approx((p, r, f1s[-1]))
    assert evaluate.macro(df, 5).first().f1 == pytest.approx(sum(f1s) / 5)
    assert sum(r.n for r in evaluate.dense_confusion(df, 5).collect()) == len(pairs)


def test_metric_files(spark, tmp_path):
    df = spark.createDataFrame([(0, 0), (1, 0)], "pred long, truth long")
    for epoch in range(2):
        files.append_metrics(evaluate.evolution(epoch, df, df, 2), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).groupBy("split").count().collect() and spark.read.parquet(str(tmp_path / "m")).count() == 12
    assert evaluate.report(df, 2) == "precision 50.00%, recall 25.00%, f1 33.33%"


def test_stream(spark, tmp_path):
    rows = [(i, [1.0, float(i)]) for i in range(10)]
    schema = "sample_id long, data array<double>"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    scoring.write_scores(stream, ones([2, 3], "identity"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 10 and all(r.output == [2.0 + r.sample_id] * 3 and r.pred == 0 for r in got)


# what large inputs need


def pic(px, w, h):
    """A PIC file: row after row of red, green, blue, the even rows mixed run-length coded, the odd ones too, with a long run."""
    raw = b"\x53\x80\xf6\x34" + bytes(84) + b"PICT" + struct.pack(">HHfHH", w, h, 1.0, 3, 0) + bytes([0, 8, 2, 0xE0])
    for y in range(h):
        row = px[y * w : (y + 1) * w]
        if len(set(row)) == 1:
            raw += b"\x80" + struct.pack(">H", w) + bytes(row[0])
        else:
            raw += bytes([1]) + bytes(row[0]) + bytes(row[1]) + bytes([127 + w - 2]) + bytes(row[2])
    return raw


def test_pic_and_broken_files(spark, tmp_path):
    rows = [(1, 2, 3), (200, 100, 50), *[(9, 8, 7)] * 3, *[(255, 0, 10)] * 5]
    gray = [(77 * r + 150 * g + 29 * b) >> 8 for r, g, b in rows]
    (tmp_path / "a.pic").write_bytes(pic(rows, 5, 2))
    (tmp_path / "b.pic").write_bytes(pic(rows, 5, 2)[:-4])
    (tmp_path / "c.pgm").write_bytes(b"P5 3 3 255\nab")
    (tmp_path / "d.tga").write_bytes(b"no")
    (tmp_path / "e.pgm").write_bytes(b"P5 2 1 255\nab")
    got = {os.path.basename(r.path): (r.width, r.height, list(r.px)) for r in images.scan_other(spark, str(tmp_path)).collect()}
    assert got == {"a.pic": (5, 2, gray), "e.pgm": (2, 1, [97, 98])}


def test_large_images(spark, tmp_path, monkeypatch):
    """A million pixels in seconds; small batches give the same."""
    px = (np.arange(1 << 20) * 7919 >> 3).astype(np.uint8)
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "1.png").write_bytes(images.encode_png(px, 1024, 1024))
    (tmp_path / "x" / "2.png").write_bytes(images.encode_png(np.array([97, 98]), 2, 1))
    (tmp_path / "x" / "3.png").write_bytes(b"broken")
    images.scan(spark, str(tmp_path / "x")).count()
    began = time.monotonic()
    got = {os.path.basename(r.path): np.array(r.px) for r in images.scan(spark, str(tmp_path / "x")).collect()}
    assert time.monotonic() - began < 15
    assert set(got) == {"1.png", "2.png"} and (got["1.png"] == px).all() and got["2.png"].tolist() == [97, 98]
    monkeypatch.setattr(images, "BATCH_PIXELS", 1)
    assert sorted(len(r.px) for r in images.scan(spark, str(tmp_path / "x")).collect()) == [2, 1 << 20]


def test_bias_of_keys_without_a_product(spark, monkeypatch):
    kind = "key long, i long, j long, v double"
    a = spark.createDataFrame([(1, 0, 0, 2.0), (2, 0, 0, 3.0)], kind)
    b = spark.createDataFrame([(1, 0, 0, 5.0), (2, 1, 0, 7.0)], kind)
    c = spark.createDataFrame([(0, 0, 1.0), (0, 1, 4.0)], "i long, j long, v double")
    want = {(1, 0, 0, 12.0), (1, 0, 1, 8.0), (2, 0, 0, 2.0), (2, 0, 1, 8.0)}
    assert {tuple(r) for r in linalg.gemm(a, b, beta=2.0, c=c, keys=("key",)).collect()} == want
    monkeypatch.setattr(linalg, "BLOCK_CELLS", 1)
    with pytest.raises(ValueError):
        linalg.gemm(a, b, beta=2.0, c=c, keys=("key",))


@pytest.mark.parametrize("held", [1, 256])
def test_tiles_are_summed_whole(spark, monkeypatch, held):
    monkeypatch.setattr(linalg, "TILES_HELD", held)
    rng = np.random.default_rng(4)
    a, b = rng.integers(-3, 4, (21, 34)), rng.integers(-3, 4, (34, 18))
    cells = lambda m: spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(m)], "i long, j long, v double")
    got = np.zeros((21, 18))
    for r in linalg.tiled_gemm(cells(a), cells(b), 8).collect():
        got[r.i, r.j] += r.v
    assert (got == a @ b).all()


def test_gradients_are_merged_in_levels(spark):
    assert training.levels(8) == [1] and training.levels(32) == [1] and training.levels(10_000) == [313, 10, 1]
    rows = [(p, p + 1, np.array([float(p), 1.0]).tobytes()) for p in range(60)]
    parts = spark.createDataFrame(rows, training.SUMS)
    for widths in ([7], [7, 3], [7, 3, 1]):
        got = training.merged(parts, 2, widths).collect()
        assert 1 <= len(got) <= widths[-1] and len({r.part for r in got}) == len(got)
        assert sum(r.n for r in got) == sum(range(1, 61))
        assert sum(np.frombuffer(r.g) for r in got).tolist() == [sum(range(60)), 60]
    assert len(training.merged(parts, 2, [7]).collect()) > 3


@pytest.mark.parametrize(("size", "momentum", "biases"), [(4, 0.0, False), (7, 0.9, True), (100, 0.5, False)])
def test_minibatches_step_in_order(spark, size, momentum, biases):
    """One worker takes the batches one after another, as a loop on the driver does."""
    rng = np.random.default_rng(size)
    x, t = rng.random((30, 5)), rng.random((30, 2))
    df = spark.createDataFrame([(int(i), x[i].tolist(), t[i].tolist()) for i in rng.permutation(30)], "pos long, data array<double>, target array<double>")
    model, plain = mlp.MLP.random([5, 4, 2], "sigmoid", 1), mlp.MLP.random([5, 4, 2], "sigmoid", 1)
    rule, own = (training.Optimiser(0.3, momentum, 0.1, biases) for _ in range(2))
    for _ in range(2):
        training.train_epoch(df, model, rule, size)
        for i in range(0, 30, size):
            grads, more, _ = plain.backward(x[i : i + size], t[i : i + size])
            own.apply(plain, grads, more, len(x[i : i + size]))
        own.end_epoch()
    for a, b in zip([*model.weights, *model.biases], [*plain.weights, *plain.biases], strict=True):
        assert np.allclose(a, b, atol=1e-12)


def test_workers_are_averaged(spark):
    """Each worker steps through its own range; the models are averaged by their rows."""
    rng = np.random.default_rng(2)
    x, t = rng.random((40, 3)), rng.random((40, 1))
    df = spark.createDataFrame([(i, x[i].tolist(), t[i].tolist()) for i in range(40)], "pos long, data array<double>, target array<double>")
    model = mlp.MLP.random([3, 1], "sigmoid", 5)
    before = model.weights[0].copy()
    training.train_epoch(df, model, training.Optimiser(0.5), 40, workers=4)
    assert not np.allclose(model.weights[0], before)
    start = mlp.MLP([3, 1], ["sigmoid"], [before], model.biases)
    grads, _, _ = start.backward(x, t)
    # with one batch a worker the average of their steps is near the step of all rows
    assert np.allclose(model.weights[0], before - 0.5 * grads[0] / 40, atol=0.02)
    empty = [w.copy() for w in model.weights]
    training.train_epoch(df.limit(0), model, training.Optimiser(0.5), 8)
    assert np.array_equal(empty[0], model.weights[0])


def test_models_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(linalg, "BLOCK_CELLS", 3)
    df = spark.createDataFrame([(0, [1.0, 2.0], [1.0])], "pos long, data array<double>, target array<double>")
    model = mlp.MLP.random([2, 2, 1], "sigmoid", 0)
    for run in (lambda: mlp.score_blocks(df, model), lambda: training.train_epoch(df, model, training.Optimiser()), lambda: training.train_epoch(df, model, training.Optimiser(), 1)):
        with pytest.raises(ValueError):
            run()


def test_cap_of_a_hot_class(spark, monkeypatch):
    monkeypatch.setattr(dataset, "SALTS", 4)
    df = spark.range(500).select(F.concat(F.lit("f"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("path"), F.when(F.col("id") % 10 == 0, 1).otherwise(0).cast("long").alias("class_id"))
    got = {(r.class_id, r.path) for r in dataset.cap_per_class(df, "path", 20).collect()}
    want = {c: sorted(f"f{i:04}" for i in range(500) if (i % 10 == 0) == c)[:20] for c in (0, 1)}
    assert got == {(c, p) for c, ps in want.items() for p in ps}


@pytest.mark.parametrize(("total", "parts"), [(10, 3), (2, 5), (9, 9)])
def test_slices_by_number(spark, total, parts):
    df = spark.range(total).select(F.col("id").alias("pos"), F.col("id").alias("x"))
    held = [sorted(r.x for r in linalg.slice_of(df, parts, n, total).collect()) for n in range(parts)]
    assert [x for h in held for x in h] == list(range(total))
    assert max(map(len, held)) - min(map(len, held)) <= 1


def test_no_private_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

        def getConf(self):
            return {}

    fake = type("Session", (), {"sparkContext": Context(), "conf": {}})()
    with pytest.raises(ValueError):
        session.shared_dir(fake)


# training networks, and the program


@pytest.mark.parametrize("layers", ["convolution 2 2 2 pooling max 2 2", "convolution 2 2 2 convolution 2 2 3", "pooling avg 2 2 convolution 3 2 2"])
@pytest.mark.parametrize("function", ["sigmoid", "square", "leakyRelu"])
def test_network_gradient_is_that_of_differences(layers, function):
    rng = np.random.default_rng(3)
    model = cnn.CNNModel.random(f"5 4 {function} {layers}", [3, 2], 1)
    model.head.set_activation("sigmoid")
    model.weights = [w - 0.4 for w in model.weights]
    x, t = rng.normal(size=(3, 20)), rng.random((3, 2))
    grads, _, inputs = model.backward(x, t)

    def loss():
        return ((model.forward(x)[1][-1] - t) ** 2).sum() / 2

    for w, g in zip([*model.weights, x], [*grads, inputs], strict=True):
        for at in np.ndindex(w.shape):
            kept, sides = w[at], []
            for e in (1e-6, -1e-6):
                w[at] = kept + e
                sides.append(loss())
            w[at] = kept
            assert (sides[0] - sides[1]) / 2e-6 == pytest.approx(g[at], abs=1e-5)


def test_network_blocks_match_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6, 25))
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "sample_id long, data array<double>")
    for text in ("5 5 sigmoid convolution 2 2 2 pooling max 2 2 convolution 2 2 2", "5 5 relu pooling avg 2 3 convolution 2 3 2"):
        model = cnn.CNNModel.random(text, [3], 2)
        got = [r.output for r in model.predict(df).orderBy("sample_id").collect()]
        assert np.allclose(got, model.forward(x)[1][-1]) and np.allclose([r.output for r in mlp.score_blocks(df, model).orderBy("sample_id").collect()], got)


def test_networks_train_in_minibatches(spark):
    rng = np.random.default_rng(5)
    x, t = rng.random((13, 16)), rng.random((13, 2))
    df = spark.createDataFrame([(i, x[i].tolist(), t[i].tolist()) for i in range(13)], "pos long, data array<double>, target array<double>").repartition(3)
    model, plain = (cnn.CNNModel.random("4 4 sigmoid convolution 2 2 2 pooling max 2 2", [2], 1) for _ in range(2))
    rule, own = (training.Optimiser(0.3, 0.9, 0.1, True) for _ in range(2))
    for _ in range(2):
        training.train_epoch(df, model, rule, 4)
        for i in range(0, 13, 4):
            grads, biases, _ = plain.backward(x[i : i + 4], t[i : i + 4])
            own.apply(plain, grads, biases, len(x[i : i + 4]))
        own.end_epoch()
    for a, b in zip([*model.weights, *model.biases], [*plain.weights, *plain.biases], strict=True):
        assert np.allclose(a, b, atol=1e-12)


@pytest.fixture
def folders(spark, tmp_path):
    """Two classes of images, dark on the left or on the right, in two sizes, and a broken file."""
    for s, n in (("train", 12), ("eval", 4)):
        for c, name in enumerate(("left", "right")):
            (tmp_path / "in" / s / name).mkdir(parents=True)
            for k in range(n):
                w, h = (8, 6) if k % 2 else (5, 9)
                px = np.tile(np.where((np.arange(w) < w / 2) == (c == 0), 20 + k, 230 - k), (h, 1))
                (tmp_path / "in" / s / name / f"{k}.png").write_bytes(images.encode_png(px.astype(np.uint8).ravel(), w, h))
    (tmp_path / "in" / "train" / "left" / "broken.png").write_bytes(b"no image")
    return tmp_path


def test_program(spark, folders):
    out = str(folders / "out")
    program.main([str(folders / "in"), out, "--image-side", "4", "--tensor-size", "5", "--batch-size", "4", "--epochs", "6", "--rate", "0.5", "--hidden", "6", "--function", "sigmoid", "--optimiser", "decay-momentum"])
    rows = spark.read.parquet(f"{out}/samples")
    assert rows.groupBy("split").count().orderBy("split").collect() == [("eval", 8), ("train", 24)]
    places = rows.filter("split = 'train'").orderBy("pos").collect()
    assert [(r.pos, r.tensor_id) for r in places] == [(i, i // 5) for i in range(24)]
    assert all(set(r.data) <= {0.0, 1.0} and len(r.data) == 16 for r in places) and {tuple(r.target) for r in places} == {(1.0, 0.0), (0.0, 1.0)}
    history = spark.read.parquet(f"{out}/model_evolution")
    assert history.count() == 6 * 2 * 3
    last = history.filter("epoch = 5 AND class_id IS NULL AND split = 'eval'").first()
    model = files.load_model(f"{out}/model.txt")
    assert model.topology == [16, 6, 2] and last.f1 == 1.0
    lines = (folders / "out" / "logs.txt").read_text().splitlines()
    assert "24 samples to train on, 8 to evaluate, 2 classes" in lines[0] and len(lines) == 7
    with pytest.raises(FileExistsError):
        program.main([str(folders / "in"), out, "--epochs", "1"])
    assert (folders / "out" / "logs.txt").read_text().splitlines() == lines
    with pytest.raises(ValueError):
        program.optimiser("adam", training.Settings())


def test_default_settings():
    s = training.Settings()
    assert (s.image_side, s.tensor_size, s.batch_size, s.epochs) == (32, 256, 16, 75)
    plain, both = program.optimiser("sgd", s), program.optimiser("decay-momentum", s)
    assert (plain.rate, plain.momentum, plain.decay) == (0.08, 0, 0) and (both.momentum, both.decay) == (0.9, 0.001)
    # the default model may be sent to the tasks
    assert mlp.MLP([s.image_side**2, *s.hidden, 10], [s.function] * (len(s.hidden) + 1)).shipped()


def test_removed_folders(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a")
    assert session.remove(spark, f"file://{tmp_path}/a") and not (tmp_path / "a").exists()
    assert not session.remove(spark, f"{tmp_path}/a")


@pytest.mark.parametrize("shared", ["a", "b"])
def test_shared_product_and_summand_fill_tasks_by_cells(spark, monkeypatch, shared):
    """Products by key with a summand for all keys equal numpy's, over more tasks than shuffle partitions where the cells ask for it."""
    monkeypatch.setattr(linalg, "CELLS_HELD", 32, raising=False)
    rng = np.random.default_rng(3)
    w, c, many = rng.random((3, 3)), rng.random((3, 3)), rng.random((40, 3, 3))
    cells = lambda m: [(i, j, float(v)) for (i, j), v in np.ndenumerate(m)]
    one_, extra = (spark.createDataFrame(cells(m), "i long, j long, v double") for m in (w, c))
    keyed = spark.createDataFrame([(k, *x) for k, m in enumerate(many) for x in cells(m)], "key long, i long, j long, v double")
    a, b = (F.broadcast(one_), keyed) if shared == "a" else (keyed, F.broadcast(one_))
    out = linalg.gemm(a, b, alpha=2.0, beta=0.5, c=extra, keys=("key",), shared=shared)
    got = {(r.key, r.i, r.j): r.v for r in out.collect()}
    want = {(k, i, j): v for k, m in enumerate(many) for i, j, v in cells(2 * (w @ m if shared == "a" else m @ w) + c / 2)}
    assert got.keys() == want.keys() and np.allclose([got[x] for x in want], list(want.values()))
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 4
