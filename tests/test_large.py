"""Perceptrons as tables of tiles against the dense ones."""

from __future__ import annotations

import numpy as np
import pytest

from pixelloom.operators import large, linalg, mlp, training


def rows(spark, n, width, outputs, seed=0):
    rng = np.random.default_rng(seed)
    x, t = rng.random((n, width)), rng.random((n, outputs))
    data = [(int(i), x[i].tolist(), t[i].tolist()) for i in rng.permutation(n)]
    return spark.createDataFrame(data, "pos long, data array<double>, target array<double>").repartition(3)


def dense_model(topology, seed=1):
    model = mlp.MLP.random(topology, "sigmoid", seed)
    model.activations = ["leakyRelu", *model.activations[1:]]
    return model


@pytest.mark.parametrize("side", [3, 4, 16])
def test_tiles_score_and_train_like_the_dense_model(spark, side):
    df = rows(spark, 11, 7, 2)
    plain = dense_model([7, 9, 5, 2])
    tiled = large.TiledMLP.of(spark, plain.weights, plain.biases, plain.activations, side)
    want = {r.pos: r.output for r in mlp.score_blocks(df, plain).collect()}
    got = {r.pos: r.output for r in tiled.predict(df).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
    rule = training.Optimiser(0.5, train_biases=True)
    for _ in range(2):
        training.train_epoch(df, plain, rule)
        tiled.step(df, 0.5, train_biases=True)
    for a, b in zip([*plain.weights, *plain.biases], [x for group in tiled.dense() for x in group], strict=True):
        assert np.allclose(a, b, atol=1e-12)


def test_large_biases_and_empty_samples(spark, monkeypatch):
    df = rows(spark, 5, 4, 3)
    plain = dense_model([4, 6, 3])
    tiled = large.TiledMLP.of(spark, plain.weights, plain.biases, plain.activations, 2)
    monkeypatch.setattr(large, "BROADCAST_BYTES", 0)
    got = {r.pos: r.output for r in tiled.predict(df).collect()}
    assert all(np.allclose(got[r.pos], r.output) for r in mlp.score_blocks(df, plain).collect())
    before = tiled.dense()[0]
    tiled.step(df.limit(0), 0.5)
    assert tiled.predict(df.limit(0)).count() == 0 and all(np.array_equal(a, b) for a, b in zip(before, tiled.dense()[0], strict=True))
    with pytest.raises(Exception, match="takes 4"):
        tiled.predict(rows(spark, 2, 5, 3)).count()


def test_random_models_and_files(spark, tmp_path):
    one, two = (large.TiledMLP.random(spark, [7, 5, 3], "relu", 4, 2) for _ in range(2))
    for a, b in zip([x for g in one.dense() for x in g], [x for g in two.dense() for x in g], strict=True):
        assert np.array_equal(a, b)
    assert [w.shape for w in one.dense()[0]] == [(5, 7), (3, 5)] and [b.shape for b in one.dense()[1]] == [(5,), (3,)]
    assert all(abs(w).max() <= (2 / len(w)) ** 0.5 for w in one.dense()[0])
    one.save(str(tmp_path / "model"))
    again = two.loaded(str(tmp_path / "model"))
    assert all(np.array_equal(a, b) for a, b in zip(one.dense()[0], again.dense()[0], strict=True))


def test_no_tile_set_is_whole_in_a_task(spark):
    """A product of many tiles is dealt to as many partitions as its grid has, and no task holds more output than the bound."""
    g = linalg.grid_for(64, 64, 32, 8, 512)
    assert g.held(64, 64) * 512**2 <= linalg.TILES_HELD


def test_topologies_are_edited():
    t = mlp.Topology.from_text("4,3")
    t.push_back(2)
    t.push_front(9)
    t.input_size, t.output_size = 8, 1
    assert t == [8, 4, 3, 1] and str(t) == "8 4 3 1" and len(t) == 4 and (t.input_size, t.output_size) == (8, 1)
    assert mlp.MLP.random(t).topology == [8, 4, 3, 1]
    none = mlp.Topology()
    assert not none and none.input_size == 0 == none.output_size
    none.output_size = 5
    none.input_size = 6
    assert none == [6]
