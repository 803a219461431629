"""Stages of pyspark.ml: fitted, saved, loaded and scored like the functions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pixelloom.operators import cnn, mlp, pixels, stages, training


@pytest.fixture(scope="module")
def pictures(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(40):
        px = rng.integers(0, 60, (6, 6))
        px[:, :3] += 150 * (k % 2)
        rows.append((k, px.ravel().tolist(), k % 2, "x"))
    return spark.createDataFrame(rows, "id long, px array<int>, label int, pred string").repartition(3).cache()


def built():
    net = cnn.CNN.from_text("6 6 relu convolution 2 3 3 pooling max 2 2").randomise(1)
    engine = pixels.TransformEngine("inversion", ("restriction", 8))
    return net, engine, [stages.ImageTransformer.of(engine, width=6, height=6, divisor=255.0), stages.NetworkFeatures(net), stages.PerceptronClassifier(hidden=[4], maxIter=30, stepSize=2.0, momentum=0.5, trainBiases=True, seed=3)]


def test_a_pipeline_fits_saves_loads_and_scores(spark, pictures, tmp_path):
    net, engine, parts = built()
    model = Pipeline(stages=parts).fit(pictures)
    scored = {r.id: r for r in model.transform(pictures).collect()}
    # the functions, one after another
    rows = engine.apply(pictures, 6, 6).withColumn("data", F.transform("px", lambda v: v / 255.0))
    features = cnn.forward_blocks(rows.select("id", "data", "label"), net)
    plain, rule = mlp.MLP.random([net.output_size, 4, 2], "sigmoid", 3), training.Optimiser(2.0, 0.5, train_biases=True)
    samples = training.with_target(features.select(F.col("features").alias("data"), F.col("label").alias("class_id")), 2)
    for _ in range(30):
        training.train_epoch(samples, plain, rule)
    want = {r.id: r.output for r in mlp.score_blocks(features.select("id", F.col("features").alias("data")), plain).collect()}
    assert all(np.allclose(scored[k].output, want[k], atol=1e-9) for k in want)
    assert all(scored[k].prediction == scored[k].label for k in want) and isinstance(scored[0].prediction, float)
    assert "pred" not in model.transform(pictures.drop("pred")).columns
    for saved, load in ((model, PipelineModel.load), (Pipeline(stages=parts), Pipeline.load)):
        path = f"file://{tmp_path}/{type(saved).__name__}"
        saved.write().overwrite().save(path)
        again = load(path)
        again = again if saved is model else again.fit(pictures)
        assert all(np.allclose(r.output, scored[r.id].output, atol=1e-9) for r in again.transform(pictures).collect())


def test_mini_batches_and_vectors(spark, pictures):
    df = pictures.withColumn("features", array_to_vector(F.transform("px", lambda v: v / 255.0)))
    fitted = stages.PerceptronClassifier(maxIter=4, stepSize=0.5, batchSize=8, orderCol="id").fit(df)
    plain, rule = mlp.MLP.random([36, 2], "sigmoid", 0), training.Optimiser(0.5)
    samples = training.with_target(pictures.select(F.col("id").alias("pos"), F.transform("px", lambda v: v / 255.0).alias("data"), F.col("label").alias("class_id")), 2)
    for _ in range(4):
        training.train_epoch(samples, plain, rule, 8)
    assert np.allclose(fitted.model.weights[0], plain.weights[0], atol=1e-12)
    assert fitted.transform(df).count() == 40
    with pytest.raises(ValueError, match="label"):
        stages.PerceptronClassifier().fit(df.withColumn("label", F.lit(None).cast("int")))
    assert stages.ImageTransformer.of(pixels.TransformEngine(("crop", 3, 2, 0, 0)), width=6, height=6).out_size() == (3, 2)
