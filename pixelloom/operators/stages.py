"""Transforms, networks and perceptrons as stages of pyspark.ml pipelines.

The stages call the functions of this package and add nothing to them: params,
fitting, and persistence. A stage's params are its metadata; weights lie beside
them as files with all their digits. Images are arrays of gray pixels of one size,
features arrays of doubles or vectors.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasMaxIter, HasOutputCol, HasPredictionCol, HasSeed, HasStepSize
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.cnn import CNN, forward_blocks
from pixelloom.operators.dataset import one_hot
from pixelloom.operators.mlp import MLP, classified, score_blocks
from pixelloom.operators.ordering import with_position
from pixelloom.operators.pixels import TransformEngine
from pixelloom.operators.training import Optimiser, train_epoch
from pixelloom.sources import files


class _Sized(Params):
    width = Param(Params._dummy(), "width", "columns of the images", TypeConverters.toInt)
    height = Param(Params._dummy(), "height", "rows of the images", TypeConverters.toInt)


class ImageTransformer(Transformer, HasInputCol, HasOutputCol, _Sized, DefaultParamsReadable, DefaultParamsWritable):
    """Named transforms, as TransformEngine has them, on images of one size; the result is divided by `divisor` if that is set."""

    steps = Param(Params._dummy(), "steps", "a transform and its parameters per line", TypeConverters.toString)
    divisor = Param(Params._dummy(), "divisor", "what pixels are divided by", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, width=None, height=None, steps=None, divisor=None):  # noqa: ANN001, N803
        super().__init__()
        self._setDefault(inputCol="px", outputCol="data", steps="", divisor=1.0)
        self._set(**self._input_kwargs)

    @staticmethod
    def of(engine: TransformEngine, **params) -> ImageTransformer:  # noqa: ANN003
        return ImageTransformer(steps=files.transforms_to_text(engine), **params)

    def out_size(self) -> tuple[int, int]:
        """Columns and rows after the transforms."""
        _, w, h = files.transforms_from_text(self.getOrDefault("steps")).column(F.col("px"), self.getOrDefault("width"), self.getOrDefault("height"))
        return w, h

    def _transform(self, dataset: DataFrame) -> DataFrame:
        engine, out = files.transforms_from_text(self.getOrDefault("steps")), self.getOutputCol()
        size = {"width": self.getOrDefault("width"), "height": self.getOrDefault("height")}
        # each transform is a projection of its own, on a column that no table has
        df, px = dataset.withColumn("__stage", F.col(self.getInputCol())), F.col("__stage")
        for name, *more in engine.steps:
            column, size["width"], size["height"] = TransformEngine((name, *more)).column(px, size["width"], size["height"])
            df = df.withColumn("__stage", column)
        return df.withColumn(out, F.transform("__stage", lambda v: v / F.lit(self.getOrDefault("divisor")))).drop("__stage")


class _FileWriter(MLWriter):
    def __init__(self, instance: _Filed) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sc, extraMetadata={"shape": self.instance.shape()})
        raw = io.BytesIO()
        np.savez(raw, **self.instance.arrays())
        files.write_bytes(f"{path}/arrays.npz", raw.getvalue())


class _FileReader(MLReader):
    def __init__(self, kind: type) -> None:
        super().__init__()
        self.kind = kind

    def load(self, path: str):  # noqa: ANN201
        metadata = DefaultParamsReader.loadMetadata(path, self.sc)
        fs, at = files.located(f"{path}/arrays.npz")
        with fs.open_input_file(at) as f:
            held = np.load(io.BytesIO(f.read()))
        out = self.kind.restored(metadata["shape"], {k: held[k] for k in held.files})
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out


class _Filed(MLWritable, MLReadable):
    """Persistence of params and arrays; shape() is what restored() needs beside them."""

    def write(self) -> MLWriter:
        return _FileWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FileReader(cls)


class NetworkFeatures(Transformer, HasInputCol, HasOutputCol, _Filed):
    """The features of a convolutional network."""

    def __init__(self, net: CNN, inputCol: str = "data", outputCol: str = "features") -> None:  # noqa: N803
        super().__init__()
        self.net = net
        self._set(inputCol=inputCol, outputCol=outputCol)

    def shape(self) -> str:
        return self.net.to_text()

    def arrays(self) -> dict[str, np.ndarray]:
        return {str(n): layer.filters for n, layer in enumerate(self.net.layers) if layer.filters is not None}

    @classmethod
    def restored(cls, shape: str, arrays: dict[str, np.ndarray]) -> NetworkFeatures:
        net = CNN.from_text(shape)
        for n, filters in arrays.items():
            net.layers[int(n)].set_filters(filters)
        return cls(net)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return forward_blocks(dataset, self.net, self.getInputCol(), self.getOutputCol())


class _Perceptron(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasOutputCol):
    def arrays_in(self, dataset: DataFrame, out: str) -> DataFrame:
        """The features as an array of doubles in a column `out`."""
        kind = dataset.schema[self.getFeaturesCol()].dataType
        column = F.col(self.getFeaturesCol())
        return dataset.withColumn(out, vector_to_array(column) if isinstance(kind, VectorUDT) else column.cast("array<double>"))


class PerceptronModel(Model, _Perceptron, _Filed):
    """Adds the outputs and the class of the output largest without its sign."""

    def __init__(self, model: MLP) -> None:
        super().__init__()
        self.model = model
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", outputCol="output")

    def shape(self) -> dict:
        return {"topology": self.model.topology, "activations": self.model.activations}

    def arrays(self) -> dict[str, np.ndarray]:
        return {f"w{i}": w for i, w in enumerate(self.model.weights)} | {f"b{i}": b for i, b in enumerate(self.model.biases)}

    @classmethod
    def restored(cls, shape: dict, arrays: dict[str, np.ndarray]) -> PerceptronModel:
        n = len(shape["activations"])
        return cls(MLP(shape["topology"], shape["activations"], [arrays[f"w{i}"] for i in range(n)], [arrays[f"b{i}"] for i in range(n)]))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = classified(score_blocks(self.arrays_in(dataset, "__x"), self.model, "__x", self.getOutputCol()), self.getOutputCol())
        return scored.withColumn(self.getPredictionCol(), F.col("pred").cast("double")).drop("__x", "pred")


class PerceptronClassifier(Estimator, _Perceptron, HasMaxIter, HasStepSize, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Trains a perceptron on labels 0, 1 and so on; rows without a label teach nothing.

    Without a batch size an epoch is one step over all rows; with one it is a step
    for each batch, in the order of `orderCol`.
    """

    hidden = Param(Params._dummy(), "hidden", "widths of the hidden layers", TypeConverters.toListInt)
    function = Param(Params._dummy(), "function", "activation function", TypeConverters.toString)
    momentum = Param(Params._dummy(), "momentum", "share of the last step that is taken again", TypeConverters.toFloat)
    decay = Param(Params._dummy(), "decay", "decay of the rate by epoch", TypeConverters.toFloat)
    trainBiases = Param(Params._dummy(), "trainBiases", "whether biases are trained", TypeConverters.toBoolean)
    batchSize = Param(Params._dummy(), "batchSize", "rows of a mini-batch, 0 for all", TypeConverters.toInt)
    orderCol = Param(Params._dummy(), "orderCol", "column that orders the rows for mini-batches", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, predictionCol=None, outputCol=None, hidden=None, function=None, maxIter=None, stepSize=None, momentum=None, decay=None, trainBiases=None, batchSize=None, orderCol=None, seed=None):  # noqa: ANN001, N803
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", outputCol="output", hidden=[], function="sigmoid", maxIter=10, stepSize=0.08, momentum=0.0, decay=0.0, trainBiases=False, batchSize=0, orderCol="", seed=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PerceptronModel:
        get = self.getOrDefault
        rows = self.arrays_in(dataset.filter(F.col(self.getLabelCol()).isNotNull()), "__x").withColumn("__y", F.col(self.getLabelCol()).cast("long"))
        classes, width = rows.agg(F.max("__y") + 1, F.max(F.size("__x"))).first()
        if classes is None:
            raise ValueError("no row has a label")
        samples = rows.select("__x", "__y", *([get("orderCol")] if get("orderCol") else [])).withColumns({"data": F.col("__x"), "target": one_hot(F.col("__y"), classes)})
        batch = get("batchSize") or None
        if batch:
            samples = with_position(samples, *([get("orderCol")] if get("orderCol") else []), F.xxhash64("data"), "__y")
        model = MLP.random([width, *get("hidden"), classes], get("function"), get("seed"))
        rule = Optimiser(get("stepSize"), get("momentum"), get("decay"), get("trainBiases"))
        for _ in range(get("maxIter")):
            train_epoch(samples, model, rule, batch)
        return self._copyValues(PerceptronModel(model))
