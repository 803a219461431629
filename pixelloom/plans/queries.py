"""One query per operator over the driver's tables; each takes (spark, folder)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions import activation as af
from pixelloom.operators import cnn, dataset, evaluate, linalg, mlp, pixels, rasters, training
from pixelloom.functions.binding import spread_out
from pixelloom.operators.ordering import with_position
from pixelloom.plans import weights as wt
from pixelloom.session import shared_dir
from pixelloom.sources import files
from pixelloom.sources import images as pictures
from pixelloom.sources.samples import SIDE, images, samples, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
N = SIDE * SIDE


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def named(name: str) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        return f

    return put


def spread(df: DataFrame, px: Column, value: str = "px", kind: str = "long", *more: str) -> DataFrame:
    """(vec_id, p, value), a row for each element; doubles with six decimals."""
    out = spread_out(df.select(F.col("sample_id").alias("vec_id"), *more, px.alias("__a")), "__a", value)
    v = F.col(value).cast(kind)
    return out.select("vec_id", *more, F.col("p").cast("long").alias("p"), (F.round(v, 6) if kind == "double" else v).alias(value))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# pixels


def pixel_query(name: str, f: Callable[[Column], Column], value: str = "px", kind: str = "long") -> None:
    QUERIES[name] = lambda spark, d: spread(images(spark, d), f(F.col("px")), value, kind)


pixel_query("px_quantize", lambda px: px)
pixel_query("px_invert", pixels.invert)
pixel_query("px_binary_scale", pixels.binary_scale)
pixel_query("px_restriction", lambda px: pixels.restriction(px, 32))
pixel_query("px_normalize", pixels.normalise, "v", "double")
pixel_query("px_crop", lambda px: pixels.crop(px, SIDE, SIDE, 4, 3, 2, 1))
pixel_query("px_equalize", pixels.equalise)
pixel_query("px_binary_by_median", pixels.binary_scale_by_median)
pixel_query("px_sobel_edges", lambda px: pixels.edges(px, SIDE, SIDE))
pixel_query("px_gaussian_oop", lambda px: pixels.blur(px, SIDE, SIDE, 5))
pixel_query("px_histogram_dense", pixels.dense_histogram, "n")
pixel_query("px_resize", lambda px: pixels.resize(px, SIDE, SIDE, 5, 5))


@query
def px_pipeline_invert_binary(spark, d):
    engine = pixels.TransformEngine("inversion", "binaryscale")
    return spread(engine.apply(images(spark, d), SIDE, SIDE), F.col("px"))


@query
def px_histogram(spark, d):
    h = pixels.histogram(images(spark, d).withColumnRenamed("sample_id", "vec_id"), "vec_id")
    return h.select("vec_id", F.col("px").cast("long").alias("px"), "n")


@query
def px_ratio_histogram(spark, d):
    out = spread(images(spark, d), pixels.ratio_histogram(F.col("px")), "ratio", "double")
    return out.filter(F.col("ratio") > 0)


@query
def px_difference(spark, d):
    """Each image against the one with the next id."""
    a = images(spark, d).select("sample_id", F.col("px").alias("a"))
    b = a.select((F.col("sample_id") - 1).alias("sample_id"), F.col("a").alias("b"))
    return a.join(b, "sample_id").select(F.col("sample_id").alias("vec_id"), r6(pixels.difference(F.col("a"), SIDE, SIDE, F.col("b"), SIDE, SIDE)).alias("difference"))


@query
def px_pixel_at(spark, d):
    return images(spark, d).select(F.col("sample_id").alias("vec_id"), pixels.pixel_at(F.col("px"), F.col("width"), 3, 5).cast("long").alias("px"))


@query
def px_sizes(spark, d):
    return pixels.sizes(images(spark, d)).select(F.col("sample_id").alias("vec_id"), "width", "height", "n_pixels")


@query
def px_printed(spark, d):
    """Each image as text."""
    return images(spark, d).select(F.col("sample_id").alias("vec_id"), linalg.printed(F.col("px"), SIDE).alias("text"))


@query
def luma_rgb(spark, d):
    """Each image as 21 colours, one value over."""
    px = F.col("px")
    return spread(images(spark, d), F.transform(F.sequence(F.lit(0), F.lit(N // 3 - 1)), lambda k: pixels.luma(*(F.get(px, k * 3 + c) for c in range(3)))), "gray")


def place(spark, name: str) -> str:
    """A folder of this call's own on shared storage."""
    top = shared_dir(spark)
    return f"{top if '://' in top or top.startswith('file:') else 'file://' + top}/{name}-{uuid.uuid4().hex}"


@query
def px_transforms_from_file(spark, d):
    """The transforms written to a file and read again."""
    path = f"{place(spark, 'transforms')}/list.txt"
    files.save_transforms(pixels.TransformEngine("inversion", "binaryscale"), path)
    return spread(files.load_transforms(path).apply(images(spark, d), SIDE, SIDE), F.col("px"))


@query
def px_resize_pipeline(spark, d):
    """A pipeline that keeps the size, inverts and then binarises."""
    steps = pixels.TransformationPipeline(SIDE, SIDE, pixels.TransformEngine("inversion"), pixels.TransformEngine("binaryscale"))
    return spread(steps.apply(images(spark, d), SIDE, SIDE), F.col("px"))


@query
def px_set_size(spark, d):
    """All pixels of images whose size was set anew."""
    return spread(images(spark, d), pixels.blank(4, 3))


@query
def img_write_and_load(spark, d):
    """All images as PNG files in folders by class, loaded with their classes."""
    folder = place(spark, "images")
    pictures.write_png(images(spark, d), folder, within=F.concat(F.lit("class"), F.col("class_id")))
    loaded = pictures.load(spark, folder).withColumn("sample_id", F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long"))
    return spread(loaded, F.col("px"), "px", "long", "class_name", "width", "height")


def numbered_name(path: str = "path") -> Column:
    return F.regexp_extract(path, r"(\d+)\.png$", 1).cast("long")


@query
def img_directory(spark, d):
    """All images as PNG files right in one folder, loaded again."""
    folder = place(spark, "images")
    pictures.write_png(images(spark, d), folder)
    return spread(pictures.load_directory(spark, folder).withColumn("sample_id", numbered_name()), F.col("px"))


@query
def img_info(spark, d):
    """Sizes and channels of such files, from their headers."""
    folder = place(spark, "images")
    pictures.write_png(images(spark, d), folder)
    return pictures.info(spark, folder).select(numbered_name().alias("vec_id"), "width", "height", "channels")


@query
def img_without_classes(spark, d):
    """Files in folders by class, numbered by their paths and unlabelled."""
    folder = place(spark, "images")
    pictures.write_png(images(spark, d), folder, within=F.concat(F.lit("class"), F.col("class_id")))
    return pictures.load(spark, folder, with_classes=False).select(numbered_name().alias("vec_id"), F.col("sample_id").alias("place"), "class_id", F.array_max("px").cast("long").alias("brightest"))


@query
def img_matrix_save(spark, d):
    """Matrices of numbers saved as pixels, and loaded."""
    folder = place(spark, "images")
    rows = samples(spark, d).select("sample_id", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), pictures.rescaled(F.col("data")).alias("px"))
    pictures.write_png(rows, folder)
    return spread(pictures.load_directory(spark, folder).withColumn("sample_id", numbered_name()), F.col("px"))


@query
def px_transforms_from_text(spark, d):
    """The transforms as text and back."""
    text = files.transforms_to_text(pixels.TransformEngine("inversion", "binaryscale"))
    return spread(files.transforms_from_text(text).apply(images(spark, d), SIDE, SIDE), F.col("px"))


def tall_image(spark, d, name: str) -> DataFrame:
    """The embeddings as the lines of one image, filtered in tiles: (y, x, px)."""
    lines = images(spark, d).select(F.lit("all").alias("image"), F.col("sample_id").alias("y"), F.col("px"))
    height = table(spark, d, "embeddings").agg(F.max("vec_id") + 1).first()[0]
    tiles = rasters.filtered_tiles(rasters.from_lines(lines, N, height, 24), 24, name)
    wide = F.least(F.lit(24), N - F.col("tx") * 24)
    cells = spread_out(tiles.select("ty", "tx", "px"), "px", "v")
    return cells.select((F.col("ty") * 24 + F.floor(F.col("p") / wide)).cast("long").alias("y"), (F.col("tx") * 24 + F.col("p") % wide).cast("long").alias("x"), F.col("v").cast("long").alias("px"))


@query
def px_gaussian_tiled(spark, d):
    return tall_image(spark, d, "filter")


@query
def px_edges_tiled(spark, d):
    return tall_image(spark, d, "edges")


@query
def px_edges_blocks(spark, d):
    """Edges of each image, by numpy."""
    return spread(rasters.filtered(images(spark, d).select("sample_id", "width", "height", "px"), "edges"), F.col("px"))


@query
def img_noise(spark, d):
    """An image of noise for each customer."""
    n = table(spark, d, "customer").count()
    return spread(pictures.noise(spark, n, 3, 2, 5), F.col("px"))


# data sets


def ordered(spark, d):
    return with_position(samples(spark, d).select("sample_id", "class_id", "n_rows", "n_cols"), "sample_id")


@query
def ds_class_dictionary(spark, d):
    return dataset.class_dictionary(table(spark, d, "events"), "event_type")


@query
def ds_class_counts(spark, d):
    events = table(spark, d, "events")
    named_ = dataset.labelled(events, dataset.class_dictionary(events, "event_type"), "event_type")
    return dataset.class_counts(named_)


@query
def ds_class_cap(spark, d):
    events = table(spark, d, "events")
    named_ = dataset.labelled(events, dataset.class_dictionary(events, "event_type"), "event_type")
    return dataset.cap_per_class(named_, "event_id", 100).select("event_id", "class_id")


@query
def ds_tensor_batches(spark, d):
    return dataset.batched(table(spark, d, "events").select("event_id"), 256, "event_id").select("event_id", "pos", "tensor_id")


@query
def ds_rebatch(spark, d):
    return dataset.rebatched(dataset.batched(table(spark, d, "events").select("event_id"), 256, "event_id"), 100).select("event_id", "tensor_id")


@query
def ds_remove_tensors(spark, d):
    return dataset.without_tensors(dataset.batched(table(spark, d, "events").select("event_id"), 256, "event_id"), 1, 3).select("event_id", "pos", "tensor_id")


@query
def ds_minibatch_ids(spark, d):
    return dataset.minibatches(with_position(table(spark, d, "events").select("event_id"), "event_id"), 16).select("event_id", "batch_id", "in_batch")


@query
def ds_split_parts(spark, d):
    tensors = dataset.batched(table(spark, d, "events").select("event_id"), 256, "event_id")
    return dataset.split(tensors, 3).select("event_id", "part")


@query
def ds_split_sizes(spark, d):
    tensors = dataset.batched(table(spark, d, "events").select("event_id"), 256, "event_id")
    return dataset.sizes(dataset.split(tensors, 3), "part")


@query
def ds_append(spark, d):
    first = ordered(spark, d)
    return dataset.appended(first, first.withColumn("sample_id", F.col("sample_id") + 1_000_000)).select("sample_id", "pos")


@query
def ds_onehot(spark, d):
    return spread(samples(spark, d), dataset.one_hot(F.col("class_id"), wt.CLASSES), "v", "double")


@query
def ds_train_eval(spark, d):
    s = samples(spark, d).select("sample_id", "class_id")
    even = F.col("sample_id") % 5 == 0
    return dataset.train_eval(s.filter(~even), s.filter(even)).groupBy("split", "class_id").agg(F.count("*").alias("n"))


@query
def ds_shuffle(spark, d):
    return dataset.shuffled(ordered(spark, d), 7, size=32).select("sample_id", "pos", "tensor_id")


@query
def ds_permuted(spark, d):
    """A shuffle by a bijection of the places."""
    return dataset.permuted(ordered(spark, d), 7, size=32).select("sample_id", "pos", "tensor_id")


@query
def ds_relabel(spark, d):
    return dataset.relabelled(samples(spark, d), 3, 7).select("sample_id", "class_id")


# linear algebra


def value_query(name: str, f: Callable[[Column], Column], kind: str = "double") -> None:
    def run(spark, d):
        v = f(F.col("data")).cast(kind)
        return samples(spark, d).select(F.col("sample_id").alias("vec_id"), (r6(v) if kind == "double" else v).alias("v"))

    QUERIES[name] = run


value_query("la_sum", linalg.total)
value_query("la_asum", linalg.absolute_total)
value_query("la_l2norm", linalg.l2_norm)
value_query("la_imax_abs", linalg.argmax_absolute, "long")
value_query("la_imax", linalg.argmax, "long")


def array_query(name: str, f: Callable[[Column], Column]) -> None:
    QUERIES[name] = lambda spark, d: spread(samples(spark, d), f(F.col("data")), "v", "double")


array_query("la_scale", lambda x: linalg.scale(x, 2.5))
array_query("la_transpose", lambda x: linalg.transposed(x, SIDE, SIDE))
array_query("la_add", lambda x: linalg.add(x, linalg.transposed(x, SIDE, SIDE)))
array_query("la_sub", lambda x: linalg.sub(x, linalg.transposed(x, SIDE, SIDE)))
array_query("la_axpy", lambda x: linalg.add(x, linalg.transposed(x, SIDE, SIDE), -0.75))
array_query("la_hadamard", lambda x: linalg.hadamard(x, linalg.transposed(x, SIDE, SIDE)))
array_query("la_gemm_rows", lambda x: linalg.product(x, (SIDE, SIDE), x, (SIDE, SIDE), tb=True, alpha=2.0))


def embedding_matrix(spark, d):
    """The embeddings as one matrix of a row each, as coordinates."""
    return linalg.cells(samples(spark, d).select("sample_id", "data"), "data", N, "sample_id").select(F.col("sample_id").alias("i"), "j", "v")


def fixed_matrix(spark, rows, cols, a, b, m, s):
    """The matrix ((i * a + j * b) % m - s) / 100 as coordinates."""
    i, j = F.floor(F.col("id") / cols), F.col("id") % cols
    return spark.range(rows * cols).select(i.alias("i"), j.alias("j"), (((i * a + j * b) % m - s) / 100).alias("v"))


@query
def la_gemm(spark, d):
    """The embeddings times a matrix of 64 x 40."""
    return linalg.gemm(embedding_matrix(spark, d), fixed_matrix(spark, N, 40, 5, 11, 23, 11)).select("i", "j", r6("v").alias("v"))


@query
def la_gemm_ta(spark, d):
    """Twice the transposed embeddings times the classes as unit vectors: class sums."""
    classes = samples(spark, d).select(F.col("sample_id").alias("i"), F.col("class_id").alias("j"), F.lit(1.0).alias("v"))
    return linalg.gemm(embedding_matrix(spark, d), classes, ta=True, alpha=2.0).select("i", "j", F.round("v", 4).alias("v"))


@query
def la_gemm_tb(spark, d):
    """The embeddings times a transposed matrix of 40 x 64."""
    return linalg.gemm(embedding_matrix(spark, d), fixed_matrix(spark, 40, N, 7, 3, 19, 9), tb=True).select("i", "j", r6("v").alias("v"))


@query
def la_gemm_bias(spark, d):
    """Half of la_gemm and three times the embeddings' own first 40 columns."""
    x = embedding_matrix(spark, d)
    return linalg.gemm(x, fixed_matrix(spark, N, 40, 5, 11, 23, 11), alpha=0.5, beta=3.0, c=x.filter("j < 40")).select("i", "j", r6("v").alias("v"))


@query
def la_gram(spark, d):
    """The embeddings as one matrix of a row each, its transpose times itself."""
    x = embedding_matrix(spark, d)
    return linalg.gemm(x, x, ta=True).select("i", "j", F.round(F.col("v"), 4).alias("v"))


@query
def la_gram_tiled(spark, d):
    x = embedding_matrix(spark, d)
    return linalg.tiled_gemm(linalg.flipped(x), x, 32).select("i", "j", F.round(F.col("v"), 4).alias("v"))


@query
def la_filled(spark, d):
    return spread(samples(spark, d), linalg.filled(2, 3, 1.5), "v", "double")


@query
def la_random(spark, d):
    return spread(samples(spark, d), linalg.random(4, 5, -1.0, 1.0, 3, F.col("sample_id")), "v", "double")


@query
def la_random_padded(spark, d):
    return spread(samples(spark, d), linalg.random(4, 5, 0.5, 2.0, 4, F.col("sample_id"), padding=1), "v", "double")


@query
def la_gemm_tiled(spark, d):
    return linalg.tiled_gemm(embedding_matrix(spark, d), fixed_matrix(spark, N, 40, 5, 11, 23, 11), 16).select("i", "j", F.round(F.col("v") + 0.0, 6).alias("v")).filter(F.col("v") != 0)


def sample_cells(spark, d):
    return linalg.cells(samples(spark, d).withColumnRenamed("sample_id", "vec_id"), "data", SIDE, "vec_id")


@query
def ts_batched_gemm_mt(spark, d):
    """One 8 x 8 matrix times each sample."""
    i, j = F.floor(F.col("id") / SIDE), F.col("id") % SIDE
    w = spark.range(N).select(i.alias("i"), j.alias("j"), (((i * 7 + j * 3) % 19 - 9) / 100).alias("v"))
    return linalg.gemm(F.broadcast(w), sample_cells(spark, d), keys=("vec_id",), shared="a").select("vec_id", "i", "j", r6("v").alias("v"))


@query
def ts_batched_gemm_bias(spark, d):
    """The first four columns of a matrix times each sample, of every seventh the lower half alone, so that its product is empty; and half of another matrix for all."""
    i, j = F.floor(F.col("id") / SIDE), F.col("id") % SIDE
    cell = spark.range(N).select(i.alias("i"), j.alias("j"))
    w = cell.select("i", "j", (((F.col("i") * 7 + F.col("j") * 3) % 19 - 9) / 100).alias("v")).filter("j < 4")
    c = cell.select("i", "j", (((F.col("i") * 5 + F.col("j") * 11) % 23 - 11) / 100).alias("v"))
    b = sample_cells(spark, d).filter("vec_id % 7 <> 0 OR i >= 4")
    return linalg.gemm(F.broadcast(w), b, beta=0.5, c=c, keys=("vec_id",), shared="a").select("vec_id", "i", "j", r6("v").alias("v"))


@query
def ts_slice_of(spark, d):
    """The second of three parts."""
    rows = ordered(spark, d)
    return linalg.slice_of(rows, 3, 1, rows.count()).select("sample_id", "pos")


@query
def ts_batched_gemm_tt(spark, d):
    """Each sample times itself."""
    return spread(samples(spark, d), linalg.product(F.col("data"), (SIDE, SIDE), F.col("data"), (SIDE, SIDE)), "v", "double")


@query
def ts_sum_collapse(spark, d):
    return linalg.collapsed(sample_cells(spark, d)).select("i", "j", r6("v").alias("v"))


@query
def ts_slice(spark, d):
    return linalg.sliced(ordered(spark, d), 100, 150).select("sample_id", "pos")


@query
def ts_reshape(spark, d):
    flat = linalg.reshaped(samples(spark, d), 4, 16)
    return linalg.cells(flat.withColumnRenamed("sample_id", "vec_id"), "data", 16, "vec_id").select("vec_id", "i", "j", r6("v").alias("v"))


@query
def ts_tensor_sum(spark, d):
    """Each sample plus half the sample with the next id, as coordinates."""
    a = sample_cells(spark, d)
    b = a.withColumn("vec_id", F.col("vec_id") - 1).join(a.select("vec_id").distinct(), "vec_id", "left_semi")
    return linalg.summed(a, b, 1.0, 0.5, ("vec_id",)).select("vec_id", "i", "j", r6("v").alias("v"))


# activation functions

for _name, _slug in (("identity", "identity"), ("sigmoid", "sigmoid"), ("relu", "relu"), ("leakyRelu", "leaky_relu"), ("square", "square")):
    array_query(f"af_{_slug}", lambda x, n=_name: af.applied(x, n))
    array_query(f"af_{_slug}_derivative", lambda x, n=_name: af.derived(x, n))


# perceptrons


@query
def mlp_predict_2layer(spark, d):
    return spread(mlp.score_columns(samples(spark, d), wt.perceptron()), F.col("output"), "v", "double")


@query
def mlp_predict_blocks(spark, d):
    return spread(mlp.score_blocks(samples(spark, d).select("sample_id", "data"), wt.perceptron()), F.col("output"), "v", "double")


@query
def mlp_classify(spark, d):
    scored = mlp.classified(mlp.score_blocks(samples(spark, d).select("sample_id", "data"), wt.perceptron()))
    return scored.select(F.col("sample_id").alias("vec_id"), F.col("pred").cast("long").alias("pred"))


def after_steps(spark, d, steps: int, **how) -> DataFrame:
    model, optimiser = wt.perceptron(), training.Optimiser(rate=0.5, **how)
    rows = training.with_target(samples(spark, d), wt.CLASSES)
    for _ in range(steps):
        training.train_epoch(rows, model, optimiser)
    cells = [(n, o, k, float(w[o, k])) for n, w in enumerate(model.weights) for o, k in np.ndindex(w.shape)]
    return spark.createDataFrame(cells, "layer long, o long, k long, w double").withColumn("w", r6("w"))


@query
def mlp_sgd_step(spark, d):
    return after_steps(spark, d, 1)


@query
def mlp_momentum_step(spark, d):
    return after_steps(spark, d, 2, momentum=0.9)


@query
def mlp_decay_step(spark, d):
    return after_steps(spark, d, 2, decay=0.5)


@query
def mlp_decay_momentum_step(spark, d):
    return after_steps(spark, d, 2, momentum=0.9, decay=0.5)


@query
def mlp_train_epochs(spark, d):
    """Two epochs of three mini-batches, rated after each."""
    rows = with_position(training.with_target(samples(spark, d), wt.CLASSES), "sample_id")
    size = -(-table(spark, d, "embeddings").count() // 3)
    history = training.train(rows, rows, wt.perceptron(), training.Optimiser(rate=0.5, momentum=0.9), wt.CLASSES, 2, size)
    return history.select(F.col("epoch").cast("long").alias("epoch"), "class_id", *(r6(c).alias(c) for c in ("precision", "recall", "f1")))


@query
def mlp_minibatch_weights(spark, d):
    """The weights after the two epochs of mlp_train_epochs, each batch shared by several tasks."""
    ranks = min(4, spark.sparkContext.defaultParallelism)
    rows = with_position(training.with_target(samples(spark, d), wt.CLASSES), "sample_id")
    model, optimiser = wt.perceptron(), training.Optimiser(rate=0.5, momentum=0.9)
    for _ in range(2):
        training.train_epoch(rows, model, optimiser, -(-table(spark, d, "embeddings").count() // 3), ranks=ranks)
    return model.tables(spark)[0].select(*(F.col(c).cast("long").alias(c) for c in ("layer", "o", "k")), r6("w").alias("w"))


@query
def mlp_model_file(spark, d):
    """The outputs of a model that was written and read again."""
    path = f"{place(spark, 'model')}/model.txt"
    files.save_model(wt.perceptron(), path)
    return spread(mlp.score_blocks(samples(spark, d).select("sample_id", "data"), files.load_model(path)), F.col("output"), "v", "double")


@query
def ev_evolution(spark, d):
    """One epoch's ratings through the metrics sink."""
    path = place(spark, "metrics")
    # the epoch written twice, as by a run that was started again
    for _ in range(2):
        files.append_metrics(evaluate.evolution(4, label_pairs(spark, d), label_pairs(spark, d), 2), path)
    return spark.read.parquet(path).select(F.col("epoch").cast("long").alias("epoch"), F.col("split").cast("string").alias("split"), "class_id", *(r6(c).alias(c) for c in ("precision", "recall", "f1")))


# convolution


def image_data(spark, d):
    return images(spark, d).withColumn("data", F.transform("px", lambda p: p.cast("double")))


@query
def cnn_conv_valid(spark, d):
    return spread(image_data(spark, d), cnn.correlate(F.col("data"), (SIDE, SIDE), wt.CONV3), "v", "double")


@query
def cnn_conv_grouped(spark, d):
    """Both layers of convolution: (vec_id, f, p, v) for the four final branches."""
    net = wt.network()
    net.layers = net.layers[:2]
    out = cnn.forward(image_data(spark, d).select("sample_id", "data"), net)
    size = net.out[0] * net.out[1]
    flat = spread(out, F.col("features"), "v", "double")
    return flat.select("vec_id", F.floor(F.col("p") / size).alias("f"), (F.col("p") % size).alias("p"), "v")


@query
def cnn_max_pool(spark, d):
    return spread(image_data(spark, d), cnn.max_pool(F.col("data"), (SIDE, SIDE), (2, 2)), "v", "double")


@query
def cnn_avg_pool(spark, d):
    return spread(image_data(spark, d), cnn.avg_pool(F.col("data"), (SIDE, SIDE), (2, 2)), "v", "double")


@query
def cnn_avg_pool_backward(spark, d):
    """The 7 x 7 errors are the first 49 pixels."""
    return spread(image_data(spark, d), cnn.avg_pool_backward(F.slice("data", 1, 49), (SIDE, SIDE), (2, 2)), "v", "double")


@query
def cnn_max_pool_backward(spark, d):
    data = F.col("data")
    return spread(image_data(spark, d), cnn.max_pool_backward(F.slice("data", 1, 49), cnn.max_pool_places(data, (SIDE, SIDE), (2, 2)), (SIDE, SIDE), (2, 2)), "v", "double")


@query
def cnn_input_error(spark, d):
    return spread(image_data(spark, d), cnn.convolve_full(F.slice("data", 1, 36), (6, 6), wt.CONV3), "v", "double")


@query
def cnn_filter_gradient(spark, d):
    """Mean over the images of the gradient of a 3 x 3 filter; the 6 x 6 errors are the first 36 pixels."""
    rows = image_data(spark, d).select(cnn.correlate_maps(F.col("data"), (SIDE, SIDE), F.slice("data", 1, 36), (6, 6)).alias("g"))
    n = table(spark, d, "embeddings").count()
    return cnn.summed_maps(rows, ["g"]).select("p", r6(F.col("v") / n).alias("v"))


@query
def cnn_train_filters(spark, d):
    """The filter after a full-batch step of a linear network; the target is whether the id is odd."""
    net = cnn.CNN.from_text("8 8 identity convolution 1 3 3")
    net.layers[0].set_filters(wt.CONV3[None, None])
    head = mlp.MLP([36, 1], ["identity"], [wt.grid(1, 36, 7, 3, 19, 9)])
    rows = image_data(spark, d).select("data", F.array((F.col("sample_id") % 2).cast("double")).alias("target"))
    cnn.train_step(rows, net, head, 1e-3)
    return net.table(spark).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r6("w").alias("w"))


@query
def cnn_predict(spark, d):
    out = cnn.forward_blocks(image_data(spark, d).select("sample_id", "data"), wt.network())
    return spread(out, F.col("features"), "v", "double")


@query
def cnn_model_predict(spark, d):
    """A network and a linear head of two outputs over its features."""
    net = wt.network()
    head = mlp.MLP([net.output_size, 2], ["identity"], [wt.grid(2, net.output_size, 7, 3, 19, 9)], [wt.bias(2, 3, 7)])
    out = cnn.CNNModel(net, head).predict(image_data(spark, d).select("sample_id", "data"))
    return spread(out, F.col("output"), "v", "double")


@query
def cnn_model_files(spark, d):
    """A network and its head, written and read again; the features."""
    folder = place(spark, "network")
    files.save_cnn_model(spark, cnn.CNNModel(wt.network(), mlp.MLP.random([wt.network().output_size, 2], "relu", 0)), folder)
    net = files.load_cnn_model(spark, folder).net
    return spread(cnn.forward(image_data(spark, d).select("sample_id", "data"), net), F.col("features"), "v", "double")


@query
def cnn_split_features(spark, d):
    """The features cut into their maps again: (vec_id, f, p, v)."""
    out = cnn.forward(image_data(spark, d).select("sample_id", "data"), wt.network())
    maps = cnn.split_features(F.col("features"), wt.network())
    return reduce(DataFrame.unionByName, (spread(out, m, "v", "double").withColumn("f", F.lit(n).cast("long")) for n, m in enumerate(maps)))


# evaluation


def label_pairs(spark, d):
    return table(spark, d, "labels").select(F.col("quality").cast("long").alias("pred"), F.col("toxic").cast("long").alias("truth"))


def class_pairs(spark, d):
    scored = mlp.classified(mlp.score_blocks(samples(spark, d).select("class_id", "data"), wt.perceptron()))
    return scored.select(F.col("pred").cast("long").alias("pred"), F.col("class_id").alias("truth"))


@query
def ev_confusion(spark, d):
    return evaluate.confusion(label_pairs(spark, d))


@query
def ev_confusion_dense(spark, d):
    return evaluate.dense_confusion(class_pairs(spark, d), wt.CLASSES)


@query
def ev_precision_recall_f1(spark, d):
    return evaluate.per_class(class_pairs(spark, d), wt.CLASSES).select("class_id", "tp", "predicted", "actual", *(r6(c).alias(c) for c in ("precision", "recall", "f1")))


@query
def ev_macro(spark, d):
    return evaluate.macro(label_pairs(spark, d), 2).select(*(r6(c).alias(c) for c in ("precision", "recall", "f1")))


@query
def feat_score_lineitem(spark, d):
    """A linear layer of three classes over four features, and how its choices agree with the return flag."""
    w = [[0.01, -0.00001, 3.0, -2.0], [-0.02, 0.00002, -1.0, 4.0], [0.015, -0.00001, -2.0, 1.0]]
    x = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    scores = F.array(*(sum((F.col(c) * v for c, v in zip(x[1:], row[1:], strict=True)), F.col(x[0]) * row[0]) for row in w))
    pred = linalg.argmax_absolute(F.col("s")).cast("long")
    truth = F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("l_returnflag")) - 1
    return evaluate.confusion(table(spark, d, "lineitem").select(scores.alias("s"), "l_returnflag").select(pred.alias("pred"), truth.cast("long").alias("truth")))


@query
def template_classifier(spark, d):
    """The flagship: invert, binarise, scale; the class means as one linear layer; argmax; precision and recall by class."""
    prepared = pixels.TransformEngine("inversion", "binaryscale").apply(images(spark, d), SIDE, SIDE)
    rows = prepared.select("sample_id", "class_id", pixels.normalise(F.col("px")).alias("data"))
    cells = spread_out(rows.select("class_id", "data"), "data", "v")
    means = cells.groupBy("class_id", "p").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    template = means.groupBy("class_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "s", "n"))), lambda c: (c["s"] * 1000 / c["n"]).cast("long")).alias("w"))
    # as many rows as classes
    layer = template.agg(F.sort_array(F.collect_list(F.struct("class_id", "w"))).alias("layer"))
    dot = lambda w, x: F.aggregate(F.zip_with(w, x, lambda a, b: a * b.cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    scored = rows.crossJoin(F.broadcast(layer)).select("class_id", "layer", F.transform("layer", lambda c: dot(c["w"], F.col("data"))).alias("scores"))
    picked = scored.select(F.get("layer", (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))["class_id"].alias("pred"), F.col("class_id").alias("truth"))
    return evaluate.per_class(picked, wt.CLASSES).select("class_id", "tp", "predicted", "actual", *(r6(c).alias(c) for c in ("precision", "recall", "f1")))
