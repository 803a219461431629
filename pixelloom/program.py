"""The training program: from folders of labelled images to a trained perceptron.

    python -m pixelloom.program INPUT OUTPUT [--epochs 75] [--batch-size 16] [--optimiser sgd] ...

INPUT holds train/<class>/<image> and eval/<class>/<image>. OUTPUT gets

* samples: the transformed images of both sets as a table, which every epoch reads,
* states: weights and velocities of the last epochs, each with a marker that is
  written when all of its epoch is,
* model.txt: the model after the last epoch that was finished,
* model_evolution: precision, recall and F1 of every epoch, set and class,
* logs.txt, and logs-2.txt and so on of resumed runs.

Images may differ in size; broken ones are dropped. An OUTPUT that already has
samples is refused, so two runs never mix their metrics, unless the run is to be
resumed: then it goes on behind the last marked epoch, with the weights and
metrics of a run that never stopped. A broken-off epoch is done again.
"""

from __future__ import annotations

import argparse
import itertools
import logging
import time
from dataclasses import asdict, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators import dataset, evaluate, training
from pixelloom.operators.mlp import MLP, classified, score_blocks
from pixelloom.operators.pixels import TransformationPipeline, TransformEngine, normalise
from pixelloom.schema import UNLABELLED
from pixelloom.session import build_session
from pixelloom.sources import files, images

log = logging.getLogger("pixelloom")
#: Which of the settings' momentum and decay an optimiser uses.
OPTIMISERS = {"sgd": (False, False), "momentum": (True, False), "decay": (False, True), "decay-momentum": (True, True)}


def optimiser(kind: str, settings: training.Settings) -> training.Optimiser:
    """By name; an unknown one raises ValueError."""
    if kind not in OPTIMISERS:
        raise ValueError(f"unknown optimiser: {kind}")
    momentum, decay = OPTIMISERS[kind]
    return training.Optimiser(settings.rate, settings.momentum * momentum, settings.decay * decay)


def prepared(spark: SparkSession, path: str, settings: training.Settings, pre: TransformEngine, post: TransformEngine, seed: int) -> DataFrame:
    """(split, pos, tensor_id, class_id, data, target), each split shuffled."""
    side = settings.image_side
    found = images.load_collection(spark, path)
    small = TransformationPipeline(side, side, pre, post).apply(found, F.col("width"), F.col("height"))
    classes = found.filter(F.col("class_id") != UNLABELLED).agg(F.max("class_id") + 1).first()[0]
    rows = training.with_target(small.select("split", "sample_id", "class_id", normalise(F.col("px")).alias("data")), classes)
    train, evaluation = (dataset.shuffled(rows.filter(F.col("split") == s), seed, size=settings.tensor_size) for s in ("train", "eval"))
    return train.unionByName(evaluation).select("split", "pos", "tensor_id", "class_id", "data", "target")


def attempt_log(out: str) -> str:
    n = next(n for n in itertools.count(1) if not files.exists(f"{out}/logs{'' if n == 1 else f'-{n}'}.txt"))
    return f"{out}/logs{'' if n == 1 else f'-{n}'}.txt"


def run(
    spark: SparkSession,
    path: str,
    out: str,
    settings: training.Settings = training.Settings(),
    kind: str = "sgd",
    workers: int = 1,
    seed: int = 0,
    pre: TransformEngine | None = None,
    post: TransformEngine | None = None,
    ranks: int | None = None,
    resume: bool = False,
) -> MLP:
    """Trains on the images under `path`, writes what the module says, and returns the model."""
    rule = optimiser(kind, settings)
    pre, post = pre or TransformEngine("inversion"), post or TransformEngine("binaryscale")
    if files.exists(f"{out}/samples") and not resume:
        raise FileExistsError(f"{out}/samples already exists")
    # what a resumed run must share with the first one; it may go on to more epochs
    shared = {k: v for k, v in asdict(settings).items() if k != "epochs"} | {"optimiser": kind, "workers": workers, "seed": seed, "transforms": files.transforms_to_text(pre) + files.transforms_to_text(post)}
    sink = files.LogFile(attempt_log(out))
    log.addHandler(sink)
    log.setLevel(min(log.level or logging.INFO, logging.INFO))
    try:
        if not files.exists(f"{out}/samples/_SUCCESS"):
            rows = prepared(spark, path, settings, pre, post, seed)
            rows.write.mode("overwrite").partitionBy("split").parquet(f"{out}/samples")
        rows = spark.read.parquet(f"{out}/samples")
        train, evaluation = (rows.filter(F.col("split") == s) for s in ("train", "eval"))
        classes = len(train.select("target").first().target)
        model = MLP.random([settings.image_side**2, *settings.hidden, classes], settings.function, seed)
        log.info("%d samples to train on, %d to evaluate, %d classes, %d weights", train.count(), evaluation.count(), classes, model.cells)
        if (done := files.last_state(f"{out}/states")) is not None:
            files.load_state(model, rule, f"{out}/states", done, shared)
            files.save_model(model, f"{out}/model.txt")
            log.info("going on after %d epochs", done)
        for epoch in range(rule.epoch, settings.epochs):
            began = time.monotonic()
            training.train_epoch(train, model, rule, settings.batch_size, workers, ranks)
            pairs = [classified(score_blocks(d.select("class_id", "data"), model)).select("pred", F.col("class_id").alias("truth")) for d in (train, evaluation)]
            # a row for each class and set: small enough to be held for the log and the file alike
            rated = evaluate.evolution(epoch, *pairs, classes)
            held = rated.collect()
            files.append_metrics(spark.createDataFrame(held, rated.schema).coalesce(1), f"{out}/model_evolution")
            files.save_state(model, rule, f"{out}/states", shared)
            files.save_model(model, f"{out}/model.txt")
            f1 = next(r.f1 for r in held if r.split == "eval" and r.class_id is None)
            log.info("epoch %d took %.0f ms, macro f1 %.4f", epoch, 1000 * (time.monotonic() - began), f1)
        return model
    except Exception:
        log.exception("the run failed")
        raise
    finally:
        log.removeHandler(sink)
        sink.close()


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m pixelloom.program", description="Train a perceptron on folders of labelled images.")
    parser.add_argument("input")
    parser.add_argument("output", nargs="?", default="runs/test")
    parser.add_argument("--optimiser", choices=OPTIMISERS, default="sgd")
    parser.add_argument("--workers", type=int, default=1, help="ranges that step on their own and are averaged each epoch")
    parser.add_argument("--ranks", type=int, default=None, help="tasks that share each batch; by default as the batch is large")
    parser.add_argument("--resume", action="store_true", help="go on after the last finished epoch in OUTPUT")
    parser.add_argument("--seed", type=int, default=0)
    for f in fields(training.Settings):
        if isinstance(f.default, (int, float)):
            parser.add_argument(f"--{f.name.replace('_', '-')}", type=type(f.default), default=f.default)
    parser.add_argument("--hidden", type=lambda t: tuple(map(int, t.split(","))), default=training.Settings.hidden)
    parser.add_argument("--function", default=training.Settings.function)
    given = vars(parser.parse_args(arguments))
    settings = replace(training.Settings(), **{f.name: given[f.name] for f in fields(training.Settings)})
    spark = SparkSession.getActiveSession() or build_session()
    run(spark, given["input"], given["output"], settings, given["optimiser"], given["workers"], given["seed"], ranks=given["ranks"], resume=given["resume"])


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO)
    main()
