"""Small files: models, networks, transform lists, logs, states of a run; and the sink of metrics.

A path with a scheme is opened by Arrow's file system for it, so a file can lie
where all machines see it; one without is the driver's own.
"""

from __future__ import annotations

import io
import json
import logging
import os

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from pixelloom.operators.cnn import CNN, CNNModel
from pixelloom.operators.mlp import MLP, from_text, to_text
from pixelloom.operators.pixels import TransformEngine
from pixelloom.operators.training import Optimiser


def located(path: str) -> tuple[pafs.FileSystem, str]:
    path = os.fspath(path)
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def exists(path: str) -> bool:
    fs, at = located(path)
    return fs.get_file_info(at).type != pafs.FileType.NotFound


def write_bytes(path: str, raw: bytes) -> None:
    fs, at = located(path)
    fs.create_dir(os.path.dirname(at))
    with fs.open_output_stream(at) as f:
        f.write(raw)


def write_text(path: str, text: str) -> None:
    write_bytes(path, text.encode())


def read_text(path: str) -> str:
    fs, at = located(path)
    with fs.open_input_file(at) as f:
        return f.read().decode()


class LogFile(logging.Handler):
    """Log records as lines of a new text file, on whatever file system its path names."""

    def __init__(self, path: str, level: int = logging.INFO):
        super().__init__(level)
        self.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        fs, at = located(path)
        fs.create_dir(os.path.dirname(at))
        self.stream = fs.open_output_stream(at)

    def emit(self, record: logging.LogRecord) -> None:
        self.stream.write((self.format(record) + "\n").encode())
        self.stream.flush()

    def close(self) -> None:
        if not self.stream.closed:
            self.stream.close()
        super().close()


def save_model(model: MLP, path: str) -> None:
    write_text(path, to_text(model))


def load_model(path: str) -> MLP:
    return from_text(read_text(path))


def save_cnn_model(spark: SparkSession, model: CNNModel, folder: str) -> None:
    """Topology and head as text, filters as a table with all their digits."""
    write_text(f"{folder}/topology.txt", model.net.to_text() + "\n")
    write_text(f"{folder}/head.txt", to_text(model.head))
    model.net.table(spark).write.mode("overwrite").parquet(f"{folder}/filters")


def load_cnn_model(spark: SparkSession, folder: str) -> CNNModel:
    net = CNN.from_text(read_text(f"{folder}/topology.txt"))
    return CNNModel(net.read(spark.read.parquet(f"{folder}/filters")), load_model(f"{folder}/head.txt"))


def transforms_to_text(engine: TransformEngine) -> str:
    """One transform per line, its parameters behind the name."""
    return "".join(" ".join(map(str, s)) + "\n" for s in engine.steps)


def transforms_from_text(text: str) -> TransformEngine:
    """An unknown name raises ValueError."""
    lines = (x.split() for x in text.splitlines() if x.strip())
    return TransformEngine(*((name, *map(int, params)) for name, *params in lines))


def save_transforms(engine: TransformEngine, path: str) -> None:
    write_text(path, transforms_to_text(engine))


def load_transforms(path: str) -> TransformEngine:
    """A missing file raises FileNotFoundError."""
    return transforms_from_text(read_text(path))


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Puts rows (epoch, split, class_id, precision, recall, f1) into a table that is partitioned by epoch and split.

    A repeated epoch replaces its rows; other epochs stay.
    """
    metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch", "split").parquet(path)


# states of a training run

DONE = "_DONE"


def save_state(model: MLP | CNNModel, optimiser: Optimiser, folder: str, settings: dict) -> None:
    """All that a run needs to go on after an epoch: weights, biases and velocities with all their digits, and the settings.

    The folder holds one of each epoch; one counts when its marker, written last, is
    there. Those of earlier epochs go, but for the one before.
    """
    epoch = optimiser.epoch
    held = {f"w{i}": w for i, w in enumerate(model.weights)} | {f"b{i}": b for i, b in enumerate(model.biases)}
    held |= {f"v{kind}{i}": v for (kind, i), v in optimiser.velocity.items()}
    raw = io.BytesIO()
    np.savez(raw, **held)
    write_bytes(f"{folder}/{epoch}/state.npz", raw.getvalue())
    write_text(f"{folder}/{epoch}/settings.json", json.dumps(settings, sort_keys=True))
    write_text(f"{folder}/{epoch}/{DONE}", "")
    fs, at = located(folder)
    for found in fs.get_file_info(pafs.FileSelector(at)):
        if found.base_name.isdigit() and int(found.base_name) < epoch - 1:
            fs.delete_dir(found.path)


def last_state(folder: str) -> int | None:
    """The epochs behind the last state that counts."""
    fs, at = located(folder)
    found = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True, recursive=True))
    return max((int(f.path.split("/")[-2]) for f in found if f.base_name == DONE), default=None)


def load_state(model: MLP | CNNModel, optimiser: Optimiser, folder: str, epoch: int, settings: dict) -> None:
    """Sets model and optimiser; a state of other settings raises ValueError."""
    told = json.loads(read_text(f"{folder}/{epoch}/settings.json"))
    if told != json.loads(json.dumps(settings)):
        differing = sorted(k for k in told.keys() | settings.keys() if told.get(k) != json.loads(json.dumps(settings)).get(k))
        raise ValueError(f"the run was started with other settings: {', '.join(differing)}")
    fs, at = located(f"{folder}/{epoch}/state.npz")
    with fs.open_input_file(at) as f:
        held = np.load(io.BytesIO(f.read()))
    model.weights = [held[f"w{i}"] for i in range(len(model.weights))]
    model.biases = [held[f"b{i}"] for i in range(len(model.biases))]
    optimiser.velocity = {(k[1], int(k[2:])): held[k] for k in held.files if k[0] == "v"}
    optimiser.epoch = epoch
