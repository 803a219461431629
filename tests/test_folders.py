"""Class folders of all formats, headers, and training runs that are resumed."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom import program
from pixelloom.operators import mlp, training
from pixelloom.plans import queries as plans
from pixelloom.sources import files, images


@pytest.fixture
def mixed(tmp_path):
    """Two classes, their names with a space, in six formats; one broken file each."""
    rng = np.random.default_rng(0)
    for c in ("a b%+", "c"):
        (tmp_path / c).mkdir()
        px = rng.integers(0, 256, 12)
        (tmp_path / c / "0.PNG").write_bytes(images.encode_png(px, 4, 3))
        (tmp_path / c / "1.pgm").write_bytes(b"P5 4 3 255\n" + px.astype(np.uint8).tobytes())
        (tmp_path / c / "2.tga").write_bytes(bytes([0, 0, 3, *[0] * 9, 4, 0, 3, 0, 8, 0x20]) + px.astype(np.uint8).tobytes())
        (tmp_path / c / "3.png").write_bytes(b"broken")
        (tmp_path / c / "4.pgm").write_bytes(b"P5 4 3 255\n")
        (tmp_path / c / "notes.txt").write_text("no image")
    return tmp_path


def test_all_formats_load_by_class(spark, mixed):
    rows = images.load_with_classes(spark, str(mixed)).orderBy("sample_id").collect()
    got = [(r.sample_id, r.class_id, r.class_name, os.path.basename(r.path)) for r in rows]
    assert got == [(5 * c + k, c, name, f) for c, name in enumerate(("a b%+", "c")) for k, f in enumerate(("0.PNG", "1.pgm", "2.tga"))]
    assert all(rows[3 * c].px == rows[3 * c + k].px and rows[3 * c].width == 4 for c in (0, 1) for k in (1, 2))
    assert len(images.load_with_classes(spark, str(mixed), cap=2).collect()) == 4
    flat = images.load_without_classes(spark, str(mixed)).collect()
    assert sorted(r.sample_id for r in flat) == [0, 1, 2, 5, 6, 7] and {r.class_id for r in flat} == {-1}


def test_pixels_are_decoded_once(spark, mixed, monkeypatch):
    """Numbers and classes come from names: what is decoded has one scan in the plan, and nothing else reads contents."""
    made = []
    monkeypatch.setattr(images, "decoded", lambda *a, f=images.decoded: made.append("image") or f(*a))
    monkeypatch.setattr(images, "scan_other", lambda *a, f=images.scan_other: made.append("other") or f(*a))
    loaded = images.load_with_classes(spark, str(mixed))
    assert sorted(made) == ["image", "other"]
    assert loaded._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    listing = images.listed(spark, f"{mixed}/*/")
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_small_files_share_tasks(spark, tmp_path):
    """A partition for each file, as with the megabytes that Spark counts for opening one, is no task for each file."""
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        rows = spark.range(600).select(F.col("id").alias("sample_id"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.array((F.col("id") % 256).cast("int")).alias("px"))
        assert images.write_png(rows, f"{tmp_path}/c") == 600
        few = max(images.WAVES * spark.sparkContext.defaultParallelism, 600 // images.SCANNED_TOGETHER + 1)
        assert spark.read.format("binaryFile").load(f"{tmp_path}/c").select("path").rdd.getNumPartitions() == 600
        for f in (images.opened, images.listed, images.info, images.load_directory):
            assert f(spark, f"{tmp_path}/c").rdd.getNumPartitions() <= few, f
        # the numbering deals the names out by ranges, and the optimizer joins neighbouring repartitions into one
        dealt = images.listed(spark, f"{tmp_path}/c").drop("class_name").repartitionByRange(4, "file")
        assert f"Repartition {few}, false" in dealt._jdf.queryExecution().optimizedPlan().toString()
        (tmp_path / "c" / "one.PGM").write_bytes(b"P5 1 1 255\n\7")
        others = images.scan_other(spark, str(tmp_path))
        assert others.rdd.getNumPartitions() == 1 and [r.px for r in others.collect()] == [[7]]
        (tmp_path / "c" / "one.PGM").unlink()
        for loaded in (images.load_without_classes(spark, str(tmp_path)), images.load_with_classes(spark, str(tmp_path))):
            got = {os.path.basename(r.path): (r.sample_id, r.px) for r in loaded.collect()}
            assert got == {f: (k, [int(f[:-4]) % 256]) for k, f in enumerate(sorted(f"{n}.png" for n in range(600)))}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_folders_of_a_column_are_written_in_one_pass(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(n, c, 1, 1, [n]) for n, c in ((1, "a"), (2, "b"), (3, "a"), (4, None))], "sample_id long, c string, width int, height int, px array<int>")
    assert images.write_png(rows, str(tmp_path / "x"), within=F.col("c")) == 4
    assert {os.path.relpath(os.path.join(d, f), tmp_path / "x") for d, _, names in os.walk(tmp_path / "x") for f in names} == {"a/1.png", "b/2.png", "a/3.png", "4.png"}
    calls = []
    monkeypatch.setattr(images, "write_png", lambda *a, f=images.write_png, **k: calls.append(a) or f(*a, **k))
    for name in ("img_without_classes", "img_write_and_load"):
        plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(calls) == 2


def test_a_folder_is_listed_once_for_names_and_contents(spark, mixed, monkeypatch):
    """The contents of other formats are taken from the files that the names came from."""
    made = []
    monkeypatch.setattr(images, "all_files", lambda *a, f=images.all_files: made.append(a) or f(*a))
    assert {r.path.rsplit(".", 1)[1] for r in images.load_without_classes(spark, str(mixed)).collect()} == {"PNG", "pgm", "tga"}
    assert len(made) == 1


def test_headers(spark, mixed):
    (mixed / "c" / "5.ppm").write_bytes(b"P6\n# x\n7 2\n255\n" + bytes(42))
    (mixed / "c" / "6.jpg").write_bytes(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x09\x00\x0c\x03" + bytes(20))
    (mixed / "c" / "7.gif").write_bytes(b"GIF89a" + bytes([5, 0, 6, 0]) + bytes(9))
    (mixed / "c" / "8.bmp").write_bytes(b"BM" + bytes(16) + (3).to_bytes(4, "little") + (8).to_bytes(4, "little") + bytes(9))
    got = {os.path.basename(r.path): tuple(r)[1:] for r in images.info(spark, str(mixed / "c")).collect()}
    assert got == {"0.PNG": (4, 3, 1), "1.pgm": (4, 3, 1), "2.tga": (4, 3, 1), "4.pgm": (4, 3, 1), "5.ppm": (7, 2, 3), "6.jpg": (12, 9, 3), "7.gif": (5, 6, 3), "8.bmp": (3, 8, 3)}
    assert images.header(memoryview(b"")) is None and images.header(memoryview(b"\xff\xd8\xff")) is None


@pytest.fixture
def pictures(tmp_path):
    for s, n in (("train", 10), ("eval", 4)):
        for c, name in enumerate(("left", "right")):
            (tmp_path / "in" / s / name).mkdir(parents=True)
            for k in range(n):
                px = np.tile(np.where((np.arange(6) < 3) == (c == 0), 20 + k, 230 - k), (5, 1))
                (tmp_path / "in" / s / name / f"{k}.png").write_bytes(images.encode_png(px.ravel(), 6, 5))
    return tmp_path


SETTINGS = training.Settings(image_side=4, tensor_size=5, batch_size=4, epochs=4, rate=0.3, hidden=(6,), function="sigmoid")


@pytest.mark.parametrize("where", ["train", "metrics", "state"])
def test_a_broken_run_goes_on(spark, pictures, monkeypatch, where):
    """Stopped in its third epoch, before, between or within what it writes: the same weights, and one row of metrics for each epoch, set and class."""
    whole = program.run(spark, str(pictures / "in"), str(pictures / "whole"), SETTINGS, "decay-momentum")
    out, calls = str(pictures / "broken"), []

    def failing(module, name):
        real = getattr(module, name)

        def run(*a, **k):
            calls.append(name)
            if len(calls) == 3:
                if where == "state":
                    # the numbers are there, the marker is not
                    monkeypatch.setattr(files, "write_text", lambda *b: (_ for _ in ()).throw(RuntimeError("killed")))
                    return real(*a, **k)
                raise RuntimeError("killed")
            return real(*a, **k)

        monkeypatch.setattr(module, name, run)

    failing(*{"train": (training, "train_epoch"), "metrics": (files, "append_metrics"), "state": (files, "save_state")}[where])
    with pytest.raises(RuntimeError):
        program.run(spark, str(pictures / "in"), out, SETTINGS, "decay-momentum")
    monkeypatch.undo()
    assert files.last_state(f"{out}/states") == 2
    with pytest.raises(FileExistsError):
        program.run(spark, str(pictures / "in"), out, SETTINGS, "decay-momentum")
    with pytest.raises(ValueError, match="rate"):
        program.run(spark, str(pictures / "in"), out, training.Settings(**{**vars(SETTINGS), "rate": 0.1}), "decay-momentum", resume=True)
    model = program.run(spark, str(pictures / "in"), out, SETTINGS, "decay-momentum", resume=True)
    assert all(np.array_equal(a, b) for a, b in zip(model.weights, whole.weights, strict=True))
    rows = [spark.read.parquet(f"{o}/model_evolution").orderBy("epoch", "split", "class_id").collect() for o in (out, str(pictures / "whole"))]
    assert rows[0] == rows[1] and len(rows[0]) == 4 * 2 * 3
    assert os.path.exists(f"{out}/logs-2.txt")
    # a run that is complete ends at once, and may be given more epochs
    again = program.run(spark, str(pictures / "in"), out, SETTINGS, "decay-momentum", resume=True)
    assert np.array_equal(again.weights[0], model.weights[0])
    program.run(spark, str(pictures / "in"), out, training.Settings(**{**vars(SETTINGS), "epochs": 5}), "decay-momentum", resume=True)
    assert spark.read.parquet(f"{out}/model_evolution").count() == 5 * 2 * 3
    assert sorted(n for n in os.listdir(f"{out}/states")) == ["4", "5"]


def test_states(spark, tmp_path):
    folder = str(tmp_path / "states")
    assert files.last_state(folder) is None
    model, rule = mlp.MLP.random([3, 2], "sigmoid", 0), training.Optimiser(0.1, 0.9, 0.5, train_biases=True)
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0], [1.0, 0.0])], "pos long, data array<double>, target array<double>")
    training.train_epoch(df, model, rule, 1)
    files.save_state(model, rule, folder, {"a": (1, 2)})
    other, fresh = mlp.MLP.random([3, 2], "sigmoid", 1), training.Optimiser(0.1, 0.9, 0.5, train_biases=True)
    files.load_state(other, fresh, folder, 1, {"a": (1, 2)})
    assert fresh.epoch == 1 and np.array_equal(other.weights[0], model.weights[0]) and np.array_equal(other.biases[0], model.biases[0])
    assert fresh.velocity.keys() == rule.velocity.keys() and all(np.array_equal(fresh.velocity[k], rule.velocity[k]) for k in rule.velocity)
    with pytest.raises(ValueError, match="a"):
        files.load_state(other, fresh, folder, 1, {"a": 3})


def test_repeated_metrics_replace(spark, tmp_path):
    schema = "epoch int, split string, class_id long, precision double, recall double, f1 double"
    at = str(tmp_path / "m")
    for epoch, f1 in ((0, 0.1), (1, 0.2), (1, 0.3), (2, 0.4)):
        files.append_metrics(spark.createDataFrame([(epoch, s, c, 0.0, 0.0, f1) for s in ("eval", "train") for c in (0, None)], schema), at)
    rows = spark.read.parquet(at)
    assert rows.count() == 12 and {(r.epoch, r.f1) for r in rows.filter(F.col("class_id").isNull()).collect()} == {(0, 0.1), (1, 0.3), (2, 0.4)}
