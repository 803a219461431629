"""Filters of images by numpy: whole images in Arrow batches, and images that do not fit a row as tiles.

A large image is a table of tiles (image, width, height, ty, tx, px), each `side`
pixels square but for the last of a row or column. A filter that sees `half`
pixels around its own needs a halo of as many: every tile sends the strips that
its neighbours need, and a task puts a tile and its strips together, filters it
and goes on to the next. So a tile and its halo are all that is in memory, and the image
is shuffled once.

Results are those of the column expressions in `pixels`, also at tile borders:
the blur runs over rows and then columns, 22 taps instead of 121, and where its
sum lies so near a whole number that rounding could decide, it is summed again
tap by tap in the order of the expression.

Rows: broken or empty arrays raise in the task; pixels outside the image count
as 0 and, as in `pixels`, places nearer to the border than `half` become 0; a
tile that is missing counts as black; repeated tiles: the last in order counts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators.pixels import BLUR_SIDE, BLUR_SIGMA, BRIGHTEST, EDGE, blur_kernel

#: Distance from a whole number within which a blurred pixel is summed again.
NEAR = 1e-6
#: Pixels of tiles that a batch carries on.
BATCH_PIXELS = 1 << 22
TILE = "image string, width int, height int, ty int, tx int, px array<int>"
Filter = Callable[[np.ndarray], np.ndarray]


def blurred(a: np.ndarray, side: int = BLUR_SIDE, sigma: float = BLUR_SIGMA) -> np.ndarray:
    """The Gaussian of every place whose window lies in the array, cut to integers."""
    h, w = a.shape[0] - side + 1, a.shape[1] - side + 1
    if h < 1 or w < 1:
        return np.zeros((max(h, 0), max(w, 0)), np.int32)
    a = a.astype(float)
    bell = np.exp(-((np.arange(side) - side // 2) ** 2) / (2 * sigma * sigma))
    down = sum(a[k : k + h] * bell[k] for k in range(side))
    sums = sum(down[:, k : k + w] * bell[k] for k in range(side)) / (2 * np.pi * sigma * sigma)
    # a sum of exactly 0 has no bright pixel in its window
    y, x = np.nonzero((np.abs(sums - np.rint(sums)) < NEAR) & (sums != 0))
    if len(y):
        kernel, again = blur_kernel(side, sigma), np.zeros(len(y))
        for dy, dx in np.ndindex(kernel.shape):
            again = again + a[y + dy, x + dx] * kernel[dy, dx]
        sums[y, x] = again
    return np.floor(sums).astype(np.int32)


def edged(a: np.ndarray, threshold: int = EDGE) -> np.ndarray:
    """255 where the Sobel sums of a 3 x 3 window together reach the threshold, else 0."""
    h, w = a.shape[0] - 2, a.shape[1] - 2
    if h < 1 or w < 1:
        return np.zeros((max(h, 0), max(w, 0)), np.int32)
    a = a.astype(np.int32)
    across, along = a[:, 2:] - a[:, :-2], a[2:] - a[:-2]
    gx = across[:-2] + 2 * across[1:-1] + across[2:]
    gy = along[:, :-2] + 2 * along[:, 1:-1] + along[:, 2:]
    return np.where(np.abs(gx) + np.abs(gy) >= threshold, BRIGHTEST, 0).astype(np.int32)


#: Filters by the names that transforms have, with the pixels they see on each side.
FILTERS: dict[str, tuple[int, Filter]] = {"filter": (BLUR_SIDE // 2, blurred), "edges": (1, edged)}


def chosen(name: str) -> tuple[int, Filter]:
    if name not in FILTERS:
        raise ValueError(f"unknown filter: {name}")
    return FILTERS[name]


def filtered(images: DataFrame, name: str) -> DataFrame:
    """images (px, width, height and more) with px filtered; sizes may differ by row."""
    half, run_filter = chosen(name)
    names = [*(c for c in images.columns if c not in ("px", "width", "height")), "width", "height", "px"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for w, h, px in zip(batch.column(-3).to_pylist(), batch.column(-2).to_pylist(), batch.column(-1), strict=True):
                out = np.zeros((h, w), np.int32)
                inner = run_filter(np.asarray(px.values).reshape(h, w))
                out[half : half + inner.shape[0], half : half + inner.shape[1]] = inner
                done.append(out.ravel())
            if done:
                ends = np.cumsum([0, *map(len, done)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(ends, np.concatenate(done))], names=names)

    rows = images.select(*(c for c in names if c != "px"), F.col("px").cast("array<int>").alias("px"))
    return rows.mapInArrow(run, rows.schema).select(*images.columns)


def tile_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    *plain, px = zip(*rows, strict=True)
    ends = np.cumsum([0, *map(len, px)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(ends, np.concatenate(px).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(plain[0], pa.string()), *(pa.array(c, pa.int32()) for c in plain[1:]), lists], names=names)


def sent(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size out of rows (image, numbers..., px)."""
    held, pixels = [], 0
    for row in rows:
        held.append(row)
        pixels += len(row[-1])
        if pixels >= BATCH_PIXELS:
            yield tile_batch(held, names)
            held, pixels = [], 0
    if held:
        yield tile_batch(held, names)


TILE_NAMES = ["image", "width", "height", "ty", "tx", "px"]


def cut(images: DataFrame, side: int, name: str = "sample_id") -> DataFrame:
    """Tiles of images that come as whole rows; `image` is `name` as a string."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for image, w, h, px in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                a = np.asarray(px.values).reshape(h, w)
                for ty, tx in np.ndindex(-(-h // side), -(-w // side)):
                    yield image, w, h, ty, tx, a[ty * side : (ty + 1) * side, tx * side : (tx + 1) * side].ravel()

    read = images.select(F.col(name).cast("string"), "width", "height", F.col("px").cast("array<int>"))
    return read.mapInArrow(lambda batches: sent(rows(batches), TILE_NAMES), TILE)


def from_lines(lines: DataFrame, width: int, height: int, side: int) -> DataFrame:
    """Tiles of images that come as lines (image, y, px) of one size; a task holds `side` lines. A missing line is black, of repeated ones the last in order counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, strip = None, None

        def tiles() -> Iterator[tuple]:
            for tx in range(-(-width // side)):
                yield now[0], width, height, now[1], tx, strip[:, tx * side : (tx + 1) * side].ravel()

        for batch in batches:
            for image, ty, y, px in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if (image, ty) != now:
                    if now:
                        yield from tiles()
                    now, strip = (image, ty), np.zeros((min(side, height - ty * side), width), np.int32)
                strip[y - ty * side] = np.asarray(px.values)
        if now:
            yield from tiles()

    ty = F.floor(F.col("y") / side).cast("int").alias("ty")
    read = lines.filter(F.col("y").between(0, height - 1)).select(F.col("image").cast("string"), ty, F.col("y").cast("int"), F.col("px").cast("array<int>"))
    return read.repartition("image", "ty").sortWithinPartitions("image", "ty", "y", "px").mapInArrow(lambda batches: sent(rows(batches), TILE_NAMES), TILE)


def pgm_header(fs: pafs.FileSystem, at: str) -> tuple[int, int, int, int]:
    """(width, height, brightest value, first byte of the pixels) of a binary PGM file."""
    with fs.open_input_file(at) as f:
        found = re.match(rb"P5(?:\s|#[^\n]*\n)+?(\d+)(?:\s|#[^\n]*\n)+?(\d+)(?:\s|#[^\n]*\n)+?(\d+)\s", f.read(1 << 16))
    if not found:
        raise ValueError(f"not a binary PGM file: {at}")
    return *(int(v) for v in found.groups()), found.end()


def scan_tiles(spark: SparkSession, paths: list[str], side: int) -> DataFrame:
    """Tiles of large binary PGM files, each strip of tiles read by its own byte range; only headers are read to plan."""
    strips = []
    for path in paths:
        uri = path if "://" in path else f"file://{os.path.abspath(path)}"
        w, h, top, at = pgm_header(*pafs.FileSystem.from_uri(uri))
        strips += [(uri, w, h, top, at, ty) for ty in range(-(-h // side))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for uri, w, h, top, at, ty in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size, high = (2 if top > 255 else 1), min(side, h - ty * side)
                fs, place = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(place) as f:
                    raw = f.read_at(w * high * size, at + ty * side * w * size)
                strip = np.frombuffer(raw, ">u2" if size == 2 else np.uint8).reshape(high, w).astype(np.int32)
                strip = strip if top == BRIGHTEST else strip * BRIGHTEST // top
                for tx in range(-(-w // side)):
                    yield uri, w, h, ty, tx, strip[:, tx * side : (tx + 1) * side].ravel()

    plan = spark.createDataFrame(strips, "image string, width int, height int, top int, at long, ty int").repartition(max(1, min(len(strips), 4 * spark.sparkContext.defaultParallelism)), "image", "ty")
    return plan.mapInArrow(lambda batches: sent(rows(batches), TILE_NAMES), TILE)


def filtered_tiles(tiles: DataFrame, side: int, name: str) -> DataFrame:
    """The tiles of the filtered images."""
    half, run_filter = chosen(name)
    reach = -(-half // side)
    names = ["image", "width", "height", "ty", "tx", "y", "x", "h", "w", "px"]

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """What each tile gives to itself and its neighbours, with its place in the image."""
        for batch in batches:
            for image, width, height, ty, tx, px in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5), strict=True):
                y, x = ty * side, tx * side
                a = np.asarray(px.values).reshape(min(side, height - y), -1)
                for dy, dx in np.ndindex(2 * reach + 1, 2 * reach + 1):
                    ny, nx = ty + dy - reach, tx + dx - reach
                    if not (0 <= ny * side < height and 0 <= nx * side < width):
                        continue
                    top, left = max(y, ny * side - half), max(x, nx * side - half)
                    bottom, right = min(y + a.shape[0], (ny + 1) * side + half), min(x + a.shape[1], (nx + 1) * side + half)
                    if top < bottom and left < right:
                        piece = a[top - y : bottom - y, left - x : right - x]
                        yield image, width, height, ny, nx, top, left, *piece.shape, piece.ravel()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, held = None, None

        def done() -> tuple:
            image, width, height, ty, tx = now
            y, x = ty * side, tx * side
            out = run_filter(held)[: height - y, : width - x]
            rows, cols = np.arange(y, y + out.shape[0]), np.arange(x, x + out.shape[1])
            inside = ((rows >= half) & (rows < height - half))[:, None] & ((cols >= half) & (cols < width - half))[None, :]
            return *now, np.where(inside, out, 0).ravel()

        for batch in batches:
            for *key, y, x, h, w, px in zip(*(batch.column(i).to_pylist() for i in range(9)), batch.column(9), strict=True):
                if key != now:
                    if now:
                        yield done()
                    now, held = key, np.zeros((side + 2 * half, side + 2 * half), np.int32)
                top, left = y - key[3] * side + half, x - key[4] * side + half
                held[top : top + h, left : left + w] = np.asarray(px.values).reshape(h, w)
        if now:
            yield done()

    pieces = tiles.mapInArrow(lambda batches: sent(strips(batches), names), "image string, width int, height int, ty int, tx int, y int, x int, h int, w int, px array<int>")
    place = ["image", "ty", "tx"]
    return pieces.repartition(*place).sortWithinPartitions(*place, "y", "x").mapInArrow(lambda batches: sent(joined(batches), TILE_NAMES), TILE)


def put_together(tiles: DataFrame, side: int) -> DataFrame:
    """(image, width, height, px): whole images, for those that fit a row."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, out = None, None
        for batch in batches:
            for image, w, h, ty, tx, px in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5), strict=True):
                if (image, w, h) != now:
                    if now:
                        yield *now, out.ravel()
                    now, out = (image, w, h), np.zeros((h, w), np.int32)
                part = out[ty * side : (ty + 1) * side, tx * side : (tx + 1) * side]
                part[:] = np.asarray(px.values).reshape(part.shape)
        if now:
            yield *now, out.ravel()

    ordered = tiles.repartition("image").sortWithinPartitions("image", "width", "height", "ty", "tx")
    return ordered.mapInArrow(lambda batches: sent(whole(batches), ["image", "width", "height", "px"]), "image string, width int, height int, px array<int>")
