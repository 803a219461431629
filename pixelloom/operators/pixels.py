"""Image operators on arrays of pixels 0..255, flat index x + y * width.

Each operator is a column expression over one row's array, so a chain of them
is one projection without a shuffle. `images` tables have the columns of
pixelloom.schema.IMAGES.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.binding import let, spread_out

BRIGHTEST, COLOURS = 255, 256
#: The blur's side and standard deviation, and the edge threshold.
BLUR_SIDE, BLUR_SIGMA = 11, 1.84
EDGE = 50


def ints(column: Column) -> Column:
    return column.cast("int")


def upto(n: Column | int) -> Column:
    """0 .. n-1; n is at least 1."""
    return F.sequence(F.lit(0), ints(F.lit(n) if isinstance(n, int) else n) - 1)


def quantise(data: Column) -> Column:
    """Values in [-1, 1) to pixels."""
    return F.transform(data, lambda v: ints(F.floor((v.cast("double") + 1) * 127.5)))


def normalise(px: Column, factor: float = BRIGHTEST) -> Column:
    return F.transform(px, lambda p: p.cast("double") / factor)


def luma(r: Column, g: Column, b: Column) -> Column:
    """Gray value of a colour: (77 r + 150 g + 29 b) / 256, cut off."""
    return ints(F.floor((r * 77 + g * 150 + b * 29) / 256))


def invert(px: Column) -> Column:
    return F.transform(px, lambda p: BRIGHTEST - p)


def binary_scale(px: Column, cap: Column | int = 127) -> Column:
    """0 up to the cap, 255 above."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    return F.transform(px, lambda p: F.when(p <= cap, 0).otherwise(BRIGHTEST))


def restriction(px: Column, step: int = 1) -> Column:
    """Each pixel down to a multiple of step + 1."""
    return F.transform(px, lambda p: p - p % (step + 1))


def counts_upto(px: Column) -> Column:
    """map<int,int>: for each occurring value how many pixels are at most that; by one sort."""
    indexed = F.transform(F.sort_array(px), lambda v, i: F.struct(v.alias("v"), (i + 1).alias("n")))
    # of equal values the last in order has the count
    last = let(indexed, lambda xs: F.filter(xs, lambda x: F.coalesce(F.get(xs, x["n"])["v"] != x["v"], F.lit(True))))
    return F.map_from_entries(last)


def equalise(px: Column) -> Column:
    """Each pixel to 255 times the share of pixels up to it, rounded half up."""
    share = lambda n, px: ints(F.round(n / F.size(px) * BRIGHTEST))
    return let(px, lambda px: let(counts_upto(px), lambda upto_: F.transform(px, lambda p: share(F.element_at(upto_, p), px))))


def median_cap(px: Column) -> Column:
    """The smallest value below 255 that at least half of the pixels do not exceed; 254 if there is none."""
    middle = F.get(F.sort_array(px), ints(F.floor((F.size(px) - 1) / 2)))
    return F.when(middle < BRIGHTEST, middle).otherwise(BRIGHTEST - 1)


def binary_scale_by_median(px: Column) -> Column:
    return let(px, lambda px: let(median_cap(px), lambda cap: binary_scale(px, cap)))


def pixel_at(px: Column, width: Column | int, x: Column | int, y: Column | int) -> Column:
    """The pixel at (x, y); null outside the array."""
    at = (F.lit(x) if isinstance(x, int) else x) + (F.lit(y) if isinstance(y, int) else y) * width
    return F.get(px, ints(at))


def crop(px: Column, width: int, height: int, w: int, h: int, x0: int = 0, y0: int = 0) -> Column:
    """The w x h rectangle at (x0, y0); ValueError unless it lies inside."""
    if w <= 0 or h <= 0 or x0 < 0 or y0 < 0 or x0 + w > width or y0 + h > height:
        raise ValueError(f"cannot crop {w}x{h} at ({x0}, {y0}) out of {width}x{height}")
    return let(px, lambda px: F.transform(upto(w * h), lambda k: F.get(px, ints(x0 + k % w + (y0 + F.floor(k / w)) * width))))


def _half_up(v: Column) -> Column:
    return F.floor(v + 0.5)


def resize(px: Column, width: Column | int, height: Column | int, w: int, h: int, mode: str = "bilinear") -> Column:
    """To w x h, from a size that may differ by row. The border takes the nearest source pixels.

    Inside, "bilinear" interpolates; "distance" weighs the four neighbours by
    their distance from the destination's own coordinates over twice the sum of
    the first and last weight, 0 where that is 0.
    """
    if w <= 0 or h <= 0:
        raise ValueError("the new size must be positive")
    if not isinstance(width, Column) and not isinstance(height, Column) and (w, h) == (width, height):
        return px
    fx, fy = ((width - 1) / (w - 1) if w > 1 else 0.0), ((height - 1) / (h - 1) if h > 1 else 0.0)

    def one(k: Column, px: Column) -> Column:
        def at(x: Column, y: Column) -> Column:
            return F.get(px, ints(x + y * width))

        x, y = k % w, F.floor(k / w)
        edge = at(F.when((x == w - 1) & (x > 0), width - 1).otherwise(_half_up(x * fx)), F.when((y == h - 1) & (y > 0), height - 1).otherwise(_half_up(y * fy)))
        left, right, up, down = F.floor(x * fx), F.ceil(x * fx), F.floor(y * fy), F.ceil(y * fy)
        corners = [(left, up), (left, down), (right, up), (right, down)]
        if mode == "bilinear":
            ax, ay = x * fx - left, y * fy - up
            weights = [(1 - ax) * (1 - ay), (1 - ax) * ay, ax * (1 - ay), ax * ay]
            total = F.lit(1.0)
        elif mode == "distance":
            weights = [F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) for cx, cy in corners]
            total = 2 * (weights[0] + weights[3])
        else:
            raise ValueError(f"unknown mode: {mode}")
        mean = reduce(lambda a, b: a + b, (at(*c) * q for c, q in zip(corners, weights, strict=True)))
        value = F.when(total == 0, 0).otherwise(_half_up(mean / F.nullif(total, F.lit(0.0))))
        return ints(F.when((x == 0) | (x == w - 1) | (y == 0) | (y == h - 1), edge).otherwise(value))

    return let(px, lambda px: F.transform(upto(w * h), lambda k: one(k, px)))


def taps(px: Column, at: Column, width: int, weights: list[tuple[int, int, float]]) -> Column:
    """Sum of weight * pixel at (row + dy, column + dx) from flat index `at`, for (dy, dx, weight)."""
    return reduce(lambda a, b: a + b, (F.get(px, ints(at + (dy * width + dx))) * w for dy, dx, w in weights))


def edges(px: Column, width: int, height: int, threshold: int = EDGE) -> Column:
    """255 where the two Sobel sums together reach the threshold, 0 elsewhere and on the border."""
    gx = [(dy, dx, dx * (2 - abs(dy))) for dy in (-1, 0, 1) for dx in (-1, 1)]
    gy = [(dy, dx, dy * (2 - abs(dx))) for dy in (-1, 1) for dx in (-1, 0, 1)]

    def one(k: Column, px: Column) -> Column:
        x, y = k % width, F.floor(k / width)
        inner = (x > 0) & (x < width - 1) & (y > 0) & (y < height - 1)
        strength = F.abs(taps(px, k, width, gx)) + F.abs(taps(px, k, width, gy))
        return F.when(inner, F.when(strength >= threshold, BRIGHTEST).otherwise(0)).otherwise(0)

    return let(px, lambda px: F.transform(upto(width * height), lambda k: one(k, px)))


def blur_kernel(side: int = BLUR_SIDE, sigma: float = BLUR_SIGMA) -> np.ndarray:
    d = np.arange(side) - side // 2
    return np.exp(-(d[:, None] ** 2 + d[None, :] ** 2) / (2 * sigma * sigma)) / (2 * math.pi * sigma * sigma)


def blur(px: Column, width: int, height: int, side: int = BLUR_SIDE, sigma: float = BLUR_SIGMA) -> Column:
    """Gaussian blur out of place, cut to integers; a border of half the side is 0."""
    half, kernel = side // 2, blur_kernel(side, sigma)
    weights = [(dy - half, dx - half, float(kernel[dy, dx])) for dy in range(side) for dx in range(side)]

    def one(k: Column, px: Column) -> Column:
        x, y = k % width, F.floor(k / width)
        inner = (x >= half) & (x < width - half) & (y >= half) & (y < height - half)
        return F.when(inner, ints(F.floor(taps(px, k, width, weights)))).otherwise(0)

    return let(px, lambda px: F.transform(upto(width * height), lambda k: one(k, px)))


def blur_in_place(images: DataFrame) -> DataFrame:
    """The blur that reads pixels it has already blurred, row by row; sequential, so numpy per image."""
    kernel, half = blur_kernel().astype(np.float32), BLUR_SIDE // 2

    def one(px: list[int], width: int, height: int) -> list[int]:
        a = np.array(px, np.float32).reshape(height, width)
        for y in range(half, height - half):
            for x in range(half, width - half):
                a[y, x] = np.trunc((a[y - half : y + half + 1, x - half : x + half + 1] * kernel).sum())
        out = np.zeros_like(a)
        out[half : height - half, half : width - half] = a[half : height - half, half : width - half]
        return out.astype(int).ravel().tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            px = [one(*r) for r in zip(rows["px"], rows["width"], rows["height"], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(px, pa.list_(pa.int32()))], names=batch.schema.names)

    names = [c for c in images.columns if c != "px"]
    rows = images.select(*names, "px")
    return rows.mapInArrow(run, rows.schema)


def difference(a: Column, width_a: int, height_a: int, b: Column, width_b: int, height_b: int) -> Column:
    """Sum of |a - b| / 255 over the common top left rectangle."""
    w, h = min(width_a, width_b), min(height_a, height_b)

    def apart(a: Column, b: Column) -> Column:
        one = lambda acc, k: acc + F.abs(F.get(a, ints(k % w + F.floor(k / w) * width_a)) - F.get(b, ints(k % w + F.floor(k / w) * width_b)))
        return F.aggregate(upto(w * h), F.lit(0), one) / float(BRIGHTEST)

    return let(a, lambda a: let(b, lambda b: apart(a, b)))


def histogram(images: DataFrame, *keys: str) -> DataFrame:
    """(keys, px, n): how often each value occurs; values that do not occur have no row."""
    return spread_out(images.select(*keys, "px"), "px", "px").groupBy(*keys, "px").agg(F.count("*").alias("n"))


def dense_histogram(px: Column) -> Column:
    """256 counts, zeros included."""
    less = lambda m, v: F.coalesce(F.try_element_at(m, v), F.lit(0))
    spread = lambda m: F.transform(upto(COLOURS), lambda v: less(m, v))
    # counts of pixels up to a value that occurs, less those below it
    below = lambda up, v: F.coalesce(F.array_max(F.slice(up, 1, v)), F.lit(0))
    counts = lambda up: F.transform(up, lambda n, v: F.when(n == 0, 0).otherwise(n - below(up, v)).cast("long"))
    return let(F.when(F.size(px) > 0, counts_upto(px)), lambda m: let(spread(m), counts))


def ratio_histogram(px: Column) -> Column:
    return let(px, lambda px: F.transform(dense_histogram(px), lambda n: n / F.size(px)))


def sizes(images: DataFrame) -> DataFrame:
    """images with n_pixels, the number that width and height make; the array itself is not read."""
    return images.withColumn("n_pixels", F.col("width").cast("long") * F.col("height"))


def blank(width: int, height: int) -> Column:
    if width <= 0 or height <= 0:
        raise ValueError("an image has a positive size")
    return F.array_repeat(F.lit(0), width * height)


#: The names of transforms in specifications. Each takes (px, width, height, *params) and gives (px, width, height).
Step = Callable[..., tuple[Column, int, int]]
TRANSFORMS: dict[str, Step] = {
    "inversion": lambda px, w, h: (invert(px), w, h),
    "binaryscale": lambda px, w, h: (binary_scale(px), w, h),
    "binaryScaleByMedian": lambda px, w, h: (binary_scale_by_median(px), w, h),
    "equalize": lambda px, w, h: (equalise(px), w, h),
    "restriction": lambda px, w, h, step=32: (restriction(px, step), w, h),
    "resize": lambda px, w, h, nw=0, nh=0: (resize(px, w, h, nw, nh), nw, nh),
    "crop": lambda px, w, h, cw=0, ch=0, x=0, y=0: (crop(px, w, h, cw, ch, x, y), cw, ch),
    "filter": lambda px, w, h: (blur(px, w, h), w, h),
    "edges": lambda px, w, h: (edges(px, w, h), w, h),
}


class TransformEngine:
    """An ordered list of named transforms."""

    def __init__(self, *steps: str | tuple):
        self.steps: list[tuple] = []
        for s in steps:
            self.add(s)

    @staticmethod
    def _checked(step: str | tuple) -> tuple:
        step = (step,) if isinstance(step, str) else tuple(step)
        if step[0] not in TRANSFORMS:
            raise ValueError(f"unknown transform: {step[0]}")
        return step

    def add(self, step: str | tuple) -> TransformEngine:
        self.steps.append(self._checked(step))
        return self

    def insert(self, place: int, step: str | tuple) -> TransformEngine:
        self.steps.insert(place, self._checked(step))
        return self

    def column(self, px: Column, width: int, height: int) -> tuple[Column, int, int]:
        for name, *params in self.steps:
            px, width, height = TRANSFORMS[name](px, width, height, *params)
        return px, width, height

    def apply(self, images: DataFrame, width: int, height: int) -> DataFrame:
        """`images` of one size, transformed; each step is its own projection, so that no pixel is computed twice."""
        for name, *params in self.steps:
            px, width, height = TRANSFORMS[name](F.col("px"), width, height, *params)
            images = images.withColumns({"px": px, "width": F.lit(width), "height": F.lit(height)})
        return images


class TransformationPipeline:
    """Resize, then the `pre` transforms, then the `post` ones."""

    def __init__(self, width: int, height: int, pre: TransformEngine | None = None, post: TransformEngine | None = None):
        self.width, self.height = width, height
        self.pre, self.post = pre or TransformEngine(), post or TransformEngine()

    def apply(self, images: DataFrame, width: Column | int, height: Column | int) -> DataFrame:
        steps = [("resize", self.width, self.height), *self.pre.steps, *self.post.steps]
        return TransformEngine(*steps).apply(images, width, height)
