"""Image scans and the PNG sink.

Spark's image source decodes JPEG, PNG, BMP and GIF on the executors. PNM, TGA,
PSD, HDR and PIC are decoded here from binaryFile rows. Broken files are dropped.
Classes, numbers and caps come from the names of files, before anything is decoded.
Whatever the channels, an image becomes gray pixels.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators.dataset import cap_per_class, class_dictionary, labelled, train_eval
from pixelloom.operators.ordering import with_position
from pixelloom.operators.pixels import ints
from pixelloom.schema import UNLABELLED


#: Pixels after which a batch of decoded images is sent on.
BATCH_PIXELS = 1 << 22
#: Partitions of a scan that a task reads in turn, and tasks for each core below which none are joined.
SCANNED_TOGETHER, WAVES = 32, 4


def packed(rows: Iterable[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size out of rows (..., px), px an array of numbers."""
    held: list[tuple] = []
    pixels = 0

    def out() -> pa.RecordBatch:
        *plain, px = zip(*held, strict=True)
        ends = np.cumsum([0, *map(len, px)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(px).astype(np.int32)))
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(plain, types, strict=True)), lists], names=[*names, "px"])

    for row in rows:
        held.append(row)
        pixels += len(row[-1])
        if pixels >= BATCH_PIXELS:
            yield out()
            held.clear()
            pixels = 0
    if held:
        yield out()


def gathered(found: DataFrame) -> DataFrame:
    """A scan of files by fewer tasks, the same rows.

    Spark counts some megabytes (spark.sql.files.openCostInBytes) for each file it
    opens, so a partition has a few small files, and a task for each partition
    takes longer to start than to read them. A task here reads its partitions one
    after the other and holds no more than one of them would.
    """
    tasks = max(WAVES * found.sparkSession.sparkContext.defaultParallelism, -(-found.rdd.getNumPartitions() // SCANNED_TOGETHER))
    return found.coalesce(tasks)


def opened(spark: SparkSession, path: str, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """(path, width, height, channels, data) of Spark's image source, without broken files."""
    reader = spark.read.format("image").option("dropInvalid", "true")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    found = reader.load(path).select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    return gathered(found)


def decoded(spark: SparkSession, path: str, recursive: bool = False, pattern: str | None = None, found: DataFrame | None = None) -> DataFrame:
    """(path, width, height, channels, px) of the images that Spark's image source knows; `found` is what opened() returned for them, if it was called."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for p, w, h, c, data in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
            # colours are blue, green, red and perhaps alpha
            v = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, c)
            yield p, w, h, c, gray_of(v[:, 2::-1] if c >= 3 else v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from packed(rows(batch), ["path", "width", "height", "channels"], [pa.string(), pa.int32(), pa.int32(), pa.int32()])

    found = opened(spark, path, recursive, pattern) if found is None else found
    return found.mapInArrow(run, "path string, width int, height int, channels int, px array<int>")


def scan(spark: SparkSession, path: str, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """(path, width, height, channels, px) of the images under a folder; a folder without any raises ValueError."""
    found = opened(spark, path, recursive, pattern)
    if not found.select("path").take(1):
        raise ValueError(f"no images in {path}")
    return decoded(spark, path, recursive, pattern, found)


def all_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Spark's rows of the image files of all formats under a folder, which is listed once for whatever is selected from them."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", anycase(SPARK_FORMATS + tuple(DECODERS)))
    return (reader.option("recursiveFileLookup", "true") if recursive else reader).load(path)


def listed(spark: SparkSession, path: str, recursive: bool = False, found: DataFrame | None = None) -> DataFrame:
    """(file, class_name) of the image files of all formats under a folder, by their names alone: nothing is read or decoded.

    class_name is the folder a file lies in; `found` is all_files() of the folder, if it was called.
    """
    found = all_files(spark, path, recursive) if found is None else found
    # the names are cut behind the join of partitions: next to another repartition the optimizer would leave it out
    return gathered(found.select("path")).select(file_key(F.col("path")).alias("file"), F.element_at(F.split("path", "/"), -2).alias("class_name"))


def anycase(endings: Iterable[str]) -> str:
    """A glob for file names with one of the endings, in whatever case."""
    return "*{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in endings) + "}"


def file_key(path: Column) -> Column:
    """A file's URI in one spelling: sources differ in the slashes behind the scheme."""
    return F.regexp_replace(path, r"^([a-zA-Z][a-zA-Z0-9+.-]*):/+", r"$1:/")


def scan_all(spark: SparkSession, path: str, recursive: bool = False, found: DataFrame | None = None) -> DataFrame:
    """(path, width, height, channels, px) of the images of all formats under a folder, each decoded once; channels is null where this module decodes."""
    own = scan_other(spark, path, recursive, found).withColumn("channels", F.lit(None).cast("int"))
    # the image source writes a file's URI with escapes, the other sources as it is
    plain = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    return decoded(spark, path, recursive, anycase(SPARK_FORMATS)).withColumn("path", plain).unionByName(own)


def placed(spark: SparkSession, path: str, files: DataFrame, recursive: bool = False, found: DataFrame | None = None) -> DataFrame:
    """The decoded images of `files` (file and more) with what stands there.

    Only names have been numbered and labelled before, so pixels are decoded once
    and move once at most, to meet their file's row; where the list is short, not at all.
    """
    pixels = scan_all(spark, path, recursive, found)
    return pixels.join(files, file_key(pixels["path"]) == files["file"]).drop("file")


def info(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, channels) from the headers of the files; no pixel is decoded. Files of unknown form have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *size) for p, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if (size := header(memoryview(raw.as_buffer()).cast("B")))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int32()) for c in columns[1:])], names=["path", "width", "height", "channels"])

    return gathered(all_files(spark, path).select("path", "content")).mapInArrow(run, "path string, width int, height int, channels int")


def load_directory(spark: SparkSession, path: str) -> DataFrame:
    """The PNG files right in a folder."""
    return scan(spark, path, pattern="*.png")


def folders_of_classes(path: str) -> str:
    return f"{path.rstrip('/')}/*/"


def load_with_classes(spark: SparkSession, path: str, cap: int | None = None, classes: DataFrame | None = None) -> DataFrame:
    """<path>/<class>/<image>: sample_id in path order, class_id by sorted class name; with a cap, at most that many images a class.

    Files that cannot be decoded have a number too, but no row.
    """
    found = all_files(spark, folders_of_classes(path))
    files = listed(spark, folders_of_classes(path), False, found)
    return placed(spark, folders_of_classes(path), numbered_files(files, classes if classes is not None else class_dictionary(files, "class_name"), cap), False, found)


def numbered_files(files: DataFrame, classes: DataFrame, cap: int | None = None) -> DataFrame:
    """(file, class_name, class_id, sample_id) of listed()."""
    named = labelled(files, classes, "class_name")
    return with_position(named if cap is None else cap_per_class(named, "file", cap), "file", name="sample_id")


def load_without_classes(spark: SparkSession, path: str) -> DataFrame:
    """All images under a folder, unlabelled."""
    found = all_files(spark, path, True)
    files = with_position(listed(spark, path, True, found).drop("class_name"), "file", name="sample_id")
    return placed(spark, path, files.withColumn("class_id", F.lit(UNLABELLED).cast("long")), True, found)


def load(spark: SparkSession, path: str, with_classes: bool = True) -> DataFrame:
    return load_with_classes(spark, path) if with_classes else load_without_classes(spark, path)


def load_collection(spark: SparkSession, path: str) -> DataFrame:
    """<path>/train and <path>/eval with one dictionary of classes for both."""
    folders = [f"{path.rstrip('/')}/{s}" for s in ("train", "eval")]
    found = [all_files(spark, folders_of_classes(f)) for f in folders]
    files = [listed(spark, folders_of_classes(f), False, rows) for f, rows in zip(folders, found, strict=True)]
    names = class_dictionary(files[0].select("class_name").union(files[1].select("class_name")), "class_name")
    numbered = train_eval(*(numbered_files(f, names) for f in files))
    loaded = (placed(spark, folders_of_classes(f), numbered.filter(F.col("split") == s), False, rows) for f, s, rows in zip(folders, ("train", "eval"), found, strict=True))
    return DataFrame.unionByName(*loaded)


def noise(spark: SparkSession, n: int, width: int, height: int, seed: int = 0) -> DataFrame:
    """n images of uniform bytes; the same seed gives the same images."""
    byte = lambda k: ints(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("sample_id"), k)), 1, 2), 16, 10).cast("long"))
    px = F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), byte)
    return spark.range(n).select(F.col("id").alias("sample_id"), F.lit(UNLABELLED).cast("long").alias("class_id"), F.lit(width).alias("width"), F.lit(height).alias("height"), px.alias("px"))


# formats that the image source does not know


PNM_HEAD = re.compile(rb"P([2356])(?:\s|#[^\n]*\n)+?(\d+)(?:\s|#[^\n]*\n)+?(\d+)(?:\s|#[^\n]*\n)+?(\d+)\s")


def decode_pnm(raw: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, gray pixels) of PGM or PPM, ASCII or binary."""
    head = PNM_HEAD.match(raw)
    if not head:
        raise ValueError("not a PNM file")
    kind, w, h, top = (int(x) for x in head.groups())
    n = w * h * (3 if kind in (3, 6) else 1)
    if kind in (2, 3):
        v = np.array(raw[head.end() :].split()[:n], int)
    else:
        v = np.frombuffer(raw, ">u2" if top > 255 else np.uint8, n, head.end()).astype(int)
    if len(v) != n:
        raise ValueError("the PNM file is cut off")
    if top != 255:
        v = v * 255 // top
    if n > w * h:
        v = gray_of(v.reshape(-1, 3))
    return w, h, v


def gray_of(v: np.ndarray) -> np.ndarray:
    """Gray pixels of an array (pixels, channels) of red, green, blue or of gray alone."""
    v = v.astype(int)
    return v[:, 0] if v.shape[1] < 3 else (v[:, :3] @ np.array([77, 150, 29])) >> 8


def tga_runs(raw: bytes, at: int, n: int, c: int) -> bytes:
    """n pixels of c bytes out of run-length packets."""
    out = bytearray()
    while len(out) < n * c:
        head = raw[at]
        count = (head & 0x7F) + 1
        if head & 0x80:
            out += raw[at + 1 : at + 1 + c] * count
            at += 1 + c
        else:
            out += raw[at + 1 : at + 1 + c * count]
            at += 1 + c * count
    return bytes(out)


def decode_tga(raw: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, gray pixels) of TGA with 8, 24 or 32 bits, plain or run-length coded."""
    if len(raw) < 18:
        raise ValueError("not a TGA file")
    skip, kind = raw[0], raw[2]
    w, h, depth, flags = struct.unpack("<HHBB", raw[12:18])
    if kind not in (2, 3, 10, 11) or depth not in (8, 24, 32):
        raise ValueError("only true colour and gray TGA is read")
    c, at = depth // 8, 18 + skip
    body = tga_runs(raw, at, w * h, c) if kind > 3 else raw[at:]
    v = np.frombuffer(body, np.uint8, w * h * c).reshape(h, w, c)
    if not flags & 0x20:
        v = v[::-1]
    return w, h, gray_of(v.reshape(w * h, c)[:, [2, 1, 0]] if c > 1 else v.reshape(w * h, 1))


def packbits(raw: bytes, at: int, n: int) -> tuple[bytes, int]:
    """n bytes out of PackBits runs, and where the next ones begin."""
    out = bytearray()
    while len(out) < n:
        k = raw[at]
        if k < 128:
            out += raw[at + 1 : at + 2 + k]
            at += 2 + k
        elif k > 128:
            out += raw[at + 1 : at + 2] * (257 - k)
            at += 2
        else:
            at += 1
    return bytes(out), at


def decode_psd(raw: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, gray pixels) of a PSD's composite: 8 or 16 bits, gray or RGB, plain or PackBits."""
    if raw[:4] != b"8BPS":
        raise ValueError("not a PSD file")
    channels, h, w, depth, mode = struct.unpack(">HIIHH", raw[12:26])
    if depth not in (8, 16) or mode not in (1, 3):
        raise ValueError("only gray and RGB of 8 or 16 bits is read")
    at = 26
    for _ in range(3):  # colours, resources, layers
        at += 4 + struct.unpack(">I", raw[at : at + 4])[0]
    coding, at, used = struct.unpack(">H", raw[at : at + 2])[0], at + 2, 3 if mode == 3 else 1
    n = w * h * depth // 8
    planes = []
    if coding == 1:
        at += 2 * h * channels  # lengths of rows
    for _ in range(min(used, channels)):
        if coding == 1:
            plane, at = packbits(raw, at, n)
        else:
            plane, at = raw[at : at + n], at + n
        planes.append(np.frombuffer(plane, np.uint8, n)[:: depth // 8])
    return w, h, gray_of(np.stack(planes, axis=1))


def decode_hdr(raw: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, gray pixels) of Radiance HDR: mean light with gamma 2.2."""
    if not raw.startswith((b"#?RADIANCE", b"#?RGBE")):
        raise ValueError("not an HDR file")
    head = re.search(rb"\n\n-Y (\d+) \+X (\d+)\n", raw)
    if not head:
        raise ValueError("unknown orientation")
    h, w, at = int(head[1]), int(head[2]), head.end()
    rows = []
    for _ in range(h):
        if 8 <= w < 32768 and raw[at : at + 2] == b"\x02\x02" and raw[at + 2] < 128:
            at += 4
            line = bytearray()
            while len(line) < 4 * w:
                k = raw[at]
                if k > 128:
                    line += raw[at + 1 : at + 2] * (k - 128)
                    at += 2
                else:
                    line += raw[at + 1 : at + 1 + k]
                    at += 1 + k
            rows.append(np.frombuffer(bytes(line), np.uint8).reshape(4, w).T)
        else:
            rows.append(np.frombuffer(raw, np.uint8, 4 * w, at).reshape(w, 4))
            at += 4 * w
    v = np.concatenate(rows).astype(float)
    light = np.where(v[:, 3] > 0, v[:, :3].mean(axis=1) * 2.0 ** (v[:, 3] - 136), 0)
    return w, h, np.clip(light ** (1 / 2.2) * 255 + 0.5, 0, 255).astype(int)


def decode_pic(raw: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, gray pixels) of Softimage PIC with 8 bits a channel: packets of channels, plain or run-length coded by row."""
    if raw[:4] != b"\x53\x80\xf6\x34" or raw[88:92] != b"PICT":
        raise ValueError("not a PIC file")
    w, h = struct.unpack(">HH", raw[92:96])
    at, packets, more = 104, [], True
    while more:
        more, size, coding, mask = raw[at : at + 4]
        at += 4
        if size != 8 or coding not in (0, 1, 2):
            raise ValueError("only PIC with 8 bits a channel is read")
        packets.append((coding, [k for k in range(4) if mask & 0x80 >> k]))
    out = np.zeros((h, w, 4), np.uint8)
    for row in out:
        for coding, channels in packets:
            n = len(channels)
            line = bytearray()
            if coding == 0:
                line += raw[at : at + n * w]
                at += n * w
            while coding and len(line) < n * w:
                count, at = raw[at], at + 1
                if coding == 2 and count < 128:
                    line += raw[at : at + n * (count + 1)]
                    at += n * (count + 1)
                    continue
                if coding == 2 and count == 128:
                    count, at = struct.unpack(">H", raw[at : at + 2])[0], at + 2
                elif coding == 2:
                    count -= 127
                line += raw[at : at + n] * count
                at += n
                if at > len(raw):
                    raise ValueError("the PIC file is cut off")
            row[:, channels] = np.frombuffer(bytes(line), np.uint8, n * w).reshape(w, n)
    return w, h, gray_of(out.reshape(w * h, 4))


DECODERS = {".pgm": decode_pnm, ".ppm": decode_pnm, ".pnm": decode_pnm, ".tga": decode_tga, ".psd": decode_psd, ".hdr": decode_hdr, ".pic": decode_pic}


#: The endings of what Spark's image source decodes.
SPARK_FORMATS = (".png", ".jpg", ".jpeg", ".bmp", ".gif")


def header(raw: memoryview) -> tuple[int, int, int] | None:
    """(width, height, channels) as the image source counts them: 1 for gray, 4 with alpha, else 3; None for an unknown form."""
    head = bytes(raw[:128])
    try:
        if head.startswith(b"\x89PNG\r\n\x1a\n"):
            w, h, _, kind = struct.unpack(">IIBB", head[16:26])
            return w, h, 1 if kind in (0, 4) else 4 if kind == 6 else 3
        if head[:2] == b"\xff\xd8":
            return jpeg_size(raw)
        if head[:6] in (b"GIF87a", b"GIF89a"):
            return *struct.unpack("<HH", head[6:10]), 3
        if head[:2] == b"BM":
            w, h = struct.unpack("<ii", head[18:26])
            return w, abs(h), 3
        if found := PNM_HEAD.match(raw[: 1 << 12]):
            return int(found[2]), int(found[3]), 1 if found[1] in b"25" else 3
        if head[:4] == b"8BPS":
            channels, h, w = struct.unpack(">HII", head[12:22])
            return w, h, 1 if channels < 3 else min(channels, 4)
        if head.startswith((b"#?RADIANCE", b"#?RGBE")) and (found := re.search(rb"\n\n-Y (\d+) \+X (\d+)\n", raw[: 1 << 16])):
            return int(found[2]), int(found[1]), 3
        if head[:4] == b"\x53\x80\xf6\x34" and head[88:92] == b"PICT":
            return *struct.unpack(">HH", head[92:96]), 4
        if len(head) >= 18 and head[2] in (2, 3, 10, 11) and head[16] in (8, 24, 32):
            return *struct.unpack("<HH", head[12:16]), head[16] // 8
    except (struct.error, IndexError):
        pass
    return None


def jpeg_size(raw: memoryview) -> tuple[int, int, int] | None:
    """From the frame header, which stands behind segments that each name their length."""
    at = 2
    while at + 9 < len(raw):
        if raw[at] != 0xFF:
            return None
        mark = raw[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w, parts = struct.unpack(">HHB", raw[at + 5 : at + 10])
            return w, h, 1 if parts == 1 else 3
        at += 1 if mark == 0xFF else 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
    return None


def scan_other(spark: SparkSession, path: str, recursive: bool = True, found: DataFrame | None = None) -> DataFrame:
    """(path, width, height, px) of PNM, TGA, PSD, HDR and PIC files under a folder; `found` is all_files() of it, if it was called."""
    found = all_files(spark, path, recursive) if found is None else found
    # a condition on names alone takes out files before any task reads them
    ours = F.lower("_metadata.file_name").rlike(rf"({'|'.join(map(re.escape, DECODERS))})$")
    files = gathered(found.filter(ours).select("path", "content"))

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for p, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                yield p, *DECODERS[os.path.splitext(p)[1].lower()](raw.as_py())
            except (ValueError, IndexError, struct.error):
                continue  # as the image source drops broken files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from packed(rows(batch), ["path", "width", "height"], [pa.string(), pa.int32(), pa.int32()])

    return files.mapInArrow(run, "path string, width int, height int, px array<int>")


# sinks


def encode_png(px: np.ndarray, width: int, height: int) -> bytes:
    """A gray PNG of 8 bits."""
    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:] = np.asarray(px, np.uint8).reshape(height, width)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def rescaled(data: Column, factor: float = 255.0) -> Column:
    """Numbers of a matrix as pixels: multiplied, cut to integers, kept to one byte."""
    return F.transform(data, lambda v: ints(v * factor).bitwiseAND(255))


def write_png(images: DataFrame, folder: str, name: str = "sample_id", within: Column | None = None) -> int:
    """One PNG per row, <folder>/<name>.png or, where `within` is not null, <folder>/<within>/<name>.png; the number written.

    Tasks write whole files under a passing name, so a repeated task does no harm.
    """
    uri = folder if "://" in folder else f"file://{os.path.abspath(folder)}"
    fs, top = pafs.FileSystem.from_uri(uri)
    fs.create_dir(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(uri)
        made = {top}
        for batch in batches:
            for n, inner, w, h, px in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = top if inner is None else f"{top}/{inner}"
                if place not in made:
                    fs.create_dir(place)
                    made.add(place)
                passing = f"{place}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(passing) as f:
                    f.write(encode_png(np.array(px), w, h))
                fs.move(passing, f"{place}/{n}.png")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    inner = F.lit(None) if within is None else within
    rows = images.select(F.col(name).cast("string").alias("name"), inner.cast("string").alias("within"), "width", "height", "px")
    return rows.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
