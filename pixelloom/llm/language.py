"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased, everything but letters becomes a space, and its n-grams of
1 to ORDERS code points, inside a word with a space on either side, are hashed
into buckets. A feature is the share of a bucket in the text's n-grams times the
bucket's inverse document frequency.

* Document frequencies are counted over all rows to learn from, one array a task.
* Weights are fitted on a sample of the labelled rows, drawn by hash: about
  SAMPLE_ROWS in all, the same number from each language as far as it has them.
  Its rows are dealt to up to SHARDS; in each round every shard goes over its
  rows with follow-the-regularised-leader, per-coordinate rates, an L1 and an
  L2 penalty, from the mean state of the round before. A small sample has fewer
  shards and more rounds.
* One in CALIBRATE rows of the sample takes no part in that: on them the
  temperature is chosen under which the probabilities have the least log loss.

The model has at most MAX_CELLS numbers, with fewer buckets for more languages,
and the MAX_LANGS most frequent labels; both bounds are for fitting only, all
rows are predicted from their whole texts.

Rows: a text that is null or has no letter is `und` with score 0, as is every text
if there is no label to learn from; a null label teaches nothing; a null id is the
empty one, whose checksum holds it out; a text is read in pieces, and a word longer
than a piece counts as several; repeated rows count each; columns besides the id,
text and label are not read, and the label never for a prediction.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import text_bytes
from pixelloom.session import durable

ORDERS = 3
BITS = 16
MAX_CELLS = 1 << 21
MAX_LANGS = 1024
SAMPLE_ROWS = 12_000
#: Shards at most and rows that each has at least, rounds at least and at most, and steps that the rounds add up to between them.
SHARDS, SHARD_ROWS = 8, 1000
EPOCHS, MOST_EPOCHS, STEPS = 4, 30, 24_000
CALIBRATE = 5
#: Follow the regularised leader: rate, smoothing of the rate, and the two penalties.
ALPHA, BETA, L1, L2 = 1.0, 0.1, 0.02, 0.01
#: Temperatures that are tried.
TEMPERATURES = np.exp(np.linspace(math.log(0.25), math.log(8), 101))
PIECE = 1 << 18
UNKNOWN = "und"
OTHER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Model:
    """names of the languages; idf of each bucket; weights (bucket, language) and bias; temperature."""

    names: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, raw: bytes) -> np.ndarray | None:
        """Scores of the languages, or None for a text without letters."""
        return mean_scores(raw, (self.idf[:, None] * self.weights).astype(np.float32), self.bias)


def pieces(raw: bytes) -> Iterator[bytes]:
    """The text cut at spaces, or between code points where a word fills a piece."""
    at = 0
    while at < len(raw):
        cut = raw.find(b" ", at + PIECE, at + 2 * PIECE)
        if cut < 0:
            cut = min(at + 2 * PIECE, len(raw))
            while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
                cut += 1
        yield raw[at:cut]
        at = cut


def grams(raw: bytes, buckets: int, orders: int = ORDERS) -> Iterator[tuple[np.ndarray, bool]]:
    """(buckets of all n-grams, whether there is a letter) of each piece."""
    for piece in pieces(raw):
        text = OTHER.sub(" ", piece.decode("utf-8", "replace").lower()).strip()
        if not text:
            continue
        code = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)
        space = code == 32
        found, h = [], np.zeros(len(code), np.uint32)
        for n in range(1, orders + 1):
            h = h[: len(code) - n + 1] * np.uint32(0x9E3779B1) + code[n - 1 :]
            # a space may only be the first or the last code point, and is no n-gram alone
            inner = np.zeros(len(h), bool) if n > 1 else space
            for k in range(1, n - 1):
                inner = inner | space[k : k + len(h)]
            mixed = (h[~inner] ^ (h[~inner] >> np.uint32(15))) * np.uint32(0x85EBCA77 + 2 * n)
            found.append((mixed >> np.uint32(8)).astype(np.int64) % buckets)
        yield np.concatenate(found), any(map(str.isalpha, text))


def mean_scores(raw: bytes | None, cells: np.ndarray, bias: np.ndarray) -> np.ndarray | None:
    total, n, letters = np.zeros(cells.shape[1]), 0, False
    for found, letter in grams(raw or b"", len(cells)):
        total += cells.take(found, axis=0).sum(axis=0)
        n, letters = n + len(found), letters or letter
    return total / n + bias if letters else None


def document_frequencies(docs: DataFrame, buckets: int) -> tuple[int, np.ndarray]:
    """(rows with an n-gram, rows with each bucket) over all rows; a task sends one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets + 1, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                parts = [np.unique(found) for found, _ in grams(raw.as_py() or b"", buckets)]
                if parts:
                    counts[np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]] += 1
                    counts[buckets] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(counts[at], pa.int64())})

    out = np.zeros(buckets + 1, np.int64)
    for r in text_bytes(docs).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return int(out[buckets]), out[:buckets]


def vectors(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """(u, label, at, x): the features of rows (u, label, text) that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = [], []
            for raw in batch.column(2):
                counts: dict[int, int] = {}
                for found, _ in grams(raw.as_py() or b"", len(idf)):
                    for b, n in zip(*(a.tolist() for a in np.unique(found, return_counts=True)), strict=True):
                        counts[b] = counts.get(b, 0) + n
                where = np.fromiter(counts, np.int64, len(counts))
                share = np.fromiter(counts.values(), np.float64, len(counts))
                at.append(where)
                x.append(share / max(share.sum(), 1.0) * idf[where])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float64()))], names=["u", "label", "at", "x"])

    read = text_bytes(rows, "u", "label")
    return durable(read.mapInArrow(run, "u bigint, label int, at array<int>, x array<double>").filter(F.size("at") > 0))


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max())
    return e / e.sum()


def leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that the state stands for."""
    shrunk = np.sign(z) * L1 - z
    return np.where(np.abs(z) > L1, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)


def learn(z: np.ndarray, n: np.ndarray, at: np.ndarray, x: np.ndarray, label: int) -> None:
    """One step: z and n, of shape (feature, language), move towards the row's label."""
    w = leader(z[at], n[at])
    p = softmax(x @ w)
    p[label] -= 1.0
    g = x[:, None] * p
    grown = n[at] + g * g
    z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
    n[at] = grown


def epoch(rows: DataFrame, z: np.ndarray, n: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean state after each shard has gone over its rows in the order of u; the driver gets one state a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([a.astype(np.float32).tobytes()], pa.binary()) for a in mine)], names=["shard", "z", "n"])

        for batch in batches:
            for shard, label, at, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if shard != now:
                    if mine:
                        yield out()
                    now, mine = shard, (z.copy(), n.copy())
                # the last feature is the bias
                where = np.append(at.values.to_numpy(), len(z) - 1)
                learn(*mine, where, np.append(x.values.to_numpy(), 1.0), label)
        if mine:
            yield out()

    shard = F.pmod(F.shiftright("u", 20), F.lit(shards)).cast("int").alias("shard")
    ordered = rows.select(shard, "label", "at", "x", "u").repartition(shards, "shard").sortWithinPartitions("shard", "u", "label", "at")
    states = sorted(ordered.mapInArrow(run, "shard int, z binary, n binary").collect(), key=lambda r: r.shard)
    if not states:
        return z, n
    mean = lambda name: np.mean([np.frombuffer(r[name], np.float32).reshape(z.shape) for r in states], axis=0, dtype=np.float64)
    return mean("z"), mean("n")


def coldest(rows: DataFrame, weights: np.ndarray) -> float:
    """The temperature of TEMPERATURES with the least log loss over rows, or 1 without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss = np.zeros(len(TEMPERATURES))
        for batch in batches:
            for label, at, x in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                logits = np.append(x.values.to_numpy(), 1.0) @ weights[np.append(at.values.to_numpy(), len(weights) - 1)]
                scaled = (logits - logits.max())[None, :] / TEMPERATURES[:, None]
                loss += np.log(np.exp(scaled).sum(axis=1)) - scaled[:, label]
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(loss)), pa.int32()), "loss": pa.array(loss, pa.float64())})

    found = rows.mapInArrow(run, "k int, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect()
    best = min(found, key=lambda r: (round(r.loss, 6), r.k), default=None)
    return float(TEMPERATURES[best.k]) if best and best.loss > 0 else 1.0


def held_out(key: Column, parts: int = 5) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts == 0


def train(docs: DataFrame, label: str = "lang", sample_rows: int = SAMPLE_ROWS, key: str = "doc_id") -> Model:
    """A model of the labels of all rows of docs."""
    rows = docs.filter(F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("string").alias("name"), "text")
    known = rows.groupBy("name").count().orderBy(F.desc("count"), "name").limit(MAX_LANGS).collect()
    counts = {r.name: r["count"] for r in known}
    names = tuple(sorted(counts))
    if not names:
        return Model((), np.zeros(1), np.zeros((1, 0)), np.zeros(0))
    buckets = min(1 << BITS, MAX_CELLS // len(names))
    n, df = document_frequencies(rows, buckets)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    # a third of the hash each for drawing, dealing and calibrating
    u = F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    rate = F.create_map(*(F.lit(v) for name in names for v in (name, min(1.0, sample_rows / len(names) / counts[name]))))
    place = F.create_map(*(F.lit(v) for i, name in enumerate(names) for v in (name, i)))
    drawn = rows.withColumn("u", u).filter(F.pmod("u", F.lit(1 << 20)) < rate[F.col("name")] * (1 << 20))
    sample = vectors(drawn.select("u", place[F.col("name")].alias("label"), "text"), idf)
    kept = F.pmod(F.shiftright("u", 40), F.lit(CALIBRATE)) == 0
    fitting = sample.filter(~kept)
    rows_fitted = fitting.count()
    z, g = np.zeros((buckets + 1, len(names))), np.zeros((buckets + 1, len(names)))
    for _ in range(max(EPOCHS, min(MOST_EPOCHS, -(-STEPS // max(rows_fitted, 1))))):
        z, g = epoch(fitting, z, g, max(1, min(SHARDS, rows_fitted // SHARD_ROWS)))
    weights = leader(z, g)
    return Model(names, idf, weights[:-1], weights[-1], coldest(sample.filter(kept), weights))


def predict(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(`key`, held_out, lang_pred, score) of every row of docs."""
    names = [key, "held_out", "lang_pred", "score"]
    cells, bias, temperature, languages = (model.idf[:, None] * model.weights).astype(np.float32), model.bias, model.temperature, model.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, sure = [], []
            for raw in batch.column(2):
                logits = mean_scores(raw.as_py(), cells, bias) if languages else None
                if logits is None:
                    said.append(UNKNOWN)
                    sure.append(0.0)
                else:
                    p = softmax(logits / temperature)
                    said.append(languages[int(p.argmax())])
                    sure.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(sure, pa.float64())], names=names)

    kind = docs.schema[key].dataType.simpleString()
    read = text_bytes(docs.select(key, held_out(docs[key]).alias("held_out"), "text"), key, "held_out")
    return read.mapInArrow(run, f"{key} {kind}, held_out boolean, lang_pred string, score double")
