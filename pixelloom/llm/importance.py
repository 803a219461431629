"""Resampling a corpus towards a target by importance weights.

Features are runs of words hashed into buckets. A bucket's gain is the logarithm
of how much more often the target has it than the corpus, in whole thousandths;
gains are one array, and a document's weight is the mean of its features' gains
looked up there. Adding Gumbel noise from a hash of the document's id turns the
highest scores into a sample drawn without replacement in proportion to
exp(weight / 1000).

The draw is an exact one of `percent` of the eligible documents:

1. Counts of documents by score give the lowest score that is drawn, and cut
   the scores above it into ranges of similar size with known first ranks.
   Scores are whole numbers of a span that the formula bounds (some 200,000 of
   them), so these counts do not grow with the corpus.
2. Each partition sorts its eligible documents down to that score and packs them
   into a run of chunks, cut where a range ends.
3. A task per range merges the runs: the chunks come sorted by their heads,
   through Spark's own sort, which spills, and a chunk joins the tournament tree when
   the tree's winner reaches its head. So only overlapping chunks are in
   memory, however many runs there are. The last range stops at the draw count;
   its remaining ties go out unranked.

Documents below the cut never move.

Rows: a null or empty text has no features, weight 0 and is never drawn where
`min_words` is above 0; a text is read in pieces, whatever its length; a null id
draws its noise from the text's hash and comes after all other ids; repeated rows
share their score and are drawn one by one; without eligible documents nothing is
drawn, and an empty target favours what is rare in the corpus. Columns besides the id
and text are not read.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pixelloom.llm.common import text_bytes
from pixelloom.session import durable

BUCKETS = 10_000
MAX_RUN = 1
SEED = 2024
PERCENT = 10
MIN_WORDS = 20
#: Bytes of a text that are cut into words at once, and words whose buckets a worker remembers.
PIECE = 1 << 20
REMEMBERED = 1 << 18
#: Rows of a chunk, and rows that a range of the merge has at least, but for the last one.
CHUNK = 1024
RANGE_ROWS = 1 << 16
#: Words are digits, letters and everything beyond ASCII; A-Z are lower-cased.
FLAT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


class Buckets(dict):
    """Bucket of a feature, computed once while it is remembered."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def words_in_pieces(raw: bytes) -> Iterator[list[bytes]]:
    flat, at = raw.translate(FLAT), 0
    while at < len(flat):
        cut = flat.find(b" ", at + PIECE)
        cut = len(flat) if cut < 0 else cut
        yield flat[at:cut].split()
        at = cut


def feature_buckets(raw: bytes | None, known: Buckets, max_run: int) -> Iterator[tuple[int, list[int]]]:
    """(words, buckets of the features that end among them) of each piece of a text."""
    before: list[bytes] = []
    for words in words_in_pieces(raw or b""):
        found = [known[w] for w in words]
        if max_run > 1:
            all_words = before + words
            for n in range(2, max_run + 1):
                found += [known[b" ".join(all_words[i - n + 1 : i + 1])] for i in range(max(len(before), n - 1), len(all_words))]
            before = all_words[1 - max_run :]
        yield len(words), found


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, max_run: int = MAX_RUN) -> np.ndarray:
    """Features in each bucket over all rows; each task sends one row a bucket, the driver gets `buckets` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, waiting = Buckets(buckets), np.zeros(buckets, np.int64), []
        for batch in batches:
            for raw in batch.column(0):
                for _, found in feature_buckets(raw.as_py(), known, max_run):
                    waiting += found
                    if len(waiting) >= PIECE:
                        counts += np.bincount(waiting, minlength=buckets)
                        waiting = []
        counts += np.bincount(np.array(waiting, np.int64), minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(counts[at], pa.int64())})

    out = np.zeros(buckets, np.int64)
    for r in text_bytes(docs).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(odds)) of each bucket, counts smoothed by one."""
    n, big_s, big_t = len(corpus), float(corpus.sum()), float(target.sum())
    odds = [(t + 1.0) * (big_s + n) / ((s + 1.0) * (big_t + n)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(o)) for o in odds], np.int64)


def drawn_number(key: Column, text: Column, seed: int) -> Column:
    """An unsigned 32-bit number from a hash of the seed and the document's id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")


def gumbel(h: int) -> int:
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, max_run: int = MAX_RUN, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """(`key`, n_words, n_features, weight, score) of each row of docs."""
    names = [key, "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(len(gains))
        for batch in batches:
            rows = np.zeros((4, batch.num_rows), np.int64)
            for i, (raw, h) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                words = features = total = 0
                for n, found in feature_buckets(raw.as_py(), known, max_run):
                    words, features, total = words + n, features + len(found), total + int(gains[found].sum()) if found else total
                weight = total // features if features else 0
                rows[:, i] = words, features, weight, weight + gumbel(h)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows)], names=names)

    kind = docs.schema[key].dataType.simpleString()
    read = text_bytes(docs.withColumn("__h", drawn_number(docs[key], docs["text"], seed)), key, "__h").select(key, "text", "__h")
    return read.mapInArrow(run, f"{key} {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")


class Tournament:
    """A winner tree over any number of open runs.

    Leaves hold heads, inner nodes the leaf that wins below them. A new head
    is played up from its leaf alone; free leaves are used again, and the tree
    doubles when none is left.
    """

    def __init__(self) -> None:
        self.heads: list = [None]
        self.nodes = [0, 0]
        self.free = [0]

    def play(self, leaf: int) -> None:
        at, heads, nodes = (len(self.heads) + leaf) // 2, self.heads, self.nodes
        while at:
            a, b = nodes[2 * at], nodes[2 * at + 1]
            nodes[at] = b if heads[a] is None or (heads[b] is not None and heads[b] < heads[a]) else a
            at //= 2

    def enter(self, head) -> int:  # noqa: ANN001
        if not self.free:
            n = len(self.heads)
            self.heads += [None] * n
            self.free = list(range(2 * n - 1, n - 1, -1))
            self.nodes = [0] * (2 * n) + list(range(2 * n))
            for leaf in range(0, 2 * n, 2):
                self.play(leaf)
        leaf = self.free.pop()
        self.replace(leaf, head)
        return leaf

    def replace(self, leaf: int, head) -> None:  # noqa: ANN001
        self.heads[leaf] = head
        if head is None:
            self.free.append(leaf)
        self.play(leaf)

    def winner(self) -> tuple[int, object]:
        """The leaf with the smallest head, and the head; a head of None means that all runs are exhausted."""
        leaf = self.nodes[1]
        return leaf, self.heads[leaf]


class Merge:
    """Sorted chunks, which must come in the order of their heads, as one sorted stream."""

    def __init__(self, chunks: Iterator[list[tuple]]) -> None:
        self.chunks, self.tree = chunks, Tournament()
        self.runs: dict[int, Iterator[tuple]] = {}
        self.coming = next(chunks, None)

    def take(self, n: int) -> Iterator[tuple]:
        """The next n rows, or all there are."""
        while n > 0:
            leaf, head = self.tree.winner()
            while self.coming is not None and (head is None or self.coming[0] <= head):
                run = iter(self.coming)
                self.runs[self.tree.enter(next(run))] = run
                self.coming = next(self.chunks, None)
                leaf, head = self.tree.winner()
            if head is None:
                return
            yield head
            n -= 1
            following = next(self.runs[leaf], None)
            if following is None:
                del self.runs[leaf]
            self.tree.replace(leaf, following)

    def rest(self) -> Iterator[tuple]:
        """What take() has left, in any order."""
        yield from (head for head in self.tree.heads if head is not None)
        for run in self.runs.values():
            yield from run
        while self.coming is not None:
            yield from self.coming
            self.coming = next(self.chunks, None)


def ranges_of(histogram: list[tuple[int, int]], draw: int, rows: int) -> tuple[int, list[int], list[int]]:
    """(lowest drawn score, lowest score of each range, documents before each range) of (score, count), the highest score first."""
    lows, before, held, passed = [], [], 0, 0
    for score, n in histogram:
        held += n
        if held >= rows or passed + held >= draw:
            lows.append(score)
            before.append(passed)
            passed, held = passed + held, 0
        if passed >= draw:
            break
    return lows[-1], lows, before


def draw_ranks(rows: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, key: str = "doc_id", range_rows: int = RANGE_ROWS, chunk: int = CHUNK) -> DataFrame:
    """Every row of scored() with its rank among the drawn ones, 1 for the highest score, or null; ties go to the smaller id."""
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    rows = durable(rows.select(key, "n_words", "n_features", "weight", "score"))
    eligible = rows.filter(F.col("n_words") >= min_words)
    histogram = sorted(((r.score, r.n) for r in eligible.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draw = percent * sum(n for _, n in histogram) // 100
    columns = [key, "n_features", "weight", "score"]
    no_rank = F.lit(None).cast("bigint").alias("rank")
    if not draw:
        return rows.select(*columns, no_rank)
    cut, lows, before = ranges_of(histogram, draw, range_rows)
    # bisect wants ascending numbers: the range of a score is the first whose lowest score is not above it
    negated = [-s for s in lows]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            scores = batch.column(3).to_pylist()
            while at < len(scores):
                place = bisect_left(negated, -scores[at])
                to = at + 1
                while to < len(scores) and to - at < chunk and scores[to] >= lows[place]:
                    to += 1
                part = batch.slice(at, to - at)
                lists = [pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), c) for c in part.columns]
                head = [pa.array([place], pa.int32()), part.column(3).slice(0, 1), part.column(0).slice(0, 1)]
                yield pa.RecordBatch.from_arrays([*head, *lists], names=["place", "head_score", "head_key", *columns])
                at = to

    def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks() -> Iterator[tuple[int, list[tuple]]]:
            for batch in batches:
                for i, place in enumerate(batch.column(0).to_pylist()):
                    keys, features, weights, scores = (batch.column(c)[i].as_py() for c in range(3, 7))
                    yield place, [(-s, k is None, k, f, w) for k, f, w, s in zip(keys, features, weights, scores, strict=True)]

        coming = chunks()
        ahead = next(coming, None)
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            keys, features, weights, scores, ranks = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *(pa.array(c, pa.int64()) for c in (features, weights, scores, ranks))], names=[*columns, "rank"])

        while ahead is not None:
            place = ahead[0]

            def of_range(place: int = place) -> Iterator[list[tuple]]:
                nonlocal ahead
                while ahead is not None and ahead[0] == place:
                    now, ahead = ahead[1], next(coming, None)
                    yield now

            merge, first = Merge(of_range()), before[place] + 1
            ranked = ((row, rank) for rank, row in enumerate(merge.take(draw - before[place]), first))
            for (negative, _, k, f, w), rank in chain(ranked, ((row, None) for row in merge.rest())):
                out.append((k, f, w, -negative, rank))
                if len(out) >= chunk:
                    yield flushed()
        if out:
            yield flushed()

    key_type = to_arrow_type(rows.schema[key].dataType)
    by = [F.col("score").desc(), F.col(key).asc_nulls_last()]
    runs = eligible.filter(F.col("score") >= cut).select(*columns).sortWithinPartitions(*by)
    packed = runs.mapInArrow(pack, f"place int, head_score bigint, head_key {kind}, {key} array<{kind}>, n_features array<bigint>, weight array<bigint>, score array<bigint>")
    ordered = packed.repartition("place").sortWithinPartitions("place", F.col("head_score").desc(), F.col("head_key").asc_nulls_last())
    ranked = ordered.mapInArrow(merge_runs, f"{key} {kind}, n_features bigint, weight bigint, score bigint, rank bigint")
    rest = rows.filter((F.col("n_words") < min_words) | (F.col("score") < cut)).select(*columns, no_rank)
    return ranked.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, max_run: int = MAX_RUN, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """(`key`, n_features, weight, score, rank) of every row of docs, for a corpus that shall come nearer to the texts of target."""
    gains = gains_of(bucket_counts(docs, buckets, max_run), bucket_counts(target, buckets, max_run))
    return draw_ranks(scored(docs, gains, max_run, seed, key), percent, min_words, key)


def drawn_documents(docs: DataFrame, ranks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The drawn rows of docs, all columns; needs ids that are unique."""
    drawn = ranks.filter(F.col("rank").isNotNull()).select(F.col(key).alias("__drawn"))
    return docs.join(drawn, docs[key] == F.col("__drawn"), "left_semi")
