"""Near-duplicate detection: SimHash with bit-sliced comparison, and its verified form on shingle sets.

Two forms share the bit-sliced comparison and the components.

* near_duplicates: 64-bit fingerprints, linked at `radius` or fewer differing
  bits. The search is exact: the bits are cut into blocks, and two fingerprints
  within the radius agree on all but `radius` blocks, so only those that agree
  on some choice of the remaining blocks are compared.
* keep_one: links texts whose sets of five-word shingles have a Jaccard
  similarity of at least `similarity`. 256-bit fingerprints of the sets are
  compared in buckets; a bucket is a band of minima over the sets, with as many
  bands as bring a pair at the threshold together with probability `recall`.
  Fingerprints within a radius far above the expectation at the threshold form
  families, and inside each family the sets themselves are compared, so no link
  is below the threshold.

A group too large for one task is dealt out: buckets of near_duplicates in
pairs of tiles; buckets of keep_one need no comparison, since a family may be
wider than needed; large families in tiles, each with some members as leaders
of all tiles, after which only what is outside the family's largest component
is compared across tiles.

Rows: a null text counts as empty, an empty text has fingerprint zero and links
like any other, repeated rows stay (keep_one keeps one), a null doc_id is never
a component's id unless the component has no other, and columns besides doc_id
and text are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import text_bytes
from pixelloom.session import durable

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Fingerprints of a bucket that one task compares with one another; a larger bucket is dealt out in pairs of tiles.
TILE = 2048
#: Rows gathered before a comparison starts; a group is never cut.
FLUSH = 1 << 15
#: Rows from which a group is searched for leaders, and how many of them.
LARGE, LEADERS = 128, 16
#: Shingles whose bits are counted, or whose minima are taken, at once.
COUNTED = 1 << 15
#: Bytes of text that are cut into words at once, and where one may be cut.
PIECE, SPACE = 1 << 20, re.compile(rb"[\x20\x09-\x0D]")
#: Minima in a band.
BAND = 6
#: Standard deviations by which the radius of wide fingerprints stands above the expectation at the threshold.
DEVIATIONS = 4
#: Rows of a key from which it is a hub; hubs are joined by broadcast.
HUB = 512
#: Shingles of a family that one task holds; a family with more of them, or of more than TILE texts, is dealt out in tiles.
FAMILY_SHINGLES = 1 << 22
#: Rows up to which the tables of large buckets and of hubs are broadcast; there are never more hubs.
BROADCAST_ROWS = 100_000
#: Keys (two short columns each) up to which a list of documents is broadcast; beyond that it is joined by shuffle.
BROADCAST_KEYS = 1_000_000
#: Links that a task reads of a written table, and tasks that read one at least.
LINKS_READ, READERS = 1 << 17, 8


def shingle_runs(text: bytes | None, width: int = 3) -> Iterator[list[bytes]]:
    """All runs of `width` lower-cased words, repeats included, in lists out of PIECE bytes of text each; of a shorter text the whole; of none nothing."""
    text = text or b""
    at, words, whole = 0, [], False
    while at < len(text):
        cut = SPACE.search(text, at + PIECE) if len(text) - at > PIECE else None
        to = cut.start() if cut else len(text)
        words += text[at:to].lower().split()
        at = to
        if len(words) >= width:
            whole = True
            yield list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
            words = words[len(words) - width + 1 :]
    if words and not whole:
        yield [b" ".join(words)]


def shingles(text: bytes | None, width: int = 3) -> list[bytes]:
    return [s for run in shingle_runs(text, width) for s in run]


def majorities(digests: Callable[[bytes], bytes], texts: list[bytes | None], width: int, size: int) -> np.ndarray:
    """Rows of `size` bytes; a bit is set if it is set in over half of the digests of the text's shingles.

    Bits are counted for COUNTED digests or a piece of text at a time, whatever the texts' lengths.
    """
    votes = np.zeros((len(texts), 8 * size), np.int32)
    sizes = np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    # texts with digests in `held`, and where each begins
    of: list[int] = []
    starts: list[int] = []

    def count() -> None:
        if held:
            bits = np.unpackbits(np.frombuffer(b"".join(held), np.uint8).reshape(-1, size), axis=1, bitorder="little")
            votes[of] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            sizes[of] += np.diff([*starts, len(held)])
        for x in (held, of, starts):
            x.clear()

    for i, text in enumerate(texts):
        for run in shingle_runs(text, width):
            if not of or of[-1] != i:
                of.append(i)
                starts.append(len(held))
            held += map(digests, run)
            if len(held) >= COUNTED:
                count()
    count()
    return np.packbits(2 * votes > sizes[:, None], axis=1, bitorder="little")


def fingerprints_of(texts: list[bytes | None], width: int = 3, seed: int = 42) -> np.ndarray:
    """uint64 fingerprints from XXH64."""
    digest = xxhash.xxh64_digest
    # digests are big-endian
    return majorities(lambda s: digest(s, seed)[::-1], texts, width, 8).view("<u8").ravel()


def fingerprint_table(docs: DataFrame, width: int = 3, key: str = "doc_id") -> DataFrame:
    """(`key`, h bigint: a hash of the text, fp bigint): a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(batch.column(2).to_pylist(), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=[key, "h", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, F.xxhash64("text").alias("h"), "text")
    return text_bytes(rows, key, "h").mapInArrow(run, f"{key} {kind}, h bigint, fp bigint")


def masks(radius: int, blocks: int) -> list[int]:
    """Bit masks such that two fingerprints within the radius agree under at least one of them."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(block, blocks - radius)]


def blocks_for(n: int, radius: int) -> int:
    """More blocks, and so longer keys, for more fingerprints; any choice finds all links."""
    blocks = radius + 1
    while blocks < 2 * radius + 2 and n >> (64 * (blocks - radius) // blocks) > 32:
        blocks += 1
    return blocks


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after merging the ends of each link; a label is the smallest index of its component."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped


def sliced_links(fp: np.ndarray, begin: np.ndarray, end: np.ndarray, radius: int, tasks_at_once: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (p, q), begin[p] <= q < end[p], whose fingerprints (rows of uint64) are within the radius.

    Fingerprints are held as bit planes. A unit of work is one position against
    one word of 64 others: the differing bits are added, plane by plane, into
    carry-save counters of all 64 at once. A counter starts so far up that it
    overflows on exceeding the radius; a unit whose 64 lanes have all overflowed
    is abandoned.
    """
    n = len(fp)
    if not n:
        return
    words = -(-n // 64)
    rows = np.ascontiguousarray(fp).view(np.uint8).reshape(n, -1)
    width = rows.shape[1] * 8
    bits = np.zeros((words * 64, width), np.uint8)
    bits[:n] = np.unpackbits(rows, axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64).reshape(width, words)
    low, high = begin // 64, (end - 1) // 64
    count = np.where(end > begin, high - low + 1, 0)
    total = np.cumsum(count)
    digits = max(1, int(radius).bit_length())
    start = (1 << digits) - 1 - radius
    for done in range(0, int(total[-1]), tasks_at_once):
        unit = np.arange(done, min(done + tasks_at_once, int(total[-1])))
        q = np.searchsorted(total, unit, side="right")
        w = low[q] + (unit - (total[q] - count[q]))
        before = np.clip(begin[q] - w * 64, 0, 63).astype(np.uint64)
        after = np.clip(end[q] - w * 64, 1, 64).astype(np.uint64)
        lanes = (ONES << before) & (ONES >> (np.uint64(64) - after))
        over = ~lanes
        counters = [np.full(len(q), ONES if start >> k & 1 else np.uint64(0)) for k in range(digits)]
        for b in range(width):
            carry = planes[b][w] ^ np.where(bits[q, b], ONES, np.uint64(0))
            for k in range(digits):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if b % 8 == 7 and b >= radius:
                alive = over != ONES
                if not alive.any():
                    q = q[:0]
                    break
                if alive.mean() < 0.7:
                    q, w, over = q[alive], w[alive], over[alive]
                    counters = [c[alive] for c in counters]
        if len(q):
            hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, lane = np.nonzero(hit)
            if len(i):
                yield q[i], w[i] * 64 + lane


def led(fp: np.ndarray, radius: int) -> np.ndarray:
    """For rows of one group the index of the leader within the radius of which each was found, or its own."""
    leader = np.arange(len(fp))
    rest = leader.copy()
    for _ in range(LEADERS):
        if len(rest) <= LARGE:
            break
        near = np.bitwise_count(fp[rest] ^ fp[rest[0]]).sum(axis=1) <= radius
        leader[rest[near]] = rest[0]
        rest = rest[~near]
    return leader


def spanning_links(node: np.ndarray, fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by group, links (member, root) between nodes that connect what is linked inside any group.

    In a large group, rows near the same leader are linked through it and not
    compared with one another, so copies of one text cost no square.
    """
    node, fp = node.copy(), fp.copy()
    values, at = np.unique(node, return_inverse=True)
    label = np.arange(len(values))
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    begin, end = np.arange(len(fp)) + 1, np.repeat(cuts[1:], np.diff(cuts))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > LARGE:
            leader = led(fp[a:b], radius)
            label = unite(label, at[a:b], at[a:b][leader])
            order = np.argsort(leader, kind="stable")
            fp[a:b], at[a:b], leader = fp[a:b][order], at[a:b][order], leader[order]
            ends = np.flatnonzero(np.r_[leader[1:] != leader[:-1], True]) + 1
            begin[a:b] = a + np.repeat(ends, np.diff(np.r_[0, ends]))
    for p, q in sliced_links(fp, begin, end, radius):
        label = unite(label, at[p], at[q])
    member = np.flatnonzero(label != np.arange(len(values)))
    return values[member], values[label[member]]


def bucket_links(keyed: DataFrame, radius: int, bounded: bool = False) -> DataFrame:
    """(u, v) bigint: links that connect all nodes that share a bucket and lie within the radius.

    keyed: t, bits (the bucket), node, f0, f1, ... (the fingerprint), all bigint;
    bounded: no bucket has more than TILE rows.
    """
    prints = [c for c in keyed.columns if c[0] == "f"]
    large = None if bounded else durable(keyed.groupBy("t", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > TILE).select("t", "bits", F.ceil(F.col("n") / TILE).cast("long").alias("tiles")))
    m = large.count() if large is not None else 0
    zero = F.lit(0).cast("long")
    if m:
        dealt = keyed.join(F.broadcast(large) if m <= BROADCAST_ROWS else large, ["t", "bits"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long")))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles"))).withColumn("other", F.explode(F.sequence(zero, F.col("tiles") - 1)))
        dealt = dealt.select("t", "bits", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", *prints)
    else:
        dealt = keyed.select("t", "bits", zero.alias("a"), zero.alias("b"), "node", *prints)
    dealt = dealt.repartition("t", "bits", "a", "b").sortWithinPartitions("t", "bits", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            new = np.r_[True, (rows[1:, :4] != rows[:-1, :4]).any(axis=1)]
            u, v = spanning_links(rows[:, 4], np.ascontiguousarray(rows[:, 5:]).view(np.uint64), np.cumsum(new), radius)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            held.append(np.column_stack([np.asarray(c) for c in batch.columns]))
            if sum(map(len, held)) >= FLUSH:
                rows = np.concatenate(held)
                last = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1))
                if len(last):
                    yield flush(rows[: last[-1] + 1])
                    rows = rows[last[-1] + 1 :]
                held = [rows]
        if sum(map(len, held)):
            yield flush(np.concatenate(held))

    return dealt.mapInArrow(run, "u bigint, v bigint")


def link_table(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(u, v) bigint: links that connect all fingerprints of `fps` (distinct fp) that lie within the radius."""
    n = fps.count()
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius, blocks_for(n, radius))]
    parts = F.array(*(F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for t, m in enumerate(signed)))
    return bucket_links(fps.select(F.explode(parts).alias("k"), F.col("fp").alias("node"), F.col("fp").alias("f0")).select("k.t", "k.bits", "node", "f0"), radius)


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of two texts with that share of common shingles."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide_radius(similarity: float, bits: int = 256) -> int:
    """DEVIATIONS above the expected number of differing bits.

    The expectation holds for sets of equal size and is an upper bound for others of that similarity.
    """
    p = differing_share(similarity)
    return round(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p)))


def bands_for(similarity: float, recall: float) -> int:
    """Bands by which two sets at the threshold share one with that probability, whatever their sizes."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**BAND))


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """The distinct shingles' XXH3 hashes, sorted."""
    runs = [np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, run)), ">u8").astype(np.uint64) for run in shingle_runs(text, width)]
    return np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.uint64)


def bands_of(sets: list[np.ndarray], bands: int) -> np.ndarray:
    """A row of hashes for each set, one of each band's minima; sets must not be empty."""
    rng = np.random.default_rng(7)
    factors = rng.integers(0, 1 << 31, bands * BAND, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    terms = rng.integers(0, 1 << 32, bands * BAND, dtype=np.uint32)
    mixers = rng.integers(0, 1 << 63, bands * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(sets), bands), np.uint64)
    first = 0
    while first < len(sets):
        to, held = first, 0
        while to < len(sets) and (to == first or held + len(sets[to]) <= COUNTED):
            held += len(sets[to])
            to += 1
        x = (np.concatenate(sets[first:to]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[first : to - 1])])
        y = np.empty_like(x)
        for i, (f, t, m) in enumerate(zip(factors, terms, mixers, strict=True)):
            np.multiply(x, f, out=y)
            np.add(y, t, out=y)
            out[first:to, i // BAND] += np.minimum.reduceat(y, starts).astype(np.uint64) * m
        first = to
    return out


def prints_of(sets: list[np.ndarray]) -> np.ndarray:
    """256-bit fingerprints, rows of four uint64: a bit is set if it is set in over half of the set's mixed hashes; sets must not be empty."""
    out = np.zeros((len(sets), 4), np.uint64)
    first = 0
    while first < len(sets):
        to, held = first, 0
        while to < len(sets) and (to == first or held + len(sets[to]) <= COUNTED):
            held += len(sets[to])
            to += 1
        size = np.array(list(map(len, sets[first:to])))
        x = np.concatenate(sets[first:to])
        for k in range(4):
            # fixed values: the finaliser of splitmix64
            y = x + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))
            y = (y ^ (y >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            y = (y ^ (y >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            y = y ^ (y >> np.uint64(31))
            if to == first + 1:
                # one set, which may be long
                votes = sum(np.unpackbits(y[i : i + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32) for i in range(0, len(y), COUNTED))[None, :]
            else:
                bits = np.unpackbits(y.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                votes = np.add.reduceat(bits, np.cumsum(size) - size, axis=0, dtype=np.int32)
            out[first:to, k] = np.packbits(2 * votes > size[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
        first = to
    return out


def similar_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the index of one of its component, the same for all of it; links are pairs similar to at least that.

    A component is searched from its first set. A set that has been reached is
    compared with no other that has, so copies of one text cost no square.
    """
    label = np.arange(len(sets))
    size = np.array(list(map(len, sets)))
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(at, np.cumsum(size)[:-1])
    marked = np.zeros(len(values), np.int64)
    rest, flat = np.flatnonzero(size), at
    while len(rest):
        root, rest, flat = rest[0], rest[1:], flat[size[rest[0]] :]
        reached = [root]
        while reached and len(rest):
            i = reached.pop()
            marked[own[i]] = 1
            common = np.add.reduceat(marked[flat], np.cumsum(size[rest]) - size[rest])
            marked[own[i]] = 0
            near = common / (size[i] + size[rest] - common) >= similarity
            if near.any():
                label[rest[near]] = root
                reached += rest[near].tolist()
                flat = flat[np.repeat(~near, size[rest])]
                rest = rest[~near]
    return label


def hubs_joined(rows: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of rows, `total` of them, with `one`, which has a row for each key and n, the key's number of rows.

    Keys with very many rows, at most BROADCAST_ROWS of them, come by broadcast, so no task gets all rows of a hub.
    """
    hub = F.col("n") > max(HUB, total // BROADCAST_ROWS)
    hubs = one.filter(hub).drop("n").withColumn("__hub", F.lit(True))
    more = [c for c in one.columns if c not in (key, "n")]
    marked = rows.join(F.broadcast(hubs), key, "left")
    rest = marked.filter(F.col("__hub").isNull()).drop("__hub", *more).join(one.filter(~hub).drop("n"), key)
    return marked.filter(F.col("__hub")).drop("__hub").unionByName(rest)


def gathered(written: DataFrame, rows: int) -> DataFrame:
    """A written table of at most so many rows, read by no more tasks than they need: each task leaves files in every shuffle that it feeds."""
    return written.coalesce(max(READERS, math.ceil(rows / LINKS_READ)))


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each linked node's component; roots themselves have no row.

    Alternating large-star and small-star rounds, each one shuffled by node
    with partial minima, until the links no longer change. A large star has at
    most a row for each link, repeats included, which the small star drops.
    """
    edges = durable(links.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(seen) == mark or not seen[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        if mark is None:
            edges = gathered(edges, seen[0])
        mark = tuple(seen)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        star = hubs_joined(both, low, "u", 2 * seen[0]).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = gathered(durable(star.filter(F.col("u") != F.col("v"))), seen[0])
        low = star.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        pulled = hubs_joined(star, low, "u", seen[0]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = gathered(durable(pulled.filter(F.col("u") != F.col("v")).distinct()), 2 * seen[0])
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def classes_of(prints: DataFrame, radius: int, key: str) -> DataFrame:
    """(fp, root, component_id, n): one row for each distinct fingerprint; n is the number of its rows."""
    distinct = durable(prints.groupBy("fp").agg(F.min(key).alias("rep"), F.count("*").alias("rows")))
    roots = connected(link_table(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "rep", "rows", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    return hubs_joined(rooted.select("fp", "root", "rows"), named, "root", distinct.count()).withColumnRenamed("rows", "n")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, key: str = "doc_id") -> DataFrame:
    """(`key`, fp bigint, component_id): one row for each row of docs; the component's smallest `key`."""
    prints = durable(fingerprint_table(docs, width, key).withColumnRenamed(key, "__k"))
    classes = durable(classes_of(prints, radius, "__k").select("fp", "component_id", "n"))
    return hubs_joined(prints.select("__k", "fp"), classes, "fp", prints.count()).select(F.col("__k").alias(key), "fp", "component_id")


def set_table(docs: DataFrame, bands: int, width: int = 5, key: str = "doc_id") -> DataFrame:
    """(__k: `key` as a string, "" for null, k: `key`, h: a hash of the text, node: one of its shingle set, size: of the set, f0 to f3: its fingerprint, bands): a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(2).to_pylist()]
            full = [x for x in sets if len(x)]
            size = np.array(list(map(len, sets)), np.int64)
            node = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            prints = np.zeros((len(sets), 4), np.int64)
            prints[size > 0] = prints_of(full).view(np.int64)
            found = bands_of(full, bands).view(np.int64)
            ends = np.r_[0, np.cumsum(np.where(size > 0, bands, 0))].astype(np.int32)
            arrays = [batch.column(0), batch.column(1), pa.array(node), pa.array(size), *(pa.array(c) for c in prints.T.copy()), pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["k", "h", "node", "size", "f0", "f1", "f2", "f3", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.xxhash64("text").alias("h"), "text")
    out = text_bytes(rows, "k", "h").mapInArrow(run, f"k {kind}, h bigint, node bigint, size bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint, bands array<bigint>")
    return out.withColumn("__k", named(F.col("k")))


def named(key: Column) -> Column:
    """A key as a string; no key is the empty one, which no number is."""
    return F.coalesce(key.cast("string"), F.lit(""))


def listed(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs (with __k and __h) joined to a list of (__k, __h), left_semi or left_anti; a short list is broadcast, so that texts stay where they are."""
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, ["__k", "__h"], how)


def families(nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, root): texts that bands and near fingerprints connect, roots too; nodes: node, f0 to f3, bands."""
    banded = nodes.select("node", F.explode("bands").alias("bits"))
    shared = durable(banded.groupBy("bits").agg(F.count("*").alias("n"), F.min("node").alias("low")).filter(F.col("n") > 1))
    rows = durable(hubs_joined(banded, shared.withColumn("size", F.col("n")), "bits", shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    wide = rows.filter(F.col("size") > TILE).select(F.col("node").alias("u"), F.col("low").alias("v"))
    narrow = rows.filter(F.col("size") <= TILE).select("bits", "node")
    keyed = narrow.join(nodes.select("node", "f0", "f1", "f2", "f3"), "node").select(F.lit(0).cast("long").alias("t"), "bits", "node", "f0", "f1", "f2", "f3")
    roots = connected(wide.union(bucket_links(keyed, wide_radius(similarity), bounded=True)))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def dealt_links(docs: DataFrame, dealt: DataFrame, width: int, similarity: float, key: str) -> DataFrame:
    """(u, v) bigint: links that connect the similar nodes of each group (root, a, b) of `dealt`, which names the texts by __k and __h."""
    keyed = docs.select(named(docs[key]).alias("__k"), F.xxhash64("text").alias("__h"), F.col("text").cast("binary").alias("text"))
    texts = listed(keyed, durable(dealt.select("__k", "__h").distinct()), "left_semi").dropDuplicates(["__k", "__h"])
    rows = dealt.join(texts, ["__k", "__h"]).select("root", "a", "b", "node", "text")
    rows = rows.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        held: dict[int, np.ndarray] = {}
        u: list[int] = []
        v: list[int] = []

        def compare() -> None:
            if len(held) > 1:
                names = list(held)
                label = similar_sets(list(held.values()), similarity)
                for i in np.flatnonzero(label != np.arange(len(names))).tolist():
                    u.append(names[i])
                    v.append(names[label[i]])
            held.clear()

        def linked() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
            u.clear()
            v.clear()
            return out

        for batch in batches:
            root, a, b, node, text = (c.to_pylist() for c in batch.columns)
            for *now, n, t in zip(root, a, b, node, text, strict=True):
                if now != group:
                    compare()
                    group = now
                if n not in held:
                    held[n] = shingle_set(t, width)
            yield linked()
        compare()
        yield linked()

    return rows.mapInArrow(run, "u bigint, v bigint")


def similar_links(docs: DataFrame, nodes: DataFrame, width: int = 5, similarity: float = 0.8, key: str = "doc_id") -> DataFrame:
    """(u, v) bigint: links that connect the nodes whose sets are similar; nodes: node, __k and __h of its text, size, f0 to f3, bands."""
    zero = F.lit(0).cast("long")
    family = durable(nodes.select("node", "__k", "__h", "size").join(families(nodes, similarity), "node"))
    tiles = F.ceil(F.greatest(F.count("*") / TILE, F.sum("size") / FAMILY_SHINGLES)).cast("long")
    # members drawn by as many orders as there are leaders
    leader = F.array_distinct(F.array(*(F.min(F.struct(F.xxhash64(F.lit(i), "node").alias("at"), "node", "__k", "__h")) for i in range(LEADERS))))
    counted = family.groupBy("root").agg(tiles.alias("tiles"), F.count("*").alias("n"), leader.alias("leaders"))
    large = durable(counted.filter(F.col("tiles") > 1))
    if not large.count():
        return dealt_links(docs, family.withColumn("a", zero).withColumn("b", zero), width, similarity, key)
    roots = large.select("root")
    small = family.join(F.broadcast(roots) if large.count() <= BROADCAST_ROWS else roots, "root", "left_anti").withColumn("a", zero)
    tiled = hubs_joined(family, large.select("root", "tiles", "n"), "root", family.count()).withColumn("a", F.pmod(F.xxhash64("node"), F.col("tiles"))).drop("tiles")
    led_ = large.select("root", F.explode("leaders").alias("l"), "tiles").select("root", "l.node", "l.__k", "l.__h", F.explode(F.sequence(zero, F.col("tiles") - 1)).alias("a"))
    first = small.select("root", "a", "node", "__k", "__h").union(tiled.select("root", "a", "node", "__k", "__h")).union(led_.select("root", "a", "node", "__k", "__h")).distinct()
    links = durable(dealt_links(docs, first.withColumn("b", zero), width, similarity, key))
    # what is in the largest component of a large family is linked already
    parts = connected(links).withColumnsRenamed({"node": "__n", "root": "part"})
    split = durable(tiled.join(parts, F.col("node") == F.col("__n"), "left").withColumn("part", F.coalesce("part", "node")).drop("__n"))
    main = split.groupBy("root", "part").agg(F.count("*").alias("c")).groupBy("root").agg(F.max(F.struct("c", "part"))["part"].alias("main"))
    rest = split.join(F.broadcast(main) if large.count() <= BROADCAST_ROWS else main, "root").filter(F.col("part") != F.col("main")).select("root", "node", "__k", "__h")
    pieces = durable(rest.groupBy("root").agg(F.count("*").alias("n"), F.ceil(F.count("*") / TILE).cast("long").alias("pieces")).join(large.select("root", "tiles"), "root"))
    if not pieces.count():
        return links
    short = pieces.count() <= BROADCAST_ROWS
    pieces = F.broadcast(pieces.drop("n")) if short else pieces.drop("n")
    own = split.select("root", "a", "node", "__k", "__h").join(pieces, "root").withColumn("b", F.explode(F.sequence(zero, F.col("pieces") - 1)))
    across = rest.join(pieces, "root").withColumn("b", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("pieces"))).withColumn("a", F.explode(F.sequence(zero, F.col("tiles") - 1)))
    columns = ["root", "a", "b", "node", "__k", "__h"]
    return links.union(dealt_links(docs, own.select(columns).union(across.select(columns)).distinct(), width, similarity, key))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 1 - 1e-6, key: str = "doc_id") -> DataFrame:
    """The rows of docs that stay: of each component of similar texts the row with the smallest `key`.

    A row without a key stands behind those that have one, of several texts
    under one key the one with the smallest hash stays, of repeats one. Only
    keys are shuffled, and the texts of families; docs is filtered in place.
    """
    sets = durable(set_table(docs, bands_for(similarity, recall), width, key))
    low = F.min(F.struct(F.col("k").isNull().alias("none"), F.col("k"), F.col("__k"), F.col("h")))
    prints = ["f0", "f1", "f2", "f3"]
    nodes = sets.groupBy("node").agg(low.alias("m"), F.first("size").alias("size"), *(F.first(c).alias(c) for c in prints), F.first("bands").alias("bands"))
    nodes = durable(nodes.select("node", "m", F.col("m.__k").alias("__k"), F.col("m.h").alias("__h"), "size", *prints, "bands"))
    roots = connected(similar_links(docs, nodes, width, similarity, key)).withColumnRenamed("node", "__n")
    stay = nodes.select("node", "m").join(roots, F.col("node") == F.col("__n"), "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("m").alias("m"))
    stay = durable(stay.select("m.__k", F.col("m.h").alias("__h")))
    seen = sets.groupBy("__k", F.col("h").alias("__h")).agg(F.count("*").alias("n"))
    gone = durable(seen.join(stay, ["__k", "__h"], "left_anti").select("__k", "__h"))
    repeated = durable(seen.filter(F.col("n") > 1).select("__k", "__h").join(gone, ["__k", "__h"], "left_anti"))
    keyed = docs.withColumns({"__k": named(docs[key]), "__h": F.xxhash64(docs["text"])})
    kept = listed(keyed, gone, "left_anti")
    if repeated.count():
        kept = listed(kept, repeated, "left_anti").unionByName(listed(kept, repeated, "left_semi").dropDuplicates(["__k", "__h"]))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
