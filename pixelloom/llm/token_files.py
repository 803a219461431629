"""Token ids of a corpus in Arrow files of equal-length sequences.

A file is an Arrow IPC file whose batches have two fixed-size-list columns:
`ids`, sequences of `length` token ids packed across documents, and `mask`,
a bit for each id, eight to a byte and the lowest first: 1 where an id is there
and 0 in the padding of the file's last sequence. The buffers are not
compressed, so a mapped file gives any sequence and its mask without a copy.
A file ends at FILE_IDS ids, whatever the table's size. Beside it lies an index file: for each document its key, the
place of its first id in the file, and its number of ids.

Documents are in ascending key order over the files and inside them. The files
are written to the shared folder under names that carry the task attempt, and
the manifest names those that count, so a repeated task leaves no damage.

Rows: a null text counts as empty and has the end id alone; a null key comes
first; ties are in the order of the texts' hashes; texts are never cut; an
empty table gives an empty manifest; other columns are not read.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.common import text_bytes
from pixelloom.llm.pieces import pieces, signed
from pixelloom.session import shared_dir

#: Ids in a sequence, and sequences in a batch of a file.
LENGTH, SEQUENCES = 2048, 128
#: Ids from which a task begins another file.
FILE_IDS = 1 << 28
#: Pieces whose ids a worker remembers until it begins anew; those from before are kept once more, and taken over when they come up.
REMEMBERED = 550_000
#: Texts encoded in one call.
TOGETHER = 128


class Encoder:
    """Ids of texts by the tokenizers library, which sees each distinct piece once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = np.dtype("u2" if self.library.get_vocab_size() <= 1 << 16 else "u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        vocab = self.library.get_vocab()
        #: whether an id's first byte is a space, which byte-level vocabularies write as U+0120
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t[:1] == "\u0120"]] = True
        self.known: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}

    def _recalled(self, piece: str) -> bool:
        """Whether the piece is known; one known formerly is taken over."""
        if (ids := self.former.get(piece)) is not None:
            self.known[piece] = ids
            return True
        return piece in self.known

    def _encoded(self, new: list[str]) -> None:
        """Encodes pieces that are not known.

        Those of one word behind a space go to the library as one text. It cuts
        before each of their spaces, as it did where they come from, and has no
        other space in them, so each begins at an id that stands for a space and
        perhaps more. Were the number of such ids another, each would go alone.
        """
        known, size = self.known, self.kind.itemsize
        alone, words = [], []
        for p in new:
            (words if p[:1] == " " and 1 < len(p) <= 64 and p.count(" ") == 1 and not p[1].isspace() else alone).append(p)
        if words:
            ids = np.array(self.library.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, self.kind)
            at = np.flatnonzero(self.spaced[ids]) * size
            if len(at) == len(words) and at[0] == 0:
                raw, cuts = ids.tobytes(), at.tolist()
                for p, i, j in zip(words, cuts, [*cuts[1:], len(raw)], strict=True):
                    known[p] = raw[i:j]
            else:
                alone += words
        if alone:
            for p, e in zip(alone, self.library.encode_batch_fast(alone, add_special_tokens=False), strict=True):
                known[p] = array(self.code, e.ids).tobytes()

    def _learn(self, missing: list[str]) -> None:
        """Makes pieces known; a word with a sign behind it comes from the two."""
        missing = [p for p in missing if not self._recalled(p)]
        late = [p for p in missing if signed(p)]
        new = {p for p in missing if not signed(p)} if late else set(missing)
        new.update(q for p in late for q in (p[:-1], p[-1]) if not self._recalled(q))
        self._encoded(list(new))
        known = self.known
        for p in late:
            known[p] = known[p[:-1]] + known[p[-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as numbers of `kind`."""
        if len(self.known) > REMEMBERED:
            self.known, self.former = {}, self.known
        known = self.known
        split = [pieces(t) for t in texts]
        found = [list(map(known.get, ps)) for ps in split]
        holes = [[i for i, ids in enumerate(f) if ids is None] if None in f else [] for f in found]
        missing = list({ps[i] for ps, hs in zip(split, holes, strict=True) for i in hs})
        self._learn(missing)
        for ps, f, hs in zip(split, found, holes, strict=True):
            for i in hs:
                f[i] = known[ps[i]]
        for p in missing:
            if len(p) > 64:
                del known[p]
        return [b"".join(f) for f in found]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


class Writer:
    """Writes one file and its index; holds one batch of ids at most, whatever the documents' sizes."""

    def __init__(self, uri: str, key: pa.DataType, kind: np.dtype, length: int):
        fs, path = opened(uri)
        if length % 8:
            raise ValueError("the length of a sequence must be a multiple of 8")
        item = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(pa.field("item", item), length)), ("mask", pa.list_(pa.field("item", pa.uint8()), length // 8))])
        self.entries = pa.schema([("key", key), ("start", pa.int64()), ("n", pa.int64())])
        self.sinks = [fs.open_output_stream(path), fs.open_output_stream(f"{path}.index")]
        self.ids = pa.ipc.new_file(self.sinks[0], self.schema)
        self.index = pa.ipc.new_file(self.sinks[1], self.entries)
        self.kind, self.length = kind, length
        self.room = np.zeros(length * SEQUENCES, kind)
        self.used = self.total = self.docs = 0
        self.waiting: list[tuple] = []

    def _flush(self, used: int) -> None:
        n = -(-used // self.length) * self.length
        values = pa.array(self.room[:n].copy())
        mask = np.zeros(n, bool)
        mask[:used] = True
        packed = pa.array(np.packbits(mask, bitorder="little"))
        lists = [pa.FixedSizeListArray.from_arrays(v, type=self.schema.field(i).type) for i, v in enumerate((values, packed))]
        self.ids.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.room[:] = 0
        self.used = 0

    def add(self, key: object, ids: bytes) -> None:
        new = np.frombuffer(ids, self.kind)
        self.waiting.append((key, self.total, len(new)))
        self.total += len(new)
        self.docs += 1
        while len(new):
            n = min(len(new), len(self.room) - self.used)
            self.room[self.used : self.used + n] = new[:n]
            self.used += n
            new = new[n:]
            if self.used == len(self.room):
                self._flush(self.used)
        if len(self.waiting) >= 10_000:
            self._note()

    def _note(self) -> None:
        columns = list(zip(*self.waiting, strict=True)) or [[], [], []]
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.entries.types, strict=True)], schema=self.entries))
        self.waiting = []

    def close(self) -> None:
        if self.used:
            self._flush(self.used)
        if self.waiting:
            self._note()
        for x in (self.ids, self.index, *self.sinks):
            x.close()


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str):
        fs, path = opened(uri)
        local = isinstance(fs, pafs.LocalFileSystem)
        sources = [pa.memory_map(p) if local else fs.open_input_file(p) for p in (path, f"{path}.index")]
        self.file, self.index = (pa.ipc.open_file(s) for s in sources)
        self.length = self.file.schema.field("ids").type.list_size
        self._at, self._ids = -1, np.zeros(0, np.uint16)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask (bits, see unpacked()) of sequence i, both views of the file."""
        batch = self.file.get_batch(i // SEQUENCES)
        at = i % SEQUENCES
        parts = (batch.column(k).flatten().slice(at * n, n) for k, n in ((0, self.length), (1, self.length // 8)))
        ids, mask = (x.to_numpy(zero_copy_only=True) for x in parts)
        return ids, mask

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from `start` on, `n` of them, as views."""
        size = self.length * SEQUENCES
        while n:
            b, at = divmod(start, size)
            if b != self._at:
                self._at, self._ids = b, self.file.get_batch(b).column(0).flatten().to_numpy(zero_copy_only=True)
            part = self._ids[at : at + n]
            yield part
            start += len(part)
            n -= len(part)

    def documents(self) -> Iterator[pa.RecordBatch]:
        for b in range(self.index.num_record_batches):
            yield self.index.get_batch(b)


def unpacked(mask: np.ndarray) -> np.ndarray:
    """A sequence's mask as booleans, one for each id."""
    return np.unpackbits(mask, bitorder="little").astype(bool)


def write_files(docs: DataFrame, vocabulary: str, end_id: int | None = 2, length: int = LENGTH, key: str = "doc_id", folder: str | None = None, file_ids: int = FILE_IDS) -> list[dict]:
    """Writes the files; the manifest: a dict for each file with path, docs, tokens and base, the ids in the files before it.

    The texts are dealt out by ranges of the key, so a task encodes and writes
    what it has sorted; only the manifest, one entry per file, comes to the driver.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    fs, top = opened(folder)
    fs.create_dir(top)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(key, F.xxhash64("text").alias("h"), "text").repartitionByRange(parts, F.col(key).asc_nulls_first(), "h")
    rows = rows.sortWithinPartitions(F.col(key).asc_nulls_first(), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}"
        encode, out, files = encoder(vocabulary), None, 0
        end = np.array([] if end_id is None else [end_id], encode.kind).tobytes()

        def written() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int64()), "number": pa.array([files], pa.int64()), "path": [f"{path}-{files}.arrow"], "docs": pa.array([out.docs], pa.int64()), "tokens": pa.array([out.total], pa.int64())})

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i in range(0, len(keys), TOGETHER):
                texts = [(x or b"").decode("utf-8", "replace") for x in batch.column(1).slice(i, TOGETHER).to_pylist()]
                for k, ids in zip(keys[i : i + TOGETHER], encode.encode(texts), strict=True):
                    if out is not None and out.total >= file_ids:
                        yield written()
                        out, files = None, files + 1
                    if out is None:
                        out = Writer(f"{path}-{files}.arrow", batch.column(0).type, encode.kind, length)
                    out.add(k, ids + end)
        if out is not None:
            yield written()

    found = text_bytes(rows, key).mapInArrow(run, "part bigint, number bigint, path string, docs bigint, tokens bigint").collect()
    manifest, base = [], 0
    for r in sorted(found, key=lambda r: (r.part, r.number)):
        manifest.append({"path": r.path, "docs": r.docs, "tokens": r.tokens, "base": base})
        base += r.tokens
    with fs.open_output_stream(f"{top}/manifest.json") as f:
        f.write(json.dumps({"length": length, "files": manifest}).encode())
    return manifest


def read_documents(spark: SparkSession, manifest: list[dict], key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """From the files, a row for each document: `key`, start (ids before it in all files), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = Reader(path)
                for docs in file.documents():
                    sums = []
                    for start, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True):
                        crc = 0
                        for ids in file.span(start, n):
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    starts = pa.array(np.asarray(docs.column(1)) + base)
                    yield pa.RecordBatch.from_arrays([docs.column(0), starts, docs.column(2), pa.array(sums, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame([(m["path"], m["base"]) for m in manifest], "path string, base bigint").repartition(max(len(manifest), 1))
    return files.mapInArrow(run, f"{key} {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
