"""Token counts by byte-pair merging, without identifiers.

A pre-token of n bytes starts as n symbols in a linked list. A heap holds the
adjacent pairs that the merge table knows, by rank and place; the lowest is
popped, its symbols become one, and the pairs that arise are pushed. The number
of tokens is the number of initial symbols less the number of merges.

The counts equal those of the tokenizers library for a byte-level BPE file.
Rows: a null text counts as empty; an empty text has no tokens; texts are never
cut; repeated rows each get their row.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pixelloom.llm.common import text_bytes
from pixelloom.llm.pieces import pieces, signed

#: Fixed value: the split of byte-level BPE. \s is spelled out, as white space of the library's regex engine.
WHITE = r"\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Pre-tokens whose counts a worker remembers in each of two generations.
REMEMBERED = 400_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    at = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [at[b] for b in range(256)]


class MergeCounter:
    """Counts the tokens of texts for one byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.symbol = byte_symbols()
        self.first = [vocab[s] for s in self.symbol]
        if max(vocab.values()) >= 1 << 16:
            raise ValueError("symbols must be numbered below 65,536")
        self.rank: dict[int, int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 16 | vocab[b]] = (r + 1) << 16 | vocab[a + b]
        self.split = regex.compile(SPLIT)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def merged(self, raw: bytes) -> int:
        """Tokens of one pre-token."""
        n = len(raw)
        if n < 2:
            return n
        get, first = self.rank.get, self.first
        ids = [first[b] for b in raw]
        left = list(range(-1, n - 1))
        right = list(range(1, n + 1))
        shift = n.bit_length()
        mask = (1 << shift) - 1
        # of the pair that starts at a place: rank and merged symbol in one number; 0 if it isn't in the table
        pair = [get(a << 16 | b, 0) for a, b in zip(ids, ids[1:], strict=False)]
        pair.append(0)
        heap = [v << shift | i for i, v in enumerate(pair) if v]
        heapq.heapify(heap)
        merges = 0
        while heap:
            item = heappop(heap)
            i = item & mask
            v = item >> shift
            if pair[i] != v:
                continue  # one of the two has merged meanwhile
            merges += 1
            new = ids[i] = v & 0xFFFF
            j = right[i]
            pair[j] = 0
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                v = pair[i] = get(new << 16 | ids[k], 0)
                if v:
                    heappush(heap, v << shift | i)
            else:
                pair[i] = 0
            h = left[i]
            if h >= 0:
                v = pair[h] = get(ids[h] << 16 | new, 0)
                if v:
                    heappush(heap, v << shift | h)
        return n - merges

    def _keep(self, text: str, n: int) -> int:
        if len(text) <= 64:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[text] = n
        return n

    def _plain(self, text: str) -> int:
        total = 0
        for m in self.split.findall(text):
            n = self.known.get(m)
            if n is None:
                n = self.older.get(m)
                n = self._keep(m, self.merged(m.encode()) if n is None else n)
            total += n
        return total

    def piece(self, text: str) -> int:
        if self.special is None:
            return self._plain(text)
        total = at = 0
        for m in self.special.finditer(text):
            total += self._plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self._plain(text[at:])

    def count(self, text: str) -> int:
        """Tokens of a text, piece by piece, those that are pre-tokens met before from memory."""
        ps = pieces(text)
        found = list(map(self.known.get, ps))
        if None in found:
            for i, n in enumerate(found):
                if n is None:
                    p = ps[i]
                    if signed(p):
                        n = self.known.get(p[:-1])
                        found[i] = 1 + (self.piece(p[:-1]) if n is None else n)
                    else:
                        found[i] = self.piece(p)
        return sum(found)


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, key: str = "doc_id") -> DataFrame:
    """A row for each row of docs: `key`, n_bytes, n_tokens, over_limit. `vocabulary`: path of the file, the same on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(vocabulary)
        for batch in batches:
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            tokens = [counts.count(x.decode("utf-8", "replace")) for x in raw]
            columns = [pa.array([len(x) for x in raw], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return text_bytes(docs, key).mapInArrow(run, f"{key} {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
