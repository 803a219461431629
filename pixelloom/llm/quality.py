"""Quality rules in a short-circuit cascade.

Each rule is a predicate on a text that says "reject". On a sample, the first
rows of every partition, the executors time every rule and count what it
rejects; the planner adds up their figures and orders the rules by rejections
per second; a text goes through them in that order until the first one rejects
it. The order changes the cost, never the verdict: a text is kept if no rule
rejects it.

Rows: a null text counts as empty and has no words; very long texts are read
whole; repeated rows each get their row; columns besides doc_id and text are
not read, and filtering returns all columns as they were.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from pixelloom.llm.common import text_bytes

SYMBOLS = b"#*$%&|<>"
NOT_LEAD = bytes(range(0x80, 0xC0))  # continuation bytes of UTF-8
WINDOW = 8
#: Rows, and bytes after which no other row is taken, of the planning sample in each partition.
SAMPLE_ROWS, SAMPLE_BYTES = 16, 1 << 20


class Text:
    """A text and what rules derive from it, each computed once and only if asked for."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""
        self._words: list[bytes] | None = None
        self._repeated = -1

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.raw.split()
        return self._words

    def word_chars(self) -> int:
        return len(b"".join(self.words).translate(None, NOT_LEAD))

    def symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    def dup_lines(self) -> int:
        lines = self.lines()
        return len(lines) - len(set(lines))

    def repeat_words(self) -> int:
        if self._repeated < 0:
            self._repeated = covered_by_repeats(self.words)
        return self._repeated


def covered_by_repeats(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of `width` words found at least twice."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i : i + n] for i in range(width)), strict=True))
    if len(set(windows)) == n:
        return 0
    first: dict[tuple[bytes, ...], int] = {}
    starts = bytearray(n)
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            starts[i] = starts[j] = 1
    covered = end = 0
    for i in range(n):
        if starts[i]:
            covered += i + width - max(i, end)
            end = i + width
    return covered


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def too_few_words(t: Text) -> bool:
    return len(t.words) < 20


def repeated_passages(t: Text) -> bool:
    return 100 * t.repeat_words() > 30 * len(t.words)


def too_many_symbols(t: Text) -> bool:
    """More than three symbols to ten words."""
    return 10 * t.symbols() > 3 * len(t.words)


def odd_word_length(t: Text) -> bool:
    """Words shorter than 2 or longer than 15 characters in the mean."""
    return not 2 * len(t.words) <= t.word_chars() <= 15 * len(t.words)


def repeated_lines(t: Text) -> bool:
    """Over half of at least four lines repeat an earlier one."""
    n = len(t.lines())
    return n >= 4 and 2 * t.dup_lines() > n


def mostly_digits(t: Text) -> bool:
    """Over half of the bytes that are not white space are digits."""
    solid = b"".join(t.words)
    return bool(solid) and 2 * (len(solid) - len(solid.translate(None, b"0123456789"))) > len(solid)


_SHOUT = re.compile(rb"[A-Z]")
_ASCII = re.compile(rb"[A-Za-z]")


def mostly_capitals(t: Text) -> bool:
    """Over 60% of at least a hundred ASCII letters are capitals."""
    letters = len(_ASCII.findall(t.raw))
    return letters >= 100 and 10 * len(_SHOUT.findall(t.raw)) > 6 * letters


def stammering(t: Text) -> bool:
    """Over 30% of the words equal the word before them."""
    w = t.words
    return 10 * sum(map(eq, w, w[1:])) > 3 * len(w)


#: In the order in which they are written down; plan() decides the order in which they run.
RULES = (
    Rule("too_few_words", too_few_words),
    Rule("repeated_passages", repeated_passages),
    Rule("too_many_symbols", too_many_symbols),
    Rule("odd_word_length", odd_word_length),
    Rule("repeated_lines", repeated_lines),
    Rule("mostly_digits", mostly_digits),
    Rule("mostly_capitals", mostly_capitals),
    Rule("stammering", stammering),
)


def measured(sample: list[bytes | None], rules: tuple[Rule, ...] = RULES) -> list[tuple[float, int]]:
    """Seconds and rejections of each rule on the sample.

    Each rule is timed on fresh texts, so that shared derivations count for
    the rule that would pay for them.
    """
    out = []
    for rule in rules:
        texts = [Text(raw) for raw in sample]
        began = time.perf_counter()
        rejected = sum(map(rule.rejects, texts))
        out.append((time.perf_counter() - began, rejected))
    return out


def plan(figures: list[tuple[float, int]], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """The rules by rejections per second, the best first; a rule that rejects nothing counts as half a rejection."""
    scored = sorted((-(rejected or 0.5) / (cost + 1e-9), k) for k, (cost, rejected) in enumerate(figures))
    return tuple(rules[k] for _, k in scored)


def planned(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """plan() on figures of all partitions; the driver receives two numbers for each rule, no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample: list[bytes | None] = []
        for batch in batches:
            for raw in batch.column(0).slice(0, sample_rows):
                sample.append(raw.as_py())
                if len(sample) >= sample_rows or sum(len(x or b"") for x in sample) >= SAMPLE_BYTES:
                    break
            if sample:
                break
        if sample:
            cost, rejected = zip(*measured(sample, rules), strict=True)
            yield pa.RecordBatch.from_pydict({"rule": pa.array(range(len(rules)), pa.int32()), "cost": pa.array(cost, pa.float64()), "rejected": pa.array(rejected, pa.int64())})

    found = text_bytes(docs).mapInArrow(run, "rule int, cost double, rejected bigint").groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected")).collect()
    figures = {r.rule: (r.cost, r.rejected) for r in found}
    return plan([figures.get(k, (0.0, 0)) for k in range(len(rules))], rules)


def passes(raw: bytes | None, order: tuple[Rule, ...]) -> bool:
    text = Text(raw)
    return not any(rule.rejects(text) for rule in order)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, all columns, that no rule rejects."""
    order = planned(docs, rules, sample_rows)

    @pandas_udf("boolean")
    def good(text):  # noqa: ANN001, ANN202
        return text.map(lambda raw: passes(raw, order))

    text_bytes(docs)
    return docs.filter(good(F.coalesce(docs["text"].cast("binary"), F.lit(b""))))


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id") -> DataFrame:
    """A row for each row of docs: `key`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    `kept` is the cascade's verdict, the base rules among the others; the rest are the digest that every row gets.
    """
    order = planned(docs, rules, sample_rows)
    names = [key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(1):
                t = Text(raw.as_py())
                kept = not any(rule.rejects(t) for rule in order)
                failed = not kept and (too_few_words(t) or repeated_passages(t))
                rows.append((len(t.words), t.word_chars(), t.symbols(), t.dup_lines(), t.repeat_words(), failed, kept))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    kind = docs.schema[key].dataType.simpleString()
    out = f"{key} {kind}, " + ", ".join(f"{n} bigint" for n in names[1:6]) + ", base_failed boolean, kept boolean"
    return text_bytes(docs, key).mapInArrow(run, out)
