"""Chat formatting from a log of events.

A log has rows (conversation, seq, turn, op, role, text). Sorted by seq, they
fold into messages:

* delta: the text is appended to the turn's message; a null or unknown op is one;
* edit: the text replaces what the turn's message has so far;
* regenerate: the turn's message and all later turns are dropped, and the
  text starts the turn's message anew.

The fold is declared with windows, which spill, and a grouping by message; the
rendered messages then stream through a task in order, so a conversation of
any number of turns takes constant memory there. A conversation is sorted in one
task, which spills: its digest is that of one stream and cannot be computed in
parts.

The template writes a message as `<|turn|>role<|text|>text<|end|>` and a line
feed. Inside roles and texts a backslash is doubled, and a backslash is set
after the first character of any string that this or another common template
takes for control. The loss mask covers the escaped texts of assistants.

Rows: null roles and texts count as empty; a null conversation is one of its
own; rows of a table of messages stay apart even if they share a turn, ordered by
role and text; columns besides those named are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Places behind whose first character a backslash is set: our own marks, `<|...|>` of other templates, and these.
CONTROL = r"(?<=<)(?=\||/?s>|</?SYS>)|(?<=\[)(?=/?INST\])"
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
MESSAGE = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(TEXT) + r"(.*?)" + re.escape(END), re.DOTALL)


def escaped(text: Column) -> Column:
    """Doubles backslashes and breaks control strings; each control string starts with `<` or `[`, which neither changes."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, CONTROL, r"\\")


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def fold(events: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(`conv`, turn, role, text): the messages that a log of events leaves.

    Of rows with equal seq, the order is by turn, op and text. A message's role
    is the one of its last event that counts.
    """
    order = [F.col("seq"), F.col("turn"), F.col("op"), F.col("text")]
    later = W.partitionBy(conv).orderBy(*[c.desc() for c in order]).rowsBetween(W.unboundedPreceding, -1)
    cut = F.min(F.when(F.col("op") == "regenerate", F.col("turn"))).over(later)
    alive = events.select(conv, "seq", "turn", "op", "role", "text").withColumn("cut", cut)
    alive = alive.filter(F.col("cut").isNull() | (F.col("turn") < F.col("cut")))
    parts = F.sort_array(F.collect_list(F.struct("seq", "op", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))))
    grouped = alive.groupBy(conv, "turn").agg(parts.alias("parts"))
    # an edit or regeneration starts anew: what stands from the last one on is joined once
    anew = F.array_max(F.transform("parts", lambda p, i: F.when(p["op"].isin("edit", "regenerate"), i).otherwise(0)))
    grouped = grouped.withColumn("anew", anew)
    text = F.array_join(F.transform(F.slice("parts", F.col("anew") + 1, F.size("parts")), lambda p: p["text"]), "")
    return grouped.select(conv, "turn", F.element_at("parts", -1)["role"].alias("role"), text.alias("text"))


def events_of(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """A log for a table of whole messages (`conv`, turn, role, text): one event per row, and each row a message of its own."""
    place = F.row_number().over(W.partitionBy(conv).orderBy("turn", "role", "text")).cast("long")
    return rows.select(conv, place.alias("seq"), place.alias("turn"), F.lit("delta").alias("op"), "role", "text")


def streamed(log: DataFrame, conv: str = "conv_id", length: int = 400) -> DataFrame:
    """The log that a chat server would have written for a log of whole messages, one delta each; it folds to the same messages.

    Texts come in deltas of `length` code points. An assistant's message begins
    as a draft that a regeneration takes back; any other begins with a typing
    error that an edit corrects.
    """
    text = F.coalesce("text", F.lit(""))
    # one pass, where a substring by its place would count from the text's beginning each time
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{length}}}"), F.lit(0))
    pieces = F.when(F.char_length(text) > length, pieces).otherwise(F.array(text))
    first = F.when(F.col("role") == "assistant", "regenerate").otherwise("edit")
    event = lambda op, role, text: F.struct(op.alias("op"), role.alias("role"), text.alias("text"))
    draft = event(F.lit("delta"), F.lit("user"), F.concat(F.reverse(F.substring(text, 1, 20)), F.lit("?")))
    said = F.transform(pieces, lambda p, i: event(F.when(i == 0, first).otherwise("delta"), F.col("role"), p))
    spread = log.select(conv, "seq", "turn", F.posexplode(F.concat(F.array(draft), said)).alias("n", "e"))
    # no message has as many pieces as lie between two numbers
    return spread.select(conv, (F.col("seq") * (1 << 24) + F.col("n")).alias("seq"), "turn", "e.op", "e.role", "e.text")


def render(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(`conv`, turn, role, formatted, loss_start, loss_chars): a row for each message; the formatted conversation is their concatenation by turn.

    loss_start and loss_chars, in code points of `formatted`, are the span under the loss mask (length 0 but for assistants).
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = messages.select(conv, "turn", role.alias("role"), escaped(role).alias("r"), escaped(text).alias("t"), text.alias("plain"))
    return rows.select(
        conv,
        "turn",
        "role",
        F.concat(F.lit(TURN), "r", F.lit(TEXT), "t", F.lit(END)).alias("formatted"),
        (F.char_length("r") + len(TURN) + len(TEXT)).cast("long").alias("loss_start"),
        F.when(F.col("role") == "assistant", F.char_length("t")).otherwise(0).cast("long").alias("loss_chars"),
    )


def read_back(rendered: DataFrame, conv: str = "conv_id") -> DataFrame:
    """From rendered messages alone, a row for each conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = rendered.schema[conv].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done = object(), [], []

        def finish() -> None:
            if held:
                n, turns, chars, loss, total = held
                done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def out() -> pa.RecordBatch:
            types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
            done.clear()
            return batch

        key_type = None
        for batch in batches:
            key_type = batch.column(0).type
            for key, formatted, start, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not held or key != now:
                    finish()
                    now, held = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for m in MESSAGE.finditer(formatted):
                    held[0] += 1
                    held[1].update(f"{unescaped(m[1])}\n{unescaped(m[2])}\n".encode())
                masked = unescaped(formatted[start : start + n])
                held[2] += len(masked)
                held[3].update(masked.encode())
                held[4] += len(formatted)
            if len(done) > 1000:
                yield out()
        finish()
        if done:
            yield out()

    rendered.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    ordered = rendered.repartition(conv).sortWithinPartitions(conv, "turn", "role", "formatted").select(conv, "formatted", "loss_start", "loss_chars")
    return ordered.mapInArrow(run, f"{conv} {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
