"""License scan by ordered signature rules.

Texts without any anchor word are passed over. In the others every rule whose
keyword is contained is matched; each match is an interval of words. A match
is suppressed if one of the same or a better priority contains it; of equal
intervals with equal priority the earlier rule stays. Everything happens
inside the row, so there is no shuffle and no group. Places and the reach of
earlier matches are running sums and maxima that double their span in each
pass, so a text costs its length times the logarithm of its matches.

Rows: a null text counts as empty; an empty text has no words and no labels;
texts are read whole; repeated rows each get their row; other columns are not
read.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.binding import let
from pixelloom.llm.common import ALNUM, ascii_lower
from pixelloom.llm.license_rules import ANCHORS, CC_ANCHOR, CONFIDENCE, parsed

#: Phrases that are labels of their own, whatever the rules say.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Spans of the passes of a running sum; no array is longer than the last.
SPANS = [1 << k for k in range(31)]


def normalised(text: Column) -> Column:
    """Words in lower case joined by single spaces; runs beyond ASCII become `_`, which counts as part of a word."""
    return F.trim(F.regexp_replace(F.regexp_replace(ascii_lower(text), SEPARATORS, " "), r"[^\x00-\x7F]+", "_"))


def spaces(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def running(values: Column, start: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element `join` over all up to it; start must not change what it is joined to."""

    def step(acc: Column, span: Column) -> Column:
        before = F.concat(F.array_repeat(start, span), F.slice(acc, F.lit(1), F.size(acc) - span))
        return F.zip_with(before, acc, join)

    spans = F.filter(F.array(*map(F.lit, SPANS)), lambda s: s < F.size(values))
    return F.aggregate(spans, values, step)


def places(norm: Column, regex: Column) -> Column:
    """array<struct<first, last>>: the words at which each match begins and ends."""
    between, matched = F.split(norm, regex, -1), F.regexp_extract_all(norm, regex, F.lit(0))
    own = F.transform(matched, spaces)
    # words up to the end of each match
    ends = let(F.zip_with(F.slice(F.transform(between, spaces), F.lit(1), F.size(own)), own, lambda g, o: g + o), lambda gaps: running(gaps, F.lit(0), lambda x, y: x + y))
    return F.when(F.size(matched) > 0, F.zip_with(ends, own, lambda e, o: F.struct((e - o).alias("first"), e.alias("last")))).otherwise(F.array().cast("array<struct<first:int,last:int>>"))


def detections(norm: Column) -> Column:
    """All matches of all rules, sorted so that a match comes after those that can contain it."""
    # one literal instead of hundreds of expressions
    listed = [{"rule": i, "priority": p, "label": label, "keyword": keyword, "regex": regex, "score": CONFIDENCE[p]} for i, (p, label, keyword, regex) in enumerate(parsed())]
    rules = F.from_json(F.lit(json.dumps(listed)), "array<struct<rule:int,priority:int,label:string,keyword:string,regex:string,score:double>>")
    tried = F.filter(rules, lambda r: F.contains(norm, r["keyword"]))

    def matches(r: Column) -> Column:
        return F.transform(places(norm, r["regex"]), lambda m: F.struct(m["first"].alias("first"), (-m["last"]).alias("back"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"), r["score"].alias("score")))

    return F.array_sort(F.flatten(F.transform(tried, matches)))


def unsuppressed(found: Column) -> Column:
    """Sorted detections without those that one of the same or a better priority contains."""
    levels = sorted(CONFIDENCE)
    none = F.struct(*(F.lit(-1).alias(f"p{k}") for k in levels))
    # pk: the last word, if the detection is of priority k or better
    own = lambda d: F.struct(*(F.when(d["priority"] <= k, -d["back"]).otherwise(-1).alias(f"p{k}") for k in levels))
    furthest = lambda a, b: F.struct(*(F.greatest(a[f"p{k}"], b[f"p{k}"]).alias(f"p{k}") for k in levels))

    def marked(found: Column) -> Column:
        reach = F.concat(F.array(none), let(F.transform(found, own), lambda v: running(v, none, furthest)))
        before = F.slice(reach, F.lit(1), F.size(found))
        contained = lambda d, r: F.coalesce(*(F.when(d["priority"] == k, r[f"p{k}"]) for k in levels)) >= -d["back"]
        pairs = F.zip_with(found, before, lambda d, r: F.struct(d.alias("d"), contained(d, r).alias("gone")))
        return F.transform(F.filter(pairs, lambda x: ~x["gone"]), lambda x: x["d"])

    return F.when(F.size(found) > 1, let(found, marked)).otherwise(found)


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each row of docs: `key`, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    detections: array of (first, last word, priority, rule, label, score).
    """
    read = docs.select(key, F.coalesce(docs["text"], F.lit("")).alias("text"))
    gated = read.select(key, F.regexp_count("text", F.lit(ALNUM)).cast("long").alias("n_words"), "text", F.lower("text").alias("low"))
    gate = F.contains(F.col("low"), F.lit("cc")) & F.col("low").rlike(CC_ANCHOR)
    for anchor in ANCHORS:
        gate = gate | F.contains(F.col("low"), F.lit(anchor))
    gated = gated.select(key, "n_words", F.when(gate, normalised(F.col("text"))).otherwise("").alias("norm"))
    base = places(F.col("norm"), F.lit(r"\b(?:" + "|".join(BASE) + r")\b"))
    has = [F.when(F.col("norm").rlike(rf"\b{phrase}\b"), F.lit(label)) for phrase, label in BASE.items()]
    marked = gated.select(key, "n_words", "norm", base.alias("base"), F.array_compact(F.array(*has)).alias("base_found"), detections(F.col("norm")).alias("found"))
    kept = marked.select(key, "n_words", "base", "base_found", unsuppressed(F.col("found")).alias("kept"))
    labels = F.array_sort(F.array_distinct(F.concat("base_found", F.transform("kept", lambda d: d["label"]))))
    return kept.select(
        key,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.get("base", F.lit(0))["first"].cast("long").alias("first_word"),
        F.get("base", F.size("base") - 1)["first"].cast("long").alias("last_word"),
        F.array_join(F.array_sort("base_found"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda d: d["score"])), F.lit(0.0)).alias("score"),
        F.transform("kept", lambda d: F.struct(d["first"].alias("first"), (-d["back"]).alias("last"), *(d[k].alias(k) for k in ("priority", "rule", "label", "score")))).alias("detections"),
    )
