"""Benchmark decontamination by a prefix-filtered set join.

The windows of an item, runs of `width` words or the whole of a shorter item,
are sets of one-word shingles that a document must contain in full. With full
containment the necessary prefix of a window is one shingle; ordered by rarity
over all documents, that is its rarest. Documents are joined on it, place by
place. The place of the shingle in the window bounds the window's place in the
document, the window's length bounds it at the document's end, and what is
left is verified word by word.

The tokens of all documents stream past what is broadcast of the items; how much
that is depends on bytes:

* the table of windows, while it is small;
* beyond that, only the prefix words with the places that they take in windows:
  a document's words give the candidates' places at once, and what is shuffled
  is one hash for each candidate, joined to the windows' hashes and verified
  word by word on both sides;
* beyond that, the documents' words are dealt out to the prefix words, each word
  of very many rows to several tasks, and verified afterwards.

Rows: a null text has no words, an item without words has no window, items that
repeat count once, null item ids are not counted. Rows with the same doc_id and
text are read once and returned as often as they come. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import ALNUM, ascii_lower, words_of
from pixelloom.session import durable

WIDTH = 10
#: Bytes of the windows' words and items up to which their table is broadcast, and bytes of prefix words for theirs.
BROADCAST_BYTES, PREFIX_BYTES = 48 << 20, 96 << 20
#: Occurrences of a word from which it is dealt to several tasks, and how many occurrences a task then gets.
HOT = 1 << 20
#: Keys (two numbers each) up to which a list of documents to drop is broadcast.
BROADCAST_KEYS = 1_000_000
#: Stands at the end of each document's words; no word is empty.
LAST = ""


def windows(items: DataFrame, width: int = WIDTH, item: str = "item_id") -> DataFrame:
    """(win array<string>, items array<string>): each distinct window and the ids of its items."""
    ws = items.select(F.col(item).cast("string").alias("item"), words_of(ascii_lower(items["text"]), ALNUM).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.lit(width), F.size("w"))
    cut = ws.select("item", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i"))
    cut = cut.select("item", F.slice("w", F.col("i"), F.col("n")).alias("win"))
    return cut.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))


def documents(docs: DataFrame, key: str) -> DataFrame:
    """(`key`, h, w): a hash of the text and its words."""
    return docs.select(key, F.xxhash64("text").alias("h"), words_of(ascii_lower(docs["text"]), ALNUM).alias("w"))


def rarity(docs: DataFrame, vocabulary: DataFrame, small: bool, key: str) -> DataFrame:
    """(tok, n): how often each word of the vocabulary occurs in all documents."""
    # outer, for else the optimiser adds a filter on the array and cuts every text twice
    seen = documents(docs, key).select(F.explode_outer("w").alias("tok"))
    if small:
        return seen.join(F.broadcast(vocabulary), "tok", "left_semi").groupBy("tok").agg(F.count("*").alias("n"))
    # frequent words shrink to one row per task before they are dealt out
    return seen.groupBy("tok").agg(F.count("*").alias("n")).join(vocabulary, "tok", "left_semi")


def prefixes(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """wins with tok, the rarest word of the window, and off, its first place there."""
    words = wins.select("id", F.explode("win").alias("tok")).distinct()
    ranked = words.join(counts, "tok", "left")
    rarest = ranked.groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.col("tok"))).alias("m"))
    found = wins.join(rarest, "id").select("id", "win", "items", "m.tok")
    return found.withColumn("off", (F.array_position("win", F.col("tok")) - 1).cast("int"))


def covered(spans: Column) -> Column:
    """Places in the union of spans (start, end), sorted."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], s["end"]).alias("end"))
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def bytes_of(df: DataFrame, size: Column) -> int:
    return df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def hits(docs: DataFrame, items: DataFrame, width: int = WIDTH, key: str = "doc_id", item: str = "item_id", broadcast_bytes: int = BROADCAST_BYTES, prefix_bytes: int = PREFIX_BYTES) -> DataFrame:
    """A row for each row of docs: `key`, h, n_words, n_hit, items (sorted array of ids), and spans, the sorted places (start, end) of windows."""
    wins = durable(windows(items, width, item).withColumn("id", F.xxhash64("win")))
    chars = F.octet_length(F.concat_ws(" ", "win")) + F.octet_length(F.concat_ws(" ", "items")) + 16 * (F.size("win") + F.size("items")) + 64
    small = bytes_of(wins, chars) <= broadcast_bytes
    vocabulary = wins.select(F.explode("win").alias("tok")).distinct()
    counts = durable(rarity(docs, vocabulary, small, key))
    table = durable(prefixes(wins, counts))
    base = documents(docs, key)
    mark = F.concat("w", F.array(F.lit(LAST)))
    start = F.col("pos") - F.col("off")
    fits = (start >= 0) & (start + F.size("win") <= F.size("w"))
    exact = fits & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.size("win")) == F.col("win"))
    last = table.sparkSession.createDataFrame([(LAST,)], "tok string")
    if small:
        table = table.select("tok", "off", "win", "items").unionByName(last, allowMissingColumns=True)
        places = base.select(key, "h", "w", F.posexplode_outer(mark).alias("pos", "tok"))
        found = places.join(F.broadcast(table), (places["tok"] == table["tok"]) & ((places["tok"] == LAST) | exact))
        found = found.withColumn("n", F.size("w"))
    else:
        # where a prefix word stands in windows, and how long those are
        at = durable(table.select("tok", F.col("off"), F.size("win").alias("size")).distinct())
        short = bytes_of(at, F.octet_length("tok") + 64) <= prefix_bytes
        if short:
            shapes = at.unionByName(last, allowMissingColumns=True)
            places = base.select(key, "h", "w", F.posexplode_outer(mark).alias("pos", "tok")).join(F.broadcast(shapes), "tok")
            inside = (start >= 0) & (start + F.col("size") <= F.size("w"))
            words = F.when(inside, F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("size")))
            near = places.filter((F.col("tok") == LAST) | inside).select(key, "h", "pos", "off", F.size("w").alias("n"), words.alias("seen"))
            ends = near.filter(F.col("seen").isNull())
            near = near.filter(F.col("seen").isNotNull()).withColumn("id", F.xxhash64("seen"))
            checked = near.join(wins, "id").filter(F.col("seen") == F.col("win")).drop("seen", "id")
        else:
            places = base.select(key, "h", F.posexplode_outer("w").alias("pos", "tok"))
            # a word that stands at very many places comes in as many copies as tasks shall share it
            often = durable(counts.filter(F.col("n") >= HOT).select("tok", F.ceil(F.col("n") / HOT).cast("int").alias("tasks")))
            share = F.broadcast(often)  # at most the number of all words over HOT
            dealt = places.join(share, "tok", "left").withColumn("salt", F.pmod(F.xxhash64("h", "pos"), F.coalesce("tasks", F.lit(1))).cast("int")).drop("tasks")
            tabled = table.select("tok", "off", "id").join(share, "tok", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1))).drop("tasks")
            near = dealt.join(tabled, ["tok", "salt"]).filter(start >= 0).select(key, "h", "pos", "off", "id").join(wins, "id").withColumnsRenamed({key: "__k", "h": "__h"})
            checked = base.join(near, base[key].eqNullSafe(near["__k"]) & (base["h"] == near["__h"]) & exact).select(key, "h", "pos", "off", "win", "items", F.size("w").alias("n"))
            ends = base.select(key, "h", F.size("w").alias("pos"), F.size("w").alias("n"))
        found = checked.unionByName(ends.select(key, "h", "pos", "n"), allowMissingColumns=True)
    span = F.when(F.col("win").isNotNull(), F.struct(start.alias("start"), (start + F.size("win")).alias("end")))
    grouped = (
        found.select(key, "h", "n", span.alias("span"), "items", F.col("win").isNull().cast("long").alias("rows"))
        .groupBy(key, "h")
        .agg(F.max("n").cast("long").alias("n_words"), F.sum("rows").alias("rows"), F.sort_array(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    )
    full = grouped.withColumn("n_hit", covered(F.col("spans")))
    return full.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).select(key, "h", "n_words", "n_hit", "items", "spans")


def keep_clean(docs: DataFrame, items: DataFrame, width: int = WIDTH, key: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, in which no window of an item occurs."""
    bad = durable(hits(docs, items, width, key).filter(F.col("n_hit") > 0).select(F.col(key).alias("__k"), F.col("h").alias("__h")).distinct())
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_KEYS else bad
    same = docs[key].eqNullSafe(F.col("__k")) & (F.xxhash64(docs["text"]) == F.col("__h"))
    return docs.join(bad, same, "left_anti")
