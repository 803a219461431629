"""The prefix trie of conversations, by partition refinement.

A node is a distinct sequence of first turns; its members are the conversations
that start with it. The work is on digests of turns, never on their texts:

1. Turns are numbered by ranges of (conversation, turn, role, text), so a
   conversation of any length is spread over tasks; running sums of their
   characters come along.
2. Conversations of equal turns become one class each: their turns' digests are
   summed by exclusive or, which needs no order, and the ids of a class stream
   in order through running digests, in pieces that range tasks have joined.
3. All classes start together. Each round splits the active ones turn by turn,
   TURNS turns a round, a part being named by the digest of its class and its
   turn. A part with one class left is retired: its tail is a chain without
   branches, whose nodes follow from the class' running sums alone.
   Rounds end when nothing is active, so there are as many as the longest
   beginning that two different conversations share has blocks of turns.
4. The blocks are folded back from the deepest: what a node's subtree adds goes
   to its ancestors in the block and to the class the block began with.

Joins that many rows of one key may meet carry a salt, or the range a turn was
numbered in.

Rows: of equal turns, null first, role and then text decide the order; null roles
and texts are empty; a null conversation is one of its own, counted as a member
but left out of smallest ids and digests of ids; repeated rows are turns of
their own; without conversations there is no node, not even a root. Columns besides those
named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pixelloom.session import durable

#: Turns that a round splits by; no array is longer.
TURNS = 8
#: Copies of a node's row when its children look it up.
SALTS = 8
#: Ids that are joined to one piece of text.
PIECE = 1 << 12
NONE = hashlib.sha256(b"").hexdigest()


def digest(*parts: Column) -> Column:
    """128 bits of SHA-256, in hex."""
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


def numbered(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, part, pos, key, chars, before): a row for each turn, its place in the conversation, its digest, the characters of its text and of all before it.

    `part` is the range that numbered the turn; a conversation lies in neighbouring ones.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    read = rows.select(F.col(conv).alias("conv"), "turn", role.alias("role"), text.alias("text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text")]
    key = digest(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    sorted_rows = read.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    dealt = durable(sorted_rows.select("conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), key.alias("key"), F.char_length("text").cast("long").alias("chars")))
    # a conversation has one row in each range it touches
    sums = dealt.groupBy("conv", "part").agg(F.count("*").alias("n"), F.sum("chars").alias("c"))
    earlier = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = sums.select(F.col("conv").alias("__c"), F.col("part").alias("__p"), F.coalesce(F.sum("n").over(earlier), zero).alias("__n"), F.coalesce(F.sum("c").over(earlier), zero).alias("__b"))
    inside = W.partitionBy("conv", "part").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    counted = dealt.select("*", F.count("*").over(inside).alias("i"), F.coalesce(F.sum("chars").over(inside), zero).alias("b"))
    joined = counted.join(sums, F.col("conv").eqNullSafe(F.col("__c")) & (F.col("part") == F.col("__p")))
    return joined.select("conv", "part", (F.col("i") + F.col("__n")).alias("pos"), "key", "chars", (F.col("b") + F.col("__b")).alias("before"))


def by_conversation(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Inner join of turns with rows of convs, one a conversation; a long conversation's turns stay in their ranges."""
    named = convs.withColumnRenamed("conv", "__c")
    pairs = turns.select("conv", "part").distinct().join(named, F.col("conv").eqNullSafe(F.col("__c"))).drop("__c")
    pairs = pairs.withColumnsRenamed({"conv": "__c", "part": "__p"})
    return turns.join(pairs, F.col("conv").eqNullSafe(F.col("__c")) & (F.col("part") == F.col("__p"))).drop("__c", "__p")


def lengths(turns: DataFrame) -> DataFrame:
    """(conv, len, total): a conversation's turns and characters."""
    return turns.groupBy("conv").agg(F.count("*").alias("len"), F.sum("chars").alias("total"))


def with_shared_heads(turns: DataFrame, every: int = 100, kinds: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations rebuilt on the beginnings of others.

    Conversation c starts with the first h turns of conversation c - c % every,
    as far as it has them, and goes on with its own turns after its first h;
    h is the unsigned CRC-32 of c in decimal, modulo `kinds` (0 for a null c).
    """
    h = F.coalesce(F.crc32(F.col("conv").cast("string").cast("binary")) % kinds, F.lit(0))
    turns = durable(turns.withColumn("h", h))
    own = turns.groupBy("conv", "h").agg(F.count("*").alias("n"), F.sum("chars").alias("c"), F.coalesce(F.sum(F.when(F.col("pos") < F.col("h"), F.col("chars"))), F.lit(0).cast("long")).alias("skipped"))
    # at most `kinds` - 1 turns of a conversation are ever a head
    first = turns.filter((F.col("conv") % every == 0) & (F.col("pos") < kinds - 1))
    heads = first.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "key", "chars", "before"))).alias("head"))
    own = own.join(heads, F.col("conv") - F.col("conv") % every == F.col("base"), "left")
    head = F.when(F.col("head").isNull() | (F.col("h") == 0), F.array().cast(heads.schema["head"].dataType)).otherwise(F.slice("head", F.lit(1), F.greatest(F.col("h"), F.lit(1)).cast("int")))
    own = own.withColumn("head", head).withColumn("head_len", F.size("head").cast("long"))
    last = F.element_at("head", -1)
    own = own.withColumn("head_chars", F.when(F.col("head_len") > 0, last["before"] + last["chars"]).otherwise(0))
    left = F.greatest(F.col("n") - F.col("h"), F.lit(0))
    own = durable(own.select("conv", "h", "head", "head_len", "head_chars", "skipped", (F.col("head_len") + left).alias("len"), (F.col("head_chars") + F.col("c") - F.col("skipped")).alias("total")))
    moved = by_conversation(turns.filter(F.col("pos") >= F.col("h")), own.select("conv", "head_len", "head_chars", "skipped"))
    moved = moved.select("conv", "part", (F.col("pos") - F.col("h") + F.col("head_len")).alias("pos"), "key", "chars", (F.col("before") - F.col("skipped") + F.col("head_chars")).alias("before"))
    lent = own.select("conv", F.lit(-1).alias("part"), F.explode("head").alias("t")).select("conv", "part", "t.pos", "t.key", "t.chars", "t.before")
    return durable(lent.unionByName(moved)), own.select("conv", "len", "total")


def classes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, len, total, w, ends): a row for each distinct conversation; conv is its smallest id, w their number, ends the digest of their ids."""
    bits = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("key")), 256)
    word = [F.bit_xor(F.conv(F.substring(bits, 1 + 15 * i, 15), 16, 10).cast("long")).alias(f"x{i}") for i in range(4)]
    sums = turns.groupBy(F.col("conv").alias("__c")).agg(*word)
    signed = convs.join(sums, F.col("conv").eqNullSafe(F.col("__c")), "left")
    signed = signed.select(F.concat_ws(":", "len", *(F.coalesce(f"x{i}", F.lit(0)) for i in range(4))).alias("sig"), "len", "total", "conv")
    turns.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    kind = convs.schema["conv"].dataType.simpleString()
    id_type = to_arrow_type(convs.schema["conv"].dataType)
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["sig", F.col("conv").asc_nulls_last()]
    dealt = signed.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("part"))
    names = ["sig", "len", "total", "part", "seq", "first", "n", "ids"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), id_type, pa.int64(), pa.string()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, ids, n, seq, out = None, [], 0, 0, []

        def close() -> None:
            if n:
                out.append((*head, seq, ids[0] if ids else None, n, ",".join(map(str, ids))))

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out.clear()
            return batch

        size = 0
        for batch in batches:
            for sig, length, total, conv, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if head is None or head[0] != sig or n >= PIECE:
                    close()
                    seq, size = seq + 1, size + n
                    head, ids, n = (sig, length, total, part), [], 0
                ids += [conv] if conv is not None else []
                n += 1
                if size >= PIECE and out:
                    yield flushed()
                    size = 0
        close()
        if out:
            yield flushed()

    pieces = dealt.mapInArrow(pack, f"sig string, len bigint, total bigint, part int, seq bigint, first {kind}, n bigint, ids string")
    by_class = pieces.repartition("sig").sortWithinPartitions("sig", "part", "seq")

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def flushed() -> pa.RecordBatch:
            rows = [(conv, length, total, w, sha.hexdigest()) for _, conv, length, total, w, sha in out]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [id_type, *[pa.int64()] * 3, pa.string()], strict=True)], names=["conv", "len", "total", "w", "ends"])

        for batch in batches:
            for sig, length, total, _, _, first, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != sig:
                    if len(out) >= PIECE:
                        yield flushed()
                    now = [sig, first, length, total, 0, hashlib.sha256()]
                    out.append(now)
                    begun = False
                now[4] += n
                if ids:
                    now[5].update((("," if begun else "") + ids).encode())
                    begun = True
        if out:
            yield flushed()

    return durable(by_class.mapInArrow(unite, f"conv {kind}, len bigint, total bigint, w bigint, ends string"))


def split(turns: DataFrame, active: DataFrame, start: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round from depth `start`: (nodes of several classes, retired classes, classes still active).

    active has (conv, len, w, ends, name); `name` is the part the class is in.
    """
    block = turns.filter((F.col("pos") >= start) & (F.col("pos") < start + TURNS)).select(F.col("conv").alias("__c"), "pos", "key", "chars")
    held = block.groupBy("__c").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "chars"))).alias("turns"))
    joined = active.join(held, F.col("conv").eqNullSafe(F.col("__c"))).drop("__c")
    names = F.aggregate("turns", F.array("name"), lambda acc, t: F.concat(acc, F.array(digest(F.element_at(acc, -1), t["key"]))))
    paths = durable(joined.withColumn("names", names))
    spread = paths.select("conv", "len", "w", "ends", "names", F.posexplode("turns").alias("j", "t"))
    depth = (F.col("t")["pos"] + 1).cast("long")
    spread = spread.select(F.element_at("names", F.col("j") + 2).alias("name"), F.slice("names", F.lit(1), F.col("j") + 2).alias("path"), depth.alias("depth"), "conv", "w", F.col("t")["chars"].alias("chars"), F.when(F.col("len") == depth, F.col("ends")).alias("ends"))
    nodes = durable(spread.groupBy("name").agg(F.min("depth").alias("depth"), F.min("path").alias("path"), F.min("conv").alias("conv"), F.sum("w").alias("n_convs"), F.count("*").alias("classes"), F.min("chars").alias("chars"), F.max("ends").alias("ends")))
    parent = F.element_at("path", -2)
    shared = nodes.filter(F.col("classes") > 1).select("name", "depth", "path", parent.alias("parent"), "conv", "n_convs", "chars", "ends")
    singles = nodes.filter(F.col("classes") == 1).groupBy("conv").agg(F.min(F.struct("depth", parent.alias("parent"))).alias("s"))
    retired = singles.select("conv", F.col("s")["depth"].alias("from"), F.col("s")["parent"].alias("parent"))
    going = paths.filter(F.col("len") > start + TURNS).select("conv", "len", "w", "ends", F.element_at("names", -1).alias("name"))
    gone = retired.select(F.col("conv").alias("__c"))
    return shared, retired, durable(going.join(gone, F.col("conv").eqNullSafe(F.col("__c")), "left_anti"))


def with_parent(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows with parent_conv, the smallest id of the node named by `parent`, however many rows share it."""
    parents = nodes.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("conv", "parent"), F.lit(SALTS)).cast("int")).join(parents, ["parent", "__salt"], "left").drop("parent", "__salt")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    turns is what numbered() returns, convs (conv, len, total) what lengths() does.
    """
    groups = classes(turns, convs)
    zero = F.lit(0).cast("long")
    ended = F.max(F.when(F.col("len") == 0, F.col("ends"))).alias("ends")
    root = groups.agg(F.min("conv").alias("conv"), F.sum("w").alias("n_convs"), ended).filter(F.col("n_convs").isNotNull())
    # written before it is joined, or its literal name would leave joins without a key
    root = durable(root.select(F.lit("").alias("name"), zero.alias("depth"), F.array(F.lit("")).alias("path"), F.lit(None).cast("string").alias("parent"), "conv", "n_convs", zero.alias("chars"), "ends"))
    kept = durable(by_conversation(turns, groups.select("conv")))
    blocks, retired, start = [root], [], 0
    active = groups.filter(F.col("len") > 0).select("conv", "len", "w", "ends", F.lit("").alias("name"))
    while not active.isEmpty():
        shared, single, active = split(kept, active, start)
        blocks.append(shared)
        retired.append(single)
        start += TURNS
    nodes = blocks[0]
    for b in blocks[1:]:
        nodes = nodes.unionByName(b)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if not retired:
        only = nodes.withColumns({"parent_conv_id": F.lit(None).cast(convs.schema["conv"].dataType), "n_children": zero, "n_leaves": F.lit(1).cast("long"), "saved_tokens": zero, "ends_sha256": F.coalesce("ends", F.lit(NONE))})
        return only.withColumnRenamed("conv", "conv_id").select(*columns)
    chains = retired[0]
    for r in retired[1:]:
        chains = chains.unionByName(r)
    figures = groups.withColumnRenamed("conv", "__c")
    chains = durable(with_parent(chains.join(figures, F.col("conv").eqNullSafe(F.col("__c"))).drop("__c").withColumn("name", F.col("parent")), nodes))
    tails = by_conversation(kept, chains).filter(F.col("pos") + 1 >= F.col("from"))
    at = F.col("pos") + 1
    out = tails.select(
        F.col("conv").alias("conv_id"),
        at.alias("depth"),
        F.when(at > F.col("from"), F.col("conv")).otherwise(F.col("parent_conv")).alias("parent_conv_id"),
        F.col("w").alias("n_convs"),
        (at < F.col("len")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("w") - 1) * (F.col("total") - F.col("before"))).alias("saved_tokens"),
        F.when(at == F.col("len"), F.col("ends")).otherwise(NONE).alias("ends_sha256"),
    )
    # what hangs on each node of several classes: its chains, and its children of the same kind
    tops = tails.filter(at == F.col("from")).select("name", F.lit(1).cast("long").alias("kids"), F.lit(1).cast("long").alias("leaves"), ((F.col("w") - 1) * (F.col("total") - F.col("before"))).alias("saved"))
    kids = nodes.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("name"), F.lit(1).cast("long").alias("kids"), zero.alias("leaves"), zero.alias("saved"))
    hung = durable(tops.unionByName(kids).groupBy("name").agg(*(F.sum(c).alias(c) for c in ("kids", "leaves", "saved"))))
    carried = None
    for block in reversed(blocks):
        own = block.join(hung, "name", "left")
        if carried is not None:
            own = own.join(carried, "name", "left")
        extra = [F.coalesce(F.col(c), zero) for c in (("up_leaves", "up_saved") if carried is not None else ())] or [zero, zero]
        own = own.select("name", "path", (F.coalesce("leaves", zero) + extra[0]).alias("leaves"), (F.coalesce("saved", zero) + extra[1] + (F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
        up = durable(own.select(F.explode("path").alias("name"), "leaves", "saved").groupBy("name").agg(F.sum("leaves").alias("up_leaves"), F.sum("saved").alias("up_saved")))
        done = with_parent(block.join(up, "name").join(hung.select("name", "kids"), "name", "left"), nodes)
        out = out.unionByName(done.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", F.coalesce("kids", zero).alias("n_children"), F.col("up_leaves").alias("n_leaves"), F.col("up_saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NONE)).alias("ends_sha256")))
        carried = up
    return out.select(*columns)
