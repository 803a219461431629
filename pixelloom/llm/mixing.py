"""Mixing sources to target weights.

Tokens are summed per source, every source gets a target, and target over size
is its repetition rate. A document is emitted floor(rate) times, and once more
if a hash of its id, as a number in [0, 1), is below the rate's fraction.

Targets: all sources together keep their total size and share it by weight; a
target stops at `cap` times its source's size, and what is over goes to the
other sources by weight, until no target is above its limit. Sorted by
limit over weight, the capped sources come first, so running sums give the
split point without a loop.

Rows: a null text has size 0, a null source is a source of its own and comes
last, a source of size 0 has target 0. Rows that repeat a doc_id share its
draw; a null doc_id draws by the text's hash. Columns besides doc_id, text and
source pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import SPACED
from pixelloom.operators.ordering import running_sums
from pixelloom.session import durable

#: Weights of the sources in code point order, repeating; the lowest common multiple makes limit over weight an integer.
WEIGHTS, MULTIPLE = (1, 2, 3), 6
CAP = 3
SEED = 42
#: Bytes of source names and figures up to which the table of sources is broadcast; beyond that the join is salted.
BROADCAST_BYTES = 32 << 20
SALTS = 64


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACED)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, multiple: int = MULTIPLE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) of rows (source, size); one row per source, kept in the shared folder."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("s"))
    ranked = running_sums(totals, [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    weighted = ranked.select("source", "s", weight.alias("w"))
    by = [(F.col("s") * F.floor(F.lit(multiple) / F.col("w"))).asc(), F.col("source").asc_nulls_last()]
    filled = durable(running_sums(weighted, by, {"capped": cap * F.col("s"), "used": F.col("w")}))
    total, weight_all = filled.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    rest, left = F.lit(total) - F.col("capped"), F.lit(weight_all) - F.col("used")
    wide = lambda c: c.cast("decimal(38,0)")  # noqa: E731 - words by weights may pass 64 bits
    # the first source whose share of the rest is within its limit, and all after it, share that rest
    fits = wide(rest) * wide(F.col("w")) <= wide(cap * F.col("s")) * wide(left)
    split = filled.filter(fits).agg(F.min(F.struct("used", "capped"))).first()[0]
    if split is None:
        target = F.lit(float(cap)) * F.col("s")
    else:
        share = F.lit(float(total - split.capped)) * F.col("w")
        target = F.when(F.col("used") < split.used, (cap * F.col("s")).cast("double")).otherwise(share / float(weight_all - split.used))
    return durable(filled.select("source", F.col("s").alias("source_size"), target.alias("target")))


def draw(key: Column, text: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from a hash of the seed and the document's id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def with_targets(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (with __source) joined to their source's targets, however large a source is."""
    n, chars = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    named = table.withColumnsRenamed({"source": "__s", "source_size": "__source_size", "target": "__target"})
    if chars + 64 * n <= BROADCAST_BYTES:
        return rows.join(F.broadcast(named), F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s")
    named = named.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__p", F.pmod(F.hash("__u"), F.lit(SALTS)))
    return rows.join(named, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__p") == F.col("__salt")), "left").drop("__s", "__salt", "__p")


def allot(docs: DataFrame, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """docs with __size, __source_size, __target and __copies, how often the mix takes the row."""
    read = docs.withColumns({"__source": docs["source"], "__size": words(docs["text"]), "__u": draw(docs[key], docs["text"], seed)})
    table = targets(read.select(F.col("__source").alias("source"), F.col("__size").alias("size")))
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0)
    copies = F.floor(rate) + (F.col("__u") < rate - F.floor(rate)).cast("long")
    return with_targets(read, table).withColumn("__copies", copies).drop("__source", "__u")


def mix(docs: DataFrame, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """The mix itself: the rows of docs, all columns, each as often as it is taken."""
    taken = allot(docs, seed, key).filter(F.col("__copies") > 0)
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)
