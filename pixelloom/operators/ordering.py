"""Positions and running sums over a whole table without a single-task sort.

Rows are dealt out by ranges of the order, windows run inside each range, and
the totals of earlier ranges come from a table of one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.session import durable

#: Partitions up to which each value of by_partition() has its own.
MANY = 4096


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """`df` with running sums over `order`, exclusive of the row itself, in bigint columns named by `sums`.

    The order must be total for the result to be the same in every run. The rows
    are written once to the shared folder, so wide ones are better numbered by
    their keys alone and joined.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # kept in the shared folder, since a repeated range partitioning could cut elsewhere
    dealt = durable(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    inside = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = dealt.groupBy("__part").agg(*(F.sum(c).alias(f"__{k}") for k, c in sums.items()))
    totals = totals.select("__part", *(F.coalesce(F.sum(f"__{k}").over(before), zero).alias(f"__{k}") for k in sums))
    out = dealt.select("*", *(F.coalesce(F.sum(c).over(inside), zero).alias(k) for k, c in sums.items()))
    # one row per part: as many as shuffle partitions
    out = out.join(F.broadcast(totals), "__part")
    return out.select(*df.columns, *((F.col(k) + F.col(f"__{k}")).alias(k) for k in sums))


def by_partition(df: DataFrame, number: str, n: int) -> DataFrame:
    """`df` in n partitions, one for each value 0 to n - 1 of an integer column.

    repartition() by the number itself would put several values into one
    partition and leave others empty, so each value gets a key whose hash, the one
    that repartition() takes, falls into its own partition. Were that not so, the
    rows would only be spread less evenly. With more than MANY values, a task gets
    several in turn anyway, and chance spreads them.
    """
    if n == 1 or n > MANY:
        return df.repartition(n, number)
    spark = df.sparkSession
    found = spark.range(64 * n).select(F.pmod(F.hash(F.col("id")), F.lit(n)).alias("part"), "id").groupBy("part").agg(F.min("id").alias("id")).collect()
    keys = {r.part: r.id for r in found}
    own = F.array(*(F.lit(keys.get(k, k)).cast("long") for k in range(n)))
    return df.withColumn("__key", F.get(own, F.col(number))).repartition(n, "__key").drop("__key")


def with_position(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """`df` with the 0-based place of each row in the order."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    return running_sums(df, columns, {name: F.lit(1).cast("long")})


def part_of(pos: Column, total: Column | int, parts: int) -> Column:
    """0-based contiguous part of a position when `total` rows go to `parts` parts, the first ones a row larger."""
    total = F.lit(total) if isinstance(total, int) else total
    small, over = F.floor(total / parts), total % parts
    edge = over * (small + 1)
    return F.when(pos < edge, F.floor(pos / (small + 1))).otherwise(over + F.floor((pos - edge) / F.greatest(small, F.lit(1)))).cast("long")
