"""Data set operators: batches, splits, shuffles, labels.

A data set is a table of samples with a total order. `pos` is a sample's place
in it, `tensor_id` the batch of samples it is packed in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.functions import permutation
from pixelloom.operators.ordering import part_of, with_position
from pixelloom.schema import UNLABELLED

#: Fixed value: files of a class that a capped scan keeps. Scans have no cap unless one is given.
CLASS_CAP = 16_386
#: Tasks that share the ranking of a class.
SALTS = 64


def cap_per_class(samples: DataFrame, order: str, cap: int = CLASS_CAP) -> DataFrame:
    """The first `cap` samples of each class.

    Parts of a class are ranked first, so the task that ranks a class sees SALTS * cap of its samples at most.
    """
    salted = samples.withColumn("__salt", F.pmod(F.xxhash64(order), F.lit(SALTS)))
    for by in (["class_id", "__salt"], ["class_id"]):
        place = F.row_number().over(W.partitionBy(*by).orderBy(order))
        salted = salted.withColumn("__n", place).filter(F.col("__n") <= cap).drop("__n")
    return salted.drop("__salt")


def batched(samples: DataFrame, size: int, *order: Column | str) -> DataFrame:
    """With pos and tensor_id, `size` samples per tensor, the last one shorter."""
    if size <= 0:
        raise ValueError("a tensor holds at least one sample")
    return with_position(samples, *order).withColumn("tensor_id", F.floor(F.col("pos") / size))


def rebatched(samples: DataFrame, size: int) -> DataFrame:
    """Another tensor size, the same order; needs pos."""
    if size <= 0:
        raise ValueError("a tensor holds at least one sample")
    return samples.withColumn("tensor_id", F.floor(F.col("pos") / size))


def minibatches(samples: DataFrame, size: int) -> DataFrame:
    """With batch_id and the place in the batch; the cursor runs over tensor bounds. Needs pos."""
    return samples.withColumns({"batch_id": F.floor(F.col("pos") / size), "in_batch": F.col("pos") % size})


def without_tensors(samples: DataFrame, start: int, end: int) -> DataFrame:
    """Without the tensors from start to before end; the others close up. Needs pos and tensor_id."""
    if start >= end:
        raise ValueError("start must be before end")
    count = samples.agg(F.max("tensor_id")).first()[0]
    if count is None or end > count + 1:
        raise ValueError("end is beyond the last tensor")
    gone = samples.filter(F.col("tensor_id").between(start, end - 1)).count()
    kept = samples.filter((F.col("tensor_id") < start) | (F.col("tensor_id") >= end))
    after = F.col("tensor_id") >= end
    return kept.withColumns({"pos": F.when(after, F.col("pos") - gone).otherwise(F.col("pos")), "tensor_id": F.when(after, F.col("tensor_id") - (end - start)).otherwise(F.col("tensor_id"))})


def appended(first: DataFrame, second: DataFrame) -> DataFrame:
    """second behind first; both need pos and the same sizes of samples."""
    for c in ("n_rows", "n_cols"):
        if c in first.columns:
            sizes = first.select(c).distinct().union(second.select(c).distinct()).distinct().limit(2).count()
            if sizes > 1:
                raise ValueError("the samples differ in size")
    offset = first.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0]
    return first.unionByName(second.withColumn("pos", F.col("pos") + offset))


def shuffled(samples: DataFrame, seed: int, key: str = "sample_id", size: int | None = None) -> DataFrame:
    """In the order of a linear congruential number of key and seed, which any engine can compute; pos and, with a size, tensor_id anew."""
    number = ((F.col(key) + seed) * 1103515245 + 12345) % 2147483648
    dealt = samples.drop("pos", "tensor_id").withColumn("__r", number)
    out = with_position(dealt, F.col("__r"), F.col(key)).drop("__r")
    return rebatched(out, size) if size else out


def permuted(samples: DataFrame, seed: int, n: int | None = None, size: int | None = None) -> DataFrame:
    """Each sample's pos, from 0 to n - 1, becomes another one by a keyed bijection; with a size, tensor_id anew.

    Nothing is sorted or moved; whoever packs tensors moves the rows once, to their
    tensor. Without n, the number of samples is the largest pos and one.
    """
    n = samples.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0] if n is None else n
    out = samples.withColumn("pos", permutation.permuted(F.col("pos"), n, seed)) if n else samples
    return rebatched(out, size) if size else out


def split(samples: DataFrame, parts: int, by: str = "tensor_id") -> DataFrame:
    """With part, 0-based: contiguous runs of tensors, the first parts one larger. Needs `by` without gaps."""
    if parts <= 0:
        raise ValueError("at least one part")
    total = samples.agg(F.coalesce(F.max(by) + 1, F.lit(0))).first()[0]
    return samples.withColumn("part", part_of(F.col(by), int(total), parts))


def one_hot(class_id: Column, n: int) -> Column:
    """n numbers, 1 at the class; all 0 for a class that is not in range."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.when(c == class_id, 1.0).otherwise(0.0))


def class_dictionary(samples: DataFrame, name: str) -> DataFrame:
    """(class_id, class_name): names in order, numbered from 0. One row per class."""
    return with_position(samples.select(F.col(name).cast("string").alias("class_name")).distinct(), "class_name", name="class_id").select("class_id", "class_name")


def labelled(samples: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """With class_id by the dictionary; unknown names are unlabelled."""
    named = classes.select("class_id", F.col("class_name").alias("__name"))
    joined = samples.join(named, samples[name].cast("string") == F.col("__name"), "left").drop("__name")
    return joined.withColumn("class_id", F.coalesce("class_id", F.lit(UNLABELLED).cast("long")))


def train_eval(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Both in one table with a column split; both must have the same number of classes, at least one."""
    a, b = (d.filter(F.col("class_id") != UNLABELLED).agg(F.countDistinct("class_id")).first()[0] for d in (train, evaluation))
    if a != b or not a:
        raise ValueError(f"{a} classes to train on and {b} to evaluate")
    return train.withColumn("split", F.lit("train")).unionByName(evaluation.withColumn("split", F.lit("eval")))


def relabelled(samples: DataFrame, old: int, new: int) -> DataFrame:
    """With class `new` in place of `old`."""
    return samples.withColumn("class_id", F.when(F.col("class_id") == old, new).otherwise(F.col("class_id")).cast("long"))


def class_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("class_id").agg(F.count("*").alias("n"))


def sizes(samples: DataFrame, by: str) -> DataFrame:
    return samples.groupBy(by).agg(F.count("*").alias("n"))
