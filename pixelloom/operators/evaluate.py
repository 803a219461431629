"""Evaluation of predictions: rows (pred, truth)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame) -> DataFrame:
    """(pred, truth, n) of pairs that occur."""
    return pairs.groupBy("pred", "truth").agg(F.count("*").alias("n"))


def dense_confusion(pairs: DataFrame, classes: int) -> DataFrame:
    """All classes x classes cells, zeros included; pairs outside the classes do not count."""
    spine = pairs.sparkSession.range(classes * classes).select(F.floor(F.col("id") / classes).alias("pred"), (F.col("id") % classes).alias("truth"))
    return spine.join(confusion(pairs), ["pred", "truth"], "left").select("pred", "truth", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def per_class(pairs: DataFrame, classes: int) -> DataFrame:
    """(class_id, tp, predicted, actual, precision, recall, f1) for every class; a ratio over nothing is 0."""
    cells = confusion(pairs)
    sides = F.array(F.struct(F.col("pred").alias("class_id"), F.col("n").alias("p"), F.lit(0).alias("t")), F.struct(F.col("truth").alias("class_id"), F.lit(0).cast("long").alias("p"), F.col("n").alias("t")))
    marks = cells.select("pred", "truth", "n", F.explode(sides).alias("s"))
    hit = F.when((F.col("pred") == F.col("truth")) & (F.col("s.p") > 0), F.col("n")).otherwise(0)
    sums = marks.groupBy(F.col("s.class_id").cast("long").alias("class_id")).agg(F.sum(hit).alias("tp"), F.sum("s.p").alias("predicted"), F.sum("s.t").alias("actual"))
    spine = pairs.sparkSession.range(classes).withColumnRenamed("id", "class_id")
    full = spine.join(sums, "class_id", "left").na.fill(0, ["tp", "predicted", "actual"])
    precision = F.when(F.col("predicted") == 0, 0.0).otherwise(F.col("tp") / F.col("predicted"))
    recall = F.when(F.col("actual") == 0, 0.0).otherwise(F.col("tp") / F.col("actual"))
    rated = full.withColumns({"precision": precision, "recall": recall})
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", F.when((p == 0) | (r == 0), 0.0).otherwise(2 * p * r / (p + r)))


def macro(pairs: DataFrame, classes: int) -> DataFrame:
    """(precision, recall, f1): means over all classes, those without samples included."""
    return per_class(pairs, classes).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def metrics(pairs: DataFrame, classes: int) -> DataFrame:
    """per_class and, with class_id null and last, macro."""
    rows = per_class(pairs, classes).select("class_id", "precision", "recall", "f1")
    mean = macro(pairs, classes).select(F.lit(None).cast("long").alias("class_id"), "precision", "recall", "f1")
    return rows.unionByName(mean).orderBy(F.col("class_id").asc_nulls_last())


def report(pairs: DataFrame, classes: int) -> str:
    r = macro(pairs, classes).first()
    return f"precision {100 * r.precision:.2f}%, recall {100 * r.recall:.2f}%, f1 {100 * r.f1:.2f}%"


def evolution(epoch: int, train_pairs: DataFrame | None, eval_pairs: DataFrame, classes: int) -> DataFrame:
    """(epoch, split, class_id, precision, recall, f1) of one epoch, on the evaluation set and, if given, the training set."""
    out = metrics(eval_pairs, classes).withColumn("split", F.lit("eval"))
    if train_pairs is not None:
        out = out.unionByName(metrics(train_pairs, classes).withColumn("split", F.lit("train")))
    return out.select(F.lit(epoch).cast("long").alias("epoch"), "split", "class_id", "precision", "recall", "f1")
