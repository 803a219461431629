"""Samples and images out of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators.pixels import quantise

SIDE = 8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """The embeddings as 8 x 8 samples with classes 0..9."""
    e = table(spark, folder, "embeddings")
    data = F.transform("embedding", lambda v: v.cast("double"))
    return e.select(F.col("vec_id").alias("sample_id"), F.col("label").cast("long").alias("class_id"), F.lit(SIDE).alias("n_rows"), F.lit(SIDE).alias("n_cols"), data.alias("data"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """The embeddings as 8 x 8 images."""
    e = table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), F.col("label").cast("long").alias("class_id"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), quantise(F.col("embedding")).alias("px"))
