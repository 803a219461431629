"""Column layouts that the operators share."""

from __future__ import annotations

from pyspark.sql import types as T

SAMPLES = T.StructType(
    [
        T.StructField("sample_id", T.LongType()),
        T.StructField("class_id", T.LongType()),
        T.StructField("n_rows", T.IntegerType()),
        T.StructField("n_cols", T.IntegerType()),
        T.StructField("data", T.ArrayType(T.DoubleType())),
    ]
)
IMAGES = T.StructType(
    [
        T.StructField("sample_id", T.LongType()),
        T.StructField("class_id", T.LongType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("px", T.ArrayType(T.IntegerType())),
    ]
)
MATRIX = T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("v", T.DoubleType())])
CLASSES = T.StructType([T.StructField("class_id", T.LongType()), T.StructField("class_name", T.StringType())])
#: Class of a sample that has none.
UNLABELLED = -1
